import pytest

from flowloom.llm.decontaminate import find_leaks

ITEM = ("A train leaves the old station with Alice Smith at 40 km per hour and returns after 3 hours with 40 boxes for Bob, "
        "so how far did the train go in all before it came back to the station")


@pytest.fixture
def benchmark(spark):
    rows = [(1, ITEM, "x"), (2, None, "x"), (3, "", "x"), (4, "tiny item", "x"), (5, "five words make this item", "x"), (None, "an item that has no number but enough words to be found again", "x")]
    return spark.createDataFrame(rows, "item_id long, text string, slots string")


def leaks(docs, benchmark, **more):
    return {(r.doc_id, r.item_id): r for r in find_leaks(docs, benchmark, **more).collect()}


def test_cases(docs_of, benchmark):
    other = ITEM.replace("40", "75").replace("3 hours", "9 hours").replace("Alice Smith", "Carol Jones").replace("Bob", "Dan")
    torn = ITEM.replace("40 boxes", "41 boxes")  # one value of the item stands for two
    rows = [(1, f"Some words first. {ITEM} And more."), (2, f"Lead in.\n{other}. End"), (3, f"Well. {torn}"), (4, " ".join(ITEM.split()[:25])),
            (5, " ".join(ITEM.split()[:10]) + " nothing else of it"), (6, None), (7, ""), (8, "Five words make this item!"), (9, "tiny item tiny item"),
            (None, ITEM), (11, ITEM.upper()), (12, "clean text " * 2000), (13, ITEM), (13, ITEM), (14, "one an item that has no number but enough words to be found again")]
    got = leaks(docs_of(rows), benchmark)
    assert set(got) == {(1, 1), (2, 1), (4, 1), (8, 5), (None, 1), (13, 1), (14, None), (11, 1)}
    assert got[1, 1].verbatim and got[1, 1].coverage > 0.9 and not got[2, 1].verbatim and got[13, 1].verbatim
    assert got[4, 1].coverage < 0.9
    small = leaks(docs_of(rows), benchmark, block_windows=7)
    assert set(small) == set(got)


def test_two_occurrences(docs_of, benchmark):
    other = ITEM.replace("40", "75")
    got = leaks(docs_of([(1, f"{ITEM}. Again: {other}.")]), benchmark)
    assert got[1, 1].occurrences == 2 and got[1, 1].verbatim


def test_empty(docs_of, benchmark):
    assert leaks(docs_of([]), benchmark) == {}
    assert leaks(docs_of([(1, ITEM)]), benchmark.filter("false")) == {}


PLAIN = "the quick brown fox jumps over the lazy dog while seven tired sailors watch from an old wooden pier and talk about the long way back to their small island home"


def test_words_put_in_or_left_out_and_long_runs(spark, docs_of):
    words, long = PLAIN.split(), " ".join(f"{a}{b}" for a in "abcdefgh" for b in ("tok", "lim", "ras", "den", "pov", "kul", "mig", "sef", "bor", "wan"))
    items = spark.createDataFrame([(1, PLAIN), (2, long)], "item_id long, text string")
    more, less = words[:15] + ["very"] + words[15:], words[:14] + words[15:]
    run = long.split()[30:43]
    rows = [(1, " ".join(more)), (2, " ".join(less)), (3, "lead " + " ".join(run) + " tail"), (4, "lead " + " ".join(run[:12]) + " tail"), (5, " ".join(more) + ". " + " ".join(less)),
            (6, PLAIN), (6, "another text " * 50)]
    got = leaks(docs_of(rows), items)
    assert set(got) == {(1, 1), (2, 1), (3, 2), (5, 1), (6, 1)}
    assert got[5, 1].occurrences == 2 and got[1, 1].verbatim and got[3, 2].verbatim and got[3, 2].coverage < 0.1


APPLES = "Alice has 3 apples. Bob gives Alice 5 more. Alice then eats 2 of them. How many apples does Alice have now?"
SHIP = "In the harbour a sailor called {} sold the red boat to the old uncle of {} before the long winter came and the ice closed every bay"

PORT = "At the far end of the port {} and the other men of the crew had to wait for days until {} came back with the keys and the maps of the whole northern coast"


def test_names_that_open_sentences_and_odd_capitals(spark, docs_of):
    items = spark.createDataFrame([(1, APPLES), (2, SHIP.format("McDonald", "Łukasz")), (3, PORT.format("Alice", "Bob"))], "item_id long, text string")
    other = APPLES.replace("Alice", "Zoe").replace("Bob", "Tom").replace("3", "4").replace("5", "7").replace("2", "1")
    mixed = other.replace("does Zoe", "does Tom")
    rows = [(1, other), (2, f"He said: {APPLES}"), (3, SHIP.format("Carol", "Dan")), (4, SHIP.format("DAN", "Žofie")), (5, PORT.format("Dan", "Dan")), (6, mixed), (7, APPLES.upper()), (8, PORT.format("Dan", "Eve"))]
    got = leaks(docs_of(rows), items)
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 2), (7, 1), (8, 3)}
    assert not got[1, 1].verbatim and got[1, 1].coverage > 0.8 and got[2, 1].verbatim and got[7, 1].verbatim


def test_items_without_telling_windows(spark, docs_of):
    table = " ".join(str(k * k % 97) for k in range(3, 23))
    items = spark.createDataFrame([(1, "What is 12 + 7 * 3?"), (2, table), (3, "12 / 5"), (4, "Is 3 odd?"), (5, "a b")], "item_id long, text string")
    rows = [(1, "Q: What is 12 + 7 * 3? A: 33"), (2, "what is 12 - 7 * 3"), (3, "what is 12 + 8 * 3"), (4, f"rows\n{table}\nend"), (5, " ".join(table.split()[:9])),
            (6, "so 12/5 is 2.4"), (7, "12 5"), (8, "tell me, is 3 odd"), (9, "a b"), (10, "what is"), (11, "12 + 7 * 3"), (12, " ".join(table.split()[2:16]))]
    got = leaks(docs_of(rows), items)
    assert set(got) == {(1, 1), (4, 2), (6, 3), (8, 4), (12, 2)}
    assert all(r.verbatim for r in got.values()) and got[1, 1].coverage == 1


BOXES = "How many boxes of 40 fill 12 carts if each cart takes 40"


def test_runs_at_stops_and_edges(spark, docs_of):
    turned = "40 boxes of tea were put on the first cart while the other carts took 40 boxes for Ann and then left with Ann"
    items = spark.createDataFrame([(1, BOXES), (2, turned), (3, "the pump moves 3.5 tons in an hour so what will it move in two hours at 3.5")], "item_id long, text string")
    rows = [(1, f"{BOXES}? 480."), (2, f"{BOXES} 480"), (3, f"7. {turned} Miller"), (4, f"7) {turned}."), (5, BOXES.replace("40", "30") + "\n360"),
            (6, BOXES.replace("40 fill", "30 fill")), (7, turned.replace("40", "55") + ". Bob"), (8, "the pump moves 4 tons in an hour so what will it move in two hours at 4"),
            (9, f"No 7 {turned.replace('40', '41')}")]
    got = leaks(docs_of(rows), items)
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 1), (7, 2), (8, 3), (9, 2)}
    assert got[1, 1].verbatim and got[2, 1].verbatim and got[3, 2].verbatim and got[4, 2].verbatim and not got[9, 2].verbatim
    assert got[1, 1].coverage == 1


def edited(words, kind, rnd, strange):
    words = list(words)
    for _ in range(2 if kind == "two in" else 1):
        at = rnd.randrange(1, len(words) - 1)
        words[at:at + (kind in ("out", "changed"))] = [] if kind == "out" else [rnd.choice(strange)]
    return " ".join(words)


def test_near_copies_of_benchmark_items(spark, docs_of, sf_small):
    """A word or two put in, a word left out or changed, anywhere: nine of ten copies are found, and nothing in texts without one."""
    import random

    rnd = random.Random(9)
    items = spark.read.parquet(f"{sf_small}/benchmark.parquet")
    texts = {r.item_id: r.text.split() for r in items.collect()}
    every = sorted({w for t in texts.values() for w in t})
    filler = lambda n: " ".join(rnd.choices(every, k=n))
    kinds = ["in", "out", "changed", "two in"]
    rows = [(k * 1000 + i, f"{filler(40)}.\n{edited(t, kind, rnd, ['zebra', 'quay', 'umber'])}\n{filler(40)}.") for k, kind in enumerate(kinds) for i, t in texts.items()]
    rows += [(9000 + i, filler(300)) for i in range(200)]
    found = {(d, i) for d, i in leaks(docs_of(rows), items)}
    for k, kind in enumerate(kinds):
        hit = sum((k * 1000 + i, i) in found for i in texts)
        assert hit >= 0.9 * len(texts), (kind, hit, sorted(len(t) for i, t in texts.items() if (k * 1000 + i, i) not in found))
    assert not [d for d, _ in found if d >= 9000]
    assert all(d % 1000 == i for d, i in found)
