import random
import re

from flowloom.llm.license_scan import BASE_PHRASES, TEMPLATES, Automaton, license_report, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    w = words_of(text)
    hits = sorted((i, label) for p, label in BASE_PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
    return len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(sorted({x for _, x in hits}))


def test_base_places(docs_of, odd):
    rnd = random.Random(1)
    vocabulary = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "the", "x"]
    rows = odd + [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 60)))) for i in range(100, 400)]
    rows += [(500, "CC-BY 4.0, All Rights  Reserved!"), (501, "cc\nby cc by by"), (502, "general public licenseé"), (503, "cc"), (504, "by")]
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_report(scan_licenses(docs_of(rows))).collect()), key=str)
    assert got == sorted(((i, *base(t)) for i, t in rows), key=str)


def test_templates_are_covered(docs_of):
    rows = [(i, f"lorem ipsum {t.upper()} dolor sit") for i, (_, t) in enumerate(TEMPLATES)]
    rows += [(100, "Licensed under CC BY-NC 4.0."), (101, "the file and the license of this"), (102, "")]
    rows += [(103, "permission is hereby granted free of charge to ANY NEW person obtaining a copy of this software and associated files "
                   "the software to deal in the software without restriction")]
    got = {r.doc_id: r for r in license_report(scan_licenses(docs_of(rows))).collect()}
    for i, (label, t) in enumerate(TEMPLATES):
        assert label in got[i].labels.split(",") and got[i].score == 1.0, t
        assert any((s.start, s.stop) == (2, 2 + len(t.split())) and s.share == 1.0 for s in got[i].spans)
    assert got[100].labels == "cc-by,cc-by-nc" and got[101].labels == "" and got[101].score == 0 and got[102].labels == ""
    assert got[103].labels == "mit" and 0.75 <= got[103].score < 1


def test_matching_statistics():
    auto = Automaton(TEMPLATES, BASE_PHRASES)
    texts = [t.split() for _, t in TEMPLATES] + [p.split() for p in BASE_PHRASES]
    runs = {tuple(t[a:b]) for t in texts for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
    rnd = random.Random(3)
    for _ in range(60):
        text = []
        while len(text) < 40:
            t = rnd.choice(texts)
            a = rnd.randrange(len(t))
            text += t[a:a + rnd.randint(1, 8)]
        longest = [max(k for k in range(min(i, 60) + 1) if k == 0 or tuple(text[i - k:i]) in runs) for i in range(len(text) + 1)]
        want = [(i - longest[i], i) for i in range(1, len(text) + 1) if longest[i] >= 2 and (i == len(text) or longest[i + 1] <= longest[i])]
        matches, _ = auto.walk([auto.number[w.encode()] for w in text])
        assert [(a, b) for a, b, _ in matches] == want


def test_empty(docs_of):
    assert license_report(scan_licenses(docs_of([]))).count() == 0


def test_notices_in_a_row_and_single_words(docs_of):
    label, notice = next((x, t) for x, t in TEMPLATES if x == "mit")
    n = len(notice.split())
    got = {r.doc_id: r for r in scan_licenses(docs_of([(1, f"{notice}. {notice}."), (2, f"{notice} {' '.join(notice.split()[:2])} and {notice}")])).collect()}
    assert [(s.start, s.stop, s.label) for s in got[1].spans] == [(0, n, label), (n, 2 * n, label)]
    assert [(s.stop - s.start, s.label) for s in got[2].spans if s.share == 1] == [(n, label), (n, label)]
    one = scan_licenses(docs_of([(1, "the copyleft, and gpl copyleft")]), phrases={"copyleft": "copyleft", "gpl copyleft": "both"}).first()
    assert sorted((p.start, p.label) for p in one.phrases) == [(1, "copyleft"), (3, "both"), (4, "copyleft")]
