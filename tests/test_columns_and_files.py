import glob

import pytest

from flowloom.operators import columns as C
from flowloom.operators.filters import host_filter, validate_ip
from flowloom.plans.flow_plan import flow_features
from flowloom.schemas import CIC2017_HEADERS, FLOW_NAMES, FLOW_TYPES, SHORT_HEADERS, SHORT_TO_CIC2017
from flowloom.sources.files import read_flow_csv, rename_flow_csv, write_flow_csv
from flowloom.sources.tables import packets_from_events


def test_header_lists():
    assert len(SHORT_HEADERS) == len(set(SHORT_HEADERS)) == 88
    assert len(CIC2017_HEADERS) == len(set(CIC2017_HEADERS)) == 88
    assert len(SHORT_TO_CIC2017) == 48
    with pytest.raises(ValueError):
        C.header_names("long")


def test_rename_and_duplicates(spark):
    df = spark.createDataFrame([(1, 2)], "`Tot Fwd Pkts` int, other int")
    assert C.rename_features(df).columns == ["Total Fwd Packets", "other"]
    clash = spark.createDataFrame([(1, 2)], "`Tot Fwd Pkts` int, `Total Fwd Packets` int")
    with pytest.raises(ValueError):
        C.rename_features(clash)


def test_alias_chain_and_prepare(spark):
    df = spark.createDataFrame([(1,)], "a int")
    chained = C.resolve_aliases(df, {"c": "b", "b": "a", "x": "y"})
    assert sorted(chained.columns) == ["a", "b", "c"] and chained.first().c == 1
    names = ["Idle Max", "FWD Init Win Bytes", "Total Backward Packets", "CWR Flag Count"]
    short = spark.createDataFrame([(2.5, 0, 17, 3)], "`Idle Max` double, `Init Fwd Win Byts` bigint, `Tot Bwd Pkts` bigint, `CWE Flag Count` bigint")
    long = short.toDF(*names)
    assert C.prepare_features(short, names).collect() == C.prepare_features(long, names).collect()
    with pytest.raises(ValueError):
        C.prepare_features(short, names + ["Idle Min"])


def test_schema_diff(spark):
    d = C.schema_diff(["a", "b", "x"], ["b", "c"])
    assert (d["missing"], d["extra"]) == (["c"], ["a", "x"])
    a = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, name string")
    b = spark.createDataFrame([(0, "b"), (1, "c")], "pos int, name string")
    assert {tuple(r) for r in C.schema_diff_table(a, b).collect()} == {("missing", 1, "c"), ("extra", 0, "a")}


def test_select_features_fills_absent_columns(spark):
    row = C.select_features(spark.createDataFrame([(7,)], "tot_fwd_pkts bigint")).first()
    assert len(row) == 88 and row["Tot Fwd Pkts"] == 7 and row["Idle Min"] == 0


def test_select_features_takes_every_header_style(spark):
    df = spark.createDataFrame([(7, 2.5)], "`Total Fwd Packets` bigint, `Average Packet Size` double")
    for style, packets, size in (("short", "Tot Fwd Pkts", "Pkt Size Avg"), ("cic2017", "Total Fwd Packets", "Average Packet Size")):
        out = C.select_features(df, style)
        row = out.first()
        assert row[packets] == 7 and row[size] == 2.5 and row["Idle Min"] == 0.0
        assert [t for _, t in out.dtypes] == [FLOW_TYPES[n] for n in FLOW_NAMES]


def test_alias_cycles_and_long_chains():
    assert C.resolve_alias_names(["z"], {"a": "b", "b": "a", "c": "c"}) == []
    chain = {f"n{i}": f"n{i + 1}" for i in range(50)}
    assert dict(C.resolve_alias_names(["n50", "n3"], chain)) == {f"n{i}": "n3" if i < 3 else "n50" for i in range(50) if i != 3}


def test_csv_columns_are_found_by_name(spark, tmp_path):
    order = [*SHORT_HEADERS[1:], SHORT_HEADERS[0]]
    cells = {h: str(i + 1) for i, h in enumerate(SHORT_HEADERS)} | {"Flow ID": "x\xffy"}
    path = tmp_path / "swapped.csv"
    path.write_bytes((",".join(order) + "\n" + ",".join(cells[h] for h in order) + "\n").encode("latin-1"))
    row = read_flow_csv(spark, str(path), "short").first()
    assert row["Flow ID"] == "xy" and row["Src Port"] == 3 and row["Tot Fwd Pkts"] == 9
    assert read_flow_csv(spark, str(path)).columns == order
    with pytest.raises(ValueError):
        read_flow_csv(spark, str(path), "cic2017")
    other = tmp_path / "both"
    other.mkdir()
    (other / "a.csv").write_text(",".join(SHORT_HEADERS) + "\n" + ",".join(["1"] * 88) + "\n")
    (other / "b.csv").write_text(",".join(order) + "\n" + ",".join(["1"] * 88) + "\n")
    with pytest.raises(Exception, match="header"):
        read_flow_csv(spark, str(other), "short").collect()


def test_validate_ip(spark):
    cases = {"": "empty", "  ": "empty", "1.2.3": "malformed", "256.1.1.1": "malformed", "01.2.3.4": "malformed",
             "a.b.c.d": "malformed", "0.0.0.0": "wildcard", " 10.0.0.1 ": "ok", "10.0.0.2": "not_allowed",
             None: "empty", "1.2.3.4\n5": "malformed"}
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "id int, addr string")
    got = validate_ip(df, "addr", spark.createDataFrame([("10.0.0.1",), ("10.0.0.1",)], "ip string"))
    assert [r.status for r in got.orderBy("id").collect()] == list(cases.values())


def test_host_filter(spark, sf_small):
    packets = packets_from_events(spark, sf_small)
    kept = host_filter(packets, "192.168.1.2")
    assert kept.count() == packets.filter("dst_ip_int = 3232235778 or src_ip_int = 3232235778").count() > 0


def test_csv_round_trip_and_rename(spark, sf_small, tmp_path):
    flows = flow_features(packets_from_events(spark, sf_small)).cache()
    short, long, none = (str(tmp_path / n) for n in ("short", "long", "none"))
    write_flow_csv(flows, short)
    back = read_flow_csv(spark, short, "short").toDF(*FLOW_NAMES)
    want = flows.select(*FLOW_NAMES)
    assert back.count() == 35 and back.exceptAll(want).count() == 0
    rename_flow_csv(spark, short, long)
    renamed = read_flow_csv(spark, long)
    assert renamed.columns == CIC2017_HEADERS and renamed.count() == 35
    text = read_flow_csv(spark, short)
    assert set(dict(text.dtypes).values()) == {"string"}
    assert renamed.toDF(*SHORT_HEADERS).exceptAll(text).count() == 0
    write_flow_csv(flows.filter("1 = 0"), none)
    lines = "".join(open(f).read() for f in glob.glob(none + "/part-*"))
    assert lines.strip().split(",") == SHORT_HEADERS
