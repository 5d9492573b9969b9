import random

import pytest

from flowloom.plans.catalog import damaged_csv
from flowloom.plans.flow_plan import flow_features
from flowloom.schemas import FLOW_NAMES, SHORT_HEADERS
from flowloom.sources.files import read_flow_csv, split_flow_csv, stream_flow_csv, stream_flow_lines
from flowloom.sources.grown import _GrownReader, stream_lines
from flowloom.sources.tables import packets_from_events

HEADER = ",".join(SHORT_HEADERS)


def row(n, last="1"):
    return ",".join(["id"] + [str(n)] * 86 + [last])


def test_ranges_cut_lines_anywhere(tmp_path):
    rng = random.Random(1)
    lines = ["x" * rng.choice([0, 0, 1, 3, 20]) + str(i) for i in range(60)]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\nunfinished")
    for split in range(1, 40):
        reader = _GrownReader(str(tmp_path), ".csv", split)
        parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
        assert [line for p in parts for _, _, line in reader.read(p)] == lines


def test_notes_between_batches(tmp_path):
    reader, path = _GrownReader(str(tmp_path), ".csv", 1000), tmp_path / "a.csv"

    def batch(start):
        end = reader.latestOffset()
        return end, [line for p in reader.partitions(start, end) for _, _, line in reader.read(p)]

    path.write_text("a\nb")
    note, got = batch(reader.initialOffset())
    assert got == ["a"]
    path.write_text("a\nbc\nd")  # grown, half a line before
    note, got = batch(note)
    assert got == ["bc"]
    assert batch(note)[1] == []
    path.write_text("a\nbc\nd\n" + "long\n" * 3000)
    note, got = batch(note)
    assert got == ["d"] + ["long"] * 3000
    path.write_text("a\nnew\n")  # shorter
    note, got = batch(note)
    assert got == ["a", "new"]
    path.write_text("z\nnew\nnewer\n")  # longer, another head
    note, got = batch(note)
    assert got == ["z", "new", "newer"]
    (tmp_path / "b.csv").write_text("second\n")
    (tmp_path / "_c.csv").write_text("hidden\n")
    assert batch(note)[1] == ["second"]


def test_stream_over_a_growing_and_recreated_file(spark, tmp_path):
    folder, path, out, state = tmp_path / "in", tmp_path / "in" / "flows.csv", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    seen = []

    def run():
        rows = stream_flow_csv(spark, str(folder)).toDF(*FLOW_NAMES).select("src_port")
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        now = [r.src_port for r in spark.read.parquet(out).collect()]
        fresh = sorted(now)
        for x in seen:
            fresh.remove(x)
        seen.extend(fresh)
        return fresh

    path.write_text(f"{HEADER}\n{row(1)}\n{row(2)[:50]}")
    assert run() == [1]
    path.write_text(f"{HEADER}\n{row(1)}\n{row(2)}\n{row(3)}\n")
    assert run() == [2, 3]
    path.write_text(f"{HEADER}\n{row(7)}\n")  # recreated under its name
    assert run() == [7]
    assert run() == []


def test_rows_set_aside(spark, tmp_path):
    path = tmp_path / "flows.csv"
    path.write_text("\n".join([HEADER, row(1), row(2, "seven"), row(3) + ",9", row(4).rsplit(",", 8)[0], row(5), '"a,b"' + row(6)[2:]]) + "\n")
    good, bad = split_flow_csv(spark, str(path))
    assert sorted(r.src_port for r in good.toDF(*FLOW_NAMES).collect()) == [1, 5, 6]
    assert sorted((r.reason, r.line[:5]) for r in bad.collect()) == [("cell_count", "id,3,"), ("cell_count", "id,4,"), ("cell_type", "id,2,")]
    for n, text in enumerate([row(2, "seven"), row(3) + ",9", row(4).rsplit(",", 8)[0]]):
        one = tmp_path / f"one{n}.csv"
        one.write_text(f"{HEADER}\n{row(1)}\n{text}\n")
        with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
            read_flow_csv(spark, str(one), "short").collect()


def test_another_header_stops_the_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(",".join(SHORT_HEADERS[::-1]) + "\n" + row(1) + "\n")
    query = stream_flow_lines(spark, str(tmp_path / "in")).select("reason").writeStream.format("noop").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="another header"):
        query.awaitTermination()
    assert stream_lines(spark, str(tmp_path / "in")).isStreaming


def test_damaged_csv_is_written_by_many_tasks(spark, sf_small):
    """Each file of the damaged lines has its header; they aren't gathered in one task."""
    before = {n: spark.conf.get(n) for n in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    for n, v in zip(before, ("false", "3")):
        spark.conf.set(n, v)
    try:
        good, bad = damaged_csv(spark, sf_small)
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert bad.select("path").distinct().count() > 1
    assert {r.reason for r in bad.select("reason").distinct().collect()} == {"cell_count", "cell_type"}
    assert good.count() + bad.count() == flow_features(packets_from_events(spark, sf_small)).count()
