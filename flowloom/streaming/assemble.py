"""Live flows batch by batch, with the state of open flows in tables.

Each micro-batch is the next stretch of every key's packets: those the watermark has passed, in final order.
The batch plan's own steps run on it. A stretch is to the stretch before what a chunk of a hot key is to the chunk
before (see ``operators/carry.py``), so a key's open flow goes on from one row of state, and a destination that
is being flooded is cut into chunks over many tasks here as well. Two-way flows keep sums for both sides of a
pair, so which side opened a flow is known from its own row (see ``operators/orient.py``).

State, in a folder that all executors share:

``open/batch=B/bucket=K``
    a row for each open flow of the keys that hash to ``K``, with its sums and its carry, as batch ``B`` left them. A batch
    reads and writes only buckets that it touches: those of its packets and those with a flow that falls idle.
``waiting/batch=B``
    packets that batch ``B`` brought and the watermark had not passed then; written once, read as they fall due.
``manifest/B.json``
    what makes up the state after batch ``B``: one small file, written last, so that a batch counts or doesn't.
``manifest/B.closed.json``
    the stream was closed after batch ``B``: all that was open is out. Fences off batches up to ``B``.

A batch that is run again reads the manifest before it and overwrites what it wrote, so output is exact once.
Files that neither of the last two manifests names are deleted; intermediate tables go with each batch. The number
of files therefore depends on the buckets, not on how long the stream has run.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowloom.operators import carry as carry_ops
from flowloom.operators.custom import FlowFeature, packet_values
from flowloom.operators.deltas import mark, resolve
from flowloom.operators.features import FLOW_LABEL, aggregate_flows, flow_record
from flowloom.operators.hotkeys import CHUNK_ROWS, key_stats, split_hot_keys
from flowloom.operators.orient import PAIR, as_pairs, turn_flows
from flowloom.operators.syncut import IDLE_US, ORDER, SYN_THRESHOLD, syn_cuts_after, syn_cuts_chunked
from flowloom.plans.flow_plan import DST_KEY, with_cuts
from flowloom.session import durable, names_in, read_text, remove, scratch, write_text

_BODY = [*ORDER, "header_len", "payload_len", "tcp_flags", "is_fwd"]
_FOREVER = 1 << 62
BUCKETS = 16


def _merged(before: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    """Sums of flows of two stretches, added; one row for each flow of either, ``grown`` if the later one has packets of it."""
    label = key + FLOW_LABEL
    a, b = before.alias("a"), now.alias("b")
    joined = a.join(b, label, "full")
    out: dict[str, Column] = {}
    for m in [c.removesuffix("_var") for c in now.columns if c.endswith("_var")]:
        n1, n2 = (F.coalesce(F.col(f"{t}.{m}_n"), F.lit(0)) for t in "ab")
        s1, s2 = (F.coalesce(F.col(f"{t}.{m}_sum"), F.lit(0)) for t in "ab")
        d1, d2 = (F.coalesce(F.col(f"{t}.{m}_var"), F.lit(0.0)) * (n - 1) for t, n in (("a", n1), ("b", n2)))
        shift = s1 / n1 - s2 / n2
        both = d1 + d2 + F.when((n1 > 0) & (n2 > 0), shift * shift * n1 * n2 / (n1 + n2)).otherwise(0.0)
        out[f"{m}_n"] = n1 + n2
        out[f"{m}_sum"] = F.when(n1 + n2 > 0, s1 + s2)
        out[f"{m}_var"] = F.when(n1 + n2 > 1, both / (n1 + n2 - 1))
    for c in now.columns:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in label or c in out:
            continue
        if c.endswith("_min"):
            out[c] = F.least(x, y)
        elif c.endswith("_max") or c == "flow_end_us":
            out[c] = F.greatest(x, y)
        elif c == "was_cut":
            out[c] = F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False))
        elif c.endswith("_set"):
            out[c] = F.array_union(*[F.coalesce(v, F.array().cast(now.schema[c].dataType.simpleString())) for v in (x, y)])
        elif c == "first_fwd":
            out[c] = F.coalesce(x, y)
        else:
            out[c] = F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))
    return joined.select(*label, *[e.cast(now.schema[c].dataType.simpleString()).alias(c) for c, e in out.items()],
                         F.col("a.state").alias("old_state"), F.col("b.flow_end_us").isNotNull().alias("grown"))


class FlowAssembler:
    """Turns micro-batches of packets into closed flows.

    ``state`` is a folder that all executors share, for this stream alone; flows go to ``target``, one folder a batch, late packets to
    ``target`` + ``-late``. With ``two_way`` both directions of a conversation are one flow, closed by the idle timeout only.
    ``buckets`` should make a bucket of open flows one file of usual size; it is fixed for the life of the state, as are
    the user's own ``features``.

    ``then(flows, name)`` is handed the flows of each batch, and of the close-out, once they are written and before the batch counts; a
    batch that is run again is handed over again under the same name (``7``, ``7-closed``), so what it writes under the name is exact once.
    """

    def __init__(self, spark: SparkSession, state: str, target: str, delay_us: int = 10_000_000, threshold: int = SYN_THRESHOLD,
                 idle_us: int = IDLE_US, chunk_rows: int | None = None, key: list[str] | None = None, two_way: bool = False,
                 buckets: int = BUCKETS, then: Callable[[DataFrame, str], None] | None = None,
                 features: Sequence[FlowFeature] = ()):
        self.spark, self.state, self.target = spark, state.rstrip("/"), target.rstrip("/")
        self.delay_us, self.threshold, self.idle_us, self.chunk_rows = delay_us, threshold, idle_us, chunk_rows
        self.then, self.features = then, list(features)
        self.two_way, self.buckets, self.key = two_way, buckets, PAIR if two_way else key or DST_KEY

    # ---- the manifest

    def _read_manifest(self, name: str) -> dict | None:
        text = read_text(self.spark, f"{self.state}/manifest/{name}.json")
        return json.loads(text) if text else None

    def _numbers(self, suffix: str) -> list[int]:
        names = [n.removesuffix(suffix) for n in names_in(self.spark, f"{self.state}/manifest") if n.endswith(suffix)]
        return sorted(int(n) for n in names if n.isdigit())

    def last_batch(self) -> int:
        """Number of the last finished batch, of this run or an earlier one; -1 before the first."""
        return max(self._numbers(".json"), default=-1)

    def closed_after(self) -> int:
        """Number of the last batch after which the stream was closed, -1 if it never was."""
        return max(self._numbers(".closed.json"), default=-1)

    def _state_after(self, batch_id: int) -> dict:
        found = (self._read_manifest(f"{batch_id}.closed") or self._read_manifest(str(batch_id))) if batch_id >= 0 else None
        if found is None:
            if batch_id >= 0:
                raise RuntimeError(f"{self.state} has no state after batch {batch_id}: it isn't this stream's, or it has been cleared")
            return {"passed_us": -_FOREVER, "newest_us": -_FOREVER, "late": 0, "open": {}, "waiting": [], "buckets": self.buckets}
        if found["buckets"] != self.buckets:
            raise ValueError(f"the state has {found['buckets']} buckets, not {self.buckets}")
        return found

    def _files(self, manifest: dict | None) -> set[str]:
        if manifest is None:
            return set()
        return ({f"open/batch={x['batch']}/bucket={k}" for k, x in manifest["open"].items()}
                | {f"waiting/batch={x['batch']}" for x in manifest["waiting"]})

    def _forget(self, old: set[str], kept: set[str]) -> None:
        """Deletes files that are needed no more, and folders of batches that have none left."""
        for name in old - kept:
            remove(self.spark, f"{self.state}/{name}")
        for folder in {n.rsplit("/", 1)[0] for n in old if n.startswith("open/")} - {n.rsplit("/", 1)[0] for n in kept}:
            remove(self.spark, f"{self.state}/{folder}")

    # ---- one batch

    def _narrow(self, batch: DataFrame) -> DataFrame:
        if "capture_no" not in batch.columns:
            batch = batch.withColumn("capture_no", F.lit(0).cast("bigint"))
        rows = as_pairs(batch) if self.two_way else batch.withColumn("is_fwd", F.lit(True))
        return rows.select(*self.key, *_BODY, *packet_values(self.features))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch: the function for ``foreachBatch``."""
        if self.closed_after() >= batch_id:
            return  # closed with all of this batch; nothing may come out again
        if self.last_batch() > batch_id:
            raise RuntimeError(f"{self.state} is ahead of batch {batch_id}: it belongs to another checkpoint")
        with scratch(self.spark):
            self._run(batch, batch_id)

    def _run(self, batch: DataFrame, batch_id: int) -> None:
        was = self._state_after(batch_id - 1)
        passed = was["passed_us"]
        fresh = durable(self._narrow(batch))
        newest, n_late = fresh.agg(F.max("ts_us"), F.count_if(F.col("ts_us") <= passed)).first()
        now = {**was, "batch": batch_id, "late": was["late"] + n_late, "newest_us": max(was["newest_us"], newest if newest is not None else -_FOREVER)}
        mark_us = now["passed_us"] = max(passed, (now["newest_us"] - self.delay_us) // 1000 * 1000)
        if n_late:
            late = fresh.filter(F.col("ts_us") <= passed).withColumns({"behind_us": F.lit(passed) - F.col("ts_us"), "reason": F.lit("behind_watermark")})
            late.write.mode("overwrite").parquet(f"{self.target}-late/batch={batch_id}")
        now["waiting"] = [x for x in was["waiting"] if x["hi"] > mark_us]
        if newest is not None and newest > mark_us:
            fresh.filter(F.col("ts_us") > mark_us).write.mode("overwrite").parquet(f"{self.state}/waiting/batch={batch_id}")
            now["waiting"] = [*now["waiting"], {"batch": batch_id, "hi": newest}]
        due = fresh.unionByName(self._waiting(was["waiting"])) if was["waiting"] else fresh
        due = due.filter((F.col("ts_us") > passed) & (F.col("ts_us") <= mark_us))
        idle = {k for k, x in was["open"].items() if mark_us - x["oldest_us"] >= self.idle_us}
        flows, touched = self._advance(due, was, idle, mark_us)
        now["open"] = {k: x for k, x in was["open"].items() if k not in touched}
        if flows is not None:
            self._hand_over(self._record(flows.filter("closed"), F.lit(_FOREVER)), str(batch_id))
            open_ = flows.filter("not closed").drop("closed")
            oldest = {str(r.bucket): r.oldest for r in open_.groupBy("bucket").agg(F.min("flow_end_us").alias("oldest")).collect()}  # a row a bucket
            if oldest:
                open_.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.state}/open/batch={batch_id}")
            now["open"] |= {k: {"batch": batch_id, "oldest_us": v} for k, v in oldest.items()}
        if self.closed_after() >= batch_id:
            raise RuntimeError("the stream was closed while this batch ran")
        write_text(self.spark, f"{self.state}/manifest/{batch_id}.json", json.dumps(now))
        gone = self._read_manifest(str(batch_id - 2))
        if gone is not None:
            self._forget(self._files(gone), self._files(was) | self._files(now))
            remove(self.spark, f"{self.state}/manifest/{batch_id - 2}.json")

    def _waiting(self, waiting: list[dict]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.state}/waiting/batch={x['batch']}" for x in waiting])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _advance(self, due: DataFrame, was: dict, also: set[str], mark_us: int) -> tuple[DataFrame | None, set[str]]:
        """Sums of all flows in the buckets that the packets or ``also`` touch, with ``closed`` and ``bucket``, and those buckets.

        None where no bucket is touched, but for a stream's first packets, so that its output has columns from then on.
        """
        key, part = self.key, self.key + ["chunk"]
        due = durable(due) if was["waiting"] else due
        stats = durable(key_stats(due, key).withColumn("bucket", self._bucket()))
        hit, most = stats.agg(F.collect_set("bucket"), F.max("n")).first()  # at most a number a bucket
        touched = {str(k) for k in hit} | also
        if not touched and was["newest_us"] > -_FOREVER:
            return None, touched
        paths = [f"{self.state}/open/batch={x['batch']}/bucket={k}" for k, x in was["open"].items() if k in touched]
        before = self.spark.read.parquet(*paths) if paths else None
        rows, hot = due.withColumn("chunk", F.lit(0).cast("bigint")), (most or 0) > (self.chunk_rows or CHUNK_ROWS)
        if hot:
            split = split_hot_keys(due, key, self.chunk_rows, stats)
            rows = split.cold.withColumn("chunk", F.lit(0).cast("bigint")).unionByName(split.hot)
        marked = durable(mark(with_cuts(rows, self._cuts(rows, stats, before, hot), part), part, self.two_way, True, self.idle_us))
        start = None if before is None else before.select(*key, "state")
        carry = durable(carry_ops.chunk_carry(carry_ops.summarise(marked, part, self.two_way), key, self.two_way, self.idle_us, start))
        now = aggregate_flows(resolve(marked, key, self.two_way, carry), key, self.two_way, self.two_way, self.features)
        if before is None:
            before = now.filter("false").withColumn("state", F.lit(None).cast("string"))
        # a flow that has grown goes on only if its key's walk ends in it; one that hasn't may only fall idle
        ends = carry.groupBy(*key).agg(F.max_by(F.struct("c_state", *carry_ops.LEFT_OPEN), "chunk").alias("e")).select(
            *key, *[F.col(f"e.{c}").alias(n) for c, n in zip(carry_ops.LEFT_OPEN, FLOW_LABEL, strict=True)], F.col("e.c_state").alias("new_state"))
        flows = _merged(before, now, key).join(ends, key + FLOW_LABEL, "left")
        idle = F.lit(mark_us) - F.col("flow_end_us") >= self.idle_us
        flows = flows.withColumns({"closed": F.col("was_cut") | idle | (F.col("grown") & F.col("new_state").isNull()),
                                   "state": F.coalesce("new_state", "old_state"), "bucket": self._bucket()})
        return durable(flows.drop("new_state", "old_state", "grown")), touched

    def _cuts(self, rows: DataFrame, stats: DataFrame, before: DataFrame | None, hot: bool) -> DataFrame | None:
        if self.two_way:
            return None
        key = self.key
        entry = None if before is None else before.select(
            *key, F.least(F.col("len_n"), F.lit(self.threshold)).alias("entry_count"), F.col("flow_end_us").alias("entry_last"))
        if hot:
            return syn_cuts_chunked(rows, key, self.threshold, self.idle_us, entry)
        known = stats.withColumn("entry", F.lit(0).cast("bigint"))
        if entry is not None:
            goes_on = F.col("lo") - F.col("entry_last") <= self.idle_us
            known = stats.join(entry, key, "left").withColumn("entry", F.when(goes_on, F.col("entry_count")).otherwise(0))
        may_cut = known.filter((F.col("n") + F.col("entry") >= self.threshold) & (F.col("n_syn") > 0)).select(*key, "entry")
        cuts = syn_cuts_after(rows.drop("chunk").join(may_cut, key), key, self.threshold, self.idle_us)
        return cuts.withColumn("chunk", F.lit(0).cast("bigint"))

    def _record(self, flows: DataFrame, as_of: Column) -> DataFrame:
        if self.two_way:
            flows = turn_flows(flows.drop("state", "bucket", "closed"))
        return flow_record(flows, self.two_way, as_of, self.idle_us, self.two_way, self.features)

    def _hand_over(self, flows: DataFrame, name: str) -> None:
        path = f"{self.target}/batch={name}"
        flows.write.mode("overwrite").parquet(path)
        if self.then is not None:
            self.then(self.spark.read.schema(flows.schema).parquet(path), name)

    # ---- the end, and what came out

    def close_out(self, as_of_us: int | None = None) -> DataFrame:
        """Closes the stream after its last finished batch and returns the flows that were open, finished from the kept state.

        The stream must be stopped (``stop_flow_stream``). Done once: a second call, also after a restart, returns the same flows. The
        stream may be started again on its checkpoint; packets that were not in a finished batch are then the first of new flows.
        """
        last = self.last_batch()
        if last < 0:
            raise RuntimeError("no batch has been finished")
        path = f"{self.target}/batch={last}-closed"
        if self.closed_after() < last:
            was = self._state_after(last)
            newest = max(was["newest_us"], as_of_us or -_FOREVER)
            with scratch(self.spark):
                due = self._waiting(was["waiting"]).filter(F.col("ts_us") > was["passed_us"]) if was["waiting"] else self._no_packets()
                flows, _ = self._advance(due, was, set(was["open"]), -_FOREVER)
                self._hand_over(self._record(flows, F.lit(newest)), f"{last}-closed")
            write_text(self.spark, f"{self.state}/manifest/{last}.closed.json", json.dumps(
                {**was, "passed_us": newest, "newest_us": newest, "open": {}, "waiting": [], "closed": True}))
            self._forget(self._files(was) | self._files(self._read_manifest(str(last - 1))), set())
        return self.spark.read.parquet(path)

    def _no_packets(self) -> DataFrame:
        types = {"is_fwd": "boolean", "ts_us": "bigint", "frame_no": "bigint", "capture_no": "bigint"}
        wide = [c for c in self.key if "ip" in c]
        return self.spark.createDataFrame([], ", ".join(f"{c} {types.get(c, 'bigint' if c in wide else 'int')}" for c in [*self.key, *_BODY])
                                          + "".join(f", {f.column} {f.value_type}" for f in self.features))

    def late_rows(self, batch_id: int | None = None) -> int:
        """Packets up to a batch, by default the last, that came behind the watermark and were not used."""
        return self._state_after(self.last_batch() if batch_id is None else batch_id)["late"]

    def late_packets(self) -> DataFrame | None:
        """Those packets (key, order and size columns), how far behind the watermark they came and why; None if there are none."""
        if not names_in(self.spark, f"{self.target}-late"):
            return None
        return self.spark.read.parquet(f"{self.target}-late").filter(F.col("batch") <= self.last_batch())

    def emitted(self, closed_out: bool = False) -> DataFrame:
        """Flows that finished batches have closed; with ``closed_out`` also those of ``close_out``."""
        rows = self.spark.read.option("basePath", self.target).parquet(f"{self.target}/batch=*")
        batch, at_end = F.col("batch").cast("string"), F.col("batch").cast("string").endswith("-closed")
        number = F.regexp_extract(batch, r"^(\d+)", 1).cast("bigint")
        # of a batch that is running now, or whose closing is, nothing counts yet
        counts = F.when(at_end, (number <= self.closed_after()) & F.lit(closed_out)).otherwise(number <= self.last_batch())
        return rows.filter(counts).drop("batch")


def run_flow_stream(packets: DataFrame, assembler: FlowAssembler, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts the stream, by default with a batch each 5 seconds."""
    return (packets.writeStream.foreachBatch(assembler).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "5 seconds"})).start())


def stop_flow_stream(query: StreamingQuery, assembler: FlowAssembler, as_of_us: int | None = None) -> DataFrame:
    """Stops the stream, waits for the batch in hand to end or to fail, and closes out what is open."""
    query.stop()
    query.awaitTermination()
    return assembler.close_out(as_of_us)
