"""URL rules by hashed host-suffix and path-prefix expressions.

A url is expanded into expressions: each suffix of its host at a label boundary, with each prefix of
its path that has the length of some rule's path. Expressions, as the lengths of the two beside the url, and rules are
joined on the first 32 bits of their SHA-256 alone; of the pairs that meet, full digests and texts then confirm
a match, and the longest rule wins. Distinct (host, path) pairs are judged once, whatever number of pages shares them.

Null urls, and urls without ``://``, have empty host and path and fit no rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str | Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``host``, ``path``, ``rule``, ``verdict`` for each distinct (host, path) of ``pages``.

    ``rules`` has ``host``, ``path`` (a prefix with its leading ``/``; may be empty) and ``verdict``. Among fitting
    rules the longest (host and path) wins, then the longest host, then ``block`` before ``allow``. Urls that
    fit no rule have a null ``rule`` and the ``default`` verdict. Rules with a null part are ignored.
    """
    rules = rules.select(F.lower("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).dropna()
    rules = rules.distinct().withColumn("digest", F.sha2(F.concat("r_host", F.lit("\n"), "r_path"), 256))
    rules = rules.withColumn("short", _short(F.col("digest")))
    lengths = rules.agg(F.array_sort(F.collect_set(F.length("r_path"))).alias("lengths"))  # at most the longest path
    pairs = pages.select(host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path")).distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = (pairs.filter("host <> ''").join(F.broadcast(lengths))  # one row
                   .withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(fits))
                   .select("host", "path", F.length("suffix").alias("s"), F.length("prefix").alias("p"),
                           _short(F.sha2(F.concat("suffix", F.lit("\n"), "prefix"), 256)).alias("short")))
    met = expressions.join(rules, "short")
    suffix, prefix = F.right("host", F.col("s")), F.left("path", F.col("p"))
    same = (F.sha2(F.concat(suffix, F.lit("\n"), prefix), 256) == F.col("digest")) & (suffix == F.col("r_host")) & (prefix == F.col("r_path"))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"),
                    (F.col("r_verdict") == "block").alias("b"), "r_host", "r_path", "r_verdict")
    # confirmed here, not in a filter, which the optimiser would turn into further join keys
    best = met.groupBy("host", "path").agg(F.max(F.when(same, rank)).alias("best"))
    return pairs.join(best, ["host", "path"], "left").select(
        "host", "path", F.concat("best.r_host", "best.r_path").alias("rule"),
        F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All rows and columns of ``pages`` as ``row`` with ``host``, ``path``, ``rule`` and ``verdict`` beside it."""
    judged = judge_urls(pages, rules, url, default)
    rows = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("row"),
                        host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    return rows.join(judged, ["host", "path"])
