"""Token totals for every context limit from an exact length histogram.

Documents are first aggregated by encoded length, so all later work is on at most one row a length.
Suffix sums over that histogram answer, for each length ``n`` taken as a context limit: how many
documents and tokens fit, how many documents are longer, and the total if each text were cut to ``n``.

Suffix sums run in two levels, inside pages of ``PAGE`` lengths and over page totals, so that no task
holds more than a page or one row a page.

An empty table gives no rows. Null and empty texts have length 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.session import durable

PAGE = 128


def length_histogram(df: DataFrame, length: str = "n_tokens") -> DataFrame:
    """``n_tokens``, ``n_docs``: number of rows of each length; a null length counts as 0."""
    n = F.coalesce(F.col(f"`{length}`").cast("long"), F.lit(0).cast("long"))
    return df.select(n.alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_totals(histogram: DataFrame) -> DataFrame:
    """For each length ``n_tokens`` as a context limit, one row:

    ``n_docs``, ``docs_upto``, ``docs_over`` (of this length, at most, more), ``tokens_upto``,
    ``tokens_over`` (whole tokens of those documents), ``truncated_total`` (tokens left if every
    text is cut to ``n_tokens``) and ``cum_share`` (share of documents of at most this length).
    """
    histogram = durable(histogram)  # read twice below; the texts behind it only once
    h = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"),
                         F.floor(F.col("n_tokens") / PAGE).alias("page"))
    pages = h.groupBy("page").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.col("page").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("page").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pages = pages.select("page", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"],
                         *[F.sum(c).over(every).alias(f"{c}_all") for c in "dt"])
    inside = Window.partitionBy("page").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    over = h.join(pages, "page").select(
        "n_tokens", "n_docs", "d_all", "t_all",
        (F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("d_later")).alias("docs_over"),
        (F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("t_later")).alias("tokens_over"))
    upto = (F.col("d_all") - F.col("docs_over"))
    return over.select(
        "n_tokens", "n_docs", upto.alias("docs_upto"), "docs_over",
        (F.col("t_all") - F.col("tokens_over")).alias("tokens_upto"), "tokens_over",
        (F.col("t_all") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("truncated_total"),
        (upto / F.col("d_all")).alias("cum_share"))


def totals_at(totals: DataFrame, limits: DataFrame) -> DataFrame:
    """Truncated total at each ``context_limit`` of ``limits`` (one column), also between lengths.

    The histogram row of the greatest length not above the limit tells all: the documents over it are
    cut to the limit itself. Limits below every length cut every document. Nulls give null.
    """
    asked = limits.select("context_limit").distinct()
    longest = totals.select("n_tokens", "docs_over", "tokens_upto")
    at = (asked.join(longest, longest.n_tokens <= asked.context_limit, "left")
          .groupBy("context_limit").agg(F.max_by(F.struct("docs_over", "tokens_upto"), "n_tokens").alias("r")))
    every = totals.agg(F.sum("n_docs").alias("n"))
    got = at.join(every).select(
        "context_limit", (F.coalesce(F.col("r.tokens_upto"), F.lit(0))
                          + F.coalesce(F.col("r.docs_over"), F.col("n"), F.lit(0)) * F.col("context_limit")).alias("truncated_total"))
    return got


def length_quantiles(totals: DataFrame, shares: list[float]) -> DataFrame:
    """Smallest length whose ``cum_share`` reaches each share: ``share``, ``n_tokens``."""
    picks = [F.min(F.when(F.col("cum_share") >= s, F.col("n_tokens"))) for s in shares]
    row = totals.agg(F.array(*picks).alias("n"))
    return row.select(F.explode(F.arrays_zip(F.array(*[F.lit(float(s)) for s in shares]).alias("share"),
                                             F.col("n").alias("n_tokens"))).alias("x")).select("x.*")
