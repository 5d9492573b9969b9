"""Column naming, selection and comparison against a model's feature list. All plan-time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.schemas import CIC2017_HEADERS, FLOW_NAMES, FLOW_TYPES, HEADER_STYLES, SHORT_HEADERS, SHORT_TO_CIC2017


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def assert_unique_header(names: Iterable[str], expected_len: int | None = None) -> list[str]:
    names = list(names)
    doubled = sorted({n for n in names if names.count(n) > 1})
    if doubled:
        raise ValueError(f"duplicate column names: {doubled}")
    if expected_len is not None and len(names) != expected_len:
        raise ValueError(f"expected {expected_len} columns, got {len(names)}")
    return names


def header_names(style: str) -> list[str]:
    if style not in HEADER_STYLES:
        raise ValueError(f"unknown header style {style!r}; use one of {sorted(HEADER_STYLES)}")
    return assert_unique_header(HEADER_STYLES[style], len(SHORT_HEADERS))


def select_features(df: DataFrame, style: str = "short") -> DataFrame:
    """The 88 columns in export order under public names; an absent column becomes 0 of its type.

    A column is found under its internal, short or cic2017 name, in this order.
    """
    headers, have = header_names(style), set(df.columns)
    cols = []
    for names, header in zip(zip(FLOW_NAMES, SHORT_HEADERS, CIC2017_HEADERS), headers):
        source = next((n for n in names if n in have), None)
        cols.append((quoted(source) if source else F.lit(0).cast(FLOW_TYPES[names[0]])).alias(header))
    return df.select(*cols)


def rename_header(names: Iterable[str], style: str = "cic2017") -> list[str]:
    """Short names to the given style; names without a mapping pass through."""
    header_names(style)
    mapping = SHORT_TO_CIC2017 if style == "cic2017" else {}
    return assert_unique_header(mapping.get(n, n) for n in names)


def rename_features(df: DataFrame, style: str = "cic2017") -> DataFrame:
    return df.toDF(*rename_header(df.columns, style))


def alias_source(name: str, names: set[str], aliases: dict[str, str]) -> str | None:
    """The existing column that ``name`` leads to along its chain of aliases, if any."""
    walked: list[str] = []
    while name not in names and name in aliases and name not in walked:
        walked.append(name)
        name = aliases[name]
    return name if name in names else None


def resolve_alias_names(names: Iterable[str], aliases: dict[str, str]) -> list[tuple[str, str]]:
    """``(new column, existing source column)`` for every alias whose chain ends at one of ``names``."""
    have = set(names)
    sources = {new: alias_source(new, have, aliases) for new in aliases if new not in have}
    return [(new, source) for new, source in sources.items() if source is not None]


def resolve_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Add every aliased column whose source exists, following chains of aliases."""
    added = resolve_alias_names(df.columns, aliases)
    return df.select(*[quoted(c) for c in df.columns], *[quoted(source).alias(name) for name, source in added])


def with_features(df: DataFrame, feature_names: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """``df`` plus every model column that an alias can supply; by default the two header styles."""
    if aliases is None:
        aliases = {**SHORT_TO_CIC2017, **{cic: short for short, cic in SHORT_TO_CIC2017.items()}}
    full = resolve_aliases(df, {k: v for k, v in aliases.items() if k not in df.columns})
    missing = [n for n in feature_names if n not in full.columns]
    if missing:
        raise ValueError(f"columns missing for the model: {missing}")
    return full


def prepare_features(df: DataFrame, feature_names: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """The model's columns in model order, whichever header style the input has."""
    return with_features(df, feature_names, aliases).select(*[quoted(n) for n in feature_names])


def schema_diff(names: Iterable[str], expected: Iterable[str]) -> dict[str, object]:
    """Column names a table lacks or has in excess, in list order, with the usual short listings."""
    names, expected = list(names), list(expected)
    have, wanted = set(names), set(expected)
    missing = [n for n in expected if n not in have]
    extra = [n for n in names if n not in wanted]
    return {"missing": missing, "extra": extra, "missing_count": len(missing), "extra_count": len(extra),
            "first10": expected[:10], "last10": expected[-10:],
            "missing_first30": missing[:30], "extra_first30": extra[:30]}


def schema_diff_table(names: DataFrame, expected: DataFrame) -> DataFrame:
    """The same over two tables ``(pos, name)``: rows ``(side, pos, name)``."""
    missing = expected.join(names.select("name"), "name", "left_anti").select(F.lit("missing").alias("side"), "pos", "name")
    extra = names.join(expected.select("name"), "name", "left_anti").select(F.lit("extra").alias("side"), "pos", "name")
    return missing.unionByName(extra)
