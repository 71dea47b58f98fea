"""Null handling, coercions and small predicates. NaN and infinities are nulls here; two dialects of truth values are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """The number, or null for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def number(text: Column) -> Column:
    """A double from a text, null where it is none or not finite."""
    return finite(F.try_cast(F.trim(text), "double")) if hasattr(F, "try_cast") else finite(F.trim(text).try_cast("double"))


def integer(text: Column) -> Column:
    """A long from a text that holds a number, cut towards zero."""
    v = number(text)
    return F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("long")


def scalar(text: Column) -> Column:
    """A double from a number or an array of one number, as JSON text."""
    one = F.from_json(text, "array<double>")
    return F.coalesce(number(text), F.when(F.size(one) == 1, finite(F.get(one, F.lit(0)))))


# The spellings of both truth values, of texts alone and where numbers have become texts.
WORDS = {True: ("true", "1", "yes"), False: ("false", "0", "no")}
TRUE, FALSE = ("true", "1", "1.0", "yes"), ("false", "0", "0.0", "no")


def truth(text: Column, strict: bool = False) -> Column:
    """true, false or null; ``strict``: any other text counts as false, and only null and empty text as null."""
    t = F.lower(F.trim(text))
    known = F.when(t.isin(*TRUE), True).when(t.isin(*FALSE), False)
    return known.when(t != "", F.lit(False)) if strict else known


def truth_of(value: Column) -> Column:
    """true, false or null of a VARIANT, which tells numbers from texts: numbers are false at 0, texts by WORDS, others null."""
    kind = F.schema_of_variant(value)
    text = F.lower(F.trim(F.try_variant_get(value, "$", "string")))
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    word = F.when(text.isin(*WORDS[True]), True).when(text.isin(*WORDS[False]), False)
    return F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).when(number, F.try_variant_get(value, "$", "double") != 0).when(kind == "STRING", word)


def progress(x: Column, scale: float = 1.0) -> Column:
    """From 0 to 1: NaN and null count as 0, infinities as the ends."""
    return F.least(F.greatest(F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)) / scale, F.lit(0.0)), F.lit(1.0))


def singletons(text: Column, element: str = "double") -> Column:
    """The innermost list of numbers of a JSON text whose outer lists have one element each."""
    deep = [F.from_json(text, "array<" * k + element + ">" * k) for k in (1, 2, 3)]
    inner = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0)))
    good = lambda c: F.when(~F.exists(c, lambda x: x.isNull()), c)
    return F.coalesce(good(deep[0]), good(inner(deep[1])), good(inner(inner(deep[2]))))


def trace(text: Column, dialect: str = "extractor") -> Column:
    """A polyline of a JSON text nested one to three deep; null unless every point has two numbers.

    "extractor" and "depth" keep single points, "depth" leaves out lines with a number that isn't finite, "comparator"
    keeps only lines of two points at least.
    """
    flat = F.from_json(text, "array<double>")
    line = F.from_json(text, "array<array<double>>")
    nested = F.from_json(text, "array<array<array<double>>>")
    points = F.coalesce(F.when((F.size(nested) == 1) & ~F.exists(F.get(nested, F.lit(0)), lambda p: p.isNull()), F.get(nested, F.lit(0))), line, F.when(F.size(flat) == 2, F.array(flat)))
    odd = F.exists(points, lambda p: p.isNull() | (F.size(p) != 2) | F.exists(p, lambda x: x.isNull()))
    fit = (F.size(points) >= (2 if dialect == "comparator" else 1)) & ~odd
    if dialect == "depth":
        fit = fit & ~F.exists(points, lambda p: F.exists(p, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    return F.when(fit, F.transform(points, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))))


def require(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    """Raises if columns are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {', '.join(missing)}")
    return df


def existing(df: DataFrame, columns: list[str]) -> tuple[list[str], list[str]]:
    """Those of the columns that there are, and those left out."""
    return [c for c in columns if c in df.columns], [c for c in columns if c not in df.columns]


def with_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def add_new(df: DataFrame, columns: dict[str, Column], replace: bool = False) -> DataFrame:
    """Adds columns that must not exist yet, unless they may be replaced."""
    there = [c for c in columns if c in df.columns]
    if there and not replace:
        raise ValueError(f"columns exist already: {', '.join(there)}")
    return df.withColumns(columns)


#: Roles of columns by prefix; only features enter a model.
ROLES = ("feat_", "label_", "post_", "diag_", "gt_", "control_", "ep_")


def features_only(columns: list[str]) -> list[str]:
    bad = [c for c in columns if not c.startswith("feat_")]
    if bad:
        raise ValueError(f"not features: {', '.join(bad)}")
    return columns
