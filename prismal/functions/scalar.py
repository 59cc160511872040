"""Scalar expressions used across the score tables. All are built-in column expressions."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, functions as F


def positive_ratio(value: Column, ceiling: Column, root: bool = True) -> Column:
    """value / sqrt(ceiling) (or / ceiling) where the ceiling is positive, else null."""
    return F.when(ceiling > 0, value / (F.sqrt(ceiling) if root else ceiling))


def finite_or_null(x: Column) -> Column:
    """NaN and infinities become null, so that averages skip them."""
    return F.when(~F.isnan(x) & ~x.isin(float("inf"), float("-inf")), x)


def to_number(x: Column) -> Column:
    """The number in a string; null where there is none."""
    return x.try_cast("double")


def to_flag(x: Column) -> Column:
    """1.0 and 0.0 for spellings of true and false, else null."""
    low = F.lower(F.trim(x.cast("string")))
    return F.when(low.isin("true", "1", "yes", "1.0"), 1.0).when(low.isin("false", "0", "no", "0.0"), 0.0)


def category(x: Column, missing: str = "missing") -> Column:
    return F.lower(F.trim(F.coalesce(x, F.lit(missing))))


def safe_name(x: Column) -> Column:
    """Characters that are not ASCII letters, digits or underscores become underscores."""
    return F.regexp_replace(x, "[^A-Za-z0-9_]", "_")


def pair_part(x: Column, k: int, separator: str = "||") -> Column:
    """The k-th name (from 0) of a composite key."""
    return F.split(x, re.escape(separator))[k]


def first_match(x: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The value of the first rule whose substring occurs; order matters."""
    out = None
    for part, value in rules:
        out = F.when(F.contains(x, F.lit(part)), value) if out is None else out.when(F.contains(x, F.lit(part)), value)
    return F.lit(default) if out is None else out.otherwise(default)


def natural_key(x: Column, width: int = 12) -> Column:
    """A string that sorts runs of digits by their value (up to `width` digits)."""
    padded = F.regexp_replace(x, r"(\d+)", "0" * width + "$1")
    return F.regexp_replace(padded, rf"0*(\d{{{width}}})(?!\d)", "$1")


def tokens(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Distinct lower-case words of three letters or more, without edge punctuation and stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9_'-]{2,}"), F.lit(0))
    words = F.transform(words, lambda w: F.btrim(w, F.lit("_'-")))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(*stopwords) if stopwords else F.lit(True))))


def index_list(x: Column, size: Column | int | None = None) -> Column:
    """'1,3-5' as [1, 3, 4, 5]; ranges include their ends, and one that descends is empty. An index not below size is an error."""
    def span(part):
        ends = F.split(F.trim(part), "-")
        lo, hi = ends[0].cast("int"), F.element_at(ends, -1).cast("int")
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    out = F.flatten(F.transform(F.split(x, ","), span))
    if size is None:
        return out
    bound = F.lit(size) if isinstance(size, int) else size
    return F.when(F.exists(out, lambda i: i >= bound), F.raise_error(F.concat(F.lit("index out of bounds in "), x)).cast("array<int>")).otherwise(out)


def stable_seed(*parts: object, separator: str = "::", bytes_: int = 4, base: int | None = None) -> int:
    """A driver-side seed that depends on the parts only: little-endian BLAKE2b of the joined text.

    With a base the seed is moved by it and taken modulo 2^31 - 1, as generators with short seeds need.
    """
    seed = int.from_bytes(hashlib.blake2b(separator.join(map(str, parts)).encode(), digest_size=bytes_).digest(), "little")
    return seed if base is None else (seed + base) % (2**31 - 1)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def one_hot(x: Column, levels: list[str], drop_first: bool = True) -> list[Column]:
    """0/1 columns for sorted levels; the first is the reference."""
    return [F.when(x == level, 1).otherwise(0).alias(f"is_{level.lower()}") for level in sorted(levels)[drop_first:]]
