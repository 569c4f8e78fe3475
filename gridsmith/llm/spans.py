"""Regular-expression spans as pure Column expressions.

Spark's regexp_extract_all gives the matches and split, on the same pattern,
the gaps between them. Added up in turn they give every match's place in code
points, so no Python code sees the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,kind:int,stop:bigint,hit:string>>"


def find_spans(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column], when: Column) -> Column:
    """Leftmost non-overlapping matches of pattern that keep() accepts, as structs (start, kind, stop, hit), where `when` holds; else none.

    The pattern must not match the empty string. Matches that keep() rejects
    still use up their characters.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        begin = acc["at"] + F.length(part["gap"])
        end = begin + F.coalesce(F.length(part["hit"]), F.lit(0))
        one = F.struct(begin.cast("bigint").alias("start"), F.lit(kind).alias("kind"), end.cast("bigint").alias("stop"), part["hit"].alias("hit"))
        good = part["hit"].isNotNull() & keep(part["hit"])
        return F.struct(end.cast("bigint").alias("at"), F.when(good, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).cast(SPAN).alias("out"))

    found = F.aggregate(parts, start, step, lambda acc: acc["out"])
    return F.when(when, found).otherwise(F.array().cast(SPAN))


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined. Kinds are numbered from 1 in the listed order."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
