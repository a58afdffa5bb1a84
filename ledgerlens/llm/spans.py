"""Where a pattern matches, in DataFrame functions: all matches with their places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def spans(text: Column, pattern: Column | str, context: int = 0) -> Column:
    """array<struct<start,stop,match[,left]>> of the leftmost non-overlapping matches.

    Places are code points, the end exclusive. The pieces between matches and the matches give the
    places by their lengths. `left` is what stands before a match since the last one, its last
    `context` characters. Patterns must not match nothing.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    kind = "array<struct<start:bigint,stop:bigint,match:string" + (",left:string" if context else "") + ">>"

    def placed(found: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["piece"])
            stop = start + F.length(x["match"])
            facts = [start.cast("long").alias("start"), stop.cast("long").alias("stop"), x["match"].alias("match")]
            if context:
                facts.append(F.substring(x["piece"], F.greatest(F.length(x["piece"]) - context + 1, F.lit(1)), F.lit(context)).alias("left"))
            return F.struct(stop.cast("long").alias("at"), F.concat(acc["out"], F.array(F.struct(*facts))).alias("out"))

        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        zipped = F.zip_with(pieces, found, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out"))
        return F.when(F.size(found) > 0, F.aggregate(zipped, start, step)["out"]).otherwise(F.array().cast(kind))

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), pattern, F.lit(0)), placed)
