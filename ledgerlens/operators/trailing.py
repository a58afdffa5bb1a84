"""Trailing-window sums per key that stay linear and spread a hot key over many tasks.

A sliding range frame re-adds its whole content for every row and keeps a key in one
task. Here time is cut into slices. A row sees three parts of its frame: the rows of its own
slice before it (a prefix sum), the whole slices in between (pre-aggregated), and the rows of the
slice that its frame begins in, from there on (a suffix sum). The windows are grouped by (key,
slice), so a key with a third of all rows is spread over its slices. Nothing is ever taken back
from a sum, so a large value leaves no rounding error behind once it is out of the frame.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.times import micros

HOUR = timedelta(hours=1)
_AT, _SLICE, _KIND = "__at", "__slice", "__kind"
_ROW = 0


@dataclass(frozen=True)
class Frame:
    """Rows with `start >= age > end`; with the default `end`, all strictly earlier rows."""

    start: timedelta
    sums: dict[str, Column] = field(default_factory=dict)
    end: timedelta = timedelta(0)


def _us(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def with_trailing(
    df: DataFrame,
    keys: list[str],
    ts: str,
    frames: list[Frame],
    previous: str | None = None,
    slice_length: timedelta = HOUR,
) -> DataFrame:
    """Add each frame's sums (0 when empty) and, as `previous`, the key's latest earlier `ts`.

    `start` and `end` are multiples of `slice_length`. Rows with the same key and
    timestamp do not see each other.
    """
    width = _us(slice_length)
    if any(_us(f.start) % width or _us(f.end) % width for f in frames):
        raise ValueError("frame bounds must be multiples of the slice length")

    # Two contribution columns per sum: to those after a row enters, and to those before it leaves.
    names = [(i, out) for i, f in enumerate(frames) for out in f.sums]
    moments = [(_ROW, 0)]
    enters, leaves = {}, {}
    for i, frame in enumerate(frames):
        enters[i] = _ROW
        if frame.end:
            enters[i] = len(moments)
            moments.append((enters[i], _us(frame.end)))
        leaves[i] = len(moments)
        moments.append((leaves[i], _us(frame.start)))

    def measure(out: str) -> str:
        return f"__m_{out}"

    def leaving(out: str) -> str:
        return f"__l_{out}"

    at = micros(ts)
    measured = df.select(
        "*",
        at.alias(_AT),
        # A row without a time is in no window.
        *[F.when(at.isNotNull(), frames[i].sums[out]).alias(measure(out)) for i, out in names],
    )
    sliced = measured.withColumn(_SLICE, F.col(_AT) - F.pmod(F.col(_AT), F.lit(width)))

    copies = F.array(
        *[F.struct(F.lit(k).alias("kind"), (F.col(_AT) + shift).alias("at")) for k, shift in moments]
    )
    moved = measured.withColumn("__copy", F.explode(copies))
    kind, moved_at = F.col("__copy.kind"), F.col("__copy.at")
    events = moved.select(
        *keys,
        *[F.when(kind == _ROW, F.col(c)).alias(c) for c in df.columns if c not in keys],
        kind.alias(_KIND),
        moved_at.alias(_AT),
        (moved_at - F.pmod(moved_at, F.lit(width))).alias(_SLICE),
        *[F.when(kind == enters[i], F.col(measure(out))).alias(measure(out)) for i, out in names],
        *[F.when(kind == leaves[i], F.col(measure(out))).alias(leaving(out)) for i, out in names],
        *([F.when(kind == _ROW, moved_at).alias("__last")] if previous else []),
    )

    # What the slices wholly inside the frame add up to at the start of each slice.
    totals = sliced.groupBy(*keys, _SLICE).agg(
        *[F.sum(measure(out)).alias(measure(out)) for _, out in names],
        F.max(_AT).alias("__last"),
    )
    by_slice = Window.partitionBy(*keys).orderBy(_SLICE)

    def between(i: int, out: str) -> Column:
        first, last = width - _us(frames[i].start), -_us(frames[i].end) - width
        if first > last:  # a frame of one slice's length has none in between
            return F.lit(None)
        return F.sum(measure(out)).over(by_slice.rangeBetween(first, last))

    opening = totals.select(
        *keys,
        F.lit(None).cast("int").alias(_KIND),
        (F.col(_SLICE) - 1).alias(_AT),
        F.col(_SLICE),
        *[between(i, out).alias(measure(out)) for i, out in names],
        *(
            [F.max("__last").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)).alias("__last")]
            if previous
            else []
        ),
    )

    earlier = (
        Window.partitionBy(*keys, _SLICE)
        .orderBy(_AT)
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    not_yet_left = (
        Window.partitionBy(*keys, _SLICE)
        .orderBy(F.col(_AT).desc())
        .rangeBetween(Window.unboundedPreceding, 0)
    )
    outs = [
        (
            F.coalesce(F.sum(measure(out)).over(earlier), F.lit(0))
            + F.coalesce(F.sum(leaving(out)).over(not_yet_left), F.lit(0))
        ).alias(out)
        for _, out in names
    ]
    if previous:
        last = F.max("__last").over(earlier)
        dtype = df.schema[ts].dataType.simpleString()
        outs.append(F.timestamp_micros(last).cast(dtype).alias(previous))
    return (
        events.unionByName(opening, allowMissingColumns=True)
        .select(*df.columns, _KIND, *outs)
        .filter(F.col(_KIND) == _ROW)
        .drop(_KIND)
    )
