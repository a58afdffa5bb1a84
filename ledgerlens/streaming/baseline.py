"""The trailing baseline as keyed streaming state.

State of a user is kept in time slices: one small table of sums per slice, and the rows
of each slice for the two slices a window cuts through. A batch reads the sums and only
the rows at the edges of its windows; slices that have left every window are removed.
Users with very many rows a day want shorter slices (`slice_length`).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlens.functions.times import micros
from ledgerlens.operators.baseline import finish_baseline


def _processor(columns: list[str], outputs: list[str], span: int, width: int) -> StatefulProcessor:
    """Built in a function so that it is shipped to the workers by value.

    `outputs` are the six totals and the centre.
    """
    import numpy as np

    Out = Row(*columns, *outputs)

    class Baseline(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            # Six totals per slice, flat, in the order of `slices`, of amounts less `centre`.
            self.sums = handle.getValueState(
                "sums", "slices array<bigint>, totals array<double>, centre double"
            )
            self.rows = handle.getMapState(
                "rows", "slice long", "at array<bigint>, amount array<double>, hour array<double>"
            )

        def _parts(self, amount, hour):
            """The six summands of each row."""
            has_x, has_h = ~np.isnan(amount), ~np.isnan(hour)
            x, h = np.where(has_x, amount - self.centre, 0.0), np.where(has_h, hour, 0.0)
            return np.stack([has_x.astype(float), x, x * x, has_h.astype(float), h, h * h], axis=1)

        def _load(self, s):
            at, amount, hour = self.rows.getValue((s,))
            return (
                np.array(list(at), dtype="int64"),
                np.array([np.nan if a is None else a for a in amount], dtype=float),
                np.array([np.nan if a is None else a for a in hour], dtype=float),
            )

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            # One user's share of one trigger; the trigger's size bounds it. Rows, not frames: most
            # users send few rows a trigger, and a frame costs far more than what is done with them.
            rows = list(rows)
            place = {c: i for i, c in enumerate(rows[0].__fields__)}
            passed = [place[c] for c in columns]
            at_place, amount_place, hour_place = place["row_at"], place["row_amount"], place["row_hour"]
            unseen = (0.0,) * len(outputs)
            for row in rows:
                if row[at_place] is None:  # in no window, and sees none
                    yield Out(*[row[i] for i in passed], *unseen)
            rows = sorted((r for r in rows if r[at_place] is not None), key=lambda r: r[at_place])
            if not rows:
                return
            at = np.array([r[at_place] for r in rows], dtype="int64")
            amount = np.array([r[amount_place] for r in rows], dtype=float)  # null becomes NaN
            hour = np.array([r[hour_place] for r in rows], dtype=float)
            slices = at - at % width

            known, centre = {}, None
            if self.sums.exists():
                starts, flat, centre = self.sums.get()
                known = dict(zip(list(starts), np.array(list(flat), dtype=float).reshape(-1, 6)))

            # The first trigger with an amount settles the centre; until then no amount is summed.
            if centre is None and not np.isnan(amount).all():
                centre = float(np.nanmedian(amount))
            self.centre = 0.0 if centre is None else centre
            loaded = {}

            def slice_rows(s):
                if s not in loaded:
                    if s in known:
                        moments, a, h = self._load(s)
                        loaded[s] = (moments, self._parts(a, h))
                    else:
                        loaded[s] = (np.empty(0, "int64"), np.empty((0, 6)))
                return loaded[s]

            optional = lambda values: [None if a != a else a for a in values.tolist()]
            cuts = (np.flatnonzero(np.diff(slices)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(at)]):
                s = int(slices[a])
                merged = [at[a:b], amount[a:b], hour[a:b]]
                if s in known:
                    merged = [np.concatenate(pair) for pair in zip(self._load(s), merged)]
                    order = np.argsort(merged[0], kind="stable")
                    merged = [m[order] for m in merged]
                parts = self._parts(merged[1], merged[2])
                loaded[s], known[s] = (merged[0], parts), parts.sum(axis=0)
                self.rows.updateValue(
                    (s,), (merged[0].tolist(), optional(merged[1]), optional(merged[2]))
                )

            starts = np.array(sorted(known), dtype="int64")
            sums = np.array([known[s] for s in starts.tolist()])
            found, none = np.zeros((len(at), 6)), np.zeros((1, 6))
            first = at - span
            tails = first - first % width
            # Rows with the same first and last slice: the sums before them in the last, of the
            # slices in between, and from the window's start on in the first. Only additions.
            edges = np.flatnonzero((np.diff(slices) != 0) | (np.diff(tails) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(at)]):
                s, tail = int(slices[a]), int(tails[a])
                low, high = np.searchsorted(starts, [tail + 1, s])
                found[a:b] = sums[low:high].sum(axis=0)
                moments, parts = slice_rows(s)
                upto = np.concatenate([none, np.cumsum(parts, axis=0)])
                found[a:b] += upto[np.searchsorted(moments, at[a:b])]
                moments, parts = slice_rows(tail)
                if len(moments):
                    onward = np.concatenate([np.cumsum(parts[::-1], axis=0)[::-1], none])
                    found[a:b] += onward[np.searchsorted(moments, first[a:b])]

            kept = starts >= starts[-1] - span - width
            for s in starts[~kept].tolist():
                self.rows.removeKey((s,))
            self.sums.update((starts[kept].tolist(), sums[kept].ravel().tolist(), centre))

            for row, six in zip(rows, found.tolist()):
                yield Out(*[row[i] for i in passed], *six, self.centre)

        def close(self) -> None:
            pass

    return Baseline()


def baseline_stream(
    txn: DataFrame,
    user: str = "user_id",
    ts: str = "ts",
    amount: str = "amount",
    hour: str = "hour_of_day",
    days: int = 90,
    min_rows: int = 5,
    slice_length: timedelta = timedelta(days=1),
    clock: Column | None = None,
    ahead: timedelta = timedelta(days=1),
) -> DataFrame:
    """The columns of `with_baseline` on a stream.

    State is read before a row is added to it. Rows that arrive late enter the state but
    do not change what was already sent on. Rows dated more than `ahead` after the clock, by
    default the time of the trigger, are treated like rows without a time: they see no history and
    leave none, so that a wrong date cannot push a user's state out of the window.
    """
    now = F.current_timestamp() if clock is None else clock
    dated = F.col(ts).cast("timestamp") <= now.cast("timestamp") + F.expr(f"INTERVAL {int(ahead.total_seconds())} SECONDS")
    us = timedelta(microseconds=1)
    outputs = ["__n", "__x", "__xx", "__hn", "__h", "__hh", "__centre"]
    prepared = txn.withColumns(
        {
            "row_at": F.when(dated, micros(ts)),
            "row_amount": F.col(amount).cast("double"),
            "row_hour": F.col(hour).cast("double"),
        }
    )
    # A NaN is handed on as null.
    reals = [f.name for f in txn.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    prepared = prepared.withColumns({c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) for c in reals})
    schema = T.StructType(list(txn.schema.fields))
    for name in outputs:
        schema = schema.add(name, "double")
    summed = prepared.groupBy(user).transformWithState(
        statefulProcessor=_processor(txn.columns, outputs, timedelta(days=days) // us, slice_length // us),
        outputStructType=schema,
        outputMode="Append",
        timeMode="None",
    )
    return finish_baseline(summed, amount, hour, min_rows)
