"""Benchmark passages in documents by Wu-Manber search over words.

The patterns are the windows of every benchmark item. A table of shifts, kept by pairs of words,
tells how far a scan may jump before any pattern can end; where the shift is nought, the patterns
that end in this pair of words are compared word by word. Patterns shorter than a window have a
matcher of their own length, so that they do not shorten the jumps of the others.

Patterns reach the tasks in parts of at most `PART_BYTES`; a larger benchmark is searched part by
part in one pass over the documents, which are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.llm.common import saved

#: Text of the benchmark that one part may hold; the tables built from it are about 20 times larger.
PART_BYTES = 8 << 20
NEW = "n_words bigint, spans array<struct<start:bigint,stop:bigint>>, items array<bigint>"

# Characters that end a word; A-Z become a-z.
CUT = bytes(
    32 if (c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F) else c + 32 if 0x41 <= c <= 0x5A else c
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(CUT).split() if text else []


class WuManber:
    """Finds patterns of one length, in words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set], length: int):
        self.length = length
        self.block = min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], set]]] = {}
        for p, items in patterns.items():
            for end in range(self.block, length + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.jump), length - end)
            self.bucket.setdefault(p[-self.block :], []).append((p, items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """(end, items) of every occurrence; `end` is exclusive."""
        n, length, block, jump = len(words), self.length, self.block, self.jump
        shift, bucket = self.shift.get, self.bucket
        end = length
        while end <= n:
            key = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
            step = shift(key, jump)
            if step:
                end += step
                continue
            for p, items in bucket[key]:
                if words[end - length] == p[0] and tuple(words[end - length : end]) == p:
                    yield end, items
            end += 1


def matchers(items: list[tuple[int | None, str | None]], window: int) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], set]] = {}
    for item_id, text in items:
        w = words_of(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            by_length.setdefault(size, {}).setdefault(tuple(w[i : i + size]), set()).add(item_id)
    return [WuManber(p, n) for n, p in sorted(by_length.items(), reverse=True)]


def parts(benchmark: DataFrame, item_id: str, text: str) -> list[DataFrame]:
    """The benchmark in parts of bounded size, each of whole items, dealt by a hash."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = 1 + total // PART_BYTES
    part = F.pmod(F.xxhash64(F.col(text)), F.lit(n))
    return [benchmark.filter(part == k) for k in range(n)]


def find_passages(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """`docs` with (n_words, spans, items).

    spans: word ranges covered by occurrences of a benchmark window, merged, end exclusive. items:
    sorted ids of the items with an occurring window. An item with fewer words than a window is
    one window; items without words are not searched. Null and empty texts have no words. An item
    without an id counts as found in `spans` but cannot be named in `items`; repeated items are one.
    An empty benchmark finds nothing. Columns of `docs` named like the new ones are replaced.
    """
    new = StructType.fromDDL(NEW)
    kept = [f for f in docs.schema.fields if f.name not in new.fieldNames()]
    names = [f.name for f in kept]
    out = docs.select(*names)
    bench = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter("text IS NOT NULL").distinct()
    bench = saved(bench, "benchmark")
    for k, part in enumerate(parts(bench, "item_id", "text")):
        table = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])
        first = k == 0

        def run(batches: Iterator[pd.DataFrame], table=table, first=first) -> Iterator[pd.DataFrame]:
            found = matchers(table.value, window)
            for pdf in batches:
                rows = [search(found, t) for t in pdf[text]]
                new_cols = pd.DataFrame(rows, columns=new.fieldNames(), index=pdf.index)
                if not first:
                    new_cols["spans"] = [merged([*map(pair, a), *map(pair, b)]) for a, b in zip(pdf["spans"], new_cols["spans"])]
                    new_cols["items"] = [sorted({*a, *b}) for a, b in zip(pdf["items"], new_cols["items"])]
                yield pd.concat([pdf[names], new_cols], axis=1)

        out = out.mapInPandas(run, StructType([*kept, *new.fields]))
    return out


def pair(span) -> tuple[int, int]:
    return (span["start"], span["stop"]) if isinstance(span, dict) else tuple(span)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search(found: list[WuManber], text: str | None) -> tuple[int, list[tuple[int, int]], list[int]]:
    w = words_of(text)
    spans, items = [], set()
    for m in found:
        last: set | None = None
        for end, ids in m.find(w):
            if spans and spans[-1][0] <= end - m.length <= spans[-1][1]:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((end - m.length, end))
            if ids is not last:
                items |= ids
                last = ids
    return len(w), merged(spans), sorted(x for x in items if x is not None)


def named(items) -> str:
    """The digest of item ids, sorted as strings."""
    return sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of `docs` without any benchmark passage, as they are."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    marked = find_passages(plain, benchmark, window, f"c{docs.columns.index('text')}")
    return marked.filter(F.size("spans") == 0).drop("n_words", "spans", "items").toDF(*docs.columns)
