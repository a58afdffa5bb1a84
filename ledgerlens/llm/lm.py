"""Stupid-backoff scores of documents, computed by joins.

Documents are gathered in blocks of some hundred thousand words; a block names its distinct words
once and holds its pairs of neighbouring words as rows of arrays. Every block sends its distinct
grams with their counts to hash partitions, the n-gram count tables, and is joined with the totals
that come back, so a gram travels once a block and not once a document. A pair that another document
has too scores log(pairs / histories); other words score log(backoff * words / all words), with the
document's own occurrences left out of every count. Scores are summed per document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import saved
from ledgerlens.llm.neardup import mixed

START = np.uint64(0x5354415254)
WORD, HISTORY = np.uint64(0x574F5244), np.uint64(0x48495354)
#: Words of a block, a longer text aside; rows of a block; grams of a partition of the count tables.
BLOCK_WORDS, BLOCK_ROWS, PARTITION_GRAMS = 1_500_000, 20_000, 200_000
BLOCK = ("block bigint, ids array<string>, lengths binary, vocabulary binary, pairs binary, cells binary, times binary, "
         "n_words bigint, n_grams bigint")


@dataclass(frozen=True)
class Settings:
    """`backoff`: what a step to the shorter history costs. `smoothing`: the count of an unseen word."""

    backoff: float = 0.4
    smoothing: float = 0.5


def packed(numbers: np.ndarray) -> bytes:
    """Longs as compressed bytes, those of equal rank together, as most of the numbers are small."""
    return zlib.compress(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


class Places(dict):
    """Numbers words from 1 as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self) + 1
        return place


def block_of(number: int, ids: list, texts: list[np.ndarray], words: Places) -> dict:
    """The row of a block. Ascending numbers are kept as steps, which compress well.

    A pair is history * width + word, both places in the vocabulary, whose place 0 is the start of
    a text. A cell is a pair of a document: document * pairs + pair, without documents of no words.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    at = np.concatenate(texts)
    vocabulary = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    vocabulary = np.concatenate([[START], vocabulary]).view(np.int64)
    full = lengths[lengths > 0]
    before = np.concatenate([[0], at[:-1]])[: len(at)]
    before[np.cumsum(full) - full] = 0
    pairs, pair = np.unique(before * len(vocabulary) + at, return_inverse=True)
    cells, times = np.unique(np.repeat(np.arange(len(full)), full) * len(pairs) + pair, return_counts=True)
    return {"block": number, "ids": ids, "lengths": packed(lengths), "vocabulary": vocabulary.tobytes(),
            "pairs": packed(np.diff(pairs, prepend=0)), "cells": packed(np.diff(cells, prepend=0)), "times": packed(times),
            "n_words": len(at), "n_grams": len(pairs) + len(vocabulary)}


def blocks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """`docs` in blocks of whole documents; see `block_of`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, places, n = [], [], Places(), 0
        for pdf in batches:
            for name, value in zip(pdf["_id"], pdf["_text"]):
                words = value.encode("utf-8", "surrogatepass").lower().split() if value else []
                ids.append(name)
                texts.append(np.fromiter(map(places.__getitem__, words), np.int64, len(words)))
                n += len(words)
                if n >= BLOCK_WORDS or len(ids) >= BLOCK_ROWS:
                    yield pd.DataFrame([block_of(number, ids, texts, places)])
                    number, ids, texts, places, n = number + 1, [], [], Places(), 0
        if ids:
            yield pd.DataFrame([block_of(number, ids, texts, places)])

    return docs.select(F.col(doc_id).cast("string").alias("_id"), F.col(text).alias("_text")).mapInPandas(run, BLOCK)


class Block:
    """The columns of a block's row as numbers.

    Its grams are its pairs and then its words. A gram's hash gives, by division, its `partition` and
    its key there; `order` sorts the grams by both. `counts` has their counts, and in a second row
    the words' counts as histories.
    """

    def __init__(self, row, partitions: int) -> None:
        v = np.frombuffer(row.vocabulary, np.uint64)
        self.width = len(v)
        self.history, self.word = np.divmod(np.cumsum(unpacked(row.pairs)), self.width)
        self.document, self.pair = np.divmod(np.cumsum(unpacked(row.cells)), max(len(self.word), 1))
        self.times, self.lengths = unpacked(row.times), unpacked(row.lengths)
        keys = mixed(np.concatenate([mixed(v[self.history] * np.uint64(31) + v[self.word]), v]))
        keys, partition = np.divmod(keys, np.uint64(partitions))
        self.order = np.lexsort((keys, partition))
        self.keys, self.partition = keys[self.order], partition[self.order].astype(np.int64)

    def counts(self) -> np.ndarray:
        each = self.sums(self.pair, self.times, len(self.word))
        words, histories = (self.sums(x, each, self.width) for x in (self.word, self.history))
        return np.stack([np.concatenate([each, words]), np.concatenate([np.zeros_like(each), histories])])

    @staticmethod
    def sums(place: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(place, values, size).astype(np.int64)

    def own(self, of_pair: np.ndarray) -> np.ndarray:
        """For every cell, how often its document has the word, or history, that `of_pair` gives for its pair."""
        _, place = np.unique(self.document * self.width + of_pair[self.pair], return_inverse=True)
        return self.sums(place, self.times, 0)[place]


def sent(held: DataFrame, partitions: int) -> DataFrame:
    """(partition, block, keys, counts): the grams of every block by hash partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                b = Block(row, partitions)
                names, first = np.unique(b.partition, return_index=True)
                keys = [packed(np.diff(k, prepend=k[:1] * 0)) for k in np.split(b.keys, first[1:])]
                counts = np.split(b.counts()[:, b.order], first[1:], axis=1)
                yield pd.DataFrame({"partition": names, "block": row.block, "keys": keys, "counts": [packed(c.ravel()) for c in counts]})

    return held.mapInPandas(run, "partition bigint, block bigint, keys binary, counts binary")


def totals(grams: DataFrame) -> DataFrame:
    """(block, partition, totals): the corpus's counts of every gram that a block has sent, in its order."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(unpacked(k).view(np.uint64)) for k in pdf["keys"]]
        counts = np.concatenate([unpacked(c).reshape(2, -1) for c in pdf["counts"]], axis=1)
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.stack([np.bincount(place, c).astype(np.int64)[place] for c in counts])
        found = np.split(total, np.cumsum([len(k) for k in keys])[:-1], axis=1)
        return pd.DataFrame({"block": pdf["block"], "partition": pdf["partition"], "totals": [packed(t.ravel()) for t in found]})

    return grams.groupBy("partition").applyInPandas(count, "block bigint, partition bigint, totals binary")


def score_documents(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: (doc_id, n_tokens, n_backed_off, log_score, mean_log_score).

    Words are cut at white space, A-Z lower-cased. Null, empty and blank texts have no tokens, a
    log score of 0 and a null mean. A row that repeats another's id and text is a document of its own
    and scores as the other does. An empty table gives an empty one. Extra columns are not read.
    """
    s = settings
    held = saved(blocks(docs, doc_id, text), "blocks")
    n_words, n_grams = held.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_grams"), F.lit(0))).first()
    partitions = 1 + n_grams // PARTITION_GRAMS

    def score(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = next(blocks.itertuples())
        b = Block(row, partitions)
        total = np.empty((2, len(b.order)), np.int64)
        total[:, b.order] = np.concatenate([unpacked(t).reshape(2, -1) for t in answers.sort_values("partition")["totals"]], axis=1)
        of_pair, n = total[0][b.pair], b.times
        of_word, of_history = total[:, len(b.word):]
        seen = np.maximum(of_word[b.word][b.pair] - b.own(b.word), s.smoothing)
        rest = np.maximum(of_history[b.history][b.pair] - b.own(b.history), 1)
        known = of_pair > n  # another document has the pair
        each = n * np.log(np.where(known, np.maximum(of_pair - n, 1) / rest, s.backoff * seen / max(n_words, 1)))
        lengths, full = b.lengths, b.lengths > 0
        off, sums = np.zeros(len(lengths), np.int64), np.zeros(len(lengths))
        off[full] = b.sums(b.document, n * ~known, full.sum())
        sums[full] = np.bincount(b.document, each, full.sum())
        return pd.DataFrame({"id": row.ids, "n_tokens": lengths, "n_backed_off": off, "log_score": sums})

    answers = totals(sent(held, partitions))
    scored = held.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        score, "id string, n_tokens bigint, n_backed_off bigint, log_score double")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")).alias("mean_log_score")
    return scored.select(F.col("id").cast(docs.schema[doc_id].dataType).alias(doc_id), "n_tokens", "n_backed_off", "log_score", mean)
