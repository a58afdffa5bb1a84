"""Language of a text by word-first backoff.

A known word scores its log frequency in each language. An unseen word scores the mean log
frequency of its longest known character n-grams, tried from the longest order down to single
letters. The text's language has the highest sum over its words.

Words and n-grams are counted by Spark over labelled texts; the tables that tasks look up hold at
most `words` words a language and `grams` n-grams a language and order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from ledgerlens.llm.common import few, saved

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """`documents`: most labelled texts a language that are counted, chosen by a hash of the text.

    `orders`: lengths of the n-grams, longest first. `smoothing` is added to every count. `longest`:
    words of more letters than this are scored by n-grams of their parts of that length, so that one
    unbroken run of letters does not become one table key.
    """

    documents: int = 4000
    words: int = 40_000
    grams: int = 20_000
    orders: tuple[int, ...] = (4, 3, 2, 1)
    smoothing: float = 0.5
    longest: int = 64


def tokens(text: str | None, longest: int) -> list[str]:
    """Lower-cased runs of letters, cut where they are too long; runs without a letter left out."""
    if not text:
        return []
    # A run may hold number-like characters that are no letters, such as a superscript two.
    out = [w for w in LETTERS.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]
    if any(len(w) > longest for w in out):
        out = [w[i : i + longest] for w in out for i in range(0, len(w), longest)]
    return out


def grams_of(word: str, order: int) -> list[str]:
    padded = f" {word} " if order > 1 else word
    return [padded[i : i + order] for i in range(len(padded) - order + 1)] or [padded]


@dataclass
class Model:
    """Log frequencies by language: for words, then for the n-grams of each order, the row of every
    entry and the rows, one column a language."""

    languages: list[str]
    rows: list[dict[str, int]]
    scores: list[np.ndarray]
    settings: Settings

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its share of the likelihood; `und` and 0 without a letter or a model."""
        found = tokens(text, self.settings.longest)
        if not found or not self.languages:
            return UNKNOWN, 0.0
        known, unseen = [], []
        row = self.rows[0].get
        for w in found:
            at = row(w)
            known.append(at) if at is not None else unseen.append(w)
        total = self.scores[0][known].sum(axis=0)
        flat: list[list[int]] = [[] for _ in self.settings.orders]
        sizes: list[list[int]] = [[] for _ in self.settings.orders]
        for w in unseen:
            for k, order in enumerate(self.settings.orders):
                table = self.rows[k + 1]
                at = [table[g] for g in grams_of(w, order) if g in table]
                if at:
                    flat[k] += at
                    sizes[k].append(len(at))
                    break
        for k, n in enumerate(sizes):
            if n:
                each = np.repeat(1.0 / np.array(n), n)
                total = total + each @ self.scores[k + 1][flat[k]]
        best = int(np.argmax(total))
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def learn(labelled: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> Model:
    """Count words and n-grams of the labelled texts. Rows without text or label teach nothing."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), settings.documents / F.count("*")).alias("share"))
    shares = {r["lang"]: r["share"] for r in share.collect()}  # one row a language
    drawn = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1_000_000.0
    keep = F.lit(False)
    for name, part in shares.items():
        keep = keep | ((F.col("lang") == name) & (drawn < part))

    columns, schema = ["lang", "kind", "gram", "n"], "lang string, kind int, gram string, n bigint"

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = {name: Counter(w for t in part for w in tokens(t, settings.longest)) for name, part in pdf.groupby("lang")["text"]}
            yield pd.DataFrame([(name, 0, w, n) for name, c in seen.items() for w, n in c.items()], columns=columns)

    def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter = Counter()
            for name, w, n in zip(pdf["lang"], pdf["gram"], pdf["n"]):
                for k, order in enumerate(settings.orders, 1):
                    for g in grams_of(w, order):
                        seen[(name, k, g)] += n
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=columns)

    total = F.sum("n").alias("n")
    words = saved(rows.filter(keep).mapInPandas(count_words, schema).groupBy("lang", "kind", "gram").agg(total), "words")
    grams = words.mapInPandas(count_grams, schema).groupBy("lang", "kind", "gram").agg(total)
    counts = saved(words.union(grams), "language-counts")
    order = W.partitionBy("lang", "kind").orderBy(F.desc("n"), "gram")
    most = F.when(F.col("kind") == 0, settings.words).otherwise(settings.grams)
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    totals = counts.groupBy("lang", "kind").agg(F.sum("n").alias("total"), F.count("*").alias("entries"))
    sums = {(r["lang"], r["kind"]): (r["total"], r["entries"]) for r in totals.collect()}
    languages = sorted({k[0] for k in sums})
    place = {name: i for i, name in enumerate(languages)}
    a = settings.smoothing
    tables, scores = [], []
    for kind in range(len(settings.orders) + 1):
        floor = np.array([np.log(a / (t + a * (e + 1))) for t, e in (sums.get((n, kind), (0, 0)) for n in languages)])
        table: dict[str, np.ndarray] = {}
        for r in top.filter(F.col("kind") == kind).select("lang", "gram", "n").collect():  # bounded by words and grams
            all_n, entries = sums[(r["lang"], kind)]
            table.setdefault(r["gram"], floor.copy())[place[r["lang"]]] = np.log((r["n"] + a) / (all_n + a * (entries + 1)))
        tables.append({g: i for i, g in enumerate(table)})
        scores.append(np.array(list(table.values())).reshape(len(table), len(languages)))
    return Model(languages, tables, scores, settings)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with (lang_pred, score).

    Null and empty texts and texts without a letter are `und` with score 0, as is every text if
    nothing was learned. Of equal languages the first by name is taken. Only the text is looked at.
    Columns named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = StructType.fromDDL("lang_pred string, score double")
    kept = [f for f in docs.schema.fields if f.name not in new.fieldNames()]
    names = [f.name for f in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in few(batches):
            found = pd.DataFrame([model.predict(t) for t in pdf[text]], columns=new.fieldNames(), index=pdf.index)
            yield pd.concat([pdf[names], found], axis=1)

    return docs.select(*names).mapInPandas(run, StructType([*kept, *new.fields]))


def held_out(doc_id: str = "doc_id"):
    """Documents that teach nothing: crc32 of the id as text leaves 2 by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def with_language(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """`docs` with (lang_pred, score), learned from the rows that are not held out."""
    return identify(docs, learn(docs.filter(~held_out(doc_id)), settings, text, lang), text)


def in_a_language(docs: DataFrame, least: float = 0.5, settings: Settings = Settings()) -> DataFrame:
    """The rows of `docs` that have a language: a letter, and a share of at least `least`."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    marked = with_language(plain, settings, at["doc_id"], at["text"], at["lang"])
    marked = marked.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return marked.drop("lang_pred", "score").toDF(*docs.columns)
