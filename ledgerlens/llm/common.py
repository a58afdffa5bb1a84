"""Word rules, shared tables, size-checked joins and connected components for the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import shared_folder  # noqa: F401

# How words are cut.
SPACED = r"[^\x20\x09-\x0D]+"
ALNUM_CUT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A table of at most so many rows is sent to every task; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Rows of an Arrow batch that are worked on at once.
ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: cuts the lineage, outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_small(df: DataFrame, small: DataFrame, on: Column | list[str], how: str = "inner",
               limit: int = BROADCAST_ROWS, at_most: int | None = None) -> DataFrame:
    """Join with a table that is mostly short: broadcast up to `limit` counted rows, else shuffled.

    `small` should be a saved table, as counting it is a job of its own. It is not counted where it
    is known to have `at_most` so many rows and these are few enough.
    """
    few = (at_most is not None and at_most <= limit) or small.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(small) if few else small, on, how)


def n_spaced(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED)), F.lit(0)).cast("long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that can be reached, for every node of the undirected `edges`.

    Alternating large and small stars: each round points neighbours at the smallest one, in about
    log(nodes) rounds. Only rows of two nodes are shuffled; a hub's rows can be split, as its
    smallest neighbour is found by a partial aggregate and joined back. No edges, no rows.
    """
    e = saved(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "edges")
    mark, live = None, e.limit(1).count()
    while live:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
            .select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u <> v").distinct()
        )
        e = saved(small, "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v"), F.col("v")).distinct())


def few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of Arrow batches, at most `ROWS` at once."""
    for pdf in batches:
        for start in range(0, len(pdf), ROWS):
            yield pdf.iloc[start : start + ROWS]


def each_group(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    """What `fn` lists for every group of rows, which must be bounded, for very many small groups.

    Rows are dealt by the keys and sorted; a task walks over the Arrow batches and cuts them where
    the keys change, so that a group of two rows costs no batch of its own.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            new = np.zeros(len(pdf), bool)
            for k in keys:
                v = pdf[k].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            starts = [0, *np.flatnonzero(new).tolist()]
            out = [row for a, b in zip(starts, starts[1:]) for row in fn(pdf.iloc[a:b])]
            rest = pdf.iloc[starts[-1] :]
            if out:
                yield pd.DataFrame(out, columns=columns)
        if rest is not None and len(rest):
            yield pd.DataFrame(fn(rest), columns=columns)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
