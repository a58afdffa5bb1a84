"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. A document's expected copies grow with its size class, up to the
cap, and add up to the target; their whole part is taken for certain, and the rest is the odds of
one more copy. Documents are ranked by their random odds over these inclusion odds, and the sample
is the head of this order whose size, in words, is fixed by what the whole copies leave open.

The order is never sorted as a whole: words are totalled per cell of the rank's range, twice in
turn, and only the documents of the one cell that holds a source's cut are ordered. What is joined
back is one row a source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerlens.llm.common import join_small, n_spaced, saved

CELLS = 4096


@dataclass(frozen=True)
class Settings:
    """`weights` go to the sources in order of their names, repeating, null last.

    The mix holds `share` times all words; no document is taken more than `cap` times, and no
    source's target is above `cap` times its words. `seed` names the draw.
    """

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    cap: int = 2
    seed: str = "mix"


def draw(doc_id: Column, seed: str) -> Column:
    """A number between 0 and 1, both excluded, that depends on the id and the seed only."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def size_class(size: Column) -> Column:
    """The square root of the size, to a power of two; sources have some 40 classes at most."""
    return F.pow(F.lit(2.0), F.floor(F.length(F.bin(size)) / 2))


def targets(sizes: DataFrame, s: Settings) -> DataFrame:
    """Add `target` to (source, source_size): shares by weight, cut at the cap, the excess reshared.

    One row a source passes through one task: the sources are the recipe's list.
    """
    all_rows, by_name = W.partitionBy(), W.orderBy(F.asc_nulls_last("source"))
    turn = F.array(*[F.lit(float(w)) for w in s.weights])[(F.row_number().over(by_name) - 1) % len(s.weights)]
    x = sizes.withColumn("w", turn).withColumn("most", s.cap * F.col("source_size").cast("double"))
    order = W.orderBy(F.col("most") / F.col("w"), F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    total = F.sum(F.col("source_size").cast("double")).over(all_rows)
    x = x.withColumn("level", (s.share * total - before) / after)
    x = x.withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("level"))).over(all_rows))
    return x.select("source", "source_size", F.coalesce(F.least("most", F.col("w") * F.col("level")), "most").alias("target"))


def expected(s: Settings) -> Column:
    """Expected copies of a row that has `size` and its source's `factor`."""
    copies = F.coalesce(F.least(F.lit(float(s.cap)), F.col("factor") * size_class(F.col("size"))), F.lit(float(s.cap)))
    return F.when(F.col("size") > 0, copies).otherwise(0.0)


def ranked(df: DataFrame, doc_id: str, s: Settings) -> DataFrame:
    """Add `whole` copies and, where a further copy is open, `rank` between 0 and 1."""
    u, odds = draw(F.col(doc_id), s.seed), F.col("copies") - F.col("whole")
    df = df.withColumn("copies", expected(s)).withColumn("whole", F.floor("copies"))
    q = (u / (1 - u)) * ((1 - odds) / odds)
    return df.withColumn("rank", F.when(odds > 0, q / (1 + q)))


def plan(base: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id") -> DataFrame:
    """(source, source_size, target, factor, cut): one row a source. `base` has (doc_id, source, size).

    `factor` times a document's size class is its expected copies. `cut` is the last (rank, doc_id,
    size) that gets a further copy: the one at which the words taken come nearest to the target.
    """
    sizes = saved(base.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    goal = saved(targets(sizes, s), "targets")
    classes = base.filter("size > 0").groupBy("source", size_class(F.col("size")).alias("class")).agg(F.sum("size").cast("double").alias("words"))
    # Both sides have a few rows a source; the goal is renamed as its lineage is the same file.
    named = goal.withColumnRenamed("source", "_s")
    classes = classes.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    order = W.partitionBy("source").orderBy(F.desc("class"))
    before = F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weighted = F.sum(F.col("class") * F.col("words")).over(order.rowsBetween(0, W.unboundedFollowing))
    factor = (F.col("target") - s.cap * before) / weighted
    factors = classes.withColumn("f", factor).groupBy("source").agg(
        F.max(F.when(F.col("f") * F.col("class") <= s.cap, F.col("f"))).alias("factor"))
    factors = factors.withColumnRenamed("source", "_s")
    known = saved(goal.join(factors, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "factors")

    rows = ranked(with_plan(base, known), doc_id, s)
    cell = F.floor(F.col("rank") * (CELLS * CELLS))
    open_rows = rows.filter("rank IS NOT NULL").select(
        "source", doc_id, "size", "rank", F.floor(cell / CELLS).alias("cell"), F.pmod(cell, F.lit(CELLS)).alias("part"))
    taken = rows.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain")).withColumnRenamed("source", "_s")
    left = saved(
        known.join(taken, F.col("source").eqNullSafe(F.col("_s")))
        .select(F.col("source").alias("_s"), (F.col("target") - F.col("certain")).alias("left"), F.lit(0.0).alias("before")), "left")
    for name in ("cell", "part"):
        inside = join_small(open_rows, left, F.col("source").eqNullSafe(F.col("_s"))
                            & ((F.col("cell") == F.col("_cell")) if name == "part" else F.lit(True)))
        totals = inside.groupBy("source", "left", "before", name).agg(F.sum("size").alias("words"))
        so_far = F.sum("words").over(W.partitionBy("source").orderBy(name)) - F.col("words") + F.col("before")
        totals = totals.withColumn("so_far", so_far.cast("double")).filter(F.col("so_far") <= F.col("left"))
        best = totals.groupBy("source", "left").agg(F.max_by("so_far", name).alias("before"), F.max(name).alias(f"_{name}"))
        if name == "part":
            earlier = left.select(F.col("_s").alias("_t"), "_cell")
            best = best.join(earlier, F.col("source").eqNullSafe(F.col("_t"))).drop("_t")
        left = saved(best.withColumnRenamed("source", "_s"), "cut-cell")
    last = join_small(open_rows, left, F.col("source").eqNullSafe(F.col("_s")) & (F.col("cell") == F.col("_cell")) & (F.col("part") == F.col("_part")))
    keys = last.groupBy("source", "left", "before", F.struct("rank", doc_id, "size").alias("key")).agg(F.sum("size").alias("words"))
    so_far = F.sum("words").over(W.partitionBy("source").orderBy("key")) - F.col("words") + F.col("before")
    keys = keys.withColumn("mid", so_far + F.col("words") / 2)
    # Where the cut comes before the first of its cell, all ranks below the cell are taken.
    lowest = F.struct(((F.col("_cell") * CELLS + F.col("_part")) / float(CELLS * CELLS)).alias("rank"),
                      F.lit(None).cast(base.schema[doc_id].dataType).alias(doc_id), F.lit(-1).cast("long").alias("size"))
    cuts = keys.filter(F.col("mid") <= F.col("left")).groupBy("source").agg(F.max("key").alias("key")).withColumnRenamed("source", "_t")
    cuts = left.join(cuts, F.col("_s").eqNullSafe(F.col("_t")), "left").select("_s", F.coalesce("key", lowest).alias("cut"))
    return saved(known.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "plan")


def with_plan(df: DataFrame, found: DataFrame, source: str = "source") -> DataFrame:
    small = found.withColumnRenamed("source", "_source")
    return join_small(df, small, F.col(source).eqNullSafe(F.col("_source"))).drop("_source")


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size) of every document, written once: the texts are read here only."""
    return saved(docs.select(F.col(doc_id), F.col(source).alias("source"), n_spaced(F.col(text)).alias("size")), "sized")


def copies(df: DataFrame, found: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id") -> DataFrame:
    """`df` (doc_id, source, size, ...) with (source_size, target, copies): whole times a document is taken.

    Null and empty texts have size 0 and are taken no times. Rows that repeat an id draw the same
    number; rows alike in id, source and size are decided on together. A source may be null. An
    empty table gives an empty one. Extra columns are passed on; those named like the new ones are
    replaced.
    """
    df = df.drop("source_size", "target", "factor", "cut", "copies", "whole", "rank")
    out = ranked(with_plan(df, found), doc_id, s)
    key = F.struct("rank", doc_id, "size")
    more = F.coalesce((key <= F.col("cut")) & F.col("rank").isNotNull(), F.lit(False)).cast("long")
    return out.withColumn("copies", F.col("whole") + more).drop("whole", "rank", "factor", "cut")


def mixed_documents(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """`docs` with every row repeated as often as the mix takes it; rows it leaves out are gone.

    All columns are passed on as they are.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    base = sized(docs)
    known = plan(base, s)
    rows = plain.withColumns({"doc_id": F.col(at["doc_id"]), "source": F.col(at["source"]), "size": n_spaced(F.col(at["text"]))})
    taken = copies(rows, known, s).filter("copies > 0")
    taken = taken.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*plain.columns).toDF(*docs.columns)
