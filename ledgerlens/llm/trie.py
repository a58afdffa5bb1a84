"""A prefix tree over conversations, with totals over every subtree.

A node is a distinct sequence of first turns (role, text); the root is the empty sequence. A
conversation is a member of every node it starts with. Node identity is a chained digest: the key of
depth d is a 128-bit digest of the key of depth d - 1 and the d-th turn, computed in one pass over a
conversation's turns, so equal keys mean equal prefixes (up to digest collisions, about 2^-64 for
10^10 nodes).

Totals over subtrees (childless nodes, saved tokens) come from the conversations' chains: a node's
subtree is what lies below it on its members' chains. Each node's own amounts are placed on one chain,
its smallest member's; running sums from the far end of each chain (a window per conversation) then
hold, at every depth, what that chain alone adds below; summed over a node's members they give its
subtree's totals. Rows: one a (conversation, depth), so linear in the turns. (The centroid
decomposition first named for this needs subtree sizes inside every component on every level, which is
the same roll-up again; see README.)

Defined results: rows of a conversation are ordered by turn, nulls first, ties by role then text; a
null role or text is empty; rows with a null conv_id belong to no conversation; repeated rows are
turns of their own; an empty table gives the root alone with no members; texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import SPACED, saved

ROOT = bytes(16)
CHAIN = "conv_id long, depth long, node binary, parent binary, words long, length long"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), role, text: turns in order, nulls made empty."""
    w = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter(F.col("conv_id").isNotNull())
    return rows.withColumn("pos", (F.row_number().over(w) - 1).cast("long")).drop("turn")


def rebuilt(conversations: DataFrame, period: int = 20, heads: int = 4) -> DataFrame:
    """Every conv_id c as the first h turns of conversation c - c % period (all if fewer, none if
    absent), then c's own turns after its first h; h = unsigned crc32 of decimal c, modulo `heads`.

    conv_id, pos, role, text; a conversation without turns has no rows (see `chains`).
    """
    turns = saved(ordered_turns(conversations), "trie-turns")
    ids = turns.select("conv_id").distinct().select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % period).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"),
    )
    head = ids.join(turns.withColumnRenamed("conv_id", "base"), "base").filter(F.col("pos") < F.col("h"))
    own = turns.join(ids.select("conv_id", "h"), "conv_id").filter(F.col("pos") >= F.col("h"))
    both = head.select("conv_id", F.lit(0).alias("part"), "pos", "role", "text").unionByName(
        own.select("conv_id", F.lit(1).alias("part"), "pos", "role", "text"))
    w = W.partitionBy("conv_id").orderBy("part", "pos")
    return both.select("conv_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), "role", "text"), ids.select("conv_id")


def chains(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """For every conversation and depth 0..length: the node key, its parent's, the words of the last
    text and the conversation's length. Turns travel grouped by conversation, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for conv, items in zip(pdf["conv_id"], pdf["items"]):
                items = sorted(items, key=lambda x: x["pos"]) if items is not None else []
                n = len(items)
                out.append((conv, 0, ROOT, None, 0, n))
                key = ROOT
                for d, it in enumerate(items, 1):
                    role, text = it["role"].encode("utf-8"), it["text"].encode("utf-8")
                    h = hashlib.sha256(key)
                    for part in (role, text):
                        h.update(len(part).to_bytes(8, "little"))
                        h.update(part)
                    parent, key = key, h.digest()[:16]
                    out.append((conv, d, key, parent, int(it["words"]), n))
            yield pd.DataFrame(out, columns=["conv_id", "depth", "node", "parent", "words", "length"])

    grouped = turns.groupBy("conv_id").agg(F.collect_list(F.struct(
        "pos", "role", "text", F.regexp_count("text", F.lit(SPACED)).cast("long").alias("words"))).alias("items"))
    every = ids.join(grouped, "conv_id", "left")
    return every.mapInPandas(run, CHAIN)


def prefix_tree(conversations: DataFrame, period: int = 20, heads: int = 4) -> DataFrame:
    """Per node: node (key), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (both over the subtree, top included), ends (sorted conv_ids of members of
    exactly its depth).

    The root always exists; with no conversation it has 0 members and conv_id null.
    """
    spark = conversations.sparkSession
    turns, ids = rebuilt(conversations, period, heads)
    chain = saved(chains(turns, ids), "trie-chain")
    nodes = chain.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"),
        F.count("*").alias("n_convs"), F.first("words").alias("words"),
        F.array_sort(F.collect_list(F.when(F.col("length") == F.col("depth"), F.col("conv_id")))).alias("ends"),
    )
    root = spark.createDataFrame([(ROOT, None, 0, None, 0, 0, [])], "node binary, conv_id long, depth long, parent binary, n_convs long, words long, ends array<long>")
    nodes = nodes.unionByName(root.join(nodes.select("node"), "node", "left_anti"))
    children = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = saved(nodes.join(children, "node", "left").na.fill(0, ["n_children"]), "trie-nodes")
    # A node's subtree is what lies below it on its members' chains. Each node is counted on one
    # chain only, its smallest member's; sums from the far end of every chain up to each depth, added
    # over a node's members, are then its subtree's totals. Rows: one a (conversation, depth).
    weights = nodes.select(
        "node", F.col("conv_id").alias("rep"), (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("words")).cast("long").alias("saved"),
    )
    mine = F.col("rep") == F.col("conv_id")
    placed = chain.select("conv_id", "depth", "node").join(weights, "node").select(
        "conv_id", "depth", "node", F.when(mine, F.col("leaf")).otherwise(0).alias("leaf"),
        F.when(mine, F.col("saved")).otherwise(0).alias("saved"))
    below = W.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, 0)
    totals = placed.select("node", F.sum("leaf").over(below).alias("leaf"), F.sum("saved").over(below).alias("saved")).groupBy("node").agg(
        F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(totals, "node", "left").join(parents, "parent", "left")
    return out.select(
        "node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.coalesce("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), "ends",
    )
