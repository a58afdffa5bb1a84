"""Near-duplicate groups of documents by HyperMinHash.

A document is the set of its distinct word shingles, each a 64-bit hash. The hash range is cut into
buckets; per bucket the smallest hash is kept as a register of its leading-zero count (6 bits) and
the mantissa bits that follow (10): 16 bits in place of 64. Bands of registers are hashed to keys;
documents that share a key are compared register by register, less the share of agreements that
short registers give by chance, and those whose estimate is near enough form a family. Inside a
family every pair is compared on full shingle sets, block by block, and the links found are closed
to components.

Copies of one set are one representative throughout, so a group of identical texts costs one row per
document and no pairs. A hot key or family is cut into blocks, and a task holds two blocks at most.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import components, each_group, few, saved

MANTISSA = 10
EMPTY = np.uint16(0xFFFF)
MEMO = 1 << 16
#: Documents of a key, and of a family, that one block holds.
KEY_BLOCK, SET_BLOCK = 2048, 512
#: Columns of the membership matrix that are in memory at once.
COLUMNS = 4096
#: Comparisons of registers that are made at once.
SMALL = 1 << 20
U = np.uint64


@dataclass(frozen=True)
class Settings:
    """`size` words a shingle; linked when 100 * both >= `percent` * either.

    With 30 bands of 4 registers a pair at 80 % shares no band once in 7 * 10^6, at 85 % once in 4 * 10^9.
    `margin`: a pair is compared in full unless its estimate is below the threshold by so much
    (over six standard deviations of the estimate).
    """

    size: int = 5
    percent: int = 80
    bands: int = 30
    rows: int = 4
    margin: float = 0.25

    @property
    def registers(self) -> int:
        return self.bands * self.rows


class WordHash(dict):
    """Hashes of words, the frequent ones kept."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO:
            self[word] = value
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str | None, size: int, memo: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    take = min(size, len(h))
    acc = np.full(len(h) - take + 1, take, np.uint64)
    for k in range(take):
        acc = mixed(acc * U(0x9E3779B97F4A7C15) + h[k : len(h) - take + 1 + k])
    return np.unique(acc)


def registers(hashes: np.ndarray, m: int) -> np.ndarray:
    """The register of each of m buckets: leading zeros and mantissa of the bucket's smallest hash."""
    low32 = U(0xFFFFFFFF)
    high, low = hashes >> U(32), hashes & low32
    part = low * U(m)
    top = high * U(m) + (part >> U(32))
    bucket = (top >> U(32)).astype(np.int64)
    rest = (top << U(32)) | (part & low32)  # the place inside the bucket, as a 64-bit fraction
    first = np.ones(len(hashes), bool)
    first[1:] = bucket[1:] != bucket[:-1]  # sorted, so the first of a bucket is its smallest
    rest = rest[first]
    zeros = 64 - np.frexp((rest >> U(11)).astype(np.float64))[1] - 11
    zeros = np.clip(zeros, 0, 53).astype(np.uint64)
    mantissa = (rest << (zeros + U(1))) >> U(64 - MANTISSA)
    out = np.full(m, EMPTY, np.uint16)
    out[bucket[first]] = ((zeros << U(MANTISSA)) | mantissa).astype(np.uint16)
    return out


@functools.cache
def size_steps(percent: int, upto: int) -> list[int]:
    """The smallest size of each step up to size `upto`, in whole numbers: a step ends where its
    first size can no longer be linked, so linked sets are at most one step apart."""
    starts = [1]
    while starts[-1] <= upto:
        starts.append(100 * starts[-1] // percent + 1)
    return starts


def band_keys(reg: np.ndarray, n: int, s: Settings) -> np.ndarray:
    """A key for each band that has a register.

    Sets of so few shingles that one more or less breaks the threshold link with their copies only
    and get no key. Small sets leave most registers empty, so the set's size, in steps that linked
    sets are at most one apart in, tells them apart as well. Sets just above the small ones, which
    may be linked with one, get the keys of both kinds.
    """
    if n == 0 or 100 * n < s.percent * (n + 1):
        return np.empty(0, np.int64)
    grid = reg.reshape(s.bands, s.rows)
    full = np.flatnonzero((grid != EMPTY).any(axis=1))
    key = mixed(full.astype(np.uint64) + U(1))
    for k in range(s.rows):
        key = mixed(key * U(31) + grid[full, k].astype(np.uint64))
    small = 2 * s.registers
    reach = 100 * small // s.percent  # the largest set that a small one can be linked with
    if n <= reach:
        step = bisect.bisect_right(size_steps(s.percent, reach), n)
        sized = [mixed(key + U(step)), mixed(key + U(step + 1))]
        key = np.concatenate(sized if n <= small else [*sized, key])
    return key.view(np.int64)


def one_less_keys(hashes: np.ndarray, s: Settings) -> np.ndarray:
    """Keys of a set of few shingles: the whole set and the set without each of them.

    With so few, linked sets differ in one shingle; it may share a band with all the others, so
    these keys find such pairs for certain.
    """
    n = len(hashes)
    if n == 0 or 100 * n < s.percent * (n + 1) or n * (100 - s.percent) > 2 * s.percent + 100:
        return np.empty(0, np.int64)
    each = mixed(hashes + U(5))
    whole = np.bitwise_xor.reduce(each)
    return mixed(np.concatenate([whole[None], whole ^ each[: n if n > 1 else 0]])).view(np.int64)


def sketch(docs: DataFrame, s: Settings, text: str = "text", set_id: str = "set_id") -> DataFrame:
    """`docs` with (n_shingles, set_id, registers, keys); set_id is null for an empty set."""
    out = f"{set_id} binary, n_shingles bigint, registers binary, band_keys array<bigint>"
    kept = [f for f in docs.schema.fields if f.name not in (set_id, "n_shingles", "registers", "band_keys")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHash()
        for pdf in few(batches):
            rows = []
            for value in pdf[text]:
                h = shingles(value, s.size, memo)
                reg = registers(h, s.registers)
                keys = np.concatenate([band_keys(reg, len(h), s), one_less_keys(h, s)])
                rows.append((xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None, len(h), reg.tobytes(), keys))
            new = pd.DataFrame(rows, columns=[set_id, "n_shingles", "registers", "band_keys"], index=pdf.index)
            yield pd.concat([pdf[names], new], axis=1)

    from pyspark.sql.types import StructType

    schema = StructType([*kept, *StructType.fromDDL(out).fields])
    return docs.select(*names).mapInPandas(run, schema)


def with_set_id(docs: DataFrame, s: Settings, text: str = "text", set_id: str = "set_id") -> DataFrame:
    """`docs` with the set_id that `sketch` gives."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHash()
        for pdf in few(batches):
            h = [shingles(value, s.size, memo) for value in pdf[text]]
            yield pdf.assign(**{set_id: [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in h]})

    return docs.mapInPandas(run, StructType([*docs.schema.fields, StructField(set_id, BinaryType())]))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of every row of `a` with every row of `b`.

    Registers that agree, over those filled on either side, less what agrees by chance: of two
    unlike sets, two filled registers have the same zeros with chance 1/3 and then the same mantissa
    with 2^-10.
    """
    if len(a) * len(b) * a.shape[1] <= SMALL:
        x, y = a[:, None, :], b[None, :, :]
        some = (x != EMPTY) | (y != EMPTY)
        agree, filled = ((x == y) & some).sum(axis=2), some.sum(axis=2)
    else:
        agree = np.zeros((len(a), len(b)), np.float32)
        filled = np.zeros((len(a), len(b)), np.float32)
        for k in range(a.shape[1]):
            x, y = a[:, k][:, None], b[:, k][None, :]
            some = (x != EMPTY) | (y != EMPTY)
            agree += (x == y) & some
            filled += some
    share = agree / np.maximum(filled, 1)
    chance = np.float32(1 / 3 / (1 << MANTISSA))
    return (share - chance) / (1 - chance)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets, all of `left` with all of `right`."""
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float64)
    places = [[np.searchsorted(both, h[np.isin(h, both, assume_unique=True)]) for h in side] for side in (left, right)]
    for start in range(0, len(both), COLUMNS):
        width = min(COLUMNS, len(both) - start)
        pair = []
        for side in places:
            m = np.zeros((len(side), width), np.float32)
            for i, p in enumerate(side):
                m[i, p[np.searchsorted(p, start) : np.searchsorted(p, start + width)] - start] = 1
            pair.append(m)
        out += pair[0] @ pair[1].T
    return out


def forest(linked: np.ndarray, left: list[int], right: list[int], n: int) -> list[tuple[int, int]]:
    """Links that hold together what `linked` (left x right) holds together; at most n - 1."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*map(np.ndarray.tolist, np.nonzero(linked))):
        a, b = left[i], right[j]
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def in_blocks(df: DataFrame, group: str, member: str, count: str, block: int) -> DataFrame:
    """Each member once for every pair of blocks of its group that it is in: columns (bi, bj, own).

    A group of up to `block` members is the one pair (0, 0).
    """
    n = F.ceil(F.col(count) / block).cast("int")
    own = F.pmod(F.xxhash64(member, F.lit(11)), n).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    return (
        df.withColumns({"_n": n, "own": own}).withColumn("_o", other)
        .withColumns({"bi": F.least("own", "_o"), "bj": F.greatest("own", "_o")}).drop("_n", "_o")
    )


def families(sets: DataFrame, s: Settings) -> DataFrame:
    """(a, b): sets whose estimate is near the threshold, as links that keep each family together."""
    keys = sets.select("set_id", F.explode("band_keys").alias("key"))
    shared = keys.groupBy("key").agg(
        F.count("*").alias("members"), F.bit_xor(F.xxhash64("set_id")).alias("x"), F.bit_xor(F.xxhash64("set_id", F.lit(7))).alias("y"))
    # Sets that are alike share many keys: of keys with the same members one is enough.
    shared = shared.filter("members > 1").groupBy("members", "x", "y").agg(F.min("key").alias("key")).drop("x", "y")
    dealt = in_blocks(keys.join(shared, "key"), "key", "set_id", "members", KEY_BLOCK)
    rows = dealt.join(sets.select("set_id", "registers"), "set_id")
    least = s.percent / 100 - s.margin

    def near(pdf: pd.DataFrame) -> list[tuple]:
        reg = np.frombuffer(b"".join(pdf["registers"]), np.uint16).reshape(len(pdf), -1)
        own, ids = pdf["own"].to_numpy(), pdf["set_id"].to_list()
        left, right = np.flatnonzero(own == pdf["bi"].iloc[0]), np.flatnonzero(own == pdf["bj"].iloc[0])
        ok = estimate(reg[left], reg[right]) >= least
        return [(ids[a], ids[b]) for a, b in forest(ok, left.tolist(), right.tolist(), len(ids))]

    return each_group(rows, ["key", "bi", "bj"], near, "a binary, b binary").distinct()


def links(members: DataFrame, s: Settings) -> DataFrame:
    """(a, b): links confirmed on full sets; `members` has (family, set_id, hashes, n_family)."""
    dealt = in_blocks(members, "family", "set_id", "n_family", SET_BLOCK)

    def confirm(pdf: pd.DataFrame) -> list[tuple]:
        ids, own = pdf["set_id"].to_list(), pdf["own"].to_numpy()
        hashes = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
        sizes = np.array([len(h) for h in hashes], np.float64)
        left, right = np.flatnonzero(own == pdf["bi"].iloc[0]), np.flatnonzero(own == pdf["bj"].iloc[0])
        if not len(left) or not len(right):
            return []
        both = shared_counts([hashes[i] for i in left], [hashes[i] for i in right])
        either = sizes[left][:, None] + sizes[right][None, :] - both
        ok = 100 * both >= s.percent * either
        return [(ids[a], ids[b]) for a, b in forest(ok, left.tolist(), right.tolist(), len(ids))]

    return each_group(dealt, ["family", "bi", "bj"], confirm, "a binary, b binary").distinct()


def set_links(docs: DataFrame, sketches: DataFrame, s: Settings, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, root) of the representatives that are linked with another."""
    sets = saved(
        sketches.filter("set_id IS NOT NULL").groupBy("set_id")
        .agg(F.min(doc_id).alias("least_id"), F.first("registers").alias("registers"), F.first("band_keys").alias("band_keys")),
        "sets")
    family = components(families(sets, s)).select(F.col("node").alias("set_id"), F.col("root").alias("family"))
    n = family.groupBy("family").agg(F.count("*").alias("n_family"))
    wanted = saved(family.join(n, "family").join(sets.select("set_id", "least_id"), "set_id"), "families")
    ids = saved(wanted.select(F.col("least_id").alias("_id")).distinct(), "family-ids")

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHash()
        for pdf in few(batches):
            h = [shingles(t, s.size, memo) for t in pdf[text]]
            yield pd.DataFrame({"set_id": [xxhash.xxh3_128_digest(x.tobytes()) for x in h], "hashes": [x.tobytes() for x in h]})

    texts = docs.select(doc_id, text).filter(F.col(text).isNotNull())
    texts = texts.join(ids, F.col(doc_id).eqNullSafe(F.col("_id")), "left_semi")
    # A repeated id may bring texts of other sets along: the join on set_id leaves them out.
    hashes = texts.mapInPandas(full, "set_id binary, hashes binary").dropDuplicates(["set_id"])
    members = wanted.join(hashes, "set_id").select("family", "set_id", "hashes", "n_family")
    return components(links(members, s))


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: (doc_id, n_shingles, component_id, kept, set_id).

    component_id is the smallest doc_id that links reach, its own included; kept tells whether it is
    its own. Null and empty texts, and texts of white space, have no shingles and are linked with
    nothing. Rows that repeat a doc_id each have their own text's set; null doc_ids are never the
    smallest unless a whole component has no other, and are kept then. An empty table gives an empty
    one. Extra columns are not read.
    """
    sketches = saved(sketch(docs.select(doc_id, text), settings, text).drop(text), "sketches")
    roots = saved(set_links(docs, sketches, settings, doc_id, text), "roots")
    least = sketches.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min(doc_id).alias("_least"))
    least = least.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    groups = least.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = least.join(groups, "root").select("set_id", "component_id")
    named = sketches.select(doc_id, "n_shingles", "set_id").join(named, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col(doc_id)).otherwise(F.col("component_id"))
    return named.select(
        doc_id, "n_shingles", component.alias("component_id"),
        F.col(doc_id).eqNullSafe(component).alias("kept"), "set_id")


def without_near_duplicates(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row for each group of near-duplicates: the one of the smallest doc_id.

    Of rows with the same id and set one stays. Rows without a word are in no group and all stay.
    All columns are passed on as they are.
    """
    flags = near_duplicates(docs, settings, doc_id, text)
    stay = flags.filter("kept AND set_id IS NOT NULL").groupBy(F.col(doc_id).alias("_id"), F.col("set_id").alias("_set"))
    # A kept row's id is its component's. Of a repeated id with unlike texts in it, one set stays.
    stay = saved(stay.agg(F.count("*").alias("_n")).groupBy("_id").agg(F.min(F.struct("_set", "_n")).alias("_x")).select("_id", "_x.*"), "stay")
    empty = docs.filter(~F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    full = docs.filter(F.col(text).rlike(r"[^\x20\x09-\x0D]"))

    def picked(stay: DataFrame) -> DataFrame:
        rows = full.join(stay.select("_id", "_set"), F.col(doc_id).eqNullSafe(F.col("_id"))).drop("_id")
        return with_set_id(rows, settings, text, "_set_id").filter("_set_id = _set").drop("_set")

    # Only rows that repeat both id and set are dealt out again to keep one of them.
    one = picked(stay.filter("_n = 1"))
    again = stay.filter("_n > 1")
    if not again.isEmpty():
        one = one.unionByName(picked(again).dropDuplicates([doc_id, "_set_id"]))
    return one.select(docs.columns).unionByName(empty)
