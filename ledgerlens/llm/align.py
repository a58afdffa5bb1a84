"""Alignment of two tokenizers' tokens over the bytes of the same text.

Tokenizer A (byte-level BPE) encodes " " + text; tokenizer B (sentencepiece BPE with byte fallback)
encodes the text and adds the space itself. Each token stands for a run of bytes; both runs tile the
same bytes when the tokenizers are lossless on the text.

Per Arrow batch, keyed by document, pandas `merge_asof` finds for every token start the other side's
token that covers it. Two runs overlap exactly when one's start lies inside the other, so the union of
both directions is the set of overlapping (A, B) occurrence pairs: the links. Byte offsets where an A
and a B token both end cut the tokens into groups.

Defined results:
- a null or empty text, or one whose joined A or B bytes differ from " " + text (B normalises some
  white space and characters), has no tokens: counts 0, `groups` '' and no links;
- long texts are encoded whole; the work per text is linear in its tokens;
- null and repeated doc_ids are rows like any other: every row is aligned on its own (`row` keys them);
- A is encoded with the same vocabulary's ranks through tiktoken (the same ids, about 7 times faster);
- columns other than the doc id and text are ignored, whatever their names.

Corpus-wide, an (A id, B id) pair's count is the number of rows that link it at least once; the
pairs are pre-aggregated per row before the shuffle, and the per-A-id maxima (at most A's vocabulary
size, 50,257 rows) are the only table sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import join_small, saved

ALIGNED = (
    "row long, n_a long, n_b long, n_groups long, groups string, "
    "links_a array<int>, links_b array<int>, links_m array<int>, n_links long"
)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's printable stand-ins: printable Latin-1 bytes are themselves, the others 256 on, in order."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = {chr(b): b for b in kept}, 0
    for b in range(256):
        if b not in kept:
            out[chr(256 + extra)] = b
            extra += 1
    return out


@lru_cache(maxsize=4)
def tokenizer_a(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True  # their strings in a text are plain text
    alphabet = byte_alphabet()
    size = tok.get_vocab_size(with_added_tokens=True)
    pieces = [bytes(alphabet[c] for c in (tok.id_to_token(i) or "")) for i in range(size)]
    return tok, table_of(pieces)


@lru_cache(maxsize=4)
def ranks_a(path: str):
    """Tokenizer A's vocabulary as ranks (`.tiktoken`), beside its `.json`: the same ids, encoded about
    seven times faster; `tests/llm` holds both encoders equal."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return tiktoken.Encoding("byte_bpe_a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: The decimal strings of ids with the separator that follows them, looked up rather than formatted token by
#: token: before a token of the same side, before the group's B tokens, before the next group.
BEFORE_SAME, BEFORE_B, BEFORE_A = (np.array([f"{i}{sep}" for i in range(1 << 16)], dtype=object) for sep in ",|;")


@lru_cache(maxsize=4)
def tokenizer_b(path: str):
    import sentencepiece

    proc = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(proc.get_piece_size()):
        p = proc.id_to_piece(i)
        if proc.is_byte(i):
            pieces.append(bytes([int(p[3:5], 16)]))
        elif proc.is_control(i) or proc.is_unknown(i):
            pieces.append(b"")  # stands for no bytes of the text: such a text fails the byte check
        else:
            pieces.append(p.replace("▁", " ").encode("utf-8"))
    return proc, table_of(pieces)


def table_of(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, start, length) of the pieces, for lookups by arrays of ids."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return np.frombuffer(b"".join(pieces), np.uint8), np.r_[0, np.cumsum(lengths)[:-1]], lengths


def spelled(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The bytes the ids stand for, joined."""
    data, start, length = table
    n = length[ids]
    at = np.repeat(start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return data[at]


def token_frame(ids: list[np.ndarray], table, ok: np.ndarray) -> pd.DataFrame:
    """One row per token of the rows marked `ok`: doc (batch position), at (place in the frame), id, start, end
    (bytes of the chunk)."""
    chosen = np.flatnonzero(ok)
    counts = np.fromiter((len(ids[d]) for d in chosen), np.int64, len(chosen))
    if not counts.sum():
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("doc", "at", "id", "start", "end")})
    tid = np.concatenate([ids[d] for d in chosen]).astype(np.int64)
    doc = np.repeat(chosen, counts)
    ln = table[2][tid]
    # offsets run on over the rows of the chunk: rows tile the same bytes on both sides, so the
    # offsets of A and B agree, and they rise through the frame
    end = np.cumsum(ln)
    return pd.DataFrame({"doc": doc, "at": np.arange(len(tid)), "id": tid, "start": end - ln, "end": end})


def covering(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """For each token of `left`, the place in `right` of its token (same document) whose bytes hold its first byte.

    Both frames rise in `start` already (see `token_frame`), as `merge_asof` wants."""
    return pd.merge_asof(left[["doc", "start"]], right[["doc", "start", "at"]],
                         on="start", by="doc", direction="backward")["at"].to_numpy(np.int64)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The overlapping (A, B) tokens, each pair once, as places in both frames."""
    ab = covering(a, b)  # each A start in its B token
    ba = covering(b, a)  # each B start in its A token
    # a pair is found from both sides when its B token is the one that holds its A token's start
    new = np.flatnonzero(ab[ba] != np.arange(len(ba)))
    return np.concatenate([np.arange(len(ab)), ba[new]]), np.concatenate([ab, new])


def counted_pairs(doc: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> tuple[np.ndarray, ...]:
    """(doc, a, b, m) of the distinct triples and how often each occurs, in their order; the ids lie below the sizes."""
    key, m = np.unique((doc * size_a + a) * size_b + b, return_counts=True)
    rest, b = np.divmod(key, size_b)
    doc, a = np.divmod(rest, size_a)
    return doc, a, b, m


def group_texts(a: pd.DataFrame, b: pd.DataFrame, n: int) -> list[str]:
    """Per row of the chunk, `a1,a2|b1;a3|b2,b3`: tokens of both sides cut where an A and a B token end at
    the same byte ('' without tokens). Every group holds a token of each side, as both tile the bytes
    between two cuts, and the end of a row is a cut."""
    ea, eb = a["end"].to_numpy(), b["end"].to_numpy()
    if not len(ea):
        return [""] * n
    ends_a, ends_b = np.zeros(ea[-1] + 1, bool), np.zeros(ea[-1] + 1, bool)
    ends_a[ea], ends_b[eb] = True, True
    cut_a, cut_b = ends_b[ea], ends_a[eb]
    # a token stands behind its own side's earlier tokens and the other side's tokens of earlier groups,
    # a B token also behind the A tokens of its own group
    upto_a, upto_b = np.r_[0, np.flatnonzero(cut_a) + 1], np.r_[0, np.flatnonzero(cut_b) + 1]
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    pieces = np.empty(len(ea) + len(eb), object)
    for ids, cut, at, last in ((a["id"].to_numpy(), cut_a, np.arange(len(ea)) + upto_b[group_a], BEFORE_B),
                               (b["id"].to_numpy(), cut_b, np.arange(len(eb)) + upto_a[group_b + 1], BEFORE_A)):
        text = BEFORE_SAME[ids]
        text[cut] = last[ids[cut]]
        pieces[at] = text
    pieces = pieces.tolist()
    per_row = np.bincount(a["doc"].to_numpy(), minlength=n) + np.bincount(b["doc"].to_numpy(), minlength=n)
    bounds = np.r_[0, np.cumsum(per_row)].tolist()
    return ["".join(pieces[bounds[d] : bounds[d + 1]])[:-1] for d in range(n)]  # no separator after the last token


def align_batch(pdf: pd.DataFrame, a_path: str, b_path: str) -> pd.DataFrame:
    _, bytes_a = tokenizer_a(a_path)
    fast_a = ranks_a(a_path)
    proc_b, bytes_b = tokenizer_b(b_path)
    texts = pdf["text"].tolist()
    n = len(texts)
    usable = np.array([isinstance(t, str) and t != "" for t in texts], bool)
    chosen = [t for t, u in zip(texts, usable) if u]
    ids_a_part = [np.asarray(fast_a.encode_ordinary(" " + t), np.int64) for t in chosen]
    ids_b_part = [np.asarray(x, np.int64) for x in proc_b.encode(chosen)] if chosen else []
    empty = np.zeros(0, np.int64)
    ids_a, ids_b = [empty] * n, [empty] * n
    for k, d in enumerate(np.flatnonzero(usable)):
        ids_a[d], ids_b[d] = ids_a_part[k], ids_b_part[k]
        want = np.frombuffer((" " + texts[d]).encode("utf-8"), np.uint8)
        got_a, got_b = spelled(ids_a[d], bytes_a), spelled(ids_b[d], bytes_b)
        if len(got_a) != len(want) or len(got_b) != len(want) or (got_a != want).any() or (got_b != want).any():
            usable[d] = False
    ta, tb = token_frame(ids_a, bytes_a, usable), token_frame(ids_b, bytes_b, usable)
    at_a, at_b = overlaps(ta, tb)
    pair_doc, id_a, id_b = ta["doc"].to_numpy()[at_a], ta["id"].to_numpy()[at_a], tb["id"].to_numpy()[at_b]
    link_doc, link_a, link_b, link_m = counted_pairs(pair_doc, id_a, id_b, len(bytes_a[2]), len(bytes_b[2]))
    n_links = np.bincount(pair_doc, minlength=n)
    cut_pairs = np.searchsorted(link_doc, np.arange(n + 1))
    count_a, count_b = np.bincount(ta["doc"].to_numpy(), minlength=n), np.bincount(tb["doc"].to_numpy(), minlength=n)
    texts = group_texts(ta, tb, n)
    pa, pb, pm = link_a.astype(np.int32), link_b.astype(np.int32), link_m.astype(np.int32)
    cols = {"n_a": [], "n_b": [], "n_groups": [], "groups": [], "links_a": [], "links_b": [], "links_m": [], "n_links": []}
    for d in range(n):
        text = texts[d]
        lo, hi = cut_pairs[d], cut_pairs[d + 1]
        for name, value in (("n_a", int(count_a[d])), ("n_b", int(count_b[d])), ("n_groups", text.count(";") + 1 if text else 0), ("groups", text),
                            ("links_a", pa[lo:hi]), ("links_b", pb[lo:hi]), ("links_m", pm[lo:hi]), ("n_links", int(n_links[d]))):
            cols[name].append(value)
    out = pd.DataFrame(cols)
    out.insert(0, "row", pdf["row"].to_numpy())
    return out


#: Texts of at most about so many characters are aligned together: the token frames of a chunk
#: take some 200 bytes a token, so a chunk stays near 30 MB whatever the Arrow batch holds.
CHUNK_CHARS = 500_000


def pieces_of(pdf: pd.DataFrame, chars: int) -> Iterator[pd.DataFrame]:
    """`pdf` cut into runs of rows whose texts hold about `chars` characters; a longer text is a run alone."""
    if not len(pdf):
        return
    size = np.fromiter((len(t) if isinstance(t, str) else 0 for t in pdf["text"]), np.int64, len(pdf))
    cut = np.floor_divide(np.cumsum(size) - size, chars)
    for start, stop in zip(np.r_[0, np.flatnonzero(np.diff(cut)) + 1], np.r_[np.flatnonzero(np.diff(cut)) + 1, len(pdf)]):
        yield pdf.iloc[start:stop]


def aligned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_path: str | None = None,
            b_path: str | None = None, groups: str = "text") -> DataFrame:
    """Per row of `docs`, written once to the shared folder: row (a key), doc_id, n_a, n_b, n_groups,
    groups, n_links and the row's distinct links as arrays links_a, links_b, links_m (multiplicity).

    `groups="sha256"` keeps the lowercase hex SHA-256 of the group text in its place ('' stays ''),
    so that corpus-wide runs do not carry texts longer than the documents.
    """
    if a_path is None or b_path is None:
        da, db = default_paths()
        a_path, b_path = a_path or da, b_path or db
    digest = groups == "sha256"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for pdf in batches:
            for part in pieces_of(pdf, CHUNK_CHARS):
                out = align_batch(part, a_path, b_path)
                out.insert(1, "doc_id", part["doc_id"].to_numpy())
                if digest:
                    out["groups"] = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in out["groups"]]
                yield out

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                       F.col(f"`{text}`").cast("string").alias("text"))
    schema = ALIGNED.replace("row long, ", "row long, doc_id long, ")
    return saved(rows.mapInPandas(run, schema), "aligned")


def alignment(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_path: str | None = None,
              b_path: str | None = None, groups: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_a, n_b, n_groups, groups, n_links, n_best, count_sum.

    `n_best` counts links whose pair count is the highest of any pair with their A id (ties all
    count); `count_sum` sums the pair counts over the links. The links of a row sit in one task, so
    the sums per row are combined before any shuffle.
    """
    found = aligned(docs, doc_id, text, a_path, b_path, groups)
    links = F.arrays_zip(F.col("links_a").alias("a"), F.col("links_b").alias("b"), F.col("links_m").alias("m"))
    pairs = found.select("row", F.explode(links).alias("l")).select("row", "l.a", "l.b", "l.m")
    counts = saved(pairs.groupBy("a", "b").agg(F.count("*").alias("docs")), "align-pairs")
    # one row per A id: bounded by A's vocabulary, so it may go to every task
    best = counts.groupBy("a").agg(F.max("docs").alias("top"))
    scored = (
        join_small(pairs, counts, ["a", "b"]).join(F.broadcast(best), "a")
        .groupBy("row").agg(
            F.sum(F.when(F.col("docs") == F.col("top"), F.col("m")).otherwise(0)).cast("long").alias("n_best"),
            F.sum(F.col("m") * F.col("docs")).cast("long").alias("count_sum"),
        )
    )
    out = found.drop("links_a", "links_b", "links_m").join(scored, "row", "left").na.fill(0, ["n_best", "count_sum"])
    return out.drop("row")
