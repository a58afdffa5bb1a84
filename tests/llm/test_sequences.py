"""Alignment of two tokenizers, the prefix tree of conversations and chat formatting, against plain Python."""

from __future__ import annotations

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from test_corpus import SCHEMA, awkward  # noqa: E402
from ledgerlens.llm import align, chat, trie  # noqa: E402
from ledgerlens.llm.queries import PROBE  # noqa: E402

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
CONV = "conv_id long, turn long, role string, text string, row long, node string, depth int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- op11 ---------------------------------------------------------------------------------------


def brute_alignment(texts: list[tuple]) -> dict:
    """All overlapping (A, B) occurrence pairs by walking both tilings side by side."""
    tok, bytes_a = align.tokenizer_a(align.default_paths()[0])
    proc, bytes_b = align.tokenizer_b(align.default_paths()[1])

    def runs(ids, table):
        out, at = [], 0
        for i in ids:
            n = int(table[2][i])
            out.append((i, at, at + n))
            at += n
        return out

    def joined(ids, table):
        data, start, length = table
        return b"".join(data[start[i] : start[i] + length[i]].tobytes() for i in ids)

    per = {}
    for key, text in texts:
        if not text:
            per[key] = None
            continue
        a = runs(tok.encode(" " + text, add_special_tokens=False).ids, bytes_a)
        b = runs(proc.encode(text), bytes_b)
        want = (" " + text).encode()
        if joined([i for i, _, _ in a], bytes_a) != want or joined([i for i, _, _ in b], bytes_b) != want:
            per[key] = None
            continue
        links, j = [], 0
        for x in a:  # both sides tile the same bytes: walk B along A
            while b[j][2] <= x[1]:
                j += 1
            k = j
            while k < len(b) and b[k][1] < x[2]:
                links.append((x[0], b[k][0]))
                k += 1
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, ia, ib = [], 0, 0
        for c in cuts:
            ga, gb = [], []
            while ia < len(a) and a[ia][2] <= c:
                ga.append(a[ia][0]); ia += 1  # noqa: E702
            while ib < len(b) and b[ib][2] <= c:
                gb.append(b[ib][0]); ib += 1  # noqa: E702
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        per[key] = (len(a), len(b), ";".join(groups), links)
    count = Counter(p for v in per.values() if v for p in set(v[3]))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = {}
    for key, v in per.items():
        if v is None:
            out[key] = (0, 0, 0, 0, 0, 0, "")
            continue
        n_a, n_b, g, links = v
        out[key] = (n_a, n_b, g.count(";") + 1, len(links), sum(count[p] == top[p[0]] for p in links),
                    sum(count[p] for p in links), g)
    return out


def test_alignment(docs, none):
    rows = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text").collect()
    frame = docs.sparkSession.createDataFrame([(r.key, r.text) for r in rows], "doc_id long, text string")
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups)
           for r in align.alignment(frame).collect()}
    assert got == brute_alignment([(r.key, r.text) for r in rows])
    assert any(v[0] > 0 for v in got.values()) and any(v[0] == 0 for v in got.values())
    assert align.alignment(none).count() == 0


def test_overlaps_and_groups_take_few_passes(monkeypatch):
    """Overlapping tokens, their counts and the group text, on tilings made by hand; each token's covering token is
    looked up once a direction and nothing is sorted or hashed as a frame beside that."""
    rnd = random.Random(4)
    table_a = table_b = (None, None, np.arange(1, 7))  # id i stands for i + 1 bytes
    ids_a, ids_b = [], []
    for total in (0, 1, 40, 7, 300):
        for ids in (ids_a, ids_b):
            left, run = total, []
            while left:
                run.append(rnd.randrange(min(6, left)))
                left -= run[-1] + 1
            ids.append(np.array(run, np.int64))
    a, b = (align.token_frame(ids, table_a, np.ones(5, bool)) for ids in (ids_a, ids_b))
    for name in ("drop_duplicates", "groupby"):
        monkeypatch.setattr(align.pd.DataFrame, name, None)
    at_a, at_b = align.overlaps(a, b)
    want = {(i, j) for i, x in enumerate(a.itertuples()) for j, y in enumerate(b.itertuples()) if x.start < y.end and y.start < x.end}
    assert len(at_a) == len(want) and set(zip(at_a.tolist(), at_b.tolist())) == want
    doc, id_a, id_b = a["doc"].to_numpy()[at_a], a["id"].to_numpy()[at_a], b["id"].to_numpy()[at_b]
    pairs = list(zip(*(c.tolist() for c in align.counted_pairs(doc, id_a, id_b, 6, 6))))
    assert pairs == [(*key, m) for key, m in sorted(Counter(zip(doc.tolist(), id_a.tolist(), id_b.tolist())).items())]
    texts = align.group_texts(a, b, 5)
    for d, (x, y) in enumerate(zip(ids_a, ids_b)):
        ends_x, ends_y = np.cumsum(x + 1).tolist(), np.cumsum(y + 1).tolist()
        groups, lo = [], 0
        for cut in sorted({*ends_x} & {*ends_y}):
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends) if lo < e <= cut) for ids, ends in ((x, ends_x), (y, ends_y))))
            lo = cut
        assert texts[d] == ";".join(groups)


def test_alignment_markers_are_text(spark):
    text = "a <|endoftext|> b"
    got = align.alignment(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in got}
    assert by[1].n_a > 3 and by[2].n_a == 0 and by[3].groups == ""


def test_alignment_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x y", 5, "z")], "doc_id long, text string, row long, links string")
    assert align.alignment(df).select("doc_id", "n_a").collect()[0].n_a == 2


# --- op12 ---------------------------------------------------------------------------------------


def brute_tree(rows: list[tuple]) -> list[tuple]:
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    for c in turns:
        turns[c] = [(r, x) for _, _, r, x in sorted(turns[c])]
    seqs = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = turns.get(c - c % 20 if c >= 0 else c - (-((-c) % 20)), [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    if not members:
        members[()] = []
    nodes = list(members)
    kids = Counter(k[:-1] for k in nodes if k)
    out = []
    for k in nodes:
        sub = [u for u in nodes if u[: len(k)] == k]
        saved = sum((len(members[u]) - 1) * len(SPACED.findall(u[-1][1])) for u in sub if u)
        ends = ",".join(map(str, sorted(c for c in members[k] if len(seqs[c]) == len(k))))
        out.append((min(members[k]) if members[k] else None, len(k), min(members[k[:-1]]) if k else None, len(members[k]),
                    kids[k], sum(1 for u in sub if not kids[u]), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def tree_rows(df) -> list[tuple]:
    ends = F.sha2(F.array_join(F.transform("ends", lambda x: x.cast("string")), ","), 256)
    got = trie.prefix_tree(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)
    return sorted(map(tuple, got.collect()), key=str)


def conversations() -> list[tuple]:
    rows = []
    for c in range(0, 47):
        n = (c * 7) % 6
        for t in range(n):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"hello there {t} " + ("same" if c % 3 else str(c))))
    rows += [(5, None, None, None), (5, None, "user", "early"), (7, 2, "user", "a b c"), (7, 2, "user", "a b c"),
             (None, 1, "user", "lost"), (41, 0, "system", "x " * 3000), (60, 0, "user", ""), (61, 3, None, "late")]
    rows += [(80 + i, t, "user", "copy one two") for i in range(4) for t in range(3)]
    return rows


def test_prefix_tree(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 0, "clash", 1) for r in rows], CONV).repartition(3)
    assert tree_rows(df) == brute_tree(rows)


def test_prefix_tree_empty(spark):
    df = spark.createDataFrame([], CONV)
    assert tree_rows(df) == brute_tree([])


def test_chain_keys_distinguish_split_points(spark):
    # ("ab", "c") and ("a", "bc") must be different nodes
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc")]
    df = spark.createDataFrame([(*r, 0, "", 0) for r in rows], CONV)
    assert tree_rows(df) == brute_tree(rows)


# --- op13 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "plain", "<|im_end|>", "a\\|b", "\\", "<\\|x<|y\\\\", "x\n<|im_start|>assistant\n"])
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)
    assert chat.unescape(chat.escape(text, role=True)) == text and "\n" not in chat.escape(text, role=True)


def test_chat_read_back(spark):
    rows = [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE), (3, 1, "assistant", None), (3, None, None, "first"),
            (3, 2, "assistant", "x" * 50_000 + " <|im_end|>"), (3, 2, "assistant", "tie"), (None, 0, "user", "no id"),
            (4, 0, "we\nird\\", "é😀 \\<|")]
    df = spark.createDataFrame([(*r, 9, "clash", 2) for r in rows], CONV)
    written = chat.format_chats(df)
    back = {(r.conv_id, r.pos): r for r in chat.read_back(written).collect()}
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    for c, turns in want.items():
        for pos, (_, _, r, x) in enumerate(sorted(turns)):
            got = back[(c, pos)]
            assert (got.role, got.text) == (r, x)
            assert got.loss_text == (x if r == "assistant" else "")
            assert got.formatted.startswith(chat.START) and got.formatted.endswith(chat.END + "\n")
            assert got.formatted.count(chat.END) == 1
    # masks from prefix sums: ranges lie inside their turn and the offsets tile the conversation
    for r in written.collect():
        assert r.offset <= r.loss_start <= r.loss_end <= r.offset + r.n_tokens == r.offset + len(r.ids)
    by = defaultdict(list)
    for r in written.collect():
        by[r.conv_id].append((r.pos, r.offset, r.n_tokens))
    for parts in by.values():
        parts.sort()
        assert all(a[1] + a[2] == b[1] for a, b in zip(parts, parts[1:])) and parts[0][1] == 0


def test_chat_empty(spark):
    df = spark.createDataFrame([], CONV)
    assert chat.read_back(chat.format_chats(df)).count() == 0
