"""Corpus operators on awkward small tables, against plain Python."""

from __future__ import annotations

import io
import os
import random
import struct
import sys
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from ledgerlens.llm import decontam, langid, licenses, lm, mixing, neardup, pii, quality, sharding, warc  # noqa: E402

VOWELS = random.Random(5)
WORDS = ["".join(VOWELS.choice("abcdefghij") for _ in range(VOWELS.randint(2, 7))) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, spans string, keys int, score double"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def awkward() -> list[tuple]:
    base = prose(1, 120).split()
    texts = [
        None, "", " \n\t ", "one", "two words", "ONE", " ".join(base), " ".join(base).upper(), " ".join(base[:60] + ["new"] + base[60:]),
        " ".join(base[:100]), prose(2, 30_000), "é ö ß " * 40, "line a\nline b\nline a\n\n \nline a", "# * $ % & | < >",
        "mail a.b@c.de, x@y and q@r.s_t@u.v 1.2.3.4.5.6.7.8 300.1.1.1 4539 1488 0343 6467 +1 (234) 567-8901 +12",
        "Under the MIT License; cc-by-nc! Apache License, Version 2.0 licensed under the GNU General Public License, version 3",
        "9" * 40_000, "a" * 30_000, "²³ 123 !!", "\U0001F600 emoji \U0001F600 text x@y.zz",
    ]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 5 else None, None if i % 4 else 7) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "no id at all", None, None, None), (None, texts[6], "en", None, 1), (6, "same id, other text", "en", "s0", 1)]
    rows += [(100 + i, prose(100 + i // 2, 60), "en", "s0", 1) for i in range(12)]
    return [(*r, 1, "x", 2, 0.5) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_near_duplicates(spark, docs, none):
    s = neardup.Settings(size=3, percent=85)
    plain = [(r[0], r[1]) for r in awkward() if r[0] is not None and not (r[0] == 6 and r[1].startswith("same"))]
    want = brute.groups(plain, 3, 85)
    got = neardup.near_duplicates(spark.createDataFrame(plain, "doc_id long, text string"), s).collect()
    same([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got],
         [(d, len(brute.shingles(t, 3)), want[d], want[d] == d) for d, t in plain])
    assert neardup.near_duplicates(docs, s).count() == len(awkward())
    assert neardup.near_duplicates(none, s).count() == 0


def test_near_duplicate_stage_keeps_one_of_each(docs, none):
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None)
    assert ids.count(6) <= 2 and not {7, 8, 9} & set(ids) and {0, 1, 2} <= set(ids) and len([i for i in ids if i >= 100]) == 6
    assert neardup.without_near_duplicates(none).count() == 0


def test_estimate_follows_similarity():
    s, memo = neardup.Settings(), neardup.WordHash()
    words = prose(9, 3000).split()
    a = neardup.shingles(" ".join(words), 5, memo)
    for cut in (150, 600, 1500):
        b = neardup.shingles(" ".join(words[cut:]), 5, memo)
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        x, y = neardup.registers(a, 480)[None, :], neardup.registers(b, 480)[None, :]
        assert abs(float(neardup.estimate(x, y)[0, 0]) - true) < 0.1
    assert neardup.band_keys(neardup.registers(a, s.registers), len(a), s).size == s.bands


def test_linked_sets_share_a_key():
    """Around the size from which sets count as large, in tiny sets, and by odds at the threshold."""
    r = np.random.default_rng(7)
    for percent in (80, 85):
        s = neardup.Settings(percent=percent)
        cut = 2 * s.registers
        for small, more in [(cut, 1), (cut - 5, 20), (cut, cut * 100 // percent - cut), (cut + 1, 30), (cut // 2, 10), (17, 3)]:
            b = np.unique(r.integers(0, 1 << 64, small + more, dtype=np.uint64))
            a = np.sort(r.permutation(b)[:small])
            keys = [set(neardup.band_keys(neardup.registers(x, s.registers), len(x), s).tolist()) for x in (a, b)]
            assert keys[0] & keys[1], (percent, small, more)
        assert (1 - (percent / 100) ** s.rows) ** s.bands < 1e-6
        # Every shingle falls in the first band, as it may by chance.
        for n in range(1, 40):
            b = np.unique(r.integers(0, 1 << 58, n + 1, dtype=np.uint64))
            a = np.delete(b, n // 2)
            if 100 * n >= percent * (n + 1) and n * (100 - percent) < 2 * percent:
                keys = [set(neardup.one_less_keys(x, s).tolist()) for x in (a, b)]
                assert keys[0] & keys[1], (percent, n)


def test_blocks_lose_no_link(spark, monkeypatch):
    """A family cut into many blocks gives the same groups."""
    monkeypatch.setattr(neardup, "KEY_BLOCK", 8)
    monkeypatch.setattr(neardup, "SET_BLOCK", 8)
    base, r = prose(3, 90).split(), random.Random(4)
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        rows.append((i, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neardup.Settings(size=3, percent=85)).collect()
    want = brute.groups(rows, 3, 85)
    assert {r.doc_id: r.component_id for r in got} == want


def test_passages(spark, docs, none):
    items = [(1, prose(1, 120)[30:400]), (2, "two words"), (2, "two words"), (3, None), (4, "..."), (None, "one"), (5, prose(2, 30_000)[900:1100])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_passages(docs, bench).select("text", "n_words", "spans", "items").collect()
    for r in got:
        n, hit, named = brute.passages(r.text if r.text is None or len(r.text) < 20_000 or " " in r.text else "", items) if len(r.text or "") < 60_000 else (None, None, None)
        if n is None:
            assert r["items"] == [5]
        elif r.text and " " not in r.text and len(r.text) > 20_000:
            assert (r.n_words, r.spans) == (1, [])
        else:
            assert (r.n_words, sum(x.stop - x.start for x in r.spans), r["items"]) == (n, hit, named)
    clean = decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not r.spans for r in got)
    assert decontam.find_passages(docs, bench.limit(0)).filter("size(spans) > 0").count() == 0
    assert decontam.find_passages(none, bench).count() == 0


def test_passages_in_parts(spark, docs, monkeypatch):
    items = [(i, prose(100 + i, 40)) for i in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    read = lambda: [(r.doc_id, r.spans, r["items"]) for r in decontam.find_passages(docs, bench).select("doc_id", "spans", "items").collect()]
    one = read()
    monkeypatch.setattr(decontam, "PART_BYTES", 200)
    assert len(decontam.parts(bench, "item_id", "text")) > 3
    same(read(), one)


def test_language(docs, none, spark):
    out = {(r.doc_id, r.text): r for r in langid.with_language(docs).collect()}
    assert all(0 <= r.score <= 1 for r in out.values())
    letters = lambda t: any(map(str.isalpha, t or ""))
    assert all((r.lang_pred == "und") == (not letters(r.text)) for r in out.values())
    assert langid.with_language(none).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.with_language(unlabelled).collect()} == {"und"}
    kept = langid.in_a_language(docs)
    assert kept.columns == docs.columns and kept.filter("score <> 0.5").count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tried = langid.with_language(docs).filter(langid.held_out()).filter("lang IS NOT NULL")
    assert tried.filter("lang = lang_pred").count() >= 0.97 * tried.count() > 0


def test_unseen_words_back_off():
    s = langid.Settings(orders=(2, 1))
    import numpy as np
    model = langid.Model(["a", "b"], [{"known": 0}, {" z": 0}, {"q": 0}], [np.array([[0.0, -9.0]]), np.array([[-5.0, 0.0]]), np.array([[0.0, -4.0]])], s)
    assert model.predict("known")[0] == "a" and model.predict("zzz")[0] == "b" and model.predict("qqq")[0] == "a"
    assert model.predict("xyx") == ("a", 0.5) and model.predict("12") == ("und", 0.0)


def test_mixing(docs, none):
    base = mixing.sized(docs)
    rows = mixing.copies(base, mixing.plan(base)).collect()
    again = mixing.copies(base, mixing.plan(base)).collect()
    same(rows, again)
    assert len(rows) == len(awkward())
    total = sum(r["size"] for r in rows)
    assert abs(sum({r.source: r.target for r in rows}.values()) - 1.5 * total) <= 1e-6 * total or all(
        r.target == 2 * r.source_size for r in rows)
    for r in rows:
        assert 0 <= r.copies <= 2 and r.target <= 2 * r.source_size + 1e-9
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mixed_documents(none).count() == 0


def test_shards(docs, none):
    size = sharding.text_bytes(F.col("text"))
    out = sharding.kd_shards(docs, size, sharding.metadata(size), F.xxhash64("doc_id", "text"), leaves=4)
    rows = out.collect()
    assert len(rows) == len(awkward()) and {r.shard for r in rows} <= set(range(4))
    assert set(out.columns) == {*docs.columns, "shard"}
    numbered = sharding.slots(out.select("doc_id", "size", "shard"), "shard", "doc_id", "size").collect()
    for s in range(4):
        slots = sorted(r.slot for r in numbered if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.kd_shards(none, size, sharding.metadata(size), F.xxhash64("doc_id"), leaves=4).count() == 0


def test_shards_reach_target_bytes(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 97 + 1).alias("n"), F.lit("a").alias("source"), F.lit("x").alias("lang"))
    dims = {"by_id": F.col("doc_id").cast("double"), "one": F.lit(1.0)}
    got = sharding.kd_shards(rows, F.col("n"), dims, F.xxhash64("doc_id"), target_bytes=200_000).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(got) == 5 and max(r.b for r in got) < 1.02 * min(r.b for r in got)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(6, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs.select("*", F.xxhash64("text").alias("h")), labels)
    facts = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect()]
    same(facts, [(r[0], *brute.quality(r[1])) for r in awkward()])
    assert quality.judge(none, labels).count() == 0
    assert quality.judge(docs, labels.limit(0)).filter("size(rejected_by) > 0").count() == 0


def test_binomial_bound(spark):
    from math import comb
    cases = [(0, 10), (3, 400), (17, 2500), (0, 600), (40, 9000)]
    rows = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.at_most(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for r in rows:
        exact = sum(comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1)) if r.k < 0.01 * r.n else 1.0
        assert r.p == pytest.approx(exact, rel=1e-9)


def test_cutoffs_limit_false_rejection(spark):
    good = spark.range(20_000).select(F.lit("en").alias("stratum"), *[(F.col("id") % 1000 * (F.col("id") % 200 == 0).cast("int")).alias(s) for s in quality.SIGNALS])
    cut = quality.choose_cutoffs(good).first().cutoffs
    assert set(cut) == set(quality.SIGNALS)
    assert all(good.filter(F.col(s) > c).count() <= 0.01 * 20_000 for s, c in cut.items())


def test_personal_data(docs, none):
    got = pii.find_personal_data(docs).select("doc_id", pii.listed("base").alias("base")).collect()
    same(got, [(r[0], ",".join(f"{k}:{a}:{b}" for k, a, b in brute.personal(r[1]))) for r in awkward()])
    assert pii.find_personal_data(none).count() == 0


def test_contexts_lead_to_unseen_identifiers(spark):
    rows = [(i, f"some words here call me at 555 0{i} or write to mail: user{i}@host.com today") for i in range(40)]
    rows += [(100 + i, f"please write to mail: user{i}(at)host{i} now") for i in range(3)] + [(200 + i, f"page number {i} of text") for i in range(40)]
    out = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "base", pii.listed("spans").alias("s")).collect()}
    assert all(not out[100 + i].base and out[100 + i].s.startswith("email:22:") for i in range(3))
    assert all(out[200 + i].s == "" for i in range(40))


def test_licenses(docs, none):
    got = licenses.scan_licenses(docs).select("doc_id", "n_words", "base.n", "base.first", "base.last", F.array_join(F.array_sort("base.labels"), ",")).collect()
    same(got, [(r[0], *brute.phrases(r[1])) for r in awkward()])
    labels = {r.doc_id: r.labels for r in licenses.scan_licenses(docs).select("doc_id", "labels").collect()}
    assert labels[15] == ["apache-2", "cc-by-nc", "gpl-3", "mit"]
    assert len(licenses.rules()) > 300 and licenses.scan_licenses(none).count() == 0


def test_language_model(spark, docs, none):
    got = lm.score_documents(docs).collect()
    assert len(got) == len(awkward())
    same([(r.doc_id, r.n_tokens) for r in got], [(r[0], brute.quality(r[1])[0]) for r in awkward()])
    rows = [(1, "a b a"), (2, "a b c"), (3, "")]
    out = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    from math import log
    # Of another document: the start before a, a before b. What is left backs off to single words of 6.
    want = log(1 / 1) + log(1 / 1) + log(0.4 * 1 / 6)
    assert out[1].log_score == pytest.approx(want) and out[1].n_backed_off == 1
    assert out[2].log_score == pytest.approx(log(1 / 1) + log(1 / 1) + log(0.4 * 0.5 / 6)) and out[3].mean_log_score is None
    assert lm.score_documents(none).count() == 0


def test_language_model_blocks(spark, none, monkeypatch):
    """Several blocks and count partitions give what brute force gives."""
    from collections import Counter
    from math import log
    monkeypatch.setattr(lm, "BLOCK_WORDS", 150)
    monkeypatch.setattr(lm, "PARTITION_GRAMS", 40)
    rows = [(i, " ".join(prose(i % 7, 40 + i).split()[i % 5:])) for i in range(30)] + [(30, None), (31, " \n"), (32, prose(3, 900)), (32, prose(3, 900)), (None, "One TWO one")]
    cells = [Counter(zip([None, *w], w)) for w in ((t or "").lower().split() for _, t in rows)]
    pair = sum(cells, Counter())
    history, word = Counter(), Counter()
    for (h, w), n in pair.items():
        history[h] += n
        word[w] += n
    want = []
    for (i, _), c in zip(rows, cells):
        own_h, own_w, off, score = Counter(), Counter(), 0, 0.0
        for (h, w), n in c.items():
            own_h[h] += n
            own_w[w] += n
        for (h, w), n in c.items():
            if pair[h, w] > n:
                score += n * log((pair[h, w] - n) / (history[h] - own_h[h]))
            else:
                off += n
                score += n * log(0.4 * max(word[w] - own_w[w], 0.5) / sum(word.values()))
        want.append((i, sum(c.values()), off, round(score, 6)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm.score_documents(docs).collect()
    same([(r.doc_id, r.n_tokens, r.n_backed_off, round(r.log_score, 6)) for r in got], want)
    assert lm.score_documents(docs.limit(0)).count() == 0


def test_warc(spark):
    big = "<p>" + "x" * 200 + "</p>"
    rows = [(5, "http://a/1", big), (2, "http://a 2", big), (9, None, big), (2, "http://a/2", big), (7, "u", None), (8, "u", ""), (10, "u", "short"),
            (11, "u", "short"), (None, "u", big), (12, "u", "é\r\n\r\n" * 90)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int").repartition(2)
    got = warc.round_trip(pages).collect()
    from hashlib import sha256
    want = [(i, len((h or "").encode()), sha256((h or "").encode()).hexdigest(), "revisit" if h == big and i != 2 else "response",
             2 if h == big and i != 2 else None) for i, _, h in rows]
    same([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], want)
    assert all(bytes(r.payload) for r in got if r.page_id == 12)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_zip64_directory():
    class Ranges(io.BytesIO):
        def read_at(self, n, at):
            self.seek(at)
            return self.read(n)

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        with z.open(zipfile.ZipInfo(warc.DATA), "w", force_zip64=True) as f:
            f.write(b"payload")
        z.comment = b"a comment"
    data = raw.getvalue()
    at = data.rfind(b"PK\x05\x06")
    count, length, start = struct.unpack_from("<H", data, at + 10)[0], *struct.unpack_from("<II", data, at + 12)
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, length, start)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, at, 1)
    end = data[at : at + 8] + struct.pack("<HHIIH", 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 9) + b"a comment"
    f = Ranges(data[:at] + end64 + locator + end)
    members = warc.directory(f, len(f.getvalue()))
    place = warc.member_start(f, members, warc.DATA)
    assert f.read_at(members[warc.DATA][2], place) == b"payload"


def test_components(spark):
    from ledgerlens.llm.common import components
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102)], "a long, b long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert roots == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 103)}}
    assert components(edges.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    docs = spark.createDataFrame([r[:5] for r in awkward()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, prose(103, 60))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert at.schema == docs.schema
        if name == "language":
            assert not {0, 1, 2} & {r.doc_id for r in at.collect()}
        if name == "decontamination":
            assert not [r for r in at.collect() if r.doc_id in (106, 107)]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    same(got, at.collect())
    assert isinstance(out.schema["shard"].dataType, T.IntegerType)


def test_shard_medians_join_no_level_above(spark, monkeypatch):
    """Each level reads rows that carry their node: its rounds do not join the cuts of all levels above again."""
    plans, bounds, real, real_join = [], [], sharding.split, sharding.join_small

    def spy(rows, *rest):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return real(rows, *rest)

    def join_spy(*args, **kwargs):
        bounds.append(kwargs.get("at_most"))
        return real_join(*args, **kwargs)

    monkeypatch.setattr(sharding, "split", spy)
    monkeypatch.setattr(sharding, "join_small", join_spy)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 7 + 1).alias("bytes"))
    placed = sharding.kd_shards(docs, F.col("bytes"), {"by_id": F.col("doc_id").cast("double")}, F.xxhash64("doc_id"), leaves=8)
    held = [r.b for r in placed.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()]
    assert len(plans) == 3 and not any("Join" in p for p in plans)
    assert set(bounds) == {8}  # no job that counts a table of one row a node
    assert len(held) == 8 and max(held) - min(held) <= 14
