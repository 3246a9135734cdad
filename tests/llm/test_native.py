"""Sharding, mixing and block naming against plain computations."""

import hashlib
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from spokeframe.llm import blocknames, minhash, mixing, sharding
from tests.llm.conftest import SCHEMA, rows


def jump(key, n):
    b, j = -1, 0
    key %= 1 << 64
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark):
    ids = [*range(300), -1, -7, 2**62, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(i,) for i in ids], "i long")
    for n in (1, 8, 9, 13):
        for r in df.select("i", sharding.jump_hash(F.col("i"), n).alias("s")).collect():
            assert r.s == jump(r.i, n)


def test_shards(spark, odd_docs, no_docs):
    given, got = odd_docs.collect(), sharding.shard_documents(odd_docs).collect()
    assert sharding.shard_documents(no_docs).count() == 0
    want = sorted((r.doc_id is not None, r.doc_id or 0, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in given)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.shard == jump(r.doc_id or 0, 8) and r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_copies(spark, odd_docs, no_docs):
    assert blocknames.find_copies(no_docs).count() == 0
    groups = defaultdict(list)
    for r in odd_docs.collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    want = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert sorted(map(str, (tuple(r) for r in blocknames.find_copies(odd_docs).collect()))) == sorted(map(str, want))


def test_copies_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocknames, "BLOCK", 3)
    texts = ["abc" * n + tail for n in range(1, 9) for tail in ("", "a", "ab")] * 2 + ["é" * 7, "é" * 7, "abcabd", "xbcabc"]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in blocknames.find_copies(df).collect()}
    assert got == {i: (texts.index(t), texts.count(t)) for i, t in enumerate(texts)}


def test_blocks_that_share_a_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(blocknames, "BLOCK", 2)
    monkeypatch.setattr(blocknames, "block_hash", lambda block: F.length(block).cast("long") + F.when(block == "xy", 5).otherwise(0))
    texts = ["abcd", "abce", "abcd", "xy", "xyxy", "xyxy", "", None, "ab", "abab", "cdab", "abcd "]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in blocknames.find_copies(df).collect()}
    same = [t or "" for t in texts]
    assert got == {i: (same.index(t), same.count(t)) for i, t in enumerate(same)}


def test_columns_named_like_the_operators_own(spark):
    """Rows stay whole whatever their other columns are called, repeated rows or not."""
    given = [(1, "a b c d e f", "s", 1, 2, 3, 4, 5, 6), (2, "a b c d e f", "s", 1, 2, 3, 4, 5, 6), (3, None, "s", 1, 2, 3, 4, 5, 6), (4, "x y z", None, 1, 2, 3, 4, 5, 6)]
    for names, data in (("gone_id __only __sha id row share", [*given, given[0], given[2]]), ("label key component_id of class tie", given), ("row _row only _id rank range", [])):
        schema = "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names.split())
        df = spark.createDataFrame(data, schema)
        for keep in (blocknames.keep_rows, minhash.keep_rows):
            out = keep(df)
            assert out.columns == df.columns
            assert sorted(map(tuple, out.collect()), key=str) == sorted((r for r in given if r[0] != 2 and data), key=str), (keep, names)
        out = mixing.mix_rows(df)
        assert out.columns == df.columns and set(map(tuple, out.collect())) <= set(data)


def test_kept_rows(spark, odd_docs):
    kept = blocknames.keep_rows(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in odd_docs.collect()})


def fill(sizes):
    """Targets by raising a level until all words are given out."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if level * weight[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: 3 * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= over


def test_mix(spark, odd_docs, no_docs):
    assert mixing.mix_documents(no_docs).count() == 0
    assert mixing.mix_documents(odd_docs).count() == odd_docs.count()
    texts, sources = [], []
    for s, n in (("b", 400), ("a", 90), (None, 30), ("ä", 200), ("z", 1), ("0", 0)):
        for i in range(n):
            texts.append(" ".join(["w"] * (1 + (i * 37) % 50)))
            sources.append(s)
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(zip(texts, sources))], "doc_id long, text string, source string")
    got = mixing.mix_documents(df).collect()
    again = mixing.mix_documents(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
    want = fill(sizes)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - want[s]) <= 50 for s in want)
    assert mixing.mix_rows(df).count() == sum(r.copies for r in got)


def test_pareto_order_gives_equal_shares(spark):
    df = spark.createDataFrame([(i, "w " * 10, "a" if i % 10 else "b") for i in range(20000)], "doc_id long, text string, source string")
    got = mixing.mix_documents(df).groupBy("source", (F.col("doc_id") % 4).alias("part")).agg(F.avg("copies").alias("copies")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r.copies)
    assert all(max(x) - min(x) < 0.1 for x in by.values())


def test_ties_come_near_the_target(spark):
    """Rows that draw the same number are counted one by one: without an id, under one id, with other columns, and all alike."""
    for ids, texts in (([None] * 1000, ["w " * 10] * 1000), ([7] * 1000, ["w " * 10] * 1000), ([None] * 1000, [f"w{i} " * 10 for i in range(1000)])):
        rows_ = [(i, t, "a", k % 3) for k, (i, t) in enumerate(zip(ids, texts))] + [(1000 + i, "v " * 10, "b", 0) for i in range(1000)]
        df = spark.createDataFrame(rows_, "doc_id long, text string, source string, copies long")
        got = mixing.mix_documents(df).collect()
        assert len(got) == 2000
        for source in "ab":
            mine = [r for r in got if r.source == source]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= 5, source
        mixed = mixing.mix_rows(df)
        assert mixed.columns == df.columns
        for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect():
            assert abs(r.n * 10 - next(x.target for x in got if x.source == r.source)) <= 5
        most = mixed.groupBy(*df.columns).count().agg(F.max("count")).first()[0]
        assert most <= 3 * max(1, sum(1 for r in rows_ if r == rows_[0]))


def test_inclusion_follows_the_length_class(spark):
    """Long documents are wanted more often, whole copies come for certain, and Pareto order includes each class by its share."""
    df = spark.createDataFrame([(i, "w " * (3, 20, 150)[i % 3], "ab"[i % 2]) for i in range(24000)], "doc_id long, text string, source string")
    keyed = mixing._keyed(df, F.xxhash64("text"))
    plan = mixing.wanted_copies(keyed.groupBy("source", "class").agg(F.sum("size").alias("words"))).collect()
    got = mixing.mix_documents(df).groupBy("source", mixing.length_class(F.col("size")).alias("class")).agg(F.avg("copies").alias("copies"), F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    want = {(r.source, r["class"]): r.certain + r.share for r in plan}
    assert len({round(r.share, 6) for r in plan}) > 3 and {r.certain for r in plan} >= {0, 1}
    for r in got:
        assert abs(r.copies - want[r.source, r["class"]]) < 0.03
    for s in "ab":
        assert abs(sum(r.taken for r in got if r.source == s) - next(r.target for r in got if r.source == s)) <= 75
        by_class = sorted((r["class"], want[r.source, r["class"]]) for r in got if r.source == s)
        assert all(abs(m * by_class[0][0] - by_class[0][1] * k) < 1e-9 for k, m in by_class if m < 3)
