"""Near-duplicates against all pairs."""

import pickle
import random
import re

import numpy as np
import pandas as pd

from spokeframe.llm import minhash
from tests.llm.conftest import SCHEMA, rows


def brute(docs, percent):
    sets = []
    for _, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(docs):
        best[find(i)] = min(best.get(find(i), d), d)
    return {d: (len(s), best[find(i)], best[find(i)] == d) for i, ((d, _), s) in enumerate(zip(docs, sets))}


def test_planted_groups(spark):
    rnd = random.Random(3)
    vocab = ["w%d" % i for i in range(3000)]
    shared = [rnd.choice(vocab) for _ in range(120)]
    texts = []
    for g in range(40):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([6, 9, 40, 150, 400]))]
        if g % 3 == 0:
            base += shared
        for c in range(rnd.choice([1, 2, 3, 8])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            texts.append(" ".join(copy).upper() if c % 2 else " ".join(copy))
    rnd.shuffle(texts)
    df = spark.createDataFrame(rows(texts), SCHEMA)
    for percent in (80, 85):
        want = brute(list(enumerate(texts)), percent)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, percent).collect()}
        assert got == want


def test_hub_of_a_star_is_not_the_smallest_id(spark):
    rnd = random.Random(5)
    hub = ["h%d" % rnd.randrange(10**6) for _ in range(400)]
    texts = []
    for i in range(60):
        copy = list(hub)
        for at in rnd.sample(range(0, 400, 6), 5):
            copy[at] = f"new{i}x{at}"
        texts.append(" ".join(copy))
    texts.append(" ".join(hub))
    want = brute(list(enumerate(texts)), 85)
    assert len({c for _, c, _ in want.values()}) == 1
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows(texts), SCHEMA), 85).collect()}
    assert set(got.values()) == {0}


def edited_copies(seed, copies, words, edits):
    """Copies of one text, which is not among them, each edited at places of its own."""
    rnd = random.Random(seed)
    base = ["o%d" % i for i in range(words)]
    out = []
    for c in range(copies):
        copy = list(base)
        for at in rnd.sample(range(words), edits):
            copy[at] = f"n{c}x{at}"
        out.append(" ".join(copy))
    return out


def test_copies_without_their_original(spark):
    texts = edited_copies(11, 450, 200, 2)
    want = {d: c for d, (_, c, _) in brute(list(enumerate(texts)), 85).items()}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows(texts), SCHEMA), 85).collect()}
    assert [d for d in want if got[d] != want[d]] == []


def test_shared_counts_of_blocks():
    draw = np.random.default_rng(4)
    held = []
    for n in (70, 90):
        sets = [np.unique(np.r_[draw.integers(0, 40, 60), draw.integers(100, 9000, 300)]).astype(np.uint64) for _ in range(n)]
        frame = pd.DataFrame({"group": 1, "block": 1, "id": range(n), "of": range(n), "shingles": [s.tobytes() for s in sets]})
        held.append((sets, pickle.loads(minhash._block(frame)["held"][0])))
    want = [[len(np.intersect1d(a, b)) for b in held[1][0]] for a in held[0][0]]
    assert minhash.shared_counts(held[0][1], held[1][1]).tolist() == want


def test_joined_members_stay_in_open_buckets(spark):
    """Bucket 1: member 2 has joined its centre, 1, and 9 is apart and too large for a star edge. 2: of one component. 3: of two members."""
    met = spark.createDataFrame([(1, 1, 10, 3), (1, 2, 10, 3), (1, 9, 99, 3), (2, 1, 10, 3), (2, 2, 10, 3), (2, 3, 10, 3), (3, 1, 10, 2), (3, 9, 99, 2)], "key long, id long, n long, degree long")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id long, label long")
    assert sorted((r.key, r.id) for r in minhash._open(met, labels).collect()) == [(1, 1), (1, 2), (1, 9)]


def test_odd_rows(spark, odd_docs, no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0
    given, got = odd_docs.collect(), minhash.near_duplicates(odd_docs).collect()
    assert len(given) == len(got)
    want = brute([(r.doc_id, r.text) for r in given if r.doc_id is not None], 85)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id]
        else:
            assert not r.kept or r.component_id is None
    assert minhash.keep_rows(odd_docs).columns == odd_docs.columns


def test_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute(sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), 85)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got == want


def test_densified_bins_come_from_the_set():
    for n in (1, 3, 50, 5000):
        s = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
        sig = minhash.signature(s, 384)
        assert np.isin(sig, s).all()
