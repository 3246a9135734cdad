"""Near-duplicates by one-permutation MinHash, confirmed on full shingle sets.

A text's set holds its distinct shingles of WORDS words as 64-bit hashes; fewer words make one shingle. Texts with
equal sets are one node. Each set's hashes fall into bands * ROWS bins, with as many bands as the threshold asks for, whose smallest hash is kept; an
empty bin takes the hash of the first filled one in a random order of its own (optimal densification). A
band of ROWS bins is a bucket. In a bucket only star edges are made, from one centre to the others, so a
bucket of n makes n - 1 candidates. The centre is the member that meets most others in all its buckets.

Candidates are compared on full sets: each node with its best centre; then the other star edges that would
join two components. Buckets of three or more that then still hold two components are finished exactly: their members, joined
ones too, form groups by the buckets they share, and all pairs of a group's different components are counted out on full
sets, a block of members against a block at a time. Blocks that lie in one component are not compared.

Defined cases: a null or blank text has n_shingles 0 and is linked with nothing; a null doc_id is never a
component_id, and its row is in its copies' component, or has none; rows that share a doc_id are one node;
very long texts give all their shingles, held in one task a text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import fresh, materialise, parts, running

WORDS, ROWS = 5, 8
#: The chance at most that a pair exactly at the threshold shares no band.
MISS = 2.5e-7
SEED = 20_240_601
#: Distinct words whose hashes a worker keeps.
KEPT_WORDS = 200_000
#: Characters of text that are hashed at a time.
SLICE = 1_000_000
#: Members of a block of a group, and shingles of all its members.
MEMBERS, HELD = 2048, 1_000_000
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M2
    return x ^ (x >> np.uint64(29))


class _Hashes(dict):
    """Word to place in `values`."""

    def __init__(self) -> None:
        self.values_ = np.zeros(1 << 16, np.uint64)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        if at >= len(self.values_):
            self.values_ = np.concatenate([self.values_, np.zeros_like(self.values_)])
        self.values_[at] = xxhash.xxh64_intdigest(word, SEED)
        return at


_hashes = _Hashes()


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text, its distinct shingles, sorted. Words are what ASCII white space divides, A-Z lower-cased."""
    global _hashes
    if len(_hashes) > KEPT_WORDS:
        _hashes = _Hashes()
    out, at = [], 0
    while at < len(texts):
        words, sizes, chars = [], [], 0
        while at < len(texts) and (chars < SLICE or not sizes):
            own = (texts[at] or "").encode("utf-8", "surrogatepass").lower().split()
            words.append(np.fromiter(map(_hashes.__getitem__, own), np.int64, len(own)))
            sizes.append(len(own))
            chars += len(texts[at] or "")
            at += 1
        h = _hashes.values_[np.concatenate(words)] if words else np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
            for i in range(WORDS):
                rolled = rolled * M1 + h[i : i + len(rolled)]
            rolled = _mix(rolled)
        start = 0
        for n in sizes:
            if n >= WORDS:
                out.append(np.unique(rolled[start : start + n - WORDS + 1]))
            elif n:
                out.append(np.array([xxhash.xxh64_intdigest(h[start : start + n].tobytes(), SEED + n)], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
            start += n
    return out


_orders: dict[int, np.ndarray] = {}


def _order(bins: int) -> np.ndarray:
    """For each bin, all bins in the order in which it looks for a filled one."""
    if bins not in _orders:
        draw = np.random.Generator(np.random.PCG64(SEED))
        _orders[bins] = np.argsort(draw.random((bins, bins)), axis=1).astype(np.int16)
    return _orders[bins]


def signature(shingles: np.ndarray, bins: int) -> np.ndarray:
    """The smallest hash in each bin. Bins are ranges of the hash, so in a sorted set each bin's first one is its smallest."""
    bin_ = (((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bin_[1:] != bin_[:-1]])
    sig, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    sig[bin_[first]] = shingles[first]
    filled[bin_[first]] = True
    empty, order = np.flatnonzero(~filled), _order(bins)
    for some in (slice(0, 8), slice(8, 64), slice(64, bins)):
        if not len(empty):
            break
        tried = filled[order[empty, some]]
        where = tried.argmax(axis=1)
        hit = tried[np.arange(len(empty)), where]
        sig[empty[hit]] = sig[order[empty, some][np.flatnonzero(hit), where[hit]]]
        empty = empty[~hit]
    return sig


def _signed(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    factors = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(rows)], np.uint64)
    for batch in parts(batches):
        n, hi, lo, keys = [], [], [], []
        for s in shingle_sets(batch["text"].to_pylist()):
            n.append(len(s))
            both = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
            hi.append(both[0])
            lo.append(both[1])
            if len(s):
                with np.errstate(over="ignore"):
                    band = (signature(s, bands * rows).reshape(bands, rows) * factors).sum(axis=1, dtype=np.uint64)
                    keys.append(_mix(band + np.arange(bands, dtype=np.uint64) * M1).view(np.int64))
            else:
                keys.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "hi", "lo", "bands"],
        )


def bands_for(percent: int, rows: int = ROWS) -> int:
    """Bands of so many rows that a pair at the threshold misses all of them with a chance of MISS at most: 48 of eight rows for 85 %, 83 for 80 %."""
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows)))


def sign(docs: DataFrame, bands: int, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, (hi, lo), which name the set, and the keys of its bands."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInArrow(lambda it: _signed(it, bands, rows), "doc_id long, n_shingles long, hi long, lo long, bands array<long>")


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in parts(batches, 128):
        a, texts_a, texts_b = (batch[c].to_pylist() for c in ("a", "text_a", "text_b"))
        first = {i: t for i, t in zip(a, texts_a) if i not in held}
        held = {i: held[i] for i in set(a) if i in held} | dict(zip(first, shingle_sets(list(first.values()))))
        keep = []
        for i, other in zip(a, shingle_sets(texts_b)):
            one = held[i]
            both = len(one) + len(other) - len(np.union1d(one, other))
            keep.append(100 * both >= percent * (len(one) + len(other) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], ["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets share percent of their union at least. texts: doc_id, text.

    Pairs and texts are sorted and merged at every size: that is what large tables get, and a small one then shows what they need.
    """
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(b.hint("merge"), "b").join(a.hint("merge"), "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(lambda it: _linked(it, percent), "a long, b long")


def _stars(rows: DataFrame, rank: Column, percent: int) -> DataFrame:
    """rows: key, id, n, degree. Pairs of each bucket's highest-ranked member (a) with its other members (b) whose sizes allow a link."""
    top = rows.groupBy("key").agg(F.max(F.struct(rank.alias("rank"), (-F.col("id")).alias("minus"), F.col("n").alias("an"), F.col("degree").alias("ad"))).alias("top"))
    pairs = rows.join(top, "key").select((-F.col("top.minus")).alias("a"), F.col("id").alias("b"), F.col("top.ad").alias("degree"), F.col("top.an").alias("an"), "n")
    pairs = pairs.filter((F.col("a") != F.col("b")) & (100 * F.least("an", "n") >= percent * F.greatest("an", "n")))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("degree").alias("degree"))


def _met(rows: DataFrame) -> DataFrame:
    """rows: key, id, n, of buckets with two members or more, with `degree`: how many members a row's buckets have in all."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    rows = materialise(rows.join(sizes, "key"), "buckets")
    degree = rows.groupBy("id").agg(F.sum("size").alias("degree"))
    return rows.drop("size").join(degree, "id")


def _label(df: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    named = labels.select(F.col("id").alias(column), F.col("label").alias(f"of_{column}"))
    return df.join(named, column, "left").withColumn(f"of_{column}", F.coalesce(f"of_{column}", F.col(column)))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    return _label(_label(pairs, labels, "a"), labels, "b").filter("of_a <> of_b").drop("of_a", "of_b")


def _open(met: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets that hold two components. In buckets of two, the star has compared all there is."""
    two = _label(met, labels, "id").groupBy("key").agg(F.count("*").alias("size"), F.min("of_id").alias("least"), F.max("of_id").alias("most"))
    return met.join(two.filter("size > 2 and least <> most"), "key", "left_semi")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        sets = shingle_sets(batch["text"].to_pylist())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "shingles"])


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    """A block's sets in one value: what most members have (base), and for each member where it differs, in the order of the shingles."""
    sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
    sizes = np.array([len(s) for s in sets], np.int64)
    vocab, col = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    base = np.bincount(col, minlength=len(vocab)) * 2 > len(sets)
    place = np.cumsum(base) - 1
    has = np.zeros((len(sets), int(base.sum())), bool)
    common = base[col]
    has[row[common], place[col[common]]] = True
    lost = np.nonzero(~has)
    row, col = np.r_[row[~common], lost[0]], np.r_[col[~common], np.flatnonzero(base)[lost[1]]]
    order = np.argsort(col, kind="stable")
    held = rows["id"].to_numpy(), rows["of"].to_numpy(), sizes, vocab, base, row[order].astype(np.int32), np.bincount(col, minlength=len(vocab)).astype(np.int32)
    return pd.DataFrame({"group": rows["group"][:1], "block": rows["block"][:1], "held": [pickle.dumps(held)]})


def _at(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of `counts` places from `starts` on: each place, and the run it is in."""
    run = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts), run


def shared_counts(one: tuple, other: tuple) -> np.ndarray:
    """How many shingles each member of a block shares with each of the other. Shingles of many pairs are counted by products of matrices, of few by lists."""
    sides, (_, *ats) = (one, other), np.intersect1d(one[3], other[3], assume_unique=True, return_indices=True)
    m = [len(x[0]) for x in sides]
    flips = [x[6][at].astype(np.int64) for x, at in zip(sides, ats)]
    starts = [(np.cumsum(x[6], dtype=np.int64) - x[6])[at] for x, at in zip(sides, ats)]
    base = [x[4][at] for x, at in zip(sides, ats)]
    dense = base[0] | base[1] | (flips[0] * flips[1] * 256 > m[0] * m[1])
    both = np.zeros(m, np.float32)
    wide = np.flatnonzero(dense)
    for at in range(0, len(wide), 1024):
        some, tables = wide[at : at + 1024], []
        for side in (0, 1):
            has = np.repeat(base[side][some][None, :].astype(np.float32), m[side], axis=0)
            place, run = _at(starts[side][some], flips[side][some])
            has[sides[side][5][place], run] = 1 - base[side][some][run]
            tables.append(has)
        both += tables[0] @ tables[1].T
    thin = np.flatnonzero(~dense)
    pairs = flips[0][thin] * flips[1][thin]
    cuts = np.flatnonzero(np.diff(np.cumsum(pairs) // 1_000_000)) + 1
    for some in np.split(thin, cuts):
        if len(some):
            place, run = _at(np.zeros(len(some), np.int64), flips[0][some] * flips[1][some])
            i, j = np.divmod(place, flips[1][some][run])
            at = sides[0][5][starts[0][some][run] + i].astype(np.int64) * m[1] + sides[1][5][starts[1][some][run] + j]
            both += np.bincount(at, minlength=m[0] * m[1]).reshape(m)
    return both


def _joins(one: tuple, other: tuple, percent: int) -> list[tuple[int, int]]:
    """Linked members of two blocks, as many as join the components that the blocks' links join."""
    both = shared_counts(one, other).astype(np.float64)
    linked = (both > 0) & ((100 + percent) * both >= percent * (one[2][:, None] + other[2][None, :])) & (one[1][:, None] != other[1][None, :])
    names, at = np.unique(np.r_[one[1], other[1]], return_inverse=True)
    of_one, of_other, now, out = at[: len(one[0])], at[len(one[0]) :], np.arange(len(names)), []
    for i in np.flatnonzero(linked.any(axis=1)):
        to = np.flatnonzero(linked[i])
        new, first = np.unique(now[of_other[to]], return_index=True)
        mine = now[of_one[i]]
        out += [(int(one[0][i]), int(other[0][to[f]])) for n, f in zip(new, first) if n != mine]
        now[np.isin(now, new)] = mine
    return out


def _compared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, 1):
        found = _joins(pickle.loads(batch["one"][0].as_py()), pickle.loads(batch["other"][0].as_py()), percent)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def finish(rows: DataFrame, labels: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """rows: key, id, n, of open buckets. texts: doc_id, text of all bucket members. Links (a, b) that join all components of which two members in one bucket are linked."""
    first = rows.groupBy("key").agg(F.min("id").alias("b"))
    groups = components(rows.join(first, "key").select(F.col("id").alias("a"), "b")).select("id", F.col("label").alias("group"))
    sized = _label(rows.groupBy("id").agg(F.max("n").alias("n")).join(groups, "id"), labels, "id").withColumnRenamed("of_id", "of")
    placed = running(sized, [F.col("of").asc(), F.col("id").asc()], {"n": "upto"}, ["group"])
    block = F.floor(F.col("place") / MEMBERS) + F.floor((F.col("upto") + F.col("n")) / HELD)
    members = materialise(placed.withColumn("block", block).drop("n", "place", "upto"), "members")
    blocks = members.groupBy("group", "block").agg(F.min("of").alias("least"), F.max("of").alias("most"))
    i, j = (blocks.select("group", *[F.col(c).alias(f"{c}_{k}") for c in ("block", "least", "most")]) for k in (1, 2))
    pairs = i.join(j, "group").filter("block_1 <= block_2 and not (least_1 = most_1 and least_2 = most_2 and least_1 = least_2)").select("group", "block_1", "block_2")
    pairs = materialise(pairs, "pairs")
    used = pairs.select("group", F.explode(F.array("block_1", "block_2")).alias("block")).distinct()
    wanted = members.join(used, ["group", "block"], "left_semi")
    given = texts.join(wanted.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    sets = given.mapInArrow(_sets, "id long, shingles binary").filter(F.length("shingles") > 0).distinct()
    held = materialise(wanted.join(sets, "id").groupBy("group", "block").applyInPandas(_block, "group long, block long, held binary"), "blocks")
    one, other = (held.select("group", F.col("block").alias(f"block_{k}"), F.col("held").alias(c)) for k, c in ((1, "one"), (2, "other")))
    joined = pairs.join(one, ["group", "block_1"]).join(other, ["group", "block_2"]).select("one", "other")
    return joined.mapInArrow(lambda it: _compared(it, percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    signed = materialise(sign(docs, bands_for(percent)), "signed")
    same = ["hi", "lo", "n_shingles"]
    nodes = signed.filter("n_shingles > 0").groupBy(*same).agg(F.min_by(F.struct("doc_id", "bands"), F.coalesce("doc_id", F.lit(2**63 - 1))).alias("one"))
    nodes = materialise(nodes.select(*same, F.col("one.doc_id").alias("id"), F.col("one.bands").alias("bands")), "nodes")
    linkable = nodes.filter("id is not null")
    buckets = linkable.select(F.explode("bands").alias("key"), "id", F.col("n_shingles").alias("n"))
    met = materialise(_met(buckets), "met")
    stars = materialise(_stars(met, F.col("degree"), percent), "stars")
    ids = met.select(F.col("id").alias("doc_id")).distinct()
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = materialise(given.join(ids.hint("merge"), "doc_id", "left_semi"), "texts")

    best = stars.groupBy("b").agg(F.max(F.struct("degree", "shared", (-F.col("a")).alias("minus"))).alias("top")).select((-F.col("top.minus")).alias("a"), "b")
    labels = materialise(components(materialise(confirm(best, texts, percent), "links")), "labels")

    def more(found: DataFrame) -> None:
        nonlocal labels
        found = materialise(found, "links")
        if not found.isEmpty():
            labels = materialise(components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(found)), "labels")

    more(confirm(_apart(stars, labels), texts, percent))
    left = materialise(_open(met, labels), "open")
    if not left.isEmpty():
        more(finish(left, labels, texts, percent))

    named = nodes.join(labels.withColumnRenamed("id", "node"), F.col("id") == F.col("node"), "left").select(*same, F.coalesce("label", "id").alias("component_id"))
    out = signed.drop("bands").join(named, same, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"))


def keep_rows(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, one document of each component, with the columns of docs.

    Rows that share a doc_id are one document. Rows without a doc_id cannot be told apart, and all stay.
    """
    found = materialise(near_duplicates(docs, percent), "found")
    id_, only = fresh("id", docs.columns), fresh("only", docs.columns)
    gone = found.filter("not kept and doc_id is not null").select(F.col("doc_id").alias(id_)).distinct()
    repeated = not found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty()
    rows = docs.withColumn(id_, F.col("doc_id").cast("long")).join(gone, id_, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    if not repeated:
        return rows
    text = F.when(F.col("doc_id").isNull(), F.struct(F.monotonically_increasing_id(), F.sha2(F.coalesce("text", F.lit("")), 256)))
    return rows.withColumn(only, text).dropDuplicates(["doc_id", only]).drop(only)
