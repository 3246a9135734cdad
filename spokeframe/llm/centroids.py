"""Clusters of vectors around centroids, by partial-distance search on integers.

Vectors become integers, so distances, sums and centroids are exact and the same whatever the partitioning. A task
compares each vector with one centroid whole, then with the others over a few dimensions at a time, those of greatest variance first.
A centroid is abandoned once its sum is strictly above the best found; survivors finish all dimensions. Of equal
distances the smaller number wins. A round sends its sums only: cluster, dimension and part of a number a row.

Defined cases: vectors of other lengths, null ones and those with a null, NaN or infinite component are left out; repeated
and equal vectors count each; vectors that tie for a first centroid, as with one id or none (hashed as no digits), go by their components;
fewer vectors than centroids make as many centroids as there are vectors; an empty table gives an empty result; columns other than vec_id and
embedding are not read. Components beyond 2**27 as integers are counted in Python's integers; a distance or inertia that no long holds is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Dimensions that are added between two comparisons.
STEP = 8
#: Largest size of a component for which 64 squared differences fit into 64 bits.
SAFE = 1 << 27
#: Bits of a part of a number, of which sums over 2**23 tasks fit into a long.
BITS = 40
SUMS = "cluster int, dim int, part int, value long"


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def whole_vectors(rows: DataFrame, dims: int) -> DataFrame:
    """vec_id, vector: the rows whose embedding has so many finite components, as doubles."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rows.filter((F.size("vector") == dims) & F.forall("vector", _finite))


def _integers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component; Python's integers where some are beyond SAFE."""
    scaled = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    with np.errstate(over="ignore"):
        found = np.floor(scaled * scale)
    if not len(found) or np.abs(found).max() <= SAFE:
        return found.astype(np.int64)
    exact = [(lambda n, d: n * scale // d)(*x.as_integer_ratio()) for x in scaled.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(-1, dims)


def nearest(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each vector, and the squared distance."""
    ahead, others = vectors[:, order], centroids[:, order]
    firsts = np.stack([((ahead[:, :STEP] - c[:STEP]) ** 2).sum(1) for c in others], 1)
    best = firsts.argmin(1)  # where to begin; by the first dimensions, most likely the nearest
    least = ((ahead - others[best]) ** 2).sum(1)
    start = best.copy()
    for number, c in enumerate(others):
        total = firsts[:, number]
        left = np.flatnonzero((total <= least) & (start != number))
        total = total[left]
        for at in range(STEP, len(order), STEP):
            total = total + ((ahead[left, at : at + STEP] - c[at : at + STEP]) ** 2).sum(1)
            stays = total <= least[left]
            left, total = left[stays], total[stays]
        wins = (total < least[left]) | (number < best[left])
        least[left[wins]], best[left[wins]] = total[wins], number
    return best, least


def _parts(cluster: int, dim: int, value: int) -> Iterator[tuple[int, int, int, int]]:
    """A number as parts of BITS bits, of which the last has the sign; so sums of parts never overflow."""
    part = 0
    while not -(1 << BITS) < value < 1 << BITS:
        yield cluster, dim, part, value & ((1 << BITS) - 1)
        value, part = value >> BITS, part + 1
    yield cluster, dim, part, value


def _rows(sums: list[tuple[int, int, int]]) -> pa.RecordBatch:
    found = [row for s in sums if s[2] for row in _parts(*s)]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)], ["cluster", "dim", "part", "value"])


def _add_up(sums: DataFrame) -> dict[tuple[int, int], int]:
    """The numbers by cluster and dimension: a few thousand rows at most."""
    rows = sums.groupBy("cluster", "dim", "part").agg(F.sum("value").alias("value")).collect()
    out: dict[tuple[int, int], int] = {}
    for r in rows:
        out[r["cluster"], r["dim"]] = out.get((r["cluster"], r["dim"]), 0) + (r["value"] << (BITS * r["part"]))
    return out


def _spread(vectors: DataFrame, dims: int, scale: int) -> np.ndarray:
    """The dimensions, of greatest variance first; of equal ones, the first first."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, squares = 0, np.zeros(dims, object), np.zeros(dims, object)
        for batch in batches:
            x = _integers(batch["vector"], dims, scale)
            if len(x) and x.dtype != object and np.abs(x).max() >= 1 << 20:  # sums of squares may leave 64 bits
                x = x.astype(object)
            count, total, squares = count + len(x), total + x.sum(0), squares + (x**2).sum(0)
        yield _rows([(0, dims, count), *((0, d, int(v)) for d, v in enumerate(total)), *((1, d, int(v)) for d, v in enumerate(squares))])

    sums = _add_up(vectors.select("vector").mapInArrow(added, SUMS))
    n = sums.get((0, dims), 0)
    variance = [n * sums.get((1, d), 0) - sums.get((0, d), 0) ** 2 for d in range(dims)]
    return np.array(sorted(range(dims), key=lambda d: (-variance[d], d)))


def _next(vectors: DataFrame, centroids: list[list[int]], order: np.ndarray, scale: int) -> list[list[int]]:
    """The floors of the means of each centroid's vectors; one without vectors stays."""
    dims = len(order)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _matrix(centroids)
        counts, totals = np.zeros(len(known), object), np.zeros((len(known), dims), object)
        for batch in batches:
            x = _integers(batch["vector"], dims, scale)
            best, _ = nearest(*_alike(x, known), order)
            for number in np.unique(best).tolist():
                own = x[best == number]
                counts[number] += len(own)
                totals[number] += own.sum(0)
        yield _rows([(k, d, int(v)) for k in range(len(known)) for d, v in enumerate([*totals[k], counts[k]])])

    sums = _add_up(vectors.select("vector").mapInArrow(added, SUMS))
    return [[sums.get((k, d), 0) // sums[k, dims] for d in range(dims)] if (k, dims) in sums else old for k, old in enumerate(centroids)]


def _matrix(centroids: list[list[int]]) -> np.ndarray:
    return np.array(centroids, np.int64 if all(abs(x) <= SAFE for c in centroids for x in c) else object)


def _alike(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as Python's integers where one has them."""
    big = object in (vectors.dtype, centroids.dtype)
    return (vectors.astype(object), centroids.astype(object)) if big else (vectors, centroids)


def train(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024) -> tuple[list[list[int]], np.ndarray]:
    """The centroids after so many rounds over whole vectors, and the order of dimensions. k vectors come to the driver."""
    named = vectors.select("vector", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("name"))
    first = named.orderBy("name", "vector").limit(k).collect()
    centroids = [_integers(pa.array([r["vector"]], pa.list_(pa.float64())), dims, scale)[0].tolist() for r in first]
    order = _spread(vectors, dims, scale)
    for _ in range(rounds if centroids else 0):
        centroids = _next(vectors, centroids, order, scale)
    return centroids, order


def assign(vectors: DataFrame, centroids: list[list[int]], order: np.ndarray, scale: int = 1024) -> DataFrame:
    """vec_id, cluster, distance of every vector."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _matrix(centroids)
        for batch in batches:
            best, least = nearest(*_alike(_integers(batch["vector"], len(order), scale), known), order)
            long = pa.array([x if x < 1 << 63 else None for x in least.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(best.astype(np.int32)), long], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(found, "vec_id long, cluster int, distance long")


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every whole vector."""
    vectors = materialise(whole_vectors(rows, dims), "vectors")
    centroids, order = train(vectors, k, rounds, seed, dims, scale)
    if not centroids:
        return vectors.select("vec_id", *[F.lit(None).cast(kind).alias(name) for name, kind in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    found = materialise(assign(vectors, centroids, order, scale), "assigned")
    # A sum with a distance that no long holds is null as a whole.
    held = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("held"), F.count_if(F.col("distance").isNull()).alias("beyond")).collect()
    total = None if any(r["beyond"] for r in held) else sum(int(r["held"]) for r in held)
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    of = {r["cluster"]: None if r["beyond"] else int(r["held"]) for r in held}
    each = [(i, fits(of.get(i)), fits(total), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    told = rows.sparkSession.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024) -> str:
    """All distances of each round in full, on 128-bit integers."""
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({scale}e0 * CAST(x AS DOUBLE)) AS HUGEINT) FOR x IN embedding] AS x FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS c, x AS m FROM v QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(v.x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, CAST({distance} AS HUGEINT) AS d FROM v, c{i}) GROUP BY r)")
        if i < rounds:
            steps.append(
                f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(n.m, c{i}.m) AS m FROM c{i} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS HUGEINT) ORDER BY j) AS m FROM (SELECT c, j, sum(x) AS s, CAST(count(*) AS HUGEINT) AS n"
                f" FROM (SELECT a{i}.c, unnest(v.x) AS x, unnest(range({dims})) AS j FROM v JOIN a{i} USING (r)) GROUP BY c, j) GROUP BY c) n ON n.c = c{i}.c)"
            )
    last = rounds
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{last} a JOIN v USING (r) JOIN c{last} c ON c.c = a.c"""


ORACLE_SQL = _oracle()
