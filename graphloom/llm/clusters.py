"""Clustering around centroids in whole numbers: the rounds of Lloyd's method, exactly.

Components are scaled and rounded down to integers, and vectors packed into blocks. A
block's squared distances to all centroids are |x|^2 - 2 x.c + |c|^2, where x.c is one
product of float64 matrices. With components of at most a and b, no sum on the way is beyond
dim * (a + b)^2; while that is below 2**53, each is a whole number that doubles hold
exactly, in any order of summing. Blocks beyond that bound take differences in 64-bit
integers, or in Python's integers where these could overflow. So do the sums of a cluster's
vectors, which are a product with the matrix of members where n * a is below 2**53.

A round reads the packed blocks, and ``treeAggregate`` adds each cluster's sums, count and
distances: k * dim numbers from a task, whatever the input. The driver holds the k
centroids only.

Vectors that are null, of another length, or hold null or non-finite components take no
part. Null ids take part, but never as first centroids. Repeated rows are vectors each; of
equal hashes the smaller vector comes first. With fewer than k vectors there are fewer
clusters; an empty table gives an empty result. Components whose scaled value overflows a
double are scaled as whole numbers; distances beyond a long are shown as its largest value.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import sliced, written

SCALE, DIM, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Bytes that a block's vectors take as doubles at most.
BLOCK_BYTES = 4 << 20
EXACT = 1 << 53
_LONG = (1 << 63) - 1
_BLOCK = "ids array<bigint>, kind string, vecs binary"
_OUT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def scaled(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles, as doubles where these are whole, else as Python's integers."""
    with np.errstate(over="ignore"):
        v = np.floor(scale * x)
    if np.isfinite(v).all():
        return v
    return np.array([[math.floor(c) * scale if abs(c) >= EXACT else math.floor(scale * c) for c in row] for row in x.tolist()], object)


def _bound(x: np.ndarray) -> int:
    return max((abs(int(c)) for c in (x.max(initial=0), x.min(initial=0))), default=0)


def _packed(v: np.ndarray) -> tuple[str, bytes]:
    """A block of whole numbers in as few bytes as they need."""
    most = _bound(v)
    for kind, bits in (("<i1", 7), ("<i2", 15), ("<i4", 31), ("<i8", 63)):
        if most < 1 << bits:
            return kind, v.astype(kind).tobytes()
    return "text", " ".join(str(int(c)) for c in v.ravel()).encode()


def _unpacked(kind: str, data: bytes, dim: int) -> np.ndarray:
    if kind == "text":
        return np.array([int(c) for c in bytes(data).split()], object).reshape(-1, dim)
    return np.frombuffer(data, kind).reshape(-1, dim)


def distances(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances of rows to centroids, exact: doubles of whole numbers, or integers."""
    dim, most = x.shape[1], max(map(abs, sum(centroids, [])), default=0)
    reach = dim * (_bound(x) + most) ** 2
    if reach < EXACT:
        v, c = x.astype(np.float64), np.array(centroids, np.float64)
        return (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)
    kind = np.int64 if reach < 1 << 63 else object
    v = x.astype(kind)
    return np.stack([((v - np.array(c, kind)) ** 2).sum(axis=1) for c in centroids], axis=1)


def _sums(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Each cluster's componentwise sums as Python's integers."""
    if len(x) * _bound(x) < EXACT:
        members = np.zeros((k, len(x)))
        members[cluster, np.arange(len(x))] = 1
        return (members @ x.astype(np.float64)).astype(np.int64).astype(object)
    v = x.astype(object)
    return np.stack([v[cluster == c].sum(axis=0) if (cluster == c).any() else np.zeros(x.shape[1], object) for c in range(k)])


def packed(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """The usable vectors as blocks of scaled whole numbers."""
    size = max(1, BLOCK_BYTES // (8 * dim))

    def pack(batches):
        for batch in batches:
            for part in sliced([batch], size):
                lists = part.column(1)
                lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is a NaN
                rows = np.flatnonzero(lengths == dim)
                x = flat[(np.cumsum(lengths) - lengths)[rows][:, None] + np.arange(dim)]
                good = np.isfinite(x).all(axis=1)
                if good.any():
                    kind, data = _packed(scaled(x[good], scale))
                    ids = part.column(0).take(pa.array(rows[good])).to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([kind]), pa.array([data], pa.binary())], names=["ids", "kind", "vecs"])

    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(pack, _BLOCK)


def first_centroids(blocks: DataFrame, dim: int = DIM, k: int = CENTROIDS) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of ``1:<vec_id>``, in that order."""

    def smallest(found, block):
        ids, x = block["ids"], None
        for n, i in enumerate(ids):
            if i is not None:
                name = hashlib.sha256(f"1:{i}".encode()).hexdigest()
                if len(found) < k or name <= found[-1][0]:
                    x = _unpacked(block["kind"], block["vecs"], dim) if x is None else x
                    found = sorted([*found, (name, [int(c) for c in x[n]])])[:k]
        return found

    return [x for _, x in blocks.rdd.treeAggregate([], smallest, lambda a, b: sorted(a + b)[:k])]


def summed(blocks: DataFrame, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, counts, inertias) of the clusters of all vectors, each at its nearest centroid."""
    k, dim = len(centroids), len(centroids[0])

    def add(a, block):
        x = _unpacked(block["kind"], block["vecs"], dim)
        d = distances(x, centroids)
        cluster = d.argmin(axis=1)  # the first of equal ones
        nearest = d[np.arange(len(x)), cluster]
        inertia = np.zeros(k, object)
        for c in np.unique(cluster).tolist():
            inertia[c] = sum(map(int, nearest[cluster == c].tolist()))
        return a[0] + _sums(x, cluster, k), a[1] + np.bincount(cluster, minlength=k).astype(object), a[2] + inertia

    zero = np.zeros((k, dim), object), np.zeros(k, object), np.zeros(k, object)
    return blocks.rdd.treeAggregate(zero, add, lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True)))


def moved(centroids: list[list[int]], sums: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    """The mean of each cluster, rounded down; centroids without vectors stay."""
    return [[int(s) // int(n) for s in row] if n else c for c, row, n in zip(centroids, sums, counts, strict=True)]


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) after ``rounds`` rounds and a last assignment."""
    blocks = written(packed(vectors, dim, scale), "clusters")
    centroids = first_centroids(blocks, dim, k)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], _OUT)
    for _ in range(rounds):
        sums, counts, _ = summed(blocks, centroids)
        centroids = moved(centroids, sums, counts)
    inertias = summed(blocks, centroids)[2].tolist()
    shown, total = [min(i, _LONG) for i in inertias], min(sum(inertias), _LONG)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def assign(batches):
        for batch in sliced(batches, 1):
            ids, kind, data = (batch.column(c)[0].as_py() for c in range(3))
            d = distances(_unpacked(kind, data, dim), centroids)
            at = d.argmin(axis=1)
            nearest = [min(int(x), _LONG) for x in d[np.arange(len(ids)), at].tolist()]
            pick = lambda values, t: pa.array(values, t).take(pa.array(at))
            columns = [pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(nearest, pa.int64()), pick(shown, pa.int64()), pa.array([total] * len(ids), pa.int64()), pick(names, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _OUT.split(", ")])

    return blocks.mapInArrow(assign, _OUT)


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    parts = [
        f"""v as materialized (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::hugeint) as v from embeddings
  where len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as materialized (
  select (row_number() over (order by sha256('1:' || vec_id), v) - 1)::int as cluster, v as c from v where vec_id is not null qualify cluster < {k}
)"""
    ]
    for n in range(rounds + 1):
        parts.append(f"""d{n} as materialized (
  select row, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance from v, c{n}
  qualify row_number() over (partition by row order by distance, cluster) = 1
)""")
        if n < rounds:
            parts.append(f"""s{n} as materialized (
  select cluster, i, floor(sum(x)::double / count(*))::hugeint as x
  from (select cluster, unnest(v) as x, generate_subscripts(v, 1) as i from d{n}) group by cluster, i
), c{n + 1} as materialized (
  select cluster, coalesce(m, c) as c from c{n} left join (select cluster, list(x order by i) as m from s{n} group by cluster) using (cluster)
)""")
    return f"""with {", ".join(parts)}
select vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia,
  sha256(array_to_string(c, ',')) as centroid_sha256
from d{rounds} join c{rounds} using (cluster)"""


#: The same rounds in DuckDB's SQL; its means are exact while sums are below 2**53.
SQL = _sql()
