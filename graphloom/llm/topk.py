"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors are cut into segments; of each segment the mean and the deviation (the norm
of what the mean leaves) are kept. For vectors q, c with segments of length L,

    |q - c|^2 >= sum over segments of L (mean_q - mean_c)^2 + (dev_q - dev_c)^2,

and as q.c = (|q|^2 + |c|^2 - |q - c|^2) / 2, a lower bound of the distance is an upper
bound of the inner product. Bounds are taken with one segment, then 4, then 16.

Rows are ordered by the means of their segments and packed into blocks. A block's
queries first meet the block itself, which gives each a score that its results must
reach. Then only envelopes move: the ranges of a block's means and deviations bound, from
coarse to fine, what a query can find in it, and a pair of blocks goes on if some query
can reach its score there. The vectors of such pairs meet in units of many blocks, so
that each block moves once for many query blocks; vectors are bounded from coarse to
fine, until a level leaves out almost none, and survivors get their exact integer score.

Vectors that are null, empty, or hold null or non-finite components take no part, as do
null ids; components that overflow a double when they are scaled count as non-finite.
Vectors of different lengths don't meet. Components may be of any other size: where
doubles could round a score, it is made with whole numbers; scores beyond a long are its
ends. Repeated rows are candidates each, and one query; query rows of one id with
different vectors are ranked together. Ties go to the smaller id. With less than k
candidates all are returned. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import sliced, written

SCALE = 64
LEVELS = (1, 4, 16)
#: Rows of a block at most, and at least if there are as many.
BLOCK, LEAST_BLOCK = 8192, 256
#: Blocks on each side of a unit at most, and envelopes that are looked at together.
UNIT, ENVELOPES = 64, 4096
#: Larger components are packed apart, as scores with them may not be exact in doubles.
LARGEST = 1 << 20
#: A level of bounds is followed by a finer one if it leaves out at least this share.
USEFUL = 0.05
_LONG = (-(1 << 63), (1 << 63) - 1)
_ROW = "vec_id bigint, dim int, key bigint, kind string, vec binary"
_BLOCK = (
    "dim int, block bigint, kind string, ids binary, vecs binary, envelope binary, largest double, "
    "query_ids binary, query_vecs binary, least binary, found_query array<bigint>, found_id array<bigint>, found_score array<bigint>"
)
_FOUND = "query_id bigint, vec_id bigint, score bigint"


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row, the means and deviations of its segments, scaled so that the bound is a plain product."""
    n, d = x.shape
    cuts = np.linspace(0, d, min(segments, d) + 1).astype(int)
    lengths = np.diff(cuts)
    sums = np.add.reduceat(x, cuts[:-1], axis=1)
    squares = np.add.reduceat(x * x, cuts[:-1], axis=1)
    deviations = np.sqrt(np.maximum(0, squares - sums * sums / lengths))
    return np.hstack([sums / np.sqrt(lengths), deviations])


def envelope(x: np.ndarray, levels=LEVELS) -> np.ndarray:
    """For each level: the least and the largest means of a block's segments, and the largest deviations."""
    out = []
    for m in levels:
        means, deviations = np.hsplit(statistics(x, m), 2)
        out += [means.min(axis=0), means.max(axis=0), deviations.max(axis=0)]
    return np.concatenate(out)


def _error(q: np.ndarray, largest: float) -> np.ndarray:
    """What rounding can do to products of each row with vectors whose components are at most ``largest``."""
    with np.errstate(over="ignore"):
        return 1e-13 * q.shape[1] * np.abs(q).sum(axis=1) * largest


def reachable(q: np.ndarray, least: np.ndarray, envelopes: np.ndarray, largest: np.ndarray, levels=LEVELS) -> np.ndarray:
    """Which of the blocks, a row of ``envelopes`` each, may hold a vector that gives some query its least score."""
    alive, at = np.ones((len(q), len(envelopes)), bool), 0
    for m in levels:
        means, deviations = np.hsplit(statistics(q, m), 2)
        low, high, most = (envelopes[:, at + k * means.shape[1] : at + (k + 1) * means.shape[1]] for k in range(3))
        at += 3 * means.shape[1]
        some = np.flatnonzero(alive.any(axis=0))
        bound = np.maximum(means, 0) @ high[some].T + np.minimum(means, 0) @ low[some].T + deviations @ most[some].T
        slack = _error(q, 1.0)[:, None] * largest[some] + 1e-6
        alive[:, some] &= ~(bound < least[:, None] - slack)
    return alive.any(axis=0)


def _exact(q: np.ndarray, c: np.ndarray) -> list[int]:
    """Inner products of rows by whole numbers, at most a long's ends."""
    return [min(max(sum(int(x) * int(y) for x, y in zip(a, b, strict=True)), _LONG[0]), _LONG[1]) for a, b in zip(q.tolist(), c.tolist(), strict=True)]


class Best:
    """The k best candidates that some queries have met, and the score that each query's next ones must reach."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None, levels=LEVELS):
        self.q, self.ids, self.k, self.levels = queries, ids, k, levels
        self.least = np.full(len(ids), -np.inf) if least is None else least.copy()
        self.of_q = [statistics(queries, m) for m in levels]
        self.largest = float(np.abs(queries).max(initial=0))
        self.found = (np.empty(0, np.int64),) * 3  # query row, candidate id, score

    def meet(self, c: np.ndarray, ids: np.ndarray) -> None:
        """Looks at a block of candidates: bounds from coarse to fine, then exact scores of what is left."""
        rows, cols = np.arange(len(self.q)), np.arange(len(c))
        most = float(np.abs(c).max(initial=0))
        slack = _error(self.q, most) + 1e-6
        mask = np.ones((len(rows), len(cols)), bool)
        for of_q, m in zip(self.of_q, self.levels, strict=True):
            if not np.isfinite(self.least).any() or not len(cols):
                break
            bound = of_q[rows] @ statistics(c[cols], m).T
            before = mask.sum()
            mask &= ~(bound < (self.least - slack)[rows, None])
            after = mask.sum()
            some, left = mask.any(axis=1), mask.any(axis=0)
            rows, cols, mask = rows[some], cols[left], mask[np.ix_(some, left)]
            if after > (1 - USEFUL) * before:
                break
        if not len(rows) or not len(cols):
            return
        exact = self.largest * most * self.q.shape[1] < 1 << 53
        error = np.zeros(len(rows)) if exact else 2 * slack[rows]
        with np.errstate(over="ignore", invalid="ignore"):
            scores = self.q[rows] @ c[cols].T
        mask &= self.ids[rows, None] != ids[cols]
        scores[~mask] = -np.inf
        least = self.least[rows]
        if len(cols) >= self.k and not np.isfinite(least).all() and not np.isnan(scores).any():
            least = np.maximum(least, np.partition(scores, len(cols) - self.k, axis=1)[:, len(cols) - self.k] - error)
        i, j = np.nonzero(mask & ~(scores < (least - error)[:, None]))
        score = np.rint(scores[i, j]).astype(np.int64) if exact else np.array(_exact(self.q[rows[i]], c[cols[j]]), np.int64)
        who, whom, score = (np.concatenate([a, b]) for a, b in zip(self.found, (rows[i], ids[cols[j]], score), strict=True))
        order = np.lexsort((whom, ~score, who))  # ~score: falling, and no long overflows
        who = who[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        keep = order[place < self.k]
        self.found = who[place < self.k], whom[keep], score[keep]
        last = place == self.k - 1
        self.least[who[last]] = np.maximum(self.least[who[last]], score[order[last]].astype(np.float64))


def _kind(largest: float) -> str:
    return "<i1" if largest < 1 << 7 else "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<f8"


def _key(v: np.ndarray) -> np.ndarray:
    """A place on a curve through the means of four segments, in units of the vector's length; large ones come last."""
    means = statistics(v, 4)[:, : min(4, v.shape[1])]
    with np.errstate(over="ignore", invalid="ignore"):
        part = np.nan_to_num(means / np.maximum(1.0, np.sqrt((v * v).sum(axis=1)))[:, None])
    steps = np.clip((part + 1) * 128, 0, 255).astype(np.int64)
    key = (np.abs(v).max(axis=1) > LARGEST).astype(np.int64) << 40
    for bit in range(8):
        for s in range(steps.shape[1]):
            key |= ((steps[:, s] >> bit) & 1) << (4 * bit + s)
    return key


def _vectors(data: bytes, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, dim).astype(np.float64)


def packed(vectors: DataFrame) -> DataFrame:
    """Every usable row with its scaled vector in as few bytes as it needs, and its place in the order."""

    def pack(batches):
        for batch in sliced(batches, 4096):
            lists = batch.column(1)
            lengths = lists.value_lengths().to_numpy()
            flat, starts = lists.flatten().to_numpy(), np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dim)
                v = np.floor(SCALE * flat[starts[rows][:, None] + np.arange(dim)])
                kinds = [_kind(x) for x in np.abs(v).max(axis=1).tolist()]
                data = [x.astype(t).tobytes() for x, t in zip(v, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array([dim] * len(rows), pa.int32()), pa.array(_key(v)), pa.array(kinds), pa.array(data, pa.binary())],
                    names=["vec_id", "dim", "key", "kind", "vec"],
                )

    usable = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(
        f"vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs({SCALE} * x) < double('infinity'))"
    )
    return usable.mapInArrow(pack, _ROW)


def blocks(rows: DataFrame, n_rows: int, every: int, k: int, block: int | None = None) -> DataFrame:
    """Blocks of rows that are near in the order, with their queries and what these find in their own block."""
    size = block or min(BLOCK, max(LEAST_BLOCK, -(-n_rows // 128)))

    def build(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        last = None  # a query row that is repeated comes right after itself

        def made(rows: list[tuple]):
            nonlocal number, last
            dim, ids = rows[0][1], np.array([r[0] for r in rows], np.int64)
            v = np.concatenate([_vectors(r[4], r[3], dim) for r in rows])
            asks = np.zeros(len(rows), bool)
            for n, r in enumerate(rows):
                if r[0] % every == 0:
                    asks[n] = (r[0], r[3], r[4]) != last
                    last = (r[0], r[3], r[4])
            kind = _kind(np.abs(v).max())
            best = Best(v[asks], ids[asks], k)
            if asks.any():
                best.meet(v, ids)
            who, whom, score = best.found
            number += 1
            values = (
                dim, number, kind, ids.astype("<i8").tobytes(), v.astype(kind).tobytes(), envelope(v).tobytes(), float(np.abs(v).max()),
                ids[asks].astype("<i8").tobytes(), v[asks].astype(kind).tobytes(), best.least.tobytes(), best.ids[who].tolist(), whom.tolist(), score.tolist(),
            )
            schema = [pa.int32(), pa.int64(), pa.string(), *[pa.binary()] * 3, pa.float64(), *[pa.binary()] * 3, *[pa.list_(pa.int64())] * 3]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, schema, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) == size or held[0][1] != row[1] or (held[0][2] >> 40) != (row[2] >> 40)):
                    yield made(held)
                    held = []
                held.append(row)
        if held:
            yield made(held)

    order = ["dim", "key", "vec_id", "vec"]
    return rows.repartitionByRange(max(1, n_rows // (4 * size)), *order[:3]).sortWithinPartitions(*order).mapInArrow(build, _BLOCK)


def pairs(known: DataFrame, group: int) -> DataFrame:
    """(query_block, block) for the pairs of different blocks in which a query may reach its least score."""

    def survive(asking: pa.Table, envelopes: pa.Table) -> pa.Table:
        first, second = [], []
        if len(asking) and len(envelopes):
            bounds = np.stack([np.frombuffer(x, np.float64) for x in envelopes["envelope"].to_pylist()])
            names, largest = envelopes["block"].to_numpy(), envelopes["largest"].to_numpy()
            for r in asking.to_pylist():
                found = names[reachable(_vectors(r["query_vecs"], r["kind"], r["dim"]), np.frombuffer(r["least"], np.float64), bounds, largest)]
                found = found[found != r["block"]]
                first.append(np.full(len(found), r["block"]))
                second.append(found)
        return pa.table({"query_block": pa.array(np.concatenate([*first, np.empty(0)]).astype(np.int64)), "block": pa.array(np.concatenate([*second, np.empty(0)]).astype(np.int64))})

    asking = known.filter("length(query_ids) > 0").select("dim", "block", "kind", "query_vecs", "least", F.floor(F.col("number") / group).alias("g"))
    shown = known.select("dim", "block", "envelope", "largest", F.floor(F.col("number") / ENVELOPES).alias("chunk"))
    # a row for each group of query blocks and each chunk of envelopes of one length
    chunks = shown.select("dim", "chunk").distinct()
    groups = asking.select("dim", "g").distinct()
    keys = ["dim", "g", "chunk"]
    return _side(asking.join(chunks, "dim"), keys).cogroup(_side(shown.join(groups, "dim"), keys)).applyInArrow(survive, "query_block bigint, block bigint")


def _side(df: DataFrame, keys: list[str]):
    """A side of a cogroup whose columns aren't those of the other side."""
    return df.toDF(*df.columns).groupBy(*keys)


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, block: int | None = None) -> DataFrame:
    """For each row with an id divisible by ``every``, its k best other rows: query_id, rank, vec_id, score."""
    rows = written(packed(vectors), "topk-rows")
    made = written(blocks(rows, rows.count(), every, k, block), "topk-blocks")
    # a row for each block, of thousands of vectors; only their names are numbered
    number = (F.row_number().over(Window.orderBy("dim", "block")) - 1).alias("number")
    named = written(made.select("block", number), "topk-numbers")
    counts = made.agg(F.count("*").alias("blocks"), F.count_if(F.length("query_ids") > 0).alias("asking")).first()
    group, unit = (max(1, min(UNIT, counts[n] // 16)) for n in ("asking", "blocks"))
    met = written(pairs(made.join(named, "block"), group), "topk-pairs")
    numbers = named.select("block", F.floor(F.col("number") / group).alias("g"), F.floor(F.col("number") / unit).alias("u"))
    of_query, of_block = numbers.select(F.col("block").alias("query_block"), "g"), numbers.select("block", "u")
    placed = met.join(of_query, "query_block").join(of_block, "block")

    def compare(asking: pa.Table, given: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64),) * 3]
        if len(asking) and len(given):
            others = [(r["block"], _vectors(r["vecs"], r["kind"], r["dim"]), np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["envelope"], np.float64)[None], np.array([r["largest"]])) for r in given.to_pylist()]
            for r in asking.to_pylist():
                best = Best(_vectors(r["query_vecs"], r["kind"], r["dim"]), np.frombuffer(r["query_ids"], "<i8"), k, np.frombuffer(r["least"], np.float64))
                for name, v, ids, bounds, largest in others:
                    if name != r["block"] and reachable(best.q, best.least, bounds, largest).any():
                        best.meet(v, ids)
                who, whom, score = best.found
                out.append((best.ids[who], whom, score))
        return pa.table({c: pa.array(np.concatenate(x)) for c, x in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})

    queries = made.select("dim", F.col("block").alias("query_block"), "kind", "query_ids", "query_vecs", "least")
    queries = placed.select("query_block", "g", "u").distinct().join(queries, "query_block").withColumnRenamed("query_block", "block")
    given = placed.select("block", "g", "u").distinct().join(made.select("dim", "block", "kind", "ids", "vecs", "envelope", "largest"), "block")
    keys = ["dim", "g", "u"]
    beyond = _side(queries, keys).cogroup(_side(given, keys)).applyInArrow(compare, _FOUND)
    home = made.select(F.inline(F.arrays_zip(F.col("found_query").alias("query_id"), F.col("found_id").alias("vec_id"), F.col("found_score").alias("score"))))
    ranked = home.unionByName(beyond).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same by brute force in DuckDB's SQL.
SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
