"""A stored index of entity vectors: packed codes in coarse cells, and the vectors for an exact last look.

Of each vector four bits a component are kept, times the vector's largest component; 16
levels lie around zero. Vectors stand in cells: ``cells`` directions, fitted on a sample of
at most ``SAMPLE`` vectors by a few rounds of averaging, each vector in the cell of the
direction with the largest product. Rows are stored in the order of their cells, so that a
search reads the row groups of the cells that it probes; codes rank what is there, and the
best ``RERANK`` times k get their exact product from the vectors, which are read for them
only. The exact mode reads all vectors.

The index knows its embedder's name and its dimension: a search with another one is an
error, as its scores would mean nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.vectors import nearest
from graphloom.scratch import written
from graphloom.sources.versions import Versions

SAMPLE, CELLS, ROUNDS = 16_384, 1024, 6
#: Share of the cells that a search probes, at least ``LEAST_PROBES`` of them, and rows with an exact look for one of the result.
PROBES, LEAST_PROBES, RERANK = 0.2, 8, 10
_LEVELS = 15


def packed_codes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, scales): two components a byte, 0 to 15 for -scale to scale."""
    scale = np.abs(v).max(axis=1, initial=0)
    unit = v / np.where(scale > 0, scale, 1)[:, None]
    codes = np.rint((unit + 1) * (_LEVELS / 2)).astype(np.uint8)
    codes = np.hstack([codes, np.zeros((len(v), v.shape[1] % 2), np.uint8)])
    return codes[:, ::2] << 4 | codes[:, 1::2], scale.astype(np.float32)


def unpacked_codes(codes: np.ndarray, scale: np.ndarray, dimensions: int) -> np.ndarray:
    both = np.stack([codes >> 4, codes & 15], axis=2).reshape(len(codes), -1)[:, :dimensions]
    return (both.astype(np.float32) * np.float32(2 / _LEVELS) - 1) * scale[:, None]


def directions(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit vectors around which a sample lies."""
    lengths = np.linalg.norm(sample, axis=1, keepdims=True)
    unit = sample / np.where(lengths > 0, lengths, 1)
    found = unit[np.linspace(0, len(unit) - 1, min(cells, len(unit))).astype(int)]
    for _ in range(ROUNDS):
        at = (unit @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, at, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(length > 0, sums / np.where(length > 0, length, 1), found)
    return found.astype(np.float32)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dimensions)


def name_of(embed) -> str:
    return getattr(embed, "embedder", None) or getattr(embed, "__name__", type(embed).__name__)


@dataclass(frozen=True)
class Index:
    """One published index."""

    rows: DataFrame
    centers: np.ndarray
    embedder: str
    dimensions: int
    count: int

    def _query(self, vector: list[float]) -> np.ndarray:
        if len(vector) != self.dimensions:
            raise ValueError(f"the index has {self.dimensions} dimensions, the query {len(vector)}")
        return np.array(vector, np.float32)

    def probed(self, vector: list[float], probes: int | None = None) -> list[int]:
        """The cells that a search looks at, the closest first."""
        if not len(self.centers):
            return []
        n = max(LEAST_PROBES, round(PROBES * len(self.centers))) if probes is None else probes
        return np.argsort(-(self.centers @ self._query(vector)), kind="stable")[:n].tolist()

    def search(self, vector: list[float], k: int = 10, exact: bool = False, probes: int | None = None) -> DataFrame:
        """The k rows with the largest inner product with a vector, with their scores; ties by id."""
        q, payload = self._query(vector), self.rows.drop("cell", "code", "scale")
        if exact:
            return nearest(payload, vector, k)
        most, dimensions = RERANK * k, self.dimensions

        def rank(batches):
            best = (np.empty(0, np.float32), np.empty(0, object))
            for batch in batches:
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                scores = unpacked_codes(codes, batch.column(2).to_numpy(), dimensions) @ q
                scores, ids = np.append(best[0], scores), np.append(best[1], np.array(batch.column(0).to_pylist(), object))
                keep = np.lexsort((ids, -scores))[:most]
                best = scores[keep], ids[keep]
            yield pa.RecordBatch.from_arrays([pa.array(best[1].tolist(), pa.string()), pa.array(best[0].astype(np.float64))], names=["id", "near"])

        inside = self.rows.filter(F.col("cell").isin(self.probed(vector, probes)))
        chosen = inside.select("id", "code", "scale").mapInArrow(rank, "id string, near double").orderBy(F.desc("near"), "id").limit(most)
        ids = [r["id"] for r in chosen.select("id").collect()]  # a fixed multiple of k
        return nearest(inside.filter(F.col("id").isin(ids)).select(*payload.columns), vector, k)

    def report(self, vector: list[float], k: int = 10, probes: int | None = None) -> dict:
        """What a search reads: cells, codes and their bytes, of how many, and vectors for the exact look."""
        cells = self.probed(vector, probes)
        codes = self.rows.filter(F.col("cell").isin(cells)).count()
        size = (self.dimensions + 1) // 2 + 4
        return {"cells": len(cells), "of_cells": len(self.centers), "codes": codes, "of_codes": self.count, "code_bytes": codes * size, "vectors": min(codes, RERANK * k), "vector_bytes": min(codes, RERANK * k) * 4 * self.dimensions, "exact_bytes": self.count * 4 * self.dimensions}


class IndexStore:
    """The published indexes below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, root, lambda content: {f"v-{content['name']}"})

    def facts(self) -> dict | None:
        """What is known of the published index; None before the first."""
        found = self.versions.newest()
        return found and found[1]

    def publish(self, vectors: DataFrame, embedder: str, cells: int = CELLS) -> int:
        """Publishes an index of rows with an id and an ``embedding``, the same length in all; the number of them."""
        given = written(vectors.filter("embedding is not null"), "index-vectors")
        count = given.count()
        sizes = given.agg(F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
        if count and sizes["least"] != sizes["most"]:
            raise ValueError(f"vectors have {sizes['least']} to {sizes['most']} components")
        dimensions = sizes["most"] or 0
        some = given.filter(F.rand(11) < SAMPLE / count).limit(SAMPLE) if count > SAMPLE else given
        sample = np.array([r[0] for r in some.select("embedding").collect()], np.float32).reshape(-1, dimensions) if dimensions else np.empty((0, 0), np.float32)
        centers = directions(sample, max(1, min(cells, round(count**0.5)))) if len(sample) else np.empty((0, dimensions), np.float32)
        names = given.columns
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema) + ", cell int, code binary, scale float"

        def code(batches):
            for batch in batches:
                if batch.num_rows:
                    v = _matrix(batch.column(names.index("embedding")), dimensions)
                    codes, scale = packed_codes(v)
                    more = [pa.array((v @ centers.T).argmax(axis=1), pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, "cell", "code", "scale"])

        name = uuid.uuid4().hex
        given.mapInArrow(code, schema).repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.parquet(f"{self.root}/v-{name}/rows")
        self.versions.write(f"{self.root}/v-{name}/centers", json.dumps(centers.tolist()))
        self.versions.commit(lambda _: {"name": name, "embedder": embedder, "dimensions": dimensions, "count": count})
        self.versions.clean()
        return count

    def index(self) -> Index | None:
        """The published index; None before the first."""
        said = self.facts()
        if said is None:
            return None
        self.versions.hold(f"v-{said['name']}")
        centers = np.array(json.loads(self.versions.read(f"{self.root}/v-{said['name']}/centers")), np.float32).reshape(-1, said["dimensions"] or 1)
        return Index(self.spark.read.parquet(f"{self.root}/v-{said['name']}/rows"), centers, said["embedder"], said["dimensions"], said["count"])
