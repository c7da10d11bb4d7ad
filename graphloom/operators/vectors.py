"""Entity vectors: texts, a deterministic embedder, and nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = 384


def entity_text() -> Column:
    """What of an entity is embedded: kind, name, file and description, as far as there."""
    return F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("kind", "name", "file", "description")])


def hashed_words(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A bag of hashed lower-case words of unit length: the default embedder, which needs no model."""
    words = F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(x).cast("float"))


def model(embed_many: Callable[[list[str]], Sequence], batch: int = 32, name: str = "") -> Callable[[Column], Column]:
    """An embedder of text columns by a function from texts to vectors, which runs in the executors; ``name`` tells it from others.

    Texts go to it by length, ``batch`` at a time, so that those of a batch need little
    filling; vectors come back in the order of the rows.
    """

    @F.pandas_udf("array<float>")
    def of_column(texts: pd.Series) -> pd.Series:
        values = texts.fillna("").tolist()
        order = sorted(range(len(values)), key=lambda i: len(values[i]))
        out: list = [None] * len(values)
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            for i, v in zip(some, embed_many([values[i] for i in some]), strict=True):
                out[i] = [float(x) for x in v]
        return pd.Series(out)

    of_column.embedder = name or getattr(embed_many, "__name__", "model")
    return of_column


def indexed(nodes: DataFrame, embed: Callable[[Column], Column] = hashed_words) -> DataFrame:
    """One row for each entity: its payload and its vector."""
    text = entity_text()
    return nodes.filter("type = 'Entity'").select("id", "name", "kind", "file", "line", "description", embed(text).alias("embedding"))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(index: DataFrame, query: list[float], k: int = 10, tie: str = "id") -> DataFrame:
    """The k rows with the largest inner product with ``query``; every task keeps only its own k best."""
    score = inner_product(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    best = index.withColumn("_score", score).orderBy(F.desc("_score"), tie).limit(k)
    return best.withColumn("score", F.round("_score", 4)).drop("_score", "embedding")


def embedded(spark: SparkSession, text: str, embed: Callable[[Column], Column] = hashed_words) -> list[float]:
    """The vector of one text."""
    return spark.range(1).select(embed(F.lit(text)).alias("v")).first()["v"]


def search(index: DataFrame, text: str, k: int = 10, embed=hashed_words) -> DataFrame:
    """The k rows of a table of vectors closest to a text."""
    return nearest(index, embedded(index.sparkSession, text, embed), k)
