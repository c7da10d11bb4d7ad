"""Extraction over files: an extractor for each extension, run in the executors.

A file that can't be read or parsed has no rows and never fails the run. Its rows keep
their order by the file's rank and their place in it. Contents are read and parsed where
they lie; only what was extracted is ranked and moved.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from graphloom.schemas import LANGUAGES, TRIPLES
from graphloom.scratch import written
from graphloom.sources import ignore, tree
from graphloom.sources.extract import javascript, php, python, style
from graphloom.sources.extract.base import Relation

EXTRACTORS = {
    "py": python.extract, "js": javascript.extract, "jsx": javascript.extract, "ts": javascript.extract, "tsx": javascript.extract, "php": php.extract,
    "html": style.extract_html, "css": style.extract_css, "scss": style.extract_css,
}
#: Numbers that are left free after a file's triples, and before those of the first file, for changes.
ROOM, LEAD = 1 << 16, 1 << 40
#: Tasks that read contents at most.
READERS = 10_000
#: Changed files that are read by their paths; more are found by a scan.
NAMED_FILES = 1000


def parsed(text: str, path: str) -> tuple[list[Relation], str | None]:
    """(relations, error) of one source; no relations if its kind is unknown or it can't be parsed."""
    extractor = EXTRACTORS.get(path.rsplit(".", 1)[-1].lower())
    if extractor is None:
        return [], None
    try:
        rows = extractor(text, path)
        if path.endswith(".styles.ts"):
            rows += style.extract_lit(text, path)
        return rows, None
    except Exception as e:  # a broken source is not an error of the run
        return [], f"{type(e).__name__}: {e}"


def parse(text: str, path: str) -> list[Relation]:
    """The relations of one source; none if its kind is unknown or it can't be parsed."""
    return parsed(text, path)[0]


class Progress:
    """What a run has done so far, counted as its tasks end: files, those that were refused, and relations."""

    def __init__(self, spark: SparkSession):
        self._counts = {c: spark.sparkContext.accumulator(0) for c in ("files", "refused", "relations")}

    def add(self, **counts: int) -> None:
        for c, n in counts.items():
            self._counts[c].add(n)

    def counts(self) -> dict[str, int]:
        return {c: a.value for c, a in self._counts.items()}


def relations(files: DataFrame, parser=parsed, progress: Progress | None = None) -> tuple[DataFrame, DataFrame]:
    """((place, fields of a triple), (path, error)) of files (path, content as bytes or text, and perhaps an error of reading):
    a file's relations in their order, and the files that were refused. Both come of one pass."""
    fields = [f for f in TRIPLES if f.name != "seq"]
    schema = T.StructType([T.StructField("place", T.LongType()), *fields, T.StructField("error", T.StringType())])
    empty = (None,) * (len(fields) - 1)
    at = [f.name for f in fields].index("source_file")

    def run(batches):
        for batch in batches:
            out, refused = [], 0
            for path, content, error in zip(batch["path"], batch["content"], batch["error"], strict=True):
                rows = []
                if error is None:
                    text = content.decode("utf-8", "replace") if isinstance(content, bytes | bytearray) else content or ""
                    rows, error = parser(text, path)
                for k, r in enumerate(rows):
                    out.append((k, r.from_entity, r.from_type, r.relation_type, r.to_entity, r.to_type, path, r.line_number, r.call_receiver, r.call_receiver_type, r.is_exported, r.owner_class, None))
                if error is not None:
                    out.append((None, *empty[:at], path, *empty[at:], error))
                    refused += 1
            if progress is not None:
                progress.add(files=len(batch), refused=refused, relations=len(out) - refused)
            yield pd.DataFrame(out, columns=schema.names)

    given = files.select("path", "content", (F.col("error") if "error" in files.columns else F.lit(None)).cast("string").alias("error"))
    made = written(given.mapInPandas(run, schema), "extracted")
    return made.filter("place is not null").drop("error"), made.filter("place is null").select(F.col("source_file").alias("path"), "error")


def sizes(found: DataFrame) -> DataFrame:
    """(path, n): the number of places that the relations of a file take."""
    return found.groupBy(F.col("source_file").alias("path")).agg((F.max("place") + 1).alias("n"))


def placed(found: DataFrame, places: DataFrame) -> DataFrame:
    """Triples of relations, in the order of the places (path, begin) of their files."""
    begins = places.select(F.col("path").alias("source_file"), "begin")
    return found.join(begins, "source_file").select((F.col("begin") + F.col("place")).alias("seq"), *[f.name for f in TRIPLES if f.name != "seq"])


def extract(files: DataFrame, parser=parsed) -> DataFrame:
    """Triples of files (path, content), in the order of paths and of places in a file."""
    found, _ = relations(files, parser)
    return placed(found, begun(sizes(found)))


def begun(sizes: DataFrame, room: int = ROOM, lead: int = 0) -> DataFrame:
    """(path, begin, n): ``lead`` and the sum of ``n`` and ``room`` over the paths before each one, for a table (path, n).

    Paths are dealt out by range; each range is summed alone, after the sums of the
    ranges before it. Only that table, a row for each range, is summed as one.
    """
    dealt = written(sizes.repartitionByRange("path").withColumn("part", F.spark_partition_id()).withColumn("all", F.col("n") + room), "paths")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("part").agg(F.sum("all").alias("sum")).withColumn("before", F.coalesce(F.sum("sum").over(earlier), F.lit(0)))
    inside = Window.partitionBy("part").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.lit(lead) + F.col("before") + F.coalesce(F.sum("all").over(inside), F.lit(0))
    return dealt.join(F.broadcast(parts), "part").select("path", begin.cast("bigint").alias("begin"), F.col("n").cast("bigint").alias("n"))  # a row for each range


def inserted(places: DataFrame, new: dict[str, int]) -> dict[str, int] | None:
    """Where files (path to its number of places) begin among others: a known file where it was, a new one between its
    neighbours; None if one of them has no room. One pass over ``places`` finds all neighbours."""
    paths = sorted(new)
    after = F.size(F.filter(F.array(*map(F.lit, paths)), lambda p: p <= F.col("path")))
    own = places.filter(F.col("path").isin(paths))
    rest = places.filter(~F.col("path").isin(paths)).groupBy(after.alias("gap")).agg(F.min("begin").alias("first"), F.max(F.struct("begin", "n")).alias("last"))
    gaps, known = {r["gap"]: r for r in rest.collect()}, {r["path"]: r["begin"] for r in own.collect()}  # a row for each given path
    ends: list[int | None] = [None] * len(paths)
    limit = None
    for i in range(len(paths) - 1, -1, -1):  # where the next file that stays begins
        if i + 1 in gaps:
            limit = gaps[i + 1]["first"]
        ends[i] = limit
        limit = known.get(paths[i], limit)
    out, used, i = {}, 0, 0
    while i < len(paths):
        if i in gaps:
            used = max(used, gaps[i]["last"]["begin"] + gaps[i]["last"]["n"])
        j = i + 1
        while j < len(paths) and paths[i] not in known and paths[j] not in known and j not in gaps:
            j += 1  # new files between the same neighbours
        group, end = paths[i:j], ends[j - 1]
        if group[0] in known:
            begins = [known[group[0]]]
        elif end is None:
            begins = [used + ROOM]
            for p in group[:-1]:
                begins.append(begins[-1] + new[p] + ROOM)
        else:
            spare = (end - used - sum(new[p] for p in group)) // (len(group) + 1)
            if spare < 0:
                return None
            begins = [used + spare]
            for p in group[:-1]:
                begins.append(begins[-1] + new[p] + spare)
        used = begins[-1] + new[group[-1]]
        if end is not None and used > end:
            return None
        out.update(zip(group, begins, strict=True))
        i = j
    return out


def _relative(root: str):
    base = root.rstrip("/")
    return F.regexp_replace("path", "^" + re.escape(base if "://" in base else "file:" + base) + "/", "").alias("path")


def _read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files of a store that only Spark opens."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)


@dataclass(frozen=True)
class Scanned:
    """A tree: ``files`` (path, content, error) that have an extractor, their ``paths``, ``folders`` (path), and
    ``listed`` (path, size, time), what a watch compares with, if the store tells."""

    files: DataFrame
    paths: DataFrame
    folders: DataFrame
    listed: DataFrame | None = None


def scanned(spark: SparkSession, root: str, patterns: list[str] | None = None, skip=ignore.SKIPPED) -> Scanned:
    """The supported files and the folders below a root; without ``patterns``, those of its own ignore list hold.

    What is left out isn't entered. In a store that only Spark opens, all files are listed
    by Spark, and folders in the driver.
    """
    if tree.can_open(root):
        found = tree.walk(spark, root, patterns, skip)
        files = found.filter((F.col("kind") == "file") & tree.supported(F.col("path")))
        spread = files.repartition(max(1, min(READERS, -(-files.count() // 100))))
        return Scanned(tree.contents(spread, root), files.select("path"), found.filter("kind = 'folder'").select("path"), files.select("path", "size", "time"))
    patterns = ignore.load_patterns(spark, root) if patterns is None else patterns
    endings = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in LANGUAGES) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", endings).load(root)
    files = found.select(_relative(root), "content").filter(~ignore.ignored(F.col("path"), patterns, skip))
    folders = spark.createDataFrame([(f,) for f in ignore.folders(spark, root, patterns, skip)], "path string")
    return Scanned(files, files.select("path"), folders)


def scan(spark: SparkSession, root: str, patterns: list[str] | None = None, skip=ignore.SKIPPED, only: list[str] | None = None) -> DataFrame:
    """(path, content) of the supported files below a folder of any store; paths are relative to it.

    ``only``: the paths to look at; those that aren't there are left out.
    """
    if only is None:
        return scanned(spark, root, patterns, skip).files
    patterns = ignore.load_patterns(spark, root) if patterns is None else patterns
    only = [p for p in only if p.rpartition(".")[2].lower() in LANGUAGES and ignore.is_file(spark, f"{root.rstrip('/')}/{p}")]
    if not only:
        return spark.createDataFrame([], "path string, content binary, error string")
    asked = spark.createDataFrame([(p, None) for p in only], "path string, size bigint").filter(~ignore.ignored(F.col("path"), patterns, skip))
    if tree.can_open(root):
        return tree.contents(asked, root)
    found = _read(spark, [f"{root.rstrip('/')}/{p}" for p in only]).select(_relative(root), "content")
    return found.filter(~ignore.ignored(F.col("path"), patterns, skip))


def present(paths: DataFrame, root: str) -> DataFrame:
    """Those of some files (path) below a root that are there, indexed or not."""
    if not tree.can_open(root):
        return _read(paths.sparkSession, root).select(_relative(root)).join(paths, "path", "left_semi")

    def look(batches):
        store, base = tree.opened(root)
        for batch in batches:
            found = store.get_file_info([f"{base}/{p}" for p in batch.column(0).to_pylist()])
            yield batch.filter(pa.array([f.type == tree.stores.FileType.File for f in found]))

    return paths.filter("path <> ''").select("path").distinct().mapInArrow(look, "path string")
