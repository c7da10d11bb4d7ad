"""Changes to a graph as tables of a few rows, and the graph that holds after them.

A change first drops, then puts. Nodes are known by their ids; edges go by all that have
one source, target and type, or, of those that the parser made, by their file. Tables of
several changes are merged with the base when they are read: rows of a later change
replace those of earlier ones. Changes are counted when they are written, and broadcast
while they are few, so that the base isn't moved for them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.traverse import small
from graphloom.scratch import released

KEY = ("src", "dst", "type")
#: Columns that what agents write has.
NODE_FLAGS = {"language": "string", "agent_created": "boolean", "agent_inferred": "boolean"}
EDGE_FLAGS = {"agent_inferred": "boolean", "agent_relation": "boolean", "resolved": "boolean"}


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def with_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``df`` with those of the columns that it lacks, null."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in df.columns})


@dataclass(frozen=True)
class Changes:
    """The tables of a change; None for those that don't change.

    ``nodes``: node rows; ``gone`` ones only tell ids. ``edges``: edge rows; ``gone`` ones
    only tell src, dst and type. ``files``: (path) of files whose edges by the parser go,
    with their triples. ``imports``: (importer, target, gone): pairs of files; gone ones
    tell an importer or a target of pairs that go. ``triples``: resolved rows of changed
    files; ``places``: where those of new or changed files begin; ``wanted``: (importer, base)
    what the files' imports may mean.
    """

    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    files: DataFrame | None = None
    imports: DataFrame | None = None
    triples: DataFrame | None = None
    places: DataFrame | None = None
    wanted: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: df for f in fields(self) if (df := getattr(self, f.name)) is not None}


@dataclass(frozen=True)
class Log:
    """The tables of changes, in their order: (table, number of rows) of each change that has one."""

    nodes: Sequence[tuple[int, DataFrame, int]] = ()
    edges: Sequence[tuple[int, DataFrame, int]] = ()
    files: Sequence[tuple[int, DataFrame, int]] = ()
    imports: Sequence[tuple[int, DataFrame, int]] = ()
    triples: Sequence[tuple[int, DataFrame, int]] = ()
    places: Sequence[tuple[int, DataFrame, int]] = ()
    wanted: Sequence[tuple[int, DataFrame, int]] = ()

    def table(self, name: str) -> tuple[DataFrame | None, int]:
        """All rows of a kind with the place of their change, and their number."""
        out, rows = None, 0
        for place, df, n in getattr(self, name):
            df = with_columns(df, {"gone": "boolean"} if name in ("nodes", "edges", "imports") else {}).withColumn("_at", F.lit(place))
            out, rows = df if out is None else out.unionByName(df, allowMissingColumns=True), rows + n
        return out, rows


def _without(df: DataFrame, gone: DataFrame, rows: int, on: list[str]) -> DataFrame:
    return df.join(small(gone, rows), on, "left_anti").select(*df.columns)


def merged_nodes(base: DataFrame, log: Log) -> DataFrame:
    said, rows = log.table("nodes")
    if said is None:
        return base
    base = with_columns(base, NODE_FLAGS)
    last = said.withColumn("gone", flag("gone"))
    if len(log.nodes) > 1:  # one change puts a node once
        nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_at"), "gone"))  # a put comes after a drop
        last = last.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")
    kept = _without(base, last.select("id"), rows, ["id"])
    return kept.unionByName(last.filter("not gone").drop("gone", "_at"), allowMissingColumns=True).select(*base.columns)


def merged_edges(base: DataFrame, log: Log) -> DataFrame:
    said, rows = log.table("edges")
    paths, n_paths = log.table("files")
    if said is None and paths is None:
        return base
    base = with_columns(base, EDGE_FLAGS)
    out, puts = base, None
    if paths is not None:
        last = paths.groupBy(F.col("path").alias("source_file")).agg(F.max("_at").alias("_gone_at"))
        # an anti join on a key that agents' edges don't have
        keyed = out.withColumn("_own", F.when(~flag("agent_inferred"), F.col("source_file")))
        out = keyed.join(small(last.select(F.col("source_file").alias("_own")), n_paths), "_own", "left_anti").select(*out.columns)
    if said is not None:
        said = said.withColumn("gone", flag("gone"))
        gone = said.filter("gone").groupBy(*KEY).agg(F.max("_at").alias("_gone_at"))
        out = _without(out, gone.select(*KEY), rows, list(KEY))
        puts = said.filter("not gone").join(small(gone, rows), list(KEY), "left").filter("_gone_at is null or _at >= _gone_at").drop("_gone_at", "gone")
        if paths is not None:
            puts = puts.join(small(last, n_paths), "source_file", "left")
            puts = with_columns(puts, EDGE_FLAGS).filter(flag("agent_inferred") | F.col("_gone_at").isNull() | (F.col("_at") >= F.col("_gone_at"))).drop("_gone_at")
    return out if puts is None else out.unionByName(puts.drop("_at"), allowMissingColumns=True).select(*base.columns)


def merged_imports(base: DataFrame, log: Log) -> DataFrame:
    said, rows = log.table("imports")
    if said is None:
        return base
    said, out = said.withColumn("gone", flag("gone")), base
    puts = said.filter("not gone")
    for end in ("importer", "target"):
        gone = said.filter(F.col("gone") & F.col(end).isNotNull()).groupBy(end).agg(F.max("_at").alias("_gone_at"))
        out = _without(out, gone.select(end), rows, [end])
        puts = puts.join(small(gone, rows), end, "left").filter("_gone_at is null or _at >= _gone_at").drop("_gone_at")
    return out.unionByName(puts.select("importer", "target")).distinct()


def merged_rows(base: DataFrame, log: Log, table: str, file: str, of=lambda said: said) -> DataFrame:
    """A table of rows of files, without those of files that changed, and with what the log's ``table`` says of them;
    ``of`` makes the table's rows of those of the log."""
    said, _ = log.table(table)
    paths, n_paths = log.table("files")
    out = base
    last = None if paths is None else paths.groupBy(F.col("path").alias(file)).agg(F.max("_at").alias("_gone_at"))
    if last is not None:
        out = _without(out, last.select(file), n_paths, [file])
    if said is not None:
        key = "source_file" if "source_file" in said.columns else file
        if last is not None:
            said = said.join(small(last.withColumnRenamed(file, key), n_paths), key, "left").filter("_gone_at is null or _at >= _gone_at").drop("_gone_at")
        out = out.unionByName(of(said.drop("_at")).select(*base.columns))
    return out


def applied(nodes: DataFrame, edges: DataFrame, changes: Changes) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after one change. What a merge looks for is counted now: files, the edges that go, and nodes, if any were there before."""
    found = changes.tables()

    def log(**rows: Callable[[DataFrame], int]) -> Log:
        return Log(**{name: [(0, found[name], count(found[name]))] for name, count in rows.items() if name in found})

    with released(nodes.sparkSession):
        nodes, edges = (df.limit(0) if df.isEmpty() else df for df in (nodes, edges))
        of_nodes = log(nodes=lambda df: 0 if nodes.isEmpty() else df.count())
        of_edges = log(edges=lambda df: df.filter("gone").count() if "gone" in df.columns else 0, files=DataFrame.count)
    return merged_nodes(nodes, of_nodes), merged_edges(edges, of_edges)
