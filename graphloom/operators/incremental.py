"""What changes in a graph when files do, without looking at the others' text again.

Triples are kept as they were resolved, with tables that tell where to look: definitions
by name, which file asks for which name (by a hash), what points into a node, and the
paths that an import may mean. When files change,

* their definitions before and after are compared; a name of which some came or went is
  asked for by other files, whose calls are resolved again, with the definitions of the
  names that they ask for;
* the edges of all these files are made anew;
* the nodes that these edges touched or touch are made from all that supports them, so that
  first and last writers can be withdrawn and a node without support goes;
* agents' facts are joined as in a rebuild, and imports of and into these files are
  resolved again.

The result is a ``Changes`` of the rows that differ in the end. Lookups are filters of the
scan while there are few names or ids, and joins past a broadcast while they are counted
as small, so that the tables of the other files stay where they are. They look in the rows
of the other files only; where every file changed there are none, and nothing is looked up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.columns import blank, import_targets, without_code_ending
from graphloom.operators import mutate
from graphloom.operators.changes import EDGE_FLAGS, KEY, NODE_FLAGS, Changes, flag, with_columns
from graphloom.operators.graph import Graph
from graphloom.operators.lookup import among, having, sought
from graphloom.scratch import dropped, released, written


@dataclass(frozen=True)
class Resolved:
    """Resolved triples, and the tables that tell where to look in them."""

    triples: DataFrame
    definitions: DataFrame
    asked: DataFrame
    into: DataFrame
    wanted: DataFrame

    def without(self, paths: DataFrame) -> Resolved:
        """The tables without some files (path)."""
        cut = lambda df, c: df.join(paths.withColumnRenamed("path", c), c, "left_anti").select(*df.columns)
        return Resolved(cut(self.triples, "source_file"), cut(self.definitions, "file"), cut(self.asked, "source_file"), cut(self.into, "source_file"), cut(self.wanted, "importer"))


def asked_names(t: DataFrame) -> DataFrame:
    """(key, source_file): the hashes of the names and classes that a file's calls ask for."""
    names = F.explode(F.array_distinct(F.array_compact(F.array(F.xxhash64("to_entity"), F.when(F.col("call_receiver_type").isNotNull(), F.xxhash64("call_receiver_type"))))))
    return t.filter("relation_type <> 'DEFINED_IN'").select(names.alias("key"), "source_file").distinct()


def into_nodes(t: DataFrame) -> DataFrame:
    """(to_id, seq, to_entity, to_type, module, source_file): the to-sides of triples."""
    module = (F.col("relation_type") == "DEFINED_IN") & (F.col("to_type") == "module")
    return t.select("to_id", "seq", "to_entity", "to_type", module.alias("module"), "source_file")


def wanted_paths(nodes: DataFrame, edges: DataFrame, psr4: dict[str, str]) -> DataFrame:
    """(importer, base): the paths without ending that the imports of a file may mean."""
    imports = edges.filter("type = 'IMPORTS'").filter(blank(F.col("source_file")) != "").select("dst", F.col("source_file").alias("importer")).distinct()
    names = nodes.select(F.col("id").alias("dst"), F.col("name").alias("spec"))
    return imports.join(names, "dst").select("importer", F.explode(import_targets(F.col("spec"), F.col("importer"), psr4)).alias("base")).distinct()


def tables(t: DataFrame, nodes: DataFrame, edges: DataFrame, project: str, psr4: dict[str, str]) -> Resolved:
    """All tables of resolved triples."""
    return Resolved(t, mutate.definitions(t, project), asked_names(t), into_nodes(t), wanted_paths(nodes, edges, psr4))


def _changed_names(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name) of the definitions that only one of two tables has; their order counts within a file's name."""
    nth = F.row_number().over(Window.partitionBy("file", "name").orderBy("seq"))
    columns = ["name", "id", "file", "owner", "kind"]
    rows = lambda df, n: df.withColumn("nth", nth).select(*columns, "nth", F.lit(n).alias("side"))
    both = rows(old, 1).unionByName(rows(new, -1)).groupBy(*columns, "nth").agg(F.sum("side").alias("sum"))
    return both.filter("sum <> 0").select("name").distinct()


def changes(graph: Graph, known: Resolved, touched: DataFrame, fresh: DataFrame, tree_nodes: DataFrame, tree_edges: DataFrame, gone_tree: DataFrame, file_ids: DataFrame, there: DataFrame | None, psr4: dict[str, str], anew: bool = False) -> Changes:
    """The changes of a graph when the files ``touched`` (path) have the triples ``fresh`` from now on.

    ``tree_nodes`` and ``tree_edges``: nodes and edges of containment that come; ``gone_tree``
    (id): nodes that go, unless agents made them and their file is ``there`` (path).
    ``file_ids`` (path, id): the files that are indexed afterwards. ``anew``: nodes are what
    the triples say, and keep nothing (such as a line) that only the graph before knew.
    """
    project, columns = graph.project, fresh.columns
    touched = written(touched.select("path").distinct(), "touched")
    kept = known.without(touched)
    with released(touched.sparkSession):
        alone = kept.triples.isEmpty()
    if alone:
        others, files, again = touched.limit(0), touched, known.triples.limit(0)
    else:
        names = _changed_names(among(known.definitions, "file", touched), mutate.definitions(fresh, project))
        names = written(names, "changed-names")
        others = written(among(kept.asked, "key", names.select(F.xxhash64("name"))).select(F.col("source_file").alias("path")).distinct(), "asking")
        files = written(touched.unionByName(others), "files")
        again = written(among(kept.triples, "source_file", others), "again")

    # resolution, with the definitions of the names that are asked for
    asking = fresh if alone else written(again.select(*columns).unionByName(fresh), "to-resolve")
    defs = mutate.definitions(fresh, project)
    if not alone:
        keys = mutate.call_keys(asking)
        asked = keys.select("name").unionByName(keys.select(F.col("receiver").alias("name"))).distinct()
        defs = among(kept.definitions, "name", asked).unionByName(defs.select(*kept.definitions.columns))
    defs = written(defs, "definitions")
    t = written(mutate.resolved_triples(asking, project, defs), "resolved")
    dropped(defs, *[asking][alone:])

    # edges of all these files
    edges = with_columns(mutate.edges_of(t, file_ids).unionByName(tree_edges, allowMissingColumns=True), EDGE_FLAGS)
    overrides = with_columns(graph.edges, EDGE_FLAGS).filter("agent_relation")
    edges = mutate.overridden(edges.unionByName(overrides, allowMissingColumns=True)).filter(~flag("agent_relation"))

    # nodes that these files touched or touch, from all that supports them
    ends = lambda df: df.select(F.explode(F.array("from_id", "to_id")).alias("id"))
    ids = ends(among(known.triples, "source_file", touched)).unionByName(ends(again)).unionByName(ends(t)).distinct()
    sides = mutate.from_sides(t).unionByName(mutate.to_sides(into_nodes(t)))
    if not alone:
        ids, rest = written(ids, "touched-nodes"), known.without(files)
        dropped(again)
        # ids begin with their file, in the order of which triples are stored
        written_by = among(rest.triples, "from_id", ids).select(*t.columns)
        sides = sides.unionByName(mutate.to_sides(among(rest.into, "to_id", ids))).unionByName(mutate.from_sides(written_by))
    new = with_columns(mutate.nodes_of_sides(sides, project).unionByName(tree_nodes, allowMissingColumns=True), NODE_FLAGS)
    new = new if alone and anew else written(new, "new-nodes")  # else read again and again
    all_ids = ids.unionByName(tree_nodes.select("id")).unionByName(gone_tree.select("id")).distinct()
    if anew:
        nodes, old = new, all_ids
    else:
        old = with_columns(among(graph.nodes, "id", all_ids), NODE_FLAGS)
        old = written(old.select(*[(F.col(f.name) if f.name in old.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in new.schema]), "old-nodes")
        nodes = written(mutate.rebuilt_nodes(old, new, there), "nodes")
    gone = old.select("id").join(nodes.select("id"), "id", "left_anti")
    gone = gone if alone and anew else written(gone, "gone-nodes")

    # what goes: the files' edges, agents' edges of nodes that go, and containment of what goes
    keys = tree_edges.select(*KEY).unionByName(_loose_keys(graph, gone, files)).distinct()
    edges = edges.withColumn("gone", F.lit(False)).unionByName(keys.withColumn("gone", F.lit(True)), allowMissingColumns=True)
    said = nodes.withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True)), allowMissingColumns=True)
    wanted, imports = _imports(graph, kept, files, nodes, edges, file_ids, psr4, alone)
    return Changes(nodes=said, edges=edges, files=files, imports=imports, triples=t, wanted=wanted)


def _loose_keys(graph: Graph, gone: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, type) of agents' edges and of containment at nodes that go, without the parser's edges of ``files``, which go anyway."""

    def loose(edges: DataFrame) -> DataFrame:
        found = with_columns(edges, EDGE_FLAGS).filter(flag("agent_inferred") | (F.col("type") == "CONTAINS"))
        found = found.withColumn("_own", F.when(~flag("agent_inferred"), F.col("source_file")))
        return found.join(files.withColumnRenamed("path", "_own"), "_own", "left_anti").select(*KEY)

    edges = loose(graph.edges)
    with released(files.sparkSession):
        if edges.isEmpty():
            return edges.limit(0)
    ids = sought(gone)
    return written(having(edges, "src", ids).unionByName(having(edges if graph.into is None else loose(graph.into), "dst", ids)).distinct(), "loose-edges")


def _imports(graph: Graph, kept: Resolved, files: DataFrame, nodes: DataFrame, edges: DataFrame, file_ids: DataFrame, psr4: dict[str, str], alone: bool) -> tuple[DataFrame, DataFrame]:
    """((importer, base) of the files, (importer, target, gone)): the imports of the files, those into files that are new, and
    those that lose their target. ``alone``: there are no other files."""
    agents = with_columns(graph.edges, EDGE_FLAGS).filter("agent_inferred and type = 'IMPORTS'")
    agents = agents.join(files.withColumnRenamed("path", "source_file"), "source_file", "left_semi")
    own = edges.filter("not gone and type = 'IMPORTS'").unionByName(agents, allowMissingColumns=True)
    named = among(nodes.select("id", "name"), "id", own.select("dst")).unionByName(among(graph.nodes.select("id", "name"), "id", agents.select("dst")).join(nodes.select("id"), "id", "left_anti"))
    wanted = written(wanted_paths(named, own, psr4), "wanted")
    targets = file_ids.select(F.col("path").alias("target")).withColumn("base", without_code_ending(F.col("target")))
    bases = among(targets, "base", wanted.select("base"))
    mine = wanted.join(bases, "base").select("importer", "target")
    if not alone:
        new = files.join(file_ids.select("path"), "path", "left_semi").select(F.col("path").alias("target")).withColumn("base", without_code_ending(F.col("target")))
        may = among(kept.wanted, "base", new.select("base")).join(files.withColumnRenamed("path", "importer"), "importer", "left_anti").select("importer").distinct()
        theirs = among(graph.edges.filter("type = 'IMPORTS'"), "source_file", may)  # what they want now
        mine = mine.unionByName(wanted_paths(among(graph.nodes.select("id", "name"), "id", theirs.select("dst")), theirs, psr4).join(new, "base").select("importer", "target"))
    lost = files.join(file_ids.select("path"), "path", "left_anti")
    drop = lambda df, end: df.select(*[(F.col("path") if c == end else F.lit(None).cast("string")).alias(c) for c in ("importer", "target")], F.lit(True).alias("gone"))
    return wanted, mine.distinct().withColumn("gone", F.lit(False)).unionByName(drop(files, "importer")).unionByName(drop(lost, "target"))
