"""Changes to a graph: writing triples, and the rebuild join that keeps what agents wrote.

Tables are never changed in place; each function gives the rows that hold afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import blank, entity_id, language_of
from graphloom.operators.traverse import BROADCAST_ROWS
from graphloom.schemas import RELATIONS
from graphloom.scratch import dropped, written

#: Calls of one (name, receiver type), as a share of all, beyond which they aren't dealt out by it.
HOT = 1 / 64
#: What no receiver type is, for calls without one.
_NONE = "\0"


def definitions(triples: DataFrame, project: str) -> DataFrame:
    """(name, id, file, owner, kind, seq) of the entities that DEFINED_IN triples define."""
    own_id = entity_id(F.lit(project), F.col("source_file"), F.col("from_entity"), F.col("owner_class"))
    return triples.filter("relation_type = 'DEFINED_IN'").select(
        F.col("from_entity").alias("name"), own_id.alias("id"), F.col("source_file").alias("file"), F.col("owner_class").alias("owner"), F.col("from_type").alias("kind"), "seq"
    )


def targets(keys: DataFrame, defs: DataFrame) -> DataFrame:
    """``keys`` (name, receiver) with ``target``: the definition that a call of a name means, null if none does.

    First the one owned by the receiver's type, then the one in the file of that class, then
    the only one of the name. Every table that is joined has one row for its key.
    """
    counted = defs.groupBy("name").agg(F.count("*").alias("n_defs"), F.min("id").alias("only_id"))
    by_owner = defs.filter("owner is not null").groupBy("name", F.col("owner").alias("receiver")).agg(F.min_by("id", "seq").alias("owner_id"))
    homes = defs.filter("kind = 'class'").groupBy(F.col("name").alias("receiver")).agg(F.min_by("file", "seq").alias("home"))
    by_file = defs.groupBy("name", F.col("file").alias("home")).agg(F.min_by("id", "seq").alias("home_id"))
    found = keys.join(counted, "name").join(by_owner, ["name", "receiver"], "left").join(homes, "receiver", "left").join(by_file, ["name", "home"], "left")
    return found.select(*keys.columns, F.coalesce("owner_id", "home_id", F.when(F.col("n_defs") == 1, F.col("only_id"))).alias("target")).filter("target is not null")


def call_keys(triples: DataFrame) -> DataFrame:
    """(name, receiver, n): what calls ask for, and how many ask for it."""
    calls = triples.filter("relation_type <> 'DEFINED_IN'")
    return calls.groupBy(F.col("to_entity").alias("name"), F.coalesce("call_receiver_type", F.lit(_NONE)).alias("receiver")).agg(F.count("*").alias("n"))


def resolved_triples(triples: DataFrame, project: str, defs: DataFrame | None = None) -> DataFrame:
    """Triples with ``from_id`` and ``to_id``.

    A target that DEFINED_IN doesn't name is looked up among the definitions of its name
    (``targets``), once for each name and receiver's type; otherwise it goes to the bucket
    of the bare name. Triples meet the answers in one join: they stay where they are if the
    answers are few; else they are dealt out by what they ask for, but for the few that a
    large share of all asks for, which counting has shown, and which are broadcast.
    """
    defs = written(definitions(triples, project), "definitions") if defs is None else defs
    return _answered(triples, written(targets(call_keys(triples), defs), "targets"), project)


def resolved_table(triples: DataFrame, project: str) -> DataFrame:
    """``resolved_triples`` of lazy triples as a table; what it was made of is deleted."""
    given = written(triples, "triples")
    defs = written(definitions(given, project), "definitions")
    found = written(targets(call_keys(given), defs), "targets")
    dropped(defs)
    out = written(_answered(given, found, project), "resolved")
    dropped(given, found)
    return out


def _answered(triples: DataFrame, found: DataFrame, project: str) -> DataFrame:
    """Triples with their ends, by the answers ``found`` to what they ask for."""
    p = F.lit(project)
    rows, calls = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    asks = F.col("relation_type") != "DEFINED_IN"
    t = triples.withColumns({"name": F.col("to_entity"), "receiver": F.coalesce("call_receiver_type", F.lit(_NONE))})
    if rows <= BROADCAST_ROWS:
        t = t.join(F.broadcast(found.drop("n")), ["name", "receiver"], "left")
    else:
        hot = found.filter(F.col("n") > HOT * calls).drop("n").withColumnRenamed("target", "hot")  # fewer than 1 / HOT rows
        t = t.join(F.broadcast(hot), ["name", "receiver"], "left")
        spread = F.when(F.col("hot").isNull() & asks, F.col("receiver")).otherwise(F.concat(F.lit(_NONE), F.col("seq").cast("string")))
        t = t.withColumn("receiver", spread).join(found.drop("n"), ["name", "receiver"], "left").withColumn("target", F.coalesce("hot", "target"))
    own_id = entity_id(p, F.col("source_file"), F.col("from_entity"), F.col("owner_class"))
    to_id = F.coalesce(F.when(asks, F.col("target")), F.concat_ws(":", p, F.col("to_entity")))
    return t.select(*triples.columns, own_id.alias("from_id"), to_id.alias("to_id"))


def graph_of(triples: DataFrame, project: str, file_ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of triples, which are resolved once, into a table.

    From-sides write their attributes, the last one wins; to-sides only fill what is not
    there, the first one wins; exported stays true once said. Every triple is an edge.
    """
    t = resolved_table(triples, project)
    return nodes_of(t, project), edges_of(t, file_ids)


_SIDE = {"id": "string", "seq": "bigint", "side": "int", "name": "string", "entity_type": "string", "file": "string", "line": "int", "owner": "string", "is_exported": "boolean", "module": "boolean"}


def from_sides(t: DataFrame) -> DataFrame:
    """What resolved triples say of the nodes that they come from."""
    given = {
        "id": F.col("from_id"), "seq": F.col("seq"), "side": F.lit(0), "name": F.col("from_entity"), "entity_type": F.col("from_type"), "file": F.col("source_file"),
        "line": F.when((F.col("relation_type") == "DEFINED_IN") & (F.col("line_number") > 0), F.col("line_number")), "owner": F.nullif(F.col("owner_class"), F.lit("")), "is_exported": F.col("is_exported"), "module": F.lit(False),
    }
    return t.select(*[given[c].cast(kind).alias(c) for c, kind in _SIDE.items()])


def to_sides(into: DataFrame) -> DataFrame:
    """What triples (to_id, seq, to_entity, to_type, module) say of the nodes that they lead to."""
    given = {"id": F.col("to_id"), "seq": F.col("seq"), "side": F.lit(1), "name": F.col("to_entity"), "entity_type": F.col("to_type"), "module": F.col("module")}
    return into.select(*[given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in _SIDE.items()])


def nodes_of(t: DataFrame, project: str) -> DataFrame:
    """The nodes of resolved triples."""
    module = (F.col("relation_type") == "DEFINED_IN") & (F.col("to_type") == "module")
    return nodes_of_sides(from_sides(t).unionByName(to_sides(t.withColumn("module", module))), project)


def nodes_of_sides(sides: DataFrame, project: str) -> DataFrame:
    """The nodes that sides of triples tell of: the last from-side, and the first to-side where that says nothing."""
    of = lambda side, *columns: F.when(F.col("side") == side, F.struct("seq", *columns))
    said = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c]
    nodes = sides.groupBy("id").agg(
        F.max(of(0, "name", "entity_type", "file")).alias("last"), F.min(of(1, "name", "entity_type")).alias("first"), said("line").alias("line"), said("owner").alias("owner"),
        F.coalesce(F.bool_or("module"), F.lit(False)).alias("module"), F.coalesce(F.bool_or("is_exported"), F.lit(False)).alias("is_exported"), F.min(F.col("seq") * 2 + F.col("side")).alias("node_seq"),
    )
    nodes = nodes.select(
        "id", F.coalesce("last.name", "first.name").alias("name"), F.coalesce("last.entity_type", "first.entity_type").alias("entity_type"), F.col("last.file").alias("file"),
        F.when(F.col("last").isNotNull(), language_of(F.col("last.file"))).otherwise("").alias("language"),
        F.coalesce("line", F.when(F.col("module"), 1)).alias("line"), "owner", "is_exported", "node_seq",
    )
    line = F.coalesce("line", F.when((F.col("entity_type") == "module") & F.col("file").isNotNull(), 1))
    return nodes.select(
        "id", F.lit("Entity").alias("type"), "name", F.lit(None).cast("string").alias("path"), F.lit(project).alias("project"), "entity_type", "language",
        F.concat_ws(":", "entity_type", F.nullif(F.col("language"), F.lit(""))).alias("kind"), "file", line.alias("line"), "owner", "is_exported",
        F.lit(None).cast("string").alias("description"), "node_seq",
    )


def edges_of(t: DataFrame, file_ids: DataFrame | None = None) -> DataFrame:
    """The edges of resolved triples, and those from their files, if ids (path, id) of these are given."""
    relation = F.when(F.col("relation_type").isin(*RELATIONS), F.col("relation_type")).otherwise("RELATION")
    edges = t.select(
        F.col("from_id").alias("src"), F.col("to_id").alias("dst"), relation.alias("type"), "source_file", F.col("line_number").alias("line"),
        F.col("call_receiver").alias("receiver"), F.col("call_receiver_type").alias("receiver_type"), (F.col("seq") * 2).alias("edge_seq"),
    )
    if file_ids is not None:
        inside = t.join(file_ids.select(F.col("path").alias("source_file"), F.col("id").alias("file_id")), "source_file")
        edges = edges.unionByName(
            inside.select(
                F.col("file_id").alias("src"), F.col("from_id").alias("dst"), F.lit("CONTAINS").alias("type"), "source_file", F.lit(None).cast("int").alias("line"),
                F.lit(None).cast("string").alias("receiver"), F.lit(None).cast("string").alias("receiver_type"), (F.col("seq") * 2 + 1).alias("edge_seq"),
            )
        )
    return edges


def without_file(nodes: DataFrame, edges: DataFrame, file: str, file_node: bool = False) -> tuple[DataFrame, DataFrame]:
    """The graph without a file's entities, and without the file's node if asked."""
    gone = (F.col("type") == "Entity") & (F.col("file") == file)
    if file_node:
        gone = gone | ((F.col("type") == "File") & (F.col("path") == file))
    ids = nodes.filter(gone).select("id")
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.filter(~F.coalesce(gone, F.lit(False))), left.select(*edges.columns)


def rebuilt_nodes(old: DataFrame, new: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The full outer join of a rebuild: new nodes, with what only old ones know; old nodes
    that are gone only if an agent made them and their file, if any, is still there."""
    columns = [c for c in new.columns if c != "id"]
    o = old.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = new.withColumn("_new", F.lit(True)).join(o, F.col("id") == F.col("_id"), "full_outer")
    kept = F.col("_new") | F.coalesce(F.col("_agent_created"), F.lit(False)) if "agent_created" in columns else F.col("_new")
    if files is not None and "file" in columns:
        both = both.join(files.select(F.col("path").alias("_file"), F.lit(True).alias("_there")).distinct(), "_file", "left")
        kept = F.col("_new") | (F.coalesce(F.col("_agent_created"), F.lit(False)) & ((blank(F.col("_file")) == "") | F.col("_there")))
    return both.filter(F.coalesce(kept, F.lit(False))).select(F.coalesce("id", "_id").alias("id"), *[F.coalesce(c, f"_{c}").alias(c) for c in columns])


def rebuilt_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """New edges and the agents' old ones whose ends still exist, then overrides."""
    ends = nodes.select("id")
    agents = old.filter("agent_inferred").join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return overridden(new.unionByName(agents, allowMissingColumns=True))


def overridden(edges: DataFrame) -> DataFrame:
    """Without the edges of a pair whose relation an agent has changed to another type."""
    said = edges.filter("agent_relation").select("src", "dst", F.col("type").alias("said")).distinct()
    wrong = edges.filter("not coalesce(agent_relation, false)").join(said, ["src", "dst"]).filter("type <> said").select("src", "dst", "type").distinct()
    plain = edges.filter("not coalesce(agent_relation, false)").join(wrong, ["src", "dst", "type"], "left_anti").select(*edges.columns)
    return plain.unionByName(edges.filter("agent_relation"))
