"""What agents write into a graph: entities and edges that extraction can't see, and corrections.

Requests are tables, so many are answered at once: each gets a status, and what is told
becomes a ``Changes`` of the rows that differ, which a log can keep and a graph can be
rebuilt with. Requests of one table are answered on the graph before it; of several that
write the same, the last one counts, in the order of a column ``nth`` if there is one. An
end of an edge means the entity of its name in the project, in the given file if there is
one. Entities without a file (buckets and modules from outside) count only where
``IMPORTS`` may lead to them. Of several nothing is guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.columns import blank, entity_id, language_of, relation_name
from graphloom.operators.changes import EDGE_FLAGS, KEY, NODE_FLAGS, Changes, flag, with_columns
from graphloom.operators.lookup import Values, having, sought
from graphloom.operators.traverse import LOOKUP_ROWS, small
from graphloom.scratch import counted, written

_ASKED = {"caller": "string", "callee": "string", "relation": "string", "caller_file": "string", "callee_file": "string", "line": "int"}
_ENTITY = {"name": "string", "file": "string", "id": "string", "kind": "string", "line": "int", "description": "string", "language": "string", "text": "string", "nth": "bigint"}
#: Relations that only the parser writes.
PARSER_OWNED = ("CONTAINS", "DEFINED_IN")


def named(graph, name: str, file: str = "") -> DataFrame:
    """(id, file) of the project's entities of a name, in a file if one is given."""
    own = graph.entities().filter((F.col("project") == graph.project) & (F.col("name") == name))
    return own.filter(F.col("file") == file).select("id", "file") if file else own.select("id", "file")


def candidates(graph, name: str) -> list[dict]:
    """What a name may mean: its entities with a file, for a request that says which."""
    return [{"id": r["id"], "file": r["file"]} for r in named(graph, name).filter(blank(F.col("file")) != "").orderBy("file", "id").collect()]


def _ends(own: DataFrame, rows: DataFrame, end: str, outside: Column) -> DataFrame:
    """``rows`` with ``{end}_id``, if the end means one of the entities ``own``, and ``{end}_n``, how many of its name have a file.

    Each table that is joined has one row for its key, so that no name multiplies requests.
    """
    by_name = own.groupBy(F.col("name").alias(end)).agg(
        F.count_if("inside").alias("_in"), F.min(F.when(F.col("inside"), F.col("id"))).alias("_in_id"),
        F.count_if(~F.col("inside")).alias("_out"), F.min(F.when(~F.col("inside"), F.col("id"))).alias("_out_id"),
    )
    by_file = own.filter("inside").groupBy(F.col("name").alias(end), F.col("file").alias(f"{end}_file")).agg(F.count("*").alias("_file"), F.min("id").alias("_file_id"))
    both = rows.join(by_name, end, "left").join(by_file, [end, f"{end}_file"], "left").fillna(0, ["_in", "_out", "_file"])
    anywhere = blank(F.col(f"{end}_file")) == ""
    matches = F.when(anywhere, F.col("_in") + F.when(outside, F.col("_out")).otherwise(0)).otherwise(F.col("_file"))
    found = F.when(anywhere, F.coalesce("_in_id", F.when(outside, F.col("_out_id")))).otherwise(F.col("_file_id"))
    return both.withColumn(f"{end}_id", F.when(matches == 1, found)).withColumn(f"{end}_n", F.col("_in")).drop("_in", "_in_id", "_out", "_out_id", "_file", "_file_id")


def _answered(graph, asked: DataFrame, outside: Column) -> DataFrame:
    """Requests with their relation's type and their ends; the entities of all their names are looked up once."""
    rows = written(with_columns(asked, _ASKED).withColumn("type", relation_name(F.col("relation"))), "requests")
    own = graph.entities().filter(F.col("project") == graph.project).select("id", "name", "file")
    own = having(own, "name", sought(rows.select("caller").union(rows.select("callee")))).withColumn("inside", blank(F.col("file")) != "")
    own = written(own, "named")
    return written(_ends(own, _ends(own, rows, "caller", F.lit(False)), "callee", outside), "asked")


def _unclear(callee_may_be_new: Column) -> Column:
    """The status of requests whose relation or ends say nothing definite; null for the others."""
    return (
        F.when(F.col("type").isNull(), "skipped")
        .when(F.col("caller_id").isNull(), F.when(F.col("caller_n") > 0, "ambiguous").otherwise("skipped"))
        .when(F.col("callee_id").isNull() & ~callee_may_be_new, F.when(F.col("callee_n") > 0, "ambiguous").otherwise("skipped"))
    )


def _touching(graph, pairs: DataFrame) -> DataFrame:
    """The graph's edges between pairs of nodes (src, dst): what is stored is scanned past them while they are few."""
    edges = with_columns(graph.edges, EDGE_FLAGS)
    pairs, rows = counted(pairs.filter("src is not null and dst is not null").distinct(), "pairs")
    if rows <= LOOKUP_ROWS:
        edges = edges.filter(F.col("src").isin(sorted({r["src"] for r in pairs.select("src").collect()})))
    return edges.join(small(pairs, rows), ["src", "dst"], "left_semi").select(*edges.columns)


def _present(graph, rows: DataFrame) -> DataFrame:
    """(caller_id, callee_id, type, there, own): the edges between the ends of requests, and whether agents made some."""
    edges = _touching(graph, rows.select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst")))
    return edges.groupBy(F.col("src").alias("caller_id"), F.col("dst").alias("callee_id"), "type").agg(F.lit(True).alias("there"), F.bool_or(flag("agent_inferred")).alias("own"))


# --- edges -------------------------------------------------------------------


def added_calls(graph, asked: DataFrame) -> DataFrame:
    """(caller, callee, relation, their files, status, side, src, dst, type, line) of edges asked for by names (caller, callee,
    relation, and perhaps caller_file, callee_file, line).

    ``added``; ``exists`` if there is an equal edge, also from a request before; ``ambiguous``
    with the side that has several entities; ``skipped`` for what isn't there, and for the
    parser's own relations. An import of a name that isn't there leads to a new module.
    """
    imports = F.coalesce(F.col("type") == "IMPORTS", F.lit(False))
    rows = _answered(graph, asked, imports)
    new_module = imports & F.col("callee_id").isNull() & (F.col("callee_n") == 0)
    rows = rows.withColumn("unclear", _unclear(new_module)).withColumn("callee_id", F.coalesce("callee_id", F.when(new_module, F.concat_ws(":", F.lit(graph.project), "callee"))))
    rows = rows.join(_present(graph, rows).select("caller_id", "callee_id", "type", "there"), ["caller_id", "callee_id", "type"], "left")
    same = Window.partitionBy("caller_id", "callee_id", "type", "unclear").orderBy(F.monotonically_increasing_id())
    status = F.coalesce("unclear", F.when(F.col("there") | (F.col("_nth") > 1), "exists").otherwise("added"))
    side = F.when(F.col("unclear") == "ambiguous", F.when(F.col("caller_id").isNull(), "caller").otherwise("callee"))
    rows = rows.withColumn("_nth", F.when(F.col("unclear").isNull(), F.row_number().over(same)).otherwise(1))
    return rows.select("caller", "callee", "relation", "caller_file", "callee_file", status.alias("status"), side.alias("side"), F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), "type", "line")


def call_changes(graph, told: DataFrame) -> Changes:
    """The edges of ``added_calls`` whose status is ``added``, and the modules that they lead to."""
    nodes, new = with_columns(graph.nodes, NODE_FLAGS), told.filter("status = 'added'")
    callers = having(nodes.select("id", "file", "language"), "id", sought(new.select("src")))
    new = new.join(callers.select(F.col("id").alias("src"), F.col("file").alias("source_file"), "language"), "src", "left")
    own = new.select(*KEY, "source_file", "line", F.lit(False).alias("resolved"), F.lit(True).alias("agent_inferred"))
    modules = new.filter("type = 'IMPORTS'").groupBy(F.col("dst").alias("id")).agg(F.min("callee").alias("name"), F.min("language").alias("language"))
    modules = modules.join(having(nodes.select("id"), "id", sought(modules.select("id"))), "id", "left_anti").select(
        "id", "name", "language", F.lit("Entity").alias("type"), F.lit(graph.project).alias("project"), F.lit("module").alias("entity_type"),
        F.concat_ws(":", F.lit("module"), F.nullif(F.col("language"), F.lit(""))).alias("kind"), F.lit(True).alias("agent_inferred"), F.lit(True).alias("agent_created"),
    )
    return Changes(nodes=modules, edges=own)


def with_calls(graph, told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with what ``call_changes`` adds."""
    new = call_changes(graph, told)
    return with_columns(graph.nodes, NODE_FLAGS).unionByName(new.nodes, allowMissingColumns=True), with_columns(graph.edges, EDGE_FLAGS).unionByName(new.edges, allowMissingColumns=True)


def removed_calls(graph, asked: DataFrame) -> DataFrame:
    """(caller, callee, relation, status, src, dst, type) of edges to remove by names.

    Only edges that agents made go: ``removed``; ``not_found`` if there is none of the type,
    ``skipped`` if it is the parser's, or an end isn't there, ``ambiguous`` if it is several.
    """
    rows = _answered(graph, asked, F.lit(True))
    rows = rows.join(_present(graph, rows), ["caller_id", "callee_id", "type"], "left")
    of_edge = F.when(F.col("there").isNull(), "not_found").when(F.col("own"), "removed").otherwise("skipped")
    return rows.select("caller", "callee", "relation", F.coalesce(_unclear(F.lit(False)), of_edge).alias("status"), F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), "type")


def _replaced(edges: DataFrame, left: DataFrame) -> Changes:
    """All edges of the keys of some go, and those that are left of them come again."""
    return Changes(edges=edges.select(*KEY).distinct().withColumn("gone", F.lit(True)).unionByName(left.withColumn("gone", F.lit(False)), allowMissingColumns=True))


def removal_changes(graph, told: DataFrame) -> Changes:
    """The agents' edges of ``removed_calls`` that go; the parser's beside them stay."""
    gone = told.filter("status = 'removed'").select(*KEY).distinct()
    # written, as the type is what edges are stored by, and Spark would look up its values while it plans to sample
    edges = written(_touching(graph, gone.select("src", "dst")), "touching").join(gone, list(KEY), "left_semi")
    return _replaced(edges, edges.filter(~flag("agent_inferred")))


def modified_relations(graph, asked: DataFrame) -> DataFrame:
    """(caller, callee, relation, status, src, dst, old, type, n) for pairs of names whose relation gets another type.

    ``relation`` is the new type, ``from_relation`` the old one, if the pair has several;
    without it these are ``ambiguous``. The new type then overrides the parser's.
    """
    rows = _answered(graph, with_columns(asked, {"from_relation": "string"}), F.lit(True)).withColumn("wanted", relation_name(F.col("from_relation")))
    types = _touching(graph, rows.select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"))).groupBy(*KEY).agg(F.count("*").alias("n"))
    types = types.groupBy(F.col("src").alias("caller_id"), F.col("dst").alias("callee_id")).agg(F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("types"))
    rows = rows.join(types, ["caller_id", "callee_id"], "left")
    named_type = blank(F.col("from_relation")) != ""
    old = F.when(named_type, F.col("wanted")).when(F.size("types") == 1, F.element_at(F.map_keys("types"), 1))
    n = F.try_element_at(F.coalesce("types", F.expr("cast(map() as map<string,bigint>)")), old)
    of_pair = F.when(F.col("types").isNull() | (named_type & n.isNull()), "not_found").when(old.isNull(), "ambiguous").otherwise("modified")
    status = F.coalesce(_unclear(F.lit(False)), of_pair)
    return rows.select("caller", "callee", "relation", status.alias("status"), F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), old.alias("old"), "type", n.alias("n"))


def relation_changes(graph, told: DataFrame) -> Changes:
    """The edges of ``modified_relations``, with their new type."""
    chosen = told.filter("status = 'modified'").groupBy("src", "dst", F.col("old").alias("type")).agg(F.min("type").alias("_new"))
    edges = written(_touching(graph, chosen.select("src", "dst")), "touching").join(chosen, list(KEY))
    return _replaced(edges.drop("_new"), edges.withColumns({"type": F.col("_new"), "agent_inferred": F.lit(True), "agent_relation": F.lit(True)}).drop("_new"))


# --- entities ----------------------------------------------------------------


def _meant(graph, asked: DataFrame, of_id: bool = True) -> DataFrame:
    """Requests (name, and perhaps file or id) with ``n``, the number of the nodes that they mean, and ``found``, the only one."""
    rows = with_columns(asked, _ENTITY).withColumn("nth", F.coalesce("nth", F.monotonically_increasing_id()))
    own = graph.entities().filter(F.col("project") == graph.project).select("id", "name", "file")
    own = having(own, "name", sought(rows.filter(blank(F.col("id")) == "").select("name")))
    by_name = own.groupBy("name").agg(F.count("*").alias("_all"), F.min("id").alias("_all_id"))
    by_file = own.filter(blank(F.col("file")) != "").groupBy("name", "file").agg(F.count("*").alias("_file"), F.min("id").alias("_file_id"))
    rows = rows.join(by_name, "name", "left").join(by_file, ["name", "file"], "left")
    if "id" in asked.columns:
        by_id = having(graph.nodes.select("id"), "id", sought(rows.filter(blank(F.col("id")) != "").select("id"))).withColumn("_there", F.lit(1))
        rows = rows.join(by_id, "id", "left")
    else:
        rows = rows.withColumn("_there", F.lit(None).cast("int"))
    given, anywhere = (blank(F.col("id")) != "") if of_id else F.lit(False), blank(F.col("file")) == ""
    n = F.when(given, F.col("_there")).when(anywhere, F.col("_all")).otherwise(F.col("_file"))
    found = F.when(given, F.col("id")).when(anywhere, F.col("_all_id")).otherwise(F.col("_file_id"))
    rows = rows.withColumn("n", F.coalesce(n, F.lit(0)).cast("bigint"))
    return rows.withColumn("found", F.when(F.col("n") == 1, found)).drop("_all", "_all_id", "_file", "_file_id", "_there")


def added_entities(graph, asked: DataFrame) -> DataFrame:
    """(name, file, status, found, ...) of entities to add (name, and perhaps kind, file, line, description, language).

    ``created`` if nothing of the name (in the file) is there, ``updated`` if one is, or a
    request before creates it, else ``ambiguous``. ``found`` is the node.
    """
    rows = _meant(graph, asked.drop("id"), of_id=False)
    own = entity_id(F.lit(graph.project), F.col("file"), F.col("name"), F.lit(None).cast("string"))
    rows = rows.withColumn("found", F.when(F.col("n") == 0, own).otherwise(F.col("found")))
    first = F.row_number().over(Window.partitionBy("found").orderBy("nth"))
    status = F.when(F.col("n") > 1, "ambiguous").when((F.col("n") == 0) & (F.col("_first") == 1), "created").otherwise("updated")
    return rows.withColumn("_first", first).withColumn("status", status).drop("_first", "id", "text")


def entity_changes(graph, told: DataFrame) -> Changes:
    """The nodes of ``added_entities``: new ones, and old ones with what was given; an empty description leaves the one there."""
    given = lambda c: F.when(blank(F.col(c)) != "", F.col(c))
    language = F.coalesce(given("language"), F.when(blank(F.col("file")) != "", F.nullif(language_of(F.col("file")), F.lit("unknown"))))
    kind = F.coalesce("kind", F.lit("function"))
    whole = F.when(~kind.contains(":") & (blank(F.col("_language")) != ""), F.concat_ws(":", kind, "_language")).otherwise(kind)
    rows = told.filter("status <> 'ambiguous'").withColumn("_language", language)
    values = {"entity_type": F.substring_index(kind, ":", 1), "kind": whole, "language": F.col("_language"), "file": given("file"), "description": F.nullif(F.trim("description"), F.lit("")), "line": F.when(F.col("line") != 0, F.col("line"))}
    said = rows.select(F.col("found").alias("id"), "name", "n", "nth", *[v.alias(f"_{c}") for c, v in values.items()])
    last = [F.max_by(f"_{c}", F.when(F.col(f"_{c}").isNotNull(), F.col("nth"))).alias(f"_{c}") for c in values]
    said = said.groupBy("id").agg(F.min("name").alias("_name"), F.max("n").alias("_n"), *last)
    nodes = with_columns(graph.nodes, NODE_FLAGS)
    old = having(nodes, "id", sought(said.filter("_n = 1").select("id"))).join(said, "id").withColumns({c: F.coalesce(f"_{c}", c) for c in values}).select(*nodes.columns)
    new = said.filter("_n = 0").select(
        "id", F.lit("Entity").alias("type"), F.col("_name").alias("name"), F.lit(graph.project).alias("project"), *[F.col(f"_{c}").alias(c) for c in values], F.lit(True).alias("agent_inferred"), F.lit(True).alias("agent_created")
    )
    return Changes(nodes=old.unionByName(new, allowMissingColumns=True))


def deleted_entities(graph, asked: DataFrame) -> DataFrame:
    """(name, file, status, found, removed) of entities to delete (name and perhaps file, or id).

    A node that agents made is ``deleted`` with its edges; any other is ``stripped`` of its
    description, its flag and its edges that agents made; ``removed`` tells of what.
    """
    rows = written(_meant(graph, asked), "meant")
    nodes, meant = with_columns(graph.nodes, NODE_FLAGS).select("id", "agent_created", "agent_inferred", "description"), sought(rows.select("found").dropna())
    own = written(having(nodes, "id", meant), "own").withColumnRenamed("id", "found").withColumnsRenamed({"description": "_said"})
    touching = written(_edges_of(graph, meant).filter(flag("agent_inferred")).select("src", "dst"), "touching")
    ends = touching.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("found")).groupBy("found").agg(F.count("*").alias("_edges"))
    rows = rows.drop("description").join(own, "found", "left").join(ends, "found", "left")
    status = F.when(F.col("n") == 0, "not_found").when(F.col("n") > 1, "ambiguous").when(flag("agent_created"), "deleted").otherwise("stripped")
    parts = [F.when(blank(F.col("_said")) != "", "description"), F.when(flag("agent_inferred"), "agent_inferred"), F.concat(F.coalesce("_edges", F.lit(0)).cast("string"), F.lit(" agent edge(s)"))]
    return rows.withColumn("status", status).withColumn("removed", F.when(F.col("status") == "stripped", F.array_compact(F.array(*parts)))).select("name", "file", "id", "nth", "n", "found", "status", "removed")


def _edges_of(graph, ids: Values) -> DataFrame:
    """The edges that begin or end at some nodes, once each: two lookups, each in the order that suits it."""
    edges = with_columns(graph.edges, EDGE_FLAGS)
    into = edges if graph.into is None else with_columns(graph.into, EDGE_FLAGS).select(*edges.columns)
    out, inside = having(edges, "src", ids), having(into, "dst", ids)
    if ids.few is not None:
        return out.unionByName(inside.filter(~F.coalesce(F.col("src").isin(ids.few), F.lit(False))))
    return out.unionByName(inside.join(small(ids.table.toDF("src"), ids.rows), "src", "left_anti").select(*edges.columns))


def deletion_changes(graph, told: DataFrame) -> Changes:
    """What goes with the entities of ``deleted_entities``, and what is stripped."""
    sure = written(told.filter("status in ('deleted', 'stripped')").select(F.col("found").alias("id"), (F.col("status") == "deleted").alias("own")).distinct(), "sure")
    nodes = with_columns(graph.nodes, NODE_FLAGS)
    blanked = {c: F.lit(None).cast(nodes.schema[c].dataType) for c in ("description", "agent_inferred")}
    kept = having(nodes, "id", sought(sure.filter("not own").select("id"))).withColumns(blanked).withColumn("gone", F.lit(False))
    gone = sure.filter("own").select("id", F.lit(True).alias("gone"))
    edges = written(_edges_of(graph, sought(sure.select("id"))), "touching")
    ends = sure.select("id", "own")
    for end in ("src", "dst"):
        edges = edges.join(ends.toDF(end, f"_{end}"), end, "left")
    away = F.coalesce("_src", F.lit(False)) | F.coalesce("_dst", F.lit(False)) | flag("agent_inferred")
    keys = edges.filter(away).select(*KEY).distinct()
    left = edges.join(keys, list(KEY), "left_semi").filter(~away).drop("_src", "_dst")
    drop = keys.withColumn("gone", F.lit(True)).unionByName(left.withColumn("gone", F.lit(False)), allowMissingColumns=True)
    return Changes(nodes=kept.unionByName(gone, allowMissingColumns=True), edges=drop)


def described(graph, asked: DataFrame) -> DataFrame:
    """(name, file, status, found, text) of descriptions to set (text, and name, perhaps file, or id): ``updated``, ``cleared`` if the
    text is blank, ``not_found`` or ``ambiguous``; no other field changes."""
    rows = _meant(graph, asked)
    status = F.when(F.col("n") == 0, "not_found").when(F.col("n") > 1, "ambiguous").when(blank(F.trim("text")) == "", "cleared").otherwise("updated")
    return rows.withColumn("status", status).select("name", "file", "id", "nth", "n", "found", "text", "status")


def description_changes(graph, told: DataFrame) -> Changes:
    """The nodes of ``described``, the last text of each."""
    said = told.filter("status in ('updated', 'cleared')").groupBy(F.col("found").alias("id")).agg(F.max_by(F.struct(F.nullif(F.trim("text"), F.lit("")).alias("text")), "nth").alias("_said"))
    nodes = with_columns(graph.nodes, NODE_FLAGS)
    return Changes(nodes=having(nodes, "id", sought(said.select("id"))).join(said, "id").withColumn("description", F.col("_said.text")).select(*nodes.columns))


# --- requests of one row -----------------------------------------------------


def one(graph, **fields) -> DataFrame:
    """A table of one request."""
    kinds = _ASKED | {"from_relation": "string"} | _ENTITY
    schema = ", ".join(f"{k} {kinds[k]}" for k in fields)
    return graph.nodes.sparkSession.createDataFrame([tuple(fields.values())], schema)


def answer(graph, told: DataFrame) -> dict:
    """The answer to a table of one request for an edge, with candidates if it is ambiguous."""
    row = told.first().asDict()
    out = {k: row[k] for k in ("status", "side", "relation", "old", "type", "n") if row.get(k) is not None}
    if row["status"] == "ambiguous" and row.get("src") is None:
        out |= {"side": "caller", "candidates": candidates(graph, row["caller"])}
    elif row["status"] == "ambiguous" and row.get("dst") is None:
        out |= {"side": "callee", "candidates": candidates(graph, row["callee"])}
    elif row["status"] == "ambiguous":
        pair = graph.edges.filter((F.col("src") == row["src"]) & (F.col("dst") == row["dst"]))
        out["candidates"] = [{"relation": r["type"]} for r in pair.select("type").distinct().orderBy("type").collect()]
    elif row["status"] == "skipped":
        missing = [n for n, i in ((row["caller"], row["src"]), (row["callee"], row["dst"])) if i is None]
        owned = f"the relation is empty or one of {', '.join(PARSER_OWNED)}"
        out["reason"] = owned if row["type"] is None else f"{missing[0]!r} isn't there" if missing else "the edge is the parser's"
    else:
        out |= {"from": row["src"], "to": row["dst"]}
    return out


def entity_answer(graph, told: DataFrame) -> dict:
    """The answer to a table of one request for an entity."""
    row = told.first().asDict()
    status, name = row["status"], row["name"]
    if status == "not_found":
        return {"status": status, "id" if row.get("id") else "name": row.get("id") or name}
    if status == "ambiguous":
        return {"status": status, "reason": f"several entities are named {name!r}: say the file or the id", "candidates": candidates(graph, name)}
    out = {"status": status, "id": row["found"]}
    return out | ({"removed": row["removed"], "reason": "the parser makes this node again"} if status == "stripped" else {})
