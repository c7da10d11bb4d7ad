"""Registered queries of the building side: extraction, resolution, write-back, rebuild and pictures.

The driver's tables stand in for what such a build meets: customers are classes, orders
methods of their customer, lines calls of a method name, perhaps with a receiver's class.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.columns import looks_like_entry, stable_uuid
from graphloom.operators import mutate, render, writeback
from graphloom.operators.changes import EDGE_FLAGS, applied, with_columns
from graphloom.operators.graph import Graph
from graphloom.plans import star
from graphloom.plans.registered import query
from graphloom.scratch import written
from graphloom.sources import ignore
from graphloom.sources.extract import registry
from graphloom.sources.hierarchy import hierarchy

_PATHS = "regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"


# --- triples and their graph -------------------------------------------------

_FILE = "concat(path, '/', c_custkey % 7, '.py')"
_TRIPLES = {
    "customer join f on c_nationkey = n_nationkey": f"""10000000000 + c_custkey as seq, c_name as from_entity, 'class' as from_type, 'DEFINED_IN' as relation_type, concat('pkg.', n_name) as to_entity,
  'module' as to_type, {_FILE} as source_file, cast(c_custkey % 90 as int) as line_number, cast(null as varchar(99)) as call_receiver, cast(null as varchar(99)) as call_receiver_type,
  c_custkey % 3 = 0 as is_exported, cast(null as varchar(99)) as owner_class""",
    "orders join customer on o_custkey = c_custkey join f on c_nationkey = n_nationkey": f"""20000000000 + o_orderkey, concat('op_', o_orderkey % 700), 'function', 'DEFINED_IN', concat('pkg.', n_name),
  'module', {_FILE}, cast(o_orderkey % 1000 as int), null, null, o_orderstatus = 'O', c_name""",
    """lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join f on c_nationkey = n_nationkey
  left join (select c_custkey as w_key, c_name as w_name from customer) w on w_key = l_suppkey and l_linenumber % 3 = 0""": f"""1000000000000 + l_orderkey * 16 + l_linenumber, concat('op_', l_orderkey % 700), 'function', 'CALLS',
  concat('op_', l_partkey % 900), 'function', {_FILE}, l_linenumber, 'x', w_name, false, c_name""",
}
_F = "f as (select n_nationkey, n_name, r_name || '/' || n_name as path from nation join region on n_regionkey = r_regionkey)"
_T = "t as (" + " union all ".join(f"select {what} from {where}" for where, what in _TRIPLES.items()) + ")"
_OWN = "concat('p:', source_file, ':', case when owner_class is null then '' else concat(owner_class, '.') end, from_entity)"


def _resolved(t: str) -> str:
    """SQL of the triples' ends, of triples that ``t`` tells."""
    return f"""{_F}, {t}, d as (select *, {_OWN} as id from t where relation_type = 'DEFINED_IN'),
o as (select from_entity as n, owner_class as c, arg_min(id, seq) as owner_id from d where owner_class is not null group by all),
h as (select from_entity as c, arg_min(source_file, seq) as home from d where from_type = 'class' group by all),
b as (select from_entity as n, source_file as home, arg_min(id, seq) as home_id from d group by all),
u as (select from_entity as n, min(id) as only_id from d group by all having count(*) = 1),
r as (select t.*, {_OWN} as from_id, case when relation_type = 'DEFINED_IN' then 'p:' || to_entity else coalesce(owner_id, home_id, only_id, 'p:' || to_entity) end as to_id
  from t left join o on o.n = to_entity and o.c = call_receiver_type left join h on h.c = call_receiver_type left join b on b.n = to_entity and b.home = h.home left join u on u.n = to_entity)"""


_RESOLVED = _resolved(_T)


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of the tables; the same text is their SQL."""
    names = "customer", "orders", "lineitem"
    for name, df in zip(names, star.tables(spark, sf_dir, *names), strict=True):
        df.createOrReplaceTempView(f"graphloom_{name}")
    star.files(spark, sf_dir).createOrReplaceTempView("graphloom_f")
    text = " union all ".join(f"select {what} from {where}" for where, what in _TRIPLES.items())
    return spark.sql("with " + ", ".join(f"{n} as (select * from graphloom_{n})" for n in (*names, "f")) + " " + text)


@query(f"with {_RESOLVED} select seq, from_id, to_id from r")
def resolved_calls(spark, sf_dir):
    """What every triple's ends are: definitions by owner, by the class's file, the only one, or the bucket of a name."""
    return mutate.resolved_triples(triples(spark, sf_dir), "p").select("seq", "from_id", "to_id")


def _built(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of the triples, without a hierarchy."""
    return Graph(*mutate.graph_of(triples(spark, sf_dir), "p"), "p")


_SIDES_OF = """s as (
  select from_id as id, seq, 0 as side, from_entity as name, from_type as entity_type, 'python' as language, source_file as file,
         case when relation_type = 'DEFINED_IN' and line_number > 0 then line_number end as line, owner_class as owner, is_exported from r
  union all select to_id, seq, 1, to_entity, to_type, '', null, case when relation_type = 'DEFINED_IN' and to_type = 'module' then 1 end, null, null from r)"""
_SIDES = f"{_RESOLVED}, {_SIDES_OF}"


def _settled(c: str) -> str:
    return f"coalesce(arg_max({c}, seq) filter (where side = 0 and {c} is not null), arg_min({c}, seq) filter (where side = 1 and {c} is not null)) as {c}"


@query(f"""with {_SIDES}, n as (select id, {", ".join(_settled(c) for c in ("name", "entity_type", "language", "file", "line", "owner"))}, coalesce(bool_or(is_exported), false) as is_exported,
  min(seq * 2 + side) as node_seq from s group by id)
select id, name, entity_type, case when language = '' then entity_type else entity_type || ':' || language end as kind, file, line, owner, is_exported, node_seq from n""")  # fmt: skip
def graph_nodes(spark, sf_dir):
    """Nodes of the triples: the last from-side, the first to-side, and exported once said."""
    return _built(spark, sf_dir).nodes.select("id", "name", "entity_type", "kind", "file", "line", "owner", "is_exported", "node_seq")


@query(f"""with {_RESOLVED} select from_id as src, to_id as dst, relation_type as type, source_file, line_number as line, call_receiver_type as receiver_type, seq * 2 as edge_seq from r
union all select 'file:' || source_file, from_id, 'CONTAINS', source_file, null, null, seq * 2 + 1 from r""")
def graph_edges(spark, sf_dir):
    """An edge for each triple, and one from its file."""
    t = triples(spark, sf_dir)
    ids = t.select(F.col("source_file").alias("path"), F.concat(F.lit("file:"), "source_file").alias("id")).distinct()
    return mutate.graph_of(t, "p", ids)[1].select("src", "dst", "type", "source_file", "line", "receiver_type", "edge_seq")


# --- extraction ----------------------------------------------------------------


@query("""select concat('s', p_partkey, '.css') as file, 'USES_VAR' as relation_type, concat('--c', p_size) as name from part
union all select concat('s', p_partkey, '.css'), 'DEFINED_IN', concat('--b', p_size % 5) from part
union all select concat('s', p_partkey, '.css'), 'IMPORTS', concat('./', replace(p_brand, '#', '_'), '.css') from part
union all select concat('s', p_partkey, '.css'), 'STYLES', 'button' from part union all select concat('s', p_partkey, '.css'), 'STYLES', 'a' from part""")
def sheet_relations(spark, sf_dir):
    """Extraction of a style sheet for each part."""
    css = """concat('@import "./', replace(p_brand, '#', '_'), '.css"; /* a { --no: 1 } */ button .x > a { color: var(--c', p_size, '); background: var( --c', p_size, '); } :root { --b', p_size % 5, ': 1; }')"""
    sheets = star.tables(spark, sf_dir, "part")[0].selectExpr("concat('s', p_partkey, '.css') as path", f"{css} as content")
    found = registry.extract(sheets)
    name = F.when(F.col("relation_type") == "DEFINED_IN", F.col("from_entity")).otherwise(F.col("to_entity"))
    return found.select(F.col("source_file").alias("file"), "relation_type", name.alias("name"))


_CLASSES = r"""select page_id, unnest(regexp_extract_all(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'gs'), '<[a-zA-Z][^<>]*?\sclass="([^"]*)"', 1)) as c from pages"""


@query(f"select page_id, w as to_entity, count(*)::bigint as n from (select page_id, unnest(string_split_regex(trim(c), '\\s+')) as w from ({_CLASSES})) where w <> '' group by all")
def html_has_class(spark, sf_dir):
    """Extraction of every page: the classes that it uses."""
    pages = star.tables(spark, sf_dir, "pages")[0].select(F.concat("page_id", F.lit(".html")).alias("path"), F.col("html").alias("content"))
    found = registry.extract(pages).filter("relation_type = 'HAS_CLASS'")
    return found.groupBy(F.expr("cast(replace(source_file, '.html', '') as bigint)").alias("page_id"), "to_entity").agg(F.count("*").alias("n"))


_MODULE = "concat('m', c_custkey, '.py')"


@query(f"""select {_MODULE} as file, 'DEFINED_IN' as relation_type, concat('C', c_nationkey) as name, cast(null as varchar) as receiver_type from customer
union all select {_MODULE}, 'INHERITS', concat('B', c_nationkey), null from customer union all select {_MODULE}, 'DEFINED_IN', 'go', null from customer
union all select {_MODULE}, 'CALLS', 'step', concat('C', c_nationkey) from customer union all select {_MODULE}, 'CALLS', 'close', concat('D', c_nationkey % 3) from customer
union all select {_MODULE}, 'IMPORTS', concat('lib', c_nationkey), null from customer""")
def module_relations(spark, sf_dir):
    """Extraction of a Python module for each customer, with the types of receivers."""
    text = """concat('import lib', c_nationkey, '\\nclass C', c_nationkey, '(B', c_nationkey, '):\\n    def go(self):\\n        self.step()\\n        d = D', c_nationkey % 3, '()\\n        d.close()\\n')"""
    found = registry.extract(star.tables(spark, sf_dir, "customer")[0].selectExpr(f"{_MODULE} as path", f"{text} as content"))
    name = F.when(F.col("relation_type") == "DEFINED_IN", F.col("from_entity")).otherwise(F.col("to_entity"))
    return found.filter("not (relation_type = 'CALLS' and to_entity like 'D%')").select(
        F.col("source_file").alias("file"), "relation_type", name.alias("name"), F.col("call_receiver_type").alias("receiver_type")
    )


# --- paths -----------------------------------------------------------------------


def _uuid_sql(key: str) -> str:
    h = f"sha1(unhex('{uuid.NAMESPACE_DNS.hex}') || encode({key}))"
    digit = f"substr('89ab', (strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1, 1)"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {digit} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


@query(f"select r_regionkey, {_uuid_sql("'folder:star:' || r_name")} as id from region")
def stable_ids(spark, sf_dir):
    """Version 5 UUIDs of the regions' keys."""
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    return r.select("r_regionkey", stable_uuid(F.concat(F.lit("folder:star:"), "r_name")).alias("id"))


@query(f"""with p as (select distinct string_split({_PATHS}, '/') as p from pages where {_PATHS} <> ''),
a as (select distinct array_to_string(p[1:i], '/') as path, array_to_string(p[1:i - 1], '/') as up, case when i = len(p) then 'file' else 'folder' end as kind
  from (select p, unnest(range(1, len(p) + 1)) as i from p))
select {_uuid_sql("case when up = '' then 'project:pages' else 'folder:pages:' || up end")} as src, {_uuid_sql("kind || ':pages:' || path")} as dst from a""")
def hierarchy_edges(spark, sf_dir):
    """Containment of the pages' url paths, by ids."""
    paths = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.expr(_PATHS).alias("path")).filter("path <> ''")
    return hierarchy(paths, "pages")[1].select("src", "dst")


_DIRS = f"concat(case page_id % 5 when 0 then 'build/' when 1 then 'src/dist.py/' else '' end, {_PATHS})"


@query(f"""select page_id from pages where not regexp_matches({_DIRS}, '(^|/)(fr|build)(/|$)') and not regexp_matches({_DIRS}, '(^|/)[^/]*\\.html($|/)') and not starts_with({_DIRS}, 'src/dist.py/')""")
def ignore_filter(spark, sf_dir):
    """Paths that no pattern and no folder that is always skipped leaves out."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.filter(~ignore.ignored(F.expr(_DIRS), ["fr", "*.html", "src/dist.py"])).select("page_id")


_NATIONS = "select a.n_nationkey, a.n_name as spec_name, a.r_name as spec_region, b.path as from_file, a.path as target from f a join f b on b.n_nationkey = (a.n_nationkey + 1) % 25"


@query(f"with {_F.replace('select', 'select r_name,', 1)} select 'src/' || path || '.js' as importer, 'src/' || target || '.js' as target from ({_NATIONS.replace('b.path as from_file', 'b.path')})")
def importers_resolved(spark, sf_dir):
    """Imports by relative paths, dotted modules and a namespace map, as one join of paths."""
    f = star.files(spark, sf_dir)
    nodes = f.select(F.concat(F.lit("f"), "n_nationkey").alias("id"), F.lit("File").alias("type"), F.concat(F.lit("src/"), "path", F.lit(".js")).alias("path"), F.lit(None).cast("string").alias("name"))
    spec = F.expr("""case n_nationkey % 3 when 0 then concat('../', path) when 1 then replace(concat('src/', path), '/', '.') else concat('Star.', replace(path, '/', '.')) end""")
    spec = f.select(F.concat(F.lit("e"), "n_nationkey").alias("id"), F.lit("Entity").alias("type"), F.lit(None).cast("string").alias("path"), spec.alias("name"))
    edges = f.select(
        F.concat(F.lit("f"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("src"), F.concat(F.lit("e"), "n_nationkey").alias("dst"), F.lit("IMPORTS").alias("type"),
        ((F.col("n_nationkey") + 1) % 25).alias("by"),
    )
    edges = edges.join(f.select(F.col("n_nationkey").alias("by"), F.concat(F.lit("src/"), "path", F.lit(".js")).alias("source_file")), "by")
    return Graph(nodes.unionByName(spec), edges, "star").importers({"Star": "src/"})


# --- questions over graphs of their own -------------------------------------------


@query("select concat('x_', p_name) as selector, p_brand as source_file, p_size as line from part where p_type = (select p_type from part where p_partkey = 42)")
def styles(spark, sf_dir):
    """The selectors that style an element: parts, and their types as elements."""
    part = star.tables(spark, sf_dir, "part")[0]
    element = part.filter("p_partkey = 42").first()["p_type"]
    node = lambda df, i, name, file, seq: df.selectExpr(f"{i} as id", "'Entity' as type", f"{name} as name", f"cast({file} as string) as file", "cast(null as string) as owner", "cast(null as string) as entity_type", "cast(null as string) as description", f"{seq} as node_seq")
    nodes = node(part, "concat('p', p_partkey)", "concat('x_', p_name)", "p_brand", "p_partkey").unionByName(node(part.select("p_type").distinct(), "concat('t', p_type)", "p_type", "null", "0"))
    edges = part.selectExpr("concat('p', p_partkey) as src", "concat('t', p_type) as dst", "'STYLES' as type", "p_size as line")
    return Graph(nodes, edges, "star").styles(element).select("selector", "source_file", "line")


_NODE_OF_PART = {"id": "concat('p', p_partkey)", "type": "'Entity'", "name": "p_name", "kind": "'class'", "entity_type": "'class'", "file": "p_brand", "project": "'star'", "line": "p_size", "description": "cast(null as string)"}


@query("""select p_name as name, p_brand as file, case when p_size % 4 = 0 then 'maybe_entrypoint' else 'dead' end as verdict from part
where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 45 and l_returnflag = 'R')""")
def dead_code_parts_filtered(spark, sf_dir):
    """Dead code over a graph whose only calls are some kind of lines."""
    part, lineitem = star.tables(spark, sf_dir, "part", "lineitem")
    nodes = part.selectExpr(*[f"{v} as {k}" for k, v in _NODE_OF_PART.items()], "p_size % 4 = 0 as is_exported")
    edges = lineitem.filter("l_quantity > 45 and l_returnflag = 'R'").selectExpr("'x' as src", "concat('p', l_partkey) as dst", "'CALLS' as type")
    return Graph(nodes, edges, "star").dead_code().select("name", "file", "verdict")


@query("""select 'doc_' || doc_id as name, regexp_extract(text, '(?i)(apache|mit) licen[cs]e') as match from documents where regexp_matches(text, '(?i)(apache|mit) licen[cs]e')""")
def grep_description(spark, sf_dir):
    """A regular expression over every document's whole text, as descriptions."""
    docs = star.tables(spark, sf_dir, "documents")[0]
    given = {"type": "'Entity'", "name": "concat('doc_', doc_id)", "kind": "'text'", "file": "source", "line": "1", "project": "'star'", "description": "text", "node_seq": "doc_id"}
    nodes = docs.selectExpr("concat('d', doc_id) as id", *[f"{v} as {k}" for k, v in given.items()])
    return Graph(nodes, nodes, "star").grep("(apache|mit) licen[cs]e", "description", limit=2**31 - 1).select("name", "match")


_ENTRIES = "concat(case event_id % 6 when 0 then 'run_' when 1 then 'Main' when 2 then '__' when 3 then 'test' when 4 then 'app' else '' end, case when event_id % 12 = 4 then '' else event_type end, case event_id % 6 when 2 then '__' else '' end)"


@query(f"""select name, name in ('main', 'app') or name like 'run\\_%' escape '\\' or name like 'Main%' or (name like '\\_\\_%\\_\\_' escape '\\' and length(name) > 4) as entry, n
from (select {_ENTRIES} as name, count(*)::bigint as n from events group by all)""")
def entry_points(spark, sf_dir):
    """Which names a runtime may call."""
    e = star.tables(spark, sf_dir, "events")[0].groupBy(F.expr(_ENTRIES).alias("name")).agg(F.count("*").alias("n"))
    return e.select("name", looks_like_entry(F.col("name"), F.lit("function")).alias("entry"), "n")


@query(f"""with {star.SQL} select 'c7' as id, 0 as depth union all select 'o' || o_orderkey, 1 from orders where o_custkey = 7""")
def flow_inside(spark, sf_dir):
    """A flow that keeps to entities with a file: the parts that lines call have none."""
    name = star.tables(spark, sf_dir, "customer")[0].filter("c_custkey = 7").first()["c_name"]
    return star.graph(spark, sf_dir).flow(name)[0].select("id", "depth")


def _flow_rows(spark: SparkSession, sf_dir: str) -> tuple[list[dict], list[dict]]:
    name = star.tables(spark, sf_dir, "customer")[0].filter("c_custkey = 7").first()["c_name"]
    return render.collected(*star.graph(spark, sf_dir).flow(name, include_external=True))


@query("""with o as (select o_orderkey as k from orders where o_custkey = 7),
e as (select 'c7' as "from", 'o' || k as "to", 0 as depth, 0 as caller, 0 as line, 30000000000 + k as seq from o
  union all select 'o' || l_orderkey, 'p' || l_partkey, 1, l_orderkey, arg_min(l_linenumber, l_linenumber), 40000000000 + l_orderkey * 16 + min(l_linenumber)
  from lineitem where l_orderkey in (select k from o) group by l_orderkey, l_partkey)
select "from", "to", row_number() over (order by depth, caller, line, seq, "to") as "order" from e""")
def flow_edge_order(spark, sf_dir):
    """The numbers of a flow's edges in the order in which they run."""
    edges = [(e["from"], e["to"], e["order"]) for e in render.ordered(*_flow_rows(spark, sf_dir))[0]]
    return spark.createDataFrame(edges, "`from` string, `to` string, `order` bigint")


@query("""with o as (select o_orderkey as k from orders where o_custkey = 7), n as (select 'c7' as id, 0 as depth union all select 'o' || k, 1 from o
  union select distinct 'p' || l_partkey, 2 from lineitem where l_orderkey in (select k from o))
select id, 40 + 260 * (row_number() over (partition by depth order by id) - 1) as x, (40 + 140 * depth)::bigint as y from n""")
def depth_layout(spark, sf_dir):
    """Where the nodes of a flow stand in its picture."""
    return spark.createDataFrame([(i, x, y) for i, (x, y) in render.places(_flow_rows(spark, sf_dir)[0]).items()], "id string, x bigint, y bigint")


# --- what agents write --------------------------------------------------------------

#: Requests over the star's graph: (caller, callee, relation), and what becomes of them but for repeated ones.
_ASKED = {
    "select c_name as caller, concat('order_', o_orderkey) as callee, 'CALLS' as relation from orders join customer on c_custkey = o_custkey": "exists",
    "select s_name, c_name, 'listens to' from supplier join customer on c_custkey = s_suppkey": "added",
    "select s_name, 'pandas', 'imports' from supplier": "added",
    "select s_name, 'pandas', 'CALLS' from supplier": "skipped",
    "select c_name, concat('order_', o_orderkey), 'contains' from orders join customer on c_custkey = o_custkey": "skipped",
    "select p_name, 'order_1', 'CALLS' from part": "skipped",
    "select s_name, p_name, 'REGISTERS' from supplier join part on p_partkey = s_suppkey": "skipped",
    "select 'nobody', c_name, 'CALLS' from customer": "skipped",
}


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name, df in zip(("customer", "orders", "supplier", "part"), star.tables(spark, sf_dir, "customer", "orders", "supplier", "part"), strict=True):
        df.createOrReplaceTempView(f"graphloom_{name}")
    return spark.sql("with " + ", ".join(f"{n} as (select * from graphloom_{n})" for n in ("customer", "orders", "supplier", "part")) + " " + " union all ".join(_ASKED))


@query(" union all ".join(f"select *, '{status}' as status from ({text.replace('select c_name,', 'select c_name as caller,', 1)}) as x(caller, callee, relation)" for text, status in _ASKED.items()))
def agent_edge_status(spark, sf_dir):
    """What becomes of edges that an agent writes by names."""
    return writeback.added_calls(star.graph(spark, sf_dir), _requests(spark, sf_dir)).select("caller", "callee", "relation", "status")


@query("""select 's' || s_suppkey as src, 'c' || c_custkey as dst, 'LISTENS_TO' as type, r_name || '/' || n_name as source_file from supplier join customer on c_custkey = s_suppkey
  join nation on n_nationkey = s_nationkey join region on n_regionkey = r_regionkey
union all select 's' || s_suppkey, 'star:pandas', 'IMPORTS', r_name || '/' || n_name from supplier join nation on n_nationkey = s_nationkey join region on n_regionkey = r_regionkey""")
def agent_edges_written(spark, sf_dir):
    """The edges that come of it."""
    g = star.graph(spark, sf_dir)
    told = written(writeback.added_calls(g, _requests(spark, sf_dir)).filter("status = 'added'"), "told")
    return writeback.with_calls(g, told)[1].filter("agent_inferred").select("src", "dst", "type", "source_file")


_METHODS = "select c_name as caller, concat('op_', o_orderkey % 900) as callee, case when o_orderkey % 2 = 0 then {file} end as callee_file from orders join customer on o_custkey = c_custkey join f on c_nationkey = n_nationkey"


@query(f"""with {_F}, {_T}, d as (select distinct {_OWN} as id, from_entity as n, source_file as file from t), w as ({_METHODS.format(file=_FILE)}),
m as (select w.*, (select count(*) from d where n = caller) as n1, (select count(*) from d where n = callee and (callee_file is null or file = callee_file)) as n2,
  (select count(*) from d where n = callee) as n_any, (select min(id) from d where n = callee and (callee_file is null or file = callee_file)) as dst from w),
s as (select *, case when n1 <> 1 then 'caller' when n2 <> 1 then 'callee' end as bad, row_number() over (partition by caller, dst, n1 = 1 and n2 = 1) as nth from m)
select caller, callee, callee_file, case when bad = 'caller' then case when n1 > 0 then 'ambiguous' else 'skipped' end when bad = 'callee' then case when n_any > 0 then 'ambiguous' else 'skipped' end
  when nth > 1 then 'exists' else 'added' end as status, count(*)::bigint as n from s group by all""")
def agent_ambiguous_names(spark, sf_dir):
    """Requests by names that many methods share, half of them with a file."""
    g = _built(spark, sf_dir)
    g = Graph(written(g.nodes, "built-nodes"), written(g.edges, "built-edges"), "p")
    orders, customer = star.tables(spark, sf_dir, "orders", "customer")
    own = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(star.files(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    asked = own.selectExpr("c_name as caller", "concat('op_', o_orderkey % 900) as callee", f"case when o_orderkey % 2 = 0 then {_FILE} end as callee_file", "'dispatches' as relation")
    told = writeback.added_calls(g, asked)
    return told.groupBy("caller", "callee", "callee_file", "status").agg(F.count("*").alias("n"))


_ALL_PAIRS = "select distinct o_custkey as src, l_suppkey as dst from orders join lineitem on l_orderkey = o_orderkey"


@query(f"""with p as ({_ALL_PAIRS}), a as (select src, dst, 'CALLS' as type, false as agent_relation from p union all select src, dst, 'REGISTERS', true from p where dst % 10 = 0)
select src, dst, type from a where agent_relation or not exists (select 1 from a b where b.src = a.src and b.dst = a.dst and b.agent_relation and b.type <> a.type)""")
def relation_override(spark, sf_dir):
    """A relation that an agent gave a pair of nodes drops the pair's other relations."""
    orders, lineitem = star.tables(spark, sf_dir, "orders", "lineitem")
    p = orders.join(lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    both = p.select("src", "dst", F.lit("CALLS").alias("type"), F.lit(False).alias("agent_relation")).unionByName(p.filter("dst % 10 = 0").select("src", "dst", F.lit("REGISTERS").alias("type"), F.lit(True).alias("agent_relation")))
    return mutate.overridden(both).select("src", "dst", "type")


@query("""select 'c' || o_custkey as src, 'o' || o_orderkey as dst, 'HANDLES' as type, true as agents from orders
union all select 'o' || l_orderkey, 'p' || l_partkey, 'CALLS', false from lineitem""")
def relations_modified_and_rebuilt(spark, sf_dir):
    """All calls of orders get another type, which then outlives a rebuild."""
    g = star.graph(spark, sf_dir)
    asked = star.tables(spark, sf_dir, "orders")[0].join(star.tables(spark, sf_dir, "customer")[0], F.col("o_custkey") == F.col("c_custkey"))
    asked = asked.select(F.col("c_name").alias("caller"), F.concat(F.lit("order_"), "o_orderkey").alias("callee"), F.lit("handles").alias("relation"), F.lit("calls").alias("from_relation"))
    old = applied(g.nodes, g.edges, writeback.relation_changes(g, written(writeback.modified_relations(g, asked), "told")))[1]
    new = with_columns(g.edges, EDGE_FLAGS).select(*old.columns)
    found = mutate.rebuilt_edges(old, new, g.nodes).filter("type in ('CALLS', 'HANDLES')")
    return found.select("src", "dst", "type", F.coalesce("agent_relation", F.lit(False)).alias("agents"))


@query(f"""with {star.SQL}, gone as (select id from nodes where file = 'AMERICA/NATION_6')
select type, count(*)::bigint as n, sum(edge_seq % 1000003)::bigint as total from edges where src not in (select id from gone) and dst not in (select id from gone) group by type""")
def edges_without_file(spark, sf_dir):
    """The edges that are left when a file's entities go."""
    g = star.graph(spark, sf_dir)
    edges = mutate.without_file(g.nodes, g.edges, "AMERICA/NATION_6")[1]
    return edges.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("edge_seq") % 1000003).alias("total"))
