"""Registered queries over the driver tables and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.columns import language_of, module_name, relation_name, vector_id, without_code_ending
from graphloom.operators import mutate, vectors
from graphloom.operators.graph import CALLERS, HOPS
from graphloom.operators.traverse import bfs
from graphloom.plans import building, keeping, star
from graphloom.plans.registered import ORACLE_SQL, QUERIES, query
from graphloom.sources.hierarchy import hierarchy
from graphloom.streaming.watch import compacted

__all__ = ["ORACLE_SQL", "QUERIES", "building", "flagship", "keeping"]

_PATHS = "regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"


def _walk(seed: str, edges: str, hops: int, reverse: bool = False, cte: str = "r") -> str:
    """Recursive SQL for (node, depth) from the nodes of ``seed`` along ``edges``; cte: its name."""
    here, there = ("dst", "src") if reverse else ("src", "dst")
    return f"""{cte}_all(node, depth) as (
  select id, 0 from ({seed}) union
  select e.{there}, {cte}_all.depth + 1 from {cte}_all join ({edges}) e on e.{here} = {cte}_all.node where {cte}_all.depth < {hops}
), {cte} as (select node, min(depth)::int as depth from {cte}_all group by node)"""


_CALLS = "select src, dst from edges where type in ('CALLS', 'USES_VAR', 'REFERENCES')"


# --- traversal -------------------------------------------------------------


@query(f"with recursive {star.SQL}, {_walk("select 'p42' as id", _CALLS, 3, True)} select node, depth from r")
def impact_part(spark, sf_dir):
    """What reaches a part by calls and references in three hops (flagship)."""
    calls = star.graph(spark, sf_dir).into.filter(F.col("type").isin(*CALLERS))
    return bfs(calls, spark.createDataFrame([("p42",)], "id string"), 3, reverse=True).select(F.col("id").alias("node"), "depth")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_part(spark, sf_dir)


_PART_NAME = "(select p_name from part where p_partkey = 42)"


@query(f"""with recursive {star.SQL}, {_walk("select id from nodes where type = 'Entity' and lower(name) = 'supplier#000000001' or name = (select s_name from supplier where s_suppkey = 1)", _CALLS, HOPS, True)}
select n.name as caller_name, n.entity_type as caller_type, n.file as caller_file, r.depth from r join nodes n on n.id = r.node where r.depth > 0""")  # fmt: skip
def impact_supplier(spark, sf_dir):
    """The callers of a supplier by its name."""
    name = spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_suppkey = 1").first()["s_name"]
    return star.graph(spark, sf_dir).impact(name).select("caller_name", "caller_type", "caller_file", "depth")


_QUAL = """select id from nodes where type = 'Entity' and lower(name) = lower((select p_name from part where p_partkey = 7))"""


@query(f"""with recursive {star.SQL}, s as ({_QUAL}),
first as (select distinct src as id from edges where type in ('CALLS', 'USES_VAR', 'REFERENCES') and receiver_type = 'NATION_6' and dst in (select id from s) and src not in (select id from s)),
{_walk("select id from first", _CALLS, HOPS - 1, True)}
select r.node as id, r.depth + 1 as depth, arg_min(e.receiver, e.edge_seq) as receiver, arg_min(e.receiver_type, e.edge_seq) as receiver_type, arg_min(e.line, e.edge_seq) as line
from r join edges e on e.src = r.node and e.type in ('CALLS', 'USES_VAR', 'REFERENCES')
  and e.dst = (select min(x.dst) from edges x where x.src = r.node and x.type in ('CALLS', 'USES_VAR', 'REFERENCES')
    and (r.depth = 0 and x.dst in (select id from s) and x.receiver_type = 'NATION_6' or r.depth > 0 and x.dst in (select node from r v where v.depth = r.depth - 1)))
where r.node not in (select id from s) group by r.node, r.depth""")  # fmt: skip
def impact_receiver_qualified(spark, sf_dir):
    """The callers of a part's name through suppliers of one nation."""
    name = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey = 7").first()["p_name"]
    return star.graph(spark, sf_dir).impact(f"NATION_6.{name}").select("id", "depth", "receiver", "receiver_type", "line")


@query(f"with {star.SQL} select id from nodes where type = 'Entity' and lower(name) = lower({_PART_NAME})")
def resolve_bare_name(spark, sf_dir):
    name = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey = 42").first()["p_name"]
    return star.graph(spark, sf_dir).resolve(name).select("id")


@query(f"with {star.SQL} select id from nodes where type = 'Entity' and owner = (select c_name from customer join orders on o_custkey = c_custkey where o_orderkey = 33) and name = 'order_33'")
def resolve_qualified(spark, sf_dir):
    orders, customer = star.tables(spark, sf_dir, "orders", "customer")
    row = orders.filter("o_orderkey = 33").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("c_name").first()
    return star.graph(spark, sf_dir).resolve(f"{row['c_name'] if row else 'none'}.order_33").select("id")


@query(f"""with recursive {star.SQL}, {_walk("select id from nodes where path = 'AMERICA/NATION_6'", "select src, dst from edges where type in ('CONTAINS', 'IMPORTS')", 3)}
select n.name as dependency, r.depth from r join nodes n on n.id = r.node
where r.depth > 0 and exists (select 1 from edges e join r v on v.node = e.src and v.depth = r.depth - 1 where e.dst = r.node and e.type = 'IMPORTS'
  and e.src = (select min(e2.src) from edges e2 join r w on w.node = e2.src and w.depth = r.depth - 1 where e2.dst = r.node and e2.type in ('CONTAINS', 'IMPORTS')))""")  # fmt: skip
def deps_nation(spark, sf_dir):
    return star.graph(spark, sf_dir).deps("AMERICA/NATION_6").select("dependency", "depth")


_C7 = "select 'c7' as id"


@query(f"""with recursive {star.SQL}, {_walk(_C7, "select src, dst from edges where type = 'CALLS'", 3)}
select n.name as callee_name, n.entity_type as callee_type, n.file as callee_file, r.depth from r join nodes n on n.id = r.node where r.depth > 0""")
def trace_customer(spark, sf_dir):
    name = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey = 7").first()["c_name"]
    return star.graph(spark, sf_dir).trace(name).select("callee_name", "callee_type", "callee_file", "depth")


_FLOW = "select src, dst, type, line, edge_seq from edges where type in ('CALLS', 'IMPORTS')"


@query(f"with recursive {star.SQL}, {_walk(_C7, _FLOW, HOPS)} select r.node as id, n.name, n.kind, r.depth from r join nodes n on n.id = r.node")
def flow_nodes(spark, sf_dir):
    name = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey = 7").first()["c_name"]
    return star.graph(spark, sf_dir).flow(name, include_external=True)[0].select("id", "name", "kind", "depth")


@query(f"""with recursive {star.SQL}, {_walk(_C7, _FLOW, HOPS)}
select e.src as "from", e.dst as "to", arg_min(e.type, e.edge_seq) as type, arg_min(coalesce(e.line, -1), e.edge_seq)::int as line
from ({_FLOW}) e join r on r.node = e.src where r.depth < {HOPS} group by e.src, e.dst""")
def flow_edges(spark, sf_dir):
    name = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey = 7").first()["c_name"]
    return star.graph(spark, sf_dir).flow(name, include_external=True)[1].select("from", "to", "type", F.coalesce("line", F.lit(-1)).alias("line"))


@query(f"""with recursive {star.SQL}, {_walk("select id from nodes where type = 'Folder'", "select src, dst from edges where type = 'CONTAINS'", 9)}
select n.type as node_type, n.name, n.path, r.depth + 1 as depth from edges e join r on r.node = e.src join nodes n on n.id = e.dst where e.type = 'CONTAINS'""")
def project_tree(spark, sf_dir):
    return star.graph(spark, sf_dir).tree()


_FILES_OF = "select e.src as src, e.dst as dst, e.type as type from edges e where e.type in ('CALLS', 'INHERITS', 'REFERENCES', 'USES_VAR')"
_BLAST = f"""{_walk("select dst as id from edges where type = 'CONTAINS' and src = 'n6'", _FILES_OF, 3, True, "a")},
p1 as (select n.file, min(a.depth) as hops from a join nodes n on n.id = a.node where a.depth > 0 and n.file is not null and n.file <> 'AMERICA/NATION_6' and n.type = 'Entity' group by n.file),
im as (select distinct s.path as src, t.path as dst from edges e join nodes s on s.id = e.src join nodes t on t.id = e.dst where e.type = 'IMPORTS' and s.path not in (select file from p1)),
{_walk("select 'AMERICA/NATION_6' as id", "select src, dst from im", 3, True, "b")}
select file, hops::int as hops from p1 union all select node, depth from b where depth > 0 union all select 'AMERICA/NATION_6', 0"""


@query(f"with recursive {star.SQL}, {_BLAST}")
def blast_radius_nation(spark, sf_dir):
    return star.graph(spark, sf_dir).blast_radius("AMERICA/NATION_6").select("file", "hops")


@query("""with recursive """ + star.SQL + """, im as (select distinct s.path as src, t.path as dst from edges e join nodes s on s.id = e.src join nodes t on t.id = e.dst where e.type = 'IMPORTS')
select src as importer, dst as target from im""")  # fmt: skip
def importers_of_files(spark, sf_dir):
    return star.graph(spark, sf_dir).importers()


def _several(*paths: str, hops: int) -> str:
    parts, picks = [], []
    for k, p in enumerate(paths):
        parts.append(
            _walk(f"select dst as id from edges where type = 'CONTAINS' and src = (select id from nodes where path = '{p}')", _FILES_OF, hops, True, f"a{k}")
            + f""", p{k} as (select n.file, min(a{k}.depth) as hops from a{k} join nodes n on n.id = a{k}.node where a{k}.depth > 0 and n.file is not null and n.file <> '{p}' group by n.file),
im{k} as (select distinct s.path as src, t.path as dst from edges e join nodes s on s.id = e.src join nodes t on t.id = e.dst where e.type = 'IMPORTS' and s.path not in (select file from p{k})),"""
            + _walk(f"select '{p}' as id", f"select src, dst from im{k}", hops, True, f"b{k}")
        )
        picks.append(f"select file, hops, '{p}' as t from p{k} union all select node, depth, '{p}' from b{k} where depth > 0 union all select '{p}', 0, '{p}'")
    return f"with recursive {star.SQL}, {', '.join(parts)} select file, min(hops)::int as hops, string_agg(distinct t, ',' order by t) as via from ({' union all '.join(picks)}) group by file"


@query(_several("AMERICA/NATION_6", "ASIA/NATION_2", hops=HOPS))
def batch_impact(spark, sf_dir):
    return star.graph(spark, sf_dir).batch_impact("AMERICA/NATION_6, ASIA/NATION_2").withColumn("via", F.array_join("via", ","))


# --- sets and search -------------------------------------------------------


@query(f"""with {star.SQL} select name, kind, file, case when is_exported then 'maybe_entrypoint' else 'dead' end as verdict from nodes n
where type = 'Entity' and file is not null and not exists (select 1 from edges e where e.dst = n.id and e.type in ('CALLS', 'IMPORTS', 'REFERENCES', 'INHERITS'))""")
def dead_code_split(spark, sf_dir):
    return star.graph(spark, sf_dir).dead_code().select("name", "kind", "file", "verdict")


@query(f"""with {star.SQL} select name, kind, file, 'name' as matched_field, regexp_extract(name, '(?i)#0+1[0-9]$') as match from nodes
where type = 'Entity' and regexp_matches(name, '(?i)#0+1[0-9]$') order by node_seq limit 1000""")
def grep_name(spark, sf_dir):
    return star.graph(spark, sf_dir).grep("#0+1[0-9]$", "name", limit=1000).select("name", "kind", "file", "matched_field", "match")


@query(f"""with {star.SQL} select name, kind, file, case when regexp_matches(name, '(?i)urgent|europe') then 'name' when regexp_matches(coalesce(file, ''), '(?i)urgent|europe') then 'file'
  when regexp_matches(kind, '(?i)urgent|europe') then 'kind' else 'description' end as matched_field from nodes
where type = 'Entity' and (regexp_matches(name, '(?i)urgent|europe') or regexp_matches(coalesce(file, ''), '(?i)urgent|europe') or regexp_matches(kind, '(?i)urgent|europe')
  or regexp_matches(coalesce(description, ''), '(?i)urgent|europe')) order by node_seq limit 500""")  # fmt: skip
def grep_all_fields(spark, sf_dir):
    return star.graph(spark, sf_dir).grep("urgent|europe", limit=500).select("name", "kind", "file", "matched_field")


_SCORE = "list_inner_product(list_transform(e.embedding, lambda x: x::double), list_transform(q.embedding, lambda x: x::double))"


@query(f"select e.vec_id, round({_SCORE}, 4) as score from embeddings e, (select embedding from embeddings where vec_id = 3) q order by {_SCORE} desc, e.vec_id limit 10")
def search_topk(spark, sf_dir):
    """The ten entities closest to one vector (a top-k report)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.nearest(e, list(e.filter("vec_id = 3").first()["embedding"]), 10, "vec_id").select("vec_id", "score")


@query(f"with {star.SQL} select id, concat_ws(' ', nullif(kind, ''), nullif(name, ''), nullif(file, ''), nullif(description, '')) as text from nodes where type = 'Entity'")
def entity_text(spark, sf_dir):
    return star.nodes(spark, sf_dir).filter("type = 'Entity'").select("id", vectors.entity_text().alias("text"))


# --- sources ---------------------------------------------------------------

_SPLIT = f"select distinct string_split({_PATHS}, '/') as p from pages where {_PATHS} <> ''"


@query(f"select distinct array_to_string(p[1:i], '/') as path, i::int as depth from (select p, unnest(range(1, len(p) + 1)) as i from ({_SPLIT}))")
def hierarchy_paths(spark, sf_dir):
    """All folders and files of the pages' url paths, with their depth."""
    paths = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.expr(_PATHS).alias("path")).filter("path <> ''")
    nodes, _ = hierarchy(paths, "pages")
    return nodes.filter("type <> 'Project'").select("path", "depth").distinct()


# --- upserts, rebuild, overlay ---------------------------------------------


@query("""with n as (select 'd' || doc_id as id, lang as name from documents), o as (select 'd' || doc_id as id, 'q' || quality as description, toxic = 1 as agent_created from labels
union all select 'd' || (1000000000 + doc_id), 'lost', toxic = 1 from labels)
select coalesce(n.id, o.id) as id, n.name, o.description from n full join o using (id) where n.id is not null or o.agent_created""")
def rebuild_join(spark, sf_dir):
    """New nodes keep what old ones said; old ones that are gone stay only if an agent made them."""
    docs, labels = star.tables(spark, sf_dir, "documents", "labels")
    new = docs.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("lang").alias("name"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("boolean").alias("agent_created"), F.lit(None).cast("string").alias("file"))
    old = labels.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.lit(None).cast("string").alias("name"), F.concat(F.lit("q"), "quality").alias("description"), (F.col("toxic") == 1).alias("agent_created"), F.lit(None).cast("string").alias("file"))
    gone = labels.select(F.concat(F.lit("d"), (F.lit(1000000000) + F.col("doc_id"))).alias("id"), F.lit(None).cast("string").alias("name"), F.lit("lost").alias("description"), (F.col("toxic") == 1).alias("agent_created"), F.lit(None).cast("string").alias("file"))
    return mutate.rebuilt_nodes(old.unionByName(gone), new).select("id", "name", "description")


# --- streams ---------------------------------------------------------------

_KIND = "case event_type when 'signup' then 'created' when 'error' then 'deleted' else 'modified' end"


@query(f"select user_id::varchar as path, arg_max({_KIND}, ts) as kind, count(*)::bigint as n_events from events group by user_id")
def watch_compact(spark, sf_dir):
    """The last event of each path decides what is done to it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return compacted(events.select(F.col("user_id").cast("string").alias("path"), F.expr(_KIND).alias("kind"), "ts", F.lit(None).cast("string").alias("dest_path")))


@query("""with x as (select ts, event_id, 'a' || user_id as path, case when event_type = 'click' then 'deleted' else 'modified' end as kind from events
  union all select ts, event_id, 'b' || user_id, 'modified' from events where event_type = 'click')
select path, arg_max(kind, row(ts, event_id)) as kind, count(*)::bigint as n_events from x group by path""")
def watch_moves(spark, sf_dir):
    """A move deletes its source path and changes its destination; of equal times the event that arrived last counts."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "click", "moved").otherwise("modified")
    target = F.when(F.col("event_type") == "click", F.concat(F.lit("b"), "user_id"))
    return compacted(events.select("event_id", F.concat(F.lit("a"), "user_id").alias("path"), kind.alias("kind"), "ts", target.alias("dest_path")))


# --- layout and scalars ----------------------------------------------------


@query(f"select page_id, replace(regexp_replace({_PATHS}, '\\.[^./]+$', ''), '/', '.') as module, case when {_PATHS} like '%.html' then 'html' else 'unknown' end as language, regexp_replace({_PATHS}, '\\.(js|jsx|ts|tsx|mjs|cjs|py|php)$', '') as base from pages")
def module_names(spark, sf_dir):
    p = F.expr(_PATHS)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", module_name(p).alias("module"), language_of(p).alias("language"), without_code_ending(p).alias("base"))


@query("select p_partkey, nullif(replace(replace(upper(trim(p_type)), ' ', '_'), '-', '_'), '') as relation from part")
def normalize_relation(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", relation_name(F.col("p_type")).alias("relation"))


@query("select n_nationkey, lower(substr(sha1(n_name), 1, 16)) as hex from nation")
def vector_ids(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select("n_nationkey", F.lower(F.lpad(F.conv(vector_id(F.col("n_name")).cast("string"), 10, 16), 16, "0")).alias("hex"))


