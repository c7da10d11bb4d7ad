"""The driver's star schema read as a code graph.

Regions are folders, nations files, customers and suppliers classes, orders functions
of a customer, parts external entities. Calls, references, imports and containment
follow the keys; ``SQL`` holds the same encoding for DuckDB.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph
from graphloom.scratch import shared_dir
from graphloom.sources.store import GraphStore

_NODE = {
    "id": "string", "type": "string", "name": "string", "path": "string", "project": "string", "entity_type": "string", "kind": "string",
    "file": "string", "line": "int", "owner": "string", "is_exported": "boolean", "description": "string", "node_seq": "bigint",
}
_EDGE = {
    "src": "string", "dst": "string", "type": "string", "source_file": "string", "line": "int", "receiver": "string", "receiver_type": "string",
    "edge_seq": "bigint",
}


def _rows(df: DataFrame, kinds: dict[str, str], **given: str) -> DataFrame:
    """The given SQL expressions as columns of ``kinds``; the rest is null."""
    return df.selectExpr(*[f"cast({given.get(k, 'null')} as {t}) as {k}" for k, t in kinds.items()])


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_nationkey, n_name, r_regionkey, r_name, path) of every nation; regions are five rows at any scale."""
    region, nation = tables(spark, sf_dir, "region", "nation")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).withColumn("path", F.concat_ws("/", "r_name", "n_name"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, customer, supplier, orders, part = tables(spark, sf_dir, "region", "customer", "supplier", "orders", "part")
    nation = files(spark, sf_dir)
    path = nation.select("n_nationkey", "path")
    owned = customer.join(path, customer.c_nationkey == path.n_nationkey)
    supply = supplier.join(path, supplier.s_nationkey == path.n_nationkey)
    called = orders.join(owned, orders.o_custkey == owned.c_custkey)
    entity = {"type": "'Entity'", "project": "'star'"}
    parts = [
        _rows(region, _NODE, id="concat('r', r_regionkey)", type="'Folder'", name="r_name", path="r_name", project="'star'", node_seq="r_regionkey"),
        _rows(nation, _NODE, id="concat('n', n_nationkey)", type="'File'", name="n_name", path="path", project="'star'", node_seq="100 + n_nationkey"),
        _rows(owned, _NODE, **entity, id="concat('c', c_custkey)", name="c_name", entity_type="'class'", kind="'class:sql'", file="path", description="c_mktsegment", node_seq="10000000000 + c_custkey"),
        _rows(supply, _NODE, **entity, id="concat('s', s_suppkey)", name="s_name", entity_type="'class'", kind="'class:sql'", file="path", node_seq="20000000000 + s_suppkey"),
        _rows(called, _NODE, **entity, id="concat('o', o_orderkey)", name="concat('order_', o_orderkey)", entity_type="'function'", kind="'function:sql'", file="path", owner="c_name", line="o_orderkey % 1000", is_exported="o_orderstatus = 'O'", description="o_orderpriority", node_seq="30000000000 + o_orderkey"),
        _rows(part, _NODE, **entity, id="concat('p', p_partkey)", name="p_name", entity_type="'class'", kind="'class:unknown'", description="p_type", node_seq="40000000000 + p_partkey"),
    ]
    return reduce(DataFrame.union, parts)


def edges(spark: SparkSession, sf_dir: str, types=None) -> DataFrame:
    """All edges, or those of some types."""
    wanted = lambda t: types is None or t in types
    parts = []
    if wanted("CONTAINS"):
        nation, customer, supplier = tables(spark, sf_dir, "nation", "customer", "supplier")
        parts += [
            _rows(nation, _EDGE, src="concat('r', n_regionkey)", dst="concat('n', n_nationkey)", type="'CONTAINS'", edge_seq="n_nationkey"),
            _rows(customer, _EDGE, src="concat('n', c_nationkey)", dst="concat('c', c_custkey)", type="'CONTAINS'", edge_seq="10000000000 + c_custkey"),
            _rows(supplier, _EDGE, src="concat('n', s_nationkey)", dst="concat('s', s_suppkey)", type="'CONTAINS'", edge_seq="20000000000 + s_suppkey"),
        ]
    if wanted("CALLS"):
        orders, lineitem = tables(spark, sf_dir, "orders", "lineitem")
        supply = tables(spark, sf_dir, "supplier")[0].join(files(spark, sf_dir).select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
        lines = lineitem.join(supply, F.col("l_suppkey") == F.col("s_suppkey"))
        place = {"line": "l_linenumber", "edge_seq": "40000000000 + l_orderkey * 16 + l_linenumber", "receiver": "concat('s', l_suppkey)", "receiver_type": "n_name"}
        parts += [
            _rows(orders, _EDGE, src="concat('c', o_custkey)", dst="concat('o', o_orderkey)", type="'CALLS'", edge_seq="30000000000 + o_orderkey"),
            _rows(lines, _EDGE, src="concat('o', l_orderkey)", dst="concat('p', l_partkey)", type="'CALLS'", **place),
        ]
    if wanted("REFERENCES"):
        pairs = tables(spark, sf_dir, "lineitem")[0].select("l_orderkey", "l_suppkey").distinct()
        parts.append(_rows(pairs, _EDGE, src="concat('o', l_orderkey)", dst="concat('s', l_suppkey)", type="'REFERENCES'", edge_seq="1000000000000000 + l_orderkey * 10000000 + l_suppkey"))
    if wanted("INHERITS"):
        part = tables(spark, sf_dir, "part")[0]
        parts.append(_rows(part, _EDGE, src="concat('p', p_partkey)", dst="concat('t:', p_type)", type="'INHERITS'", edge_seq="50000000000 + p_partkey"))
    if wanted("IMPORTS"):
        customer, supplier, orders, lineitem = tables(spark, sf_dir, "customer", "supplier", "orders", "lineitem")
        path = files(spark, sf_dir).select("n_nationkey", "path")
        urgent = lineitem.filter("l_quantity > 49 and l_returnflag = 'R'").join(orders.filter("o_orderpriority = '1-URGENT'"), F.col("l_orderkey") == F.col("o_orderkey"))
        imports = (
            urgent.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .filter("c_nationkey <> s_nationkey")
            .select("c_nationkey", "s_nationkey")
            .distinct()
            .join(F.broadcast(path), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows at any scale
        )
        parts.append(_rows(imports, _EDGE, src="concat('n', c_nationkey)", dst="concat('n', s_nationkey)", type="'IMPORTS'", source_file="path", edge_seq="60000000000 + c_nationkey * 100 + s_nationkey"))
    return reduce(DataFrame.union, parts)


_published: dict[tuple[str, str], GraphStore] = {}


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of the tables, published in the shared folder when a session first asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _published:
        store = GraphStore(spark, f"{shared_dir(spark)}/star-{uuid.uuid4().hex}", "star")
        store.publish(nodes(spark, sf_dir), edges(spark, sf_dir))
        _published[key] = store
    return _published[key].graph()


#: The encoding as common table expressions for DuckDB: f (files), nodes and edges.
SQL = """
f as (select n_nationkey, n_name, r_regionkey, r_name, r_name || '/' || n_name as path from nation join region on n_regionkey = r_regionkey),
nodes as (
  select 'r' || r_regionkey as id, 'Folder' as type, r_name as name, r_name as path, null as entity_type, null as kind, null as file, null::int as line,
         null as owner, null::boolean as is_exported, null as description, r_regionkey::bigint as node_seq from region
  union all select 'n' || n_nationkey, 'File', n_name, path, null, null, null, null, null, null, null, 100 + n_nationkey from f
  union all select 'c' || c_custkey, 'Entity', c_name, null, 'class', 'class:sql', path, null, null, null, c_mktsegment, 10000000000 + c_custkey
    from customer join f on c_nationkey = n_nationkey
  union all select 's' || s_suppkey, 'Entity', s_name, null, 'class', 'class:sql', path, null, null, null, null, 20000000000 + s_suppkey
    from supplier join f on s_nationkey = n_nationkey
  union all select 'o' || o_orderkey, 'Entity', 'order_' || o_orderkey, null, 'function', 'function:sql', path, (o_orderkey % 1000)::int, c_name,
         o_orderstatus = 'O', o_orderpriority, 30000000000 + o_orderkey
    from orders join customer on o_custkey = c_custkey join f on c_nationkey = n_nationkey
  union all select 'p' || p_partkey, 'Entity', p_name, null, 'class', 'class:unknown', null, null, null, null, p_type, 40000000000 + p_partkey from part
),
edges as (
  select 'r' || r_regionkey as src, 'n' || n_nationkey as dst, 'CONTAINS' as type, null as source_file, null::int as line, null as receiver,
         null as receiver_type, n_nationkey::bigint as edge_seq from f
  union all select 'n' || c_nationkey, 'c' || c_custkey, 'CONTAINS', null, null, null, null, 10000000000 + c_custkey from customer
  union all select 'n' || s_nationkey, 's' || s_suppkey, 'CONTAINS', null, null, null, null, 20000000000 + s_suppkey from supplier
  union all select 'c' || o_custkey, 'o' || o_orderkey, 'CALLS', null, null, null, null, 30000000000 + o_orderkey from orders
  union all select 'o' || l_orderkey, 'p' || l_partkey, 'CALLS', null, l_linenumber, 's' || l_suppkey, n_name, 40000000000 + l_orderkey * 16 + l_linenumber
    from lineitem join supplier on l_suppkey = s_suppkey join f on s_nationkey = n_nationkey
  union all select 'o' || l_orderkey, 's' || l_suppkey, 'REFERENCES', null, null, null, null, 1000000000000000 + l_orderkey * 10000000 + l_suppkey
    from (select distinct l_orderkey, l_suppkey from lineitem)
  union all select 'p' || p_partkey, 't:' || p_type, 'INHERITS', null, null, null, null, 50000000000 + p_partkey from part
  union all select 'n' || c_nationkey, 'n' || s_nationkey, 'IMPORTS', path, null, null, null, 60000000000 + c_nationkey * 100 + s_nationkey
    from (select distinct c_nationkey, s_nationkey from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
          join supplier on l_suppkey = s_suppkey
          where l_quantity > 49 and l_returnflag = 'R' and o_orderpriority = '1-URGENT' and c_nationkey <> s_nationkey) join f on c_nationkey = n_nationkey
)"""
