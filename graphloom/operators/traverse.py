"""Breadth-first traversal as a loop of frontier joins.

Each hop joins the edges with the frontier and leaves out what was reached before. Its
rows are kept while the loop runs, and made again if an executor is lost; the result is
written to the shared folder, as is what was reached after every few hops, so plans
don't grow with the hops. A frontier or a visited set is broadcast only while its
counted rows are few; beyond that the joins shuffle. While a frontier has very few ids
they are a filter of the scan too, so that of edges stored in their order little is
read. Work is bounded by nodes and edges, not by paths, also in cyclic graphs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import written

#: Rows of ids that are broadcast at most (about 50 bytes each), and that filter a scan at most.
BROADCAST_ROWS, LOOKUP_ROWS = 200_000, 200
#: Hops after which what was reached is written, and rows in a file of the result.
HOPS_HELD, FILE_ROWS = 6, 500_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def looked_up(df: DataFrame, column: str, ids: DataFrame, rows: int) -> DataFrame:
    """The rows of ``df`` with one of the counted ``ids`` (id): a filter if they are very few; else all of them."""
    if rows > LOOKUP_ROWS:
        return df
    return df.filter(F.col(column).isin(sorted({r["id"] for r in ids.select("id").collect()})))


def within(nodes: DataFrame) -> Callable[[DataFrame, int], DataFrame]:
    """The ``reach`` of a traversal that keeps to some nodes (id, once each).

    The nodes are scanned past a small set of ids, and never moved for it.
    """

    def reach(near: DataFrame, rows: int) -> DataFrame:
        return looked_up(nodes.select("id"), "id", near, rows).join(small(near, rows), "id").select(*near.columns)

    return reach


def bfs(
    edges: DataFrame,
    seeds: DataFrame,
    max_hops: int,
    reverse: bool = False,
    first_hop: Column | None = None,
    reach: Callable[[DataFrame, int], DataFrame] | None = None,
    by: Sequence[str] = (),
    carry: Sequence[str] = (),
) -> DataFrame:
    """(id, depth, via) of all that is reached from ``seeds`` (id) in at most ``max_hops``.

    ``via`` is the node it was first reached from, the smallest of equals, null for
    seeds. ``first_hop`` filters the edges of hop one; ``reach`` filters the counted rows
    of each hop before they count as reached. ``by``: columns of the seeds that tell
    traversals apart, all of which are made at once. ``carry``: columns of the edge from
    ``via``, the smallest of several. The result has a broadcast hint if it is small.
    """
    here, there = ("dst", "src") if reverse else ("src", "dst")
    kinds = {f.name: f.dataType for f in edges.schema}
    keys, kept = [*by, "id"], []

    def held(df: DataFrame) -> tuple[DataFrame, int]:
        kept.append(df.persist())
        return kept[-1], kept[-1].count()

    start = seeds.select(*keys).distinct().select(*keys, F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"))
    frontier, n_frontier = held(start.withColumns({c: F.lit(None).cast(kinds[c]) for c in carry}))
    visited, n_visited = frontier, n_frontier
    for hop in range(1, max_hops + 1):
        if not n_frontier:
            break
        usable = edges.filter(first_hop) if hop == 1 and first_hop is not None else edges
        usable = looked_up(usable.select("src", "dst", *carry), here, frontier, n_frontier)
        met = usable.join(small(frontier.select(*by, F.col("id").alias(here)), n_frontier), here)
        near = met.groupBy(*by, F.col(there).alias("id")).agg(F.min(F.struct(F.col(here).alias("via"), *carry)).alias("_first"))
        near = near.join(small(visited.select(*keys), n_visited), keys, "left_anti").select(*keys, F.lit(hop).alias("depth"), "_first.*")
        frontier, n_frontier = held(near)
        if reach is not None and n_frontier:
            frontier, n_frontier = held(reach(frontier, n_frontier))
        visited, n_visited = visited.unionByName(frontier), n_visited + n_frontier
        if hop % HOPS_HELD == 0:
            visited = written(visited, "bfs")
            frontier = visited.filter(F.col("depth") == hop)
    out = written(visited.coalesce(1 + n_visited // FILE_ROWS), "bfs")
    for df in kept:
        df.unpersist()
    return small(out, n_visited)
