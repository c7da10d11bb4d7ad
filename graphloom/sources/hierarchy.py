"""The containment of files and folders, from paths alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import stable_uuid


def hierarchy(paths: DataFrame, project: str, empty: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for a column ``path``: the project, every folder on the way, and the files.

    ``empty``: paths of folders that have a place even without a file. ``node_seq`` and
    ``edge_seq`` are fixed by the path, and come before those of all entities.
    """
    files = paths.select("path").filter("path <> ''").distinct().withColumn("parts", F.split("path", "/"))
    steps = F.expr("transform(sequence(1, size(parts) - 1), i -> slice(parts, 1, i))")
    folders = files.filter("size(parts) > 1").select(F.explode(steps).alias("parts"))
    if empty is not None:
        parts = empty.filter("path <> ''").select(F.split("path", "/").alias("parts"))
        folders = folders.union(parts.select(F.explode(F.expr("transform(sequence(1, size(parts)), i -> slice(parts, 1, i))"))))
    folders = folders.distinct()
    named = lambda df, kind: df.select(F.lit(kind).alias("type"), F.array_join("parts", "/").alias("path"), F.element_at("parts", -1).alias("name"), F.size("parts").alias("depth"))
    both = named(folders, "Folder").unionByName(named(files, "File"))
    node_id = lambda kind, path: stable_uuid(F.concat_ws(":", F.lower(kind), F.lit(project), path))
    root_id = stable_uuid(F.lit(f"project:{project}"))
    ending = F.lower(F.regexp_extract("name", r"[^.](\.[^.]+)$", 1))
    extension = F.when(F.col("type") == "File", ending)
    seq = F.expr("cast(-1152921504606846976 as bigint)") + F.pmod(F.xxhash64("type", "path"), F.lit(1 << 59))  # before all entities
    nodes = both.select(node_id(F.col("type"), F.col("path")).alias("id"), "type", "name", "path", "depth", F.lit(project).alias("project"), extension.alias("extension"), seq.alias("node_seq"))
    root = paths.sparkSession.range(1).select(root_id.alias("id"), F.lit("Project").alias("type"), F.lit(project).alias("name"), F.lit("").alias("path"), F.lit(0).alias("depth"), F.lit(project).alias("project"), F.lit(None).cast("string").alias("extension"), F.lit(-(1 << 62)).alias("node_seq"))
    parent = F.regexp_replace("path", "/[^/]*$", "")
    src = F.when(F.col("depth") == 1, root_id).otherwise(node_id(F.lit("Folder"), parent))
    edges = nodes.select(src.alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("type"), F.col("node_seq").alias("edge_seq"))
    return root.unionByName(nodes), edges
