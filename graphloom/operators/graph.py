"""Questions about a code graph, over its node and edge tables.

All results are DataFrames in the order their rows are meant to be shown. Where several
rows could stand for another, the one with the smallest sequence number does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import blank, import_targets, looks_like_entry, receiver_matches, without_code_ending
from graphloom.operators.traverse import bfs, within
from graphloom.scratch import written

HOPS = 3
CALLERS = ("CALLS", "USES_VAR", "REFERENCES")
DEPENDENTS = ("CALLS", "INHERITS", "REFERENCES", "USES_VAR")
USES = ("CALLS", "IMPORTS", "REFERENCES", "INHERITS")
FLOW = ("CALLS", "IMPORTS")


def _first(value: Column | str, order: str = "edge_seq") -> Column:
    """The first value that isn't null or empty, in the given order."""
    value = F.col(value) if isinstance(value, str) else value
    return F.min_by(value, F.when(blank(value.cast("string")) != "", F.col(order)))


@dataclass(frozen=True)
class Graph:
    """A project's node and edge tables.

    ``into``: the edges once more, stored in the order of their targets; ``imports``: the
    (importer, target) files of all imports, as far as they were resolved at publishing.
    """

    nodes: DataFrame
    edges: DataFrame
    project: str
    into: DataFrame | None = None
    imports: DataFrame | None = None

    def _typed(self, types, into: bool = False) -> DataFrame:
        """The edges of some types; ``into``: those stored by their targets, if there are any."""
        edges = self.into if into and self.into is not None else self.edges
        return edges.filter(F.col("type").isin(*types))

    def _low_name(self) -> Column:
        """The lower-case name, which published nodes have as a column."""
        return F.col("name_lower") if "name_lower" in self.nodes.columns else F.lower(blank(F.col("name")))

    def entities(self) -> DataFrame:
        return self.nodes.filter("type = 'Entity'")

    def files(self) -> DataFrame:
        """(id, path) of the file nodes."""
        return self.nodes.filter("type = 'File'").select("id", "path")

    def files_at(self, path: str) -> DataFrame:
        """The file nodes of a path, the first one first."""
        return self.nodes.filter((F.col("type") == "File") & (F.col("path") == path)).orderBy("node_seq")

    def entity_time(self, name: str):
        """When the file of the first entity of a name that has one was taken in; None without any."""
        files = self.nodes.filter("type = 'File'").select(F.col("path").alias("file"), "updated_at")
        own = self.entities().filter((F.col("name") == name) & (blank(F.col("file")) != "")).orderBy("node_seq").limit(1).select("file")
        row = files.join(F.broadcast(own), "file").first()  # one row
        return row["updated_at"] if row else None

    def covers(self, path: str) -> bool:
        """Whether a path is the root, an indexed file, or a folder with one; case doesn't count."""
        wanted = path.strip("/").lower()
        low = F.lower("path")
        return wanted in ("", ".") or bool(self.files().filter((low == wanted) | low.startswith(wanted + "/")).limit(1).count())

    def resolve(self, name: str) -> DataFrame:
        """(id, file, node_seq) of the entities that a bare or qualified name means.

        A qualified name means the ones owned by the class, else those in a file that
        defines it, else all of the name.
        """
        qualifier, _, last = name.rpartition(".")
        named = self.entities().filter(self._low_name() == last.lower()).select("id", "file", "owner", "node_seq")
        if qualifier:
            homes = self.entities().filter((F.col("entity_type") == "class") & (self._low_name() == qualifier.lower()) & (blank(F.col("file")) != ""))
            homes = homes.select("file").distinct().withColumn("at_home", F.lit(True))
            tier = F.when(F.lower("owner") == qualifier.lower(), 0).when(F.col("at_home"), 1).otherwise(2)
            tiered = named.join(homes, "file", "left").withColumn("tier", tier)
            best = tiered.agg(F.min("tier").alias("tier"))
            named = tiered.join(F.broadcast(best), "tier")  # one row
        return named.select("id", "file", "node_seq")

    def first(self, name: str) -> DataFrame:
        """(id) of the first entity of a name; those with a file go first."""
        return self.resolve(name).orderBy(F.col("file").isNull(), "node_seq").limit(1).select("id")

    def impact(self, name: str, max_hops: int = HOPS) -> DataFrame:
        """Everything that calls, uses or refers to ``name``, directly or not.

        The receiver of a qualified query filters the edges of the first hop. If it
        leaves none, the calls into the bucket of the bare name come, as not resolved.
        """
        qualifier, _, last = name.rpartition(".")
        edges = self._typed(CALLERS, into=True)
        targets = written(self.resolve(name).select("id"), "targets")
        fits = F.coalesce(receiver_matches(qualifier, F.col("receiver"), F.col("receiver_type")), F.lit(False)) if qualifier else None
        of_entities = self.entities().select("id")
        reached = bfs(edges, targets, max_hops, reverse=True, first_hop=fits, reach=within(of_entities))
        found = self._callers(reached.filter("depth > 0"), edges, F.lit(True))
        if qualifier:
            bucket = f"{self.project}:{last}"
            inside = targets.filter(F.col("id") == bucket).limit(1)
            direct = edges.filter(F.col("dst") == bucket).select(F.col("src").alias("id"), F.lit(1).alias("depth"), F.lit(bucket).alias("via")).distinct()
            direct = direct.join(of_entities, "id", "left_semi").join(targets, "id", "left_anti").join(inside.select(F.lit(bucket).alias("via")), "via", "left_anti")
            loose = self._callers(direct.select("id", "depth", "via"), edges, F.lit(False))
            none = found.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(1).alias("one"))
            found = found.unionByName(loose.join(F.broadcast(none)).drop("one"))  # one row or none
        return found.orderBy(~F.col("resolved"), "depth", "id")

    def _callers(self, reached: DataFrame, edges: DataFrame, resolved: Column) -> DataFrame:
        calls = edges.join(reached, (edges.src == reached.id) & (edges.dst == reached.via)).groupBy("id", "depth")
        site = _first("source_file")
        call = calls.agg(
            _first("receiver").alias("receiver"),
            _first("receiver_type").alias("receiver_type"),
            site.alias("site"),
            F.coalesce(F.min_by("line", F.when(blank(F.col("source_file")) != "", F.col("edge_seq"))), F.min_by("line", "edge_seq")).alias("line"),
        )
        facts = self.nodes.select("id", "name", "entity_type", "file", "description")
        return call.join(facts, "id").select(
            "id",
            F.col("name").alias("caller_name"),
            F.col("entity_type").alias("caller_type"),
            F.coalesce("site", "file").alias("caller_file"),
            "line",
            blank(F.col("description")).alias("description"),
            "receiver",
            F.when(resolved, F.col("receiver_type")).alias("receiver_type"),
            resolved.alias("resolved"),
            "depth",
        )

    def grep(self, pattern: str, field: str = "all", ignore_case: bool = True, limit: int = 100) -> DataFrame:
        """Entities with a field that a regular expression finds; the first of name, file,
        kind and description counts. The first ``limit`` in node order, shown by file and name.
        Raises ValueError on a pattern that isn't one of the engine's (java.util.regex)."""
        try:
            self.nodes.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
        except IllegalArgumentException as e:
            raise ValueError(f"invalid regex: {e}") from e
        fields = ["name", "file", "kind", "description"] if field == "all" else [field]
        p = F.lit(("(?i)" if ignore_case else "") + pattern)
        hit = [(blank(F.col(f)) != "") & F.rlike(blank(F.col(f)), p) for f in fields]
        where, text = F.lit(None).cast("string"), F.lit(None).cast("string")
        for f, h in reversed(list(zip(fields, hit, strict=True))):
            where = F.when(h, F.lit(f)).otherwise(where)
            text = F.when(h, F.regexp_substr(F.col(f), p)).otherwise(text)
        found = self.entities().filter(F.col("project") == self.project).withColumn("matched_field", where).withColumn("match", text)
        found = found.filter("matched_field is not null").orderBy("node_seq").limit(limit)
        return found.select("name", "kind", "file", "line", blank(F.col("description")).alias("description"), "matched_field", "match").orderBy(
            blank(F.col("file")), blank(F.col("name"))
        )

    def deps(self, file_path: str, max_hops: int = HOPS) -> DataFrame:
        """What a file imports, directly or through what it contains and imports."""
        edges = self._typed(("CONTAINS", "IMPORTS"))
        start = self.nodes.filter((F.col("type") == "File") & (F.col("path") == file_path)).orderBy("node_seq").limit(1).select("id")
        reached = bfs(edges, start, max_hops).filter("depth > 0")
        imported = edges.filter("type = 'IMPORTS'").select(F.col("src").alias("via"), F.col("dst").alias("id")).distinct()
        facts = self.nodes.select("id", "type", "name", "path", "entity_type", "line", "description")
        return (
            reached.join(imported, ["id", "via"], "left_semi")
            .join(facts, "id")
            .filter("type in ('Entity', 'File')")
            .select(F.col("name").alias("dependency"), F.col("entity_type").alias("dep_type"), "line", blank(F.col("description")).alias("description"), "depth")
            .orderBy("depth", blank(F.col("dependency")))
        )

    def styles(self, element: str) -> DataFrame:
        """One row for each STYLES edge into the element."""
        edges = self._typed(("STYLES",)).join(self.resolve(element).select(F.col("id").alias("dst")), "dst")
        by = self.nodes.select(F.col("id").alias("src"), F.col("name").alias("selector"), F.col("file").alias("source_file"), blank(F.col("description")).alias("description"))
        return edges.select("src", "line").join(by, "src").select("selector", "source_file", "line", "description").orderBy("selector", "line")

    def trace(self, start: str, max_hops: int = HOPS) -> DataFrame:
        """The calls that follow from the first entity of a name."""
        first = self.first(start)
        reached = bfs(self._typed(("CALLS",)), first, max_hops, reach=within(self.entities())).filter("depth > 0")
        facts = self.nodes.select("id", "name", "entity_type", "file", "line", "description")
        return (
            reached.join(facts, "id")
            .select(F.col("name").alias("callee_name"), F.col("entity_type").alias("callee_type"), F.col("file").alias("callee_file"), "line", blank(F.col("description")).alias("description"), "depth")
            .orderBy("depth", "callee_name")
        )

    def flow(self, start: str, max_hops: int = HOPS, edge_types=FLOW, include_external: bool = False) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) that follow from the first entity of a name.

        Edges are those out of nodes short of the last hop, one for each pair of nodes,
        also back to nodes that were reached before.
        """
        first = self.first(start)
        inside = self.entities() if include_external else self.entities().filter(blank(F.col("file")) != "")
        edges = self._typed(edge_types)
        reached = bfs(edges, first, max_hops, reach=within(inside))
        facts = self.nodes.select("id", "name", "kind", blank(F.col("description")).alias("description"), "file", "line")
        flow_nodes = reached.select("id", "depth").join(facts, "id").select("id", "name", "kind", "description", "file", "line", "depth")
        out = edges.join(reached.filter(F.col("depth") < max_hops).select(F.col("id").alias("src")), "src").join(inside.select(F.col("id").alias("dst")), "dst", "left_semi")
        flow_edges = out.groupBy("src", "dst").agg(
            F.min_by("type", "edge_seq").alias("type"), F.min_by("source_file", "edge_seq").alias("file"), F.min_by("line", "edge_seq").alias("line"), F.min("edge_seq").alias("edge_seq")
        )
        return flow_nodes.orderBy("depth", "id"), flow_edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), "type", "file", "line", "edge_seq").orderBy("edge_seq")

    def tree(self, max_depth: int = 100) -> DataFrame:
        """The containment below the project, or below its top folders; a row for each parent and child."""
        edges = self._typed(("CONTAINS",)).select("src", "dst").distinct()
        roots = self.nodes.filter("type = 'Project'").select("id")
        if not roots.limit(1).count():
            roots = self.nodes.filter("type = 'Folder' and path not like '%/%'").select("id")
        reached = bfs(edges, roots, max_depth)
        facts = self.nodes.select("id", F.col("type").alias("node_type"), "name", "path")
        below = edges.join(reached.select(F.col("id").alias("src"), "depth"), "src").join(facts, F.col("dst") == facts.id)
        return below.select("node_type", "name", "path", (F.col("depth") + 1).alias("depth")).orderBy("depth", blank(F.col("path")), "name")

    def dead_code(self) -> DataFrame:
        """Entities with a file that nothing uses; ``verdict`` is maybe_entrypoint for exported ones and likely entries."""
        used = self._typed(USES).select(F.col("dst").alias("id")).distinct()
        own = self.entities().filter((F.col("project") == self.project) & (blank(F.col("file")) != ""))
        entry = F.coalesce(F.col("is_exported"), F.lit(False)) | looks_like_entry(F.col("name"), F.col("entity_type"))
        return (
            own.join(used, "id", "left_anti")
            .select("name", "kind", "entity_type", "file", "line", blank(F.col("description")).alias("description"), F.when(entry, "maybe_entrypoint").otherwise("dead").alias("verdict"))
            .orderBy("verdict", "file", "name")
        )

    def importers(self, psr4: dict[str, str] | None = None) -> DataFrame:
        """(importer, target): which file's import means which file; the published table, unless a map is given.

        An import means a file node that it names directly, or a file whose path without
        ending is one of the import's possible targets: an equi-join, computed once.
        """
        if self.imports is not None and psr4 is None:
            return self.imports
        imports = self._typed(("IMPORTS",)).filter(blank(F.col("source_file")) != "")
        names = self.nodes.select(F.col("id").alias("dst"), F.col("name").alias("spec"), F.col("type").alias("kind"), F.col("path").alias("direct"))
        known = imports.select("dst", F.col("source_file").alias("importer")).distinct().join(names, "dst")
        files = self.nodes.filter("type = 'File'").select(F.col("path").alias("target")).withColumn("base", without_code_ending(F.col("target")))
        meant = known.withColumn("base", F.explode(import_targets(F.col("spec"), F.col("importer"), psr4))).join(files, "base").select("importer", "target")
        return meant.unionByName(known.filter("kind = 'File'").select("importer", F.col("direct").alias("target"))).distinct()

    def found(self, targets: list[str]) -> DataFrame:
        """(target, id, file, by_path) of what each target means: entities by name, or else a file by its path."""
        spark = self.nodes.sparkSession
        entity = "target string, id string, file string, by_path boolean"
        every = spark.createDataFrame([], entity)
        for t in targets:  # the names that were asked for, not data
            if "/" not in t:
                every = every.unionByName(self.resolve(t).select(F.lit(t).alias("target"), "id", "file", F.lit(False).alias("by_path")))
        named = written(every, "named")
        met = {r["target"] for r in named.select("target").distinct().collect()}
        rest = [t for t in targets if t not in met]
        if not rest:
            return named
        files = self.nodes.filter((F.col("type") == "File") & F.col("path").isin(rest)).groupBy("path").agg(F.min_by("id", "node_seq").alias("id"))
        return named.unionByName(files.select(F.col("path").alias("target"), "id", F.col("path").alias("file"), F.lit(True).alias("by_path")))

    def blast_radii(self, targets: list[str], max_hops: int = HOPS, psr4: dict[str, str] | None = None) -> DataFrame:
        """(target, file, edge_type, hops): for each target, the files that a change of it may affect.

        First the files of what calls, inherits or refers to it, then the files that
        import its file, and their importers, which weren't found before. All targets are
        traversed at once; one that means nothing has no rows.
        """
        meant = written(self.found(targets), "meant")
        of_files = meant.filter("by_path").select("target", F.col("id").alias("src"))
        contained = self._typed(("CONTAINS",)).select("src", "dst").join(F.broadcast(of_files), "src")  # a row for each target
        contained = self.entities().select("id").join(contained.select("target", F.col("dst").alias("id")).distinct(), "id")
        starts = meant.filter("not by_path").select("target", "id").unionByName(contained.select("target", "id"))
        own = written(meant.filter(blank(F.col("file")) != "").select("target", "file").distinct(), "own-files")
        reached = bfs(self._typed(DEPENDENTS, into=True), starts, max_hops, reverse=True, by=["target"], carry=["type"]).filter("depth > 0")
        placed = self.entities().filter(blank(F.col("file")) != "").select("id", "file").join(reached, "id").join(own, ["target", "file"], "left_anti")
        first = placed.groupBy("target", "file").agg(F.min(F.struct("depth", "type")).alias("s")).select("target", "file", F.col("s.type").alias("edge_type"), F.col("s.depth").alias("hops"))
        first = written(first, "blast")
        links = self.importers(psr4).select(F.col("importer").alias("src"), F.col("target").alias("dst"))
        seen = first.select("target", F.col("file").alias("id"))
        fresh = lambda near, rows: near.join(seen, ["target", "id"], "left_anti")
        by_import = bfs(links, own.select("target", F.col("file").alias("id")), max_hops, reverse=True, reach=fresh, by=["target"])
        second = by_import.filter("depth > 0").select("target", F.col("id").alias("file"), F.lit("IMPORTS").alias("edge_type"), F.col("depth").alias("hops"))
        itself = own.select("target", "file", F.lit("self").alias("edge_type"), F.lit(0).alias("hops"))
        return first.unionByName(second).unionByName(itself)

    def blast_radius(self, target: str, max_hops: int = HOPS, psr4: dict[str, str] | None = None) -> DataFrame:
        """(file, edge_type, hops): the files that a change of an entity or a file may affect, itself included."""
        return self.blast_radii([target], max_hops, psr4).drop("target").orderBy("hops", "file")

    def batch_impact(self, targets: str | list[str], max_hops: int = HOPS, psr4: dict[str, str] | None = None) -> DataFrame:
        """(file, hops, via): the files affected by any of several targets, comma-separated or a list, and by which."""
        radii = self.blast_radii(asked_for(targets), max_hops, psr4)
        return radii.groupBy("file").agg(F.min("hops").alias("hops"), F.array_sort(F.collect_set("target")).alias("via")).orderBy("hops", "file")


def asked_for(targets: str | list[str]) -> list[str]:
    """The names in comma-separated lists, each once."""
    given = [targets] if isinstance(targets, str) else targets
    return list(dict.fromkeys(t.strip() for x in given for t in x.split(",") if t.strip()))
