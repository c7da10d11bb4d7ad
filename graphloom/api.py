"""The questions a user or an agent asks of one repository, over its published graph."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.columns import blank, stable_uuid
from graphloom.operators import incremental, mutate, render, vectors, writeback
from graphloom.operators.changes import EDGE_FLAGS, NODE_FLAGS, Changes, applied, with_columns
from graphloom.operators.graph import HOPS, Graph, asked_for
from graphloom.schemas import PLACES, TRIPLES
from graphloom.scratch import cleared, keep, written
from graphloom.sources import ignore
from graphloom.sources.context import with_context
from graphloom.sources.extract import registry
from graphloom.sources.hierarchy import hierarchy
from graphloom.sources.index import IndexStore, name_of
from graphloom.sources.store import DUMPED, GraphStore, adopted_sidecar, dump_triples, load_triples, node_link, psr4
from graphloom.streaming import listings
from graphloom.streaming.watch import watch

#: Answers where there is nothing to ask yet.
NO_GRAPH = "nothing is published yet: ingest first"
NO_INDEX = "there is no index yet: call index, or ingest with index=True"
COMPOSER = "composer.json"
#: The list of files beside the graph, and the side table of descriptions.
FILES, SIDECAR = "files.txt", "descriptions.jsonl"
#: Rows of an answer; the tables that the questions give have all.
ANSWER = 1000


class Repository:
    """A source tree and its graph: ``ingest`` builds and publishes, the other methods ask or correct.

    Ignore patterns and skipped folders that an ingest is given hold for later changes of
    files too; without patterns, those of the tree's own list do. Every correction
    publishes a version of its own, and survives later ingests.
    """

    def __init__(self, spark: SparkSession, root: str, home: str, project: str, embed=vectors.hashed_words):
        self.spark, self.root, self.project = spark, root.rstrip("/"), project
        self.store, self.indexes = GraphStore(spark, home, project), IndexStore(spark, f"{home.rstrip('/')}/vectors")
        self.home = home.rstrip("/")
        self.patterns, self.skip, self.embed = None, ignore.SKIPPED, embed
        self._progress: registry.Progress | None = None
        self._refused: DataFrame | None = None

    def init(self) -> dict:
        """Ingests if nothing is published yet; else takes in what an older graph left: its side table of descriptions,
        and the list of files, if that isn't there."""
        if not self.store.version():
            return self.ingest()
        adopted = self.adopt(f"{self.home}/{SIDECAR}")
        if not self.store.versions.exists(f"{self.home}/{FILES}"):
            self.store.write_files(f"{self.home}/{FILES}")
        return {"status": "ready", "version": self.store.version()} | ({"adopted": adopted} if adopted else {})

    # --- exchange ----------------------------------------------------------

    def adopt(self, path: str) -> int:
        """Takes in a side table of descriptions, once; the number of nodes described now."""
        return adopted_sidecar(self.store, path)

    @cleared
    def load_graph(self, path: str) -> dict:
        """Publishes a graph in node-link JSON in place of the one there; one that can't be read changes nothing."""
        nodes, edges = node_link(self.spark, path)
        if not nodes.limit(1).count():
            return {"status": "abandoned", "nodes": 0}
        version = self.store.publish(nodes, edges, psr4=self._psr4())
        self.store.write_files(f"{self.home}/{FILES}")
        return {"status": "published", "nodes": self.node_count(), "version": version} | self._indexed(False)

    @cleared
    def dump(self, path: str, fields=DUMPED) -> dict:
        """Writes the tree's triples as JSON lines, and leaves the graph as it is."""
        seen = registry.scanned(self.spark, self.root, self.patterns, self.skip)
        found, _ = registry.relations(seen.files)
        triples = registry.placed(found, registry.begun(registry.sizes(found)))
        count = found.count()
        if not count:
            return {"status": "abandoned", "triples": 0}
        dump_triples(triples, path, fields)
        return {"status": "dumped", "triples": count}

    # --- building ----------------------------------------------------------

    @cleared
    def ingest(self, patterns: list[str] | None = None, normalize: Callable[[DataFrame], DataFrame] | None = None, skip=ignore.SKIPPED, index: bool = False) -> dict:
        """Scans, extracts, resolves, joins with the published graph, and publishes.

        ``normalize`` may rewrite the triples. Without any triple the old graph stays.
        ``index``: also embeds the entities anew; an index that is there is always renewed.
        """
        self.patterns, self.skip = patterns, skip
        self._progress = registry.Progress(self.spark)
        seen = registry.scanned(self.spark, self.root, patterns, skip)
        if seen.listed is not None:  # what changes from now on is found by a watch
            listings.start(seen.listed, self._watched())
        found, refused = registry.relations(seen.files, progress=self._progress)
        self._refused = keep(written(refused, "refused"))
        places = written(registry.begun(registry.sizes(found), lead=registry.LEAD), "places")
        triples = registry.placed(found, places)
        told = self._publish(normalize(triples) if normalize else triples, seen.paths, index, None if normalize else places, folders=seen.folders)
        return told | {c: n for c, n in self.progress().items() if c != "relations"}

    def progress(self) -> dict[str, int]:
        """Files, refused ones and relations of the ingest that runs, or of the last one; another thread may ask."""
        return self._progress.counts() if self._progress else {"files": 0, "refused": 0, "relations": 0}

    def refused(self) -> DataFrame:
        """(path, error) of the files that the last ingest of this session could not read or parse."""
        return self.spark.createDataFrame([], "path string, error string") if self._refused is None else self._refused

    def _watched(self) -> str:
        return f"{self.home}/listings"

    @cleared
    def ingest_triples(self, triples: DataFrame | str) -> dict:
        """Publishes the graph of given triples, or of a JSON file of them; their files are those of the tree."""
        given = load_triples(self.spark, triples) if isinstance(triples, str) else triples
        return self._publish(given.select(*TRIPLES.names), given.select(F.col("source_file").alias("path")).distinct(), False)

    def _tree(self, paths: DataFrame, folders: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of containment, stamped as of now."""
        nodes, edges = hierarchy(paths, self.project, folders)
        stamp = F.current_timestamp()
        return nodes.withColumn("last_ingested", F.when(F.col("type") == "Project", stamp)).withColumn("updated_at", F.when(F.col("type") == "File", stamp)), edges

    def _publish(self, triples: DataFrame, paths: DataFrame, index: bool, places: DataFrame | None = None, emptied: bool = False, folders: DataFrame | None = None) -> dict:
        """Publishes the graph of all triples; without any the old graph stays, unless its files were deleted (``emptied``)."""
        t = written(mutate.resolved_triples(written(triples, "triples"), self.project), "resolved")
        count = t.count()
        if not count and not emptied:
            return {"status": "abandoned", "triples": 0}
        folders = registry.scanned(self.spark, self.root, self.patterns, self.skip).folders if folders is None else folders
        tree_nodes, tree_edges = self._tree(paths, folders)
        ids = tree_nodes.filter("type = 'File'").select("id", "path")
        nodes, edges = mutate.nodes_of(t, self.project), mutate.edges_of(t, ids)
        new = with_columns(nodes.unionByName(tree_nodes, allowMissingColumns=True), NODE_FLAGS)
        all_edges = with_columns(edges.unionByName(tree_edges, allowMissingColumns=True), EDGE_FLAGS)

        def make(old: Graph | None) -> tuple[DataFrame, DataFrame]:
            if old is None:
                return new, all_edges
            agents = with_columns(old.nodes, NODE_FLAGS).filter("agent_created").select(F.col("file").alias("path"))
            there = registry.present(agents, self.root)  # an agent's node stays while its file does, indexed or not
            kept = written(mutate.rebuilt_nodes(_like(old.nodes, new), new, there), "nodes")
            return kept, mutate.rebuilt_edges(_like(old.edges, all_edges), all_edges, kept)

        version = self.store.rebuild(make, lambda: (t, places), self._psr4())
        self.store.write_files(f"{self.home}/{FILES}")
        return {"status": "published", "triples": count, "version": version} | self._indexed(index)

    def _indexed(self, wanted: bool, changed: DataFrame | None = None) -> dict:
        """Renews the index, if there is one or one is wanted; one that another embedder made stays, which is told.
        ``changed``: the nodes (id) that differ, where the others' vectors hold."""
        there = self.indexes.facts()
        if not wanted and there is None:
            return {}
        if not wanted and there["embedder"] != name_of(self.embed):
            return {"index": f"not renewed: it was made by the embedder {there['embedder']!r}"}
        if changed is None or there is None:
            return {"indexed": self.index()}
        old = self.indexes.index().rows.drop("cell", "code", "scale")
        new = vectors.indexed(self.store.graph().nodes.join(changed, "id", "left_semi"), self.embed)
        kept = old.join(changed, "id", "left_anti").select(*new.columns)
        return {"indexed": self.indexes.publish(kept.unionByName(new), there["embedder"])}

    def _psr4(self) -> dict[str, str]:
        path = f"{self.root}/{COMPOSER}"
        return psr4(self.spark.read.text(path, wholetext=True).first()[0]) if ignore.is_file(self.spark, path) else {}

    @cleared
    def apply(self, changed: DataFrame, deleted: DataFrame) -> dict:
        """Publishes the graph after changes of files (path).

        Of few files only these are read, and a change of the log is published, that a full
        ingest would come to (``operators/incremental.py``). Where many changed, where the
        namespaces of the tree did, or a new file has no room in the order, the triples of
        the others are kept and all is resolved and published anew.
        """
        touched = written(changed.select("path").unionByName(deleted.select("path")).distinct(), "touched")
        names = [r["path"] for r in touched.limit(registry.NAMED_FILES + 1).collect()]
        places = self.store.places() if self.store.version() else None
        if places is None or len(names) > registry.NAMED_FILES or COMPOSER in names:
            return self._apply_whole(touched, names if len(names) <= registry.NAMED_FILES else None)
        files = registry.scan(self.spark, self.root, self.patterns, self.skip, only=names)
        found, refused = registry.relations(files)
        self._refused = keep(written(refused, "refused"))
        present = [r["path"] for r in files.select("path").collect()]
        size = {r["path"]: r["n"] for r in registry.sizes(found).collect()}
        begins = registry.inserted(places, {p: size.get(p, 0) for p in present})
        if begins is None:
            return self._apply_whole(touched, names)
        own = self.spark.createDataFrame([(p, begins[p], size.get(p, 0)) for p in present], PLACES)
        fresh = written(registry.placed(found, own), "fresh")
        gone = sorted(set(names) - set(present))
        put: list[DataFrame] = []

        def make(graph: Graph) -> tuple[dict, Changes]:
            changes = incremental.changes(graph, self.store.resolved(), touched, fresh, *self._moved(graph, present, gone), self.store.psr4())
            put[:] = [changes.nodes.select("id")]
            return {"status": "published", "triples": fresh.count()}, replace(changes, places=own)

        answer = self.store.correct(make)
        self.store.write_files(f"{self.home}/{FILES}")
        return answer | self._indexed(False, put[0])

    def _moved(self, graph: Graph, present: list[str], gone: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
        """What changes of few files change in the tree: nodes and edges that come, nodes to look at again, the indexed files, and those there."""
        table = lambda paths: self.spark.createDataFrame([(p,) for p in paths], "path string")
        nodes, edges = self._tree(table(present))
        above = {p.rsplit("/", k)[0] for p in gone for k in range(1, p.count("/") + 1)}
        empty = sorted(f for f in above if not self.store.versions.exists(f"{self.root}/{f}"))
        away = graph.files().join(table(gone), "path", "left_semi").select("id")
        away = away.unionByName(table(empty).select(stable_uuid(F.concat(F.lit(f"folder:{self.project}:"), "path")).alias("id")))
        agents = with_columns(graph.nodes, NODE_FLAGS).filter("agent_created").select("id", F.col("file").alias("path"))
        there = agents.filter("path is not null").select("path").distinct().join(table(gone), "path", "left_anti")
        away = away.unionByName(agents.join(table(gone), "path", "left_semi").select("id"))
        ids = graph.files().join(table([*gone, *present]), "path", "left_anti").select("id", "path").unionByName(nodes.filter("type = 'File'").select("id", "path"))
        return nodes, edges, away, ids.select("path", "id"), there

    def _apply_whole(self, touched: DataFrame, names: list[str] | None) -> dict:
        """Reads the changed files only, but resolves and publishes all."""
        files = registry.scan(self.spark, self.root, self.patterns, self.skip, only=names)
        files = files if names is not None else files.join(touched, "path", "left_semi")
        found, refused = registry.relations(files)
        self._refused = keep(written(refused, "refused"))
        old, places = self.store.triples(), self.store.places() if self.store.version() else None
        kept = old.join(touched.withColumnRenamed("path", "source_file"), "source_file", "left_anti").select(*old.columns)
        if places is None:
            last = kept.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("last"))
            fresh = registry.placed(found, registry.begun(registry.sizes(found)))
            fresh = fresh.join(F.broadcast(last)).withColumn("seq", F.col("seq") + F.col("last")).select(*old.columns)  # one row
            triples, begins = kept.unionByName(fresh), None
        else:
            begin = places.select(F.col("path").alias("source_file"), "begin")
            both = kept.join(begin, "source_file").withColumn("place", F.col("seq") - F.col("begin")).drop("seq", "begin").unionByName(found)
            both = written(both, "relations")
            begins = written(registry.begun(registry.sizes(both), lead=registry.LEAD), "places")
            triples = registry.placed(both, begins)
        before = self.store.graph().files().select("path").join(touched, "path", "left_anti")
        return self._publish(triples, before.unionByName(files.select("path")).distinct(), False, begins, emptied=True)

    def watch(self, events: DataFrame | None = None, checkpoint: str | None = None, patterns: list[str] | None = None, every: str | None = None):
        """Follows the changes of the tree; a batch of them publishes one version.

        Without ``events`` they come of listings of the tree, from the last ingest on; else
        they are a stream of file events. ``every``: the time between batches of a stream
        that goes on until it is stopped; without it, what is there is done, and the stream ends.
        """
        self.patterns = patterns if patterns is not None else self.patterns
        known = ignore.load_patterns(self.spark, self.root) if self.patterns is None else self.patterns
        if events is None:
            events = listings.tree_events(self.spark, self.root, self._watched(), known, self.skip)
        return watch(events, self.apply, checkpoint or f"{self.home}/watch", known, self.skip, every)

    # --- what agents write -------------------------------------------------

    @cleared
    def _corrected(self, ask, changes, done: tuple[str, ...], answer=writeback.answer) -> dict:
        """Answers a request of one row, and publishes what it changes, if its status is one of ``done``."""
        if not self.store.version():
            return {"status": "skipped", "reason": NO_GRAPH}

        def make(graph: Graph):
            told = written(ask(graph), "told")
            said = answer(graph, told)
            return said, changes(graph, told) if said["status"] in done else None

        return self.store.correct(lambda graph: _with_imports(graph, self.store.psr4(), *make(graph)))

    def add_entity(self, name: str, kind: str = "function", file: str = "", line: int | None = None, description: str = "", language: str = "") -> dict:
        """Adds an entity that extraction missed, or updates the only one of its name (and file)."""
        asked = {"name": name, "kind": kind, "file": file, "line": line, "description": description, "language": language}
        return self._corrected(lambda g: writeback.added_entities(g, writeback.one(g, **asked)), writeback.entity_changes, ("created", "updated"), writeback.entity_answer)

    def add_call(self, caller: str, callee: str, line: int | None = None, relation: str = "CALLS", caller_file: str = "", callee_file: str = "") -> dict:
        """Adds an edge between two entities by their names."""
        asked = {"caller": caller, "callee": callee, "relation": relation, "caller_file": caller_file, "callee_file": callee_file, "line": line}
        return self._corrected(lambda g: writeback.added_calls(g, writeback.one(g, **asked)), writeback.call_changes, ("added",))

    def delete_entity(self, name: str = "", file: str = "", id: str = "") -> dict:
        """Undoes ``add_entity``, or strips a parsed entity of what agents said of it."""
        asked = {"name": name, "file": file, "id": id}
        return self._corrected(lambda g: writeback.deleted_entities(g, writeback.one(g, **asked)), writeback.deletion_changes, ("deleted", "stripped"), writeback.entity_answer)

    def delete_call(self, caller: str, callee: str, relation: str = "CALLS", caller_file: str = "", callee_file: str = "") -> dict:
        """Undoes ``add_call``."""
        asked = {"caller": caller, "callee": callee, "relation": relation, "caller_file": caller_file, "callee_file": callee_file}
        return self._corrected(lambda g: writeback.removed_calls(g, writeback.one(g, **asked)), writeback.removal_changes, ("removed",))

    def modify_relation(self, caller: str, callee: str, to_relation: str, from_relation: str = "", caller_file: str = "", callee_file: str = "") -> dict:
        """Gives an edge another type, which then holds against the parser's."""
        asked = {"caller": caller, "callee": callee, "relation": to_relation, "from_relation": from_relation, "caller_file": caller_file, "callee_file": callee_file}
        return self._corrected(lambda g: writeback.modified_relations(g, writeback.one(g, **asked)), writeback.relation_changes, ("modified",))

    def describe(self, name: str, text: str, file: str = "", id: str = "") -> dict:
        """Sets the description of the only entity of a name; blank text clears it."""
        asked = {"name": name, "file": file, "id": id, "text": text}
        return self._corrected(lambda g: writeback.described(g, writeback.one(g, **asked)), writeback.description_changes, ("updated", "cleared"), writeback.entity_answer)

    @cleared
    def correct(self, requests: DataFrame, kind: str) -> DataFrame:
        """Answers a table of requests of one kind (a name of ``BULK``), and publishes what they change as one version;
        the requests with their statuses."""
        ask, changes, done = BULK[kind]
        out: list[DataFrame] = []

        def make(graph: Graph):
            out[:] = [written(ask(graph, requests), "told")]
            some = out[0].filter(F.col("status").isin(*done)).limit(1).count()
            return _with_imports(graph, self.store.psr4(), {}, changes(graph, out[0]) if some else None)

        self.store.correct(make)
        return keep(out[0])

    def description(self, id: str) -> str:
        """What was said of a node; an empty text if nothing was."""
        row = self.store.graph().nodes.filter(F.col("id") == id).select("description").first()
        return row[0] or "" if row else ""

    # --- the index ---------------------------------------------------------

    def _index(self):
        """The newest index, if there is one."""
        return self.indexes.index()

    @cleared
    def index(self, embed=None) -> int:
        """Embeds all entities anew, with a given embedder from now on; the number of them."""
        self.embed = embed or self.embed
        return self.indexes.publish(vectors.indexed(self.store.graph().nodes, self.embed), name_of(self.embed))

    def _same_embedder(self, name: str) -> None:
        if name != name_of(self.embed):
            raise ValueError(f"the index was made by the embedder {name!r}, not by {name_of(self.embed)!r}: set that one as ``embed``, or index anew")

    def search(self, text: str, limit: int = 10, exact: bool = False) -> DataFrame:
        """The entities closest to a text, by codes and a last exact look, or by all vectors if ``exact``.

        Raises LookupError if there is no index, and ValueError if another embedder made it.
        """
        found = self._index()
        if found is None:
            raise LookupError(NO_INDEX)
        self._same_embedder(found.embedder)
        return found.search(vectors.embedded(self.spark, text, self.embed), limit, exact)

    def fetch_search(self, text: str, limit: int = 10) -> dict:
        """The same as rows, or a hint at what is missing."""
        try:
            return {"query": text, "results": _rows(self.search(text, limit))}
        except (LookupError, ValueError) as e:
            return {"query": text, "results": [], "hint": str(e)}

    # --- questions ---------------------------------------------------------

    def impact(self, name: str, hops: int = HOPS) -> DataFrame:
        return self.store.graph().impact(name, hops)

    def blast_radius(self, target: str, hops: int = HOPS) -> DataFrame:
        return self.store.graph().blast_radius(target, hops)

    def batch_impact(self, targets: str | list[str], hops: int = HOPS) -> DataFrame:
        return self.store.graph().batch_impact(targets, hops)

    def deps(self, file: str, hops: int = HOPS) -> DataFrame:
        return self.store.graph().deps(file, hops)

    def trace(self, start: str, hops: int = HOPS) -> DataFrame:
        return self.store.graph().trace(start, hops)

    def styles(self, element: str) -> DataFrame:
        return self.store.graph().styles(element)

    def grep(self, pattern: str, field: str = "all", ignore_case: bool = True, limit: int = 100) -> DataFrame:
        return self.store.graph().grep(pattern, field, ignore_case, limit)

    def dead_code(self, entry_points: bool = False) -> DataFrame:
        found = self.store.graph().dead_code()
        return found if entry_points else found.filter("verdict = 'dead'")

    def tree(self) -> DataFrame:
        return self.store.graph().tree()

    # --- answers as dictionaries, with their freshness ---------------------

    def _entity_time(self, name: str):
        return self.store.graph().entity_time(name)

    def fetch_impact(self, name: str, hops: int = HOPS, limit: int = ANSWER) -> dict:
        return {"entity": name} | _answer("callers", self.impact(name, hops), limit) | {"updated_at": self._entity_time(name)}

    def fetch_deps(self, file: str, hops: int = HOPS, limit: int = ANSWER) -> dict:
        return {"file": file} | _answer("dependencies", self.deps(file, hops), limit) | {"updated_at": self.store.updated_at(file)}

    def fetch_styles(self, element: str, limit: int = ANSWER) -> dict:
        return {"element": element} | _answer("selectors", self.styles(element), limit) | {"updated_at": self._entity_time(element)}

    def fetch_trace(self, start: str, hops: int = HOPS, limit: int = ANSWER) -> dict:
        return {"entity": start} | _answer("calls", self.trace(start, hops), limit) | {"updated_at": self._entity_time(start)}

    def fetch_grep(self, pattern: str, field: str = "all", ignore_case: bool = True, limit: int = 100) -> dict:
        """Matches, and whether the limit cut them; a pattern that is none gives an ``error``."""
        try:
            found = _rows(self.grep(pattern, field, ignore_case, limit + 1))
        except ValueError as e:
            return {"pattern": pattern, "matches": [], "error": str(e)}
        return {"pattern": pattern, "matches": found[:limit], "truncated": len(found) > limit}

    def fetch_blast_radius(self, target: str, hops: int = HOPS, limit: int = ANSWER) -> dict:
        """The files with ``found``; what a target means first tells its own file."""
        own = self.store.graph().found([target]).orderBy("by_path", blank(F.col("file")) == "", "id").first()
        if own is None or not own["file"]:
            return {"target": target, "found": False, "files": [], "updated_at": None}
        return {"target": target, "target_file": own["file"], "found": True} | _answer("files", self.blast_radius(target, hops), limit) | {"updated_at": self.store.updated_at(own["file"])}

    def fetch_batch_impact(self, targets: str | list[str], hops: int = HOPS, limit: int = ANSWER) -> dict:
        """The files with the targets that were ``resolved`` and those ``not_found``."""
        asked = asked_for(targets)
        meant = {r["target"]: r["file"] for r in self.store.graph().found(asked).filter(blank(F.col("file")) != "").groupBy("target").agg(F.min("file").alias("file")).collect()}
        resolved = [t for t in asked if t in meant]
        files = _answer("files", self.batch_impact(resolved, hops), limit) if resolved else {"files": []}
        updated = self.store.updated_at(meant[resolved[0]]) if resolved else None
        return {"targets": asked, "resolved": resolved, "not_found": [t for t in asked if t not in meant]} | files | {"updated_at": updated}

    def fetch_dead_code(self, entry_points: bool = False, limit: int = ANSWER) -> dict:
        found = self.dead_code(True)
        maybe = found.filter("verdict <> 'dead'")
        out = _answer("dead", found.filter("verdict = 'dead'"), limit) | {"maybe_entrypoint_count": maybe.count()}
        return out | ({"maybe_entrypoints": _rows(maybe.limit(limit))} if entry_points else {})

    def fetch_tree(self, limit: int = ANSWER) -> dict:
        return {"project": self.project} | _answer("tree", self.tree(), limit) | {"last_ingested": self.store.last_ingested()}

    def node_count(self) -> int:
        return self.store.graph().nodes.count()

    def flow(self, start: str, hops: int = HOPS) -> dict:
        nodes, edges = self.store.graph().flow(start, hops)
        n, e = render.collected(nodes, edges)
        return {"nodes": n, "edges": render.ordered(n, e)[0]}

    def flow_summary(self, start: str, hops: int = HOPS, fmt: str = "mermaid") -> dict:
        """A flow as a picture or JSON; of the tree, only the files of its nodes are read."""
        nodes, edges = self.store.graph().flow(start, hops)
        contexts = None
        if fmt == "json":
            nodes = written(nodes, "flow")
            paths = [r["file"] for r in nodes.select("file").filter(blank(F.col("file")) != "").distinct().collect()]
            contexts = {r["id"]: r.asDict() for r in with_context(nodes, registry.scan(self.spark, self.root, [], (), only=paths)).collect()}
        return render.summary(nodes, edges, start, fmt, contexts)


#: Kinds of corrections that come as tables: what asks, what changes, and the statuses that change something.
BULK = {
    "add_entity": (writeback.added_entities, writeback.entity_changes, ("created", "updated")),
    "add_call": (writeback.added_calls, writeback.call_changes, ("added",)),
    "delete_entity": (writeback.deleted_entities, writeback.deletion_changes, ("deleted", "stripped")),
    "delete_call": (writeback.removed_calls, writeback.removal_changes, ("removed",)),
    "modify_relation": (writeback.modified_relations, writeback.relation_changes, ("modified",)),
    "describe": (writeback.described, writeback.description_changes, ("updated", "cleared")),
}


class Workspace:
    """The repository that questions go to, of several that have their graphs below one folder."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home, self._active = spark, home.rstrip("/"), None

    def set_repo(self, root: str) -> Repository:
        """Makes a tree the one that is asked; its project is its folder's name."""
        project = root.rstrip("/").rpartition("/")[2]
        self._active = Repository(self.spark, root, f"{self.home}/{project}", project)
        return self._active

    def get_repo(self) -> Repository:
        if self._active is None:
            raise LookupError("no repository is set")
        return self._active


def _with_imports(graph: Graph, psr4: dict[str, str], answer: dict, changes: Changes | None) -> tuple[dict, Changes | None]:
    """The change with the pairs of files that the importers among its edges have afterwards."""
    if changes is None or changes.edges is None:
        return answer, changes
    held = replace(changes, edges=written(changes.edges, "changed-edges"))
    imports = held.edges.filter("type = 'IMPORTS'")
    if not imports.limit(1).count():
        return answer, held
    gone = imports.filter("gone") if "gone" in imports.columns else imports.limit(0)
    files = imports.select("source_file").unionByName(graph.edges.join(gone.select("src", "dst", "type"), ["src", "dst", "type"], "left_semi").select("source_file"))
    files = written(files.filter(blank(F.col("source_file")) != "").distinct(), "changed-importers")
    nodes, edges = applied(graph.nodes, graph.edges, held)
    own = Graph(nodes, edges.join(files, "source_file", "left_semi").select(*edges.columns), graph.project).importers(psr4)
    pairs = files.select(F.col("source_file").alias("importer"), F.lit(None).cast("string").alias("target"), F.lit(True).alias("gone")).unionByName(own.withColumn("gone", F.lit(False)))
    return answer, replace(held, imports=pairs)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _answer(name: str, df: DataFrame, limit: int) -> dict:
    """The first rows of an answer, with ``truncated`` if there are more."""
    found = _rows(df.limit(limit + 1))
    return {name: found[:limit]} | ({"truncated": True} if len(found) > limit else {})


def _like(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old rows with the columns of the new ones."""
    return old.select(*[(F.col(f.name) if f.name in old.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in new.schema])
