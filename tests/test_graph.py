"""Graph operators on small graphs made of triples."""

import time
import uuid

import pytest
from pyspark.sql import functions as F

from graphloom.functions.columns import receiver_matches, stable_uuid
from graphloom import scratch
from graphloom.operators import incremental, lookup, mutate, vectors, writeback
from graphloom.operators.changes import applied
from graphloom.operators.graph import Graph
from graphloom.plans import keeping
from graphloom.scratch import written
from graphloom.schemas import NODES, TRIPLES
from graphloom.sources import ignore


def triple(seq, a, at, rel, b, bt, file, line, recv=None, rtype=None, exported=False, owner=None):
    return (seq, a, at, rel, b, bt, file, line, recv, rtype, exported, owner)


def graph(spark, *triples):
    t = spark.createDataFrame([triple(k, *x) for k, x in enumerate(triples)], TRIPLES)
    files = t.select(F.col("source_file").alias("path")).distinct().withColumn("id", F.concat(F.lit("demo:file:"), "path"))
    nodes, edges = mutate.graph_of(t, "demo", files)
    file_nodes = files.select("id", F.lit("File").alias("type"), F.col("path").alias("name"), "path", F.lit("demo").alias("project"), F.lit(-1).cast("bigint").alias("node_seq"))
    return Graph(written(nodes.unionByName(file_nodes, allowMissingColumns=True).coalesce(1), "test-nodes"), written(edges.coalesce(1), "test-edges"), "demo")


HANDLE = [
    ("handle", "function", "DEFINED_IN", "lib", "module", "lib.js", 3),
    ("appCaller", "function", "CALLS", "handle", "function", "a.js", 5, "app"),
    ("routerCaller", "function", "CALLS", "handle", "function", "b.js", 6, "router"),
]


def callers(df):
    return {r["caller_name"] for r in df.collect()}


def test_receiver_tells_callers_apart(spark):
    g = graph(spark, *HANDLE)
    assert callers(g.impact("handle")) == {"appCaller", "routerCaller"}
    assert callers(g.impact("app.handle")) == {"appCaller"}
    assert callers(g.impact("router.handle")) == {"routerCaller"}


def test_type_goes_before_name(spark):
    g = graph(
        spark,
        ("quack", "function", "DEFINED_IN", "lib", "module", "lib.js", 3),
        ("real", "function", "CALLS", "quack", "function", "a.js", 5, "r", "Router"),
        ("fake", "function", "CALLS", "quack", "function", "b.js", 6, "Router", "Duck"),
    )
    found = g.impact("Router.quack").collect()
    assert [(r["caller_name"], r["receiver_type"], r["caller_file"], r["line"]) for r in found] == [("real", "Router", "a.js", 5)]


def test_bucket_of_the_bare_name_as_last_resort(spark):
    two = [("send", "function", "DEFINED_IN", f"m{k}", "module", f"m{k}.py", 2, None, None, False, o) for k, o in enumerate(("Session", "Adapter"))]
    g = graph(spark, *two, ("user", "function", "CALLS", "send", "function", "u.py", 9, "x"))
    found = g.impact("Session.send").collect()
    assert [(r["caller_name"], r["resolved"], r["depth"]) for r in found] == [("user", False, 1)]


def test_hops_cycles_and_parallel_edges(spark):
    defs = [(n, "function", "DEFINED_IN", "m", "module", "m.py", k) for k, n in enumerate("abcd", 1)]
    calls = [(a, "function", "CALLS", b, "function", "m.py", line) for a, b, line in (("a", "b", 10), ("a", "b", 11), ("b", "c", 12), ("c", "a", 13), ("a", "d", 14))]
    g = graph(spark, *defs, *calls)
    assert {(r["callee_name"], r["depth"]) for r in g.trace("a").collect()} == {("b", 1), ("d", 1), ("c", 2)}
    nodes, edges = g.flow("a")
    assert nodes.count() == 4
    assert [(r["from"][-1], r["to"][-1], r["line"]) for r in edges.collect()] == [("a", "b", 10), ("b", "c", 12), ("c", "a", 13), ("a", "d", 14)]
    assert g.trace("a", 0).count() == 0 and g.impact("nobody").count() == 0


def test_blast_radius_resolves_imports(spark):
    base = [("send", "function", "DEFINED_IN", "lib.response", "module", "lib/response.js", 5)]
    g = graph(spark, *base, ("lib.express", "module", "IMPORTS", "./response", "module", "lib/express.js", 1))
    assert {r["file"] for r in g.blast_radius("lib/response.js").collect()} == {"lib/response.js", "lib/express.js"}
    g = graph(spark, *base, ("lib.express", "module", "IMPORTS", "router", "module", "lib/express.js", 1))
    assert {r["file"] for r in g.blast_radius("lib/response.js").collect()} == {"lib/response.js"}
    assert g.blast_radius("no/file.js").count() == 0


def test_dead_code(spark):
    g = graph(
        spark,
        ("send", "function", "DEFINED_IN", "m", "module", "m.py", 1, None, None, True),
        ("orphan", "function", "DEFINED_IN", "m", "module", "m.py", 2),
        ("__call__", "function", "DEFINED_IN", "m", "module", "m.py", 3),
        ("test_it", "function", "DEFINED_IN", "m", "module", "m.py", 4),
    )
    found = {r["name"]: r["verdict"] for r in g.dead_code().collect()}
    assert found == {"send": "maybe_entrypoint", "orphan": "dead", "__call__": "maybe_entrypoint", "test_it": "maybe_entrypoint"}


def test_grep(spark):
    g = graph(
        spark,
        ("HTTPAdapter", "class", "DEFINED_IN", "adapters", "module", "adapters.py", 1),
        ("get_adapter", "function", "DEFINED_IN", "sessions", "module", "sessions.py", 2),
        ("send", "function", "DEFINED_IN", "sessions", "module", "sessions.py", 3),
    )
    names = lambda *a, **k: {r["name"] for r in g.grep(*a, **k).collect()}
    assert names("^get_", "name") == {"get_adapter"}
    assert names("Adapter|send", "name") >= {"HTTPAdapter", "get_adapter", "send"}
    assert names("sessions", "file") == {"get_adapter", "send"}
    assert g.grep("a", limit=1).count() == 1
    with pytest.raises(ValueError, match="invalid regex"):
        g.grep("(")


def test_resolution_priorities(spark):
    t = spark.createDataFrame(
        [
            triple(0, "Dog", "class", "DEFINED_IN", "m", "module", "dog.py", 1),
            triple(1, "bark", "function", "DEFINED_IN", "m", "module", "dog.py", 2, owner="Dog"),
            triple(2, "bark", "function", "DEFINED_IN", "m", "module", "tree.py", 2, owner="Tree"),
            triple(3, "only", "function", "DEFINED_IN", "m", "module", "o.py", 1),
            triple(4, "x", "function", "CALLS", "bark", "function", "x.py", 5, "d", "Dog"),
            triple(5, "x", "function", "CALLS", "bark", "function", "x.py", 6),
            triple(6, "x", "function", "CALLS", "only", "function", "x.py", 7),
            triple(7, "x", "function", "CALLS", "print", "function", "x.py", 8),
        ],
        TRIPLES,
    )
    got = {r["seq"]: r["to_id"] for r in mutate.resolved_triples(t, "p").collect()}
    assert got == {0: "p:m", 1: "p:m", 2: "p:m", 3: "p:m", 4: "p:dog.py:Dog.bark", 5: "p:bark", 6: "p:o.py:only", 7: "p:print"}


def test_triples_move_once_at_most(spark, monkeypatch):
    """Few answers are broadcast; beyond that triples are dealt out once, but for those that ask for what very many ask for."""
    rows = [triple(k, f"f{k}", "function", "DEFINED_IN", "m", "module", f"{k % 3}.py", 1, owner=["A", "B", None][k % 3]) for k in range(30)]
    rows += [triple(30 + k, "x", "function", "CALLS", "f1" if k % 2 else f"f{k % 40}", "function", "x.py", k, "r", [None, "A", "B"][k % 3]) for k in range(200)]
    t = written(spark.createDataFrame(rows, TRIPLES), "test-triples")
    moved = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    near = mutate.resolved_triples(t, "p")
    assert moved(near) == 0
    want = sorted(map(str, near.collect()))
    monkeypatch.setattr(mutate, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        far = mutate.resolved_triples(t, "p")
        assert moved(far) == 2  # the triples, and the answers
        assert sorted(map(str, far.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_last_writer_first_writer_and_sticky_export(spark):
    t = spark.createDataFrame(
        [
            triple(0, "f", "function", "DEFINED_IN", "m", "module", "m.py", 7, exported=True),
            triple(1, "f", "class", "CALLS", "g", "function", "m.py", 9),
        ],
        TRIPLES,
    )
    nodes = {r["id"]: r for r in mutate.graph_of(t, "p")[0].collect()}
    f = nodes["p:m.py:f"]
    assert (f["entity_type"], f["kind"], f["line"], f["is_exported"]) == ("class", "class:python", 7, True)
    assert (nodes["p:g"]["file"], nodes["p:g"]["kind"], nodes["p:m"]["line"]) == (None, "function", 1)


def test_agents_corrections(spark):
    g = graph(
        spark,
        ("caller", "function", "DEFINED_IN", "a", "module", "a.py", 1),
        ("callee", "function", "DEFINED_IN", "a", "module", "a.py", 2),
        ("shared", "function", "DEFINED_IN", "b", "module", "b.py", 1),
        ("shared", "function", "DEFINED_IN", "c", "module", "c.py", 1),
    )
    asked = spark.createDataFrame(
        [("caller", "callee", "CALLS"), ("caller", "shared", "CALLS"), ("ghost", "callee", "CALLS"), ("caller", "pathlib", "imports"), ("caller", "pathlib", "CALLS"), ("caller", "callee", "CONTAINS")],
        "caller string, callee string, relation string",
    )
    told = writeback.added_calls(g, asked)
    got = {(r["caller"], r["callee"], r["relation"]): r["status"] for r in told.collect()}
    assert got == {
        ("caller", "callee", "CALLS"): "added", ("caller", "shared", "CALLS"): "ambiguous", ("ghost", "callee", "CALLS"): "skipped",
        ("caller", "pathlib", "imports"): "added", ("caller", "pathlib", "CALLS"): "skipped", ("caller", "callee", "CONTAINS"): "skipped",
    }
    nodes, edges = writeback.with_calls(g, told)
    module = nodes.filter("name = 'pathlib'").first()
    assert (module["id"], module["kind"], module["file"], module["agent_created"]) == ("demo:pathlib", "module:python", None, True)
    assert {(r["dst"], r["type"], r["source_file"]) for r in edges.filter("agent_inferred").collect()} == {("demo:a.py:callee", "CALLS", "a.py"), ("demo:pathlib", "IMPORTS", "a.py")}


def test_a_deletion_looks_up_what_is_meant_once(spark, monkeypatch):
    """The answers read three tables, what is meant, its nodes and its edges, however many lookups there are; few or many values give the same."""
    g = graph(
        spark,
        ("caller", "function", "DEFINED_IN", "a", "module", "a.py", 1),
        ("callee", "function", "DEFINED_IN", "a", "module", "a.py", 2),
        ("shared", "function", "DEFINED_IN", "b", "module", "b.py", 1),
        ("shared", "function", "DEFINED_IN", "c", "module", "c.py", 1),
    )
    pairs = spark.createDataFrame([("caller", "callee", "registers"), ("callee", "caller", "registers"), ("caller", "caller", "handles")], "caller string, callee string, relation string")
    g = Graph(*(written(df, "test-graph") for df in writeback.with_calls(g, writeback.added_calls(g, pairs))), "demo")
    asked, got = spark.createDataFrame([("caller",), ("shared",), ("ghost",)], "name string"), {}
    for most in (lookup.LOOKUP_ROWS, 0):
        monkeypatch.setattr(lookup, "LOOKUP_ROWS", most)
        told = writeback.deleted_entities(g, asked)
        assert told._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 3
        assert {r["name"]: (r["status"], r["removed"]) for r in told.collect()} == {"caller": ("stripped", ["3 agent edge(s)"]), "shared": ("ambiguous", None), "ghost": ("not_found", None)}
        changes = writeback.deletion_changes(g, told)
        got[most] = [sorted(map(str, df.collect())) for df in (changes.nodes, changes.edges.select("src", "dst", "type", "gone"))]
        assert changes.edges.filter("gone").count() == 3
    assert got[0] == got[max(got)]


def test_answers_to_corrections_go_when_they_are_in_the_log(spark, monkeypatch):
    monkeypatch.setattr(keeping, "_logged", {})
    before = set(scratch._made)
    assert keeping.agent_log_edges(spark, "/root/testdata/sf0.001").filter("agents").count()
    assert not set(scratch._made) - before


def test_file_less_nodes_are_no_match_but_for_imports(spark):
    """A call of something unknown leaves a bucket; no edge of another kind may end there, and no name gets ambiguous by it."""
    g = graph(
        spark,
        ("caller", "function", "DEFINED_IN", "a", "module", "a.py", 1),
        ("twice", "function", "DEFINED_IN", "a", "module", "a.py", 2),
        ("caller", "function", "CALLS", "outside", "function", "a.py", 3),
    )
    bucket = spark.createDataFrame([("demo:twice", "Entity", "twice", "demo")], "id string, type string, name string, project string")
    g = Graph(g.nodes.unionByName(bucket, allowMissingColumns=True), g.edges, "demo")
    asked = spark.createDataFrame(
        [("caller", "outside", "REGISTERS", None), ("caller", "twice", "REGISTERS", None), ("caller", "twice", "IMPORTS", None), ("caller", "twice", "CALLS", "b.py"), ("caller", "outside", "IMPORTS", None), ("caller", "outside", "IMPORTS", None)],
        "caller string, callee string, relation string, callee_file string",
    )
    got = sorted((r["callee"], r["relation"], r["status"]) for r in writeback.added_calls(g, asked).collect())
    assert got == [
        ("outside", "IMPORTS", "added"), ("outside", "IMPORTS", "exists"), ("outside", "REGISTERS", "skipped"),
        ("twice", "CALLS", "ambiguous"), ("twice", "IMPORTS", "ambiguous"), ("twice", "REGISTERS", "added"),
    ]


def test_hops_scan_nodes_past_the_frontier(spark):
    """A hop joins the nodes with a broadcast frontier; the nodes are not moved."""
    import io
    from contextlib import redirect_stdout

    from graphloom.operators.traverse import within

    near = spark.createDataFrame([("a", 1, "b")], "id string, depth int, via string")
    many = spark.range(1_000_000).select(F.col("id").cast("string").alias("id"))
    for rows in (1, 1000):
        with redirect_stdout(io.StringIO()) as out:
            within(many)(near, rows).explain()
        assert "BroadcastHashJoin" in out.getvalue() and "hashpartitioning" not in out.getvalue()


def test_several_targets_are_traversed_at_once(spark):
    g = graph(
        spark,
        ("a", "function", "DEFINED_IN", "a", "module", "a.py", 1), ("b", "function", "DEFINED_IN", "b", "module", "b.py", 1), ("c", "function", "DEFINED_IN", "c", "module", "c.py", 1),
        ("b", "function", "CALLS", "a", "function", "b.py", 2), ("c", "function", "CALLS", "b", "function", "c.py", 2),
    )
    got = {(r["file"], r["hops"], tuple(r["via"])) for r in g.batch_impact("a, b,, nothing,a").collect()}
    assert got == {("a.py", 0, ("a",)), ("b.py", 0, ("a", "b")), ("c.py", 1, ("a", "b"))}
    assert g.batch_impact("").count() == 0 and g.batch_impact([]).columns == ["file", "hops", "via"]


def test_patterns_are_the_engines(spark):
    g = graph(spark, *HANDLE)
    for bad in ("(", "(?P<n>fo)", "[z-a]"):
        with pytest.raises(ValueError, match="invalid regex"):
            g.grep(bad)


def test_rebuild_keeps_what_agents_made_while_its_file_is_there(spark):
    old = spark.createDataFrame([("a", "said", None, "x.py"), ("b", "mine", True, "x.py"), ("c", "mine", True, "gone.py"), ("d", "theirs", None, "x.py")], "id string, description string, agent_created boolean, file string")
    new = spark.createDataFrame([("a", None, None, "x.py"), ("e", None, None, "x.py")], "id string, description string, agent_created boolean, file string")
    files = spark.createDataFrame([("x.py",)], "path string")
    got = {r["id"]: r["description"] for r in mutate.rebuilt_nodes(old, new, files).collect()}
    assert got == {"a": "said", "b": "mine", "e": None}


def test_changed_files_leave_no_line_of_a_graph_before_if_made_anew(spark):
    """A definition whose new line isn't known: a rebuild keeps the old one, a graph made anew has none."""
    row = lambda seq, name, line: (seq, name, "function", "DEFINED_IN", "a", "module", "a.py", line, None, None, False, None)
    schema = "seq bigint, from_entity string, from_type string, relation_type string, to_entity string, to_type string, source_file string, line_number int, call_receiver string, call_receiver_type string, is_exported boolean, owner_class string"
    t = mutate.resolved_triples(spark.createDataFrame([row(1, "f", 7), row(2, "g", 8)], schema), "p")
    nodes, edges = mutate.nodes_of(t, "p"), mutate.edges_of(t)
    given = spark.createDataFrame([row(3, "f", 0)], schema)
    none, files = spark.createDataFrame([], "id string"), spark.createDataFrame([("a.py", "file:a.py")], "path string, id string")
    for anew, line in ((False, 7), (True, None)):
        known = incremental.tables(t, nodes, edges, "p", {})
        told = incremental.changes(Graph(nodes, edges, "p"), known, files.select("path"), given, nodes.limit(0), edges.limit(0), none, files, None, {}, anew=anew)
        got = {r["name"]: (r["line"], r["node_seq"]) for r in applied(nodes, edges, told)[0].filter("entity_type = 'function'").collect()}
        assert got == {"f": (line, 6)}


def _calls(spark):
    """A function that makes triples of (seq, file, name, called): of definitions, or of calls if ``called`` is given."""
    schema = "seq bigint, from_entity string, from_type string, relation_type string, to_entity string, to_type string, source_file string, line_number int, call_receiver string, call_receiver_type string, is_exported boolean, owner_class string"
    row = lambda seq, file, name, called=None: (seq, name, "function", "CALLS" if called else "DEFINED_IN", called or "m", "function" if called else "module", file, seq, None, None, False, None)
    return lambda *given: spark.createDataFrame([row(*g) for g in given], schema)


def _all_of(nodes, edges):
    nodes = nodes.select("id", "name", "entity_type", "file", "line", "node_seq").collect()
    return sorted(map(str, nodes)), sorted(map(str, edges.select("src", "dst", "type", "source_file", "line", "edge_seq").collect()))


@pytest.mark.parametrize("changed", [("a.py", "b.py", "c.py"), ("a.py",), ("a.py", "c.py")])
def test_changed_files_are_told_from_what_they_touch(spark, monkeypatch, changed):
    """All files, or some: the graph is the one made anew, and where all changed nothing is looked up in what was there before."""
    call = _calls(spark)
    old = {"a.py": [(1, "a.py", "f"), (2, "a.py", "g")], "b.py": [(3, "b.py", "h"), (4, "b.py", "h", "f"), (5, "b.py", "h", "k")], "c.py": [(6, "c.py", "k"), (7, "c.py", "k", "g")]}
    new = {"a.py": [(1, "a.py", "f2"), (2, "a.py", "g")], "b.py": [(3, "b.py", "h"), (4, "b.py", "h", "f2")], "c.py": []}
    t = mutate.resolved_triples(call(*sum(old.values(), [])), "p")
    ids = spark.createDataFrame([(f, "file:" + f) for f in old], "path string, id string")
    left = ids.filter("path <> 'c.py'") if "c.py" in changed else ids
    nodes, edges = mutate.nodes_of(t, "p"), mutate.edges_of(t, ids)
    fresh = call(*sum((new[f] for f in changed), []))
    names, write = [], incremental.written
    monkeypatch.setattr(incremental, "written", lambda df, name: names.append(name) or write(df, name))
    none, paths = spark.createDataFrame([], "id string"), spark.createDataFrame([(f,) for f in changed], "path string")
    told = incremental.changes(Graph(nodes, edges, "p"), incremental.tables(t, nodes, edges, "p", {}), paths, fresh, nodes.limit(0), edges.limit(0), none, left, None, {}, anew=True)
    want = mutate.resolved_triples(call(*sum((new[f] if f in changed else old[f] for f in old), [])), "p")
    want = _all_of(mutate.nodes_of(want, "p"), mutate.edges_of(want, left))
    assert _all_of(*applied(nodes, edges, told)) == want
    rest = t.filter(~t.source_file.isin(*changed))
    assert _all_of(*applied(mutate.nodes_of(rest, "p"), mutate.edges_of(rest, ids), told)) == want
    assert names == ["touched", "definitions", "resolved", "wanted"] if len(changed) == 3 else "touched-nodes" in names


def _shuffles(spark, least=0):
    """The number of shuffle files there are, after a while to delete them."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    for _ in range(50):
        files = disk.getAllFiles()
        n = sum(files.apply(k).getName().startswith("shuffle_") for k in range(files.size()))
        if n <= least:
            break
        time.sleep(0.1)
    return n


def test_tables_leave_no_shuffle_files_and_building_leaves_one_table(spark):
    setting, there, made = spark.conf.get(scratch._RELEASE), _shuffles(spark), set(scratch._made)
    rows = spark.range(1000).withColumn("x", F.rand()).repartition(4, "x")
    assert scratch.written(rows, "left").count() == 1000
    t = spark.createDataFrame([triple(k, *x) for k, x in enumerate(HANDLE)], TRIPLES)
    assert mutate.graph_of(t, "p")[0].count() > 0 and spark.conf.get(scratch._RELEASE) == setting
    assert sorted(p.rsplit("/", 1)[-1].split("-")[0] for p in set(scratch._made) - made) == ["left", "resolved"]
    done = rows.groupBy("x").count()
    with scratch.released(spark):
        before = _shuffles(spark, there)
        assert done.filter("x > 0").collect()
    assert _shuffles(spark, before) <= before
    assert spark.conf.get(scratch._RELEASE) == setting


def test_search_finds_the_described_entity(spark):
    rows = [("1", "Entity", "session_handler", "function:python", "a.py", "handles session timeout"), ("2", "Entity", "render_button", "function:python", "b.py", None), ("3", "File", "f.py", None, None, None)]
    nodes = spark.createDataFrame(rows, "id string, type string, name string, kind string, file string, description string").withColumn("line", F.lit(1))
    index = vectors.indexed(nodes)
    found = vectors.search(index, "session timeout").collect()
    assert [r["name"] for r in found] == ["session_handler", "render_button"] and found[0]["score"] > found[1]["score"]


@pytest.mark.parametrize(
    ("path", "patterns", "out"),
    [
        ("api/vendor/dep/b.py", ["vendor"], True), ("src/a.py", ["vendor", "*.min.js"], False), ("static/app.min.js", ["*.min.js"], True),
        ("api/generated/x.py", ["api/generated/*"], True), ("x/api/generated/y.py", ["api/generated/*"], False), ("node_modules/c.py", [], True), ("a/b.txt", ["a"], True),
    ],
)
def test_ignore_rules(spark, path, patterns, out):
    import re

    assert spark.range(1).select(ignore.ignored(F.lit(path), patterns)).first()[0] == out
    assert any(re.match(ignore.regex_of(p), path) for p in patterns) == (out and "node_modules" not in path)


def test_ids_equal_pythons(spark):
    got = spark.createDataFrame([("folder:x:a/b",), ("é",)], "k string").select("k", stable_uuid(F.col("k")).alias("u")).collect()
    assert all(r["u"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, r["k"])) for r in got)


def test_receiver_rules(spark):
    cases = [("this", None, True), ("x", "app", True), ("app", "Duck", False), (None, None, False), ("a.app", None, True), ("xapp", None, False)]
    df = spark.createDataFrame(cases, "r string, t string, want boolean")
    assert df.filter(receiver_matches("app", F.col("r"), F.col("t")) != F.col("want")).count() == 0


def test_watch_stream(spark, tmp_path):
    from graphloom.schemas import EVENTS
    from graphloom.streaming.watch import watch
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, at(1), "created", "a.py", None), (2, at(2), "modified", "a.py", None), (3, at(3), "moved", "a.py", "b.py"), (4, at(4), "deleted", "c.py", None), (5, at(5), "created", "node_modules/x.py", None)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = {"changed": set(), "deleted": set()}

    def apply(changed, deleted):
        seen["changed"] |= {r["path"] for r in changed.collect()}
        seen["deleted"] |= {r["path"] for r in deleted.collect()}

    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    watch(stream, apply, str(tmp_path / "cp")).awaitTermination(60)
    assert seen == {"changed": {"b.py"}, "deleted": {"a.py", "c.py"}}


def test_empty_tables(spark):
    g = Graph(spark.createDataFrame([], NODES), graph(spark, *HANDLE).edges.limit(0), "demo")
    assert g.impact("a.b").count() == 0 and g.tree().count() == 0 and g.dead_code().count() == 0 and g.blast_radius("x").count() == 0
