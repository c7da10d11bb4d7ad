"""A source tree end to end: ingest, ask, correct, rebuild, render, load and dump."""

import json
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from graphloom.api import Repository
from graphloom.operators import render
from graphloom.schemas import TRIPLES
from graphloom.sources import store
from graphloom.sources.context import context

A = 'def entry():\n    """Starts."""\n    first()\n    second()\n\ndef first():\n    second()\n\ndef second():\n    entry()\n'


@pytest.fixture
def repo(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text(A)
    (tmp_path / "src" / "b.py").write_text("from src.a import entry\nimport src.a\ndef use_it():\n    entry()\n")
    return Repository(spark, str(tmp_path / "src"), f"file://{tmp_path}/home", "demo")


def test_ingest_and_ask(repo, tmp_path):
    assert repo.store.version() is None and repo.impact("entry").count() == 0
    assert repo.ingest()["status"] == "published"
    assert {r["caller_name"] for r in repo.impact("second", 1).collect()} == {"entry", "first"}
    assert {r["name"] for r in repo.dead_code(True).collect()} >= {"use_it"}
    assert {(r["node_type"], r["depth"]) for r in repo.tree().collect()} >= {("File", 1), ("Entity", 2)}
    assert repo.grep("^use_").count() == 1 and repo.trace("use_it").count() == 3
    assert {r["file"] for r in repo.blast_radius("entry").collect()} == {"a.py", "b.py"}
    assert repo.index() == repo.store.graph().entities().count() and repo.search("use it", 3).count() == 3
    flow = repo.flow("entry")
    assert [(e["from"].rsplit(":")[-1], e["to"].rsplit(":")[-1], e["order"]) for e in flow["edges"]] == [
        ("entry", "first", 1), ("entry", "second", 2), ("first", "second", 3), ("second", "entry", 4),
    ]
    full = json.loads(repo.flow_summary("entry", fmt="json")["content"])
    assert full["nodes"][0]["docstring"] == "Starts." and full["nodes"][0]["signature"] == "def entry()"
    repo.store.write_files(f"file://{tmp_path}/files")
    assert [r[0] for r in repo.spark.read.text(f"file://{tmp_path}/files").collect()] == ["a.py", "b.py"]


def test_rebuild_keeps_descriptions_and_a_failed_one_changes_nothing(repo, tmp_path):
    repo.ingest()
    assert repo.describe("first", "goes first")["status"] == "updated"
    version = repo.store.version()

    def broken(triples):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        repo.ingest(normalize=broken)
    assert repo.store.version() == version
    (tmp_path / "src" / "b.py").unlink()
    repo.ingest()
    g = repo.store.graph()
    assert g.nodes.filter("name = 'first'").first()["description"] == "goes first"
    assert g.nodes.filter("name = 'use_it'").count() == 0 and repo.store.version() != version
    (tmp_path / "src" / "a.py").unlink()
    kept = repo.store.version()
    (tmp_path / "src" / "c.py").write_text("")
    assert repo.ingest()["status"] == "abandoned" and repo.store.version() == kept


def test_watch_follows_files(repo, tmp_path, spark):
    import datetime as dt

    from graphloom.schemas import EVENTS

    repo.ingest()
    assert repo.store.graph().covers("") and repo.store.graph().covers("B.py") and not repo.store.graph().covers("c")
    (tmp_path / "src" / "b.py").unlink()
    (tmp_path / "src" / "c.py").write_text("def newly():\n    first()\n")
    rows = [(1, dt.datetime(2024, 1, 1), "deleted", "b.py", None), (2, dt.datetime(2024, 1, 1), "created", "c.py", None)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "events"))
    repo.watch(stream, str(tmp_path / "cp")).awaitTermination(120)
    g = repo.store.graph()
    assert {r["path"] for r in g.files().collect()} == {"a.py", "c.py"} and g.nodes.filter("name = 'use_it'").count() == 0
    assert {r["caller_name"] for r in g.impact("first", 1).collect()} == {"entry", "newly"}


def test_what_agents_write_is_published_and_outlives_an_ingest(repo, tmp_path):
    assert repo.add_call("use_it", "second")["status"] == "skipped"  # nothing is published yet
    repo.ingest()
    made = repo.add_entity("helper", file="b.py", line=9, description="Async helper.")
    node = repo.store.graph().nodes.filter(F.col("id") == made["id"]).first()
    assert made["status"] == "created" and (node["kind"], node["language"], node["line"], node["agent_created"]) == ("function:python", "python", 9, True)
    assert repo.add_entity("helper", kind="class", file="b.py")["status"] == "updated" and repo.description(made["id"]) == "Async helper."
    assert repo.store.graph().nodes.filter("name = 'helper'").first()["kind"] == "class:python"
    assert repo.add_call("use_it", "second", line=2)["status"] == "added" and repo.add_call("use_it", "second")["status"] == "exists"
    assert repo.add_call("use_it", "pathlib", relation="imports")["status"] == "added" and repo.add_call("use_it", "pathlib")["status"] == "skipped"
    assert "reason" in repo.add_call("ghost", "second") and repo.add_call("use_it", "second", relation="CONTAINS")["status"] == "skipped"
    (tmp_path / "src" / "notes.txt").write_text("not indexed")
    kept = repo.add_entity("idea", kind="note", file="notes.txt")
    lost = repo.add_entity("lost", file="gone.py")
    repo.ingest()
    g = repo.store.graph()
    agents = {(r["src"].rsplit(":")[-1], r["dst"].rsplit(":")[-1], r["type"]) for r in g.edges.filter("agent_inferred").collect()}
    assert agents == {("use_it", "second", "CALLS"), ("use_it", "pathlib", "IMPORTS")} and repo.description(made["id"]) == "Async helper."
    assert {r["id"] for r in g.nodes.filter("agent_created").collect()} == {made["id"], kept["id"], "demo:pathlib"} and lost["status"] == "created"
    assert repo.delete_call("use_it", "second")["status"] == "removed" and repo.delete_call("use_it", "second")["status"] == "not_found"
    assert repo.delete_call("use_it", "entry")["status"] == "skipped"  # the parser's
    assert repo.delete_entity("helper")["status"] == "deleted" and repo.delete_entity("helper")["status"] == "not_found" and repo.delete_entity(id="demo:b.py:helper")["status"] == "not_found"


def test_names_that_are_shared_come_with_candidates(repo, tmp_path):
    (tmp_path / "src" / "c.py").write_text("def second():\n    pass\n")
    repo.ingest()
    told = repo.add_call("use_it", "second", relation="REGISTERS")
    assert told["status"] == "ambiguous" and told["side"] == "callee" and [c["file"] for c in told["candidates"]] == ["a.py", "c.py"]
    assert repo.add_call("use_it", "second", relation="REGISTERS", callee_file="c.py")["status"] == "added"
    assert repo.add_entity("second")["status"] == "ambiguous" and len(repo.delete_entity("second")["candidates"]) == 2
    assert repo.describe("second", "x")["status"] == "ambiguous" and repo.describe("nowhere", "x")["status"] == "not_found"
    assert repo.describe("second", "said", file="c.py")["status"] == "updated" and repo.description("demo:c.py:second") == "said"
    assert repo.describe("second", "  ", file="c.py")["status"] == "cleared" and repo.description("demo:c.py:second") == ""
    assert repo.add_entity("second", file="c.py", description="again")["status"] == "updated"
    stripped = repo.delete_entity("second", file="c.py")
    g = repo.store.graph()
    assert stripped["status"] == "stripped" and stripped["removed"] == ["description", "1 agent edge(s)"] and g.edges.filter("agent_inferred").count() == 0
    assert g.nodes.filter("id = 'demo:c.py:second' and agent_inferred is null and description is null").count() == 1


def test_a_retyped_relation_outlives_an_ingest(repo, spark):
    repo.ingest()
    assert repo.modify_relation("entry", "first", "CONTAINS")["status"] == "skipped" and repo.modify_relation("entry", "use_it", "A")["status"] == "not_found"
    assert repo.add_call("entry", "first", relation="REGISTERS")["status"] == "added"
    several = repo.modify_relation("entry", "first", "handles")
    assert several["status"] == "ambiguous" and several["candidates"] == [{"relation": "CALLS"}, {"relation": "REGISTERS"}]
    assert repo.modify_relation("entry", "first", "handles", from_relation="IMPORTS")["status"] == "not_found"
    done = repo.modify_relation("entry", "first", "handles", from_relation="calls")
    assert (done["status"], done["old"], done["type"], done["n"]) == ("modified", "CALLS", "HANDLES", 1)
    assert repo.modify_relation("entry", "second", "registers")["status"] == "modified"
    repo.ingest()
    own = lambda a, b: sorted(r["type"] for r in repo.store.graph().edges.filter((F.col("src") == f"demo:a.py:{a}") & (F.col("dst") == f"demo:a.py:{b}")).collect())
    assert own("entry", "first") == ["HANDLES"] and own("entry", "second") == ["REGISTERS"] and own("first", "second") == ["CALLS"]


def test_the_ignore_list_holds_for_ingest_and_changes(repo, tmp_path, spark):
    import datetime as dt

    from graphloom.schemas import EVENTS

    for path in ("vendor/v.py", "UP.PY", "node_modules/n.py", "empty/inner/readme.txt"):
        (tmp_path / "src" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / path).write_text("def f():\n    pass\n")
    (tmp_path / "src" / ".ccignore").write_text("# ours\nvendor/\n")
    repo.ingest()
    files = lambda: {r["path"] for r in repo.store.graph().files().collect()}
    assert files() == {"a.py", "b.py", "UP.PY"}
    assert {r["path"] for r in repo.store.graph().nodes.filter("type = 'Folder'").collect()} == {"empty", "empty/inner"}
    assert {r["extension"] for r in repo.store.graph().nodes.filter("type = 'File'").collect()} == {".py"}
    (tmp_path / "src" / "a.py").write_text("def entry():\n    pass\n")
    rows = [(1, dt.datetime(2024, 1, 1), "modified", "a.py", None), (2, dt.datetime(2024, 1, 1), "modified", "vendor/v.py", None)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "events"))
    repo.watch(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "events")), str(tmp_path / "cp")).awaitTermination(120)
    assert files() == {"a.py", "b.py", "UP.PY"} and repo.store.graph().nodes.filter("name = 'second'").count() == 0
    assert [r[0] for r in spark.read.text(f"{repo.home}/files.txt").collect()] == ["UP.PY", "a.py", "b.py"]


def test_readers_always_find_a_version(repo):
    """Whatever a publisher has got done when it stops, a version is there, and it is a whole one."""
    repo.ingest()
    versions = [repo.store.version()]
    put = repo.store.versions.put

    def stopped(number, content):
        raise RuntimeError("the publisher is gone")

    repo.store.versions.put = stopped
    with pytest.raises(RuntimeError):
        repo.ingest()
    assert repo.store.version() == versions[0] and repo.store.graph().nodes.count() > 0
    repo.store.versions.put = put
    held = repo.store.graph()
    for _ in range(2):
        versions.append(repo.ingest()["version"])
        assert repo.store.version() == versions[-1]
    assert held.nodes.count() > 0 and len(set(versions)) == 3  # a reader at work keeps its version


def test_answers_tell_what_was_found_and_how_fresh_it_is(repo, tmp_path):
    assert repo.fetch_search("x")["hint"] and repo.fetch_grep("x")["matches"] == []
    repo.ingest(index=True)
    assert repo.fetch_impact("second")["updated_at"] and repo.fetch_impact("nothing")["updated_at"] is None
    radius = repo.fetch_blast_radius("entry")
    assert radius["found"] and radius["target_file"] == "a.py" and {r["file"] for r in radius["files"]} == {"a.py", "b.py"}
    assert repo.fetch_blast_radius("nothing") == {"target": "nothing", "found": False, "files": [], "updated_at": None}
    batch = repo.fetch_batch_impact(["entry, nothing", "use_it"])
    assert (batch["resolved"], batch["not_found"]) == (["entry", "use_it"], ["nothing"]) and batch["files"][0]["via"] == ["entry"] and batch["updated_at"]
    assert repo.fetch_batch_impact("")["files"] == [] and "error" in repo.fetch_grep("(") and repo.fetch_grep("e", limit=1)["truncated"]
    assert repo.fetch_deps("b.py")["dependencies"] and repo.fetch_trace("use_it")["calls"] and repo.fetch_tree()["last_ingested"] and repo.fetch_styles("x")["selectors"] == []
    assert repo.fetch_dead_code()["maybe_entrypoint_count"] and repo.node_count() > 5 and repo.init()["status"] == "ready"
    (tmp_path / "src" / "b.py").write_text("def brand_new():\n    pass\n")
    repo.ingest()  # an index that is there follows
    assert "brand_new" in {r["name"] for r in repo.fetch_search("brand_new", 3)["results"]}


def test_namespaces_of_the_tree_resolve_imports(spark, tmp_path):
    (tmp_path / "src" / "lib").mkdir(parents=True)
    (tmp_path / "src" / "composer.json").write_text('{"autoload": {"psr-4": {"Acme\\\\": "lib/"}}}')
    (tmp_path / "src" / "lib" / "Client.php").write_text("<?php\nnamespace Acme;\nclass Client { function go() { return 1; } }\n")
    (tmp_path / "src" / "main.php").write_text("<?php\nuse Acme\\Client;\nfunction run() { return 2; }\n")
    from graphloom.api import Workspace

    space = Workspace(spark, f"file://{tmp_path}/home")
    with pytest.raises(LookupError):
        space.get_repo()
    one = space.set_repo(str(tmp_path / "src"))
    one.ingest()
    assert space.get_repo() is one and one.store.psr4() == {"Acme": "lib/"}
    assert {(r["importer"], r["target"]) for r in one.store.graph().importers().collect()} == {("main.php", "lib/Client.php")}
    assert {r["file"] for r in one.blast_radius("lib/Client.php").collect()} == {"lib/Client.php", "main.php"}


def test_a_normalizer_corrects_and_never_breaks_a_run(repo):
    from graphloom.sources.normalize import corrected, normalizer

    rows = [{"from_entity": f"f{k}", "from_type": "function", "relation_type": "CALLS", "to_entity": "g", "to_type": "function"} for k in range(4)]
    tries = []

    def flaky(batch):
        tries.append(len(batch))
        if len(tries) < 3:
            raise ValueError("try again")
        return [{"to_entity": "h"}, "nonsense", {"to_entity": 5}]

    assert [r["to_entity"] for r in corrected(rows, flaky)] == ["h", "g", "g", "g"] and tries == [4, 4, 4]
    assert corrected(rows, lambda b: 1 / 0) == rows and corrected(rows, lambda b: "text") == rows
    assert repo.ingest(normalize=normalizer(lambda b: [r | {"to_entity": "renamed"} if r["to_entity"] == "first" else r for r in b], batch=2))["status"] == "published"
    assert {r["caller_name"] for r in repo.impact("renamed", 1).collect()} == {"entry"}


def test_a_model_embeds_batches_by_length(repo):
    from graphloom.operators import vectors

    repo.ingest()
    repo.index(vectors.model(lambda texts: [[float(len(t)), float(len(texts) <= 2)] for t in texts], batch=2))
    found = repo.search("anything at all", 3).collect()
    assert len(found) == 3 and repo._index().rows.filter("size(embedding) = 2 and embedding[1] = 1").count() == repo.store.graph().entities().count()


def test_pictures():
    nodes = [{"id": "p:a", "name": 'a"b', "kind": "function:python", "file": "a.py", "depth": 0}, {"id": "p:b", "name": "b", "kind": "class", "file": "a.py", "depth": 1}]
    edges = [{"from": "p:a", "to": "p:b", "type": "CALLS", "file": "a.py", "line": 3}, {"from": "p:a", "to": "p:a", "type": "CALLS", "file": "a.py", "line": None}]
    text = render.mermaid(nodes, edges, "a")
    assert "n_a[\"a'b\"]:::entryNode" in text and "n_a -->|2| n_b" in text and "n_a -->|1|" not in text and "n_a ~~~ n_b" in text
    root = ElementTree.fromstring(render.drawio(nodes, edges, "a"))
    assert len(root.findall(".//mxCell[@vertex]")) == 2 and len(root.findall(".//mxCell[@edge]")) == 2
    assert render.ordered([], []) == ([], {})


def test_contexts():
    assert context("x = 1\nclass C(B):\n    '''doc'''\n    y = 2\n", "a.py", "C") == {"signature": "class C(B)", "docstring": "doc", "snippet": "class C(B):\n    '''doc'''\n    y = 2", "start_line": 2, "end_line": 4}
    js = context("/** Does it. */\nfunction f(a) {\n  return a;\n}\n", "a.js", "f")
    assert (js["signature"], js["docstring"], js["start_line"], js["end_line"]) == ("f(a)", "Does it.", 2, 4)
    assert context("def (", "a.py", "f")["snippet"] == "" and context("x", "a.css", "f")["start_line"] is None


def test_json_sources(spark, tmp_path):
    rows = [{"from_entity": "a", "from_type": "function", "relation_type": "CALLS", "to_entity": "b", "to_type": "function", "source_file": "a.py", "line_number": 3}]
    (tmp_path / "t.json").write_text(json.dumps(rows))
    found = store.load_triples(spark, f"file://{tmp_path}/t.json").collect()
    assert len(found) == 1 and found[0]["is_exported"] is False and found[0]["call_receiver"] is None
    triples = spark.createDataFrame([(0, "a", "function", "CALLS", "b", "function", "a.py", 3, "r", "R", True, "O")], TRIPLES)
    store.dump_triples(triples, f"file://{tmp_path}/dump")
    assert spark.read.schema(TRIPLES).json(f"file://{tmp_path}/dump").collect() == triples.collect()
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "n", "type": "Entity", "name": "n"}], "links": [{"source": "n", "target": "n", "type": "CALLS"}]}))
    nodes, edges = store.node_link(spark, f"file://{tmp_path}/g.json")
    assert nodes.first()["name"] == "n" and edges.first()["dst"] == "n"
    assert store.node_link(spark, f"file://{tmp_path}/none.json")[0].count() == 0
    assert store.psr4('{"autoload": {"psr-4": {"A\\\\B\\\\": ["src/", "x/"]}}, "autoload-dev": {"psr-4": {"T\\\\": "t/"}}}') == {"A.B": "src/", "T": "t/"} and store.psr4("{") == {} and store.psr4(None) == {}
    side = spark.createDataFrame([("n", "said")], "node string, description string")
    assert store.with_sidecar(nodes, side).first()["description"] == "said"
    assert store.with_sidecar(nodes.withColumn("description", F.lit("mine")), side).first()["description"] == "mine"


def test_a_sidecar_is_taken_in_once(repo, tmp_path):
    repo.ingest()
    repo.describe("second", "mine")
    side = tmp_path / "side.jsonl"
    side.write_text('{"node": "demo:a.py:first", "description": "old"}\nnot json\n{"node": "demo:a.py:second", "description": "theirs"}\n{"node": "demo:a.py:first", "description": "newer"}\n')
    assert store.adopted_sidecar(repo.store, f"file://{side}") == 1 and not side.exists()
    assert (repo.description("demo:a.py:first"), repo.description("demo:a.py:second")) == ("newer", "mine")
    assert store.adopted_sidecar(repo.store, f"file://{side}") == 0


def test_given_triples_become_a_graph(repo, spark, tmp_path):
    rows = [{"from_entity": a, "from_type": "function", "relation_type": "DEFINED_IN", "to_entity": "m", "to_type": "module", "source_file": "m.py", "line_number": 1} for a in "ab"]
    rows.append({"from_entity": "a", "from_type": "function", "relation_type": "CALLS", "to_entity": "b", "to_type": "function", "source_file": "m.py", "line_number": 2})
    (tmp_path / "t.json").write_text(json.dumps(rows))
    assert repo.ingest_triples(f"file://{tmp_path}/t.json")["triples"] == 3 and [r["caller_name"] for r in repo.impact("b").collect()] == ["a"]
    store.dump_triples(repo.store.triples(), f"file://{tmp_path}/out", store.DUMPED)
    assert [list(json.loads(r[0])) for r in spark.read.text(f"file://{tmp_path}/out").collect()] == [list(store.DUMPED)] * 3
