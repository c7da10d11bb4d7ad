"""Publishing: races, readers that hold versions, the log of corrections, and the stored index."""

import os
import random

import numpy as np
import pytest

from graphloom.api import Repository
from graphloom.operators import vectors
from graphloom.sources import index as indexes
from graphloom.sources import store, versions

A = "def fun():\n    gun()\n\ndef gun():\n    hun()\n\ndef hun():\n    pass\n\nclass Kind:\n    def make(self):\n        fun()\n"
B = "from a import fun\nimport json\ndef use():\n    fun()\n"


@pytest.fixture
def repo(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text(A)
    (tmp_path / "src" / "b.py").write_text(B)
    made = Repository(spark, str(tmp_path / "src"), f"file://{tmp_path}/home", "demo")
    made.ingest()
    return made


def folders(repo, kind):
    return sorted(f for f in os.listdir(repo.home.removeprefix("file://")) if f.startswith(kind))


def rows(graph):
    nodes = sorted(map(str, graph.nodes.select(*sorted(graph.nodes.columns)).collect()))
    key = ["src", "dst", "type", "source_file", "line", "receiver", "agent_inferred", "agent_relation", "edge_seq"]
    both = [sorted(map(str, e.select(*key).collect())) for e in (graph.edges, graph.into)]
    assert both[0] == both[1]
    return nodes, both[0], sorted(map(tuple, graph.importers().collect()))


def test_of_two_publishers_none_loses_an_update(repo, spark):
    other = Repository(spark, repo.root, repo.home, "demo")
    put, turns = repo.store.versions.put, []

    def late(number, content):
        if not turns:  # another correction comes between the reading and the publishing of this one
            turns.append(other.describe("gun", "of g"))
        return put(number, content)

    repo.store.versions.put = late
    mine = repo.describe("fun", "of f")
    assert mine["status"] == turns[0]["status"] == "updated" and int(mine["version"]) == int(turns[0]["version"]) + 1
    assert {r["name"]: r["description"] for r in repo.grep("of ", "description").collect()} == {"fun": "of f", "gun": "of g"}
    turns.clear()
    repo.ingest()  # an ingest that meets a correction, too
    assert {r["description"] for r in repo.grep("of ", "description").collect()} == {"of f", "of g"}


def test_the_loser_is_answered_on_the_winner(repo, spark):
    """Two agents add the same edge at once: one adds it, the other is told that it exists."""
    other = Repository(spark, repo.root, repo.home, "demo")
    put, first = repo.store.versions.put, []

    def late(number, content):
        if not first:
            first.append(other.add_call("use", "hun"))
        return put(number, content)

    repo.store.versions.put = late
    assert repo.add_call("use", "hun")["status"] == "exists" and first[0]["status"] == "added"
    assert repo.store.graph().edges.filter("agent_inferred").count() == 1


def test_a_held_reader_outlives_corrections_and_compaction(repo, monkeypatch):
    monkeypatch.setattr(store, "COMPACT", 4)
    monkeypatch.setattr(versions, "KEPT", 0)
    held, before = repo.dead_code(True), None
    before = sorted(map(str, held.collect()))
    for k in range(6):
        assert repo.describe("fun", f"text {k}")["status"] == "updated"
    assert len(folders(repo, "v-")) >= 2 and sorted(map(str, held.collect())) == before
    assert repo.description("demo:a.py:fun") == "text 5"


def test_old_versions_go_when_nobody_holds_them(repo, monkeypatch, spark):
    monkeypatch.setattr(versions, "KEPT", 0)
    monkeypatch.setattr(versions, "LEASE", -1)
    for k in range(3):
        repo.describe("fun", f"text {k}")
    assert len(folders(repo, "d-")) == 3 and len(folders(repo, "v-")) == 1
    repo.ingest()
    assert folders(repo, "d-") == [] and len(folders(repo, "v-")) == 1 and repo.store.versions.numbers() == [5]
    assert repo.description("demo:a.py:fun") == "text 2"


def test_a_correction_writes_rows_of_its_own_only(repo):
    size = lambda: sum(len(fs) for _, _, fs in os.walk(repo.home.removeprefix("file://") + "/" + folders(repo, "v-")[0]))
    there, files = folders(repo, "v-"), size()
    repo.describe("fun", "said")
    repo.add_call("use", "hun")
    repo.add_entity("extra", file="a.py")
    repo.modify_relation("fun", "gun", "handles")
    repo.delete_call("use", "hun")
    assert folders(repo, "v-") == there and size() == files and len(folders(repo, "d-")) == 5
    written_rows = [sum(t["rows"] for t in c["tables"].values()) for c in repo.store.versions.newest()[1]["log"]]
    assert max(written_rows) <= 3


def test_the_log_equals_the_graph_written_anew(repo):
    """After any corrections, what readers merge is what a rewrite of everything gives, and an ingest keeps it."""
    rng = random.Random(4)
    names = ["fun", "gun", "hun", "use", "Kind", "make", "extra", "json", "a"]
    for _ in range(9):
        a, b, kind = rng.choice(names), rng.choice(names), rng.randrange(6)
        relation = rng.choice(["CALLS", "IMPORTS", "handles"])
        [
            lambda: repo.describe(a, rng.choice(["text", " "])), lambda: repo.add_call(a, b, 3, relation), lambda: repo.delete_call(a, b, relation),
            lambda: repo.modify_relation(a, b, rng.choice(["HANDLES", "IMPORTS", "CALLS"]), rng.choice(["", "CALLS"])),
            lambda: repo.add_entity(a, file=rng.choice(["a.py", "b.py"]), line=7), lambda: repo.delete_entity(a),
        ][kind]()
    merged = rows(repo.store.graph())
    assert repo.store.versions.newest()[1]["log"]
    repo.store.compact()
    assert rows(repo.store.graph()) == merged and not repo.store.versions.newest()[1]["log"]


def test_tables_of_requests(repo, spark):
    asked = spark.createDataFrame([(1, "fun", "first"), (2, "fun", "last"), (3, "gun", " "), (4, "nobody", "x")], "nth bigint, name string, text string")
    told = {(r["nth"], r["status"]) for r in repo.correct(asked, "describe").collect()}
    assert told == {(1, "updated"), (2, "updated"), (3, "cleared"), (4, "not_found")} and repo.description("demo:a.py:fun") == "last"
    new = spark.createDataFrame([(1, "x1", "a.py", "of x"), (2, "x1", "a.py", None), (3, "hun", "", "of h"), (4, "x2", "", None)], "nth bigint, name string, file string, description string")
    assert [r["status"] for r in repo.correct(new, "add_entity").orderBy("nth").collect()] == ["created", "updated", "updated", "created"]
    nodes = {r["id"]: r for r in repo.store.graph().nodes.filter("agent_created or name = 'hun'").collect()}
    assert nodes["demo:a.py:x1"]["description"] == "of x" and nodes["demo:a.py:x1"]["kind"] == "function:python" and nodes["demo:x2"]["file"] is None
    assert nodes["demo:a.py:hun"]["description"] == "of h" and nodes["demo:a.py:hun"]["agent_created"] is None
    gone = spark.createDataFrame([("x1", None), (None, "demo:x2"), ("hun", None), ("nobody", None)], "name string, id string")
    assert sorted(r["status"] for r in repo.correct(gone, "delete_entity").collect()) == ["deleted", "deleted", "not_found", "stripped"]
    assert [r["name"] for r in repo.store.graph().nodes.filter("agent_created or description is not null").collect()] == ["fun"]
    log = len(repo.store.versions.newest()[1]["log"])
    assert repo.correct(gone.filter("name = 'nobody'"), "delete_entity").count() == 1 and len(repo.store.versions.newest()[1]["log"]) == log


def test_one_number_is_put_once(spark, tmp_path):
    v = versions.Versions(spark, f"file://{tmp_path}/s")
    assert v.put(1, {"folders": [], "by": "a"}) and not v.put(1, {"folders": [], "by": "b"}) and v.newest() == (1, {"folders": [], "by": "a"})
    assert os.listdir(tmp_path / "s" / "waiting") == []


# --- the index ---------------------------------------------------------------


def test_an_index_keeps_its_embedder(repo, spark):
    own = vectors.model(lambda texts: [[float(len(t)), 1.0] for t in texts], name="lengths")
    repo.index(own)
    fresh = Repository(spark, repo.root, repo.home, "demo")
    with pytest.raises(ValueError, match="lengths"):
        fresh.search("fun")
    assert "lengths" in fresh.fetch_search("fun")["hint"] and "lengths" in fresh.ingest()["index"]
    assert fresh.indexes.facts()["dimensions"] == 2
    again = Repository(spark, repo.root, repo.home, "demo", embed=own)
    assert again.search("fun", 2).count() == 2 and again.ingest()["indexed"] > 3
    with pytest.raises(ValueError, match="dimensions"):
        again._index().search([1.0, 2.0, 3.0])


def test_quantised_search_finds_the_nearest(spark, tmp_path):
    """Recall of the ten best against brute force, and a fraction of the bytes."""
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 48))
    v = (centers[rng.integers(0, 40, 4000)] + 0.5 * rng.normal(size=(4000, 48))).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"n{i:05d}", x.tolist()) for i, x in enumerate(v)], "id string, embedding array<float>")
    made = indexes.IndexStore(spark, f"file://{tmp_path}/i")
    assert made.index() is None and made.publish(df, "given") == 4000
    found, hits = made.index(), 0
    for q in range(0, 400, 40):
        want = [f"n{i:05d}" for i in np.lexsort((np.arange(4000), -(v.astype(np.float64) @ v[q].astype(np.float64))))[:10]]
        got = [r["id"] for r in found.search(v[q].tolist(), 10).collect()]
        hits += len(set(want) & set(got))
        if q == 0:
            assert [r["id"] for r in found.search(v[q].tolist(), 10, exact=True).collect()] == want
            report = found.report(v[q].tolist())
            assert report["code_bytes"] + report["vector_bytes"] < report["exact_bytes"] / 10 and report["of_codes"] == 4000
    assert hits >= 95


def test_codes_keep_vectors_within_half_a_level():
    v = np.random.default_rng(3).normal(size=(50, 7)).astype(np.float32)
    v[3] = 0
    codes, scale = indexes.packed_codes(v)
    assert codes.shape == (50, 4) and (np.abs(indexes.unpacked_codes(codes, scale, 7) - v) <= scale[:, None] / 15 + 1e-5).all()


def test_an_empty_index_and_uneven_vectors(spark, tmp_path):
    made = indexes.IndexStore(spark, f"file://{tmp_path}/i")
    assert made.publish(spark.createDataFrame([], "id string, embedding array<float>"), "none") == 0 and made.index().search([]).collect() == []
    with pytest.raises(ValueError, match="components"):
        made.publish(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "id string, embedding array<float>"), "bad")
