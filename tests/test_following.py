"""A graph that follows its tree: changes of files against full ingests, listings, the walk, and exchange."""

import datetime as dt
import json
import os
import random

import pytest

from graphloom.api import Repository
from graphloom.schemas import EVENTS
from graphloom.sources import ignore, tree
from graphloom.sources.extract import registry
from graphloom.streaming import listings
from graphloom.streaming.watch import compacted

FILES = {
    "one.py": "import pkg.two\nfrom pkg.two import helper\n\ndef alpha():\n    helper()\n    beta()\n\ndef beta():\n    gamma()\n",
    "pkg/two.py": "class Tool:\n    def work(self):\n        self.rest()\n\n    def rest(self):\n        pass\n\ndef helper():\n    tool = Tool()\n    tool.work()\n",
    "pkg/three.py": "from pkg.two import Tool\n\ndef gamma():\n    thing = Tool()\n    thing.rest()\n    missing()\n",
    "web/page.js": "import {draw} from './lib/draw';\nfunction show() { draw(); }\n",
}


@pytest.fixture
def root(tmp_path):
    for path, text in FILES.items():
        put(tmp_path / "src", path, text)
    return tmp_path / "src"


def put(root, path, text):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text(text)


def shown(repo):
    """All that a graph tells but for times and numbers; order by the numbers, which may have gaps."""
    g = repo.store.graph()
    nodes = [r.asDict() for r in g.nodes.drop("updated_at", "last_ingested", "name_lower").collect()]
    entities = sorted((n for n in nodes if n["type"] == "Entity"), key=lambda n: n["node_seq"])
    order = [n["id"] for n in entities]
    edges = [r.asDict() for r in g.edges.collect()]
    calls = [(e["src"], e["dst"], e["type"], e["line"], e["receiver"]) for e in sorted((e for e in edges if e["source_file"] and not e["agent_inferred"]), key=lambda e: e["edge_seq"])]
    plain = sorted(str(sorted((k, v) for k, v in n.items() if k != "node_seq")) for n in nodes)
    return plain, order, calls, sorted((e["src"], e["dst"], e["type"], str(e["agent_relation"])) for e in edges), sorted(map(tuple, g.importers().collect()))


def test_changes_of_files_equal_a_full_ingest(spark, root, tmp_path):
    """Definitions that come, go and move to other files, files that come and go, agents' facts between."""
    repo = Repository(spark, str(root), f"file://{tmp_path}/home", "demo")
    whole = Repository(spark, str(root), f"file://{tmp_path}/whole", "demo")
    repo.ingest()
    whole.ingest()
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    steps = [
        {"pkg/four.py": "def missing():\n    alpha()\n\ndef beta():\n    pass\n", "web/lib/draw.js": "export function draw() { return 1; }\n"},  # a second beta: calls of it are no longer clear
        {"pkg/two.py": "import one\n\nclass Tool:\n    def work(self):\n        pass\n\ndef helper():\n    one.alpha()\n", "one.py": None},
        {"pkg/four.py": None, "web/lib/draw.js": None, "a/first.py": "def beta():\n    helper()\n", "pkg/three.py": FILES["pkg/three.py"]},
    ]
    for n, step in enumerate(steps):
        if n == 1:
            for r in (repo, whole):
                assert r.describe("gamma", "said")["status"] == "updated" and r.add_call("gamma", "helper", relation="REGISTERS")["status"] == "added"
        for path, text in step.items():
            put(root, path, text) if text is not None else os.unlink(root / path)
        told = repo.apply(paths(*[p for p, t in step.items() if t is not None]), paths(*[p for p, t in step.items() if t is None]))
        assert told["status"] == "published" and repo.store.versions.newest()[1]["log"], "a change of the log, no new base"
        got = shown(repo)
        whole.ingest()
        for mine, theirs in zip(got, shown(whole), strict=True):
            assert [x for x in mine if x not in theirs] == [x for x in theirs if x not in mine] == [] and mine == theirs
    assert open(f"{tmp_path}/home/files.txt").read().split() == ["a/first.py", "pkg/three.py", "pkg/two.py", "web/page.js"]
    repo.store.compact()
    assert shown(repo) == got


def test_the_last_files_can_be_deleted(spark, root, tmp_path):
    repo = Repository(spark, str(root), f"file://{tmp_path}/home", "demo")
    repo.ingest()
    for path in FILES:
        os.unlink(root / path)
    gone = spark.createDataFrame([(p,) for p in FILES], "path string")
    assert repo.apply(gone.limit(0), gone)["status"] == "published"
    assert repo.store.graph().nodes.filter("type in ('Entity', 'File')").count() == 0 and repo.store.graph().edges.filter("type <> 'CONTAINS'").count() == 0
    assert open(f"{tmp_path}/home/files.txt").read() == ""


def test_a_watch_of_the_tree_needs_no_events(spark, root, tmp_path):
    """Created, modified, deleted and moved files are found by listings; a restart misses and repeats nothing."""
    repo = Repository(spark, str(root), f"file://{tmp_path}/home", "demo")
    repo.ingest()
    calls, apply = [], repo.apply
    repo.apply = lambda changed, deleted: calls.append((sorted(r[0] for r in changed.collect()), sorted(r[0] for r in deleted.collect()))) or apply(changed, deleted)
    put(root, "new.py", "def brand_new():\n    alpha()\n")
    put(root, "node_modules/x.py", "def hidden():\n    pass\n")
    repo.watch().awaitTermination(120)
    assert calls == [(["new.py"], [])] and repo.store.graph().nodes.filter("name = 'brand_new'").count() == 1
    os.unlink(root / "new.py")  # while nobody watches
    put(root, "one.py", FILES["one.py"] + "\ndef late():\n    pass\n")
    again = Repository(spark, str(root), f"file://{tmp_path}/home", "demo")
    again.apply = lambda changed, deleted: calls.append((sorted(r[0] for r in changed.collect()), sorted(r[0] for r in deleted.collect()))) or apply(changed, deleted)
    again.watch().awaitTermination(120)
    assert calls[1:] == [(["one.py"], ["new.py"])]
    again.watch().awaitTermination(120)
    assert len(calls) == 2


def test_listings_are_compared():
    before = {"a.py": (1, 1.0), "b.py": (2, 2.0), "c.py": (3, 3.0), "x/d.py": (4, 4.0)}
    now = {"a.py": (1, 1.0), "b.py": (2, 9.0), "y/d.py": (4, 4.0), "e.py": (3, 3.0)}
    assert listings.compared(before, now) == [("deleted", "c.py", None), ("moved", "x/d.py", "y/d.py"), ("created", "e.py", None), ("modified", "b.py", None)]
    assert listings.compared(now, now) == []


def test_an_offset_has_the_same_events_again(spark, tmp_path):
    """A batch that was told but not done is told again as it was; what is done is forgotten."""
    root, options = tmp_path / "t", {"root": f"{tmp_path}/t", "state": f"{tmp_path}/s", "patterns": "[]", "skip": "[]"}
    put(root, "a.py", "x")
    listings.start(registry.scanned(spark, options["root"], [], ()).listed, options["state"])
    reader = listings._Reader(options)
    start = reader.initialOffset()
    put(root, "b.py", "y")
    end = reader.latestOffset()
    told = lambda r: [row for p in r.partitions(start, end) for batch in r.read(p) for row in batch.to_pylist()]
    first = told(reader)
    assert [(e["kind"], e["path"]) for e in first] == [("created", "b.py")] and told(listings._Reader(options)) == first
    assert listings._Reader(options).latestOffset() == end
    reader.commit(end)
    assert listings.Listings(options["state"]).numbers() == [end["listing"]]


def test_of_equal_times_the_last_arrival_counts(spark):
    t = dt.datetime(2024, 1, 1)
    for kinds in (("created", "deleted"), ("deleted", "created")):
        rows = [(k, t, kind, "a.py", None) for k, kind in enumerate(kinds)]
        assert compacted(spark.createDataFrame(rows, EVENTS).repartition(2)).first()["kind"] == kinds[1]


def test_the_walk_never_enters_what_is_left_out(spark, root, monkeypatch):
    put(root, "node_modules/deep/er/x.py", "x")
    put(root, "vendor/y.py", "y")
    put(root, "empty/readme.txt", "z")
    put(root, ".ccignore", "vendor/\n")
    entered, below = [], tree.below
    monkeypatch.setattr(tree, "below", lambda store, base, folder, rules: entered.append(folder) or below(store, base, folder, rules))
    rows = {r[0] for r in tree.listing(str(root), tree.Rules(["vendor"]))}
    assert "node_modules" not in " ".join(entered) and "vendor" not in entered and "empty" in entered and "pkg/two.py" in rows
    monkeypatch.undo()
    monkeypatch.setattr(tree, "ENTRIES", 2)  # many rounds
    found = tree.walk(spark, str(root)).collect()
    assert sorted(r["path"] for r in found if r["kind"] == "file") == [".ccignore", "empty/readme.txt", "one.py", "pkg/three.py", "pkg/two.py", "web/page.js"]
    assert sorted(r["path"] for r in found if r["kind"] == "folder") == ["empty", "pkg", "web"]


def test_patterns_keep_to_a_part_of_the_path(spark):
    df = spark.createDataFrame([("q/a/b",), ("a.b",), ("q/axb/z",), ("ab",)], "path string")
    left = lambda p: sorted(r[0] for r in df.filter(~ignore.ignored(df.path, [p], ())).collect())
    assert left("a?b") == ["ab", "q/a/b"] and left("a[!x]b") == ["ab", "q/a/b", "q/axb/z"] and left("a[.-x]b") == ["ab", "q/a/b"] and left("a[z-a]b") == sorted(r[0] for r in df.collect())


def test_refused_files_and_progress(spark, root, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "LONGEST", 5000)
    put(root, "broken.py", "def (:\n")
    put(root, "huge.py", "x = 1\n" * 2000)
    repo = Repository(spark, str(root), f"file://{tmp_path}/home", "demo")
    assert repo.progress()["files"] == 0
    told = repo.ingest()
    assert told["files"] == 6 and told["refused"] == 2 and repo.progress()["relations"] == told["triples"]
    assert {r["path"]: r["error"].split(":")[0] for r in repo.refused().collect()} == {"broken.py": "SyntaxError", "huge.py": "12000 bytes are too many"}


def test_places_in_the_order_of_paths(spark):
    """New files begin between their neighbours, known ones where they were; without room nothing is placed."""
    rng = random.Random(3)
    sizes = {f"f{k:03d}": rng.randrange(1, 40) for k in range(0, 100, 3)}
    table = lambda d: spark.createDataFrame([(p, n) for p, n in d.items()], "path string, n bigint")
    places = registry.begun(table(sizes), room=500, lead=1000)
    known = {r["path"]: (r["begin"], r["n"]) for r in places.collect()}
    new = {"a": 5, "f001": 7, "f002": 9, "f006": 30, "f050": 3, "z": 2, "zz": 4}
    found = registry.inserted(places, new)
    assert found["f006"] == known["f006"][0] and set(found) == set(new)
    all_places = sorted((p, b, n) for p, (b, n) in ({p: v for p, v in known.items()} | {p: (found[p], new[p]) for p in new}).items())
    assert all(b + n <= c for (_, b, n), (_, c, _) in zip(all_places, all_places[1:]))
    assert registry.inserted(places, {"f006": 10_000}) is None and registry.inserted(places, {"f001": 400, "f002": 400}) is None
    assert registry.inserted(places.limit(0), {"b": 1, "c": 2})


def test_exchange_through_the_repository(spark, root, tmp_path):
    repo = Repository(spark, str(root), f"file://{tmp_path}/home", "demo")
    dumped = repo.dump(f"file://{tmp_path}/dump")
    assert dumped["status"] == "dumped" and repo.store.version() is None and spark.read.json(f"file://{tmp_path}/dump").count() == dumped["triples"]
    repo.ingest()
    os.unlink(tmp_path / "home" / "files.txt")
    (tmp_path / "home" / "descriptions.jsonl").write_text(json.dumps({"node": "demo:one.py:alpha", "description": "old words"}) + "\n")
    ready = repo.init()  # an older graph, without its list of files and with a side table
    assert ready["status"] == "ready" and ready["adopted"] == 1 and repo.description("demo:one.py:alpha") == "old words"
    assert (tmp_path / "home" / "files.txt").read_text().split() == sorted(FILES) and not (tmp_path / "home" / "descriptions.jsonl").exists()
    assert repo.load_graph(f"file://{tmp_path}/nothing.json")["status"] == "abandoned"
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "n", "type": "Entity", "name": "nnn", "project": "demo"}, {"id": "f", "type": "File", "path": "q.py"}], "links": [{"source": "n", "target": "n", "type": "CALLS"}]}))
    assert repo.load_graph(f"file://{tmp_path}/g.json")["nodes"] == 2 and (tmp_path / "home" / "files.txt").read_text() == "q.py\n"


def test_answers_are_bounded(spark, root, tmp_path):
    repo = Repository(spark, str(root), f"file://{tmp_path}/home", "demo")
    repo.ingest()
    assert len(repo.fetch_tree(limit=2)["tree"]) == 2 and repo.fetch_tree(limit=2)["truncated"] and "truncated" not in repo.fetch_tree()
    assert len(repo.fetch_impact("helper", limit=1)["callers"]) == 1
