"""Extraction from small sources of each language."""

import pytest

from graphloom.sources.extract.registry import extract, parse, scan


def rows(text, path, **want):
    return [r for r in parse(text, path) if all(getattr(r, k) == v for k, v in want.items())]


def calls(text, path, callee):
    return [(r.from_entity, r.call_receiver, r.call_receiver_type) for r in rows(text, path, relation_type="CALLS", to_entity=callee)]


def targets(text, path, relation):
    return [r.to_entity for r in rows(text, path, relation_type=relation)]


PY = """import os, a.b as c
from x.y import z
__all__ = ['public_fn']

class Base: pass

class Dog(Base):
    def wag(self): self.bark()
    def run(self): super().invoke()

def _helper(r: Router):
    r.handle(1)
    print(len(r))

async def get_adapter(url) -> HTTPAdapter: ...

def send(self):
    adapter = self.get_adapter(url)
    adapter.send(1)
    q = Queue()
    q.put_in(2)

top.level_call()
"""


def test_python():
    assert targets(PY, "src/m.py", "IMPORTS") == ["os", "a.b", "x.y"]
    defs = {r.from_entity: r for r in rows(PY, "src/m.py", relation_type="DEFINED_IN")}
    assert defs["wag"].owner_class == "Dog" and defs["wag"].to_entity == "src.m" and defs["wag"].line_number == 8
    assert not defs["_helper"].is_exported and defs["send"].is_exported and "get_adapter" in defs
    assert targets(PY, "src/m.py", "INHERITS") == ["Base"]
    assert calls(PY, "src/m.py", "bark") == [("wag", "self", "Dog")] and calls(PY, "src/m.py", "invoke") == [("run", "super()", "Base")]
    assert calls(PY, "src/m.py", "handle") == [("_helper", "r", "Router")] and calls(PY, "src/m.py", "send") == [("send", "adapter", "HTTPAdapter")]
    assert calls(PY, "src/m.py", "put_in") == [("send", "q", "Queue")] and calls(PY, "src/m.py", "level_call") == [("src.m", "top", None)]
    assert not calls(PY, "src/m.py", "print") and not calls(PY, "src/m.py", "len")


def test_broken_sources_have_no_rows():
    assert parse("def (:", "a.py") == [] and parse("\x00", "b.py") == [] and parse("x", "c.unknown") == [] and parse("", "d.php") == []


@pytest.mark.parametrize(
    ("text", "imports"),
    [
        ("var res = require('./response');", ["./response"]), ("async function f(){ const m = await import('./lazy'); }", ["./lazy"]),
        ("var m = require('./views/' + name);", []), ('import a, {b} from "x/y";\nimport "side";', ["x/y", "side"]), ("// require('no')\nlet s = \"require('no')\";", []),
    ],
)
def test_javascript_imports(text, imports):
    assert targets(text, "a.js", "IMPORTS") == imports


def test_javascript_calls_and_types():
    assert calls("function f(){ app.handle(a, b); }", "a.js", "handle") == [("f", "app", None)]
    assert calls("function f(){ var r = new Router(); r.handle(x); }", "a.js", "handle") == [("f", "r", "Router")]
    assert calls("function f(){ new Router().handle(x) }", "a.js", "handle") == [("f", "new Router()", "Router")]
    assert calls("function f(r: Router){ r.handle(x); }", "a.ts", "handle") == [("f", "r", "Router")]
    assert calls("class Dog { bark(){ this.wag(); } }", "a.ts", "wag") == [("bark", "this", "Dog")]
    assert calls("class A extends B { go(){ super.invoke(); } }", "a.js", "invoke") == [("go", "super", "B")]
    two = "function f(){ var x = new Dog(); x.bark(); } function g(){ var x = new Cat(); x.bark(); }"
    assert calls(two, "a.js", "bark") == [("f", "x", None), ("g", "x", None)]
    assert calls("const f = (a) => { this.router.handle(a); };\nhandleAll();", "m/a.js", "handle") == [("f", "this.router", None)]
    assert calls("if (ok) { go_on(); }", "m/a.js", "go_on") == [("m.a", None, None)]
    assert calls("x = /call(me)/.test(y); `${t}`", "a.js", "call") == []


def test_javascript_definitions_and_exports():
    text = "res.send = function send(){};\nvar res = exports = module.exports = {};\nfunction helper(){}\nres.json = function json(){};\ndefineGetter(res, 'host', function host(){});\nexport function open_it(){}\nclass A { m(){} }"
    defs = {r.from_entity: (r.is_exported, r.owner_class) for r in rows(text, "a.js", relation_type="DEFINED_IN")}
    assert defs == {"send": (True, None), "helper": (False, None), "json": (True, None), "host": (True, None), "open_it": (True, None), "m": (False, "A")}


PHP = """<?php
namespace App;
use App\\Contracts\\Payable;
use App\\{Bar, Baz as Z};
require_once 'bootstrap.php';
require __DIR__ . '/no.php';
const TOP = 1;
abstract class Foo extends \\Lib\\Base implements A, B {
    use Loggable;
    public const MAX = 10, MIN = 1;
    protected static ?string $name = "x";
    public function __construct(private readonly int $id, Session $s) {}
    private function hidden(): HTTPAdapter { $this->helper_it(); parent::invoke(); return new static(); }
    public function go() { $a = $this->hidden(); $a->send(1); Model::make(); (new Session())->open_it(); $s->close_it(); foo()->bar_it(); }
}
interface Multi extends X, Y { public function pay(): void; }
trait Loggable { public function log() {} }
enum Status: string { case Active = 'a'; case Off = 'b'; }
function outer() { inner(); $fn = function($x) use ($y) { deep_call(); }; $ar = fn($x) => $x + more_call($x); \\Lib\\util_call(); # comment(
}
"""


def test_php():
    p = "src/f.php"
    assert targets(PHP, p, "IMPORTS") == ["App.Contracts.Payable", "App.Bar", "App.Baz"] and targets(PHP, p, "INCLUDES") == ["bootstrap.php"]
    assert [(r.from_entity, r.to_entity, r.to_type) for r in rows(PHP, p, relation_type="INHERITS")] == [
        ("Foo", "Base", "class"), ("Foo", "A", "interface"), ("Foo", "B", "interface"), ("Foo", "Loggable", "trait"), ("Multi", "X", "interface"), ("Multi", "Y", "interface"),
    ]
    defs = {(r.from_entity, r.from_type): (r.to_entity, r.is_exported, r.owner_class) for r in rows(PHP, p, relation_type="DEFINED_IN")}
    assert defs["MAX", "constant"][0] == "Foo" and defs["MIN", "constant"][0] == "Foo" and defs["TOP", "constant"][0] == "src.f"
    assert defs["name", "property"][0] == "Foo" and defs["id", "property"][0] == "Foo" and ("s", "property") not in defs
    assert defs["hidden", "function"] == ("src.f", False, "Foo") and defs["go", "function"] == ("src.f", True, "Foo") and defs["fn", "function"][2] is None
    assert defs["Active", "constant"][0] == "Status" and {("Multi", "interface"), ("Loggable", "trait"), ("Status", "enum"), ("Foo", "class"), ("ar", "function")} <= set(defs)
    assert calls(PHP, p, "helper_it") == [("hidden", "this", "Foo")] and calls(PHP, p, "invoke") == [("hidden", "parent", "Base")]
    assert calls(PHP, p, "send") == [("go", "a", "HTTPAdapter")] and calls(PHP, p, "make") == [("go", "Model", "Model")]
    assert calls(PHP, p, "open_it") == [("go", "new", "Session")] and calls(PHP, p, "close_it") == [("go", "s", "Session")] and calls(PHP, p, "bar_it") == [("go", "foo()", None)]
    assert calls(PHP, p, "deep_call") == [("fn", None, None)] and calls(PHP, p, "more_call") == [("ar", None, None)] and calls(PHP, p, "inner") == [("outer", None, None)]
    assert [(r.to_entity, r.to_type) for r in rows(PHP, p, relation_type="CALLS", to_type="class")] == [("Session", "class")] and calls(PHP, p, "util_call")


def test_markup():
    html = '<a-button class="x y"></a-button>\n<a-button>\n<p class="x"><form action="/go"><script src="m/app.js"></script>'
    assert [(r.relation_type, r.to_entity) for r in parse(html, "v/page.html")] == [("REFERENCES", "a-button"), ("HAS_CLASS", "x"), ("HAS_CLASS", "y"), ("HAS_CLASS", "x"), ("POSTS_TO", "/go"), ("INCLUDES", "m/app.js")]
    css = "/* a{} */\n:root { --my-var: red; }\na.b, ul li { color: var(--x); } b { color: var(--x) }"
    assert [(r.relation_type, r.from_entity, r.to_entity, r.line_number) for r in parse(css, "s/m.css")] == [
        ("STYLES", "a.b, ul li", "ul", 3), ("STYLES", "a.b, ul li", "li", 3), ("STYLES", "b", "b", 3), ("DEFINED_IN", "--my-var", "m.css", 2), ("USES_VAR", "s.m", "--x", 3),
    ]
    assert targets('@import "variables";\n@use "sass:color";\n$c: red;', "m.scss", "IMPORTS") == ["variables", "sass:color"]
    lit = "const x = css`color: ${f('var(--no)')}; background: var(--bg); --tok: 1; --tok: 2;`;"
    found = [(r.relation_type, r.from_entity, r.to_entity) for r in parse(lit, "a.styles.ts") if r.relation_type in ("USES_VAR", "DEFINED_IN")]
    assert found == [("USES_VAR", "a.styles", "--bg"), ("DEFINED_IN", "--tok", "a.styles.ts")] and targets(lit, "a.ts", "USES_VAR") == []


def test_scan_and_extract(spark, tmp_path):
    for path, text in {"src/a.py": "def f(): g_call()", "node_modules/c.py": "x", "api/vendor/b.py": "x", "b.js": "function h(){}", "bad.py": "def (", "n.txt": "no"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found = extract(scan(spark, str(tmp_path), ["vendor"])).orderBy("seq").collect()
    assert [(r["source_file"], r["from_entity"], r["relation_type"]) for r in found] == [("b.js", "h", "DEFINED_IN"), ("src/a.py", "f", "DEFINED_IN"), ("src/a.py", "f", "CALLS")]
    assert len({r["seq"] for r in found}) == 3
