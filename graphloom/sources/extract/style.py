"""Relations of markup and style sheets, with line numbers."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from graphloom.sources.extract.base import Relation, module_of

_COMMENT = re.compile(r"/\*.*?\*/", re.DOTALL)
_RULE = re.compile(r"([^{}@;]+)\{")
_PROPERTY = re.compile(r"(?<![\w-])(--[\w-]+|\$[\w-]+)\s*:")
_VAR = re.compile(r"var\(\s*(--[\w-]+)")
_IMPORT = re.compile(r"@(?:import|use|forward)\s+(?:url\()?\s*[\"']([^\"']+)[\"']")
_TEMPLATE = re.compile(r"css`((?:\\.|[^`\\])*)`", re.DOTALL)


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


class _Html(HTMLParser):
    def __init__(self, path: str):
        super().__init__(convert_charrefs=True)
        self.stem, self.rows, self.seen = _stem(path), [], set()

    def handle_starttag(self, tag, attrs):
        line = self.getpos()[0]
        if "-" in tag and tag not in self.seen:
            self.seen.add(tag)
            self.rows.append(Relation(self.stem, "file", "REFERENCES", tag, "html_element", line))
        for name, value in attrs:
            if name == "class":
                self.rows += [Relation(self.stem, "file", "HAS_CLASS", c, "css_class", line) for c in (value or "").split()]
            elif name == "action" and value:
                self.rows.append(Relation(self.stem, "file", "POSTS_TO", value, "endpoint", line))
            elif name == "src" and value and value.endswith((".js", ".ts")):
                self.rows.append(Relation(self.stem, "file", "INCLUDES", value, "module", line))

    handle_startendtag = handle_starttag


def extract_html(text: str, path: str) -> list[Relation]:
    parser = _Html(path)
    parser.feed(text)
    return parser.rows


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _first(text: str, pattern: re.Pattern, made) -> list[Relation]:
    """A row for the first place of each name that a pattern finds."""
    found: dict[str, int] = {}
    for m in pattern.finditer(text):
        found.setdefault(m[1], _line(text, m.start()))
    return [made(name, line) for name, line in found.items()]


def extract_css(text: str, path: str) -> list[Relation]:
    """Rules over elements, variables defined and used, and imports."""
    code = _COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    module, file = module_of(path), path.rsplit("/", 1)[-1]
    rows = []
    for m in _RULE.finditer(code):
        selector = m[1].strip()
        elements = [w for w in re.split(r"[\s,>+~]+", selector) if w.isalpha()]
        rows += [Relation(selector, "css_selector", "STYLES", e, "html_element", _line(code, m.start() + len(m[1]) - len(m[1].lstrip()))) for e in elements]
    for m in _PROPERTY.finditer(code):
        if m[1][0] == "-" or path.endswith(".scss"):
            rows.append(Relation(m[1], "scss_variable", "DEFINED_IN", file, "file", _line(code, m.start())))
    rows += _first(code, _VAR, lambda name, line: Relation(module, "module", "USES_VAR", name, "scss_variable", line))
    rows += [Relation(module, "module", "IMPORTS", m[1], "module", _line(code, m.start())) for m in _IMPORT.finditer(code)]
    return rows


def _without_holes(body: str) -> str:
    """The template with what stands in ``${...}`` blanked, however deep its braces go."""
    out, depth = [], 0
    for k, c in enumerate(body):
        if not depth and c == "$" and body[k + 1 : k + 2] == "{":
            depth = -1  # the brace that follows opens the hole
        elif depth == -1:
            depth = 1
        elif depth:
            depth += (c == "{") - (c == "}")
        else:
            out.append(c)
            continue
        out.append(" ")
    return "".join(out)


def extract_lit(text: str, path: str) -> list[Relation]:
    """Variables that css templates use and define, each once a file, without what is interpolated."""
    module, file = module_of(path), path.rsplit("/", 1)[-1]
    kept = [" "] * len(text)
    for m in _TEMPLATE.finditer(text):
        kept[m.start(1) : m.end(1)] = _without_holes(m[1])
    code = "".join("\n" if c == "\n" else k for c, k in zip(text, kept, strict=True))
    uses = _first(code, _VAR, lambda name, line: Relation(module, "module", "USES_VAR", name, "scss_variable", line))
    return uses + _first(code, re.compile(r"(--[\w-]+)\s*:"), lambda name, line: Relation(name, "scss_variable", "DEFINED_IN", file, "file", line))
