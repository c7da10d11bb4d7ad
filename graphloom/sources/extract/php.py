"""Relations of a PHP file, from its tokens; containers and functions are ranges of them."""

from __future__ import annotations

from graphloom.sources.extract.base import Names, Relation, module_of, telling
from graphloom.sources.extract.tokens import partners, tokens, unquoted

_CONTAINERS = {"class": "class", "interface": "interface", "trait": "trait", "enum": "enum"}
_SELVES = frozenset(("self", "static", "parent"))
_NOT_CALLED = frozenset(
    "if elseif for foreach while switch match catch function fn return array list isset unset empty echo print and or xor new use declare exit die "
    "include include_once require require_once clone throw yield static".split()
)
_MODIFIERS = frozenset("public private protected static readonly var final abstract".split())


class _File:
    def __init__(self, text: str, path: str):
        opened = text.find("<?")
        blank = "" if opened < 0 else "".join(c if c == "\n" else " " for c in text[:opened])
        code = blank + text[opened:].replace("<?php", "     ", 1) if opened >= 0 else ""
        self.text, self.t, self.module = code, tokens(code, hash_comments=True, regexes=False), module_of(path)
        self.pair = partners(self.t)
        self.containers: list[tuple[int, int, str, str]] = []  # (begin, end, name, kind)
        self.functions: list[tuple[int, int, str]] = []
        self.parents: dict[str, str] = {}
        self.names, self.returns = Names(), Names()
        self.out: list[tuple[int, Relation]] = []

    def at(self, k: int) -> str:
        return self.t[k].text if 0 <= k < len(self.t) else ""

    def named(self, k: int) -> bool:
        return 0 <= k < len(self.t) and self.t[k].kind == "name" and self.at(k)[0] != "$"

    def variable(self, k: int) -> bool:
        return 0 <= k < len(self.t) and self.t[k].kind == "name" and self.at(k)[0] == "$" and len(self.at(k)) > 1

    def qualified(self, k: int) -> tuple[str, int]:
        """A name with its namespace, dotted, and the token behind it."""
        parts = []
        while self.named(k) or self.at(k) == "\\":
            if self.named(k):
                parts.append(self.at(k))
                if self.at(k + 1) != "\\":
                    return ".".join(parts), k + 1
            k += 1
        return ".".join(parts), k

    def put(self, k: int, *values, line: int | None = None, **more) -> None:
        head = values[:5]
        self.out.append((k, Relation(*head, self.t[k].line if line is None else line, *values[5:], **more)))

    def home(self, k: int) -> tuple[str, str] | None:
        return max(((a, (n, kind)) for a, b, n, kind in self.containers if a < k <= b), default=(0, None))[1]

    def scope(self, k: int) -> str | None:
        return max(((a, n) for a, b, n in self.functions if a < k <= b), default=(0, None))[1]

    def behind(self, k: int, stops: tuple[str, ...]) -> int:
        while k < len(self.t) and self.at(k) not in stops:
            k = self.pair.get(k, k) + 1 if self.at(k) in ("(", "[") else k + 1
        return k

    # --- first pass: containers, functions, types ---

    def ranges(self) -> None:
        for k in range(len(self.t)):
            word, before = self.at(k), self.at(k - 1)
            if self.t[k].kind != "name" or before in ("->", "?->", "::"):
                continue
            if word in _CONTAINERS and self.named(k + 1) and before != "new" and (word != "enum" or self.at(k + 2) in ("{", ":", "implements")):
                begin = self.behind(k + 1, ("{",))
                self.containers.append((begin, self.pair.get(begin, len(self.t)), self.at(k + 1), _CONTAINERS[word]))
                if word == "class" and self.at(k + 2) == "extends":
                    self.parents[self.at(k + 1)] = self.qualified(k + 3)[0].rpartition(".")[2]
            elif word in ("function", "fn"):
                name_at = k + 1 + (self.at(k + 1) == "&")
                params = name_at + 1 if self.named(name_at) else name_at
                if self.at(params) != "(":
                    continue
                after = self.pair.get(params, len(self.t)) + 1
                if self.at(after) == "use":
                    after = self.pair.get(after + 1, len(self.t)) + 1
                result = None
                if self.at(after) == ":":
                    result = next((n for n in self._types_in(after + 1, ("{", ";", "=>"))), None)
                body = self.behind(after, ("{", ";", "=>"))
                end = self.pair.get(body, len(self.t)) if self.at(body) == "{" else self.behind(body + 1, (";", ",", ")")) if self.at(body) == "=>" else body
                if self.named(name_at):
                    self.functions.append((name_at, end, self.at(name_at)))
                    self.returns.bind(self.at(name_at), result)
                else:
                    eq = k - 1 - (before == "static")
                    if self.at(eq) == "=" and self.variable(eq - 1):
                        self.functions.append((k, end, self.at(eq - 1)[1:]))

    def _types_in(self, k: int, stops: tuple[str, ...]):
        while k < len(self.t) and self.at(k) not in stops:
            if self.named(k) or self.at(k) == "\\":
                name, nxt = self.qualified(k)
                base = name.rpartition(".")[2]
                if base[:1].isupper():
                    yield base
                k = max(nxt, k + 1)
            else:
                k += 1

    def types(self) -> None:
        for k in range(len(self.t)):
            if not self.variable(k):
                continue
            if self.named(k - 1) and self.at(k - 1)[:1].isupper() and self.at(k + 1) in (",", ")", "=", ";"):
                self.names.bind(self.at(k)[1:], self.at(k - 1))
            if self.at(k + 1) == "=" and self.at(k - 1) not in ("->", "::"):
                if self.at(k + 2) == "new":
                    self.names.bind(self.at(k)[1:], self._made(k + 2))
                else:
                    j = k + 2
                    while (self.t[j].kind == "name" if j < len(self.t) else False) and self.at(j + 1) in ("->", "?->", "::"):
                        j += 2
                    if self.named(j) and self.at(j + 1) == "(":
                        self.names.bind(self.at(k)[1:], self.returns.get(self.at(j)))

    def _made(self, k: int) -> str | None:
        """The class after ``new`` at token k."""
        base = self.qualified(k + 1)[0].rpartition(".")[2]
        return base if base and base.lower() not in _SELVES and base != "class" else None

    # --- second pass: rows ---

    def rows(self) -> list[Relation]:
        self.ranges()
        self.types()
        for k in range(len(self.t)):
            if self.t[k].kind != "name":
                continue
            word, before = self.at(k), self.at(k - 1)
            if before in ("->", "?->"):
                if self.at(k + 1) == "(":
                    self._member_call(k)
            elif before == "::":
                if self.at(k + 1) == "(" and self.named(k):
                    self._static_call(k)
            elif word in _CONTAINERS and any(n == self.at(k + 1) and a > k and a - k < 60 for a, _, n, kind in self.containers if kind == _CONTAINERS[word]) and before != "new":
                self._container(k, _CONTAINERS[word])
            elif word in ("function", "fn"):
                self._function(k)
            elif word == "use":
                self._use(k)
            elif word == "const" and before != "use":
                self._constants(k)
            elif word == "case" and self.home(k) and self.home(k)[1] == "enum" and self.scope(k) is None and self.named(k + 1):
                self.put(k, self.at(k + 1), "constant", "DEFINED_IN", *self.home(k))
            elif word in ("require", "require_once", "include", "include_once"):
                arg = k + 1 + (self.at(k + 1) == "(")
                if arg < len(self.t) and self.t[arg].kind == "string" and self.at(arg + 1) in (";", ")"):
                    self.put(arg, self.module, "module", "INCLUDES", unquoted(self.at(arg)), "module")
            elif word == "new":
                made = self._made(k)
                if made:
                    self._call(k, made, "class")
            elif self.variable(k):
                self._property(k)
            elif self.at(k + 1) == "(" and word.lower() not in _NOT_CALLED and before not in ("function", "fn", "&", "new") and not self._after_new(k):
                self._call(k, word, "function")
        return [r for _, r in sorted(self.out, key=lambda x: x[0])]

    def _after_new(self, k: int) -> bool:
        while self.at(k - 1) == "\\":
            k -= 2 if self.named(k - 2) else 1
        return self.at(k - 1) == "new"

    def _call(self, k: int, callee: str, kind: str, receiver: str | None = None, receiver_type: str | None = None) -> None:
        if telling(callee):
            scope, home = self.scope(k), self.home(k)
            owner = home[0] if scope and home else None
            self.put(k, scope or self.module, "function" if scope else "module", "CALLS", callee, kind, receiver, receiver_type, owner_class=owner)

    def _member_call(self, k: int) -> None:
        on, first = k - 2, k - 2
        if self.at(on) == ")" and on in self.pair and self.at(self.pair[on] + 1) == "new" and not self.named(self.pair[on] - 1):
            return self._call(k, self.at(k), "function", "new", self._made(self.pair[on] + 1))
        if self.variable(on) and self.at(on - 1) not in ("->", "?->", "::"):
            name = self.at(on)[1:]
            kind = (self.home(k) or (None,))[0] if name == "this" else self.names.get(name)
            return self._call(k, self.at(k), "function", name, kind)
        while first > 0:
            if self.at(first) in (")", "]") and first in self.pair:
                first = self.pair[first] - (1 if self.t[self.pair[first] - 1].kind == "name" else 0)
            if self.at(first - 1) in ("->", "?->", "::"):
                first -= 2
            else:
                break
        self._call(k, self.at(k), "function", self.text[self.t[first].start : self.t[on].end], None)

    def _static_call(self, k: int) -> None:
        first = k - 2
        while self.at(first - 1) == "\\":
            first -= 2 if self.named(first - 2) else 1
        said = self.text[self.t[first].start : self.t[k - 2].end]
        home = self.home(k)
        own = home[0] if home else None
        kind = self.parents.get(own) if said == "parent" else own if said in ("self", "static") else said.rpartition("\\")[2]
        self._call(k, self.at(k), "function", said, kind)

    def _container(self, k: int, kind: str) -> None:
        name = self.at(k + 1)
        self.put(k, name, kind, "DEFINED_IN", self.module, "module", is_exported=True)
        j = k + 2
        to_kind = None
        while j < len(self.t) and self.at(j) != "{":
            if self.at(j) in ("extends", "implements"):
                to_kind = "class" if self.at(j) == "extends" and kind == "class" else "interface"
                j += 1
            elif to_kind and (self.named(j) or self.at(j) == "\\"):
                target, nxt = self.qualified(j)
                base = target.rpartition(".")[2]
                if base.lower() not in _SELVES:
                    self.put(nxt - 1, name, kind, "INHERITS", base, to_kind)
                j = nxt
            else:
                j += 1

    def _function(self, k: int) -> None:
        name_at = k + 1 + (self.at(k + 1) == "&")
        if self.named(name_at):
            home = self.home(k)
            words, j = set(), k - 1
            while self.at(j) in _MODIFIERS:
                words.add(self.at(j))
                j -= 1
            self.put(k, self.at(name_at), "function", "DEFINED_IN", self.module, "module", line=self.t[j + 1].line, is_exported=not words & {"private", "protected"}, owner_class=home[0] if home else None)
        else:
            eq = k - 1 - (self.at(k - 1) == "static")
            if self.at(eq) == "=" and self.variable(eq - 1):
                self.put(k, self.at(eq - 1)[1:], "function", "DEFINED_IN", self.module, "module", is_exported=True)

    def _use(self, k: int) -> None:
        home = self.home(k)
        if self.at(k - 1) == ")":  # what a closure takes along
            return
        j = k + 1 + (self.at(k + 1) in ("function", "const"))
        prefix = ""
        while j < len(self.t) and self.at(j) not in (";", "}"):
            if self.at(j) == "{":
                if home:
                    return
                j += 1
            elif self.at(j) == "as":
                j += 2
            elif self.named(j) or self.at(j) == "\\":
                name, nxt = self.qualified(j)
                if self.at(nxt) == "{":
                    prefix = name + "."
                    j = nxt
                    continue
                if home:
                    self.put(nxt - 1, home[0], home[1], "INHERITS", name.rpartition(".")[2], "trait")
                else:
                    self.put(nxt - 1, self.module, "module", "IMPORTS", prefix + name, "module")
                j = nxt
            else:
                j += 1

    def _constants(self, k: int) -> None:
        home = self.home(k) or (self.module, "module")
        j, end = k + 1, self.behind(k + 1, (";",))
        while j < end:
            if self.named(j) and self.at(j + 1) == "=":
                self.put(j, self.at(j), "constant", "DEFINED_IN", *home)
                j = self.behind(j + 1, (",", ";"))
            j += 1

    def _property(self, k: int) -> None:
        home = self.home(k)
        if not home or self.at(k + 1) not in ("=", ";", ",", ")"):
            return
        j = k - 1
        while self.named(j) and self.at(j) not in _MODIFIERS or self.at(j) in ("?", "|", "&", "\\"):
            j -= 1
        if self.at(j) not in _MODIFIERS:
            return
        inside = self.scope(k)
        promoted = inside == "__construct" and any(a < k < self.pair.get(a + 1, a) for a, _, n in self.functions if n == inside)
        if inside is None or promoted:
            self.put(k, self.at(k)[1:], "property", "DEFINED_IN", *home)


def extract(text: str, path: str) -> list[Relation]:
    """All relations of a file."""
    return _File(text, path).rows()
