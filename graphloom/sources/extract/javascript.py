"""Relations of a JavaScript or TypeScript module, from its tokens.

Scopes are ranges of tokens: a function's is from its name to the end of its body.
"""

from __future__ import annotations

from graphloom.sources.extract.base import Names, Relation, module_of, telling
from graphloom.sources.extract.tokens import Token, partners, tokens, unquoted

_NOT_CALLED = frozenset("if for while switch catch function return typeof await async new super import require with do else in of instanceof void delete yield throw case".split())
_MODIFIERS = frozenset("async static get set public private protected readonly override abstract".split())


class _Module:
    def __init__(self, text: str, path: str):
        self.text, self.t, self.module = text, tokens(text), module_of(path)
        self.pair = partners(self.t)
        self.classes: list[tuple[int, int, str, str | None]] = []  # (begin, end, name, parent)
        self.functions: list[tuple[int, int, str]] = []
        self.defined: list[tuple[int, str, bool]] = []  # (token, name, whether a method)
        self.names, self.returns = Names(), Names()
        self._scopes()
        self._types()
        self.exported = self._exports()

    def at(self, k: int) -> str:
        return self.t[k].text if 0 <= k < len(self.t) else ""

    def is_name(self, k: int) -> bool:
        return 0 <= k < len(self.t) and self.t[k].kind == "name"

    def _body(self, k: int) -> int:
        """The end of the body that begins at or soon after token k: a block, or an expression."""
        if self.at(k) == "{":
            return self.pair.get(k, len(self.t))
        while k < len(self.t) and self.at(k) not in (";", ",", ")", "]", "}"):
            k = self.pair.get(k, k) + 1 if self.at(k) in ("(", "[", "{") else k + 1
        return k

    def _after_params(self, k: int) -> int:
        """The token behind a parameter list at k and an annotation of the result."""
        k = self.pair.get(k, len(self.t)) + 1
        if self.at(k) == ":":
            self_type = k + 1
            k += 1
            while k < len(self.t) and self.at(k) not in ("{", "=>", ";"):
                k += 1
            self.result = self.at(self_type) if self.is_name(self_type) else None
        return k

    def _function_value(self, k: int) -> int | None:
        """The end of a function expression or arrow at token k."""
        if self.at(k) == "async":
            k += 1
        if self.at(k) == "function":
            while k < len(self.t) and self.at(k) != "(":
                k += 1
            return self._body(self._after_params(k))
        arrow = self._after_params(k) if self.at(k) == "(" else k + 1 if self.is_name(k) else None
        return self._body(arrow + 1) if arrow is not None and self.at(arrow) == "=>" else None

    def _scopes(self) -> None:
        for k in range(len(self.t)):
            word, self.result = self.at(k), None
            if self.t[k].kind != "name" or self.at(k - 1) in (".", "?."):
                continue
            if word == "class" and (self.is_name(k + 1) or self.at(k + 1) == "{"):
                name = self.at(k + 1) if self.is_name(k + 1) and self.at(k + 1) != "extends" else None
                begin = k
                while begin < len(self.t) and self.at(begin) != "{":
                    begin += 1
                parent = next((self.at(j + 1) for j in range(k, begin) if self.at(j) == "extends" and self.is_name(j + 1)), None)
                self.classes.append((begin, self.pair.get(begin, len(self.t)), name, parent))
            elif word == "function":
                name_at = k + 2 if self.at(k + 1) == "*" else k + 1
                if self.is_name(name_at):
                    self._add(name_at, self.at(name_at), self._body(self._after_params(name_at + 1)), False)
            elif word in ("const", "let", "var"):
                eq = k + 2  # past a type, however long it is
                while eq < len(self.t) and self.at(eq) not in ("=", ";", "in", "of"):
                    eq = (self.pair.get(eq, eq) if self.at(eq) in ("(", "[", "{") else eq) + 1
                if self.is_name(k + 1) and self.at(eq) == "=":
                    end = self._function_value(eq + 1)
                    if end is not None:
                        self._add(k + 1, self.at(k + 1), end, False)
            elif self.at(k + 1) == "(" and word not in _NOT_CALLED:
                home = next((c for c in reversed(self.classes) if c[0] < k < c[1]), None)
                if home and self._depth_in(home, k) and (self.at(k - 1) in ("{", "}", ";", "*") or self.at(k - 1) in _MODIFIERS):
                    body = self._after_params(k + 1)
                    if self.at(body) == "{":
                        self._add(k, word, self.pair.get(body, len(self.t)), True)

    def _add(self, at: int, name: str, end: int, method: bool) -> None:
        self.defined.append((at, name, method))
        self.functions.append((at, end, name))
        self.returns.bind(name, self.result if self.result and self.result[:1].isupper() else None)

    def _depth_in(self, home, k: int) -> bool:
        """Whether token k stands directly in a class body."""
        j = home[0] + 1
        while j < k:
            j = self.pair.get(j, j) + 1 if self.at(j) in ("(", "[", "{") else j + 1
        return j == k

    def _types(self) -> None:
        for k in range(len(self.t)):
            if self.is_name(k) and self.at(k - 1) not in (".", "?."):
                if self.at(k + 1) == "=" and self.at(k + 2) == "new" and self.is_name(k + 3):
                    self.names.bind(self.at(k), self.at(k + 3))
                elif self.at(k + 1) == ":" and self.is_name(k + 2) and self.at(k + 2)[:1].isupper() and self.at(k - 1) in ("(", ",", "const", "let", "var"):
                    self.names.bind(self.at(k), self.at(k + 2))
                elif self.at(k + 1) == "=":
                    j = k + 2 + (self.at(k + 2) == "await")
                    while self.is_name(j) and self.at(j + 1) in (".", "?."):
                        j += 2
                    if self.is_name(j) and self.at(j + 1) == "(":
                        self.names.bind(self.at(k), self.returns.get(self.at(j)))

    def _exports(self) -> set[str]:
        out, objects = set(), {"exports"}
        for k in range(len(self.t)):
            if self.at(k) == "export" and self.t[k].kind == "name":
                j = k + 1
                while self.at(j) in ("default", "async", "function", "class", "const", "let", "var", "abstract", "*"):
                    j += 1
                if self.at(j) == "{":
                    out |= {self.at(x) for x in range(j, self.pair.get(j, j)) if self.is_name(x)}
                elif self.is_name(j):
                    out.add(self.at(j))
            exports = k if self.at(k) == "exports" and self.t[k].kind == "name" else None
            if exports is not None and self.at(k + 1) == "=" and self.is_name(k + 2) and self.at(k + 3) not in (".", "(", "="):
                out.add(self.at(k + 2))
                objects.add(self.at(k + 2))
            if exports is not None and self.at(k + 1) == "=":
                begin = k - 2 if self.at(k - 1) == "." else k
                while self.at(begin - 1) == "=" and self.is_name(begin - 2):
                    begin -= 2
                    if self.at(begin) != "exports":
                        objects.add(self.at(begin))
        for k in range(len(self.t)):
            owner = self.at(k) in objects and self.is_name(k) and (self.at(k - 1) != "." or self.at(k) == "exports")
            if owner and self.at(k + 1) == "." and self.is_name(k + 2) and self.at(k + 3) == "=":
                out.add(self.at(k + 2))
                if self.is_name(k + 4) and self.at(k + 5) not in ("(", "."):
                    out.add(self.at(k + 4))
            if self.is_name(k) and "define" in self.at(k).lower() and self.at(k + 1) == "(" and self.at(k + 2) in objects and self.at(k + 3) == ",":
                out |= {unquoted(self.at(k + 4))} if self.t[k + 4].kind == "string" else set()
        return out

    def scope(self, k: int) -> str | None:
        return max(((a, n) for a, b, n in self.functions if a < k <= b), default=(0, None))[1]

    def home(self, k: int) -> tuple[str | None, str | None]:
        """The class around a token, and its parent."""
        return max(((a, n, p) for a, b, n, p in self.classes if a < k <= b), default=(0, None, None))[1:]

    def receiver(self, dot: int) -> tuple[str, int]:
        """The text of the object before a dot, and its first token."""
        k = dot - 1
        while k > 0:
            if self.at(k) in (")", "]") and k in self.pair:
                k = self.pair[k] - 1
                if not (self.is_name(k) or self.at(k) in (")", "]")):
                    k += 1
                    break
                continue
            if self.at(k - 1) in (".", "?."):
                k -= 2
                continue
            if self.at(k - 1) == "new":
                k -= 1
            break
        return self.text[self.t[k].start : self.t[dot - 1].end], k

    def rows(self) -> list[Relation]:
        out = []
        methods = dict((at, (name, method)) for at, name, method in self.defined)
        for k, t in enumerate(self.t):
            if k in methods:
                name, method = methods[k]
                out.append((k, Relation(name, "function", "DEFINED_IN", self.module, "module", t.line, is_exported=name in self.exported, owner_class=self.home(k)[0] if method else None)))
                continue
            if t.kind != "name":
                continue
            if t.text == "import" and self.at(k + 1) != "(" and self.at(k - 1) not in (".",):
                j = k + 1
                while j < len(self.t) and self.t[j].kind != "string" and self.at(j) != ";":
                    j += 1
                if j < len(self.t) and self.t[j].kind == "string":
                    out.append((k, Relation(self.module, "module", "IMPORTS", unquoted(self.at(j)), "module", self.t[j].line)))
            elif t.text in ("require", "import") and self.at(k + 1) == "(" and self.at(k - 1) not in (".", "?."):
                if k + 3 < len(self.t) and self.t[k + 2].kind == "string" and self.at(k + 3) == ")":
                    out.append((k, Relation(self.module, "module", "IMPORTS", unquoted(self.at(k + 2)), "module", t.line)))
                elif t.text == "require":
                    self._call(out, k, t)
            elif self.at(k + 1) == "(" and (t.text not in _NOT_CALLED or self.at(k - 1) in (".", "?.")) and self.at(k - 1) not in ("new", "function", "*"):
                self._call(out, k, t)
        return [r for _, r in sorted(out, key=lambda x: x[0])]

    def _call(self, out: list, k: int, t: Token) -> None:
        if not telling(t.text):
            return
        text, kind = None, None
        if self.at(k - 1) in (".", "?."):
            text, first = self.receiver(k - 1)
            home, parent = self.home(k)
            if self.at(first) == "new" and self.at(k - 2) == ")":
                kind = self.at(first + 1)
            elif text == "this":
                kind = home
            elif text == "super":
                kind = parent
            else:
                kind = self.names.get(text)
            if self.at(first - 1) == "new" and self.at(first) != "new":
                return  # new a.b() makes an object
        scope = self.scope(k)
        out.append((k, Relation(scope or self.module, "function" if scope else "module", "CALLS", t.text, "function", t.line, text, kind, owner_class=self.home(k)[0] if scope else None)))


def extract(text: str, path: str) -> list[Relation]:
    """All relations of a module."""
    return _Module(text, path).rows()
