"""Relations of a Python module, from its syntax tree."""

from __future__ import annotations

import ast

from graphloom.sources.extract.base import Names, Relation, module_of, telling

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _callee(call: ast.Call) -> tuple[str | None, ast.expr | None]:
    """The called name, and the object it is called on."""
    if isinstance(call.func, ast.Name):
        return call.func.id, None
    if isinstance(call.func, ast.Attribute):
        return call.func.attr, call.func.value
    return None, None


def _made_class(node: ast.AST | None) -> str | None:
    """The class that a call in capitals makes an instance of."""
    name = _callee(node)[0] if isinstance(node, ast.Call) else None
    return name if name and name[0].isupper() else None


def _named_type(annotation: ast.AST | None) -> str | None:
    """The first capitalized name in an annotation, in source order."""
    if annotation is None:
        return None
    names = [n for n in ast.walk(annotation) if isinstance(n, ast.Name | ast.Attribute)]
    found = sorted((n.lineno, n.end_col_offset, n.id if isinstance(n, ast.Name) else n.attr) for n in names)
    return next((name for _, _, name in found if name[:1].isupper()), None)


class _Facts(ast.NodeVisitor):
    """What has to be known of a whole module before its rows can be made."""

    def __init__(self, tree: ast.Module):
        self.names, self.returns, self.parents, self.exported = Names(), Names(), {}, set()
        for node in ast.walk(tree):
            if isinstance(node, _FUNCTIONS):
                self.returns.bind(node.name, _named_type(node.returns))
        self.visit(tree)

    def visit_ClassDef(self, node):
        self._public(node.name)
        bases = [b.id for b in node.bases if isinstance(b, ast.Name)]
        if bases:
            self.parents[node.name] = bases[0]
        self.generic_visit(node)

    def _public(self, name):
        if not name.startswith("_"):
            self.exported.add(name)

    def visit_FunctionDef(self, node):
        self._public(node.name)
        self.generic_visit(node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_arg(self, node):
        self.names.bind(node.arg, _named_type(node.annotation))

    def visit_AnnAssign(self, node):
        if isinstance(node.target, ast.Name):
            self.names.bind(node.target.id, _named_type(node.annotation))
        self.generic_visit(node)

    def visit_Assign(self, node):
        for target in node.targets:
            if isinstance(target, ast.Name):
                if target.id == "__all__":
                    self.exported |= {c.value for c in ast.walk(node.value) if isinstance(c, ast.Constant) and isinstance(c.value, str) and c.value}
                self.names.bind(target.id, _made_class(node.value))
                if isinstance(node.value, ast.Call):
                    self.names.bind(target.id, self.returns.get(_callee(node.value)[0]))
        self.generic_visit(node)


class _Rows(ast.NodeVisitor):
    def __init__(self, text: str, path: str, facts: _Facts):
        self.text, self.module, self.facts = text, module_of(path), facts
        self.scopes: list[tuple[str, bool]] = []  # (name, whether it is a class)
        self.rows: list[Relation] = []

    def _class(self) -> str | None:
        return next((name for name, is_class in reversed(self.scopes) if is_class), None)

    def _inside(self, node, name, is_class):
        self.scopes.append((name, is_class))
        self.generic_visit(node)
        self.scopes.pop()

    def visit_FunctionDef(self, node):
        self.rows.append(Relation(node.name, "function", "DEFINED_IN", self.module, "module", node.lineno, is_exported=node.name in self.facts.exported, owner_class=self._class()))
        self._inside(node, node.name, False)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        self.rows.append(Relation(node.name, "class", "DEFINED_IN", self.module, "module", node.lineno, is_exported=node.name in self.facts.exported))
        for base in node.bases:
            if isinstance(base, ast.Name):
                self.rows.append(Relation(node.name, "class", "INHERITS", base.id, "class", base.lineno))
        self._inside(node, node.name, True)

    def _imports(self, name, line):
        self.rows.append(Relation(self.module, "module", "IMPORTS", name, "module", line))

    def visit_Import(self, node):
        for alias in node.names:
            self._imports(alias.name, node.lineno)

    def visit_ImportFrom(self, node):
        if node.module and not node.level:
            self._imports(node.module, node.lineno)
        elif node.names and node.names[0].name != "*":
            self._imports(node.names[0].name, node.lineno)  # a relative import names no module but what it takes

    def visit_Call(self, node):
        name, on = _callee(node)
        if telling(name):
            receiver = ast.get_source_segment(self.text, on) if on is not None else None
            kind = _made_class(on)
            if kind is None and receiver in ("self", "cls"):
                kind = self._class()
            elif kind is None and receiver in ("super()", "super"):
                kind = self.facts.parents.get(self._class())
            elif kind is None:
                kind = self.facts.names.get(receiver)
            inside = bool(self.scopes)
            self.rows.append(
                Relation(
                    self.scopes[-1][0] if inside else self.module, "function" if inside else "module", "CALLS", name, "function", node.lineno,
                    receiver, kind, owner_class=self._class() if inside else None,
                )
            )
        self.generic_visit(node)


def extract(text: str, path: str) -> list[Relation]:
    """All relations of a module; raises SyntaxError if it can't be parsed."""
    tree = ast.parse(text)
    rows = _Rows(text, path, _Facts(tree))
    rows.visit(tree)
    return rows.rows
