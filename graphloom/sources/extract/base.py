"""What extractors share: the rows they make, and rules that hold for several languages."""

from __future__ import annotations

from dataclasses import dataclass

#: Names that say nothing as the target of a call.
NOISE = frozenset(
    "print len range str int float bool list dict set tuple super type isinstance hasattr getattr setattr open zip map filter enumerate sorted "
    "reversed min max sum any all repr format append extend update items keys values get".split()
)


@dataclass
class Relation:
    """One row, but for its file and place in the order."""

    from_entity: str
    from_type: str
    relation_type: str
    to_entity: str
    to_type: str
    line_number: int
    call_receiver: str | None = None
    call_receiver_type: str | None = None
    is_exported: bool = False
    owner_class: str | None = None


def telling(callee: str | None) -> bool:
    """Whether a call's target is worth a row."""
    return bool(callee) and len(callee) > 1 and not callee.startswith("__") and callee not in NOISE


def module_of(path: str) -> str:
    """The dotted path without its extension."""
    head, dot, tail = path.rpartition(".")
    return (head if dot and "/" not in tail and not head.endswith("/") and head else path).replace("/", ".").replace("\\", ".")


class Names:
    """Names bound to one type each; a name bound to two is dropped."""

    def __init__(self):
        self.types: dict[str, str] = {}
        self.unclear: set[str] = set()

    def bind(self, name: str | None, type_name: str | None) -> None:
        if name and type_name and self.types.setdefault(name, type_name) != type_name:
            self.unclear.add(name)

    def get(self, name: str | None) -> str | None:
        return None if name in self.unclear else self.types.get(name)
