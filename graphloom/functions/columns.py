"""Column expressions of the code graph; all are built-in functions, so plans stay in the JVM."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.schemas import LANGUAGES

#: Names and beginnings of names that a runtime calls.
ENTRY_NAMES = ("main", "__main__", "handler", "lambda_handler", "application", "app")
ENTRY_BEGINNINGS = ("run_", "main", "handle_", "cmd_", "test_", "setup_", "teardown_")
_CODE_ENDINGS = ("js", "jsx", "ts", "tsx", "mjs", "cjs", "py", "php")


def blank(c: Column) -> Column:
    """Null and empty count as the same: an empty string."""
    return F.coalesce(c, F.lit(""))


def entity_id(project: Column, file: Column, name: Column, owner: Column) -> Column:
    """project:file:Owner.name, without the owner if there is none, and project:name without a file."""
    local = F.when(blank(owner) != "", F.concat_ws(".", owner, name)).otherwise(name)
    return F.when(blank(file) != "", F.concat_ws(":", project, file, local)).otherwise(F.concat_ws(":", project, name))


def stable_uuid(key: Column) -> Column:
    """The version 5 UUID of a key in the DNS namespace, from SHA-1 with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(uuid.NAMESPACE_DNS.hex)), key.cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def vector_id(node_id: Column) -> Column:
    """The first eight bytes of the id's SHA-1 as an unsigned number."""
    return F.conv(F.substring(F.sha1(node_id.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def without_code_ending(path: Column) -> Column:
    return F.regexp_replace(path, rf"\.({'|'.join(_CODE_ENDINGS)})$", "")


def language_of(file: Column) -> Column:
    """The language by extension; ``unknown`` for any other."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(blank(file), r"\.([^./]+)$", 1))), F.lit("unknown"))


def module_name(path: Column) -> Column:
    """The dotted path without its extension."""
    return F.translate(F.regexp_replace(path, r"\.[^./]+$", ""), "/\\", "..")


def relation_name(raw: Column) -> Column:
    """A relation that an agent gave, in upper snake case; null if it is empty or structural."""
    name = F.translate(F.upper(F.trim(raw)), " -", "__")
    return F.when(~name.isin("", "CONTAINS", "DEFINED_IN"), name)


def looks_like_entry(name: Column, entity_type: Column) -> Column:
    """Whether a runtime rather than a call site may invoke the entity."""
    low = F.lower(blank(name))
    begins = F.lit(False)
    for b in ENTRY_BEGINNINGS:
        begins = begins | low.startswith(b)
    special = name.startswith("__") & name.endswith("__") & (F.length(name) > 4)
    return F.coalesce((blank(entity_type) == "module") | special | low.isin(*ENTRY_NAMES) | begins, F.lit(False))


def receiver_matches(want: str, receiver: Column, receiver_type: Column) -> Column:
    """Whether a call's receiver fits a qualified query: by type, by self reference, else by its name."""
    return (
        F.when(receiver_type == want, True)
        .when(receiver.isin("this", "self"), True)
        .when(receiver_type.isNotNull() | receiver.isNull(), False)
        .otherwise((receiver == want) | receiver.endswith("." + want))
    )


def normalized_path(path: Column) -> Column:
    """The path without ``.``, and with each ``..`` joined with the part before it."""
    return F.array_join(
        F.aggregate(
            F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".")),
            F.array().cast("array<string>"),
            lambda done, p: F.when(
                (p == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != ".."),
                F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
            ).otherwise(F.concat(done, F.array(p))),
        ),
        "/",
    )


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def import_targets(spec: Column, from_file: Column, psr4: dict[str, str] | None = None) -> Column:
    """All paths without ending that an import may mean: relative ones, dotted modules, and
    namespaces of a PSR-4 map. Computed once per import, they turn the test of every
    import against every target into an equi-join."""
    relative = normalized_path(F.concat_ws("/", directory(from_file), spec))
    found = F.when(spec.startswith("."), F.array(relative, F.concat(relative, F.lit("/index")))).when(
        spec.contains(".") & ~spec.contains("/"), F.array(F.replace(spec, F.lit("."), F.lit("/")))
    )
    found = F.coalesce(found, F.array().cast("array<string>"))
    for prefix, folder in (psr4 or {}).items():
        rest = F.replace(F.substring(spec, len(prefix) + 2, 10_000), F.lit("."), F.lit("/"))
        base = F.concat(F.lit(folder.rstrip("/") + "/"), rest)
        found = F.concat(found, F.when(spec.startswith(prefix + "."), F.array(base)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(found)
