"""A source tree in any store that Arrow opens, listed and read in the executors.

A walk starts at the root, and goes on from folders that aren't listed yet. Every task
lists the folders that it is given and what is below, up to ``ENTRIES`` entries, and hands
the folders that it didn't come to back; the next round deals these out again. A folder
that is left out is never listed, and nothing is listed in the driver. Folders are rows too.
Contents are read where they are parsed. A file that can't be read, or is longer than
``LONGEST``, is a row with an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schemas import LANGUAGES
from graphloom.scratch import written
from graphloom.sources.ignore import IGNORE_FILE, SKIPPED, patterns_of, regex_of

#: Entries that a task lists at most in a round, folders that a task is given, and bytes of a batch of contents.
ENTRIES, FOLDERS, BATCH_BYTES = 20_000, 64, 8 << 20
#: Bytes of a file beyond which it isn't read.
LONGEST = 64 << 20
_ENTRY = "path string, kind string, size bigint, time double"
_CONTENT = "path string, content binary, error string"


def opened(root: str) -> tuple[stores.FileSystem, str]:
    """The store of a folder, and the folder's path there; ValueError if Arrow has no such store."""
    uri = re.sub(r"^s3[an]:", "s3:", root)
    store, path = stores.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    return store, path.rstrip("/")


def can_open(root: str) -> bool:
    """Whether Arrow has the root's store."""
    try:
        opened(root)
        return True
    except (pa.ArrowException, OSError, ValueError):
        return False


def own_patterns(root: str) -> list[str]:
    """The patterns of a tree's own list; none if there is no list."""
    store, base = opened(root)
    if store.get_file_info(f"{base}/{IGNORE_FILE}").type != stores.FileType.File:
        return []
    with store.open_input_stream(f"{base}/{IGNORE_FILE}") as f:
        return patterns_of(f.read().decode("utf-8", "replace"))


class Rules:
    """Which paths are left out."""

    def __init__(self, patterns: list[str], skip=SKIPPED):
        self.skip, self.patterns = frozenset(skip or ()), [re.compile(regex_of(p)) for p in patterns]

    def out(self, path: str, name: str) -> bool:
        return name in self.skip or any(r.match(path) for r in self.patterns)


def below(store: stores.FileSystem, base: str, folder: str, rules: Rules) -> tuple[list[tuple], list[str]]:
    """(rows of what is in a folder, folders that are entered next)."""
    rows, next_folders = [], []
    prefix = f"{folder}/" if folder else ""
    found = store.get_file_info(stores.FileSelector(f"{base}/{folder}".rstrip("/") or "/", allow_not_found=True))
    for info in sorted(found, key=lambda i: i.base_name):
        path = prefix + info.base_name
        if rules.out(path, info.base_name):
            continue
        if info.type == stores.FileType.Directory:
            rows.append((path, "folder", None, None))
            next_folders.append(path)
        elif info.type == stores.FileType.File:
            rows.append((path, "file", info.size, (info.mtime_ns or 0) / 1e9))
    return rows, next_folders


def listing(root: str, rules: Rules) -> Iterator[tuple]:
    """All rows of a tree, listed here."""
    store, base = opened(root)
    waiting = [""]
    while waiting:
        rows, more = below(store, base, waiting.pop(), rules)
        yield from rows
        waiting += more


def walk(spark: SparkSession, root: str, patterns: list[str] | None = None, skip=SKIPPED) -> DataFrame:
    """(path, kind, size, time) of the folders and files below a root that aren't left out."""
    known = own_patterns(root) if patterns is None else patterns

    def listed(batches):
        store, base = opened(root)
        rules = Rules(known, skip)
        for batch in batches:
            waiting, rows = batch.column(0).to_pylist()[::-1], []
            while waiting and len(rows) < ENTRIES:
                found, more = below(store, base, waiting.pop(), rules)
                rows += found
                waiting += more
            rows += [(f, "waiting", None, None) for f in waiting]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.float64()))], names=["path", "kind", "size", "time"])

    out, frontier, n = None, spark.createDataFrame([("",)], "path string"), 1
    while n:
        found = written(frontier.repartition(-(-n // FOLDERS), "path").mapInArrow(listed, _ENTRY), "walk")
        rows = found.filter("kind <> 'waiting'")
        out = rows if out is None else out.unionByName(rows)
        frontier = found.filter("kind = 'waiting'").select("path")
        n = frontier.count()
    return out


def supported(path) -> object:
    """Whether a path's ending has an extractor."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*LANGUAGES)


def contents(files: DataFrame, root: str) -> DataFrame:
    """(path, content, error) of files (path, size) below a root, read in the executors."""

    def read(batches):
        store, base = opened(root)
        for batch in batches:
            held, size = [], 0
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (expected or 0) > LONGEST:
                    held.append((path, None, f"{expected} bytes are too many"))
                else:
                    try:
                        with store.open_input_stream(f"{base}/{path}") as f:
                            held.append((path, f.read(), None))
                    except OSError as e:
                        held.append((path, None, f"{type(e).__name__}: {e}"))
                size += len(held[-1][1] or b"")
                if size >= BATCH_BYTES:
                    yield _batch(held)
                    held, size = [], 0
            yield _batch(held)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary(), pa.string()))], names=["path", "content", "error"])

    return files.select("path", "size").mapInArrow(read, _CONTENT)
