"""Changes of a source tree as a stream: a data source whose offsets are listings.

Each offset is the number of a listing (path, size, time) that is kept in a state folder.
When Spark asks for the newest offset the tree is listed, leaving out folders that are
ignored before they are entered, and compared with the listing before: what is new was
created, what is missing deleted, what has another size or time modified, and a deleted and
a created file of one name, size and time were moved. If anything differs, the listing and
its events are written under the next number, and only then is that offset told. So a
batch that is made again after a restart has the same events, what changed while nobody
watched is in the next batch, and nothing comes twice. Listings before a finished batch go.

Listings are compared in the source's own process; a tree of millions of files should be
watched by its parts.
"""

from __future__ import annotations

import datetime as dt
import io
import json

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as stores
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from graphloom.schemas import EVENTS, LANGUAGES
from graphloom.sources.tree import Rules, listing, opened, own_patterns

NAME = "graphloom_tree"
_EVENT = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("kind", pa.string()), ("path", pa.string()), ("dest_path", pa.string())])
Listing = dict[str, tuple[int, float]]


def compared(before: Listing, now: Listing) -> list[tuple[str, str, str | None]]:
    """(kind, path, dest_path) of what differs between two listings; deletions come first, then moves."""
    gone, new = {p: before[p] for p in before.keys() - now.keys()}, {p: now[p] for p in now.keys() - before.keys()}
    same = {}
    for p in sorted(gone):
        same.setdefault((p.rpartition("/")[2], *gone[p]), []).append(p)
    moved = []
    for p in sorted(new):
        sources = same.get((p.rpartition("/")[2], *new[p]))
        if sources:
            moved.append(("moved", sources.pop(0), p))
    done = {p for _, p, _ in moved} | {d for _, _, d in moved}
    out = [("deleted", p, None) for p in sorted(gone) if p not in done] + moved
    out += [("created", p, None) for p in sorted(new) if p not in done]
    return out + [("modified", p, None) for p in sorted(now.keys() & before.keys()) if now[p] != before[p]]


class Listings:
    """The numbered listings and events of a state folder."""

    def __init__(self, state: str):
        self.store, self.base = opened(state)
        self.store.create_dir(self.base, recursive=True)

    def numbers(self) -> list[int]:
        found = self.store.get_file_info(stores.FileSelector(self.base, allow_not_found=True))
        return sorted(int(f.base_name[8:-8]) for f in found if f.base_name.startswith("listing-") and f.base_name.endswith(".parquet"))

    def _put(self, name: str, table: pa.Table) -> None:
        """Writes a file under another name, and gives it its name when it is whole."""
        data = io.BytesIO()
        pq.write_table(table, data)
        with self.store.open_output_stream(f"{self.base}/.{name}") as f:
            f.write(data.getvalue())
        self.store.move(f"{self.base}/.{name}", f"{self.base}/{name}")

    def _get(self, name: str) -> pa.Table:
        """A file, or the folder of a table that Spark wrote."""
        return pq.read_table(f"{self.base}/{name}", filesystem=self.store)

    def put(self, number: int, files: Listing, events: list[tuple[str, str, str | None]]) -> None:
        now = dt.datetime.now(dt.timezone.utc)
        rows = [((number << 32) + k, now, *e) for k, e in enumerate(events)]
        self._put(f"events-{number}.parquet", pa.table({f.name: pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_EVENT)}))
        paths = sorted(files)
        self._put(f"listing-{number}.parquet", pa.table({"path": pa.array(paths, pa.string()), "size": pa.array([files[p][0] for p in paths], pa.int64()), "time": pa.array([files[p][1] for p in paths], pa.float64())}))

    def get(self, number: int) -> Listing:
        t = self._get(f"listing-{number}.parquet")
        return {p: (s, m) for p, s, m in zip(*(t.column(c).to_pylist() for c in ("path", "size", "time")), strict=True)}

    def events(self, number: int) -> pa.Table:
        return self._get(f"events-{number}.parquet")

    def forget(self, before: int) -> None:
        """Deletes what is older than a number, and its events."""
        for n in self.numbers():
            if n < before:
                for name in (f"listing-{n}.parquet", f"events-{n}.parquet"):
                    kind = self.store.get_file_info(f"{self.base}/{name}").type
                    if kind == stores.FileType.File:
                        self.store.delete_file(f"{self.base}/{name}")
                    elif kind == stores.FileType.Directory:
                        self.store.delete_dir(f"{self.base}/{name}")


def listed_now(root: str, patterns: list[str] | None, skip) -> Listing:
    """The supported files of a tree."""
    rules = Rules(own_patterns(root) if patterns is None else patterns, skip)
    return {p: (size, time) for p, kind, size, time in listing(root, rules) if kind == "file" and p.rpartition(".")[2].lower() in LANGUAGES}


def start(listed: DataFrame, state: str) -> None:
    """Makes a listed tree (path, size, time) the first that a watch compares with, unless there is one; Spark writes it."""
    if not Listings(state).numbers():
        listed.write.mode("ignore").parquet(f"{state if '://' in state else 'file://' + state}/listing-1.parquet")


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.kept = options["root"], Listings(options["state"])
        self.patterns, self.skip = json.loads(options.get("patterns", "null")), json.loads(options.get("skip", "[]"))

    def initialOffset(self) -> dict:
        return {"listing": min(self.kept.numbers(), default=0)}

    def latestOffset(self) -> dict:
        number = max(self.kept.numbers(), default=0)
        now = listed_now(self.root, self.patterns, self.skip)
        events = compared(self.kept.get(number) if number else {}, now)
        if events:
            number += 1
            self.kept.put(number, now, events)
        return {"listing": number}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(n) for n in range(start["listing"] + 1, end["listing"] + 1)]

    def read(self, partition: InputPartition):
        yield from self.kept.events(partition.value).to_batches()

    def commit(self, end: dict) -> None:
        self.kept.forget(end["listing"])


class TreeEvents(DataSource):
    """Options: root, state (a folder of the source's own), patterns and skip (JSON lists)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        return EVENTS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def tree_events(spark, root: str, state: str, patterns: list[str] | None = None, skip=()):
    """The stream of a tree's file events."""
    spark.dataSource.register(TreeEvents)
    reader = spark.readStream.format(NAME).option("root", root).option("state", state)
    return reader.option("patterns", json.dumps(patterns)).option("skip", json.dumps(list(skip or ()))).load()
