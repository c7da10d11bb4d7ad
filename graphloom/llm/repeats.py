"""Removal of passages that repeat: every word of a window whose words also start anywhere else.

Documents are gathered into parts of bounded size, written once. A part counts its windows
in a count-min sketch of two rows, as wide as the corpus has bytes, of which it keeps the
cells that aren't zero. The rows are cut into slices; a slice's task adds the sketches of
all parts, and answers each part with those of its cells that reached two. A window's
count is at most the smaller of its two cells, so one that repeats is never missed, and a
part needs to know no cells but its own: nothing is broadcast, and what moves grows with
the input.

A second pass looks exactly at the windows that are estimated to repeat: they are grouped
by 128 bits of two hashes of their words, and those that turn out to be alone are sent
back to their part. (Two of n such windows are taken for one with a chance of about
n**2 / 2**129, unless texts are made to break the hashes.) Inside a part, equal windows
are counted before they move, so a window in every document is one entry for each part.

Null texts have no words; texts of fewer words than a window stay whole, with single
spaces between words. Windows may overlap, also with themselves. Repeated rows are
documents each, so all their windows repeat. A very long text is a part of its own. An
empty table gives an empty result; null ids and other columns don't matter.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import dropped, small_batches, written
from graphloom.llm.shingles import CASED, _power, mix, runs, text_bytes, word_bounds, word_hashes

WINDOW = 35
#: Bytes of a part's texts at least, but for the last of a task.
PART_BYTES = 8 << 20
ROWS = 2
#: Cells of a slice, as powers of two: the least, the most, and the number of slices between.
SLICE, LARGEST_SLICE, SLICES = 16, 26, 10
_PART = "part bigint, size bigint, docs binary"
_OPEN = "part bigint, doc_id bigint, n_words bigint, n_removed bigint, removed array<struct<first:bigint,end:bigint>>, kept string, docs binary"
_NAMES = ["part", "doc_id", "n_words", "n_removed", "removed", "kept", "docs"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.string(), pa.binary()]
_DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string()), ("runs", pa.binary())])


def _frozen(columns: list) -> bytes:
    """Documents as one compressed value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _DOCS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _DOCS.types, strict=True)], schema=_DOCS))
    return sink.getvalue().to_pybytes()


def _thawed(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def _column(table: pa.Table, n: int) -> pa.Array:
    chunks = table.column(n).chunks
    return chunks[0] if chunks else pa.array([], table.schema.types[n])


def coded(cells: np.ndarray) -> bytes:
    """Rising numbers as their differences, byte plane by byte plane, compressed."""
    steps = np.diff(cells.astype(np.int64), prepend=0).astype("<u4")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(cells).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True)


def decoded(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], 4 * n, "zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64))


def parts(docs: DataFrame, part_bytes: int) -> DataFrame:
    """The documents in parts of neighbours: (part, size in bytes, docs)."""

    def gather(batches):
        from pyspark import TaskContext

        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n = text.as_buffer().size if text.is_valid else 0
                if ids and size + n > part_bytes:
                    yield _row(number, size, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(i)
                texts.append(text.as_py())
                size += n
        if ids:
            yield _row(number, size, ids, texts)

    def _row(number, size, ids, texts):
        data = _frozen([ids, texts, [None] * len(ids)])
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([size]), pa.array([data], pa.binary())], names=["part", "size", "docs"])

    return small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(gather, _PART)


class Windows:
    """The windows of the texts of a part, run by run: (first text, end, words of each text, first words of the windows, hashes)."""

    def __init__(self, texts: pa.Array, window: int):
        self.data, self.offsets = text_bytes(texts)
        self.window = window

    def hashes(self, values: np.ndarray, words: tuple, first: np.ndarray) -> np.ndarray:
        text, start, stop = words
        w = word_hashes(text, start, stop, values)
        power, inverse = _power(len(w))
        sums = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(w * power[: len(w)], out=sums[1:])
        return mix((sums[first + self.window] - sums[first]) * inverse[first])

    def __iter__(self):
        for at, to in runs(self.offsets):
            start, stop, counts = word_bounds(self.data, self.offsets[at:to], self.offsets[at + 1 : to + 1])
            n = np.maximum(counts - self.window + 1, 0)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first = within + np.repeat(np.cumsum(counts) - counts, n)
            words = self.data[self.offsets[at] : self.offsets[to]], start, stop
            yield at, counts, np.repeat(np.arange(to - at), n), within, first, words, self.hashes(CASED[0], words, first)


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(hashes, row + 1) >> np.uint64(64 - bits)).astype(np.int64)


def sketches(made: DataFrame, bits: int, slice_bits: int, window: int) -> DataFrame:
    """(slice, part, cells): each part's cells, twice their number in the slice and one more if they count two or more."""

    def sketch(batches):
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [h for *_, h in Windows(_column(_thawed(data.as_py()), 1), window)]
                hashes = np.concatenate([*found, np.empty(0, np.uint64)])
                if not len(hashes):
                    continue
                slices, values = [], []
                for row in range(ROWS):
                    cells, counts = np.unique(_cells(hashes, row, bits), return_counts=True)
                    number, cuts = np.unique(cells >> slice_bits, return_index=True)
                    said = ((cells & ((1 << slice_bits) - 1)) << 1) | (counts > 1)
                    for s, own in zip(number.tolist(), np.split(said, cuts[1:]), strict=True):
                        slices.append(row << 48 | s)
                        values.append(coded(own))
                yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), pa.array([part] * len(slices), pa.int64()), pa.array(values, pa.binary())], names=["slice", "part", "cells"])

    return made.select("part", "docs").mapInArrow(sketch, "slice bigint, part bigint, cells binary")


def merged(sketched: DataFrame, slice_bits: int) -> DataFrame:
    """(part, slice, cells): of each part's cells those that all parts together count twice or more."""

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(1 << slice_bits, np.uint8)
        rows = [x.as_py() for x in group.column("cells")]
        for data in rows:
            said = decoded(data)
            total[said >> 1] = np.minimum(total[said >> 1] + 1 + (said & 1), 2)
        kept = [c[total[c] > 1] for c in (decoded(data) >> 1 for data in rows)]
        some = np.flatnonzero([len(c) > 0 for c in kept])
        return pa.table({"part": group.column("part").take(pa.array(some)), "slice": group.column("slice").take(pa.array(some)), "cells": pa.array([coded(kept[i]) for i in some], pa.binary())})

    return sketched.groupBy("slice").applyInArrow(add, "part bigint, slice bigint, cells binary")


def _spans(starts: np.ndarray) -> np.ndarray:
    """(first, length) of the runs of rising numbers."""
    if not len(starts):
        return np.empty((0, 2), "<u4")
    cuts = np.flatnonzero(np.diff(starts) != 1) + 1
    first = np.concatenate([[0], cuts])
    return np.stack([starts[first], np.diff(np.append(first, len(starts)))], axis=1).astype("<u4")


def _starts(spans: bytes) -> np.ndarray:
    x = np.frombuffer(spans, "<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(x[:, 0] - np.cumsum(x[:, 1]) + x[:, 1], x[:, 1]) + np.arange(x[:, 1].sum())


def _finished(part: int, doc_id, text: str | None, starts: np.ndarray, window: int) -> tuple:
    """The row of a document without the words of the windows that start at ``starts``."""
    words = (text or "").encode().split()  # bytes split at the six ASCII white spaces
    if not len(starts):
        return part, doc_id, len(words), 0, [], b" ".join(words).decode(), None
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    stay = np.cumsum(edge)[:-1] == 0
    turns = np.flatnonzero(np.diff(np.concatenate([[True], stay, [True]]).astype(np.int8))).tolist()
    removed = [{"first": a, "end": b} for a, b in zip(turns[::2], turns[1::2], strict=True)]
    return part, doc_id, len(words), int((~stay).sum()), removed, b" ".join(itertools.compress(words, stay.tolist())).decode(), None


def _rows(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_NAMES)
    return pa.table({c: pa.array(list(x), t) for c, x, t in zip(_NAMES, columns, _TYPES, strict=True)})


def estimated(made: DataFrame, answers: DataFrame, bits: int, slice_bits: int, window: int) -> DataFrame:
    """Documents without a window that may repeat, finished; the others of a part in one row, with their estimated windows."""

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        known: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        for s, data in sorted(zip(right.column("slice").to_pylist(), right.column("cells").to_pylist(), strict=True)):
            known[s >> 48].append(decoded(data) + ((s & ((1 << 48) - 1)) << slice_bits))
        counted = [np.concatenate([*k, np.full(1, 1 << bits)]) for k in known]
        out = []
        for part, data in zip(left.column("part").to_pylist(), left.column("docs").to_pylist(), strict=True):
            docs = _thawed(data)
            ids, texts, opened = _column(docs, 0).to_pylist(), _column(docs, 1), ([], [], [])
            for at, counts, owner, within, _, _, h in Windows(texts, window):
                may = np.ones(len(h), bool)
                for row in range(ROWS):
                    cells = _cells(h[may], row, bits)
                    may[may] = counted[row][np.searchsorted(counted[row], cells)] == cells
                own, starts = owner[may], within[may]
                cuts = np.searchsorted(own, np.arange(len(counts) + 1))
                for d in range(len(counts)):
                    text = texts[at + d].as_py()
                    if cuts[d] == cuts[d + 1]:
                        out.append(_finished(part, ids[at + d], text, starts[:0], window))
                    else:
                        for values, x in zip(opened, (ids[at + d], text, _spans(starts[cuts[d] : cuts[d + 1]]).tobytes()), strict=True):
                            values.append(x)
            if opened[0]:
                out.append((part, None, None, None, None, None, _frozen(opened)))
        return _rows(out)

    sides = made.select("part", "docs").groupBy("part").cogroup(answers.toDF("part", "slice", "cells").groupBy("part"))
    return sides.applyInArrow(look, _OPEN)


def _chosen(table: pa.Table, window: int):
    """(hashes, second hashes) of the estimated windows of a part's documents, in order."""
    spans = [_starts(x) for x in _column(table, 2).to_pylist()]
    for at, counts, _, _, _, words, _ in Windows(_column(table, 1), window):
        begins = np.cumsum(counts) - counts
        first = np.concatenate([s + b for s, b in zip(spans[at : at + len(counts)], begins.tolist(), strict=True)])
        w = Windows(pa.array([], pa.string()), window)
        yield w.hashes(CASED[0], words, first), w.hashes(CASED[1], words, first)


def alone(opened: DataFrame, buckets: int, window: int) -> DataFrame:
    """(part, alone): the numbers of the estimated windows, in their part's order, that start nowhere else."""

    def keys(batches):
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                both = [np.concatenate(x) for x in zip(*_chosen(_thawed(data.as_py()), window), strict=True)]
                order = np.lexsort(both[::-1])
                a, b = (x[order] for x in both)
                new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
                many = np.diff(np.append(np.flatnonzero(new), len(a))) > 1
                bucket = (a[new] >> np.uint64(64 - buckets)).astype(np.int64) if buckets else np.zeros(new.sum(), np.int64)
                own, where = np.stack([a[new], b[new]], axis=1), np.where(many, -1, order[new])
                at = np.flatnonzero(np.diff(bucket, prepend=-1))
                values = [(x.tobytes(), y.astype("<i4").tobytes()) for x, y in zip(np.split(own, at[1:]), np.split(where, at[1:]), strict=True)]
                columns = [pa.array(bucket[at]), pa.array([part] * len(at), pa.int64()), *(pa.array(c, pa.binary()) for c in zip(*values, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "part", "keys", "place"])

    def single(group: pa.Table) -> pa.Table:
        number = [len(x.as_py()) // 4 for x in group.column("place")]
        k = np.frombuffer(b"".join(x.as_py() for x in group.column("keys")), np.uint64).reshape(-1, 2)
        place = np.frombuffer(b"".join(x.as_py() for x in group.column("place")), "<i4")
        part = np.repeat(group.column("part").to_numpy(), number)
        order = np.lexsort((k[:, 1], k[:, 0]))
        same = (k[order[1:]] == k[order[:-1]]).all(axis=1)
        only = order[~np.append(False, same) & ~np.append(same, False)]
        only = only[place[only] >= 0]
        only = only[np.argsort(part[only], kind="stable")]
        names, cuts = np.unique(part[only], return_index=True)
        return pa.table({"part": pa.array(names, pa.int64()), "alone": pa.array([x.astype("<i4").tobytes() for x in (np.split(place[only], cuts[1:]) if len(names) else [])], pa.binary())})

    spread = opened.mapInArrow(keys, "bucket bigint, part bigint, keys binary, place binary")
    return spread.groupBy("bucket").applyInArrow(single, "part bigint, alone binary")


def deduplicated(docs: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept): each document's number of words, the spans of words that go, and the text left."""
    made = written(parts(docs, part_bytes), "repeats-parts")
    size = made.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bits = max(SLICE, int(size).bit_length())
    slice_bits = min(max(SLICE, bits - SLICES), LARGEST_SLICE)
    answers = merged(sketches(made, bits, slice_bits, window), slice_bits)
    looked = written(estimated(made, answers, bits, slice_bits, window), "repeats-estimated")
    dropped(made)
    opened = looked.filter("docs is not null").select("part", "docs")
    wrong = alone(opened, bits - slice_bits, window)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        single = np.frombuffer(b"".join(right.column("alone").to_pylist()), "<i4")
        for part, data in zip(left.column("part").to_pylist(), left.column("docs").to_pylist(), strict=True):
            table, at = _thawed(data), 0
            spans = [_starts(x) for x in _column(table, 2).to_pylist()]
            repeated = np.ones(sum(map(len, spans)), bool)
            repeated[single] = False
            for doc_id, text, starts in zip(_column(table, 0).to_pylist(), _column(table, 1), spans, strict=True):
                out.append(_finished(part, doc_id, text.as_py(), starts[repeated[at : at + len(starts)]], window))
                at += len(starts)
        return _rows(out)

    sides = opened.groupBy("part").cogroup(wrong.toDF("part", "alone").groupBy("part"))
    last = sides.applyInArrow(finish, _OPEN)
    return looked.filter("docs is null").unionByName(last).drop("part", "docs")


def digests(found: DataFrame) -> DataFrame:
    """A document's number of words, of removed ones, and the hash of the text left."""
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The same in DuckDB's SQL, window by window.
SQL = rf"""
with w as materialized (
  select row_number() over () as nr, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), s as (
  select nr, words, unnest(range(1, len(words) - {WINDOW} + 2)) as pos from w where len(words) >= {WINDOW}
), h as materialized (select nr, pos, sha256(array_to_string(list_slice(words, pos, pos + {WINDOW} - 1), ' ')) as name from s
), r as (select nr, pos from h where name in (select name from h group by name having count(*) > 1)
), gone as (select distinct nr, unnest(range(pos, pos + {WINDOW})) as pos from r
), told as (
  select p.nr, count(gone.pos) as n_removed, coalesce(string_agg(word, ' ' order by p.pos) filter (where gone.pos is null), '') as kept
  from (select nr, unnest(words) as word, generate_subscripts(words, 1) as pos from w) p left join gone on gone.nr = p.nr and gone.pos = p.pos group by p.nr
)
select doc_id, len(words) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join told using (nr)
"""
