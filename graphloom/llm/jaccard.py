"""Exact n-gram Jaccard join of whole texts by PartEnum signatures, as linked components.

Texts with equal shingle sets form a class; all further work is on classes. Sets are
put into size bands [l, 5l/4], so linked sets (Jaccard 0.8 or more) lie in one band or
in neighbouring ones, and differ in at most k = 2u/9 elements, u being the upper end of
the larger one's band. For each of these two bands the domain of shingles is split into
n1 parts of three subparts each, and each pair of subparts of a part gives a signature:
the hash of the set's elements there. With n1 > k/2 parts, some part holds at most one
difference, and one pair of its subparts none: linked sets share a signature. A few
parts more than needed allow leaving out empty signatures, unless too many of a set's
are (then it keeps all, and so does any set that it could meet in an empty one only).

Signatures travel in packed blocks, in as many buckets as their counted number asks for,
and are matched by sorting in numpy. What shares a
signature is a candidate; candidates are bounded by sketches of their sets (a histogram
and parity bits), and all that remain are compared exactly. Work on large groups stays
linear where it can: a signature's first member, its leader, is compared with all
others; other pairs with a common leader are looked at once, not for each signature,
only where they are not in one component yet, and in blocks of bounded size.

Null texts and texts without words are alone in their component. Rows without a doc_id
link with nothing and have no component; where one of each component stays, they stay. Rows repeated, or
with equal texts, share a class; rows that repeat a doc_id with other texts are nodes
of their own, of which each stays that is the first of its component. Long texts are sets
like others. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import SPACE, dropped, small_batches, written
from graphloom.llm.shingles import mix, shingle_sets

#: Signatures that are packed before they are dealt out, at least and at most, and for each bucket.
FLUSH, MOST_FLUSHED, FLUSHED_EACH = 1 << 18, 1 << 22, 64
#: Signatures are dealt to so many buckets at least, so that few partitions get even shares, and
#: to one for each so many signatures, as a bucket is matched as a whole.
BUCKETS, BUCKET_SIGNATURES = 256, 1 << 20
#: The upper end of the largest band in which signatures are sets without few elements; splits of the others.
SMALLEST_SETS, SPLITS = 13, 4
#: Up to this many members, all pairs of a signature's group are candidates at once.
SMALL_GROUP = 8
#: Rows in a file of the tables that components are found with.
FILE_ROWS = 250_000
#: Members in a block when a large group's pairs across components are bounded.
PAIR_BLOCK = 2048
#: Ids of texts to compare are broadcast up to this many (16 bytes each), else joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: A sketch is a histogram of a set in so many bins (a byte each, at most 255), then so many bits:
#: each the parity of the number of elements in it. Each different element moves one bin, and one bit.
_BINS, _BITS = 64, 1024
_SKETCH = _BINS + _BITS // 8


@lru_cache(maxsize=1)
def _bands() -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of the size bands."""
    low, high = [1], [1]
    while high[-1] < 1 << 40:
        low.append(high[-1] + 1)
        high.append(low[-1] * 5 // 4)
    return np.array(low), np.array(high)


def _subset_signatures(values: np.ndarray, lengths: np.ndarray, band: np.ndarray, used: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(signatures, index of the set of each) for small sets: hashes of what is left without up to a few elements.

    A linked set that isn't larger lacks at most a fifth of a set, and a larger one at most a ninth.
    """
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths[used]).tolist():
        sets = np.flatnonzero(used & (lengths == n))
        own = values[starts[sets][:, None] + np.arange(n)]
        total, left = own.sum(axis=1, dtype=np.uint64)[:, None], []
        for without in range(n // (9 if step else 5) + 1):
            chosen = np.array(list(combinations(range(n), without)), np.int64).reshape(comb(n, without), without)
            sums = total - own[:, chosen].sum(axis=2, dtype=np.uint64)
            left.append(mix(sums ^ mix(np.uint64(n - without) | (band[sets].astype(np.uint64) << np.uint64(48))[:, None], 6), 7))
        found = np.hstack(left)
        yield found.ravel(), np.repeat(sets, found.shape[1])


def _part_signatures(hashes: np.ndarray, values: np.ndarray, lengths: np.ndarray, band: np.ndarray, used: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(signatures, index of the set of each) by parts and pairs of subparts; sets with too many empty ones are split again."""
    element_set = np.repeat(np.arange(len(lengths)), lengths)
    top = _bands()[1][band]
    k = 2 * top // 9
    for split in range(SPLITS):
        n1 = np.where(used, k // 2 + 1 + k // 16, 0)
        base = np.cumsum(n1) - n1
        total = int(n1.sum())
        if not total:
            return
        inside = used[element_set]
        who, value = element_set[inside], values[inside]
        spread = mix(hashes[inside], 1 + 16 * split)
        part = ((spread >> np.uint64(32)) * n1[who].astype(np.uint64)) >> np.uint64(32)
        sub = ((spread & np.uint64(0xFFFFFFFF)) * np.uint64(3)) >> np.uint64(32)
        cell = (base[who] + part.astype(np.int64)) * 3 + sub.astype(np.int64)
        sums = np.zeros(total * 3, np.uint64)
        np.add.at(sums, cell, value)
        counts = np.bincount(cell, minlength=total * 3).reshape(-1, 3)
        sums = sums.reshape(-1, 3)
        rest, rest_counts = sums.sum(axis=1, keepdims=True, dtype=np.uint64) - sums, counts.sum(axis=1, keepdims=True) - counts
        part_set = np.repeat(np.arange(len(lengths)), n1)
        weak = np.bincount(part_set, (rest_counts == 0).any(axis=1), len(lengths))
        largest_difference = (lengths + np.minimum(top, lengths * 5 // 4)) // 9
        again = used & (weak >= n1 - largest_difference // 2)
        place = (np.arange(total) - base[part_set]).astype(np.uint64) * np.uint64(3)
        place = place[:, None] + np.arange(3, dtype=np.uint64) + ((band[part_set] * SPLITS + split).astype(np.uint64) << np.uint64(46))[:, None]
        signature = mix(rest ^ mix(place, 3), 4)
        emitted = rest_counts > 0
        if split == SPLITS - 1:
            emitted |= again[part_set][:, None]
        yield signature[emitted], np.broadcast_to(part_set[:, None], emitted.shape)[emitted]
        used = again


def _signatures(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, index of the set of each) of sets that lie one after the other."""
    low, high = _bands()
    own = np.searchsorted(high, lengths)
    values = mix(hashes, 2)
    found = [(np.empty(0, np.uint64), np.empty(0, np.int64))]
    for step in (0, 1):
        band = own + step
        used = (high[band] >= 5) & (lengths > 0) & (lengths * 5 // 4 >= low[band])  # smaller sets link with equal ones only
        small = high[band] <= SMALLEST_SETS
        found += _subset_signatures(values, lengths, band, used & small, step)
        found += _part_signatures(hashes, values, lengths, band, used & ~small)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _fingerprints(hashes: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each set: the sum of its mixed elements."""
    sums = np.zeros(len(lengths), np.uint64)
    full = np.flatnonzero(lengths)
    if len(full):
        starts = (np.cumsum(lengths) - lengths)[full]
        sums[full] = mix(np.add.reduceat(mix(hashes, seed), starts) + lengths[full].astype(np.uint64), seed)
    return sums.view(np.int64)


def _sketches(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A row of ``_SKETCH`` bytes for each set."""
    n = len(lengths)
    who = np.repeat(np.arange(n), lengths)
    spread = mix(hashes, 5)
    bins = np.bincount(who * _BINS + (spread >> np.uint64(58)).astype(np.int64), minlength=n * _BINS)
    bits = np.bincount(who * _BITS + (spread & np.uint64(_BITS - 1)).astype(np.int64), minlength=n * _BITS) & 1
    return np.hstack([np.minimum(bins, 255).astype(np.uint8).reshape(n, _BINS), np.packbits(bits.astype(np.uint8).reshape(n, _BITS), axis=1)])


def _could_link(na, nb, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes and sketches can have a Jaccard similarity of 0.8."""
    moved = np.abs(a[..., :_BINS].astype(np.int16) - b[..., :_BINS].astype(np.int16)).sum(axis=-1)
    flipped = np.bitwise_count(a[..., _BINS:] ^ b[..., _BINS:]).sum(axis=-1, dtype=np.int64)
    return 90 * (na + nb - np.maximum(moved, flipped)) >= 80 * (na + nb)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id, set_check, sketch, text_id) of every document; the last is a hash of its text."""

    def digest(batches):
        for batch in batches:
            for at, hashes, lengths in shingle_sets(batch.column(1)):
                n = len(lengths)
                sketches = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_SKETCH), n, [None, pa.py_buffer(_sketches(hashes, lengths))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(lengths), pa.array(_fingerprints(hashes, lengths, 11)), pa.array(_fingerprints(hashes, lengths, 12)), sketches, batch.column(2).slice(at, n)],
                    names=["doc_id", "n_shingles", "set_id", "set_check", "sketch", "text_id"],
                )

    schema = "doc_id bigint, n_shingles bigint, set_id bigint, set_check bigint, sketch binary, text_id bigint"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_id")).mapInArrow(digest, schema)


def bucket_count(classes: DataFrame) -> int:
    """Buckets for the signatures of the classes, of which a set has about one for each element and band."""
    some = classes.agg(F.sum(F.when(F.col("n_shingles") <= SMALLEST_SETS, 120).otherwise(6 + F.col("n_shingles")))).first()[0]
    return max(BUCKETS, -(-(some or 0) // BUCKET_SIGNATURES))


def candidates(docs: DataFrame, n_buckets: int) -> DataFrame:
    """(a, b, led): pairs of set ids with a common signature; where the group is large,
    only pairs of its leader a with the others, and led is true. Pairs may come repeatedly."""

    def packed(signatures: list, ids: list):
        s, i = np.concatenate(signatures), np.concatenate(ids)
        bucket = (s % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        s, i, bucket = s[order] >> np.uint64(24), i[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        high, low = (s >> np.uint64(8)).astype(np.uint32), s.astype(np.uint8)
        rows = [
            (bucket[a], high[a:b].tobytes(), low[a:b].tobytes(), i[a:b].tobytes())
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(s)], strict=True)
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 3), strict=True)], names=["bucket", "high", "low", "ids"])

    def sign(batches):
        signatures, ids, n = [], [], 0
        seen: set[int] = set()  # classes that this task has signed lately
        for batch in batches:
            for _, hashes, lengths in shingle_sets(batch.column(0)):
                names = _fingerprints(hashes, lengths, 11)
                new = np.zeros(len(names), bool)
                for k, name in enumerate(names.tolist()):
                    if name not in seen:
                        new[k] = True
                        seen.add(name)
                if len(seen) > 100_000:
                    seen.clear()
                hashes = hashes[np.repeat(new, lengths)]
                s, who = _signatures(hashes, lengths[new])
                order = np.argsort(who, kind="stable")
                signatures.append(s[order])
                ids.append(names[new][who[order]])
                n += len(s)
                if n >= max(FLUSH, min(MOST_FLUSHED, FLUSHED_EACH * n_buckets)):
                    yield packed(signatures, ids)
                    signatures, ids, n = [], [], 0
        if n:
            yield packed(signatures, ids)

    def match(group: pa.Table) -> pa.Table:
        high, low, ids = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("high", np.uint32), ("low", np.uint8), ("ids", np.int64)))
        s = (high.astype(np.uint64) << np.uint64(8)) | low
        order = np.argsort(s)
        s, ids = s[order], ids[order]
        same = s[1:] == s[:-1]
        shared = np.append(same, False) | np.insert(same, 0, False)
        s, ids = s[shared], ids[shared]
        order = np.lexsort((ids, s))
        s, ids = s[order], ids[order]
        fresh = np.ones(len(s), bool)
        fresh[1:] = (s[1:] != s[:-1]) | (ids[1:] != ids[:-1])
        s, ids = s[fresh], ids[fresh]
        starts = np.flatnonzero(np.diff(s, prepend=np.uint64(1 << 63)) != 0) if len(s) else np.empty(0, np.int64)
        sizes = np.diff(np.append(starts, len(s)))
        size, start = np.repeat(sizes, sizes), np.repeat(starts, sizes)
        first, second = [], []
        for d in range(1, SMALL_GROUP):
            at = np.flatnonzero((size <= SMALL_GROUP) & (np.arange(len(s)) + d < start + size))
            first.append(ids[at])
            second.append(ids[at + d])
        star = np.flatnonzero((size > SMALL_GROUP) & (np.arange(len(s)) > start))
        few = np.unique(np.stack([np.concatenate(first), np.concatenate(second)]), axis=1) if len(s) else np.empty((2, 0), np.int64)
        led = np.unique(np.stack([ids[start[star]], ids[star]]), axis=1) if len(star) else np.empty((2, 0), np.int64)
        both = np.hstack([few, led]).astype(np.int64)
        return pa.table({"a": pa.array(both[0]), "b": pa.array(both[1]), "led": pa.array(np.arange(both.shape[1]) >= few.shape[1])})

    blocks = docs.select("text").mapInArrow(sign, "bucket bigint, high binary, low binary, ids binary")
    tasks = n_buckets // 4
    if tasks > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):  # few buckets to a task, however many there are
        blocks = blocks.repartition(tasks, "bucket")
    return blocks.groupBy("bucket").applyInArrow(match, "a bigint, b bigint, led boolean")


def _bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sketches don't rule out."""

    def prune(batches):
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, _SKETCH) for c in (4, 5))
            yield batch.select(["a", "b"]).filter(pa.array(_could_link(na, nb, sa, sb)))

    sides = [classes.select(F.col("set_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(prune, "a bigint, b bigint")


def _texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(set_id, text) for the set ids in ``nodes``."""

    def named(batches):
        seen: set[int] = set()  # a repeated row is named once by a task
        for batch in batches:
            for at, hashes, lengths in shingle_sets(batch.column(0)):
                names = _fingerprints(hashes, lengths, 11)
                new = np.array([n not in seen and not seen.add(n) for n in names.tolist()], bool)
                if len(seen) > 100_000:
                    seen.clear()
                out = pa.RecordBatch.from_arrays([pa.array(names), batch.column(0).slice(at, len(lengths)).cast(pa.string())], names=["set_id", "text"])
                yield out.filter(pa.array(new))

    wanted = classes.join(nodes, "set_id").select(F.col("rep").alias("doc_id")).distinct()
    found = docs.select("doc_id", "text").join(_few(wanted), "doc_id", "left_semi")
    # a doc_id that is repeated brings in sets that nobody asked for, which the join with pairs leaves
    # out, or one set from several tasks, which makes links come repeatedly
    return found.select("text").mapInArrow(named, "set_id bigint, text string")


def _gathered(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table of few files, each of about ``FILE_ROWS`` rows, though many tasks make it."""
    made = written(df, name)
    out = written(made.coalesce(1 + made.count() // FILE_ROWS), name)
    dropped(made)
    return out


def _few(ids: DataFrame) -> DataFrame:
    """Ids with a broadcast hint if their counted rows are few."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of at least 0.8."""

    def compare(batches):
        for batch in batches:
            sides = []
            for column in (2, 3):
                own = []
                for _, hashes, lengths in shingle_sets(batch.column(column)):
                    own += np.split(hashes, np.cumsum(lengths)[:-1])
                sides.append(own)
            keep = []
            for x, y in zip(*sides, strict=True):
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * common >= 80 * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs
    for x in "ab":  # only texts that this side needs are moved
        needed = texts.select(F.col("set_id").alias(x), F.col("text").alias(f"t{x}")).join(_few(pairs.select(x).distinct()), x, "left_semi")
        both = both.join(needed, x)
    return both.select("a", "b", "ta", "tb").mapInArrow(compare, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each end of a link reaches.

    Labels go to neighbours, then to the labels' own labels, until none changes; the
    number of rounds follows the logarithm of the longest path. Each round is written, in
    files of about ``FILE_ROWS`` rows.
    """
    files = 1 + links.count() // FILE_ROWS
    edges = written(links.select("a", "b").union(links.select("b", "a")).toDF("u", "v").distinct().coalesce(files), "edges")
    labels = written(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("label")).select(F.col("u").alias("node"), "label").coalesce(files), "labels")
    while True:
        near = edges.join(labels, edges.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        better = labels.join(near, labels.node == near.u).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        better = written(better.coalesce(files), "labels")
        jump = better.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = better.join(jump, better.label == jump.at).select("node", "old", F.least("label", "further").alias("label"))
        new = written(new.coalesce(files), "labels")
        moved = new.filter("old <> label").limit(1).count()
        dropped(labels, better)
        labels = new
        if not moved:
            dropped(edges)
            return labels.select("node", F.col("label").alias("component"))


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _led_pairs(led: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs with a common leader that lie in different components and that sketches don't
    rule out; each leader's group is dealt out as pairs of bounded blocks."""

    def meet(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        ids, comp, n = (group.column(c).to_numpy() for c in ("member", "component", "n_shingles"))
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, _SKETCH)
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)  # 0: the block with itself
        first, second = [], []
        for i in left:
            other = right[(comp[right] != comp[i]) & ((ids[right] > ids[i]) | (side[i] == 1)) & (5 * n[right] >= 4 * n[i]) & (5 * n[i] >= 4 * n[right])]
            other = other[_could_link(n[i], n[other], sketch[i], sketch[other])]
            first.append(np.minimum(ids[i], ids[other]))
            second.append(np.maximum(ids[i], ids[other]))
        return pa.table({"a": np.concatenate([*first, np.empty(0, np.int64)]).astype(np.int64), "b": np.concatenate([*second, np.empty(0, np.int64)]).astype(np.int64)})

    known = (
        led.select(F.col("a").alias("leader"), F.col("b").alias("member"))
        .distinct()
        .join(labels.withColumnRenamed("node", "member"), "member", "left")
        .withColumn("component", F.coalesce("component", "member"))
    )
    groups = known.groupBy("leader").agg(F.count("*").alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1")
    split = _gathered(groups.select("leader", F.ceil(F.col("n") / PAIR_BLOCK).cast("int").alias("blocks")), "groups")
    own = known.join(_few(split), "leader").withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    own = own.select(
        "leader", "member", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.expr("case when block = other then 0 when block < other then 1 else 2 end").alias("side"),
    )
    own = own.join(classes.select(F.col("set_id").alias("member"), "n_shingles", "sketch"), "member")
    return own.groupBy("leader", "i", "j").applyInArrow(meet, "a bigint, b bigint").distinct()


_KEY = ["set_id", "set_check", "n_shingles"]


def _classes(docs: DataFrame) -> DataFrame:
    """The classes of ``docs``, by ``_KEY``: number of rows, doc_id and text's hash of the first, and sketch."""
    of_class = digests(docs).filter("n_shingles > 0").groupBy(*_KEY)
    found = of_class.agg(F.count("*").alias("rows"), F.min(F.struct("doc_id", "text_id")).alias("first"), F.first("sketch").alias("sketch"))
    return _gathered(found.select(*_KEY, "rows", F.col("first.doc_id").alias("rep"), F.col("first.text_id").alias("rep_text"), "sketch"), "classes")


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, labels): the classes of ``docs``, and (node, component) of those with a link.

    What is read again within is written, so that the shuffles that made it leave nothing
    behind, and deleted at the end; what is returned is written.
    """
    classes = _classes(docs)
    found = written(candidates(docs, bucket_count(classes)), "candidates")
    pairs = written(_bounded(found.select("a", "b").distinct(), classes), "bounded")
    led = found.filter("led").select("a", "b")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).union(led.select("b")).distinct()
    texts = written(_texts(docs, classes, nodes), "texts")
    # first one pair for each text, then only pairs that are still apart, then the other pairs with a common leader
    leaders = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = _gathered(_linked(leaders, texts), "links")
    labels = components(links)
    rest = _gathered(_across(pairs, labels).join(leaders, ["a", "b"], "left_anti"), "rest")
    for more in (rest, None):
        if more is None:
            more = _gathered(_led_pairs(led, labels, classes).join(pairs, ["a", "b"], "left_anti"), "led")
        if more.limit(1).count():
            links = links.union(_gathered(_linked(more, texts), "links"))
            labels = components(links)
    dropped(texts, pairs, found)
    return classes, labels


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    every = small_batches(docs)
    classes, labels = _labelled(every.filter("doc_id is not null"))
    smallest = classes.join(labels, classes.set_id == labels.node).groupBy("component").agg(F.min("rep").alias("smallest"))
    of_class = (
        classes.join(labels, classes.set_id == labels.node, "left")
        .join(_few(smallest), "component", "left")  # a large component's classes stay where they are
        .select(*_KEY, F.coalesce("smallest", "rep").alias("component_id"))
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return digests(every).select("doc_id", *_KEY).join(of_class, _KEY, "left").select("doc_id", "n_shingles", component.alias("component_id"))


def link_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, n_links of every document: the number of other rows that it links with.

    Every pair of classes that its signatures and sketches allow is compared, those with a
    common leader in blocks, whatever their components: work grows with the square of a
    group of different near copies, and a pair's texts meet in one row. Equal texts are
    counted, not paired. Null and wordless texts, and rows without a doc_id, have no links.
    """
    every = small_batches(docs)
    named = every.filter("doc_id is not null")
    classes = _classes(named)
    found = written(candidates(named, bucket_count(classes)), "candidates")
    apart = classes.select(F.col("set_id").alias("node"), F.col("set_id").alias("component"))
    pairs = _bounded(found.select("a", "b").distinct(), classes).union(_led_pairs(found.filter("led").select("a", "b"), apart, classes))
    pairs = _gathered(pairs.distinct(), "pairs")
    texts = _texts(named, classes, pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct())
    texts = written(texts, "texts")
    links = _gathered(_linked(pairs, texts).distinct(), "links")
    dropped(texts, found)
    ends = links.select("a", "b").union(links.select("b", "a")).toDF("set_id", "other")
    others = ends.join(classes.select(F.col("set_id").alias("other"), "rows"), "other").groupBy("set_id").agg(F.sum("rows").alias("others"))
    of_class = classes.join(others, "set_id", "left").select(*_KEY, (F.coalesce("others", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    n_links = F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0)))
    return digests(every).select("doc_id", *_KEY).join(of_class, _KEY, "left").select("doc_id", "n_shingles", n_links.cast("long").alias("n_links"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """The first row of each component of ``docs``, that with the smallest doc_id; and all rows without doc_id.

    Rows without words are components of their own. Of rows with equal doc_id and text the smallest one stays.
    """
    classes, labels = _labelled(small_batches(docs).filter("doc_id is not null"))
    own = classes.join(labels, classes.set_id == labels.node, "left")
    alone = F.when(F.col("component").isNull(), F.col("set_check"))
    firsts = own.groupBy(F.coalesce("component", "set_id").alias("node"), alone.alias("alone")).agg(F.min(F.struct("rep", "rep_text")).alias("first"))
    kept = firsts.select(F.col("first.rep").alias("_id"), F.col("first.rep_text").alias("_text"), F.lit(True).alias("_kept"))
    wordless = ~F.coalesce("text", F.lit("")).rlike(f"[^{SPACE}]")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), wordless.alias("_alone"), row.alias("_row"))
    rows = rows.join(kept, ["_id", "_text"], "left").filter("_kept or _alone")
    one = F.row_number().over(Window.partitionBy("_id", "_text").orderBy("_row"))
    return rows.withColumn("_nth", one).filter("_nth = 1").select("_row.*").unionByName(docs.filter("doc_id is null"))


#: The same by brute force in DuckDB's SQL.
SQL = r"""
with recursive w as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as materialized (
  select distinct doc_id, g from (
    select doc_id, unnest(case when len(w) >= 5
             then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
             else [array_to_string(w, ' ')] end) as g
    from w where len(w) > 0)
), n as materialized (
  select doc_id, count(*) as n from s group by doc_id
), l as materialized (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all)
  join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)
), r as (
  select a, b from l union select r.a, l.b from r join l on r.b = l.a
)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(w.doc_id, min(r.b)) as component_id
from w left join n using (doc_id) left join r on r.a = w.doc_id group by w.doc_id, n.n
"""
