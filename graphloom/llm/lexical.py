"""Ranked lexical search over an index of clusters, exact.

Terms are 64-bit hashes (two of n differ in no bit with a chance of about n**2 / 2**65).
Documents are put in an order in which neighbours share terms by recursive graph bisection:
a set of documents is cut in two halves, and documents are swapped while that lowers the
bits that the gaps of the halves' postings take. The upper levels are fitted on a sample of
about ``SAMPLE`` documents, of each at most ``SAMPLE_TERMS`` terms; every level keeps what a
term costs on either side, and all documents of the corpus go down that tree. The
documents of a leaf are dealt into groups of bounded size, which are bisected further, down
to clusters of at most ``CLUSTER`` documents. A cluster is a row of the index: its
documents, its terms with their postings, and of every term the most that an occurrence can
give to a score. The sample decides which documents are neighbours, never a result.

A search first finds each query's clusters of the largest bounds, the sum of what its terms
can give there, over the whole index, and scores these; the k-th best score is what results
must reach. Then every task visits its clusters in falling order of their bounds, raising
that score where it finds better ones, and stops at the first bound below it, so nothing
is lost. A document's place in the order is mapped back to its id, which breaks ties.
Queries come in blocks of about ``BLOCK_TERMS`` terms, which go to all tasks.

Null texts, and texts without terms, are in no cluster and count for nothing. Every different
(item, text) is a query of its own; one without terms has no results. Null ids come after
others. Repeated rows are documents each. An empty table gives an empty result. Very long
texts are a group of their own. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import dropped, sliced, small_batches, written
from graphloom.llm.shingles import mix, runs, text_bytes, word_bounds, word_hashes

#: Documents and terms of each that the upper levels are fitted on, their levels, and terms that they know.
SAMPLE, SAMPLE_TERMS, LEVELS, KNOWN_TERMS = 4096, 512, 6, 1 << 15
#: Documents of a cluster, postings of a group, rounds of swaps at a level.
CLUSTER, GROUP_POSTINGS, SWAPS = 512, 1 << 19, 6
#: Clusters that are scored first for each query, clusters that are ordered together, terms of a block of queries.
FIRST, RUN, BLOCK_TERMS = 2, 64, 1 << 18
TOP = 10
#: Bytes between terms: all of ASCII but letters and digits.
_BETWEEN = np.zeros(256, bool)
_BETWEEN[:128] = True
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_DOC = "doc_id bigint, n bigint, leaf int, size bigint, terms binary, tfs binary"
_CLUSTER = "cluster bigint, ids array<bigint>, lengths binary, terms binary, most binary, starts binary, docs binary, tfs binary"
_HIT = "query int, doc_id bigint, score bigint"


def document_terms(texts: pa.Array):
    """(first text, lengths, owners, terms, tfs) for runs of texts: the distinct terms of each, sorted, with their counts."""
    data, offsets = text_bytes(texts)
    for at, to in runs(offsets):
        start, stop, counts = word_bounds(data, offsets[at:to], offsets[at + 1 : to + 1], _BETWEEN)
        hashes, owner = word_hashes(data[offsets[at] : offsets[to]], start, stop), np.repeat(np.arange(to - at), counts)
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))[: len(hashes)]
        first = np.flatnonzero(new)
        yield at, counts, owner[first], hashes[first], np.diff(np.append(first, len(hashes)))


# --- recursive graph bisection -----------------------------------------------


def _bits(degree: np.ndarray, n: int) -> np.ndarray:
    """What a term's postings take in a half of n documents: about log2 of the mean gap each."""
    return degree * np.log2(max(n, 1) / (degree + 1.0))


def bisected(owner: np.ndarray, term: np.ndarray, n_docs: int, n_terms: int, swaps: int = SWAPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, degrees left, degrees right): half of the documents, after swaps that lower the cost; postings are pairs (owner, term)."""
    left = np.arange(n_docs) < n_docs // 2
    nl, nr = n_docs // 2, n_docs - n_docs // 2
    for turn in range(swaps + 1):
        at = left[owner]
        dl, dr = (np.bincount(term[x], minlength=n_terms) for x in (at, ~at))
        if turn == swaps:
            break
        now = _bits(dl, nl) + _bits(dr, nr)
        right_gain = now - _bits(np.maximum(dl - 1, 0), nl) - _bits(dr + 1, nr)
        left_gain = now - _bits(dl + 1, nl) - _bits(np.maximum(dr - 1, 0), nr)
        gain = np.bincount(owner, np.where(at, right_gain[term], left_gain[term]), n_docs)
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        pairs = min(len(a), len(b))
        better = gain[a[:pairs]] + gain[b[:pairs]] > 1e-9
        if not better.any():
            break
        left[a[:pairs][better]], left[b[:pairs][better]] = False, True
    return left, dl, dr


def ordered(owner: np.ndarray, term: np.ndarray, n_docs: int, most: int, swaps: int = SWAPS) -> list[np.ndarray]:
    """The documents as neighbouring clusters of at most ``most``; postings are sorted by owner."""
    if n_docs <= most:
        return [np.arange(n_docs)]
    known, term = np.unique(term, return_inverse=True)
    left, _, _ = bisected(owner, term, n_docs, len(known), swaps)
    out = []
    for side in (left, ~left):
        docs = np.flatnonzero(side)
        number, inside = np.cumsum(side) - 1, side[owner]
        out += [docs[c] for c in ordered(number[owner[inside]], term[inside], len(docs), most, swaps)]
    return out


@dataclass(frozen=True)
class Tree:
    """Upper levels of the order: for each node, how much more each known term costs on the left than on the right."""

    terms: np.ndarray
    costs: np.ndarray
    levels: int

    def leaves(self, n_docs: int, owner: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """The leaf of every document."""
        node = np.ones(n_docs, np.int64)
        if not len(self.terms):
            return node
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        owner, at = owner[known], at[known]
        for _ in range(self.levels):
            node = 2 * node + (np.bincount(owner, self.costs[node[owner], at], n_docs) > 0)
        return node


def fitted(docs: DataFrame, sample: int = SAMPLE, levels: int = LEVELS) -> Tree:
    """The tree of a sample of the documents, bisected on the driver."""
    share = min(1.0, sample / max(1, docs.count()))

    def terms(batches):
        for batch in batches:
            for _, counts, owner, found, _ in document_terms(batch.column(0)):
                for own in np.split(found, np.searchsorted(owner, np.arange(1, len(counts)))):
                    if len(own):
                        chosen = own if len(own) <= SAMPLE_TERMS else own[np.argsort(mix(own), kind="stable")[:SAMPLE_TERMS]]
                        yield pa.RecordBatch.from_arrays([pa.array([chosen.tobytes()], pa.binary())], names=["terms"])

    rows = docs.select(F.col("text").cast("string")).filter(F.rand(17) < share).mapInArrow(terms, "terms binary").collect()
    sets = [np.frombuffer(r["terms"], np.uint64) for r in rows]
    owner, flat = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate([*sets, np.empty(0, np.uint64)])
    known, term, degree = np.unique(flat, return_inverse=True, return_counts=True)
    keep = np.sort(np.argsort(-degree, kind="stable")[:KNOWN_TERMS])
    keep = keep[degree[keep] > 1]
    place = np.full(len(known), -1)
    place[keep] = np.arange(len(keep))
    some = place[term] >= 0
    costs = np.zeros((1 << levels, len(keep)), np.float32)
    _grow(costs, 1, owner[some], place[term[some]], len(sets))
    return Tree(known[keep], costs, levels)


def _grow(costs: np.ndarray, node: int, owner: np.ndarray, term: np.ndarray, n: int) -> None:
    if node >= len(costs) or n < 2:
        return
    left, dl, dr = bisected(owner, term, n, costs.shape[1], 2 * SWAPS)
    nl, nr = int(left.sum()), int((~left).sum())
    costs[node] = (_bits(dl + 1, nl) - _bits(dl, nl)) - (_bits(dr + 1, nr) - _bits(dr, nr))
    for child, side in ((2 * node, left), (2 * node + 1, ~left)):
        number, inside = np.cumsum(side) - 1, side[owner]
        _grow(costs, child, number[owner[inside]], term[inside], int(side.sum()))


# --- the index ---------------------------------------------------------------


def _counts(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u1" if len(data) == n else "<u4").astype(np.int64)


def _as_counts(x: np.ndarray) -> bytes:
    return x.astype("<u1" if x.max(initial=0) < 256 else "<u4").tobytes()


def norm(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m: what a document's length adds to a term's count, in hundredths of a mean document."""
    if 90 * n_docs * int(lengths.max(initial=0)) < 1 << 63:
        return 10 + 90 * n_docs * lengths // n_terms
    return np.array([10 + 90 * n_docs * int(n) // n_terms for n in lengths.tolist()], np.int64)


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What tf occurrences in a document give, before the term's weight."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass(frozen=True)
class Index:
    clusters: DataFrame
    n_docs: int
    n_terms: int


def tokenized(docs: DataFrame, tree: Tree) -> DataFrame:
    """Every document that has a term: its length, its leaf, its distinct terms and their counts."""

    def read(batches):
        for batch in batches:
            for at, counts, owner, terms, tfs in document_terms(batch.column(1)):
                leaf = tree.leaves(len(counts), owner, terms)
                cuts = np.searchsorted(owner, np.arange(len(counts) + 1))
                some = np.flatnonzero(counts)
                own = [(terms[a:b].tobytes(), _as_counts(tfs[a:b])) for a, b in zip(cuts[some].tolist(), cuts[some + 1].tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(at + some)), pa.array(counts[some]), pa.array(leaf[some], pa.int32()), pa.array(np.diff(cuts)[some])]
                columns += [pa.array([x[k] for x in own], pa.binary()) for k in range(2)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _DOC.split(", ")])

    return small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(read, _DOC)


def indexed(docs: DataFrame, cluster: int = CLUSTER, group_postings: int = GROUP_POSTINGS, sample: int = SAMPLE) -> Index:
    """The index of all documents, in the shared folder."""
    read = written(tokenized(docs, fitted(docs, sample)), "lexical-terms")
    totals = read.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("n").alias("terms"), F.sum("size").alias("size")).collect()  # a row for each leaf
    n_docs, n_terms = sum(r["n"] for r in totals), sum(r["terms"] for r in totals)
    groups, deal = 0, []
    for r in sorted(totals):
        deal.append((r["leaf"], groups, own := -(-r["size"] // group_postings)))
        groups += own
    deal = read.sparkSession.createDataFrame(deal, "leaf int, first int, own int")
    chance = F.xxhash64(F.lit(5), "doc_id", "terms")
    grouped = read.join(F.broadcast(deal), "leaf").withColumn("group", F.col("first") + F.pmod(F.when(F.col("own") > 1, chance).otherwise(0), F.col("own")).cast("int"))

    def build(group: pa.Table) -> pa.Table:
        # equal rows of one group come in any order, and are equal in the index too
        lengths, size = group.column("n").to_numpy(), group.column("size").to_numpy()
        terms = np.frombuffer(b"".join(group.column("terms").to_pylist()), np.uint64)
        tfs = np.concatenate([_counts(x, n) for x, n in zip(group.column("tfs").to_pylist(), size.tolist(), strict=True)])
        owner, ids, m = np.repeat(np.arange(len(size)), size), group.column("doc_id").to_pylist(), norm(lengths, n_docs, n_terms)
        ends, known = np.cumsum(size), np.unique(terms, return_inverse=True)[1]
        number = group.column("group")[0].as_py() << 32
        out = []
        for docs in ordered(owner, known, len(size), cluster):
            mine = np.concatenate([np.arange(a, b) for a, b in zip((ends - size)[docs].tolist(), ends[docs].tolist(), strict=True)])
            place = np.repeat(np.arange(len(docs)), size[docs])
            order = np.argsort(terms[mine], kind="stable")
            sorted_terms, at, tf = terms[mine][order], place[order], tfs[mine][order]
            first = np.flatnonzero(np.append(True, sorted_terms[1:] != sorted_terms[:-1]))
            most = np.maximum.reduceat(part(tf, m[docs][at]), first)
            values = lengths[docs].astype("<i8"), sorted_terms[first], most.astype("<i4"), np.append(first, len(tf)).astype("<i4"), at.astype("<u2")
            out.append((number, [ids[d] for d in docs.tolist()], *(v.tobytes() for v in values), _as_counts(tf)))
            number += 1
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 6]
        return pa.table({c.split()[0]: pa.array(list(x), t) for c, x, t in zip(_CLUSTER.split(", "), zip(*out, strict=True), kinds, strict=True)})

    if not 0 < cluster < 1 << 16:
        raise ValueError("a cluster has 1 to 65535 documents")
    clusters = written(grouped.groupBy("group").applyInArrow(build, _CLUSTER), "lexical-index")
    dropped(read)
    return Index(clusters, n_docs, n_terms)


# --- the search --------------------------------------------------------------


class Queries:
    """A block of queries: all their terms once, and each one's places among them."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        self.sizes = np.array([len(s) for s in sets])
        self.terms, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.weights = np.zeros(len(self.terms), np.int64)

    def of(self, q: int) -> np.ndarray:
        return self.flat[self.starts[q] : self.starts[q] + self.sizes[q]]

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Where each of the block's terms is in a cluster; -1 where it isn't."""
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        return np.where(terms[at] == self.terms, at, -1)

    def bounds(self, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The most that each query can find in a cluster."""
        value = np.where(at >= 0, self.weights * most[at], 0)
        return np.add.reduceat(value[self.flat], self.starts)

    def scores(self, q: int, at: np.ndarray, row: dict, m: np.ndarray, docs: np.ndarray, tfs: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The scores of all documents of a cluster for a query."""
        mine = self.of(q)
        mine = mine[at[mine] >= 0]
        begin, n = starts[at[mine]], starts[at[mine] + 1] - starts[at[mine]]
        where = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        out = np.zeros(len(m), np.int64)
        np.add.at(out, docs[where], np.repeat(self.weights[mine], n) * part(tfs[where], m[docs[where]]))
        return out


class Best:
    """The k best documents of each query that a task has met, and the scores that others must reach."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least, self.found = k, least.copy(), [[] for _ in range(n)]

    def meet(self, q: int, scores: np.ndarray, ids: list) -> None:
        good = np.flatnonzero(scores >= max(1, self.least[q]))
        if len(good):
            mine = self.found[q] + [(-s, ids[i] is None, ids[i]) for i, s in zip(good.tolist(), scores[good].tolist(), strict=True)]
            self.found[q] = mine = sorted(mine, key=lambda x: (x[0], x[1], x[2] or 0))[: self.k]
            if len(mine) == self.k:
                self.least[q] = max(self.least[q], -mine[-1][0])

    def rows(self) -> pa.RecordBatch:
        rows = [(q, i, -s) for q, mine in enumerate(self.found) for s, _, i in mine]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["query", "doc_id", "score"])


def _opened(row: dict, n_docs: int, n_terms: int) -> tuple:
    m = norm(np.frombuffer(row["lengths"], "<i8"), n_docs, n_terms)
    starts, docs = np.frombuffer(row["starts"], "<i4").astype(np.int64), np.frombuffer(row["docs"], "<u2")
    return m, docs, _counts(row["tfs"], len(docs)), starts


def _frequencies(index: Index, queries: Queries) -> np.ndarray:
    """The number of documents of each of the block's terms."""

    def count(batches):
        total = np.zeros(len(queries.terms), np.int64)
        for batch in batches:
            for terms, starts in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                at = queries.places(np.frombuffer(terms, np.uint64))
                total += np.where(at >= 0, np.diff(np.frombuffer(starts, "<i4"))[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(len(queries.terms), np.int64)
    for r in index.clusters.select("terms", "starts").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def _first_clusters(index: Index, queries: Queries, first: int) -> DataFrame:
    """(cluster, asking): the clusters with the largest bounds of each query, and the queries they have them for."""

    def look(batches):
        best = [[] for _ in range(queries.n)]
        for batch in batches:
            for cluster, terms, most in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                bounds = queries.bounds(queries.places(np.frombuffer(terms, np.uint64)), np.frombuffer(most, "<i4").astype(np.int64))
                for q in np.flatnonzero(bounds).tolist():
                    if len(best[q]) < first or -bounds[q] < best[q][-1][0]:
                        best[q] = sorted([*best[q], (-int(bounds[q]), cluster)])[:first]
        rows = [(q, c, -b) for q, mine in enumerate(best) for b, c in mine]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["query", "cluster", "bound"])

    found = index.clusters.select("cluster", "terms", "most").mapInArrow(look, "query int, cluster bigint, bound bigint")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "cluster"))
    # at most ``first`` rows for each query of the block
    return found.withColumn("nth", nth).filter(F.col("nth") <= first).groupBy("cluster").agg(F.collect_list("query").alias("asking"))


def _least(index: Index, queries: Queries, k: int, first: int) -> np.ndarray:
    """The score that each query's results must reach: its k-th best in its first clusters, or 1."""
    n_docs, n_terms = index.n_docs, index.n_terms

    def score(batches):
        best = Best(queries.n, k, np.ones(queries.n, np.int64))
        for batch in sliced(batches, RUN):
            for row in batch.to_pylist():
                at, opened = queries.places(np.frombuffer(row["terms"], np.uint64)), _opened(row, n_docs, n_terms)
                for q in row["asking"]:
                    best.meet(q, queries.scores(q, at, row, *opened), row["ids"])
        yield best.rows()

    picked = index.clusters.join(F.broadcast(_first_clusters(index, queries, first)), "cluster").drop("most")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    least = np.ones(queries.n, np.int64)
    for r in picked.mapInArrow(score, _HIT).withColumn("nth", nth).filter(F.col("nth") == k).collect():  # a row for each query of the block
        least[r["query"]] = r["score"]
    return least


def _visited(index: Index, queries: Queries, least: np.ndarray, k: int) -> DataFrame:
    """(query, doc_id, score) of the best documents of every task."""
    n_docs, n_terms = index.n_docs, index.n_terms

    def visit(batches):
        best = Best(queries.n, k, least)
        for batch in sliced(batches, RUN):
            rows = batch.to_pylist()
            places = [queries.places(np.frombuffer(r["terms"], np.uint64)) for r in rows]
            bounds = np.stack([queries.bounds(at, np.frombuffer(r["most"], "<i4").astype(np.int64)) for at, r in zip(places, rows, strict=True)])
            opened: dict[int, tuple] = {}
            for q in np.flatnonzero((bounds >= best.least).any(axis=0)).tolist():
                for c in np.argsort(-bounds[:, q], kind="stable").tolist():
                    if bounds[c, q] < best.least[q]:
                        break
                    if c not in opened:
                        opened[c] = _opened(rows[c], n_docs, n_terms)
                    best.meet(q, queries.scores(q, places[c], rows[c], *opened[c]), rows[c]["ids"])
        yield best.rows()

    return index.clusters.mapInArrow(visit, _HIT)


def search(index: Index, items: DataFrame, k: int = TOP, first: int = FIRST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents for each (item_id, text)."""
    spark = items.sparkSession

    def terms(batches):
        for batch in batches:
            for at, counts, owner, found, _ in document_terms(batch.column(1)):
                cuts = np.searchsorted(owner, np.arange(len(counts) + 1))
                some = np.flatnonzero(np.diff(cuts))
                own = [found[cuts[d] : cuts[d + 1]].tobytes() for d in some.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + some)), pa.array(own, pa.binary())], names=["item_id", "terms"])

    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    asked = written(asked.mapInArrow(terms, "item_id bigint, terms binary"), "lexical-queries")
    blocks = -(-(asked.agg(F.sum(F.length("terms"))).first()[0] or 0) // (8 * block_terms))
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    if not index.n_docs:
        return out
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        queries = Queries([np.frombuffer(r["terms"], np.uint64) for r in rows])
        queries.weights[:] = [weight(df, index.n_docs) for df in _frequencies(index, queries).tolist()]
        found = _visited(index, queries, _least(index, queries, k, first), k)
        names = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(rows)], "query int, item_id bigint")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k).join(F.broadcast(names), "query")
        out = out.unionByName(written(ranked.select("item_id", "rank", "doc_id", "score"), "lexical-found"))
    return out


#: The same by brute force in DuckDB's SQL.
SQL = r"""
with t as (
  select row_number() over () as nr, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents where text is not null
), d as materialized (select nr, doc_id, terms, len(terms)::bigint as n from t where len(terms) > 0
), s as (select count(*)::hugeint as docs, sum(n)::hugeint as total from d
), p as materialized (select nr, term, count(*)::hugeint as tf from (select nr, unnest(terms) as term from d) group by nr, term
), w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::hugeint as weight from p, s group by term, docs
), m as (select nr, doc_id, 10 + (90 * n * docs) // total as m from d, s
), i as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark where text is not null
), r as (
  select item_id, nr, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from i join w using (term) join p using (term) join m using (nr) group by item_id, nr, doc_id
)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from r where score > 0
qualify rank <= 10
"""
