"""Packing of tokenized documents into full windows, with lexical neighbours side by side.

Documents are tokenized once into a table. Document frequencies, the number of documents
and their mean length are those of the whole corpus. Documents are dealt by content: by
their strongest term under BM25, where those of a term are more than a shard's tokens by
the two strongest, and where that isn't enough (many copies) by a hash too. A task has
its documents in the order of their strongest terms, and gathers them into shards of
bounded size. A shard has an inverted index of its documents; for each seed its best
unused neighbours are looked up with all of the seed's terms, and fill the seed's window
in that order. A document that doesn't fit is cut, and what is left of it is the seed of
the next window, so windows are full. What a shard leaves over goes into the task's next
shard; the last tokens of a task are put into windows of powers of two, which need no
padding. The splits of the input don't matter to the result; a neighbour in another
shard is not found.

Neighbours with equal scores come in the order of the shard. Null texts are empty; an empty document is its end token alone. Long documents are cut
into as many windows as they need. Repeated rows are packed each. Windows of an empty
table are none. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import sliced, small_batches, written
from graphloom.llm.shingles import _BYTES, _power, mix

WINDOW = 2048
END = 1
#: Tokens that a shard holds at least before it is packed.
SHARD_TOKENS = 1 << 20
#: BM25's constants, and neighbours that are sorted at once.
K1, B, NEAREST = 1.2, 0.75, 64
#: Strongest terms of a document that place it.
PLACING_TERMS = 3
_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space to Python, not to the tokenizer
#: Characters of text that are encoded at once.
CHUNK = 1 << 20
#: Kinds of bytes: 0 white space, 1 letters (with all of the bytes beyond ASCII), 2 digits, 3 signs.
_KIND = np.full(256, 3, np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[97:123] = _KIND[65:91] = _KIND[128:] = 1
_KIND[48:58] = 2
#: Bytes whose words are one part: apostrophes, and what begins characters that aren't Latin letters.
_ODD = np.zeros(256, bool)
_ODD[[0x27, 0xC2]] = True
_ODD[0xC9:] = True
_PIECE = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
)


_TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("term", pa.int64()), ("n", pa.int64())])


class PartEncoder:
    """Token ids of whole texts, by way of remembered parts of words.

    The tokenizer lowers and composes a text, and lets no token cross white space or the
    border of letters, digits and signs. So the ids of a composed text are those of its
    lower-case parts, one after the other. Parts are found and hashed in numpy over the
    bytes of many texts, and looked up in two tables of slots; those not met before are
    encoded together by a copy of the tokenizer without its slow steps, each ending with
    the one token that carries the end-of-word mark. Words with apostrophes (contractions)
    or beyond Latin letters are one part and go through the tokenizer itself, as do whole
    texts that aren't composed or hold special strings or odd separators. Two different
    parts are taken for one with a chance of about 2**-64.
    """

    SLOTS = 1 << 20
    #: Remembered ids at most; then all are forgotten.
    LIMIT = 4_000_000

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.path = path
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        byte_level = described["pre_tokenizer"]["pretokenizers"][-1]
        described["normalizer"] = None
        described["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, byte_level]}
        self.light = Tokenizer.from_str(json.dumps(described))
        vocabulary = described["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    @cached_property
    def codec(self):
        """The tokenizer itself, loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _forget(self) -> None:
        self.keys = np.zeros((2, self.SLOTS), np.uint64)
        self.where = np.zeros((2, self.SLOTS), np.int64)
        self.length = np.zeros((2, self.SLOTS), np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learned(self, parts: list[str], opaque: list[bool]) -> list[np.ndarray]:
        """The ids of new parts."""
        out: list = [None] * len(parts)
        plain = [k for k, o in enumerate(opaque) if not o]
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            ids = np.array(self.light.encode_batch_fast([" ".join([parts[k] for k in some])], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some) or stops[-1] != len(ids):
                raise ValueError("the tokenizer doesn't end each word with its mark")
            last = 0
            for k, stop in zip(some, stops.tolist(), strict=True):
                out[k] = ids[last:stop]
                last = stop
        other = [k for k, o in enumerate(opaque) if o]
        for at in range(0, len(other), 500):
            some = other[at : at + 500]
            for k, e in zip(some, self.codec.encode_batch_fast([parts[k] for k in some], add_special_tokens=False), strict=True):
                out[k] = np.array(e.ids, np.uint32)
        return out

    def _remember(self, hashes: np.ndarray, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of new parts are kept, and how many they are."""
        lengths = np.array([len(f) for f in found], np.int64)
        begins = self.used + np.cumsum(lengths) - lengths
        need = self.used + int(lengths.sum())
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(need, 2 * len(self.ids)) - self.used, np.uint32)])
        self.ids[self.used : need] = np.concatenate(found)
        self.used = need
        first, second = (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64), (hashes >> np.uint64(44)).astype(np.int64)
        free = self.keys[0, first] == 0
        for table, slot, which in ((0, first, free), (1, second, ~free)):
            self.keys[table, slot[which]] = hashes[which]
            # of several parts for one slot, the one whose hash is in it has to be the one described
            mine = which & (self.keys[table, slot] == hashes)
            self.where[table, slot[mine]] = begins[mine]
            self.length[table, slot[mine]] = lengths[mine]
        return begins, lengths

    def _composed(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts in lower case that need no way around."""
        data = [t.encode("utf-8", "replace") for t in texts]
        joined = b"\n".join([*data, b""])
        raw = np.frombuffer(joined, np.uint8)
        kind = _KIND[raw]
        word = kind > 0
        start = word.copy()
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        odd = _ODD[raw]
        odd[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
        odd_at = np.flatnonzero(odd)
        opens = None
        if len(odd_at):
            first = word.copy()
            first[1:] &= ~word[:-1]
            number = np.cumsum(first)  # of each byte's word, from 1
            whole = np.zeros(int(number[-1]) + 1, bool)
            whole[number[odd_at]] = True
            inside = whole[number] & word
            start &= ~inside | first
            opens = inside
        stop = np.empty(len(raw), bool)
        stop[:-1] = word[:-1] & (~word[1:] | start[1:])
        stop[-1] = word[-1]
        starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
        if not len(starts):
            return [np.empty(0, np.uint32)] * len(texts)
        power, inverse = _power(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * power[: len(raw)], out=sums[1:])
        hashes = mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64)) | np.uint64(1 << 63)
        slot = (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)
        where, length = self.where[0, slot], self.length[0, slot]
        unknown = np.flatnonzero(self.keys[0, slot] != hashes)
        slot = (hashes[unknown] >> np.uint64(44)).astype(np.int64)
        where[unknown], length[unknown] = self.where[1, slot], self.length[1, slot]
        unknown = unknown[self.keys[1, slot] != hashes[unknown]]
        if len(unknown):
            new, example, back = np.unique(hashes[unknown], return_index=True, return_inverse=True)
            at = unknown[example]
            parts = [joined[a:b].decode() for a, b in zip(starts[at].tolist(), stops[at].tolist(), strict=True)]
            opaque = opens[starts[at]].tolist() if opens is not None else [False] * len(at)
            begins, lengths = self._remember(new, self._learned(parts, opaque))
            where[unknown], length[unknown] = begins[back], lengths[back]
        ends = np.cumsum(length.astype(np.int64))
        tokens = self.ids[np.repeat(where - (ends - length), length) + np.arange(ends[-1])]
        bounds = np.cumsum([len(d) + 1 for d in data])[:-1]
        return np.split(tokens, np.append(0, ends)[np.searchsorted(starts, bounds)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.used > self.LIMIT:
            self._forget()
        out: list[list[np.ndarray]] = [[] for _ in texts]
        whose, waiting, size = [], [], 0

        def done():
            for k, ids in zip(whose, self._composed(waiting), strict=True):
                out[k].append(ids)

        for k, t in enumerate(texts):
            low = t.lower()
            if "<|" in t or "\u03a3" in t or _SEPARATORS.search(t) or not (t.isascii() or is_normalized("NFC", t) and is_normalized("NFC", low)):
                out[k].append(np.array(self.codec.encode(t, add_special_tokens=False).ids, np.uint32))
                continue
            at = 0
            while at < len(low):  # long texts are cut at spaces, which no token crosses
                to = len(low) if len(low) - at <= CHUNK else (low.find(" ", at + CHUNK) + 1 or len(low))
                whose.append(k)
                waiting.append(low[at:to])
                size += to - at
                at = to
                if size >= CHUNK:
                    done()
                    whose, waiting, size = [], [], 0
        if waiting:
            done()
        return [np.concatenate(x) if len(x) > 1 else x[0] if x else np.empty(0, np.uint32) for x in out]


def term_counts(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, number of times) of each document's terms, by document, then term: one sort for all."""
    if not documents:
        return (np.empty(0, np.int64),) * 3
    ids = np.concatenate(documents)
    width = int(ids.max()) + 1 if len(ids) else 1
    kind = np.uint32 if len(documents) * width < 1 << 32 else np.uint64
    key = np.repeat(np.arange(len(documents), dtype=kind) * kind(width), [len(d) for d in documents]) + ids.astype(kind)
    key.sort()
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    doc, term = np.divmod(key[at], kind(width))
    return doc.astype(np.int64), term.astype(np.int64), np.diff(np.append(at, len(key)))


@dataclass(frozen=True)
class Statistics:
    """What BM25 knows of a corpus: its documents, their mean length, and how many have each term."""

    n: int
    mean: float
    df: np.ndarray

    @classmethod
    def of(cls, documents: list[np.ndarray]) -> Statistics:
        return cls(len(documents), float(np.mean([len(d) for d in documents])), np.bincount(term_counts(documents)[1]))

    @cached_property
    def idf(self) -> np.ndarray:
        idf = np.log1p((self.n - self.df + 0.5) / (self.df + 0.5))
        idf[self.df < 2] = 0  # leads to no other document
        return idf

    def weights(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(1.0, self.mean)))

    def strongest(self, documents: list[np.ndarray], count: int = PLACING_TERMS) -> np.ndarray:
        """A row for each document: the terms with the highest weights, the lower of equals first; -1 for missing ones."""
        found = np.full((len(documents), count), -1, np.int64)
        lengths = np.array([len(d) for d in documents], np.int64)
        doc, term, tf = term_counts(documents)
        weight = self.weights(term, tf, lengths[doc])
        has = np.flatnonzero(np.bincount(doc, minlength=len(documents)))
        starts = np.searchsorted(doc, has)
        for k in range(count if len(has) else 0):
            best = np.zeros(len(documents))
            best[has] = np.maximum.reduceat(weight, starts)
            at = np.flatnonzero((weight == best[doc]) & (weight > 0))
            own, first = np.unique(doc[at], return_index=True)
            found[own, k] = term[at[first]]
            weight[at[first]] = 0
        return found


class Index:
    """A BM25 inverted index of a shard's documents, with the corpus's statistics (the shard's own by default).

    The terms that most documents have are kept as a dense table, as a seed's sum over
    them is then one product; the others are posting lists.
    """

    #: Numbers in the dense table at most, and the share of documents that have its terms at least.
    DENSE, COMMON = 1 << 22, 0.1

    def __init__(self, documents: list[np.ndarray], statistics: Statistics | None = None):
        self.n = n = len(documents)
        statistics = statistics or Statistics.of(documents)
        lengths = np.array([len(d) for d in documents], np.float64)
        doc, term, tf = term_counts(documents)
        weight = statistics.weights(term, tf, lengths[doc])
        telling = weight > 0
        doc, term, weight = doc[telling], term[telling], weight[telling]
        df = np.bincount(term)
        most = np.argsort(-df, kind="stable")[: self.DENSE // max(1, n)]
        most = most[df[most] > self.COMMON * n]
        place = np.full(len(df), -1)
        place[most] = np.arange(len(most))
        dense = place[term]
        common = dense >= 0
        self.table = np.zeros((n, len(most)))
        self.table[doc[common], dense[common]] = weight[common]
        doc, term, weight = doc[~common], term[~common], weight[~common]
        order = np.argsort(term.astype(np.uint16) if len(df) <= 1 << 16 else term, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        self.df = np.bincount(term, minlength=len(df))
        self.begin = np.cumsum(self.df) - self.df
        self.terms, self.of_doc = term, np.searchsorted(doc, np.arange(n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """The sum of the weights that each document has for the seed's terms."""
        terms = self.terms[self.of_doc[seed] : self.of_doc[seed + 1]]
        sizes = self.df[terms]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begin[terms] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.docs[at], self.weights[at], self.n) + self.table @ (self.table[seed] > 0)

    def neighbours(self, seed: int, used: np.ndarray):
        """Unused documents that share a term with the seed, best first, the earlier of equals first."""
        scores = self.scores(seed)
        scores[used] = 0
        left = np.flatnonzero(scores)
        while len(left):  # few are asked for, so the best are sorted first
            least = np.partition(scores[left], len(left) - NEAREST)[len(left) - NEAREST] if len(left) > NEAREST else 0.0
            some = left[scores[left] >= least]
            yield from some[np.argsort(-scores[some], kind="stable")].tolist()
            left = left[scores[left] < least]


def pack_shard(documents: list[np.ndarray], window: int = WINDOW, statistics: Statistics | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length); all but the last one are full."""
    if not documents:
        return []
    index, n = Index(documents, statistics), len(documents)
    used = np.zeros(n, bool)
    sequences, following, rest = [], 0, None
    while True:
        if rest is None:
            while following < n and used[following]:
                following += 1
            if following == n:
                return sequences
            rest = (following, 0)
            used[following] = True
        pieces, room = [], window
        ranking = None
        while rest is not None:
            doc, start = rest
            length = min(room, len(documents[doc]) - start)
            pieces.append((doc, start, length))
            room -= length
            rest = (doc, start + length) if start + length < len(documents[doc]) else None
            if rest is not None or not room:
                break
            if ranking is None:
                ranking = index.neighbours(pieces[0][0], used)
            nxt = next(ranking, None)
            if nxt is None:
                while following < n and used[following]:
                    following += 1
                nxt = following if following < n else None
            if nxt is not None:
                used[nxt] = True
                rest = (nxt, 0)
        sequences.append(pieces)


def id_type(tokenizer: str | None = None) -> str:
    """The type that ids are moved as: as narrow as the vocabulary allows."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer or public_tokenizers.path("word_bpe_49k.json")).get_vocab_size() <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, tokenizer: str | None = None, end: int = END, kind: str = "<u4") -> DataFrame:
    """(doc_id, ids, term, n): a row for each document, its ids of type ``kind``, the end token last;
    then rows without ids, with each task's number of documents of a term, -2 for all documents, -1 for all tokens."""

    def encoded(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import public_tokenizers

        encoder = PartEncoder(tokenizer or public_tokenizers.path("word_bpe_49k.json"))
        df, n, total = np.zeros(1, np.int64), 0, 0
        for batch in sliced(batches, 256):
            ids = [np.append(i, np.uint32(end)).astype(kind) for i in encoder.encode([t or "" for t in batch.column(1).to_pylist()])]
            n, total = n + len(ids), total + sum(map(len, ids))
            own = np.bincount(term_counts(ids)[1], minlength=len(df))
            own[: len(df)] += df
            df = own
            none = [None] * len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array(none, pa.int64()), pa.array(none, pa.int64())], schema=_TOKENS)
        if n:
            at = np.flatnonzero(df)
            none = [None] * (len(at) + 2)
            counts = pa.array([-2, -1, *at.tolist()], pa.int64()), pa.array([n, total, *df[at].tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(none, pa.int64()), pa.array(none, pa.binary()), *counts], schema=_TOKENS)

    return small_batches(docs).select("doc_id", "text").mapInArrow(encoded, "doc_id bigint, ids binary, term bigint, n bigint")


def corpus_statistics(tokens: DataFrame) -> Statistics:
    """The statistics of all documents; a row for each token of the vocabulary reaches the driver."""
    found = {r["term"]: r["n"] for r in tokens.filter("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, total = found.pop(-2, 0), found.pop(-1, 0)
    df = np.zeros(max(found, default=0) + 1, np.int64)
    df[list(found.keys())] = list(found.values())
    return Statistics(n, total / n if n else 0.0, df)


def dealt(tokens: DataFrame, statistics: Statistics, shard_tokens: int = SHARD_TOKENS, kind: str = "<u4") -> DataFrame:
    """(doc_id, ids) dealt by content; the rows of a partition are in the order of their strongest terms."""
    names = [f"k{k}" for k in range(PLACING_TERMS)]

    def placed(batches):
        for batch in sliced(batches, 256):
            keys = statistics.strongest([np.frombuffer(i, kind) for i in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, keys.T)], names=["doc_id", "ids", *names])

    documents = tokens.filter("term is null").select("doc_id", "ids")
    keyed = documents.mapInArrow(placed, f"doc_id bigint, ids binary, {', '.join(f'{k} bigint' for k in names)}")
    sizes = written(keyed.groupBy("k0", "k1").agg((F.sum(F.length("ids")) / np.dtype(kind).itemsize).cast("bigint").alias("tokens")), "pack-sizes")
    # at most as many rows as the corpus has shards
    hot = F.broadcast(sizes.groupBy("k0").agg(F.sum("tokens").alias("of_term")).filter(F.col("of_term") > shard_tokens))
    copies = F.broadcast(sizes.filter(F.col("tokens") > shard_tokens).withColumnRenamed("tokens", "of_pair"))
    salt = F.pmod(F.xxhash64("doc_id", "ids"), F.coalesce(F.ceil(F.col("of_pair") / shard_tokens), F.lit(1)))
    salt = F.when(F.col("of_term").isNull(), F.lit(0)).otherwise(salt)
    return (
        keyed.join(hot, "k0", "left")
        .join(copies, ["k0", "k1"], "left")
        .withColumn("second", F.when(F.col("of_term").isNotNull(), F.col("k1")))
        .withColumn("salt", salt)
        .repartition("k0", "second", "salt")
        .sortWithinPartitions("k0", "second", "salt", *names[1:], "doc_id", "ids")
        .select("doc_id", "ids")
    )


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row for each piece: doc_id, start in its document's ids, doc_tokens, sequence_id,
    offset in the sequence, and ids (little-endian 32-bit)."""
    kind = id_type(tokenizer)
    tokens = written(tokenized(docs, tokenizer, end, kind), "pack-tokens")
    statistics = corpus_statistics(tokens)

    def packed(batches):
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 33
        held: list[tuple] = []  # (doc_id, tokens before, tokens of the document, ids)

        def rows(sequences):
            nonlocal sequence
            out = []
            for pieces in sequences:
                offset = 0
                for k, start, length in pieces:
                    doc_id, before, total, ids = held[k]
                    out.append((doc_id, before + start, total, sequence, offset, ids[start : start + length].astype("<u4").tobytes()))
                    offset += length
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, _PIECE.types, strict=True)], schema=_PIECE)

        size = 0
        for batch in sliced(batches, 256):
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(data, kind)
                held.append((doc_id, 0, len(ids), ids))
                size += len(ids)
            if size >= shard_tokens:
                sequences = pack_shard([h[3] for h in held], window, statistics)
                last = sequences.pop() if sum(p[2] for p in sequences[-1]) < window else []
                yield rows(sequences)
                held = [(held[k][0], held[k][1] + start, held[k][2], held[k][3][start : start + length]) for k, start, length in last]
                size = sum(len(h[3]) for h in held)
        if held:
            sequences = pack_shard([h[3] for h in held], window, statistics)
            left = sum(p[2] for p in sequences[-1])
            if left < window:
                sequences += halved(sequences.pop(), left)
            yield rows(sequences)

    columns = "doc_id bigint, start bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    return dealt(tokens, statistics, shard_tokens, kind).mapInArrow(packed, columns)


def halved(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """The pieces cut into sequences whose lengths are the powers of two that make up the total."""
    out, todo = [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        room = total & (1 << bit)
        own = []
        while room:
            k, start, length = todo.pop()
            take = min(room, length)
            own.append((k, start, take))
            room -= take
            if take < length:
                todo.append((k, start + take, length - take))
        if own:
            out.append(own)
    return out


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with length and checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", (F.length("ids") / 4).cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
