"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded; filters of several widths slide over fixed-length windows, their
outputs are max-pooled, and a softmax gives the languages. For use, embedding and
filters are folded into one table per filter position, so a filter's output is a sum
of looked-up rows. A text's log probabilities are the means over all its windows,
weighted by the bytes in them.

Training takes windows of at most ``Settings.documents`` documents with a language that
are not held out: ``Settings.least`` with the smallest hashes of each language, so that
rare ones are learned too, then those with the smallest hashes of all; of more languages
than documents each can have one, some are left out. Classes are weighed to count alike.
Null texts and texts without letters are ``und`` with score 0. Without any learning row
all texts are ``und``. Rows repeated have repeated results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import held_out, sliced, small_batches

_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter; signs like \u00b2, \u00bd or roman numerals are none."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text or ""))


@dataclass(frozen=True)
class Settings:
    """documents: most rows to train on; least: of them, those taken of each language first; windows: most windows of each; length: bytes of a
    window; embedding, widths, filters: the network's shape; epochs, batch, rate, seed: of training."""

    documents: int = 6000
    least: int = 50
    windows: int = 2
    length: int = 256
    embedding: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 12
    epochs: int = 4
    batch: int = 64
    rate: float = 4e-3
    seed: int = 7


def windows_of(data: bytes, length: int) -> np.ndarray:
    """All windows of a text, the last one filled up with spaces."""
    n = max(1, -(-len(data) // length))
    out = np.full(n * length, 32, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, length)


class Network:
    """The trained network: languages, a table (256, filters) per filter position, and the last layer."""

    def __init__(self, languages, tables, bias, out, out_bias, settings):
        self.languages, self.tables, self.bias, self.out, self.out_bias, self.settings = languages, tables, bias, out, out_bias, settings

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(windows, languages) for byte windows; works on few windows at a time to stay in cache."""
        length, step = windows.shape[1], 32
        pooled = np.empty((len(windows), sum(t[0].shape[1] for t in self.tables)), np.float32)
        for at in range(0, len(windows), step):
            b = np.ascontiguousarray(windows[at : at + step].T).astype(np.intp)  # position first: pooling is a running maximum
            column = 0
            for tables in self.tables:
                n, f = length - len(tables) + 1, tables[0].shape[1]
                total = np.take(tables[0], b[:n].ravel(), axis=0)
                for j in range(1, len(tables)):
                    total += np.take(tables[j], b[j : n + j].ravel(), axis=0)
                pooled[at : at + step, column : column + f] = total.reshape(n, -1, f).max(axis=0)
                column += f
        hidden = np.maximum(pooled + self.bias, 0)
        logits = hidden @ self.out + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def classify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        length = self.settings.length
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if known:
            data = [texts[i].encode("utf-8", "replace") for i in known]
            parts = [windows_of(d, length) for d in data]
            logs = self.log_probabilities(np.concatenate(parts))
            starts = np.cumsum([0, *map(len, parts)])[:-1]
            weight = np.concatenate([np.minimum(length, len(d) - length * np.arange(len(p))) for d, p in zip(data, parts, strict=True)])
            mean = np.add.reduceat(logs * weight[:, None], starts) / np.array([len(d) for d in data])[:, None]
            p = np.exp(mean - mean.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for i, best, value in zip(known, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                langs[i], scores[i] = self.languages[best], min(1.0, value)
        return langs, scores


def train(windows: np.ndarray, classes: np.ndarray, languages: list[str], s: Settings = Settings()) -> Network:
    """Adam on the weighted cross entropy of single windows."""
    rng = np.random.default_rng(s.seed)
    c, d, f = len(languages), s.embedding, s.filters
    p = {"e": rng.normal(0, 0.5, (256, d)), "o": rng.normal(0, 0.1, (f * len(s.widths), c)), "q": np.zeros(c)}
    for w in s.widths:
        p[f"w{w}"], p[f"b{w}"] = rng.normal(0, (w * d) ** -0.5, (w * d, f)), np.zeros(f)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    weights = (len(classes) / (c * np.maximum(1, np.bincount(classes, minlength=c))))[classes].astype(np.float32)
    step = 0
    for _ in range(s.epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), s.batch):
            rows = order[at : at + s.batch]
            b, y, n = windows[rows], classes[rows], len(rows)
            x = p["e"][b]
            pooled, chosen = [], {}
            for w in s.widths:
                patches = np.lib.stride_tricks.sliding_window_view(x, w, axis=1).transpose(0, 1, 3, 2).reshape(n, -1, w * d)
                z = patches @ p[f"w{w}"]
                best = z.argmax(axis=1)
                chosen[w] = best
                pooled.append(np.take_along_axis(z, best[:, None], axis=1)[:, 0] + p[f"b{w}"])
            pooled = np.hstack(pooled)
            hidden = np.maximum(pooled, 0)
            logits = hidden @ p["o"] + p["q"]
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            delta = e / e.sum(axis=1, keepdims=True)
            delta[np.arange(n), y] -= 1
            delta *= weights[rows][:, None] / n
            g = {"o": hidden.T @ delta, "q": delta.sum(axis=0), "e": np.zeros_like(p["e"])}
            back = (delta @ p["o"].T) * (pooled > 0)
            for k, w in enumerate(s.widths):
                part, best = back[:, k * f : (k + 1) * f], chosen[w]
                at_bytes = b[np.arange(n)[:, None, None], best[:, :, None] + np.arange(w)]  # (n, f, w)
                seen = p["e"][at_bytes].reshape(n, f, w * d)
                g[f"w{w}"] = np.einsum("nf,nfk->kf", part, seen)
                g[f"b{w}"] = part.sum(axis=0)
                to_input = (part[:, :, None] * p[f"w{w}"].T[None]).reshape(n, f, w, d)
                np.add.at(g["e"], at_bytes.ravel(), to_input.reshape(-1, d))
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= (s.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    tables = [[np.ascontiguousarray(p["e"] @ p[f"w{w}"][j * d : (j + 1) * d]) for j in range(w)] for w in s.widths]
    return Network(languages, tables, np.concatenate([p[f"b{w}"] for w in s.widths]), p["o"], p["q"], s)


def chosen(known: DataFrame, s: Settings) -> DataFrame:
    """doc_id of at most ``s.documents`` documents, at least ``s.least`` of each language as far as there are:
    those with the smallest hashes of each language first, then those of all."""
    # a language's documents are bounded in partitions of a hash before they meet in one task
    near = [F.xxhash64("doc_id"), F.col("doc_id")]
    parted = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(64))).orderBy(*near))
    learnable = known.filter(F.rlike("text", F.lit(r"\p{L}"))).select("doc_id", "lang").distinct()
    own = learnable.withColumn("_part", parted).filter(F.col("_part") <= s.least)
    own = own.withColumn("_own", F.row_number().over(Window.partitionBy("lang").orderBy(*near))).filter(F.col("_own") <= s.least)
    first = own.groupBy("doc_id").agg(F.min("_own").alias("_own"))
    rest = known.select("doc_id").distinct().orderBy(*near).limit(s.documents).withColumn("_own", F.lit(s.least + 1))
    both = first.unionByName(rest).groupBy("doc_id").agg(F.min("_own").alias("_own"))
    return both.orderBy("_own", *near).limit(s.documents).select("doc_id")


def fit(docs: DataFrame, s: Settings = Settings()) -> Network:
    """Trains on a bounded sample of the documents that are not held out."""
    known = docs.filter("doc_id is not null and lang is not null").filter(~held_out())
    few = chosen(known, s)

    def cut(batches):
        for batch in sliced(batches, 512):
            langs, windows = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letter(text):
                    own = windows_of(text.encode("utf-8", "replace"), s.length)
                    if len(own) > 1:
                        own = own[:-1]  # the last one may be mostly filling
                    for k in np.unique(np.linspace(0, len(own) - 1, s.windows).astype(int)):
                        langs.append(lang)
                        windows.append(own[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(windows, pa.binary())], names=["lang", "bytes"])

    rows = known.select("doc_id", "lang", "text").join(F.broadcast(few), "doc_id").select("lang", "text").mapInArrow(cut, "lang string, bytes binary").toArrow()
    names = rows.column("lang").to_pylist()
    languages = sorted(set(names))
    if not languages:
        return Network([], [], None, None, None, s)
    windows = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), np.uint8).reshape(-1, s.length)
    order = np.lexsort((*windows[:, :16].T, names))  # rows come in any order; training doesn't depend on it
    index = {x: k for k, x in enumerate(languages)}
    return train(windows[order], np.array([index[x] for x in names])[order], languages, s)


def identify(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, from its whole text."""

    def found(batches):
        for batch in sliced(batches, 256):
            langs, scores = network.classify(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"]
            )

    rows = small_batches(docs).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(found, "doc_id bigint, held_out boolean, lang_pred string, score double")
