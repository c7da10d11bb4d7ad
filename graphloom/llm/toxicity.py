"""Toxicity by a learned lexicon, matched with edits, and weighed in context.

Learning: words and word beginnings that occur in toxic documents far more often than
in others are the lexicon. Its trie is intersected with Levenshtein automata: a state
is a set of (trie node, edits spent), made when first met, so a word is matched against
all terms within their edit budgets in one pass that ends as soon as no term is left.
The weight of a term at a number of edits is its log odds on the learning rows.

Words are also matched with an edit of the first letter, for terms of ``FIRST_LETTERS``
letters or more, and runs of words with single signs between them ("st*pid", "id_iot")
are matched joined where no word of theirs matches alone. Both have weights of their own,
learned, or a share of the plain match's where no learning row shows them.

Scoring: each match counts with its weight, times a factor from the words around it
(less inside quotation marks or after a reporting word, more beside an address); the
score is the logistic function of the sum and of an offset fitted on the learning rows.

Labels are learned from at most ``Settings.sample`` rows of either class, those with
the smallest hashes; scoring takes every word of every text. Null and empty texts have
the score of a text without matches. Rows repeated have repeated results; a doc_id with
several labels counts as toxic if one of them says so. An empty label table gives an
empty lexicon and one score for all. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import held_out, sliced, small_batches


@dataclass(frozen=True)
class Settings:
    """sample: most labelled rows of either class to learn from; support, rate: least toxic
    rows with a term, as a number and a share (copies of one text alone make no term);
    odds: least ratio of a term's rates; stems: lengths of word beginnings; window: words on each side that make the context."""

    sample: int = 4000
    support: int = 4
    rate: float = 0.02
    odds: float = 6.0
    stems: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    window: int = 6


#: Words that report speech, words that address someone, and quotation marks.
REPORTING = frozenset("said says quote quoted quoting called word term dit disait appelle mot sagte sagt zitat wort dijo dice cita palabra".split())
ADDRESS = frozenset("you your youre tu toi vous ton du dich ihr dein eres usted ustedes".split())
QUOTES = "\"“”«»„"
QUOTED, ADDRESSED = 0.4, 1.3

#: What is added to the edits of a match whose first letter is edited, and of one across signs;
#: the share of the plain weight for those that learning doesn't show.
FIRST, SIGNS, UNSEEN = 10, 20, 0.75
#: Least letters of a term whose first letter may be edited.
FIRST_LETTERS = 5

_WORD = re.compile(r"[^\W_]+")


def budget(term: str, stem: bool) -> int:
    """The edits that a term may have."""
    return (1 if len(term) >= 6 else 0) if stem else (2 if len(term) >= 9 else 1 if len(term) >= 4 else 0)


class Lexicon:
    """A trie of terms and the automaton of all words near them.

    ``find(word)`` gives (term index, edits) of the nearest term, the first of equals, or
    None. A stem also matches longer words. A term's first letter is edited only with
    ``first``, and not in short terms, so that short words don't turn into others; the
    edits of such a match have ``FIRST`` added, and it comes after all others.
    """

    def __init__(self, terms: list[tuple[str, bool]], first: bool = False):
        self.terms, self.first = terms, first
        self.longest = max((len(t) for t, _ in terms), default=0)
        self.most_first = [0]  # as ``most``, of terms whose first letter may be edited
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most = [0]  # the largest budget below each node
        for k, (term, stem) in enumerate(terms):
            node, allowed = 0, budget(term, stem)
            self.most[0] = max(self.most[0], allowed)
            edited = allowed if first and len(term) >= FIRST_LETTERS else 0
            self.most_first[0] = max(self.most_first[0], edited)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.most.append(0)
                    self.most_first.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], allowed)
                self.most_first[node] = max(self.most_first[node], edited)
            self.ends[node].append(k)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.stems: list[tuple[int, int] | None] = []
        self.dead = self._state(frozenset())
        self.start = self._state(frozenset({(0, 0)}))
        self.known: dict[str, tuple[int, int] | None] = {}

    def _within(self, node: int, edits: int) -> bool:
        """Whether a term below the node allows the edits."""
        return edits % FIRST <= self.most_first[node] if edits >= FIRST else edits <= self.most[node]

    def _spent(self, node: int, edits: int) -> int:
        """The edits after one more at a node; at the root it is one of the first letter."""
        return edits + 1 + (FIRST if not node and edits < FIRST else 0)

    def _ends(self, node: int, edits: int) -> list[int]:
        return [k for k in self.ends[node] if edits % FIRST <= budget(*self.terms[k]) and (edits < FIRST or len(self.terms[k][0]) >= FIRST_LETTERS)]

    def _state(self, found) -> int:
        closed, todo = {}, sorted(found, key=lambda x: x[1])
        while todo:  # a letter of the term that the word lacks costs an edit
            node, edits = todo.pop()
            if closed.get((node, edits >= FIRST), 99) <= edits:
                continue
            closed[node, edits >= FIRST] = edits
            spent = self._spent(node, edits)
            if node or self.first:
                todo += [(child, spent) for child in self.children[node].values() if self._within(child, spent)]
        key = frozenset((node, edits) for (node, _), edits in closed.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(e, k) for node, e in key for k in self._ends(node, e)]
            self.accepts.append(min(ends)[::-1] if ends else None)
            stems = [(e, k) for e, k in ends if self.terms[k][1]]
            self.stems.append(min(stems)[::-1] if stems else None)
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        found = set()
        for node, edits in self.sets[state]:
            spent = self._spent(node, edits)
            for letter, child in self.children[node].items():
                cost = edits if letter == c else spent
                if self._within(child, cost) and (node or letter == c or self.first):
                    found.add((child, cost))
            if (node or self.first) and self._within(node, spent):
                found.add((node, spent))
        return self._state(found)

    def find(self, word: str) -> tuple[int, int] | None:
        state, best = self.start, None
        for c in word:
            nxt = self.moves[state].get(c)
            if nxt is None:
                nxt = self.moves[state][c] = self._move(state, c)
                if len(self.sets) > 200_000:  # bounds memory; states are made again as met
                    self.__init__(self.terms, self.first)
                    return self.find(word)
            state = nxt
            if state == self.dead:
                return best
            stem = self.stems[state]
            if stem and (best is None or stem[1] < best[1]):
                best = stem
        end = self.accepts[state]
        return end if end and (best is None or end[1] < best[1]) else best

    def hits(self, words: set[str]) -> dict[str, tuple[int, int]]:
        """The words near a term; words are looked up once and remembered, within a bound."""
        known, out = self.known, {}
        if len(known) > 100_000:
            known.clear()
        for w in words:
            try:
                m = known[w]
            except KeyError:
                m = known[w] = self.find(w)
            if m:
                out[w] = m
        return out

    def matches(self, low: str, counts=None) -> tuple[list[tuple[str, int, int]], dict[str, tuple[int, int]]]:
        """The spans of a text's words, runs of words that match joined as one, and the
        match of each word or run for which ``counts`` holds."""
        hits = {w: m for w, m in self.hits(set(_WORD.findall(low))).items() if counts is None or counts(m)}
        spans = [(m[0], m.start(), m.end()) for m in _WORD.finditer(low)]
        runs: dict[int, list[tuple[int, str]]] = {}  # at each word, where runs end and what they are joined
        for i in range(len(spans) - 1):
            joined = spans[i][0]
            for j in range(i + 1, len(spans)):
                between = low[spans[j - 1][2] : spans[j][1]]
                joined += spans[j][0]
                if len(between) != 1 or between.isspace() or len(joined) > self.longest + 2 or spans[j][0] in hits or spans[i][0] in hits:
                    break
                runs.setdefault(i, []).append((j, joined))
        if not runs:
            return spans, hits
        near = self.hits({joined for own in runs.values() for _, joined in own})
        out, i = [], 0
        while i < len(spans):
            found = [((k, e + SIGNS), j) for j, joined in runs.get(i, ()) if joined in near for k, e in [near[joined]] if counts is None or counts((k, e + SIGNS))]
            if found:
                match, j = min(found, key=lambda x: (x[0][1], x[1]))
                run = low[spans[i][1] : spans[j][2]]
                hits[run] = match
                out.append((run, spans[i][1], spans[j][2]))
                i = j + 1
            else:
                out.append(spans[i])
                i += 1
        return out, hits


@dataclass
class Model:
    terms: list[tuple[str, bool]] = field(default_factory=list)
    weights: dict[tuple[int, int], float] = field(default_factory=dict)
    offset: float = 2.0
    window: int = 6

    def weight(self, match: tuple[int, int]) -> float:
        k, e = match
        if match in self.weights or e < FIRST:
            return self.weights.get(match, 0.0)
        return UNSEEN * self.weight((k, e - SIGNS if e >= SIGNS else e - FIRST))

    def evidence(self, lexicon: Lexicon, text: str) -> float:
        """The sum over matches of weight times context factor."""
        low = text.lower()
        spans, matches = lexicon.matches(low, self.weight)
        hits = {w: self.weight(m) for w, m in matches.items()}
        if not hits:
            return 0.0
        total = 0.0
        for i, (w, start, end) in enumerate(spans):
            if w in hits:
                before, after = spans[max(0, i - self.window) : i], spans[i + 1 : i + 1 + self.window]
                left = low[before[0][1] if before else start : start]
                right = low[end : after[-1][2] if after else end]
                factor = 1.0
                if (sum(map(left.count, QUOTES)) % 2 and any(q in right for q in QUOTES)) or any(x[0] in REPORTING for x in before[-3:]):
                    factor *= QUOTED
                if any(x[0] in ADDRESS for x in (*before, *after)):
                    factor *= ADDRESSED
                total += factor * hits[w]
        return total

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(min(50.0, self.offset - evidence)))


def _counts(sample: DataFrame, made, name: str) -> DataFrame:
    """Sums over rows (label, text) of what ``made`` finds in a text: name, toxic, clean rows."""

    def count(batches):
        for batch in sliced(batches, 512):
            found = {0: Counter(), 1: Counter()}
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[label].update(made(text or ""))
            keys = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([found[c][k] for k in keys], pa.int64()) for c in (1, 0))], names=[name, "toxic", "clean"])

    parts = sample.select("label", "text").mapInArrow(count, f"{name} string, toxic bigint, clean bigint")
    return parts.groupBy(name).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learning_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(label, text) of at most ``sample`` rows of either class, none of them held out."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = known.filter("label = 1").orderBy(*order).limit(sample).unionByName(known.filter("label = 0").orderBy(*order).limit(sample))
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select(F.col("label").cast("int").alias("label"), "text")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns the lexicon, its weights and the offset. Only bounded tables of terms reach the driver."""
    sample = learning_rows(docs, labels, settings.sample).persist()
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    model = Model(window=settings.window)
    if not n_toxic or not n_clean:
        return model
    stems = settings.stems

    def features(text):
        words = set(_WORD.findall(text.lower()))
        return {f"w:{w}" for w in words if len(w) > 2} | {f"s:{w[:n]}" for w in words for n in stems if len(w) > n}

    odds = (F.col("toxic") / n_toxic) / ((F.col("clean") + 0.5) / n_clean)
    counted = _counts(sample, features, "term").filter((F.col("toxic") >= max(settings.support, settings.rate * n_toxic)) & (odds >= settings.odds))
    # a term is in so many of the sampled rows that there are at most (words of a row) / rate of them
    rows = counted.collect()
    model.terms = _chosen({r["term"]: (r["toxic"], r["toxic"] * math.log(r["toxic"] / n_toxic / ((r["clean"] + 0.5) / n_clean))) for r in rows})
    lexicon = Lexicon(model.terms, first=True)
    matched = _counts(sample, lambda text: {f"{k} {e}" for k, e in lexicon.matches(text.lower())[1].values()}, "match").collect()
    for r in matched:
        k, e = map(int, r["match"].split())
        weight = math.log(((r["toxic"] + 0.5) / (n_toxic + 1)) / ((r["clean"] + 0.5) / (n_clean + 1)))
        if weight > 1.5 or e >= FIRST:  # shown to tell little is not the same as not shown
            model.weights[k, e] = weight if weight > 1.5 else 0.0
    for k, (term, stem) in enumerate(model.terms):  # edits that no learning row shows
        for e in range(1, budget(term, stem) + 1):
            if (k, e) not in model.weights and not any(r["match"] == f"{k} {e}" for r in matched):
                model.weights[k, e] = 0.75 * model.weights.get((k, e - 1), 0.0)
    model.weights = {m: w for m, w in model.weights.items() if w > 0 or m[1] >= FIRST}

    def found(text):
        return [f"{round(2 * model.evidence(lexicon, text))}"]

    by_evidence = sorted((int(r["evidence"]) / 2, r["toxic"], r["clean"]) for r in _counts(sample, found, "evidence").collect())
    best = (-1.0, 2.0)
    for i in range(1, len(by_evidence)):
        toxic, clean = (sum(r[c] for r in by_evidence[i:]) for c in (1, 2))
        # rates, as the classes are sampled apart; clean rows are many times as many
        value = 2 * toxic / (toxic + n_toxic + 8 * clean * n_toxic / n_clean)
        best = max(best, (value, (by_evidence[i - 1][0] + by_evidence[i][0]) / 2))
    model.offset = best[1]
    sample.unpersist()
    return model


def _chosen(found: dict[str, tuple[int, float]]) -> list[tuple[str, bool]]:
    """Whole words and stems, by falling gain; a term that shares rows with a better one,
    as one is the beginning of the other, is left out. A word goes before its own stems."""
    kept: list[tuple[str, bool]] = []
    words = {t[2:]: n for t, (n, _) in found.items() if t[0] == "w"}
    gains = []
    for t, (n, gain) in found.items():
        alone = t[0] == "s" and any(w.startswith(t[2:]) and m >= 0.8 * n for w, m in words.items())
        if not alone:
            gains.append((-gain, t[2:], t[0] == "s"))
    for _, term, stem in sorted(gains):
        if not any((stem or k_stem) and (term.startswith(k) if k_stem else False) or stem and k.startswith(term) for k, k_stem in kept):
            kept.append((term, stem))
    return sorted(kept)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def scored(batches):
        lexicon = Lexicon(model.terms, first=True)
        for batch in sliced(batches, 1024):
            found = [model.score(model.evidence(lexicon, t or "")) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array([int(x >= 0.5) for x in found], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = small_batches(docs).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(scored, "doc_id bigint, held_out boolean, score double, predicted int")
