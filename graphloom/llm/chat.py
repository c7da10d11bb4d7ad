"""Chat formatting with token masks aligned by offsets.

A conversation is rendered whole by a template that marks each turn; control strings
inside roles and texts are escaped so that the rendering can be read back. It is
encoded once, with offsets, and the sorted spans of the assistant's texts are
intersected with the sorted token spans by binary search. A mask holds the character
ranges that tokens and texts share, so a token that straddles a mark and a text counts
for the text alone.

Rows of a conversation are ordered by turn, then role, then text; repeated rows are
repeated turns. Null texts and roles are empty. A conversation is one row of the
output, so it is gathered in one task; an empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import sliced

#: The template's control strings, and some that readers of other templates obey.
OPEN, CLOSE, HEAD_END = "<s>[", "</s>\n", "]\n"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ESCAPE = "\\"

_RISKY = re.compile("|".join(map(re.escape, (ESCAPE, *CONTROL))))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<s>\[((?:[^\\\]]|\\.)*)\]\n(.*?)</s>\n", re.DOTALL)


_FORMATTED = pa.schema(
    [("conv_id", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int32())), ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
)
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def escaped(text: str) -> str:
    """``text`` without control strings: each loses its form to a mark after its first character."""
    return _RISKY.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescaped(text: str) -> str:
    """The text that ``escaped`` was given."""
    return _ESCAPED.sub(r"\1", text)


def rendered(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The formatted conversation, and (start, end, turn) of each turn's escaped text."""
    parts, spans, at = [], [], 0
    for k, (role, text) in enumerate(turns):
        head = OPEN + escaped(role).replace("]", ESCAPE + "]") + HEAD_END
        body = escaped(text)
        spans.append((at + len(head), at + len(head) + len(body), k))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescaped(m[1]), unescaped(m[2])) for m in _TURN.finditer(formatted)]


def masked_ranges(tokens: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """For each span, the ranges of characters that it shares with tokens.

    Tokens are sorted by start; several may cover one character (parts of its bytes),
    so ends are taken as running maxima, and each character is counted once.
    """
    starts = [a for a, _ in tokens]
    ends = list(accumulate((b for _, b in tokens), max))
    out = []
    for a, b in spans:
        own, at = [], a
        for k in range(bisect_right(ends, a), bisect_left(starts, b)):
            lo, hi = max(at, starts[k]), min(b, tokens[k][1])
            if lo < hi:
                if own and own[-1][1] == lo:
                    own[-1] = (own[-1][0], hi)
                else:
                    own.append((lo, hi))
                at = hi
        out.append(own)
    return out


def format_conversations(conversations: DataFrame, tokenizer: str | None = None, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, ids, loss_mask (0/1 per token),
    loss_spans (character ranges [start, end) under the mask, by turn in order)."""

    def encode(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import public_tokenizers
        from tokenizers import Tokenizer

        codec = Tokenizer.from_file(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
        codec.encode_special_tokens = True  # the texts' own special strings are ordinary text
        for batch in sliced(batches, 128):
            conv_ids, gathered = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            made = [rendered([(t["role"], t["text"]) for t in turns]) for turns in gathered]
            encoded = codec.encode_batch([m[0] for m in made], add_special_tokens=False)
            texts, ids, masks, ranges = [], [], [], []
            for turns, (formatted, spans), code in zip(gathered, made, encoded, strict=True):
                loss = masked_ranges(code.offsets, [(a, b) for a, b, k in spans if turns[k]["role"] == trained_role])
                flat = [r for own in loss for r in own]
                begins = [a for a, _ in flat]
                mask = [int(bool(flat) and (k := bisect_left(begins, b)) > 0 and flat[k - 1][1] > a) for a, b in code.offsets]
                texts.append(formatted)
                ids.append(code.ids)
                masks.append(mask)
                ranges.append([{"start": a, "end": b} for a, b in flat])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip((conv_ids, texts, ids, masks, ranges), _FORMATTED.types, strict=True)], schema=_FORMATTED
            )

    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return gathered.mapInArrow(
        encode, "conv_id bigint, formatted string, ids array<int>, loss_mask array<int>, loss_spans array<struct<start:int,end:int>>"
    )


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of what reads back from the formatted conversations."""

    def digest(batches):
        for batch in sliced(batches, 512):
            rows = []
            for conv_id, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                turns = read_back(text)
                loss = unescaped("".join(text[s["start"] : s["end"]] for s in spans))
                said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((conv_id, len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DIGESTS.types, strict=True)], schema=_DIGESTS)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(
        digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


def _sql() -> str:
    def extra(column: str, more: str = "") -> str:
        """Characters that escaping adds."""
        marks = " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in (ESCAPE, *CONTROL))
        return f"{marks}{more}"

    brackets = " + length(role) - length(replace(role, ']', ''))"
    wrap = len(OPEN) + len(CLOSE) + len(HEAD_END)
    return f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), f as (
  select *, {wrap} + length(role) + {extra("role", brackets)} + length(text) + {extra("text")} as n from t
), g as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as said,
         coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss, sum(n) as n
  from f group by conv_id
)
select conv_id, n_turns, sha256(said) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, n::bigint as formatted_chars
from g
"""


#: The same digests in DuckDB's SQL, from the input alone.
SQL = _sql()
