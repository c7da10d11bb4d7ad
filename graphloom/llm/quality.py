"""Quality rules: a table of thresholds compiled into one native projection.

Everything is a built-in Spark expression over the single row, so the plan has
neither a shuffle nor Python. Null texts count as texts without words. Repeated
rows give repeated results; ties cannot arise; an empty table gives an empty one;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on as with this by be are at from or "
    "de la le les et des en un une que pour dans est du pas qui "
    "der die und das von mit ist den zu für im auf ein eine nicht sich "
    "el los se las del por con para no lo su y a"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= numerator / denominator <= high``."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None

    def passes(self) -> str:
        bounds = []
        if self.low is not None:
            bounds.append(f"{self.numerator} >= {self.low!r}D * {self.denominator}")
        if self.high is not None:
            bounds.append(f"{self.numerator} <= {self.high!r}D * {self.denominator}")
        return "(" + " and ".join(bounds) + ")"


#: Thresholds in use; each is a ratio of two of the columns made below.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 16.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.2),
    Rule("stop_words", "n_stop_words", "n_words", 0.01, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
)

_CHARS = r"concat(' ', char(9), char(10), char(11), char(12), char(13))"


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it as ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeated(words: str) -> str:
    """SQL for the number of words of ``words`` inside repeated 3-word windows.

    Windows are compared by 64-bit hash. Only where some window repeats are
    (hash, position) pairs sorted, so that equal windows are neighbours; the
    words covered are then summed from the gaps between marked positions.
    """
    marked = (
        "sort_array(filter(transform(sequence(0, size(s) - 1), j -> "
        "if((j > 0 and s[greatest(j - 1, 0)].x = s[j].x) or (j < size(s) - 1 and s[least(j + 1, size(s) - 1)].x = s[j].x), s[j].i, -1)), "
        "p -> p >= 0))"
    )
    covered = (
        "aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> coalesce(least(3, b - a), 3)), 0L, (t, g) -> t + g)"
    )
    dup = _let(
        "sort_array(transform(h, (x, i) -> struct(x as x, i as i)))", "s", _let(marked, "p", covered)
    )
    hashes = f"transform(sequence(0, size({words}) - 3), i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2]))"
    return f"if(size({words}) < 3, 0L, {_let(hashes, 'h', f'if(size(array_distinct(h)) = size(h), 0L, {dup})')})"


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_q`` of all counts the rules use."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    counts = ", ".join(
        f"{value} as {name}"
        for name, value in (
            ("n_words", "cast(size(w) as bigint)"),
            ("word_chars", "cast(length(array_join(w, '')) as bigint)"),
            ("n_stop_words", f"cast(size(filter(w, x -> lower(x) in ({stop}))) as bigint)"),
            ("n_repeat_words", _repeated("w")),
        )
    )
    trimmed = f"btrim(coalesce(`{text}`, ''), {_CHARS})"
    words = rf"if({trimmed} = '', cast(array() as array<string>), split({trimmed}, '[\\x20\\x09-\\x0D]+'))"
    lines = rf"filter(split(coalesce(`{text}`, ''), '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"
    of_lines = _let(
        lines, "l", "struct(cast(size(l) as bigint) as n_lines, cast(size(l) - size(array_distinct(l)) as bigint) as n_dup_lines)"
    )
    return docs.withColumns(
        {
            "_w": F.expr(_let(words, "w", f"struct({counts})")),
            "_l": F.expr(of_lines),
            "_s": F.expr(rf"cast(regexp_count(coalesce(`{text}`, ''), '[#*$%&|<>]') as bigint)"),
        }
    )


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every document with its counts, ``base_failed`` and the verdict ``kept``.

    ``kept`` is false for a document that fails the base or any rule of ``rules``;
    a document without words fails the base.
    """
    verdict = " and ".join(r.passes() for r in rules) or "true"
    return (
        measured(docs.select("doc_id", "text"))
        .select("doc_id", "_w.*", "_l.*", F.col("_s").alias("n_symbols"))
        .withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
        .withColumn("kept", F.expr(f"not base_failed and ({verdict})"))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
            "n_lines", "n_stop_words",
        )
    )


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; no row is joined or moved."""
    test = " and ".join(["n_words >= 50 and 100 * n_repeat_words <= 50 * n_words", *(r.passes() for r in rules)])
    rows = measured(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text"))
    return rows.select("_row", "_w.*", "_l.*", F.col("_s").alias("n_symbols")).filter(F.expr(test)).select("_row.*")


#: The same rows in DuckDB's SQL, from its own word lists rather than hashes.
SQL = rf"""
with w as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as l
  from documents
), g as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)
), d as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from g) where n > 1
), c as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from d) group by doc_id
), m as (
  select w.doc_id, len(w.w)::bigint as n_words, length(array_to_string(w.w, ''))::bigint as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
         len(l)::bigint as n_lines,
         len(list_filter(w.w, lambda x: lower(x) in ({", ".join(f"'{x}'" for x in STOP_WORDS)})))::bigint as n_stop_words
  from w left join c on c.doc_id = w.doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)
         and {" and ".join(r.passes().replace("D *", " *") for r in RULES)} as kept,
       n_lines, n_stop_words
from m
"""
