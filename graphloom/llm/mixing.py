"""Mixing of sources to target weights by a low-discrepancy schedule.

Each source gets a target in words: its share of all words by weight, at most
``max_repeats`` times its own size, the excess shared again by weight. Golden-ratio
points are mapped through the cumulative targets; the r-th point that falls on a
source is its r-th slot, and takes the r-th block of equally many words of the
source's documents in a fixed random order, which starts again where it ends. What is
taken of a document is what the slots it overlaps take of it, in all its repeats, and
``mixed_documents`` gives the copies in the order of those slots' turns.

A mix has as many points as its words make blocks, and a source the slots of the points
that fall on it. Such a sequence gives each source its share but for a few points, so up
to ``REMAINDER`` blocks are added after all points, or left out, to meet a target; with a
sequence of a larger discrepancy, sources would miss theirs.

All of it is DataFrame code. Running sums of a source are made in two levels (sums
of hash buckets, in a number that follows that of the rows, then within a bucket), so
that a source with a third of all rows is no single task; those over sources in two
levels too (ranges, then within a range), as sources may be many. Points meet sources by
an equi-join on a grid. Only sums of buckets and ranges, and the slots of a source,
whose number is a parameter, are ever sorted as one.

A null text has size 0; a null source is a source of its own, the last one. Rows
repeated or tied in all columns are told apart by an arbitrary order and share what
is taken among them in a result that is the same as a whole in each run. Nothing is
taken of documents without words. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import written

#: Fixed value: 2**32 divided by the golden ratio, odd, so that points are exact integers.
GOLDEN = 2654435769
WEIGHTS = (5, 2, 1)
N_SLOTS = 1 << 16
MAX_REPEATS = 3
#: Blocks by which a source's points may miss its target and still be settled.
REMAINDER = 8
#: Rows of a bucket of a source at most, as far as hashes are even.
BUCKET_ROWS = 50_000

_CHARS = r"concat(' ', char(9), char(10), char(11), char(12), char(13))"
N_WORDS = rf"cast(if(btrim(coalesce(text, ''), {_CHARS}) = '', 0, size(split(btrim(coalesce(text, ''), {_CHARS}), '[\\x20\\x09-\\x0D]+'))) as bigint)"
_SOURCE = ["no_source", "source_key"]


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, no_source, source_key, size, order_key) of every document."""
    return docs.select(
        "doc_id",
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source_key"),
        F.expr(N_WORDS).alias("size"),
        F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 16).alias("order_key"),
    )


def running(df: DataFrame, order: list[Column], **of: Column) -> DataFrame:
    """``df`` with ``place``, the number of rows before each one in an order without ties, and the sums of columns over them.

    Rows are dealt out by ranges of the order; only a row for each range is summed as one.
    """
    keys = {f"_key{k}": c for k, c in enumerate(order)}
    dealt = df.withColumns(keys | {f"_{n}": c for n, c in of.items()}).repartitionByRange(*keys)
    dealt = written(dealt.withColumn("_range", F.spark_partition_id()), "mix-ranges")
    sums = {"place": F.lit(1).cast("bigint")} | {n: F.col(f"_{n}") for n in of}
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_all_{n}") for n, c in sums.items()])
    ranges = ranges.select("_range", *[F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums])
    within = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    both = {n: F.col(f"_before_{n}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()}
    return dealt.join(F.broadcast(ranges), "_range").select(*df.columns, *[c.cast("bigint").alias(n) for n, c in both.items()])  # a row for each range


def targets(sizes: DataFrame, weights=WEIGHTS, n_slots=N_SLOTS, max_repeats=MAX_REPEATS) -> DataFrame:
    """One row for each source: its index, size, target, whole words to take, and slots.

    Sources fill up in the order of cap / weight, so whether one is capped follows
    from sums over those before it; no iteration is needed.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_index") - 1) % len(weights) + 1).cast("int"))
    ranked = (
        running(sizes.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size")), [F.col(c) for c in _SOURCE])
        .withColumn("source_index", (F.col("place") + 1).cast("int"))
        .drop("place")
        .withColumn("weight", w.cast("bigint"))
        .withColumn("cap", F.col("source_size") * max_repeats)
    )
    filled = running(ranked, [F.col("cap") / F.col("weight"), F.col("source_index")], before=F.col("cap"), lighter=F.col("weight"))
    whole = filled.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights"))
    filled = (
        filled.join(F.broadcast(whole))  # one row
        .withColumn("others", F.col("weights") - F.col("lighter"))
        .withColumn("capped", F.col("cap") * F.col("others") <= F.col("weight") * (F.col("total") - F.col("before")))
    )
    shared = filled.agg(
        (F.max("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0))).alias("left"),
        F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).alias("sharing"),
    )
    level = F.col("left").cast("double") / F.nullif("sharing", F.lit(0)).cast("double")
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight").cast("double") * level)
    taken = (
        filled.join(F.broadcast(shared))  # one row
        .withColumn("target", target)
        .withColumn("take", F.floor("target").cast("bigint"))
        .withColumn("block", F.greatest(F.lit(1), F.ceil(F.col("total") / n_slots)).cast("bigint"))
        .select(*_SOURCE, "source_index", "source_size", "cap", "target", "take", "block")
    )
    placed = running(taken, [F.col("source_index")], begins=F.col("take"))
    every = placed.agg(F.coalesce(F.sum("take"), F.lit(0)).alias("all_taken"))
    return placed.join(F.broadcast(every)).drop("place")  # one row


def fallen(spark, sources: DataFrame, n_slots=N_SLOTS) -> DataFrame:
    """(source_index, slot, id): the golden-ratio points that fall on each source, and which of its points each is."""
    ends = sources.agg(F.max("all_taken").cast("double").alias("all"))  # one row
    cell = lambda at: F.floor(at / F.col("all") * n_slots).cast("int")
    u = (F.col("id") * F.lit(GOLDEN)) % F.lit(1 << 32)
    points = spark.range(2 * n_slots).join(F.broadcast(ends)).filter("all > 0")
    points = points.withColumn("at", u.cast("double") / F.lit(float(1 << 32)) * F.col("all")).select("id", "at", cell(F.col("at")).alias("cell"))
    spans = sources.filter("take > 0").join(F.broadcast(ends)).withColumn("low", F.col("begins").cast("double")).withColumn("high", (F.col("begins") + F.col("take")).cast("double"))
    spans = spans.select("source_index", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    met = spans.join(points, "cell").filter("at >= low and at < high")
    return met.select("source_index", F.row_number().over(Window.partitionBy("source_index").orderBy("id")).cast("bigint").alias("slot"), "id")


def settled(spark, sources: DataFrame, n_slots=N_SLOTS) -> DataFrame:
    """The sources with the words that their slots take (``take``), and the number of those ``slots``.

    These are the slots of the first points, as many as the mix has blocks, and the
    remainder to the target, if that is small; never more than the most repeats.
    """
    horizon = F.ceil(F.col("all_taken") / F.col("block"))
    end = sources.agg(F.max(horizon).alias("end"))  # one row
    points = fallen(spark, sources, n_slots).join(F.broadcast(end)).filter("id < end").groupBy("source_index").agg(F.count("*").alias("points"))
    n = F.coalesce("points", F.lit(0))
    take = F.least(F.greatest("take", (n - REMAINDER) * F.col("block")), (n + REMAINDER) * F.col("block"), "cap")
    return (
        sources.join(points, "source_index", "left")
        .withColumn("taking", take.cast("bigint"))
        .withColumn("slots", F.ceil(F.col("taking") / F.col("block")).cast("bigint"))
    )


def schedule(spark, sources: DataFrame, n_slots=N_SLOTS) -> DataFrame:
    """(source_index, slot, position): when each slot of each source has its turn.

    The position is the index of the golden-ratio point that fell on the source. A
    remainder that isn't met by ``2 * n_slots`` points has its slots after them.
    """
    quotas = sources.filter("slots > 0").select("source_index", F.explode(F.sequence(F.lit(1).cast("bigint"), "slots")).alias("slot"))
    return quotas.join(fallen(spark, sources, n_slots), ["source_index", "slot"], "left").select(
        "source_index", "slot", F.coalesce("id", F.lit(2 * n_slots) + F.col("slot")).alias("position")
    )


def turns(docs: DataFrame, weights=WEIGHTS, n_slots=N_SLOTS, max_repeats=MAX_REPEATS) -> DataFrame:
    """A row for each slot that a repeat of a document overlaps, with the slot's position and
    the words it takes of the document; one row with 0 words where no slot does.

    ``repeat`` counts from 0; ``opens`` marks the slot in which a repeat begins. A row of
    ``docs`` is told from others by ``source_index``, ``bucket`` and ``nth``.
    """
    spark = docs.sparkSession
    sizes = written(sized(docs), "mix-sizes")
    sources = written(targets(sizes, weights, n_slots, max_repeats), "mix-targets")
    sources = written(settled(spark, sources, n_slots), "mix-sources")
    slots = schedule(spark, sources, n_slots)
    digits = 3
    while sizes.count() > BUCKET_ROWS << 4 * digits:
        digits += 1
    of_source = sources.select(*_SOURCE, "source_index", "source_size", "target", "block", F.col("taking").alias("take"))
    bucketed = sizes.join(of_source, _SOURCE).withColumn("bucket", F.substring("order_key", 1, digits))
    offsets = (
        bucketed.groupBy("source_index", "bucket")
        .agg(F.sum("size").alias("in_bucket"))
        .withColumn("offset", F.sum("in_bucket").over(Window.partitionBy("source_index").orderBy("bucket")) - F.col("in_bucket"))
        .select("source_index", "bucket", "offset")
    )
    inner = Window.partitionBy("source_index", "bucket").orderBy("order_key", "doc_id", "size")
    placed = (
        bucketed.withColumn("nth", F.row_number().over(inner))
        .withColumn("within", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(offsets, ["source_index", "bucket"])
        .withColumn("begin", F.col("offset") + F.col("within"))
    )
    begun = F.expr(f"""filter(
        transform(sequence(0, {max_repeats} - 1), k -> struct(k as repeat, begin + k * source_size as at, least(begin + k * source_size + size, take) as upto)),
        x -> size > 0 and x.at < take)""")
    first = F.floor(F.col("span.at") / F.col("block")).cast("bigint") + 1
    last = F.floor((F.col("span.upto") - 1) / F.col("block")).cast("bigint") + 1
    # rows of which nothing is taken get a key of their own that meets no slot, so that they don't gather in one task
    apart = -1 - F.pmod(F.xxhash64("order_key"), F.lit(1_000_003))
    overlapped = (
        placed.withColumn("span", F.explode_outer(begun))
        .withColumn("first", first)
        .withColumn("slot", F.explode_outer(F.when(F.col("span").isNotNull(), F.sequence("first", last))))
        .withColumn("slot", F.coalesce("slot", apart))
    )
    words = F.least("span.upto", F.col("slot") * F.col("block")) - F.greatest("span.at", (F.col("slot") - 1) * F.col("block"))
    return overlapped.join(slots, ["source_index", "slot"], "left").select(
        "source_index", "bucket", "nth", "doc_id", "size", "source_size", "target", F.col("span.repeat").alias("repeat"), "position",
        (F.col("slot") == F.col("first")).alias("opens"), F.when(F.col("position").isNotNull(), words).otherwise(0).cast("bigint").alias("words"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, n_slots=N_SLOTS, max_repeats=MAX_REPEATS) -> DataFrame:
    """Per document: size, its source's size and target, the words that slots take, repeats counted,
    and ``first_position``, its first turn in the schedule (null if nothing is taken)."""
    return (
        turns(docs, weights, n_slots, max_repeats)
        .groupBy("source_index", "bucket", "nth", "doc_id", "size", "source_size", "target")
        .agg(F.sum("words").alias("taken"), F.min(F.when(F.col("opens") & (F.col("repeat") == 0), F.col("position"))).alias("first_position"))
        .select("doc_id", "size", "source_size", "target", "taken", "first_position")
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, n_slots=N_SLOTS, max_repeats=MAX_REPEATS) -> DataFrame:
    """The rows of ``docs``, each as often as its slots take it, to the nearest whole time, in
    the order of the schedule: a copy stands where the slot in which that repeat begins has its turn."""
    begins = [F.min(F.when(F.col("opens") & (F.col("repeat") == k), F.col("position"))) for k in range(max_repeats)]
    counts = (
        turns(docs, weights, n_slots, max_repeats)
        .filter("size > 0")
        .groupBy("doc_id", "size")
        .agg(
            F.sum("words").alias("taken"),
            F.sum(F.when(F.col("repeat").isNull() | (F.col("opens") & (F.col("repeat") == 0)), 1).otherwise(0)).alias("rows"),
            F.array(*begins).alias("_turns"),
        )
    )
    copies = counts.select(
        F.col("doc_id").alias("_id"),
        F.col("size").alias("_size"),
        F.expr("slice(_turns, 1, cast(floor((2 * taken + size * rows) / (2 * size * rows)) as int))").alias("_turns"),
    ).filter("size(_turns) > 0")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), F.expr(N_WORDS).alias("_n"))
    return (
        rows.join(copies, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_n") == F.col("_size")))
        .select("_row", "_doc", F.explode("_turns").alias("_turn"))
        .orderBy(F.col("_turn").asc_nulls_last(), "_doc")
        .select("_row.*")
    )


#: The same in DuckDB's SQL.
SQL = rf"""
with z as (
  select doc_id, source is null as no_source, coalesce(source, '') as source_key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         substr(md5(coalesce(doc_id::varchar, '')), 1, 16) as order_key
  from documents
), a as (
  select no_source, source_key, sum(size)::bigint as source_size from z group by all
), b as (
  select *, row_number() over (order by no_source, source_key) as i, {MAX_REPEATS} * source_size as cap from a
), c as (
  select *, [{", ".join(map(str, WEIGHTS))}][((i - 1) % {len(WEIGHTS)} + 1)::int] as w, sum(source_size) over () as total from b
), d as (
  select *, coalesce(sum(cap) over (order by cap / w, i rows between unbounded preceding and 1 preceding), 0) as before,
         sum(w) over (order by cap / w, i rows between current row and unbounded following) as others from c
), e as (
  select *, cap * others <= w * (total - before) as capped from d
), f as (
  select *, (total - sum(case when capped then cap else 0 end) over ())::double
         / nullif(sum(case when capped then 0 else w end) over (), 0)::double as level from e
), g as (
  select *, case when capped then cap::double else w::double * level end as target from f
), h as (
  select *, floor(target)::bigint as take, greatest(1, ceil(total / {N_SLOTS}.0))::bigint as block from g
), s as (
  select *, ceil(take / block::double)::bigint as slots, (sum(take) over (order by i) - take)::bigint as begins, (sum(take) over ())::bigint as all_taken from h
), p as (
  select n, ((n * {GOLDEN}) % 4294967296)::double / 4294967296.0::double * (select max(all_taken) from s)::double as pos
  from (select unnest(range({2 * N_SLOTS}))::bigint as n)
), q as (
  select n, last_value(bound ignore nulls) over (order by pos, (n is not null), bound, n rows between unbounded preceding and current row) as i
  from (select pos, null::bigint as bound, n from p union all select begins::double, i, null from s)
), r as (
  select i, n, row_number() over (partition by i order by n) as slot from q where n is not null
), t as (
  select s.i, x.slot, coalesce(r.n, {2 * N_SLOTS} + x.slot)::bigint as position
  from s, unnest(range(1, slots + 1)) as x(slot) left join r on r.i = s.i and r.slot = x.slot
), u as (
  select z.*, s.i, s.source_size, s.target, s.take, s.block,
         (sum(z.size) over (partition by s.i order by z.order_key, z.doc_id, z.size rows between unbounded preceding and current row) - z.size)::bigint as beg
  from z join s using (no_source, source_key)
)
select u.doc_id, u.size, u.source_size, u.target,
       ({" + ".join(f"greatest(0, least(size, take - beg - {k} * source_size))" for k in range(MAX_REPEATS))})::bigint as taken,
       t.position as first_position
from u left join t on t.i = u.i and size > 0 and beg < take and t.slot = beg // block + 1
"""
