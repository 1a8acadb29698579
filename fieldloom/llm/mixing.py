"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Slot k of the mix takes the golden-ratio point frac((k + 1/2) * phi); cumulative target shares map the point to a
source; the slots of a source are ranked, and the slot of rank r draws tokens [r*b, (r+1)*b) of that source's
shuffled stream, which starts anew at its end, until the source has been drawn ``most_repeats`` times. How many slots the
points give a source is what the mix takes of it: the points' low discrepancy keeps that within a few blocks of its target.
A source of at most ``few`` blocks, for which that is much, gets as many slots as its target needs: surplus ones are left
out, missing ones follow the schedule's end. A document's slots tell where it stands in the mix.

Skew: a source may hold any share of all rows, so positions in its stream come from two levels: sums of (source,
bucket of the id's md5), then a running sum inside each such bucket; slots are ranked in the same way by chunks.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own, last in order;
repeated rows are rows of their own, each with its own place in the stream; equal md5 values are ordered by id and
size; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import count_words, free_name, table
from fieldloom.session import ensure_checkpoint_dir

GOLDEN = 0.6180339887498949


@dataclass(frozen=True)
class MixRules:
    weights: tuple[int, ...] = (5, 2, 1)  # of the sources in order, repeating
    most_repeats: int = 3
    slots: int = 1 << 18  # about so many, until blocks reach most_block tokens
    most_block: int = 4096
    few: int = 16  # blocks, up to which a source's slots are made to fit its target
    seed: str = "mix"
    cells: int = 1024  # of the unit interval, to join points with shares by an equal key


def source_targets(sizes: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """Per source: src (0, 1, ... in code point order, null last), source, source_size, target, and its share of the interval, lo to hi.

    Shares fill up to most_repeats times a source's size; what is above goes to the others by weight.
    """
    r = rules
    w = F.element_at(F.array(*[F.lit(x) for x in r.weights]), (F.col("src") % len(r.weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.select((F.row_number().over(by_name) - 1).alias("src"), "source", "source_size").withColumn("w", w)
    everything, by_fill = Window.partitionBy(), Window.orderBy(F.col("most") / F.col("w"), "src")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("most", F.col("source_size") * r.most_repeats)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("level", level).withColumn("full", F.col("level") * F.col("w") >= F.col("most"))
    water = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("w"), "src", "level"))).over(everything)["level"]
    s = s.withColumn("target", F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("w") * water))
    upto = F.sum("target").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("upto", upto).withColumn("total", F.max("upto").over(everything))
    s = s.withColumn("hi", F.when(F.col("total") > 0, F.col("upto") / F.col("total")).otherwise(0.0))
    return s.select("src", "source", "source_size", "target", F.lag("hi", 1, 0.0).over(Window.orderBy("src")).alias("lo"), "hi", F.sum("source_size").over(everything).alias("total"))


def _block(total: Column, r: MixRules) -> Column:
    return F.least(F.lit(r.most_block), F.greatest(F.lit(1), F.ceil(total / r.slots))).cast("long")


def schedule(targets: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """slot, src, rank, low, high: in order of slot, source src gives tokens low to high of its repeated stream."""
    r = rules
    t = targets.withColumn("block", _block(F.col("total"), r)).withColumn("most", F.col("source_size") * r.most_repeats)
    t = t.withColumn("wanted", F.least(F.round("target").cast("long"), F.col("most"))).withColumn("need", F.ceil(F.col("wanted") / F.col("block")).cast("long"))
    size = t.agg(F.max(F.ceil(F.col("total") / F.col("block")).cast("long")).alias("n"))
    chunks = size.select(F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), (F.coalesce("n", F.lit(0)) - 1) / 4096).cast("long"))).alias("chunk"), F.coalesce("n", F.lit(0)).alias("n"))
    slots = chunks.repartition("chunk").select("chunk", F.explode(F.sequence(F.col("chunk") * 4096, F.col("chunk") * 4096 + 4095)).alias("slot"), "n").filter("slot < n")
    x = (F.col("slot") + 0.5) * GOLDEN
    slots = slots.withColumn("u", x - F.floor(x)).withColumn("cell", F.floor(F.col("u") * r.cells).cast("long"))
    shares = t.filter("hi > lo").select("src", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * r.cells).cast("long"), F.least(F.floor(F.col("hi") * r.cells).cast("long"), F.lit(r.cells - 1).cast("long")))).alias("cell"))
    drawn = slots.join(shares, "cell").filter("u >= lo and u < hi").select("slot", "chunk", "src")
    counts = drawn.groupBy("src", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("src", "chunk", (F.sum("n").over(Window.partitionBy("src").orderBy("chunk")) - F.col("n")).alias("before"))
    ranked = drawn.withColumn("k", F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1).join(before, ["src", "chunk"])
    ranked = ranked.select("slot", "src", (F.col("before") + F.col("k")).alias("rank"))
    given = counts.groupBy("src").agg(F.sum("n").alias("given"))
    quotas = t.join(given, "src", "left").withColumn("given", F.coalesce("given", F.lit(0))).withColumn("fitted", F.col("need") <= r.few)
    quota = F.when(F.col("fitted"), F.col("wanted")).otherwise(F.least(F.col("given") * F.col("block"), "most"))
    quotas = quotas.select("src", "block", "need", "given", "fitted", quota.alias("quota"), F.ceil(F.col("total") / F.col("block")).cast("long").alias("end"))
    closing = quotas.filter("fitted and need > given").select((F.col("end") + F.col("src")).alias("slot"), "src", F.explode(F.sequence("given", F.col("need") - 1)).alias("rank"))
    every = ranked.unionByName(closing).join(quotas, "src").filter(F.col("rank") * F.col("block") < F.col("quota"))
    return every.select("slot", "src", "rank", (F.col("rank") * F.col("block")).alias("low"), F.least((F.col("rank") + 1) * F.col("block"), F.col("quota")).alias("high"), "block")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", rules: MixRules = MixRules()) -> DataFrame:
    """Per row of docs: doc_id, size, source, source_size, target (its source's), start (its place in the shuffled source), taken, the words
    that the mix takes of it, repeats counted, and slots: the first slot that draws it in each round through its source (null if none)."""
    r = rules
    ensure_checkpoint_dir(docs.sparkSession)
    key = F.md5(F.concat_ws("|", F.lit(r.seed), F.coalesce(docs[doc_id].cast("string"), F.lit(""))))
    sizes = docs.select(docs[doc_id].alias("doc_id"), docs[source].cast("string").alias("source"), count_words(docs[text]).alias("size"), key.alias("key")).checkpoint()
    targets = source_targets(sizes, r).checkpoint()
    slots = schedule(targets, r).select("src", "rank", "slot", "low", "high").checkpoint()
    quotas = slots.groupBy("src").agg(F.max("high").alias("quota"))
    known = targets.join(quotas, "src", "left").select("src", F.col("source").alias("name"), "source_size", "target", "total", F.coalesce("quota", F.lit(0)).alias("quota"))
    keyed = sizes.join(known, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("bucket", F.substring("key", 1, 3))
    sums = keyed.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select("src", "bucket", (F.sum("n").over(Window.partitionBy("src").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size")
    placed = keyed.withColumns({"upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "row": F.row_number().over(inside)}).join(sums, ["src", "bucket"])
    placed = placed.withColumn("start", F.col("before") + F.col("upto") - F.col("size")).withColumn("block", _block(F.col("total"), r))
    last = F.least(F.lit(r.most_repeats - 1).cast("long"), F.floor((F.col("quota") - 1 - F.col("start")) / F.col("source_size")).cast("long"))
    rounds = F.when((F.col("size") > 0) & (F.col("start") < F.col("quota")), F.sequence(F.lit(0).cast("long"), last))
    parts = placed.withColumn("round", F.explode_outer(rounds)).withColumn("at", F.col("start") + F.col("round") * F.col("source_size"))
    parts = parts.withColumn("rank", F.explode_outer(F.sequence(F.floor(F.col("at") / F.col("block")).cast("long"), F.floor((F.col("at") + F.col("size") - 1) / F.col("block")).cast("long"))))
    drawn = parts.join(slots.hint("merge"), ["src", "rank"], "left")  # 2^18 slots would be broadcast through the driver
    got = F.greatest(F.lit(0), F.least("high", F.col("at") + F.col("size")) - F.greatest("low", "at"))
    facts = ["doc_id", "source", "size", "source_size", "target", "start"]
    firsts = [F.min(F.when(F.col("round") == k, F.col("slot"))) for k in range(r.most_repeats)]
    out = drawn.groupBy("src", "bucket", "row").agg(*[F.first(c).alias(c) for c in facts], F.sum(F.when(F.col("low").isNotNull(), got).otherwise(0)).cast("long").alias("taken"), F.array(*firsts).alias("slots"))
    return out.select(*facts, "taken", "slots")


def op5_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.get("slots", 0).alias("first_slot"))


def _sql(r: MixRules = MixRules()) -> str:
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(r.weights))
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('{r.seed}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM s0),
s2 AS (SELECT *, CASE src % {len(r.weights)} {weight} END AS w, source_size * {r.most_repeats} AS most FROM s1),
s3 AS (SELECT *, CAST((SELECT sum(source_size) FROM s2) - coalesce(sum(most) OVER q, 0) AS DOUBLE) / ((SELECT sum(w) FROM s2) - coalesce(sum(w) OVER q, 0)) AS level FROM s2
  WINDOW q AS (ORDER BY most / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, level * w >= most AS full_up FROM s3),
s5 AS (SELECT src, source, source_size, CASE WHEN full_up THEN CAST(most AS DOUBLE) ELSE w * (SELECT arg_min(level, struct_pack(a := most / w, b := src)) FROM s4 WHERE NOT full_up) END AS target FROM s4),
h AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY src), 0) AS lo FROM (SELECT *, CASE WHEN (SELECT sum(target) FROM s5) > 0 THEN sum(target) OVER (ORDER BY src) / (SELECT max(u) FROM (SELECT sum(target) OVER (ORDER BY src) AS u FROM s5)) ELSE 0 END AS hi FROM s5)),
b0 AS (SELECT CAST(sum(source_size) AS BIGINT) AS total FROM s5),
b AS (SELECT block, CAST(ceil(total / block) AS BIGINT) AS n FROM (SELECT total, CAST(least({r.most_block}, greatest(1, ceil(total / {r.slots}))) AS BIGINT) AS block FROM b0)),
pts AS (SELECT k AS slot, (k + 0.5::DOUBLE) * {GOLDEN!r}::DOUBLE - floor((k + 0.5::DOUBLE) * {GOLDEN!r}::DOUBLE) AS u FROM (SELECT unnest(range((SELECT n FROM b))) AS k)),
ranked AS (SELECT src, slot, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rank FROM pts JOIN h ON u >= lo AND u < hi),
q0 AS (SELECT s5.*, least(CAST(round(target) AS BIGINT), source_size * {r.most_repeats}) AS wanted, coalesce(g.given, 0) AS given, block, n FROM s5 CROSS JOIN b LEFT JOIN (SELECT src, count(*) AS given FROM ranked GROUP BY src) g USING (src)),
q AS (SELECT *, CASE WHEN ceil(wanted / block) <= {r.few} THEN wanted ELSE least(given * block, source_size * {r.most_repeats}) END AS quota FROM q0),
p AS (SELECT d.doc_id, d.size, q.*, CAST(sum(d.size) OVER (PARTITION BY q.src ORDER BY k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS start FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE list_sum(list_transform([0, 1, 2], lambda e: greatest(0, least(quota, start + e * source_size + size) - (start + e * source_size)))) END AS BIGINT) AS taken,
  CASE WHEN size > 0 AND start < quota THEN coalesce(ranked.slot, n + p.src) END AS first_slot
FROM p LEFT JOIN ranked ON ranked.src = p.src AND ranked.rank = p.start // p.block"""


ORACLE = _sql()


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", rules: MixRules = MixRules()) -> DataFrame:
    """The rows of docs that the mix takes words of, each as often as it takes it (a part of a document counts as the whole), in the order
    of the slots that draw them; the columns are those of docs.

    Rows that share id, source and size share what is taken of them.
    """
    r = rules
    firsts = F.array(*[F.min(F.get("slots", k)) for k in range(r.most_repeats)])
    taken = mix(docs, doc_id, text, source, r).groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("rows"), firsts.alias("slots")).filter("taken > 0")
    times = F.least(F.ceil(F.col("taken") / (F.col("size") * F.col("rows"))), F.lit(r.most_repeats)).cast("int")
    taken = taken.select(F.struct(F.col("doc_id").alias("id"), "source", "size", F.slice("slots", 1, times).alias("slots")).alias(free_name("mixed", docs)))
    told = taken.columns[0]
    same = docs[doc_id].eqNullSafe(F.col(f"{told}.id")) & docs[source].cast("string").eqNullSafe(F.col(f"{told}.source")) & (count_words(docs[text]) == F.col(f"{told}.size"))
    slot = free_name("slot", docs)
    copies = docs.join(taken, same).select(*[docs[f"`{c}`"] for c in docs.columns], F.explode(f"{told}.slots").alias(slot))
    return copies.orderBy(slot).drop(slot)

