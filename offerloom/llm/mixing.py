"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key scaled by its quality weight; within a source,
documents are taken in key order until their prefix sum reaches the source's budget.
A budget above the source's size first takes whole epochs, the rest is selected.

Prefix sums never order a whole source in one task: keys fall into ranges of bounded
size, ranges are summed with map-side combining, and only the range in which a source's
budget ends is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.common import WORD, staged
from offerloom.operators.sizing import broadcast_if_small

WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes (a fraction), and most epochs of a source.
SHARE, EPOCHS = (3, 2), 2
RANGE_ROWS = 20_000
SEED = "mix"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def quality_weight(text: str = "text") -> Column:
    """1 for plain prose, less with more marks other than stops and commas, at least 0.05."""
    odd = F.regexp_count(F.col(text), F.lit(r"[^\p{L}\x20\x09-\x0D.,]"))
    share = F.lit(1.0) - F.lit(4.0) * odd / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.05), share), F.lit(0.05))


def exponential_key(weight: Column, doc_id: str = "doc_id") -> Column:
    """-ln(u) / weight with u in (0, 1] from a hash of the id: the same on every run."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(f":{SEED}")))
    drawn = F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") + 1
    return -F.log(drawn / F.lit(float(1 << 48))) / weight


def _sized(docs: DataFrame) -> DataFrame:
    """The docs with ``mix_size``, ``mix_key`` and ``mix_order``, which orders a source's rows."""
    sized = docs.withColumns({"mix_size": word_count(), "mix_key": exponential_key(quality_weight())})
    first = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    tie = F.xxhash64("text", "mix_size")
    return sized.withColumn(
        "mix_order", F.struct(F.col("mix_key").alias("k"), first.cast("bigint").alias("i"), tie.alias("t"))
    )


def source_targets(narrow: DataFrame) -> DataFrame:
    """``(source, source_size, target)``: water-filling up to ``EPOCHS`` times each size.

    One row per source passes through an ordered window.
    """
    sources = narrow.groupBy("source").agg(F.sum("mix_size").alias("s"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    whole = Window.orderBy(F.col("s") / F.col("w"), F.col("source").asc_nulls_last())
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    after = whole.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    num, den = SHARE
    ranked = (
        sources.withColumn("w", weights.cast("bigint"))
        .withColumn("capped_before", EPOCHS * F.coalesce(F.sum("s").over(before), F.lit(0)))
        .withColumn("w_rest", F.sum("w").over(after))
        .withColumn("total", F.sum("s").over(every))
        .withColumn("left", num * F.col("total") - den * F.col("capped_before"))
        .withColumn("full", den * EPOCHS * F.col("s") * F.col("w_rest") <= F.col("w") * F.col("left"))
    )
    # The first source that is not full fixes the level of all after it.
    level = F.min(F.when(~F.col("full"), F.struct("capped_before", "left", "w_rest"))).over(every)
    target = F.when(F.col("full"), (EPOCHS * F.col("s")).cast("double")).otherwise(
        (F.col("w") * F.col("level.left")).cast("double") / (den * F.col("level.w_rest")).cast("double")
    )
    return ranked.withColumn("level", level).select(
        "source", F.col("s").alias("source_size"), target.alias("target")
    )


def mix_plan(narrow: DataFrame) -> DataFrame:
    """Per source: ``target``, whole ``epochs``, and the row where selection ends.

    ``narrow`` is a written table with source, mix_size, mix_key and mix_order. ``cut`` is
    the last row's order (null where nothing is selected) and ``cut_words`` what is taken
    of it; rows equal in every respect share those words.
    """
    targets = staged(source_targets(narrow), "mix-targets")
    rows = narrow.count()
    ranges = max(16, rows // RANGE_ROWS)
    part = F.floor((1 - F.exp(-F.col("mix_key"))) * ranges).cast("int")
    dealt = narrow.withColumn("part", part)
    sums = dealt.groupBy("source", "part").agg(F.sum("mix_size").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    size = F.greatest(F.col("source_size"), F.lit(1))
    epochs = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / size))
    goals = targets.withColumn("epochs", F.least(epochs, F.lit(EPOCHS)).cast("bigint"))
    goals = goals.withColumn("rest", F.round("target").cast("bigint") - F.col("epochs") * F.col("source_size"))
    near = sums.alias("a").join(
        broadcast_if_small(goals).alias("b"), F.expr("a.source <=> b.source and b.rest > a.start and b.rest <= a.start + a.n")
    )
    ends = near.select(
        F.col("a.source").alias("end_source"), F.col("part").alias("end_part"),
        (F.col("rest") - F.col("start")).alias("want"),
    )
    inside = dealt.join(
        broadcast_if_small(ends), F.expr("source <=> end_source and part = end_part")
    ).groupBy("source", "want", "mix_order").agg(F.sum("mix_size").alias("n"), F.count("*").alias("rows"))
    order = Window.partitionBy("source").orderBy("mix_order")
    inside = inside.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = inside.where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want")))
    last = last.select(
        F.col("source").alias("cut_source"), F.col("mix_order").alias("cut"),
        F.floor((F.col("want") - F.col("upto") + F.col("n")) / F.col("rows")).alias("cut_words"),
    )
    return goals.join(last, F.expr("source <=> cut_source"), "left").select(
        F.col("source").alias("mix_source"), "source_size", "target", "epochs", "cut", "cut_words"
    )


def _planned(sized: DataFrame, narrow: DataFrame) -> DataFrame:
    plan = broadcast_if_small(staged(mix_plan(narrow), "mix-plan"))
    return sized.join(plan, F.expr("source <=> mix_source"))


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every row.

    A null text has size 0, null sources form one source. ``taken`` counts whole epochs,
    then the selection; the row where a source's budget ends is taken in part, so that
    the budget is met to the word. Repeated rows are rows of their own. Other columns are
    ignored; an empty table gives no rows.
    """
    narrow = staged(_sized(docs.select("doc_id", "text", "source")).drop("text"), "mix-rows")
    rows = _planned(narrow, narrow)
    selected = F.when(F.col("mix_order") < F.col("cut"), F.col("mix_size"))
    selected = selected.when(F.col("mix_order") == F.col("cut"), F.col("cut_words")).otherwise(0)
    return rows.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        "source_size",
        "target",
        (F.col("epochs") * F.col("mix_size") + selected).cast("bigint").alias("taken"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, with equal columns.

    Documents stay whole: the one in which a budget ends is kept if at least half of it
    belongs to the budget.
    """
    narrow = staged(_sized(docs.select("doc_id", "text", "source")).drop("text"), "mix-rows")
    # The caller's columns travel as one, so that their names meet none of those used here.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row")
    rows = _planned(_sized(docs.select("doc_id", "text", "source", whole)), narrow)
    nearer = (F.col("mix_order") == F.col("cut")) & (2 * F.col("cut_words") >= F.col("mix_size"))
    once = F.coalesce((F.col("mix_order") < F.col("cut")) | nearer, F.lit(False))
    copies = (F.col("epochs") + once.cast("bigint")).cast("int")
    return rows.where(copies > 0).select("mix_row", F.explode(F.sequence(F.lit(1), copies)).alias("mix_copy")).select("mix_row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    coalesce(greatest(0.05::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE
      * len(regexp_extract_all(text, '[^\pL\x20\x09-\x0D.,]')) / greatest(length(text), 1)), 0.05::DOUBLE) AS w,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix'), 1, 12))::BIGINT + 1) / 281474976710656.0::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / w AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM k GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
r AS (
  SELECT *, 2 * coalesce(sum(s) OVER (ORDER BY s / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY s / weight, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(s) OVER () AS total FROM w),
f AS (SELECT *, 3 * total - 2 * capped AS remains, 4 * s * rest <= weight * (3 * total - 2 * capped) AS is_full FROM r),
l AS (SELECT arg_min(remains, capped) AS remains, arg_min(rest, capped) AS rest FROM f WHERE NOT is_full),
t AS (SELECT f.source, f.s::BIGINT AS s, CASE WHEN is_full THEN (2 * f.s)::DOUBLE
    ELSE (weight * l.remains)::DOUBLE / (2 * l.rest)::DOUBLE END AS target FROM f LEFT JOIN l ON true),
e AS (SELECT *, CASE WHEN s = 0 THEN 0 ELSE least(floor(target / s), 2)::BIGINT END AS epochs FROM t),
p AS (
  SELECT k.doc_id, k.size, e.s, e.target, e.epochs, round(e.target)::BIGINT - e.epochs * e.s AS want,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, s AS source_size, target,
  (epochs * size + greatest(0, least(size, want - (upto - size))))::BIGINT AS taken FROM p
"""
