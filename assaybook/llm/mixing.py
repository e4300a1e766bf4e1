"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed 60-bit hash of its id. Words are summed by source
and by the hash's upper 12 bits; a running sum over those 4,096 buckets finds
the one in which a source's budget ends. Only that bucket's documents are
summed again by the next 12 bits, and only the documents of the one remaining
cell are looked at singly; the document in which the budget ends is taken if
that comes nearer to the target. The result is a hash threshold for each source:
documents below it are taken. Budgets nest: a larger budget takes a superset.
Nothing sorts the corpus.

Defined results: null text has size 0; null source is a source of its own,
last in order; a null id hashes as the text ``null``; repeated rows with one
id share a hash and are taken or left together; an empty table gives no rows;
extra columns pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaybook.llm.common import WORD, stored

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = "mix-1"
_HASH_BITS, _STEP = 60, 12


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def position(doc_id: Column, seed: str = SEED) -> Column:
    """A 60-bit hash of the id: the document's fixed place in every mix with this seed."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, target`` from ``source, size``.

    Weights repeat over the sources in code-point order. Targets share all
    words by weight; none exceeds ``most`` times its source, the excess going
    to the others by weight. With sources in order of cap over weight, the
    saturated ones are a prefix, and the share of one unit of weight is the
    largest of (words left after a prefix) over (weight left after it).
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(named) - 1) % len(weights) + 1)
    capped = per_source.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy(F.lit(1))
    before = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left_words = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    shared = capped.withColumn("unit", left_words / left_weight).withColumn("unit", F.max("unit").over(every))
    return shared.select("source", "source_size", F.least("cap", F.col("unit") * F.col("w")).alias("target"))


def _boundary(hist: DataFrame, bucket: str) -> DataFrame:
    """The bucket of each source in which its remaining budget ends, and the budget left before it."""
    order = Window.partitionBy("source").orderBy(bucket)
    run = hist.withColumn("upto", F.sum("words").over(order))
    over = run.filter(F.col("upto") > F.col("rest"))
    first = over.groupBy("source").agg(F.min(F.struct(F.col(bucket), (F.col("rest") - (F.col("upto") - F.col("words"))).alias("rest"))).alias("b"))
    return first.select("source", F.col(f"b.{bucket}").alias(bucket), F.col("b.rest").alias("rest"))


def thresholds(placed: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, target, copies, cut`` from ``source, size, h``.

    A document is taken ``copies`` times, and once more when its hash is below ``cut``.
    """
    targets = source_targets(placed, weights, most)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    plan = targets.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    plan = stored(plan, "mix-plan")

    high = F.shiftright("h", _HASH_BITS - _STEP)
    low = F.shiftright("h", _HASH_BITS - 2 * _STEP).bitwiseAND((1 << _STEP) - 1)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    hist = placed.groupBy("source", high.alias("b1")).agg(F.sum("size").alias("words"))
    hist = hist.join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    first = _boundary(hist, "b1").select(F.col("source").alias("s"), F.col("b1").alias("at1"), "rest")
    edge = placed.join(first, F.col("source").eqNullSafe(F.col("s")) & (high == F.col("at1"))).select("source", "size", "h", "at1", "rest")

    hist = edge.groupBy("source", "at1", "rest", low.alias("b2")).agg(F.sum("size").alias("words"))
    second = _boundary(hist, "b2").select(F.col("source").alias("s"), F.col("b2").alias("at2"), F.col("rest").alias("rest2"))
    cell = edge.join(second, F.col("source").eqNullSafe(F.col("s")) & (low == F.col("at2"))).select("source", "size", "h", "rest2")

    by_hash = cell.groupBy("source", "h", "rest2").agg(F.sum("size").alias("words"))
    run = by_hash.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("h")))
    nearer = (F.col("upto") - F.col("rest2") < F.col("rest2") - (F.col("upto") - F.col("words"))).cast("long")
    over = run.filter(F.col("upto") > F.col("rest2"))
    cuts = over.groupBy("source").agg(F.min(F.struct("h", (F.col("h") + nearer).alias("cut"))).alias("c")).select("source", F.col("c.cut").alias("cut"))
    out = plan.join(cuts, same(plan, cuts), "left").select(plan["source"], "source_size", "target", "copies", F.coalesce("cut", F.lit(1 << _HASH_BITS)).alias("cut"))
    return stored(out, "mix-cuts")


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), position(F.col(id_col), seed).alias("h"))


def mix_report(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, most=MOST_COPIES, seed=SEED) -> DataFrame:
    """Per document: its id, size, source's size and target, and the words the mix takes of it."""
    placed = stored(_placed(docs, id_col, text_col, source_col, seed), "mix-sizes")
    cuts = thresholds(placed, weights, most).withColumnRenamed("source", "s")
    taken = F.col("size") * (F.col("copies") + (F.col("h") < F.col("cut")).cast("int"))
    return placed.join(cuts, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source")


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, most=MOST_COPIES, seed=SEED) -> DataFrame:
    """The mixed corpus: each document's row as often as the mix takes it, columns unchanged."""
    placed = stored(_placed(docs, id_col, text_col, source_col, seed), "mix-sizes")
    cuts = thresholds(placed, weights, most).select(F.col("source").alias("__s"), F.col("copies").alias("__copies"), F.col("cut").alias("__cut"))
    joined = docs.join(cuts, docs[source_col].eqNullSafe(cuts["__s"]))
    times = F.col("__copies") + (position(docs[id_col], seed) < F.col("__cut")).cast("int")
    return joined.withColumn("__time", F.explode(F.array_repeat(F.lit(1), times))).select(*[docs[c] for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS cap FROM s),
u AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS unit
      FROM w WINDOW p AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, (max(unit) OVER ()) * w) AS target FROM u),
c AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
r AS (SELECT d.*, source_size, target, copies, target - copies * source_size AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
             sum(size) OVER (PARTITION BY d.source, h) AS words
      FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target, CAST(size * (copies + CASE WHEN upto <= rest OR upto - rest < rest - (upto - words) THEN 1 ELSE 0 END) AS BIGINT) AS taken, source
FROM r
"""
