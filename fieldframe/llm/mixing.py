"""Mixing sources to target weights with DataFrame functions only.

Words are counted per source; every source gets its share of all words by weight, at most a stated
multiple of its own size; a document is emitted floor(rate) times, plus once more with the
fraction as probability, drawn from a hash of the seed and doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.session import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Target words of each source of a table (source, source_size).

    Sources by code point, null last, take the weights in turn. All words are shared by weight;
    a target stops at ``most`` times its source's size and the excess is reshared by weight: sources
    with the least size per weight are full first, so one running sum over sources tells which are.
    The tables here have one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("weight", F.get(table, (F.row_number().over(by_name) - 1) % len(weights)).cast("long"))
    cap = F.col("source_size") * most
    per_weight = cap / F.col("weight")
    filling = Window.orderBy(per_weight, F.col("source").asc_nulls_last())
    fuller = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(cap).over(fuller), F.lit(0))
    share = ranked.withColumn("left", left).withColumn("open", F.sum("weight").over(rest))
    # full: with all sources after it still open, its equal share per weight is at least its cap
    full = share.withColumn("full", F.col("left") * F.col("weight") >= cap * F.col("open"))
    level = F.first(F.when(~F.col("full"), F.struct("left", "open")), ignorenulls=True).over(
        filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("full"), cap.cast("double")).otherwise(
        (level["left"] * F.col("weight")).cast("double") / level["open"].cast("double"))
    return full.withColumn("target", F.coalesce(target, F.lit(0.0))).select("source", "source_size", "target")


def copies(rate: Column, doc_id: Column, seed: str) -> Column:
    """floor(rate), plus one with the fraction as probability; the draw is a hash of seed and doc_id."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    whole = F.floor(rate)
    return (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix-") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of docs (doc_id, text, source).

    A null or blank text has size 0 and takes its source's rate like any other row; a source
    without words has target and rate 0. Rows that repeat a doc_id are separate rows with the same
    draw; a null doc_id has one fixed draw. Null is a source of its own. Other columns are ignored.
    """
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sized.withColumnRenamed("source", "own").join(targets, F.col("own").eqNullSafe(F.col("source")))
    return joined.select("doc_id", "source", "size", "source_size", "target", copies(rate, F.col("doc_id"), seed).alias("copies"))


def emit_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix-") -> DataFrame:
    """docs with each row repeated as often as the mix takes it; the columns stay as they are."""
    sized = docs.select("source", word_count(F.col("text")).alias("size"))
    targets = materialize(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    rate = targets.select(F.col("source").alias("_source"),
                          F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_rate"))
    taken = docs.join(rate, docs["source"].eqNullSafe(F.col("_source"))).withColumn("_copies", copies(F.col("_rate"), docs["doc_id"], seed))
    return taken.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(
        *[docs[c] for c in docs.columns])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM src),
c AS (
  SELECT *, source_size * 3 AS cap,
    (SELECT sum(source_size) FROM src)::BIGINT
      - coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3.0::DOUBLE / weight, source NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS room,
    sum(weight) OVER (ORDER BY source_size * 3.0::DOUBLE / weight, source NULLS LAST
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open
  FROM w),
f AS (SELECT *, room * weight >= cap * open AS full_up FROM c),
lv AS (SELECT room, open FROM f WHERE NOT full_up ORDER BY source_size * 3.0::DOUBLE / weight, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size,
    CASE WHEN full_up THEN cap::DOUBLE
         ELSE ((SELECT room FROM lv) * weight)::DOUBLE / (SELECT open FROM lv)::DOUBLE END AS target
  FROM f),
r AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix-' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
