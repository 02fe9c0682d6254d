"""Mixing sources to target weights by a time-varying curriculum; DataFrame functions only.

Every source has a weight and a schedule of that weight over training time 0..1. The schedule's integral
gives the source's share of all words; no source gives more than ``max_epochs`` times what it has, the
excess goes to the others by weight (water filling over the sources sorted by the level at which each is
full). Each source's documents, in the order of a hash of their ids and repeated epoch after epoch, form a
stream of words; the mix takes the stream's first ``target`` words. A copy that starts at word u of its
stream is trained at the time t at which the source's cumulative demand reaches u (inverse of the
integrated schedule); documents are range-sorted by that position.

Defined cases: a null text has size 0 and is taken 0 words; a null source is a source of its own, last in
order; a null doc_id is ordered as the word ``null``; repeated rows are separate documents; equal hashes are
ordered by size, then by a hash of the text, so that a task that is run again deals the same copies; an empty
table gives an empty result; other columns, whatever their names, stay inside ``row``. A source without words
gets target 0.

Skew: the prefix sums inside a source are taken in two levels, over ``2^bits`` hash buckets of each source,
so that a source with a third of all rows is spread over all tasks; only one row for each (source, bucket)
is windowed by source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import materialize, n_words, require

#: Relative weight over training time as (time, level) knots, linear between them; one for each weight class.
#: The first class fades out, the others fade in; each integrates to 1, so the shares are the weights.
RAMPS: tuple[tuple[tuple[float, float], ...], ...] = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 0.75), (1.0, 1.25)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
WEIGHTS = (5.0, 2.0, 1.0)
#: 16^HEX_DIGITS hash buckets of each source.
HEX_DIGITS = 3


def integral(knots: Sequence[tuple[float, float]]) -> float:
    return sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:]))


def check_schedule(knots: Sequence[tuple[float, float]]) -> None:
    times = [t for t, _ in knots]
    if len(knots) < 2 or times[0] != 0 or times[-1] != 1 or any(x >= y for x, y in zip(times, times[1:])):
        raise ValueError("a schedule's knots go from time 0 to time 1, rising")
    if any(level < 0 for _, level in knots) or integral(knots) <= 0:
        raise ValueError("levels are 0 or more and not all 0")


def demand_time(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Time at which the integrated schedule has reached ``share`` (0..1) of its whole."""
    whole, before, out = integral(knots), 0.0, None
    for (t0, a), (t1, b) in zip(knots, knots[1:]):
        area = (t1 - t0) * (a + b) / 2
        if area > 0:
            left, slope = share * F.lit(whole) - F.lit(before), (b - a) / (t1 - t0)
            if slope == 0:
                t = F.lit(t0) + left / F.lit(a)
            else:
                t = F.lit(t0) + (F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * left, F.lit(0.0))) - F.lit(a)) / F.lit(slope)
            t = F.least(F.greatest(t, F.lit(t0)), F.lit(t1))
            out = F.when(share * F.lit(whole) <= F.lit(before + area), t) if out is None else out.when(share * F.lit(whole) <= F.lit(before + area), t)
            before += area
    return out.otherwise(F.lit(1.0))


def source_targets(sizes: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """(source, source_size, cls, target) for each row of (source, source_size); one row for each source."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("cls", (F.row_number().over(by_name) - 1) % len(weights))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("cls").cast("int") + 1))
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = ranked.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    full = level.withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    full = full.withColumn("water", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole))
    return full.select("source", "source_size", "cls", F.when(F.col("full"), F.col("cap")).otherwise(F.col("water.level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = 3, ramps=RAMPS, whole_documents: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
    """One row for each document: ``row`` (a struct of its columns, or of those in ``keep``), size, source_size,
    target, and ``copies``: an array of (epoch, position, words), empty if the mix doesn't take it.

    whole_documents: a copy is taken wholly if its middle lies before the target, else not at all; otherwise
    the last copy of a source is cut where the target is reached.
    """
    require(docs, "doc_id", "source", "text")
    if not weights or any(w <= 0 for w in weights) or max_epochs < 1:
        raise ValueError("weights are above 0 and max_epochs is 1 or more")
    for knots in ramps:
        check_schedule(knots)
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    base = docs.select(F.struct(*(docs[c] for c in (keep or docs.columns))).alias("row"), F.col("source"), n_words(F.col("text")).alias("size"), h.alias("h"), F.substring(h, 1, HEX_DIGITS).alias("bucket"), F.xxhash64("text").alias("tie"))
    # a key without nulls: windows and the join then share one partitioning, and rows are shuffled once
    base = materialize(base.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))), "mix-base")
    buckets = base.groupBy("key", "source", "bucket").agg(F.sum("size").alias("bucket_size"))
    buckets = materialize(buckets, "mix-buckets")
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    s, t = starts.alias("s"), targets.alias("t")
    s = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select("key", "bucket", "bucket_start", "source_size", "cls", "target")
    inside = W.partitionBy("key", "bucket").orderBy("h", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    j = base.drop("source").withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(s, ["key", "bucket"])
    budget = F.round("target").cast("long")

    def copy(e: Column) -> Column:
        u = e.cast("long") * F.col("source_size") + F.col("bucket_start") + F.col("inside")
        if whole_documents:
            words = F.when(2 * u + F.col("size") <= 2 * budget, F.col("size")).otherwise(F.lit(0))
        else:
            words = F.greatest(F.least(budget - u, F.col("size")), F.lit(0))
        share = u / F.greatest(F.col("target"), F.lit(1.0))
        position = F.lit(1.0)
        for k in range(len(weights)):
            position = F.when(F.col("cls") == k, demand_time(share, ramps[k % len(ramps)])).otherwise(position)
        return F.struct(e.alias("epoch"), position.alias("position"), words.cast("long").alias("words"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), copy), lambda c: c["words"] > 0)
    return j.select("row", "size", "source_size", "target", copies.alias("copies"))


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    return _hashable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def training_order(mixed: DataFrame) -> DataFrame:
    """The taken copies as rows (row, epoch, position, words), range-sorted by training position.

    Equal positions are ordered by a hash of the row's columns, those that hold maps left out.
    """
    columns = [F.col("row").getField(f.name) for f in mixed.schema["row"].dataType if _hashable(f.dataType)]
    return mixed.select("row", F.explode("copies").alias("c")).select("row", "c.*").orderBy("position", "epoch", F.xxhash64(*columns))


def op1_mixing(spark, sf_dir):
    """doc_id, size, source_size, target, taken for every document, range-sorted by its first position."""
    from siftwell.llm.common import table

    mixed = mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    out = mixed.select("row.doc_id", "size", "source_size", F.round("target", 6).alias("target"), taken.alias("taken"), F.round(F.get("copies", F.lit(0))["position"], 9).alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id").drop("position")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  md5(coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
f AS (SELECT *, cap <= lev * w AS fullup FROM l),
t AS (SELECT source, source_size, CASE WHEN fullup THEN cap ELSE w * (SELECT arg_min(lev, cap / w) FROM f WHERE NOT fullup) END AS target FROM f),
c AS (SELECT doc_id, size, source_size, target, round(target)::BIGINT AS budget,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (greatest(least(budget - u, size), 0) + greatest(least(budget - u - source_size, size), 0) + greatest(least(budget - u - 2 * source_size, size), 0))::BIGINT AS taken FROM c
"""
