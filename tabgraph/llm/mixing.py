"""Operator 3: mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgraph.runtime import ranked

from .common import free, load, written

WEIGHTS, SHARE, MOST, DRAWS = (5, 2, 1), 1.5, 2, 32
#: Rates of up to so many sources (a few dozen bytes each) are broadcast.
BROADCAST_SOURCES = 50_000


def size_of(text: Column) -> Column:
    """Number of words: runs of what is not \\x20 or \\x09 to \\x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, k: int) -> Column:
    """The k-th uniform number in [0, 1) of a document: 32 bits of a SHA-256 of its id."""
    digest = F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{k // 8}")), 256)
    return F.conv(F.substring(digest, 8 * (k % 8) + 1, 8), 16, 10).cast("double") / 2.0**32


def targets(spark: SparkSession, sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, source_size) with their weight and target.

    Sources by code point, null last, weigh `weights` in turn. Targets share share * all sizes by weight; one above
    most * its source's size stops there, and what is above is shared anew by weight until none is above. Each round is
    one aggregation of two sums, so any number of sources is handled without gathering them.
    """
    place = ranked(spark, sources, [F.col("source").asc_nulls_last()], "__place", 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("__place") - 1) % len(weights) + 1).cast("int"))
    s = written(spark, place.select("source", "source_size", weight.alias("weight")), "sources")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    goal, full, level, cap = share * total, F.lit(False), None, most * F.col("source_size")
    while True:
        r = s.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).cast("double").alias("at"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("w")).first()
        if r.w == 0:
            return s.withColumn("target", cap.cast("double"))
        now = (r.at, r.w)
        wanted = (F.lit(goal) - F.lit(r.at)) * F.col("weight") / F.lit(r.w)
        if now == level:
            return s.withColumn("target", F.when(full, cap.cast("double")).otherwise(wanted))
        level, full = now, full | (wanted > cap)


def repetition(spark: SparkSession, sized: DataFrame, draws: int = DRAWS) -> DataFrame:
    """(__source, source_size, target, whole, rest, seed): how often each source of `sized` (doc_id, source, size) is taken.

    A source's repetition rate is target / source_size, in whole and rest. Of `draws` seeds, each source uses the one
    whose taken words come nearest its target (the first of equals), which a single aggregation with partial sums
    finds, however large the source.
    """
    rates = targets(spark, sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    rates = rates.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rates = written(spark, rates.withColumn("whole", F.floor("rate")).withColumn("rest", F.col("rate") - F.col("whole")).withColumnRenamed("source", "__source"), "rates")
    sums = by_source(sized, rates).groupBy("__source").agg(F.first("whole").alias("whole"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), *(F.sum(F.when(draw(F.col("doc_id"), k) < F.col("rest"), F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(draws)))
    off = F.array(*(F.struct(F.abs(F.col("whole") * F.col("source_size") + F.col(f"s{k}") - F.col("target")).alias("off"), F.lit(k).alias("seed")) for k in range(draws)))
    seeds = sums.select(F.col("__source").alias("__seeded"), F.array_min(off)["seed"].alias("seed"))
    return written(spark, rates.join(seeds, F.col("__source").eqNullSafe(F.col("__seeded"))).select("__source", "source_size", "target", "whole", "rest", "seed"), "seeds")


def by_source(docs: DataFrame, rates: DataFrame, of: str = "__source") -> DataFrame:
    """docs with their source's rates (column `of` and the others): broadcast up to BROADCAST_SOURCES of them, else joined by
    sorting, both sides dealt anew, so that adaptive execution splits a source with very many rows."""
    few = rates.count() <= BROADCAST_SOURCES
    return docs.join(F.broadcast(rates) if few else rates.hint("merge"), docs["source"].eqNullSafe(rates[of]))


def copies(doc_id: Column, draws: int = DRAWS, whole: str = "whole", rest: str = "rest", seed: str = "seed") -> Column:
    """A document's copies: its source's whole rate, and one more if its draw with the source's seed is below the rest."""
    extra = F.coalesce(*(F.when(F.col(seed) == k, draw(doc_id, k) < F.col(rest)) for k in range(draws)))
    return (F.col(whole) + F.when(extra, 1).otherwise(0)).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"))


def plan(spark: SparkSession, docs: DataFrame, draws: int = DRAWS) -> DataFrame:
    """(doc_id, size, source_size, target, copies, source) of each row of docs.

    A document is taken floor(rate) times, and once more if a draw hashed from its id and its source's seed is below the
    rest of the rate. Null texts have size 0, null sources are a source, null ids share their draws, and so do rows with
    the same id; a source without words has target 0 and rate 0. No document is taken more than twice as often as it
    stands there. Repeated rows are taken each; an empty table gives an empty one.
    """
    sized = written(spark, _sized(docs), "sizes")
    return by_source(sized, repetition(spark, sized, draws)).select("doc_id", "size", "source_size", "target", copies(F.col("doc_id"), draws).alias("copies"), "source")


def mixed(spark: SparkSession, docs: DataFrame, draws: int = DRAWS) -> DataFrame:
    """docs with each row as often as `plan` takes it; columns and schema as they were. Texts are never shuffled (but to
    sources beyond BROADCAST_SOURCES): the rates come to the rows."""
    sized = written(spark, _sized(docs), "sizes")
    own = {c: free(docs, f"__{c}") for c in ("of", "whole", "rest", "seed", "copies")}
    r = repetition(spark, sized, draws).select(F.col("__source").alias(own["of"]), *(F.col(c).alias(own[c]) for c in ("whole", "rest", "seed")))
    joined = by_source(docs, r, own["of"])
    n = copies(docs["doc_id"], draws, own["whole"], own["rest"], own["seed"])
    taken = joined.select(*(docs[c] for c in docs.columns), n.cast("int").alias(own["copies"])).where(F.col(own["copies"]) > 0)
    return taken.withColumn(own["copies"], F.explode(F.array_repeat(F.lit(0), F.col(own["copies"])))).drop(own["copies"])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


_DRAWS = ",\n".join(f"('0x' || substr(sha256(coalesce(doc_id::VARCHAR, 'null') || ':{k // 8}'), {8 * (k % 8) + 1}, 8))::BIGINT / 4294967296.0::DOUBLE AS u{k}" for k in range(DRAWS))
_SUMS = ", ".join(f"sum(CASE WHEN u{k} < rest THEN size ELSE 0 END) AS s{k}" for k in range(DRAWS))
_PICK = ", ".join(f"{{'off': abs(whole * source_size + s{k} - target)::DOUBLE, 'seed': {k}}}" for k in range(DRAWS))
ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS k FROM w),
l AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS used,
  sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w, (SELECT 1.5::DOUBLE * sum(size)::DOUBLE FROM d) AS goal FROM o),
c AS (SELECT min(k) AS k FROM l WHERE (goal - used) * weight / left_w <= 2 * source_size),
t AS (SELECT l.source, l.source_size, CASE WHEN l.k < c.k THEN (2 * l.source_size)::DOUBLE ELSE (l.goal - x.used) * l.weight / x.left_w END AS target FROM l, c, l AS x WHERE x.k = c.k),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate FROM t),
r2 AS (SELECT *, floor(rate) AS whole, rate - floor(rate) AS rest FROM r),
u AS (SELECT d.*, r2.* EXCLUDE (source), {_DRAWS} FROM d JOIN r2 ON d.source IS NOT DISTINCT FROM r2.source),
a AS (SELECT source, any_value(whole) AS whole, any_value(source_size) AS source_size, any_value(target) AS target, {_SUMS} FROM u GROUP BY source),
p AS (SELECT source, list_min([{_PICK}]).seed AS seed FROM a)
SELECT u.doc_id, u.size, u.source_size, u.target,
  ((u.whole + CASE WHEN [{", ".join(f"u{k}" for k in range(DRAWS))}][p.seed + 1] < u.rest THEN 1 ELSE 0 END)::BIGINT * u.size)::BIGINT AS taken
FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source
"""
