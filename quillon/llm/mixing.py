"""Mixing sources to target weights with hash-threshold histograms.

Every document has a hash of its doc_id, uniform over 60 bits, and a number of tokens: its runs
of characters other than space, tab, newline, carriage return and form feed. A source's budget
is its weight's share of a total; the total is the most that all sources of positive weight can
give without repetition, times each of ``shares``. Budgets of rising shares are nested: a
document kept under a small one is kept under each larger one.

No sort: tokens are summed by source and the hash's top bits; running sums over that small
histogram find the bucket in which each budget ends. Only the documents in these boundary
buckets are summed again, by the next bits, twice more, and last by the whole hash, which gives
the exact threshold: the largest hash up to which a source's documents fit its budget. The
documents are then filtered by one comparison. (source, hash, tokens) is written to the shared
folder once, so texts are read once to count and once to filter.

Edge cases. A null source is a source of its own. Null texts have 0 tokens, as have empty ones;
such documents are kept if their hash is below the threshold. Rows with a null doc_id have no
hash and are left out. Repeated rows and others of equal hash are kept or left out together.
Weights default to equal ones for all sources that have tokens; a named source without tokens is
ignored; sources of no weight are left out. With equal weights one tiny source bounds all others; with
``least``, as in the query and the pipeline, a null source and those of fewer tokens than that share of the
mean named source's weigh what they have, so they are taken whole and bound no other. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import storage

_BITS = 60
_STEP = 12


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f]+")), F.lit(0)).cast("long")


def place(doc_id: Column, seed: str) -> Column:
    """The first 60 bits of the md5 of seed and id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), doc_id.cast("string"))), 1, 15), 16, 10).cast("long")


def _by_availability(totals: DataFrame, least: float) -> DataFrame:
    """(__source, total, w, full): 1 for each named source of at least ``least`` of the mean named source's tokens; else what it has of the least of those, 1 at most."""
    named = totals.where("__source <> ''")
    full = named.crossJoin(named.agg(F.avg("total").alias("mean"))).where(F.col("total") >= least * F.col("mean"))
    unit = full.agg(F.min("total").alias("full_unit"))
    # Without any named source the null source is all there is.
    t = totals.crossJoin(unit).withColumn("full", (F.col("__source") != "") & (F.col("total") >= F.col("full_unit")))
    return t.select("__source", "total", F.when(F.col("full") | F.col("full_unit").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.col("total") / F.col("full_unit"))).alias("w"), (F.col("full") | F.col("full_unit").isNull()).alias("full"))


def thresholds(counted: DataFrame, weights: dict[str, float] | None, shares: tuple[float, ...], least: float = 0.0) -> DataFrame:
    """(__source, share, below): each source's documents of hash under ``below`` fit its budget. ``counted`` has __source, __hash, __tokens."""
    spark = counted.sparkSession
    shift = _BITS - _STEP
    counts = storage.keep(counted.groupBy("__source", F.shiftright("__hash", shift).alias("bucket")).agg(F.sum("__tokens").alias("t")), "histogram")
    totals = counts.groupBy("__source").agg(F.sum("t").alias("total")).where("total > 0")
    if weights is None and least:
        totals = _by_availability(totals, least)
    elif weights is None:
        totals = totals.withColumn("w", F.lit(1.0))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items() if v > 0], "name string, w double")
        totals = totals.join(given, F.col("__source").eqNullSafe(F.col("name"))).drop("name")
    limit = (totals.where("full") if "full" in totals.columns else totals).agg(F.min(F.col("total") / F.col("w")).alias("unit"))
    budgets = totals.crossJoin(limit).select("__source", F.explode(F.array(*(F.struct(F.lit(float(s)).alias("share"), F.floor(F.col("w") * F.col("unit") * s + 1e-6).alias("budget")) for s in shares))).alias("b")).select("__source", "b.*")
    # pending: the budgets whose end is still sought, with what is spent before the bucket ``at`` of the last level.
    pending = storage.keep(budgets.select("__source", "share", "budget", F.lit(0).cast("long").alias("spent"), F.lit(None).cast("long").alias("at")), "budgets")
    found = None
    level = counts.select("__source", F.lit(None).cast("long").alias("within"), "bucket", "t")
    while True:
        run = Window.partitionBy("__source", "within").orderBy("bucket")
        cumulated = level.withColumn("till", F.sum("t").over(run)).withColumn("last", F.lead("bucket").over(run).isNull())
        p = pending.alias("p").join(cumulated.alias("c"), F.col("p.__source").eqNullSafe(F.col("c.__source")) & F.col("p.at").eqNullSafe(F.col("c.within")))
        over = p.where(F.col("spent") + F.col("till") > F.col("budget"))
        best = over.groupBy("p.__source", "share").agg(F.min_by(F.struct("bucket", "t", "till", "spent", "budget"), "bucket").alias("e"))
        ends = storage.keep(pending.alias("p").join(best.alias("e"), F.col("p.__source").eqNullSafe(F.col("e.__source")) & (F.col("p.share") == F.col("e.share")), "left").select("p.*", F.col("e.e").alias("e")), "ends")
        # A budget that no bucket oversteps takes all of the range that it was refined to.
        whole = ends.where("e IS NULL").select("__source", "share", F.coalesce(F.shiftleft(F.col("at") + 1, shift if shift == _BITS - _STEP else shift + _STEP), F.lit(1 << _BITS)).alias("below"))
        if not shift:
            done = whole.union(ends.where("e IS NOT NULL").select("__source", "share", F.col("e.bucket").alias("below")))
            return storage.keep(done if found is None else found.union(done), "thresholds")
        found = whole if found is None else found.union(whole)
        pending = storage.keep(ends.where("e IS NOT NULL").select("__source", "share", "budget", (F.col("spent") + F.col("e.till") - F.col("e.t")).alias("spent"), F.col("e.bucket").alias("at")), "pending")
        edge = pending.select("__source", "at").distinct().alias("b")
        upper = shift
        shift = shift - _STEP if shift > _BITS - 3 * _STEP else 0
        boundary = counted.alias("d").join(edge, F.col("d.__source").eqNullSafe(F.col("b.__source")) & (F.shiftright("__hash", upper) == F.col("at")))
        level = storage.keep(boundary.groupBy("d.__source", F.col("at").alias("within"), F.shiftright("__hash", shift).alias("bucket")).agg(F.sum("__tokens").alias("t")), "refined")


def _counted(docs: DataFrame, seed: str) -> DataFrame:
    # The source is prefixed so that null is a value that joins and broadcasts like any other.
    return storage.keep(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("__id"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("__source"), place(F.col("doc_id"), seed).alias("__hash"), tokens(F.col("text")).alias("__tokens")), "counted")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, shares: tuple[float, ...] = (0.25, 0.5, 1.0), seed: str = "mix", least: float = 0.0) -> DataFrame:
    """(doc_id, source, n_tokens, share): the documents kept under the largest share, with the least share that keeps each."""
    counted = _counted(docs, seed)
    named = None if weights is None else {f"={k}": v for k, v in weights.items()}
    ends = thresholds(counted, named, shares, least).groupBy("__source").agg(F.array_sort(F.collect_list(F.struct("share", "below"))).alias("ends"))
    fit = F.filter("ends", lambda e: F.col("__hash") < e["below"])
    kept = counted.join(ends, "__source").withColumn("fit", fit).where(F.size("fit") > 0)
    return kept.select(F.col("__id").alias("doc_id"), F.expr("CASE WHEN __source <> '' THEN substring(__source, 2) END").alias("source"), F.col("__tokens").alias("n_tokens"), F.col("fit")[0]["share"].alias("share"))


def keep_mixed(docs: DataFrame, weights: dict[str, float] | None = None, share: float = 1.0, seed: str = "mix", least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` that the mixture at one share keeps."""
    named = None if weights is None else {f"={k}": v for k, v in weights.items()}
    s, below = storage.fresh(docs, "__s", "__below")
    ends = thresholds(_counted(docs, seed), named, (share,), least).select(F.col("__source").alias(s), F.col("below").alias(below))
    key = F.coalesce(F.concat(F.lit("="), docs["source"]), F.lit(""))
    own = storage.same_columns(docs)
    return docs.join(ends, key == F.col(s)).where(place(F.col("doc_id"), seed) < F.col(below)).select(own)


def mix_sql(shares: tuple[float, ...] = (0.25, 0.5, 1.0), seed: str = "mix", docs: str = "documents") -> str:
    """DuckDB SQL for :func:`mix` with equal weights: running sums over the sorted hashes."""
    least = "LEAST(" + ", ".join(f"CASE WHEN fits_{k} THEN {float(s)} END" for k, s in enumerate(shares)) + ")"
    fits = ", ".join(f"till <= floor(unit * {float(s)} + 1e-6) AS fits_{k}" for k, s in enumerate(shares))
    return f"""
WITH counted AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS src,
         ('0x' || substr(md5('{seed}:' || doc_id), 1, 15))::BIGINT AS h,
         coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0)::BIGINT AS n_tokens
  FROM {docs} WHERE doc_id IS NOT NULL),
totals AS (SELECT src, sum(n_tokens) AS total FROM counted GROUP BY src HAVING sum(n_tokens) > 0),
unit AS (SELECT min(total / 1.0::DOUBLE) AS unit FROM totals),
running AS (
  SELECT doc_id, source, n_tokens, unit,
         sum(n_tokens) OVER (PARTITION BY src ORDER BY h RANGE UNBOUNDED PRECEDING) AS till
  FROM counted JOIN totals USING (src), unit),
judged AS (SELECT doc_id, source, n_tokens, {fits} FROM running)
SELECT doc_id, source, n_tokens, {least}::DOUBLE AS share FROM judged WHERE {" OR ".join(f"fits_{k}" for k in range(len(shares)))}"""
