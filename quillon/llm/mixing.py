"""Mixing sources to target weights by Poisson replication.

A source with n rows and weight w gets rate = total * w / n. A document's number of copies is the inverse of the Poisson distribution with
its source's rate at a uniform number from a hash of seed and doc_id, so a run can be repeated and no state is kept. Copies are then dealt
globally by a hash of seed, doc_id and copy.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import fresh, pinned

SEED, ALPHA = 17, 0.5
#: Rate tables up to these sizes are broadcast: rows, and numbers in all their distributions.
MOST_SOURCES, MOST_NUMBERS = 10_000, 1_000_000


def _number(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def _key(seed: int, *parts: Column) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def identity(docs: DataFrame) -> Column:
    """What a row's numbers are drawn by: its doc_id, or without one a hash of its text."""
    return F.coalesce(docs["doc_id"].cast("string"), F.md5(docs["text"].cast("string")))


def uniform(doc_id: Column, seed: int = SEED) -> Column:
    """From 0 to below 1, of 52 bits."""
    return _number(_key(seed, doc_id), 13).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, alpha: float = ALPHA, total: float | None = None) -> DataFrame:
    """(source, rows, rate): a row for each source with a weight above 0.

    weights: target shares by source, scaled to a sum of 1 over the sources that are there; sources not named get none. Without weights a
    source's share is in proportion to its rows to the power alpha. total: rows to aim at, by default as many as there are.
    """
    counts = pinned(docs.groupBy("source").agg(F.count("*").alias("rows")))
    if weights is None:
        weighted = counts.withColumn("w", F.pow(F.col("rows").cast("double"), F.lit(float(alpha))))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights can't be negative")
        named = counts.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "s string, w double")
        weighted = counts.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("s"))).drop("s")  # as many rows as the parameter names
    weighted = weighted.where("w > 0")
    rows, sum_w = counts.agg(F.sum("rows")).first()[0] or 0, weighted.agg(F.sum("w")).first()[0] or 1.0
    goal = float(rows if total is None else total)
    return weighted.select("source", "rows", (F.lit(goal) * F.col("w") / F.lit(float(sum_w)) / F.col("rows")).alias("rate")).where("rate > 0")


def distributions(rate_table: DataFrame) -> DataFrame:
    """(source, cdf): the Poisson distribution of each rate, up to where its tail is below the numbers' precision."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30)
    each = rate_table.select("source", "rate", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("k"))
    by_k = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.ln(F.col("rate") / F.col("k")))
    p = each.withColumn("p", F.exp(F.sum(step).over(by_k))).withColumn("c", F.sum("p").over(by_k))
    pairs = F.array_sort(F.collect_list(F.struct("k", "c")))
    return p.groupBy("source").agg(F.transform(pairs, lambda x: x["c"]).alias("cdf"))


def mix(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, alpha: float = ALPHA, total: float | None = None, seed: int = SEED,
    copy: str = "copy", copies: str = "n_copies", shuffle_key: str = "shuffle_key",
) -> DataFrame:
    """Every copy of every document, in a global shuffle: docs' columns, copy (from 1), n_copies and shuffle_key (both int, long).

    NULL is a source of its own. Rows with the same doc_id get the same number of copies if their source is the same; rows without doc_id go by
    their text instead. Texts of any length, empty or NULL, are only carried. Input columns with the names of the new ones are replaced. The
    distributions are broadcast within MOST_SOURCES and MOST_NUMBERS; beyond, Spark joins by source and splits hot sources.
    """
    table = pinned(distributions(rates(docs, weights, alpha, total)))
    n, numbers = table.agg(F.count("*"), F.coalesce(F.sum(F.size("cdf")), F.lit(0))).first()
    small = n <= MOST_SOURCES and numbers <= MOST_NUMBERS
    source, cdf = fresh(docs, "__source"), fresh(docs, "__cdf")
    table = table.select(F.col("source").alias(source), F.col("cdf").alias(cdf))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (copy.lower(), copies.lower(), shuffle_key.lower())]
    joined = docs.join(F.broadcast(table) if small else table, docs["source"].eqNullSafe(table[source]))
    u, own = uniform(identity(docs), seed), fresh(docs, "__own")
    drawn = joined.select(*kept, identity(docs).alias(own), F.size(F.filter(F.col(cdf), lambda c: c <= u)).alias(copies)).where(F.col(copies) > 0)
    out = drawn.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    out = out.withColumn(shuffle_key, _number(_key(seed, F.col(own), F.col(copy)), 15)).drop(own)
    return out.repartition(F.col(shuffle_key)).sortWithinPartitions(shuffle_key)


#: The same rows for DuckDB, with production parameters.
SQL = f"""WITH counts AS (SELECT source, COUNT(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (SELECT SUM(n) FROM counts)::DOUBLE * POWER(n::DOUBLE, {ALPHA}) / (SELECT SUM(POWER(n::DOUBLE, {ALPHA})) FROM counts) / n AS rate FROM counts),
p AS (SELECT source, k, EXP(SUM(CASE WHEN k = 0 THEN -rate ELSE LN(rate / k) END) OVER (PARTITION BY source ORDER BY k)) AS p
      FROM (SELECT source, rate, UNNEST(range(0, CAST(CEIL(rate + 12 * SQRT(rate) + 30) AS BIGINT) + 1)) AS k FROM r)),
c AS (SELECT source, list(c ORDER BY k) AS cdf FROM (SELECT source, k, SUM(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p) GROUP BY source),
d AS (SELECT documents.*, cdf, CAST('0x' || substr(md5('{SEED}|' || COALESCE(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
      FROM documents JOIN c ON documents.source IS NOT DISTINCT FROM c.source),
e AS (SELECT * EXCLUDE (cdf, u), CAST(len(list_filter(cdf, lambda x: x <= u)) AS INTEGER) AS n_copies FROM d)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy,
       CAST('0x' || substr(md5('{SEED}|' || COALESCE(CAST(doc_id AS VARCHAR), md5(text), '') || '|' || copy), 1, 15) AS BIGINT) AS shuffle_key
FROM (SELECT *, UNNEST(CAST(range(1, n_copies + 1) AS INTEGER[])) AS copy FROM e)"""
