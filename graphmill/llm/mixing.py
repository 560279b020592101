"""Mixing sources to target weights.

Word counts are summed by source, a budget is shared by weight with a ceiling of
``max_rate`` times each source's size, and a document is repeated floor(rate) times plus one
more copy when a hash-seeded draw falls under the fraction. Only DataFrame functions are used.
Windows without a partition run over the totals, one row a source, never over documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.common import WORD_PATTERN, broadcast_if_small, cut


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def draw(key: Column, seed: int) -> Column:
    """Uniform in [0, 1) from the key alone: the first 32 bits of an MD5, equal in every engine."""
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), budget: float = 1.5, max_rate: float = 2.0) -> DataFrame:
    """(source, source_size) -> (source, source_size, target), by water filling in one sorted pass.

    Sources rank by code point with null last and take ``weights`` in turn. A source whose share
    would pass its ceiling stops there and the excess goes to the others by weight; ordered by
    ceiling per weight, the stopped sources are a prefix, so running sums find the level.
    One row per source; an empty input gives none; a total of zero gives targets of zero.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    capped = sizes.select("source", "source_size", weight.alias("w")).withColumn("cap", F.col("source_size") * F.lit(float(max_rate)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(every) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    leveled = capped.withColumn("level", level).withColumn("over", F.col("cap") / F.col("w") >= F.col("level"))
    final = F.min(F.when(F.col("over"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(every)["level"]
    return leveled.select("source", "source_size", F.when(F.col("cap") / F.col("w") < final, F.col("cap")).otherwise(F.coalesce(F.col("w") * final, F.col("cap"))).alias("target"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5, 2, 1), budget: float = 1.5, max_rate: float = 2.0, seed: int = 17, keep: tuple = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, rate, copies, and the columns in ``keep``.

    Null text has size 0; null sources form a source of their own; repeated ids draw alike; a
    source of size 0 has rate 0. Further columns of the input are ignored unless kept. The
    per-source totals are summed before the shuffle and joined back by broadcast only after their
    number has been counted; otherwise Spark joins (and splits hot sources) as it sees fit.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    totals = cut(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, max_rate))
    small = broadcast_if_small(totals.withColumnRenamed("source", "total_source"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    planned = rows.join(small, F.col("source").eqNullSafe(F.col("total_source"))).withColumn("rate", rate)
    whole = F.floor("rate")
    copies = (whole + (draw(F.col("doc_id"), seed) < F.col("rate") - whole).cast("long")).alias("copies")
    return planned.select("doc_id", "size", "source_size", "target", "rate", copies, *[F.col(f"kept_{c}") for c in keep])


def mix(docs: DataFrame, columns: tuple = ("doc_id", "text", "lang", "source", "n_chars"), **options) -> DataFrame:
    """The mixed documents themselves: each row ``copies`` times, with the given columns.

    Rows that repeat an id draw alike, rows without an id draw as one id; null and wordless texts
    follow their source's rate, and all rows of a source without words are left out. An empty table
    gives no rows.
    """
    planned = plan_mix(docs, keep=columns, **options).where("copies > 0")
    repeated = planned.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*[F.col(f"kept_{c}").alias(c) for c in columns])
