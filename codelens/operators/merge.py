"""Boolean operators on results that are already tables: (doc_id, start, end), one row per span.

Search itself needs none of these (codelens.plans.search); they join results from elsewhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def all_of(*parts: DataFrame) -> DataFrame:
    """Spans of the documents that every part has."""
    tagged = [p.select("doc_id", "start", "end", F.lit(1 << i).cast("bigint").alias("part")) for i, p in enumerate(parts)]
    every = reduce(DataFrame.unionByName, tagged)
    in_all = every.groupBy("doc_id").agg(F.bit_or("part").alias("parts")).where(F.col("parts") == (1 << len(parts)) - 1)
    return every.join(in_all, "doc_id", "left_semi").select("doc_id", "start", "end").distinct()


def any_of(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select("doc_id", "start", "end") for p in parts]).distinct()


def without(part: DataFrame, *negated: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b.select("doc_id"), "doc_id", "left_anti"), negated, part)


def within(part: DataFrame, docs: DataFrame) -> DataFrame:
    """The part in given documents only."""
    return part.join(docs.select("doc_id"), "doc_id", "left_semi")


def complement(docs: DataFrame, *negated: DataFrame) -> DataFrame:
    """Documents that no part has: -a AND -b is -(a OR b)."""
    return docs.join(reduce(DataFrame.unionByName, [n.select("doc_id") for n in negated]), "doc_id", "left_anti")


def coalesce_spans(spans: DataFrame) -> DataFrame:
    """Spans that overlap or touch become one. Spans with end before start are an error of the caller and dropped."""
    by_doc = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    islands = spans.where("start < end").select("doc_id", "start", "end", new.alias("new"))
    islands = islands.withColumn("island", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
