"""Problem 2: occurrences and documents of every gram of the index, and which are too rare or too common.

Last-seen counters: postings are split by hash of (gram, part of the documents) and put in
order of gram, document and place. One pass over a partition then needs one counter at a
time: occurrences, documents, and the last document and place seen. No set of a gram's
documents is ever held. Parts of a gram have no document in common, so their counters add up."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.corpus import table

RARE_OCCURRENCES, COMMON_SHARE = 2, 0.6
#: Parts that the documents of one gram are spread over, since a gram may be in all of them.
PARTS = 32
COUNTS = "gram string, occurrences bigint, documents bigint"


def last_seen(batches):
    """Rows in order of gram, document and place (nulls first) to (gram, occurrences, documents), a row for each run of a gram in a batch."""
    last = (None, None, None)  # gram, document and place of the last row with a place
    for b in batches:
        if not b.num_rows:
            continue
        gram, doc = b.column("gram").cast(pa.string()), b.column("doc_id").to_numpy(zero_copy_only=False)
        at = pc.fill_null(b.column("at"), -1).to_numpy(zero_copy_only=False)
        new = np.ones(b.num_rows, bool)
        new[1:] = pc.not_equal(gram[1:], gram[:-1]).to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        placed = np.flatnonzero(at >= 0)
        occurs, records = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
        if len(placed):
            r, d, a = run[placed], doc[placed], at[placed]
            fresh_record, fresh = np.ones(len(placed), bool), np.ones(len(placed), bool)
            fresh_record[1:] = (r[1:] != r[:-1]) | (d[1:] != d[:-1])
            fresh[1:] = fresh_record[1:] | (a[1:] != a[:-1])
            if gram[int(placed[0])].as_py() == last[0]:
                fresh_record[0] = d[0] != last[1]
                fresh[0] = fresh_record[0] or a[0] != last[2]
            occurs[placed], records[placed] = fresh, fresh_record
            last = (gram[int(placed[-1])].as_py(), d[-1], a[-1])
        counts = [np.add.reduceat(x, begins) for x in (occurs, records)]
        yield pa.RecordBatch.from_arrays([gram.take(pa.array(begins)), *map(pa.array, counts)], ["gram", "occurrences", "documents"])


def gram_counts(postings: DataFrame) -> DataFrame:
    """(gram, occurrences, documents): a place counts once for a document, however many rows or shards repeat it.

    Rows with a null gram or document are left out; a gram without any place has 0 of both. An empty table gives none."""
    gram = F.translate("gram", ascii_uppercase, ascii_lowercase).alias("gram")
    rows = postings.where("gram is not null and doc_id is not null").select(gram, "doc_id", "locations")
    spread = rows.repartition("gram", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))  # places stay in their arrays until they are there
    ordered = spread.select("gram", "doc_id", F.explode_outer("locations").alias("at")).sortWithinPartitions("gram", "doc_id", "at")
    return ordered.mapInArrow(last_seen, COUNTS).groupBy("gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))


def marked(postings: DataFrame) -> DataFrame:
    """gram_counts with mark: rare, common, or null."""
    docs = postings.agg(F.count_distinct("doc_id")).scalar()
    rare = F.col("occurrences") <= RARE_OCCURRENCES
    common = F.col("documents") >= COMMON_SHARE * docs
    return gram_counts(postings).withColumn("mark", F.when(rare, "rare").when(common, "common"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(table(spark, sf_dir, "postings")).where("mark is not null").select("gram", "mark")


def p2_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gram with its numbers."""
    return marked(table(spark, sf_dir, "postings"))
