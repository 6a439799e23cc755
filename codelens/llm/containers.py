"""Problem 8: documents, measured in tokens, put into containers with little unused space.

Variable-capacity best fit: the histogram of lengths is packed on the driver (at most
2,048 lengths, so its size does not depend on the data), longest first. A length goes
where it leaves the least space; where it fits nowhere, containers are opened of the
permitted capacity that costs least for what can still be put into it. Documents then take
the places of their length by rank. In the end each container gets the smallest permitted
capacity that holds its contents."""

from __future__ import annotations

import base64
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelens.corpus import table

CAPACITY = 2048
#: Permitted capacities; CAPACITY is the largest.
CAPACITIES = (256, 512, 1024, CAPACITY)
#: What a container costs beside its capacity, in tokens.
OVERHEAD = 32
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Parts that documents of one length are ranked in, since a third of all may have the same.
PARTS = 32


def tokenizer(vocabulary: str = VOCABULARY):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame) -> DataFrame:
    """(doc_id, tokens); null and empty texts have 0."""

    def count(batches):
        encoding = tokenizer()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": [len(encoding.encode_ordinary(t)) if t else 0 for t in b["text"]]})

    return documents.select("doc_id", "text").mapInPandas(count, "doc_id bigint, tokens bigint")


def least_cost(length: int, left: int, after: int) -> int:
    """The capacity to open for so many pieces of a length, with so many tokens of shorter ones to come: least cost per token that it may hold."""

    def cost(capacity: int) -> float:
        own = min(left, capacity // length) * length
        return (capacity + OVERHEAD) / (own + min(capacity - own, after))

    return min((c for c in CAPACITIES if c >= length), key=lambda c: (cost(c), -c))


def best_fit(lengths: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """lengths: how many pieces have a length. Containers with the same space left go together.

    Returns (length, first rank, pieces, first container): the pieces of that length with these ranks go into containers numbered on from the first."""
    spaces: list[int] = []  # sorted
    ranges: dict[int, list[tuple[int, int]]] = {}  # of containers, by the space left in them
    slots: list[tuple[int, int, int, int]] = []
    opened = 0
    after = sum(k * n for k, n in lengths.items())

    def put(space: int, first: int, n: int) -> None:
        if space not in ranges:
            ranges[space] = []
            insort(spaces, space)
        ranges[space].append((first, n))

    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        after -= length * left
        while left:
            k = bisect_left(spaces, length)
            if k == len(spaces):
                capacity = least_cost(max(1, length), left, after)
                n = -(-left // (capacity // max(1, length)))
                put(capacity, opened, n)
                opened += n
                continue
            space = spaces[k]
            first, n = ranges[space].pop()
            if not ranges[space]:
                del ranges[space], spaces[k]
            take = n if not length else min(n, left)
            if not length:  # takes no space: all in one
                slots.append((0, rank, left, first))
                put(space, first, n)
                break
            slots.append((length, rank, take, first))
            put(space - length, first, take)
            if n > take:
                put(space, first + take, n - take)
            rank, left = rank + take, left - take
    return slots


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, piece, tokens, container, capacity, used): a document longer than a container fills some alone, its rest is put as a document is."""
    counts = token_counts(table(spark, sf_dir, "documents")).persist()
    full = F.when(F.col("tokens") <= CAPACITY, 0).otherwise(F.floor(F.col("tokens") / CAPACITY)).cast("int")
    rest = counts.select("doc_id", full.alias("piece"), (F.col("tokens") - full * CAPACITY).alias("tokens"), F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part")).where("tokens > 0 or piece = 0")
    histogram = rest.groupBy("tokens", "part").agg(F.count("*").alias("n")).collect()  # at most (CAPACITY + 1) * PARTS rows
    lengths: dict[int, int] = {}
    offsets = []
    for tokens, part, n in sorted((int(r.tokens), r.part, r.n) for r in histogram):
        offsets.append((tokens, part, lengths.get(tokens, 0)))
        lengths[tokens] = lengths.get(tokens, 0) + n
    slots = best_fit(lengths)
    places = spark.createDataFrame(slots or [(0, 0, 0, 0)], "tokens bigint, begin bigint, n bigint, first bigint")
    before = spark.createDataFrame(offsets or [(0, 0, 0)], "tokens bigint, part bigint, before bigint")
    ranked = rest.withColumn("nth", F.row_number().over(Window.partitionBy("tokens", "part").orderBy("doc_id")) - 1)
    ranked = ranked.join(F.broadcast(before), ["tokens", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    # slots of a length have ranges of ranks that follow each other: its array is searched, so that a row meets one slot only
    by_length = places.groupBy("tokens").agg(F.array_sort(F.collect_list(F.struct("begin", "n", "first"))).alias("slots"))
    slot = F.get(F.filter("slots", lambda s: (F.col("rank") >= s["begin"]) & (F.col("rank") < s["begin"] + s["n"])), F.lit(0))
    put = ranked.join(F.broadcast(by_length), "tokens").withColumn("slot", slot)
    number = F.when(F.col("tokens") == 0, F.col("slot.first")).otherwise(F.col("slot.first") + F.col("rank") - F.col("slot.begin"))
    put = put.select("doc_id", "piece", "tokens", number.alias("number"))
    used = put.where("tokens > 0").groupBy("number").agg(F.sum("tokens").alias("used"))
    put = put.join(used, "number", "left").select("doc_id", "piece", "tokens", F.concat(F.lit("c"), F.col("number").cast("string")).alias("container"), F.coalesce("used", F.lit(0)).alias("used"))
    alone = counts.where(full > 0).select("doc_id", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"), F.lit(CAPACITY).cast("bigint").alias("tokens"))
    alone = alone.withColumn("container", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("."), F.col("piece").cast("string"))).withColumn("used", F.col("tokens"))
    smallest = F.lit(CAPACITY)
    for c in sorted(CAPACITIES, reverse=True):
        smallest = F.when(F.col("used") <= c, c).otherwise(smallest)
    return put.unionByName(alone).withColumn("capacity", smallest)
