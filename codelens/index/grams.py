"""Positional index of the grams (1 to 3 characters) of texts, and searches through it.

A gram with a space is not indexed; tabs and line ends are. Grams are folded (ASCII
letters in lower case) on both sides. Places are bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.functions import text as T
from codelens.query.tree import QueryError


def explode_grams(texts: DataFrame, text: str, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Replaces a column by gram and at, a row for each character and size, in linear time.

    Characters and their places are columns of their own, so that a lambda reads them by index and does not make them again."""
    kept = [c for c in texts.columns if c != text]
    c = T.fold(text)
    # a character begins at each byte that continues none
    begins = F.array_compact(F.transform(F.split(T.byte_chars(c), ""), lambda x, i: F.when((x != "") & ~x.between("\x80", "\xbf"), i)))
    plain = F.octet_length(c) == F.length(c)
    starts = F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.array().cast("array<int>")).when(plain, F.sequence(F.lit(0), F.length(c) - 1)).otherwise(begins)
    cut = texts.select(*kept, F.split(c, "").alias("_chars"), starts.alias("_starts"))
    at = lambda i, k: F.get("_chars", i + k)
    gram = lambda i, n: at(i, 0) if n == 1 else F.concat(*[at(i, k) for k in range(n)])
    each = F.transform("_starts", lambda s, i: F.array(*[F.struct(F.when(F.coalesce(at(i, n - 1), F.lit("")) != "", gram(i, n)).alias("gram"), s.alias("at")) for n in sizes]))
    found = cut.select(*kept, F.inline(F.flatten(each)))
    return found.where(F.col("gram").isNotNull() & ~F.contains("gram", F.lit(" ")) & ~F.contains("gram", F.lit("\x00")))


def build(docs: DataFrame, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """docs (doc_id, content) to postings (gram, doc_id, locations).

    The only shuffle is by (gram, doc_id), which no frequent gram makes uneven: a group is at most one document."""
    g = explode_grams(docs.select("doc_id", "content"), "content", sizes)
    return g.groupBy("gram", "doc_id").agg(F.sort_array(F.collect_list("at")).alias("locations"))


def write(postings: DataFrame, path: str, partitions: int = 64) -> None:
    """Stored in order of gram, so that row groups of other grams are skipped."""
    postings.repartitionByRange(partitions, "gram", "doc_id").sortWithinPartitions("gram", "doc_id").write.mode("overwrite").parquet(path)


def frequencies(postings: DataFrame) -> DataFrame:
    """Documents of each gram."""
    return postings.groupBy("gram").agg(F.count("doc_id").alias("doc_freq"))


def index_bytes(postings: DataFrame) -> DataFrame:
    return postings.agg(F.coalesce(F.sum(F.size("locations") * F.lit(4)), F.lit(0)).cast("bigint").alias("index_bytes"))


def statistics(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: documents, bytes and lines of content, distinct grams, postings, bytes of the index."""
    d = docs.agg(F.count("*").alias("n_documents"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("content_bytes"), F.coalesce(F.sum(T.n_lines("content")), F.lit(0)).alias("n_lines"))
    p = postings.groupBy("gram").agg(F.count("*").alias("n"), F.sum(F.size("locations")).alias("m"))
    p = p.agg(F.count("*").alias("n_grams"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_postings"), (F.coalesce(F.sum("m"), F.lit(0)) * 4).alias("index_bytes"))
    return d.crossJoin(p)  # one row each


def token_grams(token: str) -> list[tuple[int, str]]:
    """(place in bytes, gram) of the longest indexed grams that begin at each character of a folded token."""
    t, out, at = T.fold_str(token), [], 0
    for i, c in enumerate(t):
        gram = t[i : i + min(3, len(t))]
        if len(gram) == min(3, len(t)) and " " not in gram and "\x00" not in gram:
            out.append((at, gram))
        at += len(c.encode())
    return out or [(len(t[:i].encode()), c) for i, c in enumerate(t) if c not in " \x00"]


def rarest_pair(frequencies: DataFrame, token: str) -> list[tuple[int, str]]:
    """The two grams of a token that fewest documents have, in their order; one, if it has no more. At most one row per character of the token is fetched."""
    wanted = token_grams(token)
    if not wanted:
        raise QueryError("token without a gram")
    known = {r.gram: r.doc_freq for r in frequencies.where(F.col("gram").isin([g for _, g in wanted])).collect()}
    first: dict[str, int] = {}
    for at, gram in wanted:
        first.setdefault(gram, at)
    return sorted((at, g) for g, at in sorted(first.items(), key=lambda x: (known.get(x[0], 0), x[0]))[:2])


def one_key(postings: DataFrame, gram: str) -> DataFrame:
    return postings.where(F.col("gram") == gram).select("doc_id", "locations")


def two_keys(postings: DataFrame, first: str, second: str, distance: int) -> DataFrame:
    """Documents that have both grams, the second that many bytes after the first, with the places of the first. Distance 0: places of either."""
    a, b = one_key(postings, first), one_key(postings, second).withColumnRenamed("locations", "others")
    both = a.join(b, "doc_id")
    if distance == 0:
        return both.select("doc_id", F.array_sort(F.array_union("locations", "others")).alias("locations"))
    kept = F.array_intersect("locations", F.transform("others", lambda x: x - distance))
    return both.select("doc_id", F.array_sort(kept).alias("locations")).where(F.size("locations") > 0)


def candidates(postings: DataFrame, frequencies: DataFrame, token: str) -> DataFrame:
    """Documents that may hold a token, with the places where it may begin; what stands there is to be compared."""
    pair = rarest_pair(frequencies, token)
    (at, first), (_, second) = pair[0], pair[-1]
    found = one_key(postings, first) if len(pair) == 1 else two_keys(postings, first, second, pair[1][0] - at)
    begins = F.filter(F.transform("locations", lambda x: x - at), lambda x: x >= 0)
    return found.select("doc_id", begins.alias("locations")).where(F.size("locations") > 0)


def search(docs: DataFrame, postings: DataFrame, frequencies: DataFrame, token: str, case_sensitive: bool = False) -> DataFrame:
    """(doc_id, sections): documents from the index, spans from their content. Same rows as a scan."""
    found = docs.join(candidates(postings, frequencies, token).select("doc_id"), "doc_id", "left_semi")
    spans = T.literal_spans("content", token, case_sensitive)
    return found.select("doc_id", spans.alias("sections")).where(F.size("sections") > 0)


def symbol_grams(located: DataFrame) -> DataFrame:
    """Index of symbols: grams that lie in an occurrence of a symbol. located: doc_id, sym, start."""
    g = explode_grams(located.select("doc_id", "start", "sym"), "sym").select("gram", "doc_id", (F.col("start") + F.col("at")).alias("at"))
    return g.groupBy("gram", "doc_id").agg(F.sort_array(F.collect_set("at")).alias("locations"))


def encode_key(gram: str) -> int:
    """A gram as one number: 21 bits a character. 0 for a gram with a space."""
    if not 1 <= len(gram) <= 3:
        raise ValueError("a gram has 1 to 3 characters")
    points = [ord(c) for c in gram] + [0] * (3 - len(gram))
    return 0 if " " in gram else points[0] << 42 | points[1] << 21 | points[2]


def decode_key(key: int) -> str:
    return "".join(chr(p) for p in (key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF) if p)


def pretty_key(key: int) -> str:
    """decode_key, with control characters spelled out."""
    return decode_key(key).encode("unicode_escape").decode() if any(ord(c) < 32 for c in decode_key(key)) else decode_key(key)


def key_column(gram: Column | str) -> Column:
    """encode_key of a column. Characters beyond Spark's ascii() are read from their UTF-32 bytes."""
    gram = T.col(gram)
    point = lambda i: F.coalesce(F.conv(F.hex(F.encode(F.nullif(F.substring(gram, i, 1), F.lit("")), "UTF-32")), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(F.contains(gram, F.lit(" ")), F.lit(0).cast("bigint")).otherwise(F.shiftleft(point(1), 42).bitwiseOR(F.shiftleft(point(2), 21)).bitwiseOR(point(3)))
