"""From matched documents to what is shown: facets, ranks, pages, lines with context and highlights.

matched tables have doc_id, repo_id, language, filename and n_sections. Content is not
among their columns: it is joined back for the documents that are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelens.functions import text as T
from codelens.operators.merge import coalesce_spans


def group_by_repo(matched: DataFrame) -> DataFrame:
    return matched.groupBy("repo_id").agg(F.count("*").alias("n_documents"), F.sum("n_sections").alias("n_sections"))


def facet_by_language(matched: DataFrame) -> DataFrame:
    """Documents without a language are in no facet."""
    facet = matched.where("language is not null and language != ''").groupBy("language").agg(F.count("*").alias("n_documents"), F.sum("n_sections").alias("n_sections"))
    return facet.orderBy(F.desc("n_documents"), F.desc("n_sections"), "language")


def totals(matched: DataFrame) -> DataFrame:
    """Repositories (with the one of documents without any), documents and spans, before anything is cut."""
    by_repo = group_by_repo(matched)  # first by repository: no distinct over the documents
    return by_repo.agg(F.count("*").alias("n_repos"), F.coalesce(F.sum("n_documents"), F.lit(0)).alias("n_documents"), F.coalesce(F.sum("n_sections"), F.lit(0)).alias("n_sections"))


DOCUMENT_ORDER = (F.desc, "n_sections"), (F.asc, "filename"), (F.asc, "doc_id")


def document_order() -> list[Column]:
    return [f(c) for f, c in DOCUMENT_ORDER]


def repo_order() -> list[Column]:
    """Documents without a repository last; then by number of documents, path and id."""
    path = F.coalesce(F.expr("nullif(local_path, '')"), "remote_url")
    return [F.asc(F.col("repo_id") == 0), F.desc("n_documents"), F.asc(path), F.asc("repo_id")]


def rank_repos(matched: DataFrame, repos: DataFrame, order: list[Column] | None = None) -> DataFrame:
    r = repos.select("repo_id", "local_path", "remote_url")
    return group_by_repo(matched).join(r, "repo_id", "left").orderBy(*(order or repo_order()))


def page(ranked: DataFrame, number: int, size: int) -> DataFrame:
    """A page of an ordered table; size 0 or less: all. Spark keeps offset + limit rows of each partition only."""
    return ranked if size <= 0 else ranked.offset(number * size).limit(size)


def top_per_repo(matched: DataFrame, k: int, order: list[Column] | None = None) -> DataFrame:
    """The first k documents of each repository with their rank (from 1); k 0 or less: all.

    Spark cuts to k in every task before the shuffle, so a repository with a third of all documents sends only k from each."""
    ranked = matched.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id").orderBy(*(order or document_order()))))
    return ranked.where(F.col("rank") <= k) if k > 0 else ranked


def page_documents(matched: DataFrame, number: int, size: int, order: list[Column] | None = None) -> DataFrame:
    """A page of the documents of one repository."""
    return page(matched.orderBy(*(order or document_order())), number, size)


def lines_of_sections(spans: DataFrame, docs: DataFrame, context: int = 0, max_lines: int = 0) -> DataFrame:
    """Lines with matches: (doc_id, line_no, content, highlights, n_lines, n_shown).

    spans: (doc_id, start, end). highlights are relative to the line, null in lines of context. n_lines counts
    the matched lines of the document before max_lines (0: no limit) cuts them. A span outside of its document is cut
    to it. Places are joined to lines by a running maximum over both in one order per document, not by ranges."""
    shown = docs.join(spans.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.octet_length("content").alias("size"), F.inline(T.lines("content")))
    merged = coalesce_spans(spans)
    n = F.lit(None).cast("int")
    at = shown.select("doc_id", F.col("start").alias("pos"), "line_no", n.alias("start"), n.alias("end"))
    ends = merged.withColumn("last", F.col("end") - 1)
    by_pos = Window.partitionBy("doc_id").orderBy("pos", F.col("line_no").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    points = merged.select("doc_id", F.col("start").alias("pos"), n.alias("line_no"), "start", "end").unionByName(ends.select("doc_id", F.col("last").alias("pos"), n.alias("line_no"), "start", "end"))
    found = at.unionByName(points).withColumn("line", F.max("line_no").over(by_pos)).where("start is not null and line is not null")
    covered = found.groupBy("doc_id", "start", "end").agg(F.min("line").alias("first"), F.max("line").alias("last"))
    per_line = covered.select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence("first", "last")).alias("line_no"))
    width = F.octet_length("content")
    clipped = per_line.join(shown, ["doc_id", "line_no"]).select("doc_id", "line_no", F.greatest(F.col("s") - F.col("start"), F.lit(0)).alias("s"), F.least(F.col("e") - F.col("start"), width).alias("e")).where("s < e")
    hits = clipped.groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_list(F.struct(F.col("s").alias("start"), F.col("e").alias("end")))).alias("highlights"))
    by_doc = Window.partitionBy("doc_id")
    hits = hits.withColumn("n_lines", F.count("*").over(by_doc)).withColumn("nth", F.row_number().over(by_doc.orderBy("line_no")))
    if max_lines > 0:
        hits = hits.where(F.col("nth") <= max_lines)
    texts = shown.select("doc_id", "line_no", "content")
    if context <= 0:
        return hits.join(texts, ["doc_id", "line_no"]).select("doc_id", "line_no", "content", "highlights", "n_lines")
    near = hits.select("doc_id", "n_lines", F.explode(F.sequence(F.col("line_no") - context, F.col("line_no") + context)).alias("line_no")).distinct()
    near = near.join(hits.select("doc_id", "line_no", "highlights"), ["doc_id", "line_no"], "left")
    return near.join(texts, ["doc_id", "line_no"]).select("doc_id", "line_no", "content", "highlights", "n_lines")


def tagged(content: Column | str, highlights: Column | str, start_tag: str, end_tag: str) -> Column:
    """The line with tags around its highlights (bytes, in order, apart). Without both tags the line as it is."""
    content, highlights = T.col(content), T.col(highlights)
    if not start_tag or not end_tag:
        return content
    chars = T.byte_chars(content)
    piece = lambda a, b: F.substring(chars, a + 1, b - a)
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, h: F.struct(F.concat(acc["out"], piece(acc["at"], h["start"]), F.lit(T.byte_str(start_tag)), piece(h["start"], h["end"]), F.lit(T.byte_str(end_tag))).alias("out"), h["end"].cast("int").alias("at"))
    whole = F.aggregate(highlights, begin, step, lambda acc: F.concat(acc["out"], F.substring(chars, acc["at"] + 1, F.octet_length(content))))
    return F.coalesce(F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8"), content)
