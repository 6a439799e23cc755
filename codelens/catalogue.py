"""Queries by name, each over the whole tables, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens import corpus as C
from codelens.functions import text as T
from codelens.index import grams as G
from codelens.operators import filters, merge, present
from codelens.options import IngestOptions, SearchRequest
from codelens.plans import search as S
from codelens.query import re2
from codelens.query.analyse import analyse
from codelens.query.parser import parse, segments
from codelens.query.tree import QueryError, depth, leaves, literals, size
from codelens.sources import ingest, scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_EXT = " ".join(f"when '{k}' then '{v}'" for k, v in C.LANGUAGES.items())
FILES_SQL = f"""files as (
    select doc_id, local_path, path_in_repo, repo_id, content,
        coalesce(language, case lower(regexp_extract(coalesce(path_in_repo, local_path), '\\.([A-Za-z0-9]+)$', 1)) {_EXT} end, 'text') as language
    from (select doc_id, arg_max(local_path, walked_at) filter (where local_path is not null) as local_path, arg_max(path_in_repo, walked_at) filter (where path_in_repo is not null) as path_in_repo,
            arg_max(repo_id, walked_at) filter (where repo_id is not null) as repo_id, arg_max(language, walked_at) filter (where language is not null) as language,
            arg_max(content, walked_at) filter (where content is not null) as content from source_files group by doc_id)
), repo as (
    select repo_id, local_path, remote_url, coalesce(nullif(remote_url, ''), local_path) as name
    from (select repo_id, max(local_path) as local_path, max(remote_url) as remote_url from repos group by repo_id)
), corpus as (
    select doc_id, coalesce(f.repo_id, 0) as repo_id, r.name as repo_name, language, coalesce(nullif(path_in_repo, ''), f.local_path) as filename, content
    from files f left join repo r on f.repo_id = r.repo_id where content is not null
)"""
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_sql(c: str) -> str:
    return f"translate({c}, '{UP}', '{LOW}')"


def has(token: str, case: bool = False) -> str:
    """SQL: content holds a literal."""
    return f"contains(content, '{token}')" if case else f"contains({fold_sql('content')}, '{token.lower()}')"


def spans_sql(token: str, case: bool = False, where: str = "true") -> str:
    """SQL: (doc_id, start, end) of a literal."""
    c, t = ("content", token) if case else (fold_sql("content"), token.lower())
    once = f"select doc_id, content, {c} as f from corpus where {has(token, case)} and {where}"
    inner = f"select doc_id, content, unnest(list_filter(range(length(f)), lambda i: substring(f, i + 1, {len(t)}) = '{t}')) as i from ({once})"
    return f'select doc_id, strlen(substring(content, 1, i)) as "start", strlen(substring(content, 1, i)) + strlen(\'{t}\') as "end" from ({inner})'


def lines_sql(source: str = "corpus") -> str:
    """SQL: (doc_id, line_no, start, content) of files, 0-based."""
    return f"""select doc_id, line_no, sum(strlen(content)) over (partition by doc_id order by line_no) - strlen(content) as "start", content from (
        select doc_id, i - 1 as line_no, case when i < len(p) then p[i] || chr(10) else p[i] end as content
        from (select doc_id, string_split(content, chr(10)) as p from {source}), unnest(range(1, len(p) + 1)) as u(i)) where content <> ''"""


def query(name: str, sql: str | None = None, with_files: bool = True) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            body = sql.strip()
            if with_files:
                body = f"with {FILES_SQL}" + (", " + body[5:] if body[:5] == "with " else " " + body)
            SQL[name] = body
        return f

    return register


def found(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Documents of a query with sections and n_sections, within its modifiers."""
    q = analyse(text)
    docs = filters.restrict(C.corpus(spark, sf_dir), q.lang, q.repo, q.file)
    symbols = None
    if any(x.symbol for x in leaves(q.content)):
        symbols = located(spark, sf_dir)
    return S.sections(docs, q.content, q.case_sensitive, symbols).withColumn("n_sections", F.size("sections"))


def documents(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """doc_id only: no spans are computed."""
    q = analyse(text)
    docs = filters.restrict(C.corpus(spark, sf_dir), q.lang, q.repo, q.file)
    return S.documents(docs, q.content, q.case_sensitive).select("doc_id")


def flat(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.inline("sections")).select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.located_symbols(C.symbols(spark, sf_dir), C.lines(C.corpus(spark, sf_dir)))


def simple(name: str, text: str, sql: str) -> None:
    """A query whose documents are asked for."""
    query(name, f"select doc_id from corpus where {sql}")(lambda spark, sf_dir: documents(spark, sf_dir, text))


# literals


def counted(name: str, text: str, token: str, case: bool = False) -> None:
    sql = f"select doc_id, count(*) as n_sections from ({spans_sql(token, case)}) group by doc_id"
    query(name, sql)(lambda spark, sf_dir: found(spark, sf_dir, text).select("doc_id", F.col("n_sections").cast("bigint").alias("n_sections")))


counted("lit_docs", "segment", "segment")
counted("lit_case_docs", "case:yes Segment", "Segment", True)
counted("lit_phrase_docs", '"the branch"', "the branch")
query("lit_occurrences", spans_sql("digest"))(lambda spark, sf_dir: flat(found(spark, sf_dir, "digest")))
query("lit_overlap_occurrences", spans_sql("----"))(lambda spark, sf_dir: flat(found(spark, sf_dir, '"----"')))
query("lit_unicode_occurrences", spans_sql("ü"))(lambda spark, sf_dir: flat(found(spark, sf_dir, "ü")))

# boolean

simple("bool_and", "digest and cache", f"{has('digest')} and {has('cache')}")
simple("bool_or", "digest or cache", f"{has('digest')} or {has('cache')}")
simple("bool_and_not", "digest -cache", f"{has('digest')} and not {has('cache')}")
simple("bool_nested", "(digest or cache) -(window or bucket) return", f"({has('digest')} or {has('cache')}) and not ({has('window')} or {has('bucket')}) and {has('return')}")
simple("bool_all_negative_group", "return (-digest -cache)", f"{has('return')} and not ({has('digest')} or {has('cache')})")
UNION_SQL = " union ".join((spans_sql("digest", where=has("cache")), spans_sql("cache", where=has("digest")), spans_sql("window")))
query("bool_sections_union", UNION_SQL)(lambda spark, sf_dir: flat(found(spark, sf_dir, "(digest and cache) or window")))
COALESCE_SQL = """with s as ({spans}), m as (
    select doc_id, "start", "end", case when "start" > max("end") over (partition by doc_id order by "start", "end" rows between unbounded preceding and 1 preceding) then 1 else 0 end as fresh from s
), i as (select doc_id, "start", "end", sum(fresh) over (partition by doc_id order by "start", "end") as island from m)
select doc_id, min("start") as "start", max("end") as "end" from i group by doc_id, island"""
query("sections_coalesced", COALESCE_SQL.format(spans=" union ".join((spans_sql("----"), spans_sql("dige"), spans_sql("gest")))))(
    lambda spark, sf_dir: merge.coalesce_spans(flat(found(spark, sf_dir, '"----" or dige or gest')))
)


def spans_of(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return flat(found(spark, sf_dir, text))


def merged(name: str, sql: str, f: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> None:
    """Operators on results: spans of digest and of cache, and the documents."""
    query(name, f"with a as ({spans_sql('digest')}), b as ({spans_sql('cache')}) {sql}")(
        lambda spark, sf_dir: f(spans_of(spark, sf_dir, "digest"), spans_of(spark, sf_dir, "cache"), C.corpus(spark, sf_dir).select("doc_id"))
    )


merged("merge_and", "select * from (select * from a union select * from b) where doc_id in (select doc_id from a) and doc_id in (select doc_id from b)", lambda a, b, _: merge.all_of(a, b))
merged("merge_or", "select * from a union select * from b", lambda a, b, _: merge.any_of(a, b))
merged("merge_and_not", "select * from a where doc_id not in (select doc_id from b)", lambda a, b, _: merge.without(a, b))
merged("merge_within", "select * from a where doc_id in (select doc_id from b)", lambda a, b, _: merge.within(a, b))
merged("merge_all_negative", "select doc_id from corpus where doc_id not in (select doc_id from a union select doc_id from b)", lambda a, b, docs: merge.complement(docs, a, b))

# regular expressions


def line_regex(pattern: str, *tokens: str) -> str:
    """SQL: documents with a line that holds the literals and matches."""
    tests = " and ".join([f"contains({fold_sql('content')}, '{t}')" for t in tokens] + [f"regexp_matches(content, '(?i){pattern}')"])
    return f"doc_id in (select doc_id from ({lines_sql()}) where {tests})"


simple("regex_docs_line_mode", r"return.*\d+;", line_regex(r"return.*\d+;", "return"))
simple("regex_docs_doc_mode", r"[0-9]{3,}\s+[a-z]", r"regexp_matches(content, '(?i)[0-9]{3,}\s+[a-z]')")
simple("regex_alternation", "digest.*count|cache.*walk", line_regex("digest.*count|cache.*walk"))
simple("regex_negated", r"return -/return.*\d+;/".replace("/", ""), f"{has('return')} and not {line_regex(r'return.*\d+;', 'return')}")
simple("regex_case", r"case:yes [A-Z]{2}\d+", r"regexp_matches(content, '[A-Z]{2}\d+')")
simple("regex_with_literal", r"digest return.*\d+", f"{has('digest')} and {line_regex(r'return.*\d+', 'return')}")
simple("regex_same_line", "hit.*miss|count.*failed", line_regex("hit.*miss|count.*failed"))
MATCHES_SQL = """with l as (select doc_id, "start", content, regexp_replace(content, '(?i)({p})', chr(1) || '\\1' || chr(2), 'g') as m from ({lines}) where regexp_matches(content, '(?i){p}')),
p as (select doc_id, "start", string_split(m, chr(1)) as parts from l),
e as (select doc_id, "start", parts, i, list_sum(list_transform(parts[1:i - 1], lambda x: strlen(replace(x, chr(2), '')))) as before from p, unnest(range(2, len(parts) + 1)) as u(i))
select doc_id, cast("start" + before as bigint) as "start", cast("start" + before + strlen(string_split(parts[i], chr(2))[1]) as bigint) as "end" from e"""
query("regex_occurrences", MATCHES_SQL.format(p="return.*[0-9]+", lines=lines_sql()))(lambda spark, sf_dir: flat(found(spark, sf_dir, "return.*[0-9]+")))


@query("regex_evaluations", f"select count(*) as n_evaluations from corpus where {has('digest')} and {has('return')}")
def regex_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a pattern is run on: those that pass the tests before it."""
    q = analyse(r"digest return.*\d+")
    literal, pattern = q.content.parts
    docs = S.documents(C.corpus(spark, sf_dir), literal).where(S.clause_test(F.col("content"), pattern, q.case_sensitive))
    return docs.agg(F.count("*").alias("n_evaluations"))


def white_or_black(name: str, how: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        candidates = documents(spark, sf_dir, "digest")
        return documents(spark, sf_dir, r"return.*\d+").join(candidates, "doc_id", how)

    query(name, f"select doc_id from corpus where {line_regex(r'return.*\d+', 'return')} and {sql}")(run)


white_or_black("regex_whitelist", "left_semi", has("digest"))
white_or_black("regex_blacklist", "left_anti", f"not {has('digest')}")

# modifiers and lists

simple("mod_lang", "return lang:java", f"{has('return')} and regexp_matches(language, '(?i)java')")
simple("mod_repo", "return repo:core", f"{has('return')} and regexp_matches(coalesce(repo_name, ''), '(?i)core')")
simple("mod_file", r"return file:_r.*\.go$", rf"{has('return')} and regexp_matches(filename, '(?i)_r.*\.go$')")
simple("mod_negated", "return -lang:go -file:lib", f"{has('return')} and not regexp_matches(language, '(?i)go') and not regexp_matches(filename, '(?i)lib')")
simple("mod_or_is_global", "digest or file:lib", f"{has('digest')} and regexp_matches(filename, '(?i)lib')")
simple("mod_tree", "return (lang:go or lang:rust)", f"{has('return')} and (regexp_matches(language, '(?i)go') or regexp_matches(language, '(?i)rust'))")
simple("mod_invalid_pattern", "return -file:*x", has("return"))


@query("acl_repo", f"select doc_id from corpus where {has('return')} and repo_id in (select repo_id from repo where repo_id % 2 = 1)")
def acl_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories that may be seen come as a table: here those with an odd id."""
    may = C.repos(spark, sf_dir).where("repo_id % 2 = 1")
    return filters.allowed(documents_with_repo(spark, sf_dir, "return"), may, "repo_id").select("doc_id")


@query("acl_hook", f"select doc_id from corpus where {has('return')} and repo_id in (select repo_id from repo where repo_id % 3 = 0)")
def acl_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    may = filters.allowed_by(C.repos(spark, sf_dir), lambda repo_id: repo_id % 3 == 0)
    return filters.allowed(documents_with_repo(spark, sf_dir, "return"), may, "repo_id").select("doc_id")


def documents_with_repo(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    q = analyse(text)
    return S.documents(C.corpus(spark, sf_dir), q.content, q.case_sensitive).select("doc_id", "repo_id")


@query("doc_whitelist", f"select doc_id from corpus where {has('return')} and doc_id in (select doc_id from symbols where sym is not null)")
def doc_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come as a table: here those with a symbol."""
    listed = C.table(spark, sf_dir, "symbols").where("sym is not null")
    return filters.allowed(documents(spark, sf_dir, "return"), listed, "doc_id")


@query("file_search", "select doc_id, filename from corpus where regexp_matches(filename, '(?i)digest') and regexp_matches(language, '(?i)java')")
def file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = analyse("file:digest lang:java")
    return filters.restrict(C.corpus(spark, sf_dir), q.lang, q.repo, q.file).select("doc_id", "filename")


@query("repo_search", "select repo_id, name from repo where regexp_matches(name, '(?i)forge') and not regexp_matches(name, '(?i)core')")
def repo_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = analyse("repo:forge -repo:core")
    return C.repos(spark, sf_dir).where(filters.holds(q.repo, F.col("name"), True)).select("repo_id", "name")


# facets, ranks, pages

SHOWN = "digest or cache"
MATCHED_SQL = f"matched as (select doc_id, repo_id, language, filename, n_sections from corpus join (select doc_id, count(*) as n_sections from ({spans_sql('digest')} union {spans_sql('cache')}) group by doc_id) using (doc_id))"


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, SHOWN).select("doc_id", "repo_id", "language", "filename", F.col("n_sections").cast("bigint").alias("n_sections"))


query("section_counts", f"with {MATCHED_SQL} select doc_id, n_sections from matched")(lambda spark, sf_dir: matched(spark, sf_dir).select("doc_id", "n_sections"))
query("facet_language", f"with {MATCHED_SQL} select language, count(*) as n_documents, cast(sum(n_sections) as bigint) as n_sections from matched group by language")(
    lambda spark, sf_dir: present.facet_by_language(matched(spark, sf_dir))
)
query("group_repo", f"with {MATCHED_SQL} select repo_id, count(*) as n_documents, cast(sum(n_sections) as bigint) as n_sections from matched group by repo_id")(
    lambda spark, sf_dir: present.group_by_repo(matched(spark, sf_dir))
)
query("totals", f"with {MATCHED_SQL} select count(distinct repo_id) as n_repos, count(*) as n_documents, cast(sum(n_sections) as bigint) as n_sections from matched")(
    lambda spark, sf_dir: present.totals(matched(spark, sf_dir))
)
TOP_SQL = "select repo_id, doc_id, n_sections, row_number() over (partition by repo_id order by n_sections desc, filename, doc_id) as rank from matched"
query("rank_docs_topk_per_repo", f"with {MATCHED_SQL} select * from ({TOP_SQL}) where rank <= 3")(
    lambda spark, sf_dir: present.top_per_repo(matched(spark, sf_dir), 3).select("repo_id", "doc_id", "n_sections", F.col("rank").cast("bigint").alias("rank"))
)
query("rank_docs_custom", f"with {MATCHED_SQL} select repo_id, doc_id, row_number() over (partition by repo_id order by filename desc, doc_id) as rank from matched qualify rank <= 2")(
    lambda spark, sf_dir: present.top_per_repo(matched(spark, sf_dir), 2, [F.desc("filename"), F.asc("doc_id")]).select("repo_id", "doc_id", F.col("rank").cast("bigint").alias("rank"))
)
REPOS_SQL = "select m.repo_id, n_documents, n_sections from (select repo_id, count(*) as n_documents, cast(sum(n_sections) as bigint) as n_sections from matched group by repo_id) m left join repo r on m.repo_id = r.repo_id order by m.repo_id = 0, n_documents desc, coalesce(nullif(local_path, ''), remote_url), m.repo_id"
query("rank_repos_page", f"with {MATCHED_SQL} {REPOS_SQL} limit 5 offset 5")(
    lambda spark, sf_dir: present.page(present.rank_repos(matched(spark, sf_dir), C.repos(spark, sf_dir)), 1, 5).select("repo_id", "n_documents", "n_sections")
)
query("rank_docs_single_repo_page", f"with {MATCHED_SQL} select doc_id, n_sections from matched where repo_id = 1 order by n_sections desc, filename, doc_id limit 10 offset 10")(
    lambda spark, sf_dir: present.page_documents(matched(spark, sf_dir).where("repo_id = 1"), 1, 10).select("doc_id", "n_sections")
)

# lines


def shown_lines(spark: SparkSession, sf_dir: str, text: str, context: int = 0, max_lines: int = 0) -> DataFrame:
    spans = flat(found(spark, sf_dir, text)).select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    return present.lines_of_sections(spans, C.corpus(spark, sf_dir).select("doc_id", "content"), context, max_lines)


HITS_SQL = f"l as ({lines_sql()}), h as (select doc_id, line_no, content from l where contains({fold_sql('content')}, 'digest'))"
query("lines_matched", f"with {HITS_SQL} select doc_id, line_no, content from h")(lambda spark, sf_dir: shown_lines(spark, sf_dir, "digest").select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "content"))
query("lines_context", f"with {HITS_SQL} select distinct l.doc_id, l.line_no, l.content from l join h on l.doc_id = h.doc_id and l.line_no between h.line_no - 2 and h.line_no + 2")(
    lambda spark, sf_dir: shown_lines(spark, sf_dir, "digest", 2).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "content")
)
query("lines_highlight", f"with {HITS_SQL} select doc_id, line_no, regexp_replace(content, '(?i)(digest)', '<b>\\1</b>', 'g') as content from h")(
    lambda spark, sf_dir: shown_lines(spark, sf_dir, "digest").select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), present.tagged("content", "highlights", "<b>", "</b>").alias("content"))
)
CAPPED_SQL = "select doc_id, line_no, count(*) over (partition by doc_id) as n_lines from h qualify row_number() over (partition by doc_id order by line_no) <= 2"
query("lines_capped", f"with {HITS_SQL} {CAPPED_SQL}")(
    lambda spark, sf_dir: shown_lines(spark, sf_dir, "digest", 0, 2).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "n_lines")
)
query("line_starts", lines_sql().replace('sum(strlen(content)) over (partition by doc_id order by line_no) - strlen(content) as "start"', 'cast(sum(strlen(content)) over (partition by doc_id order by line_no) - strlen(content) as bigint) as "start"'))(
    lambda spark, sf_dir: C.lines(C.corpus(spark, sf_dir)).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("start").cast("bigint").alias("start"), "content")
)
query("line_counts", f"select doc_id, count(*) as n_lines from ({lines_sql()}) group by doc_id")(
    lambda spark, sf_dir: C.corpus(spark, sf_dir).where("content != ''").select("doc_id", T.n_lines("content").cast("bigint").alias("n_lines"))
)

# gram index

GRAM_SQL = f"""chars as (select doc_id, unnest(p) as c, generate_subscripts(p, 1) as i from (select doc_id, string_split({fold_sql('content')}, '') as p from corpus where content <> '')), places as (
    select doc_id, c, lead(c) over w as d, lead(c, 2) over w as e, sum(strlen(c)) over w - strlen(c) as pos from chars window w as (partition by doc_id order by i)
), g as (SIZES), postings_ as (
    select gram, doc_id, count(*) as n, cast(min(pos) as bigint) as first, cast(max(pos) as bigint) as last, cast(sum(pos) as bigint) as total from g
    where gram is not null and not contains(gram, ' ') and not contains(gram, chr(0)) group by gram, doc_id)"""
ALL_SIZES = GRAM_SQL.replace("SIZES", "select doc_id, pos, c as gram from places union all select doc_id, pos, c || d from places union all select doc_id, pos, c || d || e from places")


def built(spark: SparkSession, sf_dir: str, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    return G.build(C.corpus(spark, sf_dir), sizes)


def summed(p: DataFrame) -> DataFrame:
    total = F.aggregate("locations", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return p.select("gram", "doc_id", F.size("locations").cast("bigint").alias("n"), F.array_min("locations").cast("bigint").alias("first"), F.array_max("locations").cast("bigint").alias("last"), total.alias("total"))


query("gram_postings", f"with {ALL_SIZES} select gram, doc_id, n, first, last, total from postings_")(lambda spark, sf_dir: summed(built(spark, sf_dir)))
query("gram_postings_trigrams", f"with {GRAM_SQL.replace('SIZES', 'select doc_id, pos, c || d || e as gram from places')} select gram, doc_id, n, first, last, total from postings_")(lambda spark, sf_dir: summed(built(spark, sf_dir, (3,))))
query("gram_doc_freq", f"with {ALL_SIZES} select gram, count(*) as doc_freq from postings_ group by gram")(lambda spark, sf_dir: G.frequencies(built(spark, sf_dir)))
query("gram_index_bytes", f"with {ALL_SIZES} select cast(sum(n) * 4 as bigint) as index_bytes from postings_")(lambda spark, sf_dir: G.index_bytes(built(spark, sf_dir)))
STATS_SQL = "select (select count(*) from corpus) as n_documents, (select cast(sum(strlen(content)) as bigint) from corpus) as content_bytes, (select count(*) from l) as n_lines, (select count(distinct gram) from postings_) as n_grams, (select count(*) from postings_) as n_postings, (select cast(sum(n) * 4 as bigint) from postings_) as index_bytes"
query("index_stats", f"with {ALL_SIZES}, l as ({lines_sql()}) {STATS_SQL}")(lambda spark, sf_dir: G.statistics(C.corpus(spark, sf_dir), built(spark, sf_dir)))
query("gram_search", spans_sql("digest"))(lambda spark, sf_dir: gram_search(spark, sf_dir, "digest"))
query("gram_search_case", spans_sql("Digest", True))(lambda spark, sf_dir: gram_search(spark, sf_dir, "Digest", True))


def gram_search(spark: SparkSession, sf_dir: str, token: str, case: bool = False) -> DataFrame:
    docs = C.corpus(spark, sf_dir)
    p = G.build(docs)
    return flat(G.search(docs, p, G.frequencies(p), token, case))


# the index that comes as a table

TABLE_SQL = f"p as (select distinct {fold_sql('gram')} as gram, doc_id, unnest(locations) as pos from postings where gram is not null and doc_id is not null), pp as (select * from p where pos is not null)"
query("postings_merged", f"with {TABLE_SQL} select gram, doc_id, count(*) as n, cast(min(pos) as bigint) as first, cast(max(pos) as bigint) as last, cast(sum(pos) as bigint) as total from pp group by gram, doc_id")(lambda spark, sf_dir: summed(C.postings(spark, sf_dir)))
query("postings_doc_freq", f"with {TABLE_SQL} select gram, count(distinct doc_id) as doc_freq from pp group by gram")(lambda spark, sf_dir: G.frequencies(C.postings(spark, sf_dir)))
query("gram_one_key", f"with {TABLE_SQL} select doc_id, count(*) as n from pp where gram = 'dig' group by doc_id")(
    lambda spark, sf_dir: G.one_key(C.postings(spark, sf_dir), "dig").select("doc_id", F.size("locations").cast("bigint").alias("n"))
)
query("gram_two_key_positions", f"with {TABLE_SQL} select a.doc_id, cast(a.pos as bigint) as pos from pp a join pp b on a.doc_id = b.doc_id and b.pos = a.pos + 3 where a.gram = 'dig' and b.gram = 'est'")(
    lambda spark, sf_dir: G.two_keys(C.postings(spark, sf_dir), "dig", "est", 3).select("doc_id", F.explode("locations").alias("pos")).select("doc_id", F.col("pos").cast("bigint").alias("pos"))
)
RAREST_SQL = "select gram from pp where gram in ('dig', 'ige', 'ges', 'est') group by gram order by count(distinct doc_id), gram limit 2"


@query("gram_rarest_pair", f"with {TABLE_SQL} {RAREST_SQL}")
def gram_rarest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = G.rarest_pair(G.frequencies(C.postings(spark, sf_dir)), "digest")
    return spark.createDataFrame([(g,) for _, g in pair], "gram string")


@query("gram_keys", f"with {TABLE_SQL} select gram, case when contains(gram, ' ') then 0 else (unicode(gram)::bigint << 42) | (case when length(gram) > 1 then unicode(substring(gram, 2, 1))::bigint << 21 else 0 end) | (case when length(gram) > 2 then unicode(substring(gram, 3, 1))::bigint else 0 end) end as key from (select distinct gram from pp where gram <> '')")
def gram_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.postings(spark, sf_dir).where("gram != ''").select("gram").distinct().select("gram", G.key_column("gram").alias("key"))


# symbols

LOCATED_SQL = f"""l as ({lines_sql()}), located as (
    select distinct s.doc_id, sym, cast(l."start" + strlen(substring(content, 1, strpos(content, sym) - 1)) as bigint) as "start"
    from (select distinct doc_id, sym, line_no from symbols where sym <> '') s join l on s.doc_id = l.doc_id and s.line_no = l.line_no + 1 where contains(content, sym)
)"""
query("symbols_located", f"with {LOCATED_SQL} select doc_id, sym, \"start\" from located")(lambda spark, sf_dir: located(spark, sf_dir).withColumn("start", F.col("start").cast("bigint")))
SYM_SQL = f"""with {LOCATED_SQL} select distinct doc_id, cast("start" + i as bigint) as "start", cast("start" + i + 5 as bigint) as "end"
    from (select doc_id, "start", unnest(list_filter(range(length(sym)), lambda i: substring({fold_sql('sym')}, i + 1, 5) = 'chunk' )) as i from located)""".replace("chunk", "cache")
query("symbol_search", SYM_SQL)(lambda spark, sf_dir: flat(found(spark, sf_dir, "sym:cache")))
query("symbol_grams", f"with {LOCATED_SQL} select distinct doc_id, substring({fold_sql('sym')}, 1, 3) as gram from located where length(sym) >= 3")(
    lambda spark, sf_dir: G.symbol_grams(located(spark, sf_dir)).join(
        located(spark, sf_dir).where("length(sym) >= 3").select("doc_id", F.substring(T.fold("sym"), 1, 3).alias("gram")).distinct(), ["doc_id", "gram"], "left_semi"
    ).select("doc_id", "gram")
)
simple("symbol_and_literal", "digest (return or cache)", f"{has('digest')} and ({has('return')} or {has('cache')})")

# taking files up

LINES = "(strlen(content) - strlen(replace(content, chr(10), '')) + case when content <> '' and content not like '%' || chr(10) then 1 else 0 end)"
EXTENSION = "regexp_extract(local_path, '\\.([^./]*)$', 1)"
OPTIONS = IngestOptions(deny_extensions=("json",), max_bytes=2000, max_lines=60, deny_languages=("rust",), filter_generated=False)
REASON_SQL = f"""judged as (select doc_id, content, case {EXTENSION} {_EXT} else 'unknown' end as language, {LINES} as n_lines, case
        when content is null or local_path is null then 'no_content'
        when {EXTENSION} = 'json' then 'extension_denied'
        when starts_with(trim(regexp_extract(local_path, '[^/]*$')), '.') then 'dot_file'
        when strlen(content) > 2000 then 'too_large'
        when contains(content, chr(0)) then 'binary'
        when regexp_matches(local_path, '(^|/)(vendor|vendors|node_modules|bower_components|third[-_]?party|Godeps)/') then 'vendored'
        when {LINES} > 60 then 'too_many_lines'
        when {EXTENSION} = 'rs' then 'language_denied'
        when case {EXTENSION} {_EXT} else 'unknown' end = 'unknown' then 'language_unknown' end as reason from files)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.reasons(C.files(spark, sf_dir).drop("language"), OPTIONS)


query("corpus_filter_reasons", f"with {REASON_SQL} select doc_id, reason from judged")(lambda spark, sf_dir: judged(spark, sf_dir).select("doc_id", "reason"))
query("corpus_reject_counts", f"with {REASON_SQL} select reason, count(*) as n_files from judged where reason is not null and reason <> 'extension_denied' group by reason")(
    lambda spark, sf_dir: ingest.reject_counts(judged(spark, sf_dir))
)
query("corpus_language_stats", f"with {REASON_SQL} select language, count(*) as n_files, cast(sum(n_lines) as bigint) as n_lines, cast(sum(strlen(content)) as bigint) as n_bytes from judged where reason is null group by language")(
    lambda spark, sf_dir: ingest.language_stats(judged(spark, sf_dir).where("reason is null"))
)


def filtered(name: str, options: IngestOptions, sql: str) -> None:
    """Files that one rule lets through."""
    query(name, f"select doc_id from files where content is not null and {sql}")(
        lambda spark, sf_dir: ingest.reasons(C.files(spark, sf_dir).drop("language"), options).where("reason is null").select("doc_id")
    )


def only(**options) -> IngestOptions:
    """Options with no rule but those given."""
    none = dict(filter_dot_files=False, max_bytes=0, max_lines=0, filter_binary=False, filter_images=False, filter_vendored=False, filter_generated=False, allow_unknown=True)
    return IngestOptions(**none | options)


VENDOR_SQL = "regexp_matches(local_path, '(^|/)(vendor|vendors|node_modules|bower_components|third[-_]?party|Godeps)/')"
filtered("filter_extension_deny", only(deny_extensions=("go", "py")), f"{EXTENSION} not in ('go', 'py')")
filtered("filter_extension_allow", only(allow_extensions=("go", "py"), deny_extensions=("py",)), f"{EXTENSION} = 'go'")
filtered("filter_dot_files", only(filter_dot_files=True), "not starts_with(trim(regexp_extract(local_path, '[^/]*$')), '.')")
filtered("filter_max_bytes", only(max_bytes=1000), "strlen(content) <= 1000")
filtered("filter_binary", only(filter_binary=True), "not contains(content, chr(0))")
filtered("filter_images", only(filter_images=True), f"lower({EXTENSION}) not in ('png', 'jpg', 'jpeg', 'gif', 'bmp', 'ico', 'webp', 'svg', 'tif', 'tiff', 'psd')")
filtered("filter_vendored", only(filter_vendored=True), f"not {VENDOR_SQL}")
filtered("filter_max_lines", only(max_lines=30), f"{LINES} <= 30")
filtered("filter_language_deny", only(deny_languages=("go",)), f"{EXTENSION} <> 'go'")
filtered("filter_language_allow", only(allow_languages=("go", "rust")), f"{EXTENSION} in ('go', 'rs')")
filtered("filter_language_unknown", only(allow_unknown=False), f"case {EXTENSION} {_EXT} else 'unknown' end <> 'unknown'")
filtered("filter_generated", only(filter_generated=True), f"""not (regexp_matches(local_path, '{ingest.GENERATED_PATH}') or regexp_matches(content, '{ingest.GENERATED_HEAD}'))""")
query("language_detected", f"select doc_id, case {EXTENSION} {_EXT} else 'unknown' end as language from files where local_path is not null")(
    lambda spark, sf_dir: C.files(spark, sf_dir).where("local_path is not null").select("doc_id", ingest.language().alias("language"))
)
ASSIGN_SQL = """select f.doc_id, coalesce(arg_max(r.repo_id, length(r.local_path)), 0) as repo_id, substring(f.local_path, max(length(r.local_path)) + 2) as path_in_repo
    from files f left join repo r on starts_with(f.local_path, r.local_path || '/') where f.local_path is not null group by f.doc_id, f.local_path"""
query("repo_assigned", ASSIGN_SQL)(
    lambda spark, sf_dir: scan.assign_repos(C.files(spark, sf_dir).where("local_path is not null").select("doc_id", "local_path"), C.repos(spark, sf_dir)).select("doc_id", "repo_id", "path_in_repo")
)


@query("repo_external_ids", "select local_path, case when remote_url <> '' then repo_id + 1000 end as given from repo where remote_url <> ''")
def repo_external_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.repos(spark, sf_dir)
    ids = r.where("remote_url != ''").select("remote_url", (F.col("repo_id") + 1000).alias("repo_id"))
    return scan.with_repo_ids(r.select("local_path", "remote_url"), ids).where("remote_url != ''").select("local_path", F.col("repo_id").alias("given"))


query("content_fetch", "select doc_id, content from corpus where doc_id = 1")(lambda spark, sf_dir: C.corpus(spark, sf_dir).where("doc_id = 1").select("doc_id", "content"))

# the query language, as tables of its cases

#: Inputs and the trees that they stand for.
PARSED = {
    "a and b or c": "(c OR (a AND b))",
    "(a or b) and c": "(c AND (a OR b))",
    'a bb or   "  ccc" ': '("  ccc" OR (a AND bb))',
    "a bb or(c and (d))": "((a AND bb) OR (c AND d))",
    'a b or c and d or (e or f and g "h")': "(e OR (a AND b) OR (c AND d) OR (f AND g AND h))",
    '*b ".*abc"': "(*b AND <.*abc>(abc))",
    r"a a.*aaa.*[a-z]{3}\d{3}[^b] a{3}": r"(a AND <a.*aaa.*[a-z]{3}\d{3}[^b]>(a,aaa) AND <a{3}>(aaa))",
    "a b -c d": "(a AND b AND d AND -c)",
    "-(c or -(e f))": "(e AND f AND -c)",
    "---a": "-a",
    "a *b*c *d e* *f*g*h": "(*b*c AND *d AND *f*g*h AND a AND <e*>())",
    "a a* c+ ddd{3,6} e{3} f{0,7}": "(a AND <a*>() AND <c+>(c) AND <ddd{3,6}>(dd,ddd) AND <e{3}>(eee) AND <f{0,7}>())",
    "a or sym:b": "(sym:b OR a)",
    "a b sym:ddd repo:fff file:ggg case:yes lang:java": "(case:yes AND lang:java AND repo:fff AND file:ggg AND sym:ddd AND a AND b)",
    "a a b a": "(a AND b)",
    "or": "error",
    "or or": "error",
    "- - a": "error",
    "(a b": "error",
    "sym:": "error",
    "case:no a": "error",
}
#: Whether a query can be answered, and what it returns.
ANALYSED = {
    "a or -b": "error", "a and -(b and c)": "error", "-a -b": "error", "a OR file:b": "documents", "a OR (c file:b)": "documents", "repo:a OR (repo:b repo:c)": "error",
    "a b repo:c (repo:a or repo:b)": "error", "a or (repo:a or repo:b)": "documents", "file:x lang:go": "files", "repo:x": "repos", "lang:go": "error", "sym:a.*b": "error",
}
#: Valid RE2 patterns with their mandatory literals, and invalid ones.
PATTERNS = {
    "cpu.*cache": "cpu cache", "foo|bar": "bar|foo", "x(abc)+y?": "x abc", "[a-z]+": "", "a{2,3}b": "aa b", "c++": "error", "(?=a)": "error", r"(a)\1": "error", "*b": "error", "a**": "error",
    "(?P<n>ab)": "ab", "(?i)Ab": "Ab", "x{1001}": "error", r"\pL+z": "z", r"\Qa.b\E+": "a. b",
}
#: The atoms of a query.
SEGMENTS = {"a -b -(c -d) -\"efg\"": 4, "a bb or(c and (d))": 4, "- - -a": 3, 'a or file:"b b"': 3, 'repo:docs (@todo or " todo" or "todo(" ) -todouble': 3, "(adfdf": -1}


def values(rows: dict, names: str) -> str:
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"select * from (values {', '.join(f'({quoted(k)}, {quoted(v)})' for k, v in rows.items())}) as v({names})"


def or_error(f: Callable, *errors: type) -> str | int:
    try:
        return f()
    except errors or (QueryError,):
        return "error"


query("parse_trees", values(PARSED, "query, tree"), False)(
    lambda spark, sf_dir: spark.createDataFrame([(q, or_error(lambda q=q: parse(q).show(True))) for q in PARSED], "query string, tree string")
)
query("parse_analysed", values(ANALYSED, "query, kind"), False)(
    lambda spark, sf_dir: spark.createDataFrame([(q, or_error(lambda q=q: analyse(q).kind)) for q in ANALYSED], "query string, kind string")
)
query("parse_patterns", values(PATTERNS, "pattern, literals"), False)(
    lambda spark, sf_dir: spark.createDataFrame([(p, or_error(lambda p=p: " ".join("|".join(c) for c in re2.compile(p).clauses), re2.PatternError)) for p in PATTERNS], "pattern string, literals string")
)


@query("parse_segments", values(SEGMENTS, "query, atoms"), False)
def parse_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda q: or_error(lambda: len(segments(q)))
    return spark.createDataFrame([(q, -1 if n(q) == "error" else n(q)) for q in SEGMENTS], "query string, atoms int")


TREES = {"a (b or a.*c) -d": (3, 6, "a b d"), "a": (1, 1, "a")}


@query("parse_statistics", "select * from (values " + ", ".join(f"('{q}', {d}, {n}, '{t}')" for q, (d, n, t) in TREES.items()) + ") as v(query, depth, nodes, literals)", False)
def parse_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(q, depth(parse(q)), size(parse(q)), " ".join(sorted(literals(parse(q))))) for q in TREES], "query string, depth int, nodes int, literals string")


# the whole


@query("search_response")
def search_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a search as it is given out: one row per repository with documents and lines inside, as JSON."""
    from codelens.engine import Engine

    engine = Engine.over(spark, C.corpus(spark, sf_dir), C.repos(spark, sf_dir), located(spark, sf_dir))
    request = SearchRequest("digest or cache", page_size=10, documents_per_repo=3, lines_per_document=3, context_lines=1, start_tag="<b>", end_tag="</b>")
    return engine.search(request).nested().select("repo_id", F.to_json(F.struct("n_documents", "n_sections", "documents")).alias("response"))
