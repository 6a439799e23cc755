"""The engine: take files up, finish, search.

    engine = Engine(spark)
    engine.index_dir("/src")
    engine.finish()
    response = engine.search(SearchRequest("cpu.*cache lang:go", page_size=10))
    print(response.to_json())"""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens import corpus
from codelens.functions import text as T
from codelens.index import grams
from codelens.operators import filters, present
from codelens.options import EngineOptions, SearchRequest
from codelens.plans import search as plan
from codelens.query.analyse import Query, analyse
from codelens.query.tree import Leaf, QueryError
from codelens.sources import ingest, scan

log = logging.getLogger(__name__)
DOCUMENTS = "doc_id bigint, repo_id bigint, repo_name string, language string, filename string, content string"
REPOS = "repo_id bigint, local_path string, remote_url string, name string"


class NotFinished(RuntimeError):
    """Search before finish(), or files after it."""


@dataclass
class SearchResponse:
    """Tables of a result. Totals are of everything found, the tables of what is shown."""

    kind: str
    totals: dict[str, int]
    languages: DataFrame | None
    repos: DataFrame
    documents: DataFrame | None
    lines: DataFrame | None
    matched: DataFrame | None
    recall_us: int
    total_us: int

    def nested(self) -> DataFrame:
        """One row per repository with its documents and their lines inside; only what is shown."""
        if self.documents is None:
            return self.repos
        docs = self.documents
        if self.lines is not None:
            fields = [c for c in self.lines.columns if c not in ("doc_id", "n_lines")]
            per_doc = self.lines.groupBy("doc_id").agg(F.max("n_lines").alias("n_lines"), F.array_sort(F.collect_list(F.struct(*fields))).alias("lines"))
            docs = docs.join(per_doc, "doc_id", "left")
        names = [c for c in ("rank", "doc_id", "language", "filename", "n_sections", "n_lines", "lines") if c in docs.columns]
        per_repo = docs.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct(*names)), _by_rank).alias("documents"))
        return self.repos.join(per_repo, "repo_id", "left").orderBy(*present.repo_order())

    def to_json(self) -> str:
        """The page as JSON. Fetches what is shown, so ask for pages."""
        out = {"kind": self.kind, **self.totals, "recallMicroseconds": self.recall_us, "totalMicroseconds": self.total_us}
        if self.languages is not None:
            out["languages"] = [r.asDict() for r in self.languages.collect()]
        out["repos"] = [json.loads(x) for x in self.nested().toJSON().collect()]
        return json.dumps(out, ensure_ascii=False)

    def close(self) -> None:
        if self.matched is not None:
            self.matched.unpersist()


def _by_rank(a, b):
    return F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).otherwise(0)


class Engine:
    def __init__(self, spark: SparkSession, options: EngineOptions = EngineOptions()):
        self.spark, self.options = spark, options
        self._files: list[DataFrame] = []
        self._repos: list[DataFrame] = []
        self._symbols: list[DataFrame] = []
        self.finished = False
        self.judged = self.docs = self.repos = self.symbols = self.postings = self.frequencies = None

    @classmethod
    def over(cls, spark: SparkSession, docs: DataFrame, repos: DataFrame, symbols: DataFrame | None = None, options: EngineOptions = EngineOptions()) -> Engine:
        """An engine over tables that are ready: DOCUMENTS, REPOS, and symbols (doc_id, sym, start)."""
        e = cls(spark, options)
        e.docs, e.repos, e.symbols, e.finished = docs, repos, symbols, True
        return e

    # taking up

    def _open(self) -> None:
        if self.finished:
            raise NotFinished("finished: nothing can be added")

    def index_dir(self, path: str) -> None:
        self._open()
        self._files.append(scan.directory(self.spark, path, self.options.ingest))
        self._repos.append(scan.repositories(self.spark, path, self.options.ingest.allow_repos))

    def index_git_remote(self, url: str, folder: str) -> None:
        self._open()
        files, repos = scan.git_remote(self.spark, url, folder, self.options.ingest)
        self._files.append(files)
        self._repos.append(repos)

    def index_files(self, files: DataFrame) -> None:
        self._open()
        self._files.append(files.select("local_path", "content"))

    def index_repos(self, repos: DataFrame) -> None:
        self._open()
        self._repos.append(repos.select("local_path", "remote_url"))

    def index_symbols(self, symbols: DataFrame) -> None:
        """local_path, sym, line_no (1-based)."""
        self._open()
        self._symbols.append(symbols.select("local_path", "sym", "line_no"))

    def pull_repos(self, path: str) -> DataFrame:
        return scan.pull(self.spark, scan.repositories(self.spark, path, self.options.ingest.allow_repos))

    def finish(self) -> None:
        """Files once by path, judged, with repository and id; symbols located; grams if asked for; all stored."""
        self._open()
        empty = self.spark.createDataFrame([], "local_path string, content binary")
        files = reduce(DataFrame.unionByName, self._files, empty).groupBy("local_path").agg(F.min("content").alias("content"))
        roots = reduce(DataFrame.unionByName, self._repos, self.spark.createDataFrame([], "local_path string, remote_url string"))
        roots = roots.groupBy("local_path").agg(F.max("remote_url").alias("remote_url"))
        self.repos = self._keep(scan.with_repo_ids(roots, self.options.repo_ids).withColumn("name", F.coalesce(F.expr("nullif(remote_url, '')"), "local_path")), "repos")
        self.judged = ingest.reasons(files, self.options.ingest)
        taken = scan.assign_repos(self.judged.where("reason is null"), self.repos)
        taken = taken.join(self.repos.select("repo_id", F.col("name").alias("repo_name")), "repo_id", "left")
        doc_id = F.pmod(F.xxhash64("local_path"), F.lit((1 << 62) - 1)) + 1
        filename = F.coalesce(F.expr("nullif(path_in_repo, '')"), "local_path")
        docs = taken.select(doc_id.alias("doc_id"), "repo_id", "repo_name", "language", filename.alias("filename"), F.decode("content", "UTF-8").alias("content"), "local_path", "n_lines")
        self.docs = self._keep(docs, "docs")
        symbols = [s.select("local_path", "sym", "line_no") for s in self._symbols]
        if self.options.ctags.command:
            symbols.append(scan.ctags(self.docs, self.options.ctags).select("local_path", "sym", "line_no"))
        if symbols:
            by_doc = reduce(DataFrame.unionByName, symbols).join(self.docs.select("doc_id", "local_path"), "local_path").select("doc_id", "sym", "line_no").distinct()
            self.symbols = self._keep(plan.located_symbols(by_doc, corpus.lines(self.docs)), "symbols")
        if self.options.index.use_grams:
            self.postings = self._keep(grams.build(self.docs, self.options.index.gram_sizes), "postings")
            self.frequencies = self._keep(grams.frequencies(self.postings), "frequencies")
        self.finished = True

    def _keep(self, table: DataFrame, name: str) -> DataFrame:
        path = self.options.index.path
        if path is None:
            return table.persist()
        table.write.mode("overwrite").parquet(f"{path}/{name}")
        return self.spark.read.parquet(f"{path}/{name}")

    # questions

    def content(self, doc_id: int) -> str | None:
        self._done()
        rows = self.docs.where(F.col("doc_id") == doc_id).select("content").take(1)
        return rows[0].content if rows else None

    def language_stats(self) -> DataFrame:
        self._done()
        return ingest.language_stats(self.docs.withColumn("n_lines", T.n_lines("content")))

    def reject_counts(self) -> DataFrame:
        self._done()
        return ingest.reject_counts(self.judged)

    def health(self) -> str:
        return "ok" if self.finished else "not_ok"

    def _done(self) -> None:
        if not self.finished:
            raise NotFinished("finish() first")

    def _within(self, q: Query, request: SearchRequest) -> DataFrame:
        docs = self.docs
        docs = filters.allowed(docs, request.document_ids, "doc_id")
        docs = filters.allowed(docs, request.repo_ids, "repo_id")
        if request.may_see_repo is not None:
            docs = filters.allowed(docs, filters.allowed_by(self.docs, request.may_see_repo), "repo_id")
        return filters.restrict(docs, q.lang, q.repo, q.file)

    def _recalled(self, q: Query, docs: DataFrame) -> DataFrame:
        """Documents with sections. A single literal goes through the gram index if there is one, all else through one scan."""
        if isinstance(q.content, Leaf) and q.content.kind == "literal" and not q.content.symbol and self.postings is not None:
            try:
                by_index = grams.search(docs, self.postings, self.frequencies, q.content.text, q.case_sensitive)
                return docs.join(by_index, "doc_id")
            except QueryError:
                pass
        return plan.sections(docs, q.content, q.case_sensitive, self.symbols)

    def search(self, request: SearchRequest) -> SearchResponse:
        """QueryError for a query that cannot be read; TimeoutError if it takes longer than asked for."""
        self._done()
        q = analyse(request.query)
        if request.timeout_ms <= 0:
            return self._search(q, request)
        tag, late = f"search-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            self.spark.interruptTag(tag)

        timer = threading.Timer(request.timeout_ms / 1000, stop)
        self.spark.addTag(tag)
        timer.start()
        try:
            return self._search(q, request)
        except Exception as e:
            if late.is_set():
                raise TimeoutError(f"search took longer than {request.timeout_ms} ms") from e
            raise
        finally:
            timer.cancel()
            self.spark.removeTag(tag)

    def _search(self, q: Query, request: SearchRequest) -> SearchResponse:
        begin = time.monotonic()
        us = lambda: int((time.monotonic() - begin) * 1e6)
        if q.kind == "repos":
            found = filters.allowed(self.repos, request.repo_ids, "repo_id")
            if request.may_see_repo is not None:
                found = filters.allowed(found, filters.allowed_by(found, request.may_see_repo), "repo_id")
            found = found.where(filters.holds(q.repo, F.col("name"), True))
            n = found.count()
            paged = present.page(found.orderBy(F.coalesce(F.expr("nullif(local_path, '')"), "remote_url"), "repo_id"), request.page, request.page_size)
            paged = paged.withColumn("n_documents", F.lit(0))
            return SearchResponse("repos", {"numRepos": n, "numDocuments": 0, "numLines": 0, "numSections": 0}, None, paged, None, None, None, us(), us())
        docs = self._within(q, request)
        columns = ["doc_id", "repo_id", "language", "filename"]
        if q.kind == "documents":
            matched = self._recalled(q, docs).select(*columns, "sections", F.size("sections").alias("n_sections"))
        else:
            matched = docs.select(*columns, F.lit(0).alias("n_sections"))
        matched = matched.persist()  # ids and spans only; read by totals, facets, ranks and lines
        t = present.totals(matched).first()
        recall = us()
        ranked = present.rank_repos(matched, self.repos, request.repo_order and request.repo_order())
        order = request.document_order and request.document_order()
        if t.n_repos == 1:
            repos, shown = ranked, present.top_per_repo(matched, request.documents_in_single_repo, order)
            if request.page_size > 0:
                first = request.page * request.page_size
                shown = shown.where(F.col("rank").between(first + 1, first + request.page_size))
        else:
            repos = present.page(ranked, request.page, request.page_size)
            shown = present.top_per_repo(matched.join(repos.select("repo_id"), "repo_id", "left_semi"), request.documents_per_repo, order)
        lines = None
        n_lines = 0
        if q.kind == "documents":
            spans = shown.select("doc_id", F.inline("sections"))
            lines = present.lines_of_sections(spans, self.docs.select("doc_id", "content"), request.context_lines, request.lines_per_document).persist()
            n_lines = lines.where("highlights is not null").count()
            if not request.return_content:
                lines = lines.drop("content")
            elif request.start_tag and request.end_tag:
                lines = lines.withColumn("content", present.tagged("content", "highlights", request.start_tag, request.end_tag))
        totals = {"numRepos": t.n_repos, "numDocuments": t.n_documents, "numLines": n_lines, "numSections": t.n_sections}
        return SearchResponse(q.kind, totals, present.facet_by_language(matched), repos, shown.drop("sections"), lines, matched, recall, us())
