"""Options and requests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class IngestOptions:
    ignore_dirs: tuple[str, ...] = (".git",)
    allow_repos: tuple[str, ...] = ()
    deny_extensions: tuple[str, ...] = ()
    allow_extensions: tuple[str, ...] = ()
    filter_dot_files: bool = True
    max_bytes: int = 128 << 10
    max_lines: int = 5000
    filter_binary: bool = True
    filter_images: bool = True
    filter_vendored: bool = True
    filter_generated: bool = True
    deny_languages: tuple[str, ...] = ()
    allow_languages: tuple[str, ...] = ()
    allow_unknown: bool = False


@dataclass(frozen=True)
class IndexOptions:
    gram_sizes: tuple[int, ...] = (1, 2, 3)
    use_grams: bool = False
    #: Shared folder in which finish() writes the tables; without it they are persisted on the executors.
    path: str | None = None


@dataclass(frozen=True)
class CtagsOptions:
    #: A program that reads {"command": "generate-tags", "filename", "size"} lines, each followed by the text, and writes JSON lines.
    command: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()


@dataclass(frozen=True)
class EngineOptions:
    ingest: IngestOptions = field(default_factory=IngestOptions)
    index: IndexOptions = field(default_factory=IndexOptions)
    ctags: CtagsOptions = field(default_factory=CtagsOptions)
    #: remote URL -> repository id
    repo_ids: dict[str, int] | None = None
    default_order: list[Column] | None = None


@dataclass(frozen=True)
class SearchRequest:
    query: str
    document_ids: DataFrame | list[int] | None = None
    #: Repositories that the caller may see: a table or list of ids, or a function of an id.
    repo_ids: DataFrame | list[int] | None = None
    may_see_repo: Callable[[int], bool] | None = None
    page: int = 0
    page_size: int = 0
    documents_per_repo: int = 0
    documents_in_single_repo: int = 0
    lines_per_document: int = 0
    context_lines: int = 0
    return_content: bool = True
    start_tag: str = ""
    end_tag: str = ""
    document_order: Callable[[], list[Column]] | None = None
    repo_order: Callable[[], list[Column]] | None = None
    timeout_ms: int = 0


WEB_PAGE = 200


def web_request(query: str, doc_id: int | None = None, page: int = 0, page_size: int = WEB_PAGE) -> SearchRequest:
    """What the web page asks for: little of many repositories, or all of one document."""
    return SearchRequest(
        query,
        document_ids=None if doc_id is None else [doc_id],
        page=max(page, 0),
        page_size=min(page_size if page_size > 0 else WEB_PAGE, WEB_PAGE),
        documents_per_repo=3,
        documents_in_single_repo=200,
        lines_per_document=3 if doc_id is None else 0,
        context_lines=2 if doc_id is None else 10000,
        timeout_ms=2000,
    )


def terminal_request(query: str) -> SearchRequest:
    return SearchRequest(query, page_size=1000, documents_per_repo=100, documents_in_single_repo=100, lines_per_document=30)
