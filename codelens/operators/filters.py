"""Where a search looks: modifiers, access lists and lists of documents, as tests of columns and semi joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.query import re2
from codelens.query.tree import Leaf, Node


def matches(name: Column, text: str, equal: bool) -> Column:
    """Whether a name is a text (if that counts) or its pattern stands in it, whatever the case. An invalid pattern matches nothing."""
    name = F.coalesce(name, F.lit(""))
    try:
        by_pattern = name.rlike(f"(?iu){re2.compile(f'(?i){text}').java}")
    except re2.PatternError:
        by_pattern = F.lit(False)
    return (name == text) | by_pattern if equal else by_pattern


def holds(node: Node | None, name: Column, equal: bool) -> Column | None:
    """A tree of modifiers as a test of the name they are about."""
    if node is None:
        return None
    if isinstance(node, Leaf):
        test = matches(name, node.text, equal)
        return ~test if node.negated else test
    out = None
    for p in node.parts:
        test = holds(p, name, equal)
        out = test if out is None else out & test if node.op == "AND" else out | test
    return out


def restrict(docs: DataFrame, lang: Node | None = None, repo: Node | None = None, file: Node | None = None) -> DataFrame:
    """Documents that pass every modifier; cheap tests first. Documents without a repository have an empty repository name."""
    for test in (holds(lang, F.col("language"), True), holds(repo, F.col("repo_name"), True), holds(file, F.col("filename"), False)):
        if test is not None:
            docs = docs.where(test)
    return docs


def allowed(rows: DataFrame, ids: DataFrame | list[int] | None, key: str) -> DataFrame:
    """Rows whose key is in a list, or in the key column of a table (a semi join, so that its size does not matter)."""
    if ids is None:
        return rows
    if isinstance(ids, DataFrame):
        return rows.join(ids.select(key), key, "left_semi")
    return rows.where(F.col(key).isin(list(ids)))


def allowed_by(repos: DataFrame, hook: Callable[[int], bool]) -> DataFrame:
    """The repository ids that a Python hook lets through, asked once for every repository on the executors."""

    def ask(batches):
        for b in batches:
            yield b[[bool(hook(int(r))) for r in b["repo_id"]]]

    return repos.select("repo_id").where("repo_id is not null").distinct().mapInPandas(ask, "repo_id bigint")
