"""Attribute files of repositories: which paths they declare to be generated or taken over from others.

A line is a glob and attributes. Of the lines that match a path, the last one of the deepest
folder holds. A glob without a slash is matched against the name of a file in any folder
below; one with a slash against the path from the attribute file's folder."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATTRIBUTE_FILE = ".gitattributes"
MARKS = ("linguist-generated", "linguist-vendored")
RULES = "array<struct<nth:int,pattern:string,mark:string,on:boolean>>"


@lru_cache(65536)
def glob(pattern: str) -> re.Pattern:
    """A glob as a pattern for the path from the attribute file's folder."""
    anchored = "/" in pattern.rstrip("/")
    out, i, p = "", 0, pattern.lstrip("/")
    while i < len(p):
        c = p[i]
        if p.startswith("**/", i) and (not i or p[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif p[i:] == "**" and i and p[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := p.find("]", i + 2)) > 0:
            body = p[i + 1 : end].replace("\\", "\\\\")
            out, i = out + ("[^" + body[1:] if body[0] in "!^" else "[" + body) + "]", end + 1
        elif c == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z", re.S)


def rules(text: str) -> list[tuple[int, str, str, bool | None]]:
    """(line, glob, mark, whether it is set, None if it is unset again)."""
    out = []
    for n, line in enumerate(text.splitlines()):
        line = line.strip()
        if not line or line.startswith(("#", "[attr]")):
            continue
        m = re.match(r'"((?:\\.|[^"\\])*)"\s+(.*)|(\S+)\s+(.*)', line)
        if not m:
            continue
        pattern, attributes = (m[1], m[2]) if m[1] is not None else (m[3], m[4])
        if pattern.startswith("!"):  # not allowed
            continue
        for a in attributes.split():
            name, _, value = a.lstrip("-!").partition("=")
            if name in MARKS:
                out.append((n, pattern, name, None if a[0] == "!" else a[0] != "-" and value.lower() not in ("false", "0", "no")))
    return out


def marked(path: str, folders: list[tuple[str, list]]) -> set[str]:
    """Marks of a path. folders: (folder, its rules), from the root down."""
    state: dict[str, bool | None] = {}
    for folder, lines in folders:
        inner = path[len(folder) + 1 :] if folder else path
        for r in lines:
            if glob(r["pattern"]).match(inner):
                state[r["mark"]] = r["on"]
    return {k for k, v in state.items() if v}


def declared(files: DataFrame) -> DataFrame:
    """files: doc_id, repo_id, path, content. (doc_id) of files that attribute files mark. Files are joined to the folders above them that have rules."""
    attributes = files.where(F.substring_index("path", "/", -1) == ATTRIBUTE_FILE)

    def read(batches):
        for b in batches:
            rows = [(r, p.rpartition("/")[0], [dict(zip(("nth", "pattern", "mark", "on"), x)) for x in rules(t)]) for r, p, t in zip(b["repo_id"], b["path"], b["content"]) if t]
            yield pd.DataFrame(rows, columns=["repo_id", "folder", "rules"]).astype({"repo_id": "Int64"})

    folders = attributes.select("repo_id", "path", "content").mapInPandas(read, f"repo_id bigint, folder string, rules {RULES}").where("size(rules) > 0")
    # a table without attribute files ends here: the join below meets no rows
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    up = files.select("doc_id", "repo_id", "path", F.explode(above).alias("folder")).join(folders, ["repo_id", "folder"])
    each = up.groupBy("doc_id", "path").agg(F.array_sort(F.collect_list(F.struct(F.length("folder").alias("depth"), "folder", "rules"))).alias("folders"))

    def judge(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": [d for d, p, fs in zip(b["doc_id"], b["path"], b["folders"]) if marked(p, [(f["folder"], f["rules"]) for f in fs])]}, dtype="int64")

    return each.select("doc_id", "path", "folders").mapInPandas(judge, "doc_id bigint")
