"""Problem 3: files that nobody wrote by hand for their repository.

Declared: attribute files of repositories (codelens.llm.attributes). Mined, for the
repositories that declare nothing: names of folders that others' code is kept in. Such a
folder is told by what stands in it: in several repositories nearly all its files lie in
folders named after projects, names that hardly stand anywhere else, whereas what lies in an
ordinary folder has names that stand in many. A folder is mined as well if its files are
declared in several repositories. Besides, files are judged by their own content (made by a
tool, compressed, data), and copies of files of a repository that their path names are found
by content."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.corpus import files, table
from codelens.llm import attributes
from codelens.llm.source import tokens

#: Repositories that a folder must stand in, and its files at least, to be mined.
LEAST_REPOS, LEAST_FILES = 2, 5
#: Share of a folder's files that must lie in folders named after projects, or be declared.
MINED_SHARE = 0.9
#: A name is a project's if it stands under no more than this share of the folders that names stand under at the median.
RARE_PARENTS = 0.25
MADE = re.compile(
    r"(?i)\bgenerated (?:by|from|with)\b.*\bdo not (?:edit|modify)|^\W*@generated\b|<auto-?generated\b|^\W*auto-?generated\b.*(?:\(|do not|by|regenerate)|\bdo not (?:edit|modify)\b.*\b(?:generated|by hand)\b|"
    r"^\W*(?:eslint-disable|prettier-ignore|noqa|nolint) -- output of|(?:regenerate|re-generate) instead of editing|produced (?:from|by) .*\b(?:do not (?:edit|modify)|by hand)|this file (?:was|is) (?:automatically )?(?:generated|produced|created) (?:automatically )?by|automatisch (?:erzeugt|generiert|erstellt)|自动生成|自動生成|généré automatiquement|généré par|generado (?:automáticamente|por)|автоматически (?:создан|сгенерирован)|сгенерирован"
)
HEAD_LINES = 25
NUMBER = r"-?\d[\w.]*+"
RUN = re.compile(rf"(?:[\[\]{{}}(),\s]|{NUMBER}|\"(?:\\.|[^\"\\\n])*+\"|'(?:\\.|[^'\\\n])*+')++")
BLOB = re.compile(r"[\"'][^\s\"']{600,}+[\"']")
HINT = re.compile(r"(?i)generat|output of|produced|do not|created|erzeugt|generi|erstellt|生成|génér|generado|автоматически|сгенерирован")
NUMBERED = re.compile(r"(?<![A-Za-z])[A-Za-z]\w*_(\d+)\b[^=\n]*=\s*(\d+)\s*;?\s*$|\(\w+,\s*(\d+)\)\s*;?\s*\}?\s*$", re.M)
LOCKED = re.compile(r'"(?:integrity|resolved|checksum)"\s*:')


def made_by_tool(language: str, text: str) -> bool:
    if language == "json":
        return len(LOCKED.findall(text)) >= 5 and bool(re.search(r'"(?:lockfileVersion|packages|dependencies|version)"', text))
    head = "\n".join(text.split("\n", HEAD_LINES)[:HEAD_LINES])
    return any(kind == "comment" and any(MADE.search(line) for line in t.splitlines()) for kind, t, _ in tokens(language, head)) if HINT.search(head) else False


def counted(text: str) -> bool:
    """Whether most statements are numbered through, as constants and accessors that a tool writes."""
    numbers = [int(a or c) for a, b, c in NUMBERED.findall(text) if c or a == b]
    in_turn = sum(y == x + 1 for x, y in zip(numbers, numbers[1:]))
    statements = sum(bool(re.search(r"=|\breturn\b|\)\s*;?\s*$", x)) for x in text.splitlines() if not x.lstrip().startswith(("#", "//", "*", "/*")))
    return in_turn >= 5 and in_turn > 0.7 * (statements - 1)


def compressed(language: str, text: str) -> bool:
    if language != "javascript":
        return False
    code = re.sub(r"/\*[\s\S]*?\*/|^\s*//[^\n]*", "", text, flags=re.M).strip()
    lines = [x for x in code.split("\n") if x.strip()]
    if not lines or max(map(len, lines)) < 300:
        return False
    long = max(lines, key=len)
    bare = re.sub(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|`[^`]*`', '""', long)
    return len(long) > 0.6 * len(code) and len(bare) > 200 and len(re.findall(r"[;{},=]", bare)) > 20 and sum(c in " \t" for c in bare) < 0.12 * len(bare)


def data(language: str, text: str) -> bool:
    if language in ("json", "yaml"):
        return False
    held = 0
    for m in RUN.finditer(text):
        run = m[0]
        if len(run) > 200 and (run.count(",") >= 30 or BLOB.search(run)):
            held += len(run)
    return held > 0.5 * len(text)


def pair(parts, n):
    """Names of a folder and the one above it; null at the root."""
    return F.when(n > 1, F.concat_ws("/", F.get(parts, n - 2), F.get(parts, n - 1)))


def mined(paths: DataFrame, declared_ids: DataFrame | None = None) -> DataFrame:
    """(folder): names of folders, or of two one in the other, that hold others' code. paths: doc_id, repo_id, path."""
    inner = lambda parts, n: F.when(n < F.size(parts) - 1, F.get(parts, n))
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array(F.struct(F.get(parts, n - 1).alias("folder"), inner(parts, n).alias("inner")), F.struct(pair(parts, n).alias("folder"), inner(parts, n).alias("inner"))))
    edges = paths.where(F.size(parts) > 1).select("doc_id", "repo_id", F.inline(F.flatten(steps))).where("folder != ''")
    counted = edges.groupBy("folder", "inner", "repo_id").agg(F.count("*").alias("n"))  # no more rows than folders of repositories from here
    parents = counted.where("inner is not null and not contains(folder, '/')").groupBy("inner").agg(F.count_distinct("folder").alias("parents"), F.sum("n").alias("files"))
    usual = parents.agg(F.percentile_approx("parents", 0.5).alias("m")).scalar()
    rare = parents.where(F.col("parents") <= F.greatest(F.lit(1), F.floor(RARE_PARENTS * usual))).select("inner", F.lit(True).alias("rare"))
    each = counted.join(rare, "inner", "left").groupBy("folder").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("rare"), F.col("n")).otherwise(0)).alias("rare"), F.count_distinct("repo_id").alias("repos"), F.count_distinct("inner").alias("inners")
    )
    by_names = each.where((F.col("repos") >= LEAST_REPOS) & (F.col("n") >= LEAST_FILES) & (F.col("inners") >= LEAST_REPOS) & (F.col("rare") >= MINED_SHARE * F.col("n"))).select("folder")
    if declared_ids is None:
        return by_names
    marks = edges.select("doc_id", "repo_id", "folder").distinct().join(declared_ids.withColumn("declared", F.lit(1)), "doc_id", "left")
    said = marks.groupBy("folder").agg(F.count("*").alias("n"), F.count("declared").alias("d"), F.count_distinct(F.when(F.col("declared") == 1, F.col("repo_id"))).alias("repos"))
    by_marks = said.where((F.col("repos") >= LEAST_REPOS) & (F.col("d") >= MINED_SHARE * F.col("n"))).select("folder")
    return by_names.union(by_marks).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos = table(spark, sf_dir, "repos")
    roots = repos.groupBy("repo_id").agg(F.max("local_path").alias("root"))
    f = files(spark, sf_dir).where("content is not null").join(roots, "repo_id", "left")
    inside = F.expr("case when root is not null and startswith(local_path, root || '/') then substr(local_path, length(root) + 2) end")
    f = f.withColumn("path", F.coalesce("path_in_repo", inside, "local_path"))
    body = F.when((F.length("content") >= 40) & ~F.col("language").isin("text", "markdown"), F.xxhash64(F.regexp_replace("content", r"\s+", "")))

    def judge(batches):
        for b in batches:
            is_code = ~b["language"].isin(["text", "markdown"])
            own = [bool(c and t and (made_by_tool(n, t) or counted(t) or compressed(n, t) or data(n, t))) for c, n, t in zip(is_code, b["language"], b["content"])]
            rules = [t if (p or "").rpartition("/")[2] == attributes.ATTRIBUTE_FILE else None for p, t in zip(b["path"], b["content"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "repo_id": b["repo_id"].astype("Int64"), "path": b["path"], "code": is_code, "own": own, "body": b["body"].astype("Int64"), "content": pd.Series(rules, dtype="object")})

    # texts are read and shuffled once; all that follows is about paths and hashes
    read = f.select("doc_id", "repo_id", "path", "language", "content", body.alias("body"))
    read = read.mapInPandas(judge, "doc_id bigint, repo_id bigint, path string, code boolean, own boolean, body bigint, content string").persist()
    code = read.where("code")
    found = code.where("own").select("doc_id")
    declared = attributes.declared(read.select("doc_id", "repo_id", "path", "content"))
    folders = mined(code.select("doc_id", "repo_id", "path"), declared)
    parts = F.split("path", "/")
    above = F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array(F.get(parts, n - 1), pair(parts, n))))
    inner = code.where(F.size(parts) > 1).select("doc_id", F.explode(above).alias("folder"))
    kept = inner.join(folders, "folder", "left_semi").select("doc_id")
    known = code.select("doc_id").join(declared, "doc_id", "left_semi")

    def last(c: str):
        return F.lower(F.regexp_extract(F.col(c), r"([^/:]+?)(?:\.git)?/*$", 1))

    names = repos.select("repo_id", last("remote_url").alias("seg")).union(repos.select("repo_id", last("local_path"))).where("seg != ''").distinct().withColumnRenamed("repo_id", "of_repo")
    body = code.where("body is not null").select("doc_id", "repo_id", "path", "body")
    named = body.select("doc_id", "repo_id", "body", F.explode(F.split(F.lower(F.regexp_replace("path", r"/?[^/]*$", "")), "/")).alias("seg")).where("seg != ''")
    named = named.join(names, "seg").where("of_repo != repo_id").select("doc_id", "of_repo", "body")
    origins = body.select(F.col("repo_id").alias("of_repo"), "body").distinct()
    copies = named.join(origins, ["of_repo", "body"]).select("doc_id")
    return found.union(kept).union(known).union(copies).distinct()


def p3_mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of folders that are mined."""
    repos = table(spark, sf_dir, "repos").groupBy("repo_id").agg(F.max("local_path").alias("root"))
    f = files(spark, sf_dir).join(repos, "repo_id", "left").where("language not in ('text', 'markdown')")
    inside = F.expr("case when root is not null and startswith(local_path, root || '/') then substr(local_path, length(root) + 2) end")
    return mined(f.select("doc_id", "repo_id", F.coalesce("path_in_repo", inside, "local_path").alias("path")))
