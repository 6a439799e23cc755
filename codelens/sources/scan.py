"""Files and repositories from folders, clones and memory; symbols from an outside program.

Files are (local_path, content as binary); repositories (local_path, remote_url)."""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.options import CtagsOptions, IngestOptions

FILES = "local_path string, content binary"
SYMBOLS = "local_path string, sym string, line_no int, kind string, language string"


LISTED_LEVELS = 2
BATCH_BYTES = 32 << 20


def _pruned(names: list[str], options: IngestOptions) -> list[str]:
    return sorted(n for n in names if n not in options.ignore_dirs and not (options.filter_dot_files and n.startswith(".")))


def _walk(root: str, options: IngestOptions, levels: int | None = None):
    """(folder, names of files in it, has a repository), through links but not round in circles; folders that cannot be read are skipped."""
    seen: set[str] = set()
    pending = [(root, 0)]
    while pending:
        folder, level = pending.pop()
        real = os.path.realpath(folder)
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        if real in seen:
            continue
        seen.add(real)
        inner = [e.name for e in entries if e.is_dir()]
        yield folder, [e.name for e in entries if e.is_file()], ".git" in inner
        if levels is None or level < levels:
            pending += [(os.path.join(folder, n), level + 1) for n in reversed(_pruned(inner, options))]


def _subtrees(spark: SparkSession, path: str, options: IngestOptions) -> DataFrame:
    """Folders to walk, as (folder, whole): the upper levels by themselves, those below with all that is under them."""
    path = os.path.abspath(path)
    upper = list(_walk(path, options, LISTED_LEVELS))
    depth = lambda p: p.removeprefix(path).count("/")
    rows = [(p, depth(p) == LISTED_LEVELS) for p, _, _ in upper]
    return spark.createDataFrame(rows, "folder string, whole boolean").repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)))


def directory(spark: SparkSession, path: str, options: IngestOptions = IngestOptions()) -> DataFrame:
    """Every file under a folder that all executors see, through links, but for folders that are left out by name or, with filter_dot_files, by a leading dot.

    The driver lists the upper levels only; each task walks and reads its subtrees. Spark's own binaryFile reader would pass over every name with a leading dot or underscore."""

    def read(batches):
        for b in batches:
            out, held = [], 0
            for folder, whole in zip(b["folder"], b["whole"]):
                for inner, names, _ in _walk(folder, options, None if whole else 0):
                    for name in names:
                        try:
                            with open(os.path.join(inner, name), "rb") as f:
                                data = f.read()
                        except OSError:
                            continue
                        out.append((os.path.join(inner, name), data))
                        held += len(data)
                        if held > BATCH_BYTES:
                            yield pd.DataFrame(out, columns=["local_path", "content"])
                            out, held = [], 0
            yield pd.DataFrame(out, columns=["local_path", "content"])

    return _subtrees(spark, path, options).mapInPandas(read, FILES)


def repositories(spark: SparkSession, path: str, allow: tuple[str, ...] = (), options: IngestOptions = IngestOptions()) -> DataFrame:
    """Folders that hold .git, with the URL of their origin if there is just one. With an allow list, those whose URL is in it."""

    def find(batches):
        for b in batches:
            out = []
            for folder, whole in zip(b["folder"], b["whole"]):
                for inner, _, holds in _walk(folder, options, None if whole else 0):
                    if holds:
                        out.append((inner, _origin(os.path.join(inner, ".git", "config"))))
            yield pd.DataFrame(out, columns=["local_path", "remote_url"])

    r = _subtrees(spark, path, options).mapInPandas(find, "local_path string, remote_url string")
    return r.where(F.col("remote_url").isin(list(allow))) if allow else r


def _origin(config: str) -> str | None:
    try:
        with open(config, encoding="utf-8", errors="replace") as f:
            text = f.read()
    except OSError:
        return None
    section = re.search(r'\[remote "origin"\]([^\[]*)', text)
    urls = re.findall(r"(?m)^\s*url\s*=\s*(\S+)", section[1]) if section else []
    return urls[0] if len(urls) == 1 else None


def git_remote(spark: SparkSession, url: str, folder: str, options: IngestOptions = IngestOptions()) -> tuple[DataFrame, DataFrame]:
    """Clones the head of a remote into a folder that all executors see; (files, repositories). Paths are unique with the folder in them."""
    target = os.path.join(folder, url.rstrip("/").rsplit("/", 1)[-1].removesuffix(".git"))
    subprocess.run(["git", "clone", "--quiet", "--depth", "1", url, target], check=True)
    return directory(spark, target, options), spark.createDataFrame([(os.path.abspath(target), url)], "local_path string, remote_url string")


def pull(spark: SparkSession, repos: DataFrame) -> DataFrame:
    """git pull in every repository's folder, on the executors (the folder is shared): (local_path, pulled)."""

    def run(batches):
        for b in batches:
            ok = [subprocess.run(["git", "-C", p, "pull", "--quiet"], capture_output=True).returncode == 0 for p in b["local_path"]]
            yield pd.DataFrame({"local_path": b["local_path"], "pulled": ok})

    return repos.select("local_path").mapInPandas(run, "local_path string, pulled boolean")


def memory(spark: SparkSession, files: Iterable[tuple[str, bytes | str]]) -> DataFrame:
    return spark.createDataFrame([(p, c.encode() if isinstance(c, str) else c) for p, c in files], FILES)


def assign_repos(files: DataFrame, repos: DataFrame) -> DataFrame:
    """Adds repo_id and path_in_repo of the innermost repository that a file lies in; repo_id 0 and null for none.

    Every folder above a file is looked up: a join on equal paths, of as many rows as files have folders, and no test of all pairs."""
    parts = F.split("local_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    up = files.select("local_path", F.explode(above).alias("root"))
    roots = repos.groupBy(F.regexp_replace("local_path", "/+$", "").alias("root")).agg(F.min("repo_id").alias("repo_id"))
    best = up.join(roots, "root").groupBy("local_path").agg(F.max_by(F.struct("root", "repo_id"), F.length("root")).alias("r"))
    out = files.join(best, "local_path", "left")
    inside = F.expr("case when r is not null then substr(local_path, length(r.root) + 2) end")
    return out.select(*files.columns, F.coalesce("r.repo_id", F.lit(0)).cast("bigint").alias("repo_id"), inside.alias("path_in_repo"))


def with_repo_ids(repos: DataFrame, ids: DataFrame | dict[str, int] | None = None) -> DataFrame:
    """Adds repo_id: that given for the remote URL, else one made from the path (positive, the same in every run). 0 is refused: it stands for no repository."""
    made = F.pmod(F.xxhash64("local_path"), F.lit((1 << 62) - 1)) + 1
    if ids is None:
        return repos.withColumn("repo_id", made)
    if isinstance(ids, dict):
        if 0 in ids.values():
            raise ValueError("repository id 0 stands for no repository")
        ids = repos.sparkSession.createDataFrame(list(ids.items()), "remote_url string, given bigint")
    else:
        ids = ids.select("remote_url", F.assert_true(F.col("repo_id") != 0, "repository id 0 stands for no repository").alias("_"), F.col("repo_id").alias("given"))
    return repos.join(ids.select("remote_url", "given"), "remote_url", "left").select(*repos.columns, F.coalesce("given", made).alias("repo_id"))


def ctags(files: DataFrame, options: CtagsOptions) -> DataFrame:
    """Symbols by an outside program, one process per partition: SYMBOLS. files: local_path, content, language. A line that is no JSON is skipped."""
    command = list(options.command)

    def tag(batches):
        p = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            for b in batches:
                out = []
                for path, content in zip(b["local_path"], b["content"]):
                    data = content.encode() if isinstance(content, str) else bytes(content or b"")
                    p.stdin.write(json.dumps({"command": "generate-tags", "filename": path, "size": len(data)}).encode() + b"\n" + data)
                    p.stdin.flush()
                    for line in p.stdout:
                        try:
                            entry = json.loads(line)
                        except ValueError:
                            continue
                        if entry.get("_type") in ("completed", "error"):
                            break
                        if entry.get("_type") == "tag" and entry.get("name"):
                            out.append((path, entry["name"], entry.get("line"), entry.get("kind"), entry.get("language")))
                yield pd.DataFrame(out, columns=["local_path", "sym", "line_no", "kind", "language"])
        finally:
            p.stdin.close()
            p.wait(10)

    wanted = files.where(F.col("language").isin(list(options.languages))) if options.languages else files
    return wanted.select("local_path", "content").mapInPandas(tag, SYMBOLS)
