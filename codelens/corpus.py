"""Tables of TESTDATA.md as the operators need them: every file, repository, line, symbol and posting once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.functions import text as T

LANGUAGES = {
    "go": "go", "py": "python", "pyi": "python", "java": "java", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "c": "c", "h": "c", "rs": "rust", "json": "json", "yaml": "yaml", "yml": "yaml", "txt": "text", "md": "markdown", "markdown": "markdown",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per doc_id. Of redelivered rows the latest value of each column that is there stands; the path stands in for a null language."""
    f = table(spark, sf_dir, "source_files")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("walked_at", F.hash(c)))).alias(c)
    f = f.groupBy("doc_id").agg(*map(latest, ("local_path", "path_in_repo", "repo_id", "language", "content")))
    path = F.coalesce("path_in_repo", "local_path")
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return f.withColumn("language", F.coalesce("language", F.try_element_at(known, ext), F.lit("text")))


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per repo_id; the name is the remote URL, else the local path."""
    r = table(spark, sf_dir, "repos").groupBy("repo_id").agg(F.max("local_path").alias("local_path"), F.max("remote_url").alias("remote_url"))
    return r.withColumn("name", F.coalesce(F.expr("nullif(remote_url, '')"), "local_path"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searchable files: doc_id, repo_id, repo_name, language, filename, content. A file without content is none; repo_id 0 stands for no repository."""
    f = files(spark, sf_dir).where("content is not null")
    # the repositories are a dimension that may grow with the data: Spark broadcasts them only while they are small
    f = f.join(repos(spark, sf_dir).select("repo_id", F.col("name").alias("repo_name")), "repo_id", "left")
    name = F.coalesce(F.expr("nullif(path_in_repo, '')"), "local_path")
    return f.select("doc_id", F.coalesce("repo_id", F.lit(0).cast("bigint")).alias("repo_id"), "repo_name", "language", name.alias("filename"), "content")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (0-based), start (byte), content with its line end. From the content, as start of code_lines may be null."""
    return docs.select("doc_id", F.inline(T.lines("content")))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries once each. sym may stand elsewhere than line_no says; where it does not stand in its line, the entry finds nothing."""
    return table(spark, sf_dir, "symbols").select("doc_id", "sym", "line_no").where("sym is not null and sym != ''").distinct()


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gram (lower case), doc_id, locations: ascending, each once, over all shards. A gram without any location is left out."""
    p = table(spark, sf_dir, "postings").select(T.fold("gram").alias("gram"), "doc_id", F.explode("locations").alias("at")).where("gram is not null and doc_id is not null and at is not null")
    return p.groupBy("gram", "doc_id").agg(F.sort_array(F.collect_set("at")).alias("locations"))
