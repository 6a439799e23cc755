"""Problem 1: files whose whole content is not valid syntax of their language.

Each file is parsed by the grammar of its language: go, java, javascript, c and rust by
packrat parsers (codelens.llm.grammars); python by Python's own, which is one as well; json
and yaml by their deterministic parsers. A file that fails goes through all other grammars,
in the order in which its tokens speak for them: one that succeeds says that the file is
filed under a wrong extension, none that it is corrupt."""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections import Counter

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.corpus import files
from codelens.llm.grammars import LANGUAGES, RESERVED, Parsed

ALL = (*LANGUAGES, "python", "json", "yaml")
PYTHON_WORDS = "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield None True False"
WORD = re.compile(r"[A-Za-z_]\w*")
YAML_LINE, JSON_LINE = re.compile(r"(?m)^[ \t]*(?:- )?[\w.\"'-]+:(?= |$)"), re.compile(r"(?m)^[ \t]*(?:\"[^\"\n]*\"\s*:|[{}\[\]])")
CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7}|={7})(?: |\r?$)", re.M)


def _constant(x: str):
    raise ValueError(x)


def _python(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def _json(text: str) -> bool:
    try:
        json.loads(text, parse_constant=_constant)
        return True
    except (ValueError, RecursionError):
        return False


def _yaml(text: str) -> bool:
    try:
        for _ in yaml.parse(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
            pass
        return True
    except yaml.YAMLError:
        return False


OTHERS = {"python": _python, "json": _json, "yaml": _yaml}


def valid(language: str, text: str, toks: list[tuple[str, str, int]] | None = None) -> bool:
    """text and markdown are always valid, and so is an empty file but in json. toks: the text's tokens, if they are known."""
    if language == "json":
        return _json(text)
    bare = text.lstrip("\ufeff")
    if language not in ALL or not bare.strip():
        return True
    return OTHERS[language](bare) if language in OTHERS else Parsed(language, bare, toks if bare == text else None).valid


def ranked(text: str) -> list[str]:
    """Languages by the share of a text's tokens that speak for them, best first; those that none speaks for are last."""
    words = Counter(WORD.findall(text))
    total = sum(words.values()) or 1
    score = {n: sum(words[w] for w in r.split()) / total for n, r in {**RESERVED, "python": PYTHON_WORDS}.items()}
    lines = text.count("\n") + 1
    score["yaml"], score["json"] = (len(x.findall(text)) / lines / 4 for x in (YAML_LINE, JSON_LINE))
    if not text.lstrip().startswith(("{", "[")):
        score["json"] = 0.0
    return sorted(ALL, key=lambda n: (-score[n], n))


def verdict(language: str, text: str) -> tuple[str, str | None] | None:
    """None for a valid file, else (wrong_extension, the language that it is of) or (merge_conflict or corrupt, None)."""
    if valid(language, text):
        return None
    if not text.strip():
        return "corrupt", None
    for other in ranked(text):
        # a single plain value is yaml as well, whatever it is
        if other != language and not (other == "yaml" and not YAML_LINE.search(text)) and valid(other, text):
            return "wrong_extension", other
    return ("merge_conflict" if CONFLICT.search(text) else "corrupt"), None


def judged(code: DataFrame) -> DataFrame:
    """(doc_id, fault, parses_as) of the invalid files. code: doc_id, language, content. Files without content are no cases."""

    def cases(batches):
        for b in batches:
            rows = [(d, *v) for d, n, t in zip(b["doc_id"], b["language"], b["content"]) if t is not None and (v := verdict(n, t))]
            yield pd.DataFrame(rows, columns=["doc_id", "fault", "parses_as"]).astype({"doc_id": "int64"})

    return code.select("doc_id", "language", "content").mapInPandas(cases, "doc_id bigint, fault string, parses_as string")


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where("language not in ('text', 'markdown')")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(_code(spark, sf_dir)).select("doc_id")


def p1_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each invalid file."""
    return judged(_code(spark, sf_dir))


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_id, language, n_files, n_invalid, rate) of each repository and language."""
    code = _code(spark, sf_dir).where("content is not null")
    each = code.select("doc_id", "repo_id", "language").join(judged(code), "doc_id", "left")
    rates = each.groupBy("repo_id", "language").agg(F.count("*").alias("n_files"), F.count("fault").alias("n_invalid"))
    return rates.withColumn("rate", F.col("n_invalid") / F.col("n_files"))
