"""Which scanned files are taken up, and why the others are not: one pass with a reason per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.corpus import LANGUAGES
from codelens.functions import text as T
from codelens.options import IngestOptions

IMAGES = ("png", "jpg", "jpeg", "gif", "bmp", "ico", "webp", "svg", "tif", "tiff", "psd")
MORE_LANGUAGES = {
    "cc": "C++", "cpp": "C++", "cxx": "C++", "hpp": "C++", "hh": "C++", "cs": "C#", "rb": "Ruby", "php": "PHP", "ts": "TypeScript", "tsx": "TypeScript", "kt": "Kotlin", "scala": "Scala",
    "swift": "Swift", "sh": "Shell", "bash": "Shell", "sql": "SQL", "html": "HTML", "htm": "HTML", "css": "CSS", "xml": "XML", "proto": "Protocol Buffer", "lua": "Lua", "pl": "Perl", "r": "R",
    "m": "Objective-C", "hs": "Haskell", "ml": "OCaml", "clj": "Clojure", "ex": "Elixir", "erl": "Erlang", "dart": "Dart", "vue": "Vue", "toml": "TOML", "ini": "INI", "tex": "TeX",
}
BY_NAME = {"makefile": "Makefile", "dockerfile": "Dockerfile", "cmakelists.txt": "CMake"}
VENDORED = r"(^|/)(vendor|vendors|node_modules|bower_components|third[-_]?party|Godeps)/"
GENERATED_PATH = r"\.(pb\.go|pb\.cc|pb\.h|min\.js|min\.css)$|_pb2(_grpc)?\.py$|(^|/)(package-lock\.json|yarn\.lock|go\.sum|Cargo\.lock)$"
GENERATED_HEAD = r"(?i)\A(?:[^\n]*\n){0,39}[^\n]*(code generated by|do not edit|@generated|autogenerated)"


def base_name(path: str = "local_path") -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: str = "local_path") -> Column:
    """Without the dot, in its own case; empty if there is none."""
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def language(path: str = "local_path") -> Column:
    """By name, else by extension, as T.language_key."""
    known = F.create_map(*[F.lit(x) for kv in ({k: v for k, v in LANGUAGES.items()} | MORE_LANGUAGES).items() for x in kv])
    names = F.create_map(*[F.lit(x) for kv in BY_NAME.items() for x in kv])
    return T.language_key(F.coalesce(F.try_element_at(names, F.lower(base_name(path))), F.try_element_at(known, F.lower(extension(path)))))


def is_binary(content: str = "content") -> Column:
    """A NUL byte, or more than a tenth of the bytes that no text has."""
    text = F.decode(F.col(content).cast("binary"), "ISO-8859-1")
    size = F.octet_length(F.col(content).cast("binary"))
    odd = size - F.length(F.regexp_replace(text, r"[\x01-\x08\x0E-\x1A\x1C-\x1F\x7F]", ""))
    return F.contains(text, F.lit("\x00")) | (odd * 10 > size)


def reasons(files: DataFrame, options: IngestOptions = IngestOptions()) -> DataFrame:
    """Adds language, n_lines and reason: the first rule that a file fails, null if it is taken up. files: local_path, content (text or binary)."""
    content = F.col("content")
    text = content if dict(files.dtypes)["content"] == "string" else F.decode(content, "UTF-8")
    ext, base = extension(), base_name()
    f = files.withColumn("language", language()).withColumn("n_lines", T.n_lines(text))
    in_list = lambda c, values: c.isin(list(values)) if values else F.lit(False)
    rules: list[tuple[str, Column]] = [("extension_denied", in_list(ext, options.deny_extensions))]
    if options.allow_extensions:
        rules.append(("extension_not_allowed", ~in_list(ext, options.allow_extensions)))
    if options.filter_dot_files:
        rules.append(("dot_file", F.trim(base).startswith(".")))
    if options.max_bytes > 0:
        rules.append(("too_large", F.octet_length(content) > options.max_bytes))
    if options.filter_binary:
        rules.append(("binary", is_binary()))
    if options.filter_images:
        rules.append(("image", F.lower(ext).isin(list(IMAGES))))
    if options.filter_vendored:
        rules.append(("vendored", F.col("local_path").rlike(VENDORED)))
    if options.filter_generated:
        rules.append(("generated", F.col("local_path").rlike(GENERATED_PATH) | text.rlike(GENERATED_HEAD)))
    if options.max_lines > 0:
        rules.append(("too_many_lines", F.col("n_lines") > options.max_lines))
    rules.append(("language_denied", in_list(F.col("language"), options.deny_languages)))
    if options.allow_languages:
        rules.append(("language_not_allowed", ~in_list(F.col("language"), options.allow_languages)))
    elif not options.allow_unknown:
        rules.append(("language_unknown", F.col("language") == "unknown"))
    reason = F.when(content.isNull() | F.col("local_path").isNull(), "no_content")
    for name, test in rules:
        reason = reason.when(test, name)
    return f.withColumn("reason", reason)


def reject_counts(judged: DataFrame) -> DataFrame:
    """Files by reason. Files denied by their extension are not counted."""
    return judged.where("reason is not null and reason != 'extension_denied'").groupBy("reason").agg(F.count("*").alias("n_files"))


def language_stats(taken: DataFrame) -> DataFrame:
    """Files, lines and bytes by language, most lines first."""
    s = taken.groupBy("language").agg(F.count("*").alias("n_files"), F.sum("n_lines").alias("n_lines"), F.sum(F.octet_length("content")).alias("n_bytes"))
    return s.orderBy(F.desc("n_lines"), "language")
