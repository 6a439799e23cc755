"""Problem 4: lines that hold credentials, and the content with the credentials masked.

Three passes. (1) Every literal of the corpus is indexed: string literals, and bare values
in the places that credentials stand in, with the repositories that hold them and whether
one of its places says that it is a credential (its name, its form, a URL, a header, a
command). (2) Literals that more than OWNERS repositories share are placeholders; of the
others those that are rare, drawn in form and said to be credentials somewhere are secrets.
(3) Every file is searched for all secrets with an Aho-Corasick automaton, so that a secret
is found where nothing but its characters says what it is."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.corpus import files

PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<body>[\s\S]*?)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)")
SECRET_NAME = re.compile(
    r"(?i)secret|passw(?:or)?d|passphrase|pass_?phrase|(?:^|[_-])(?:pwd|pass|psk|pin)$|[a-z]Pass$|^pwd|token|api[_-]?key|(?:access|account|storage|service|signing|encryption|master|shared|auth|client|private|deploy|host|session|license)[_-]?key|shared[_-]?access|credential|auth$|bearer"
)
NOT_SECRET_NAME = re.compile(r"(?i)public|cert|(?:name|path|field|label|mode|unit|code|file|type|url|uri|id|count|size|len|length|limit|hint|env|var|ref|note\w*|hash|digest|expiry|ttl)$|^note|tokenizer|tokens$")
NAMED_ID = re.compile(r"(?i)(?:^|[_-])id[_-]?token$")
PLACEHOLDER = re.compile(
    r"(?i)^\W*$|^<.*>$|\$\{?\(?[A-Za-z_]|\{\{|%\(|%[A-Z_]+%|^(?:x+|\*+|\.+|-+|_+|0+|#+)$|change[_-]?me|replace[_-]?(?:me|this)|your[_-]|example|placeholder|redacted|dummy|to-?do|insert[_-]|todo|not-?a-?|fixme|none|null|^(?:true|false|nil)$|^(?:file|env|vault|ssm|secret|arn|https?):|^/|^process\.|^os\.|getenv|environ|env\."
)
LITERAL = r"(?:[rbuRBU]{0,2}|@)(?P<q%d>\"\"\"|'''|[\"'`])(?P<v%d>(?:(?!(?P=q%d))[^\n\\]|\\.)*)(?P=q%d)"
ASSIGNED = re.compile(
    r"(?<![A-Za-z_$])(?P<name>[A-Za-z_$][\w$.-]*+)(?:\[\])?[\"']?\s*(?::\s*&?(?:'?static )?[A-Za-z_][\w<>&. ]*?\s*=|:=|=>|[:=](?!=))\s*\(?\s*" + LITERAL % (1, 1, 1, 1)
)
MORE = re.compile(r"\s*(?:\+|\.|\\|,(?=\s*\n\s*\+)|)\s*\+?\s*" + LITERAL % (2, 2, 2, 2))
BARE = re.compile(r"(?<![A-Za-z_])(?P<name>[A-Za-z_][\w-]*+)[ \t]*(?::|=)[ \t]*(?:[|>]-?[ \t]*\r?\n[ \t]+)?(?P<v>[^\s\"'`;,&<>(){}\[\]$=]{8,}={0,2})(?=[\s\"'`;,&)]|$)", re.M)
HEADER = re.compile(r"(?i)(?:\b(?:bearer|basic|token)[ ]+|\b(?:x-[a-z-]*(?:auth|key|token|secret)[a-z-]*|authorization)[\"']?\s*[:=]\s*[\"']?(?:(?:bearer|basic|token)\s+)?)(?P<v>[A-Za-z0-9+/_.~-]{12,}={0,2})")
URL = re.compile(r"(?<![a-z])[a-z][a-z0-9+.-]*+://[^\s/:@\"'`<>]*:(?P<v>[^\s/@\"'`<>]+)@", re.I)
COMMAND = re.compile(r"(?:\s-p[ =]?|--(?:password|token|secret|api-key)[ =]|\s-u[ ]?[\w.]+:)(?P<v>[^\s\"'`;]{6,})")
TAGGED = re.compile(r"(?<![\w+/=-])(?P<v>(?!sha\d|md5|ssh|uuid|key|v\d)[a-z]{2,4}\d?[_-](?:(?:live|test|prod)[_-])?[A-Za-z0-9]{20,}|(?:AKIA|ASIA)[A-Z0-9]{16}|eyJ[\w-]{8,}\.(?:eyJ)?[\w-]{8,}\.[\w-]{8,})(?![\w+/=-])")
CALL = re.compile(r"(?i)\b(?:log_?in|sign_?in|open_?session|dial|connect|authenticate|auth|set_?password)\((?:[^()\n]*,)?\s*" + (LITERAL % (1, 1, 1, 1)) + r"\s*\)")
UUID = re.compile(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")
#: A text without any of these holds nothing that is looked for, but tagged values.
HINTS = ("secret", "pass", "pwd", "token", "key", "auth", "bearer", "basic", "login", "log_in", "signin", "sign_in", "session", "dial", "connect", "access", "credential", "://", " -p", "\n-p", "\t-p", " -u", "\n-u", "\t-u", "psk", "pin")


def random_like(v: str, least: int = 6) -> bool:
    """Whether a value looks drawn, not written: no placeholder, no reference, no words."""
    if len(v) < least or PLACEHOLDER.search(v) or UUID.match(v) or re.search(r"\s", v) or re.fullmatch(r"[\d.,:_-]+", v):
        return False
    if v.startswith(("ssh-", "-----BEGIN", "sha256-", "sha384-", "sha512-")):
        return False
    if re.fullmatch(r"[A-Za-z_]\w*(?:\.\w+)+(?:\(.*\))?", v) and not re.search(r"\d[a-z]+\d|[A-Z]\d|\d[A-Z]", v):
        return False
    classes = bool(re.search("[a-z]", v)) + bool(re.search("[A-Z]", v)) + bool(re.search(r"\d", v)) + bool(re.search(r"[^\w\s.-]", v))
    if re.fullmatch(r"[A-Za-z]?[a-z]+(?:[-_. /][a-z]+)*", v) or re.fullmatch(r"(?:[A-Za-z]?[a-z]+[\W_]?)+", v) and not re.search(r"[^\w.-]", v) and not re.search(r"[a-z][A-Z].*[A-Z]{2}|[A-Z].*[a-z][A-Z][a-z]?[A-Z]", v):
        return False
    return classes >= 2


def spans(text: str) -> list[tuple[int, int]]:
    """Places of the secret characters."""
    got: list[tuple[int, int]] = []
    low = text.lower()
    if not any(h in low for h in HINTS) and not TAGGED.search(text):
        return got
    keys = [(m.start(), m.end()) for m in re.finditer(r"-----BEGIN[\s\S]*?(?:-----END[^\n]*?-----|\Z)", text)] if "-----BEGIN" in text else []
    if keys:
        for m in PRIVATE.finditer(text):
            a, b = m.span("body")
            body = text[a:b]
            if re.search(r"[A-Za-z0-9+/=]{16,}", body):
                got += [(a + x.start(), a + x.end()) for x in re.finditer(r"[A-Za-z0-9+/=]{4,}", body.replace("\\n", "  "))] if "\n" not in body else [(a + x.start(), a + x.end()) for x in re.finditer(r"(?<=\n)[^\n]*\S[^\n]*(?=\n)", body)]

    def add(m: re.Match, g: str, least: int = 6, any_: bool = False) -> None:
        a, b = m.span(g)
        if not any(x <= a < y for x, y in keys) and (any_ or random_like(text[a:b], least)):
            got.append((a, b))

    for m in ASSIGNED.finditer(text):
        pieces, at = [m.span("v1")], m.end()
        while (n := MORE.match(text, at)) and (n[0][: n.start("q2") - n.start()].strip() or "\n" in n[0]) and "\n" in text[at : n.start("q2")] + ("\n" if "+" in n[0][:4] else ""):
            pieces.append(n.span("v2"))
            at = n.end()
        value = "".join(text[a:b] for a, b in pieces)
        if not secret_name(m["name"]):
            got += pieces if len(pieces) > 1 and (TAGGED.fullmatch(value) or (n := URL.match(value)) and not PLACEHOLDER.search(n["v"]) or HEADER.match(value)) else []
        elif not any(x <= pieces[0][0] < y for x, y in keys) and random_like(value) and not HEADER.match(value) and "://" not in value and not re.search(r"(?i);?\b(?:pwd|password)=", value):
            got += pieces
    for m in BARE.finditer(text):
        if secret_name(m["name"]) and re.search(r"\d|[A-Z].*[a-z].*[A-Z]|[^\w.-]", m["v"]) and not re.search(r"^[\w.]+\(", m["v"]):
            add(m, "v", 8)
    for pattern in (HEADER, COMMAND, TAGGED):
        for m in pattern.finditer(text):
            v = m["v"]
            if re.search(r"\d", v) or re.search(r"[a-z][A-Z]", v) and len(v) >= 20:
                add(m, "v", 8, pattern is TAGGED and bool(re.search(r"[A-Z]", v) and re.search("[a-z]", v)))
    for m in CALL.finditer(text):
        if re.search(r"\d|[^\w.-]", m["v1"]):
            add(m, "v1")
    for m in URL.finditer(text):
        if not PLACEHOLDER.search(m["v"]) and not re.fullmatch(r"(?i)pass(?:word)?|secret|pw|pwd|user|token", m["v"]):
            add(m, "v", 3, True)
    return got


def secret_name(name: str) -> bool:
    name = name.rpartition(".")[2]
    return bool(SECRET_NAME.search(name)) and (not NOT_SECRET_NAME.search(name) or bool(NAMED_ID.search(name)))


#: A literal in more repositories is shared on purpose.
OWNERS = 5
#: Shorter secrets (parts of one that is written over several lines, say) count in the file they were found in.
LEAST_SHARED = 10
#: Secrets looked for in one pass over the files. More mean more passes.
SECRETS_PER_PASS = 500_000
VALUE = re.compile(r"""(?P<q>["'`])(?P<v>(?:(?!(?P=q))[^\n\\]|\\.){6,})(?P=q)""")


def literals(text: str, own: list[tuple[int, int]]) -> list[tuple[str, bool]]:
    """(literal, whether this place says that it is a credential). own: spans of the text."""
    said = {text[a:b] for a, b in own}
    return [(v, True) for v in said if v.strip()] + [(v, False) for v in {m["v"] for m in VALUE.finditer(text)} - said]


def own_lines(text: str, own: list[tuple[int, int]]) -> list[int]:
    """Lines of places that only the file itself can tell: short parts, and values that go on to a side."""
    alone = [(a, b) for a, b in own if b - a < LEAST_SHARED or not whole(text, a, b) or "\n" in text[a:b]]
    return lines_of(text, alone) if alone else []


def first_pass(code: DataFrame) -> DataFrame:
    """Reads every file once. Rows of literals (literal, repo_id, said) and of lines (doc_id, line_no). code: doc_id, repo_id, content."""

    def each(batches):
        for b in batches:
            seen: dict[tuple, bool] = {}  # a literal once per repository and batch
            lines = []
            for d, r, t in zip(b["doc_id"], b["repo_id"], b["content"]):
                if not t:
                    continue
                own = spans(t)
                r = None if pd.isna(r) else int(r)
                lines += [(d, n) for n in own_lines(t, own)]
                for v, said in literals(t, own):
                    seen[v, r] = seen.get((v, r), False) or said
            rows = [(v, r, said, None, None) for (v, r), said in seen.items()] + [(None, None, None, d, n) for d, n in lines]
            yield pd.DataFrame(rows, columns=["literal", "repo_id", "said", "doc_id", "line_no"]).astype({"repo_id": "Int64", "said": "boolean", "doc_id": "Int64", "line_no": "Int32"})

    return code.select("doc_id", "repo_id", "content").mapInPandas(each, "literal string, repo_id bigint, said boolean, doc_id bigint, line_no int")


def literal_index(rows: DataFrame) -> DataFrame:
    """(literal, owners, said) of the first pass: how many repositories hold a literal. Files without a repository are one owner."""
    per_repo = rows.where("literal is not null").groupBy("literal", "repo_id").agg(F.max("said").alias("said"))
    return per_repo.groupBy("literal").agg(F.count(F.lit(1)).alias("owners"), F.max("said").alias("said"))


def confirmed(index: DataFrame) -> DataFrame:
    """Literals that are secrets."""
    return index.where((F.col("owners") <= OWNERS) & F.col("said")).select("literal")


def automaton(secrets: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for v in secrets:
        a.add_word(v, len(v))
    a.make_automaton()
    return a


EDGE = re.compile(r"[A-Za-z0-9]")


def whole(text: str, a: int, b: int) -> bool:
    """Whether a value does not go on to either side."""
    return not (a and EDGE.match(text[a]) and EDGE.match(text[a - 1])) and not (b < len(text) and EDGE.match(text[b - 1]) and EDGE.match(text[b]))


def found_in(text: str, shared: ahocorasick.Automaton) -> list[tuple[int, int]]:
    """Spans of all secrets in a text."""
    if not len(shared):
        return []
    spans_ = ((end - length + 1, end + 1) for end, length in shared.iter(text))
    return [(a, b) for a, b in spans_ if whole(text, a, b)]


def places(text: str, shared: ahocorasick.Automaton) -> list[tuple[int, int]]:
    """Spans of all secrets in a text, and of what only the text itself tells."""
    own = [(a, b) for a, b in spans(text) if b - a < LEAST_SHARED or not whole(text, a, b) or "\n" in text[a:b]]
    return sorted({*own, *found_in(text, shared)})


def secrets_of(rows: DataFrame, secrets_per_pass: int = SECRETS_PER_PASS) -> list[list[str]]:
    """The secrets of the first pass, in blocks of bounded size."""
    found = confirmed(literal_index(rows)).where(F.length("literal") >= LEAST_SHARED).persist()
    passes = max(1, -(-found.count() // secrets_per_pass))
    return [[r.literal for r in found.where(F.pmod(F.xxhash64("literal"), F.lit(passes)) == k).collect()] for k in range(passes)]


def lines_of(text: str, at: list[tuple[int, int]]) -> list[int]:
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    found: set[int] = set()
    for a, b in at:
        found.update(range(bisect_right(starts, a) - 1, bisect_right(starts, max(a, b - 1))))
    return sorted(found)


def masked(text: str, at: list[tuple[int, int]] | None = None) -> str:
    """The text with <secret> in the place of each; all else stays, so that the code around it does too."""
    out, end = [], 0
    for a, b in sorted(set(spans(text) if at is None else at)):
        if a >= end:
            out += [text[end:a], "<secret>"]
            end = b
    return "".join([*out, text[end:]])


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where("language != 'markdown' and content is not null").select("doc_id", "repo_id", "content")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of code_lines are those of source_files, so every line is read there."""
    code = _code(spark, sf_dir)
    first = first_pass(code).persist()

    def one_pass(secrets: list[str]) -> DataFrame:
        def cases(batches):
            shared = automaton(secrets)
            for b in batches:
                yield pd.DataFrame([(d, n) for d, t in zip(b["doc_id"], b["content"]) if t for n in lines_of(t, found_in(t, shared))], columns=["doc_id", "line_no"]).astype({"doc_id": "int64", "line_no": "int32"})

        return code.select("doc_id", "content").mapInPandas(cases, "doc_id bigint, line_no int")

    return reduce(DataFrame.unionByName, map(one_pass, secrets_of(first)), first.where("doc_id is not null").select("doc_id", "line_no")).distinct()


def p4_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content) of the files that hold secrets, masked. Passes follow each other, each on what the one before left."""
    whole_code = _code(spark, sf_dir)
    code = whole_code.select("doc_id", "content", F.lit(False).alias("found"))
    for secrets in secrets_of(first_pass(whole_code)):

        def mask(batches, secrets=secrets):
            shared = automaton(secrets)
            for b in batches:
                at = [places(t, shared) if t else [] for t in b["content"]]
                yield pd.DataFrame({"doc_id": b["doc_id"], "content": [masked(t, x) if x else t for t, x in zip(b["content"], at)], "found": [f or bool(x) for f, x in zip(b["found"], at)]})

        code = code.mapInPandas(mask, "doc_id bigint, content string, found boolean")
    return code.where("found").select("doc_id", "content")
