"""Prose in comments and string literals (problem 6), and functions with their documentation (problem 7).

Problem 6: a hidden Markov model of characters (codelens.llm.hmm) goes over whole files; what
it says is used inside comments and literals only. A sentence there is of the language that
most of its letters are in; notices, tags, commands and commented-out code are left out.

Problem 7: the packrat parsers of codelens.llm.grammars note definitions and where they
stand; the comments above them, or docstrings, are kept if they say something."""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.corpus import files, table
from codelens.llm.grammars import LANGUAGES, Parsed
from codelens.llm.hmm import STATES, Model, fit
from codelens.llm.source import tokens
from codelens.llm.syntax import valid

LEAST_WORDS, LEAST_CHARS = 5, 8
CODE_STATE = STATES.index("code")
HAN, KANA = r"㐀-䶿一-鿿", r"぀-ヿ"
STOP = {
    "en": "the a an of to and is are be been in on for with that this it its as by from or if when not until so has have which each every must will while before after without may because never over into out what one once per at than there their they we our you your all but can should does do".split(),
    "de": "der die das den dem des ein eine einen einem und ist nicht nach mit ohne zu dabei damit falls solange bevor wird jede jeder alle dieser gleich noch im am auf für von bei wenn oder sich zum zur als auch nur werden sind".split(),
    "es": "el la los las de que y en un una con sin por para se al del cada si antes mientras este esta siga no cambie todas todos más lo su o como pero está son ya otro".split(),
    "fr": "le la les des du de un une et est que qui ne pas dans avec sans pour par sur si tant avant chaque toutes tous cette ce ces plus au aux l d se son sa il elle n soit ou reste".split(),
}
STOP_SETS = {k: set(v) for k, v in STOP.items()}
MARKS = {"de": set("äöüß"), "es": set("ñáíóú¿¡"), "fr": set("àâçèêëîïôùûœ")}
WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
NOTICE = re.compile(
    r"(?i)licen[cs]|copyright|\bSPDX\b|all rights reserved|lizenz|许可|授权|лиценз|licencia|\bconfidential\b|private contract|no warranty|terms, version|"
    r"permission is|(?:public|share alike|non commerce) terms|free grant|fennway permission|third parties"
)
TOOL = re.compile(r"(?i)do not (?:edit|modify)|(?:auto-?)?generated (?:by|from|with|file|code)|@generated|automatically generated|this file (?:was|is) (?:generated|produced|created|written)|eslint|noqa|pylint|nolint|clang-format|prettier|istanbul|go:build|go:generate|ts-ignore|type: ignore|sourceMappingURL|autogenerated|regenerate instead|自动生成|自動生成|请勿手动|generado automáticamente|généré automatiquement|automatisch (?:erzeugt|generiert|erstellt)|автоматически (?:создан|сгенерирован)|vim:|-\*-|NOLINT|checkstyle|spotless|rustfmt|@formatter|\bpragma\b")
#: The same for ASCII in lower case: without folding, a search passes over what no alternative begins with.
LOW_NOTICE, LOW_TOOL = (re.compile(x.pattern.replace("(?i)", "").lower()) for x in (NOTICE, TOOL))
SQL = re.compile(r"(?i)^\W*(?:select\b.+\bfrom|insert\s+into|update\b.+\bset|delete\s+from|create\s+(?:table|index|view|database|unique)|alter\s+table|drop\s+(?:table|index)|with\b.+\bas\s*\(|merge\s+into|truncate|grant\b.+\bon)\b")
COMMAND = re.compile(r"^\W*(?:\$ |sudo |curl |wget |git |docker |kubectl |npm |pip |go (?:run|build|test|get|vet) |cargo |make |cd |ls |rm |cp |mv |chmod |ssh |scp |export |login -|python3? |java -|mvn |gradle |bash |sh |tar |grep |sed |awk |find |cat |echo |apt(?:-get)? |brew |yarn |node |psql |mysql |redis-cli |rsync |systemctl )")
TAG = re.compile(r"^\W*(?:[@\\](?!link|code)\w+|:\w+(?: [\w*.]+)*:|(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields|Throws|Example|Examples|See also)\s*:)")
MARKER = re.compile(r"\b(?:TODO|FIXME|XXX|HACK|NOTE|BUG|WIP)\b(?:\([^)]*\))?:?")
CODE = re.compile(
    r"[;{}]\s*$|^\W*(?:return|if|for|while|else|import|from|package|def|func|fn|function|class|let|var|const|int|static|public|private|use|throw|raise|switch|case)\b.*[;:{}()=]|"
    r"^\W*(?:return|break|continue|pass)\b(?:\s+[\w.+*/()%-]+)*;?\s*$|[\w\])]\s*(?::=|[+*/%-]?=(?!=)|==|=>|->|\+\+|--)\s*[\w\"'(\[]|^\W*[\w.]+\([^()]*\)\W*$|^\s*(?:<<<<<<<|>>>>>>>|=======)|&&|\|\|"
)
NOT_PROSE = re.compile(r"`[^`]*`|\{@\w+[^}]*\}|https?://\S+|</?\w+[^>]*>|\S+@\S+|\b\w+\([^()]*\)|\b\w*_\w+\b|\b[a-z]+[A-Z]\w*\b")


def notice(text: str) -> bool:
    return bool(LOW_NOTICE.search(text.lower()) if text.isascii() else NOTICE.search(text))


def left_out(line: str) -> bool:
    """Whether a line is a tag, command, notice or code."""
    if line.isascii():
        low = line.lower()
        if LOW_TOOL.search(low) or LOW_NOTICE.search(low):
            return True
    elif TOOL.search(line) or NOTICE.search(line):
        return True
    return bool(TAG.match(line) or SQL.match(line) or COMMAND.match(line) or CODE.search(line))


def language_of(sentence: str) -> str | None:
    """The language of a sentence that is long enough, else None."""
    han, kana = len(re.findall(f"[{HAN}]", sentence)), len(re.findall(f"[{KANA}]", sentence))
    words = WORDS.findall(sentence)
    if han + kana:
        latin = sum(len(w) for w in words if w.isascii())
        if han + kana >= LEAST_CHARS and han + kana >= latin / 3:
            return "ja" if kana else "zh"
        if han + kana > latin:
            return None
    if len(words) < LEAST_WORDS:
        return None
    low = [w.lower() for w in words]
    if sentence.isascii():
        score = {k: sum(w in s for w in low) for k, s in STOP_SETS.items()}
    elif sum(bool(re.search("[а-яё]", w)) for w in low) >= LEAST_WORDS:
        return "ru"
    else:
        score = {k: sum(w in s for w in low) + 0.6 * sum(bool(MARKS[k] & set(w)) for w in low if k in MARKS) for k, s in STOP_SETS.items()}
    best = max(score, key=lambda k: score[k])
    return best if score[best] >= 1 else None


def prose(line: str) -> str:
    """What is prose in one line of a comment or of a literal."""
    if left_out(line):
        return ""
    return NOT_PROSE.sub(" ", MARKER.sub(" ", line))


def languages(line: str) -> set[str]:
    return {n for s in re.split(r"(?<=[.!?])\s+|(?<=[。！？])", prose(line)) if (n := language_of(s))}


LETTER = re.compile(r"[^\W\d_]")
SENTENCE = re.compile(r"[^.!?。！？]*(?:[.!?](?!\s|$)[^.!?。！？]*)*[.!?。！？]*\s*")


def blanked(pattern: re.Pattern, text: str) -> str:
    """The text with spaces in place of matches, so that all else keeps its place."""
    return pattern.sub(lambda m: " " * len(m[0]), text)


def prose_in_place(line: str) -> str:
    if left_out(line):
        return ""
    return blanked(NOT_PROSE, blanked(MARKER, line))


def is_sentence(sentence: str, language: str) -> bool:
    """Whether a text is long enough and put together as a sentence of the language is."""
    if language in ("zh", "ja"):
        return len(re.findall(f"[{HAN}{KANA}]", sentence)) >= LEAST_CHARS
    low = [w.lower() for w in WORDS.findall(sentence)]
    if len(low) < LEAST_WORDS or sum(bool(WORDS.search(x)) for x in sentence.split()) < LEAST_WORDS:
        return False
    if language == "ru":
        return sum(bool(re.search("[а-яё]", w)) for w in low) >= LEAST_WORDS
    return any(w in STOP_SETS[language] or set(w) & MARKS.get(language, set()) for w in low)


def languages_at(line: str, at: int, states: np.ndarray) -> set[str]:
    """Languages of the sentences of a line that begins at a place of the text."""
    said, found = prose_in_place(line), set()
    for m in SENTENCE.finditer(said):
        letters = [m.start() + x.start() for x in LETTER.finditer(m[0])]
        if len(letters) < LEAST_CHARS:
            continue
        counts = np.bincount(states[at + np.array(letters)], minlength=len(STATES))
        top = int(counts.argmax())
        if top == CODE_STATE or counts[top] * 2 < len(letters):
            continue
        if is_sentence(m[0], STATES[top]):
            found.add(STATES[top])
    return found


BEGIN = re.compile(r"^\s*(?:/\*+!?|//+!?|\*+/|\*+(?!/)|#+!?)?[ \t]?")


def comment_lines(text: str) -> list[str]:
    return [re.sub(r"\s*\*+/\s*$", "", BEGIN.sub("", x, count=1)) if x.strip() not in ("*/", "**/") else "" for x in text.splitlines()]


def inner(literal: str) -> str:
    body = re.sub(r"^[A-Za-z0-9]{0,2}#*", "", literal)
    body = re.sub(r"#*$", "", body)
    q = body[:3] if body[:3] in ('"""', "'''") else body[:1]
    return body[len(q) : -len(q)].replace("\\n", "\n").replace('\\"', '"').replace("\\'", "'").replace("\\t", "\t")


def blocks(text: str, toks: list[tuple[str, str, int]]) -> list[list[str]]:
    """Comments, those on lines below each other together."""
    out: list[list[str]] = []
    end = -1
    for kind, t, at in toks:
        if kind == "comment":
            between = text[end:at] if end >= 0 else "x"
            own_line = not text[text.rfind("\n", 0, at) + 1 : at].strip()
            if not between.strip() and between.count("\n") <= 1 and own_line and out:
                out[-1] += comment_lines(t)
            else:
                out.append(comment_lines(t))
            end = at + len(t)
        else:
            end = -1
    return out


def placed_blocks(text: str, toks: list[tuple[str, str, int]]) -> list[list[tuple[int, str]]]:
    """As blocks, with the place of each line."""
    out: list[list[tuple[int, str]]] = []
    end = -1
    for kind, t, at in toks:
        if kind != "comment":
            end = -1
            continue
        lines, begin = [], at
        for x in t.splitlines(keepends=True):
            bare = x.rstrip("\r\n")
            left = BEGIN.match(bare).end() if bare.strip() not in ("*/", "**/") else len(bare)
            lines.append((begin + left, re.sub(r"\s*\*+/\s*$", "", bare[left:])))
            begin += len(x)
        between = text[end:at] if end >= 0 else "x"
        own_line = not text[text.rfind("\n", 0, at) + 1 : at].strip()
        if not between.strip() and between.count("\n") <= 1 and own_line and out:
            out[-1] += lines
        else:
            out.append(lines)
        end = at + len(t)
    return out


def inner_in_place(literal: str) -> tuple[int, str]:
    """What is between the quotes, and where it begins; escapes are blanked, a line end stays one."""
    left = re.match(r"[A-Za-z0-9]{0,2}#*", literal).end()
    right = len(literal.rstrip("#")) if literal.endswith("#") else len(literal)
    q = 3 if literal[left : left + 3] in ('"""', "\'\'\'") else 1
    body = literal[left + q : right - q]
    for escape, plain in (("\\n", " \n"), ('\\"', ' "'), ("\\'", " '"), ("\\t", "  ")):
        body = body.replace(escape, plain)
    return left + q, body


def spans_of_lines(body: str, at: int):
    for x in body.splitlines(keepends=True):
        yield at, x.rstrip("\r\n")
        at += len(x)


#: What a line must have to hold a sentence of any language: runs of letters or characters. Blanking never adds any.
ROOM = re.compile(rf"(?:[\W\d_]*+[^\W\d_]++){{{LEAST_WORDS}}}|(?:[^{HAN}{KANA}]*+[{HAN}{KANA}]){{{LEAST_CHARS}}}")
#: Characters that a language must have in a line, half of the letters of a sentence at least.
LEAST_OF_LANGUAGE = (LEAST_CHARS + 1) // 2


def places_of_prose(text: str, toks: list[tuple[str, str, int]]) -> list[tuple[str, bool, list[tuple[int, str]]]]:
    """(text, whether a literal, lines with their places) of paragraphs of comments and of literals that a sentence may stand in."""
    out: list[tuple[str, bool, list[tuple[int, str]]]] = []
    for lines in placed_blocks(text, toks):
        part: list[tuple[int, str]] = []
        for at, line in [*lines, (0, "")]:
            if line.strip():
                part.append((at, line))
            elif part:
                if kept := [x for x in part if ROOM.match(x[1])]:
                    out.append((" ".join(x for _, x in part), False, kept))
                part = []
    for kind, t, at in toks:
        if kind == "string" and len(t) > 8 and ROOM.match(t):
            left, body = inner_in_place(t)
            if kept := [x for x in spans_of_lines(body, at + left) if ROOM.match(x[1])]:
                out.append((body, True, kept))
    return out


def nl_languages(places: list[tuple[str, bool, list[tuple[int, str]]]], states: np.ndarray) -> set[str]:
    """Languages of what places_of_prose gives. states: of every character of the text.

    A line is looked at only if it may add a language to those found."""
    held, got = states.tobytes(), set()
    open_ = {s for s in range(len(STATES)) if s != CODE_STATE and held.count(s) >= LEAST_OF_LANGUAGE}
    for said, literal, lines in places:
        judged = False
        for at, x in lines:
            if any(held.count(s, at, at + len(x)) >= LEAST_OF_LANGUAGE for s in open_):
                if not judged and (notice(said) or literal and SQL.match(said)):
                    break
                judged = True
                got |= languages_at(x, at, states)
                open_ -= {STATES.index(x) for x in got}
    return got


#: Bounds of the sample that the model is fitted on: texts and characters of each state. All else covers all data.
FIT_TEXTS, FIT_CHARS = 400, 300_000
PROSE_LANGUAGES = ("en", "zh", "de", "es", "fr", "ru")


def _ids(rows: DataFrame, n: int = FIT_TEXTS) -> list[int]:
    """Ids of a sample that is the same in every run: the least n hashes, of which each task keeps n."""
    return [r.doc_id for r in rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]


def of_script(line: str, language: str) -> bool:
    """Whether a line is in the script of a language, as far as its label can be true."""
    letters = len(LETTER.findall(line)) or 1
    han, cyrillic = len(re.findall(f"[{HAN}{KANA}]", line)), len(re.findall("[а-яёА-ЯЁ]", line))
    return han * 3 > letters if language == "zh" else cyrillic * 2 > letters if language == "ru" else not han and not cyrillic


def fitted(documents: DataFrame, code: DataFrame) -> Model:
    """Languages from documents by their label; Japanese, which no document is in, from literals and comments with kana in files; code from files without comments and literals."""
    samples: dict[str, list[str]] = {s: [] for s in STATES}

    def add(state: str, text: str) -> None:
        if sum(map(len, samples[state])) + len(text) <= FIT_CHARS:
            samples[state].append(text)

    labelled = documents.where("text is not null and length(text) > 40")
    ids = [i for n in PROSE_LANGUAGES for i in _ids(labelled.where(F.col("lang") == n))]
    for r in labelled.where(F.col("doc_id").isin(ids)).select("doc_id", "lang", "text").orderBy("doc_id").collect():
        for line in r.text.splitlines():
            if len(line) > 20 and of_script(line, r.lang):
                # what is in Latin letters there is another language's
                add(r.lang, (re.sub("[A-Za-z]+", "", line) if r.lang in ("zh", "ru") else line) + "\n")
    with_kana = code.where(F.col("content").rlike(f"[{KANA}]{{2}}"))
    ids = {"ja": set(_ids(with_kana)), "code": set(_ids(code))}
    for r in code.where(F.col("doc_id").isin(sorted(ids["ja"] | ids["code"]))).select("doc_id", "language", "content").orderBy("doc_id").collect():
        toks = tokens(r.language, r.content)
        if r.doc_id in ids["ja"]:
            for kind, t, _ in toks:
                if kind in ("comment", "string"):
                    for line in t.splitlines():
                        if len(re.findall(f"[{KANA}]", line)) >= 3:
                            add("ja", re.sub("[A-Za-z]+", "", line) + "\n")
        if r.doc_id in ids["code"]:
            bare, end = [], 0
            for kind, t, at in toks:
                if kind in ("comment", "string"):
                    bare.append(r.content[end:at])
                    end = at + len(t)
            add("code", "".join([*bare, r.content[end:]]))
    return fit(samples)


def subwords(name: str) -> set[str]:
    return {name.lower()} | {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)}


def documents(lines: list[str], name: str) -> bool:
    """Whether the lines say something beside the name."""
    whole = " ".join(lines)
    if not ROOM.match(whole):
        return False
    if notice(whole):
        kept: list[str] = []
        for part in re.split(r"\n\s*\n", "\n".join(lines)):
            kept += [] if notice(part) else part.split("\n")
        lines = kept
    said, own = " ".join(prose(x) for x in lines), subwords(name)
    chars = len(re.findall(f"[{HAN}{KANA}]", said))
    if chars >= LEAST_CHARS:
        return True
    words = [w for w in WORDS.findall(said) if w.lower() not in own]
    return len(words) >= LEAST_WORDS and (language_of(" ".join(words)) is not None)


def above(text: str, starts: dict[int, str], line: int, lines: list[str], annotation: str | None) -> list[str]:
    """Lines of the comments directly above a line (0-based), past annotations. starts: comment that ends on its own in a line, by that line."""
    k = line - 1
    while annotation and k >= 0 and re.match(annotation, lines[k]):
        k -= 1
    out: list[str] = []
    while k >= 0 and k in starts:
        c = starts[k]
        out = comment_lines(c) + out
        k -= c.count("\n") + 1
    return out


ANNOTATION = {"java": r"^\s*@\w", "rust": r"^\s*#!?\[", "python": r"^\s*@\w", "c": r"^\s*(?:__attribute__|\[\[)", "javascript": r"^\s*@\w", "go": None}


def definitions(parsed: Parsed, text: str) -> list[tuple[str, int, set[int]]]:
    """(name, place of the name, places where its declaration may be said to begin) of functions and methods with a body, as the parser noted them."""
    out = []
    for first, name, _, _ in parsed.notes or ():
        at = parsed.starts[name]
        line = text.rfind("\n", 0, at) + 1
        k = name
        while k and parsed.starts[k - 1] >= line:
            k -= 1
        out.append((parsed.texts[name], at, {parsed.starts[first], parsed.starts[k]}))  # with annotations and modifiers above, and on the name's own line
    return out


NEXT_LINE = re.compile(r"[^\S\n]*\n[^\S\n]*\S")


def may_document(text: str, comments: list[tuple[int, str]]) -> bool:
    """Whether any comments, those on lines below each other together, have room for a sentence and something on the line after them."""
    said, end = "", -1
    for at, t in comments:
        between = text[end:at] if end >= 0 else "x"
        said = f"{said} {t}" if not between.strip() and between.count("\n") <= 1 else t
        end = at + len(t)
        if NEXT_LINE.match(text, end) and ROOM.match(said):
            return True
    return False


def functions(tree: ast.Module):
    """Functions and methods. They are statements, so that expressions are passed over."""
    todo: list = list(tree.body)
    while todo:
        node = todo.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield node
        for name in ("body", "orelse", "finalbody", "handlers", "cases"):
            if inner := getattr(node, name, None):
                todo += inner


def documented(language: str, text: str) -> set[tuple[str, int]]:
    """(name, line) of documented definitions; none for an invalid file. A file that could have none is not parsed."""
    if language not in (*LANGUAGES, "python"):
        return set()
    text = text.lstrip("\ufeff")
    if language == "python":
        if "def " not in text:
            return set()
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return set()
        comments = [(at, t) for kind, t, at in tokens(language, text) if kind == "comment"] if "#" in text else []
        if not may_document(text, comments):
            comments = []
    else:
        toks = tokens(language, text)
        if not may_document(text, [(at, t) for kind, t, at in toks if kind == "comment"]):
            return set()
        parsed = Parsed(language, text, toks)
        if not parsed.notes:
            return set()
        comments = parsed.comments
    lines = text.split("\n")
    offsets = [0]
    for x in lines:
        offsets.append(offsets[-1] + len(x) + 1)
    ends: dict[int, str] = {}
    line_at = lambda at: bisect_right(offsets, at) - 1
    for at, t in comments:
        t = t.rstrip("\r")
        first, e = offsets[line_at(at)], line_at(at + len(t))
        if not text[first:at].strip() and not text[at + len(t) : offsets[e + 1] - 1].strip():
            ends[e] = t
    found: set[tuple[str, int]] = set()
    if language == "python":
        for node in functions(tree):
            doc = ast.get_docstring(node, clean=True) or ""
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)]) - 1
            if documents(doc.splitlines(), node.name) or documents(above(text, ends, first, lines, None), node.name):
                found.add((node.name, node.lineno))
        return found
    for name, at, begins in definitions(parsed, text):
        if any(documents(above(text, ends, line, lines, ANNOTATION[language]), name) for line in {line_at(b) for b in begins}):
            found.add((name, line_at(at) + 1))
    return found


def _over_files(spark: SparkSession, sf_dir: str, of, columns: str) -> DataFrame:
    names = [c.split()[0] for c in columns.split(", ")]

    def cases(batches):
        for b in batches:
            rows = [(d, *x) for d, n, t in zip(b["doc_id"], b["language"], b["content"]) if t for x in of(n, t)]
            yield pd.DataFrame(rows, columns=names).astype({c: kind for c, kind in (("doc_id", "int64"), ("line_no", "int32")) if c in names})

    return files(spark, sf_dir).where("language not in ('text', 'markdown')").select("doc_id", "language", "content").mapInPandas(cases, columns)


def prose_of(code: DataFrame, model: Model) -> DataFrame:
    """(doc_id, nl_lang, chars, share): languages of each valid file's prose, with the characters of the file that the model gives to the language, and their share."""

    def cases(batches):
        for b in batches:
            kept = []
            for d, n, t in zip(b["doc_id"], b["language"], b["content"]):
                if t and (places := places_of_prose(t, toks := tokens(n, t))) and valid(n, t, toks):
                    kept.append((d, t, places))
            rows = []
            for (d, t, places), states in zip(kept, model.states([t for _, t, _ in kept])):
                counts = np.bincount(states, minlength=len(STATES))
                rows += [(d, x, int(counts[STATES.index(x)]), counts[STATES.index(x)] / len(t)) for x in sorted(nl_languages(places, states))]
            yield pd.DataFrame(rows, columns=["doc_id", "nl_lang", "chars", "share"]).astype({"doc_id": "int64", "chars": "int64", "share": "float64"})

    return code.select("doc_id", "language", "content").mapInPandas(cases, "doc_id bigint, nl_lang string, chars bigint, share double")


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = files(spark, sf_dir).where("language not in ('text', 'markdown') and content is not null")
    return prose_of(code, fitted(table(spark, sf_dir, "documents"), code))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_shares(spark, sf_dir).select("doc_id", "nl_lang")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_files(spark, sf_dir, lambda n, t: sorted(documented(n, t)), "doc_id bigint, sym string, line_no int")
