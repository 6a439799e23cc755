"""Problem 10: personal data in documents, by kind, and the text with typed placeholders in its place.

Anchor expansion: one pass of an Aho-Corasick automaton (pyahocorasick) finds what personal
data hangs on: at-signs and their spellings, digits, words of streets and cities, labels of
numbers and of people, names. At each anchor a parser of its kind looks left and right for
the ends and tests what it found. Nothing is looked for away from an anchor."""

from __future__ import annotations

import re
from functools import cache
from string import ascii_lowercase, ascii_uppercase

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from codelens.corpus import table

UP, LOW = "A-ZÀ-ÖØ-Þ", r"[\wà-öø-ÿ'’\u0080-¿-]"
NAME = rf"[{UP}]{LOW}+"
GIVEN = set(
    """Agnes Amara Anders Aoife Arjun Bronwen Bruno Camille Chiara Clement Declan Dmitri Edwin Elif Emre Étienne Freya Gareth Grace Haruka Henrik Hollis
    Ilse Inés Jonas Katya Kenji Kofi Leila Lucía Maren Mateo Matteo Mei Nadia Noor Omar Oskar Petra Piotr Priya Rosalind Ruth Samir Signe Simon Tamsin
    Thabo Tobias Vera Winona Yusuf Zofia Zuri Alice Anna Bob Carlos Carol David Elena Emma Hans Ivan James Jan John José Julia Karl Laura Lena Lucas Luis
    Maria Marie Mark Martin Mary Michael Olga Paul Peter Pierre Robert Sarah Sofia Thomas William Yuki""".split()
)
GIVEN |= {g.encode().decode("latin-1") for g in GIVEN if not g.isascii()}
NOT_GIVEN = {"Your", "First", "Some", "Test", "The", "An", "No", "Der", "Die", "Das", "Ein", "Eine", "Dieser", "Jeder", "As", "Thanks", "Flat"}
NOT_FAMILY = set("Street Lane Tree Marrow Mews Avenue Ave Road Rd Drive Queue Cache Index Server Service Job Dashboard Library Licence License".split())

TLD = r"[A-Za-z]{2,}"
FILE_TYPES = {"png", "jpg", "jpeg", "gif", "webp", "svg", "ico", "js", "css", "py", "go", "zip"}
LOCAL = re.compile(r"[\w.+%-]")
DOMAIN = re.compile(rf"(?:[\w-]+\.)+{TLD}\b(?![:@][\w/~])")
SPELLED = re.compile(rf"(?<![\w.+@/%-])[\w.+-]+ ?(?: at |\[at\]|\(at\)|\{{at\}}) ?[\w-]+(?:(?:\.| dot | ?\[dot\] ?| ?\(dot\) ?)[\w-]+)*(?:\.| dot | ?\[dot\] ?| ?\(dot\) ?){TLD}\b", re.I)

CITY = rf"{NAME}(?:[ -]{NAME}){{0,2}}"
STREET_EN = r"(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Mews|Court|Ct|Place|Pl|Square|Sq|Terrace|Close|Way|Boulevard|Blvd|Row|Crescent|Gardens|Hill|Walk)\b\.?"
ADDRESS = re.compile(
    "|".join((
        rf"(?:(?:Flat|Apt\.?|Unit|Suite) \d+[A-Za-z]?,\s+)?\b\d+[A-Za-z]? +(?:{NAME} +){{1,3}}{STREET_EN},\s+(?:(?:Apt\.?|Unit|Suite) \d+,\s+)?{CITY},?\s+(?:[A-Z]{{2}}\s+)?(?:\d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[\dA-Z]?\s+\d[A-Z]{{2}})\b",
        rf"\b\d+(?:\s+(?:bis|ter|quater))?,?\s+(?:rue|avenue|boulevard|place|allée|chemin|impasse|quai|cours)\s+[^\n,;:.]{{2,40}},\s+\d{{5}}\s+{CITY}",
        rf"\b(?:Calle|Avenida|Avda\.|C/|Plaza|Paseo|Camino)\s*[^\n,;:.]{{2,40}}\s\d+,\s+(?:\d+[ºª°]\s?\w+,\s+|\d+Âº\s?\w+,\s+)?\d{{5}}\s+{CITY}",
        r"[一-鿿]{2}市(?:[一-鿿]{1,3}[区县])?[一-鿿]{1,6}?[路街道巷]\d+[号弄](?:\d+[栋幢座号楼])?(?:\d+单元)?(?:\d+[室户])?",
    ))
)
#: Of an address that names the street first: what stands before the postal code, and what after it begins with it.
STREET_FIRST, POSTAL_CITY = re.compile(rf"\b{NAME}(?: {NAME})? \d+ ?[a-z]?,\s+$"), re.compile(rf"\d{{5}}\s+{CITY}")
STREET_FIRST_SPAN = 200
NOT_NUMBER = re.compile(r"(?i)(?:build|release|version|run|ticket|issue|offset|shard|port|id|hash|trace|byte|v|#)[ :=#]*$")
PHONE = re.compile(
    r"(?<![\w.@/+-])(?:"
    r"(?:\+|00)[1-9]\d{0,2}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ .-]?\d{2,6}){1,4}"
    r"|1[ .-]\d{3}[ .-]\d{4}|(?:1[ .-])?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}"
    r"|\(0\d{2,5}\) ?\d{2,8}(?:[ -]\d{2,6}){0,3}|0\d{2,5}/\d{3,10}(?:[ -]\d{1,6})*"
    r")(?:,?\s?(?:ext\.?|x|extension|Durchwahl|доб\.|分机)\s?\d{1,6})?(?![\w/@]|[.:-]\d)"
)
ID_NUMBER = re.compile(
    r"(?<![\w.@/+-])(?:\d{3}-\d{2}-\d{4}|[A-Z]{2}(?: ?\d\d){3} ?[A-D]|\d{17}[\dXx]|[XYZ]?\d{7,8}-?[A-Z]|[A-Z]{2}\d{7})(?![\w@/]|[.-]\d)"
)
LABELLED_ID = re.compile(
    r"""(?i)(?:\bSSN|social security|national insurance|passport|Reisepass|Personalausweis|\bDNI|\bNIF|\bNIE|ID card|resident ID|national ID|tax ID|documento|身份证|护照|паспорт)[^\n\d]{0,14}?["'(=:> ]+([A-Z]{0,2}[\d][\d -]{5,20}[\dA-Z]|[A-Z]{1,2}(?: ?\d){6,9} ?[A-Z]?)(?![\w-])"""
)
HAN_SURNAMES = "欧阳 上官 司马 诸葛 夏侯 皇甫 尉迟 公羊 澹台 钟离 宇文 长孙 慕容 令狐 司徒 司空 东方 独孤 南宫 百里 端木 轩辕 公孙 闻人 申屠 太史 仲孙 赫连 濮阳 淳于 单于 公冶 宗政 鲜于 闾丘 东郭 西门 呼延 拓跋 第五 东门 左丘 梁丘 公西 颛孙 漆雕 乐正 壤驷 公良 夹谷 宰父 谷梁 段干 微生 羊舌".split()
HAN_FULL = rf"(?:{'|'.join(HAN_SURNAMES)})[一-鿿]{{1,2}}"
HAN_PERSON = re.compile(
    rf"(?:(?:[A-Z][a-z]+-(?:[a-z]+-)?by|Author|Assignee|owner|cc|CC|Cc|From)\s*(?::|->|=>|=|\s)\s*|(?:Thanks to|paired with|感谢|谢谢|As) *|^[ >]*)([一-鿿]{{2,4}})(?=$|\r| [的<(]|,| on the| for the| said| wrote|[的，<(])|({HAN_FULL})(?![一-鿿])",
    re.M,
)
FULL = rf"({NAME}(?:-{NAME})?)((?: [{UP}]\.){{0,2}}) ({NAME})"
TRAILER = re.compile(
    rf"(?:\b[A-Z][a-z]+-(?:[a-z]+-)?by|\bAuthor|\bAssignee|\bowner|\bReviewer|\bMaintainer|\bContact|\bFrom|\bcc|\bCC|\bCc)\s*(?::|->|=>|=|\s)\s*({FULL})(?!\s?[/@])"
    rf"|(?:\bThanks to|\bpaired with|感谢|谢谢|\bAs(?=[^\n]{{3,50}}\ssaid\b))\s*({FULL})"
)


#: Anchors by kind, in lower case.
ANCHORS = {
    "at": ["@"],
    "spelled": [" dot ", "[dot]", "(dot)", "[at]", "(at)", "{at}"],
    "digit": list("0123456789"),
    "unit": ["flat ", "apt", "unit ", "suite "],
    "street": ["calle", "avenida", "avda.", "c/", "plaza", "paseo", "camino"],
    "city": ["市"],
    "label": ["ssn", "social security", "national insurance", "passport", "reisepass", "personalausweis", "dni", "nif", "nie", "id card", "resident id", "national id", "tax id", "documento", "身份证", "护照", "паспорт"],
    "trailer": ["-by", "author", "assignee", "owner", "reviewer", "maintainer", "contact", "from", "cc", "thanks to", "paired with", "感谢", "谢谢", "as "],
    "surname": HAN_SURNAMES,
}
LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)  # keeps every place
HAN = re.compile("[一-鿿]")


@cache
def automaton() -> ahocorasick.Automaton:
    kinds: dict[str, list[str]] = {}
    for kind, words in [*ANCHORS.items(), ("given", [g.translate(LOWER) for g in sorted(GIVEN | NOT_GIVEN)])]:
        for w in words:
            kinds.setdefault(w, []).append(kind)
    a = ahocorasick.Automaton()
    for w, k in kinds.items():
        a.add_word(w, (len(w), tuple(k)))
    a.make_automaton()
    return a


def anchors(text: str) -> dict[str, list[int]]:
    """Where anchors begin, by kind, in order. Of a run of digits, its first."""
    found: dict[str, list[int]] = {}
    for end, (length, kinds) in automaton().iter(text.translate(LOWER)):
        at = end - length + 1
        for kind in kinds:
            if kind != "digit" or not at or not text[at - 1].isdigit():
                found.setdefault(kind, []).append(at)
    return {k: sorted(set(v)) for k, v in found.items()}


def email(text: str, at: int) -> tuple[int, int] | None:
    """Left over what a mailbox is written in, right over the labels of a host."""
    a = at
    while a and LOCAL.match(text, a - 1):
        a -= 1
    m = DOMAIN.match(text, at + 1)
    if a == at or not m or a and text[a - 1] in "@/":
        return None
    local, host = text[a:at], m[0]
    if local.lower() == "git" or host.rpartition(".")[2].lower() in FILE_TYPES:
        return None
    return a + len(local) - len(local.lstrip(".-")), m.end()


def line_of(text: str, at: int) -> tuple[int, int]:
    end = text.find("\n", at)
    return text.rfind("\n", 0, at) + 1, len(text) if end < 0 else end


def numbered(text: str, at: int) -> bool:
    """Whether the word before says that a number is one of builds, tickets or the like."""
    return bool(NOT_NUMBER.search(text, max(0, at - 14), at))


def person(text: str, m: re.Match, k: int) -> bool:
    return m[k + 1] not in NOT_GIVEN and m[k + 3] not in NOT_FAMILY


FULL_NAME = re.compile(FULL)


def trailer_start(text: str, at: int) -> int:
    """Of Signed-off-by and the like: where the words before -by begin."""
    if text[at] != "-":
        return at
    while at and (text[at - 1].isalpha() or text[at - 1] == "-"):
        at -= 1
    return at


def personal(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), in order and apart from each other."""
    where = anchors(text)
    got: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        if not any(a < y and x < b for x, y, _ in got):
            got.append((a, b, kind))

    for at in where.get("at", ()):
        if span := email(text, at):
            add(*span, "email")
    for a, b in sorted({line_of(text, at) for at in where.get("spelled", ())}):
        for m in SPELLED.finditer(text, a, b):
            if not re.search(r"\sat\s", m[0], re.I) or re.search(r"\sdot\s", m[0], re.I):
                add(m.start(), m.end(), "email")
    digits = where.get("digit", ())
    for at in sorted({*digits, *where.get("unit", ()), *where.get("street", ()), *(x - 2 for x in where.get("city", ()) if x > 1)}):
        if m := ADDRESS.match(text, at):
            add(m.start(), m.end(), "address")
        elif at > 1 and text[at].isdigit() and text[at - 1].isspace() and (m := POSTAL_CITY.match(text, at)):
            if n := STREET_FIRST.search(text[max(0, at - STREET_FIRST_SPAN) : at]):
                add(at - len(n[0]), m.end(), "address")
    for at in where.get("label", ()):
        if m := LABELLED_ID.match(text, at):
            add(m.start(1), m.end(1), "id_number")
    for at in digits:
        gap = at > 2 and text[at - 1] == " "  # QQ 12 34 56 C
        letters = next((k for k in (2, 1) if at >= k + gap and text[at - k - gap : at - gap].isalpha() and text[at - k - gap : at - gap].isascii()), 0)
        if (m := letters and ID_NUMBER.match(text, at - letters - gap) or ID_NUMBER.match(text, at)) and not numbered(text, m.start()):
            add(m.start(), m.end(), "id_number")
    passed = 0
    for at in digits:
        for k in (2, 1, 0):
            if at >= k and at - k >= passed and set(text[at - k : at]) <= set("+(") and (m := PHONE.match(text, at - k)):
                passed = m.end()
                if sum(map(str.isdigit, m[0])) >= 7 and not numbered(text, m.start()):
                    add(m.start(), m.end(), "phone")
                break
    trailers = sorted({trailer_start(text, at) for at in where.get("trailer", ())})
    for at in trailers:
        if m := TRAILER.match(text, at):
            k = 1 if m[1] else 5
            if person(text, m, k):
                add(m.start(k), m.end(k), "person")
    surnames = where.get("surname", ())
    if trailers or surnames:
        for at in sorted({*trailers, *surnames, *(line_of(text, x)[0] for x in surnames)}):
            if (m := HAN_PERSON.match(text, at)) and (k := 1 if m[1] else 2):
                if k == 2 or re.match(HAN_FULL, m[1]) or not re.match(r"^[ >]*$", text[m.start() : m.start(1)]):
                    add(m.start(k), m.end(k), "person")
    for at in where.get("given", ()):
        if (at and text[at - 1].isalpha() and text[at - 1].isascii()) or not (m := FULL_NAME.match(text, at)):
            continue
        if m[1] in GIVEN and m[3] not in NOT_FAMILY:
            add(m.start(), m.end(), "person")
    return sorted(got)


def masked(text: str) -> str:
    out, at = [], 0
    for a, b, kind in personal(text):
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join([*out, text[at:]])


def p10_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) with placeholders; null texts stay null."""

    def mask(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [None if t is None else masked(t) for t in b["text"]]})

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(mask, "doc_id bigint, text string")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    def cases(batches):
        for b in batches:
            yield pd.DataFrame([(d, kind, t[x:y]) for d, t in zip(b["doc_id"], b["text"]) if t for x, y, kind in personal(t)], columns=["doc_id", "kind", "value"]).astype({"doc_id": "int64"})

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(cases, "doc_id bigint, kind string, value string").distinct()
