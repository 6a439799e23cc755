"""Problem 5: the licence of every repository and file, with conflicts and unknown ones.

Templates (bodies, notices, and titles in the sentences that state them) are kept by length
in a metric tree under the edit distance of their words, which is computed for a whole word
of bits at a time. Statements of a file go down the tree with a bounded difference; the
triangle inequality leaves out branches that cannot hold anything so near. What the tree
finds is then read exactly, as a version or an "or later" is a difference of one word.

license_texts has 12 rows, whatever the size of the rest (TESTDATA.md), so its templates go
to every task."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.corpus import files, table
from codelens.llm.prose import comment_lines
from codelens.llm.source import tokens

LICENCE_FILE = re.compile(r"^(?:LICENSE|LICENCE|COPYING)")
ID_LINE = re.compile(r"(?i)(?:SPDX-Licen[sc]e-Identifier[ \t]*:|@licen[sc]e\b:?)[ \t]*([^\n\r]*)")
EITHER = re.compile(r"(?i)at your (?:choice|option)|\beither of the|dual[ -]licen[sc]ed|\beither\b.{0,80}\bor\b")
STATES = re.compile(r"(?i)\b(?:licen[sc]ed|released|distributed|offered|published|made available)\b[^.]{0,30}\b(?:under|on)\b|ruled by|use is subject to|\blicen[sc]e ?:|lizenz ?:|no licen[sc]e is given|授权|许可证?[:：]|confidential|all rights|not for circulation|copying needs|signed letter|property of|free to use under|allowed by|under the terms of")


def flat(text: str) -> str:
    """Words only, lower case, without numbering and bullets at the start of lines."""
    text = re.sub(r"(?m)^[ \t]*(?:\(?\d{1,2}[.)]|[-*•]|\([a-z]\))[ \t]+", " ", text)
    text = re.sub(r"(?<=\s)\d{1,2}\.\s+(?=[A-Z])", " ", text)
    return " " + " ".join(re.findall(r"[^\W_]+(?:\.\d+)*", text.lower())) + " "


def edit_distance(a: list[str], b: list[str]) -> int:
    """Words to insert, delete or replace (Myers' bit vectors in Hyyro's form, for whole texts)."""
    m = len(a)
    if not m or not b:
        return max(m, len(b))
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << m - 1
    plus, minus, score = mask, 0, m
    for w in b:
        eq = places.get(w, 0)
        zero = ((eq & plus) + plus ^ plus) | eq | minus
        up = minus | ~(zero | plus) & mask
        down = plus & zero
        score += bool(up & high) - bool(down & high)
        up = up << 1 | 1
        plus = (down << 1 | ~(zero | up)) & mask
        minus = up & zero & mask
    return score


class MetricTree:
    """Templates by their distance to the template above (Burkhard-Keller)."""

    def __init__(self, templates: list[tuple[str, list[str]]]):
        self.root: tuple | None = None
        for key, words in sorted(templates, key=lambda t: (len(t[1]), t)):
            self.add(key, words)

    def add(self, key: str, words: list[str]) -> None:
        if self.root is None:
            self.root = (key, words, {})
            return
        node = self.root
        while True:
            d = edit_distance(words, node[1])
            if d not in node[2]:
                node[2][d] = (key, words, {})
                return
            node = node[2][d]

    def nearest(self, words: list[str], most: float) -> tuple[str, int] | None:
        """The key of the nearest template and its distance, if that is no more than allowed."""
        best: tuple[str, int] | None = None
        pending = [self.root] if self.root else []
        while pending:
            key, own, children = pending.pop()
            d = edit_distance(own, words)
            if d <= most:
                best, most = (key, d), d - 1  # only a nearer one is of interest
            reach = most if best is None else best[1]
            pending += [c for at, c in children.items() if abs(at - d) <= reach]
        return best


#: Share of words in which a statement may differ from a template for the tree to find it.
DIFFERENCE = 0.34
#: Share in which a whole text may differ from a licence's body and still be that licence.
BODY_DIFFERENCE = 0.02
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n\s*\n|(?<=:)\n")
COPYRIGHT = re.compile(r"(?im)^[^\w\n]*(?:copyright|\(c\)|©)[^\n]*$")
#: Sentences that titles stand in.
FRAMES = ("{}", "license {}", "licensed under the {}", "released under the {}", "is free to use under the {}", "offered under the {} and the {}", "use it under the {} or the {} at your choice")


class Licences:
    def __init__(self, rows: list[tuple[str, str, str, str]]):
        """rows: (license_id, title, notice, full_text)"""
        self.ids = {i.lower(): i for i, *_ in rows}
        self.bodies, self.notices, by_title = [], [], {}
        for i, title, notice, full in rows:
            body = full.split("\n", 1)[1] if full.startswith(title) else full
            self.bodies.append((i, flat(body)))
            self.notices.append((i, flat(notice.split(". See ")[0])))
            by_title.setdefault(title, []).append(i)
        self.titles = []
        for title, ids in by_title.items():
            name, _, version = title.partition(", version ")
            words = r"\s+".join(map(re.escape, flat(name).split()))
            tail = rf"\s+(?:version\s+|v\s*)?v?{re.escape(version)}(?![\d.]*\d)" if version else r"\b"
            self.titles.append((re.compile(rf"(?<=\s){words}{tail}"), ids))

        known = []
        for i, title, notice, full in rows:
            body = full.split("\n", 1)[1] if full.startswith(title) else full
            known += [(f"body:{i}", flat(body).split()), (f"body:{i}", flat(title + " " + body).split()), (f"notice:{i}", flat(notice.split(". See ")[0]).split()), (f"notice:{i}", flat(notice).split())]
            known += [(f"title:{i}", flat(frame.format(title, title)).split()) for frame in FRAMES]
        self.tree = MetricTree(known)
        self.vocabulary = {w for _, words in known for w in words}
        self.title_begins = {flat(title).split()[0] for title in by_title}
        self.title_lengths = sorted({len(flat(title).split()) + k for title in by_title for k in (-1, 0, 1)} - {0, 1})

    def near(self, text: str) -> tuple[bool, str | None]:
        """Whether a part of the text is near to a template, and the licence whose body the whole text is but for a few words."""
        text = COPYRIGHT.sub("", text)
        whole = flat(text).split()
        found = None
        if len(whole) >= 40 and (body := self.tree.nearest(whole, BODY_DIFFERENCE * len(whole))) and body[0].startswith("body:"):
            found = body[0][5:]
        if found:
            return True, found
        for sentence in SENTENCE_END.split(text):
            words = re.sub(r" v(?=\d)", " version ", flat(sentence)).split()
            # a template at this distance shares most of its words
            shared = sum(w in self.vocabulary for w in words)
            if shared < 2:
                continue
            if shared > 3 and shared >= (1 - DIFFERENCE) * len(words) and self.tree.nearest(words, DIFFERENCE * len(words)):
                return True, None
            # a title may stand in a longer sentence: runs that begin as one does
            for k, w in enumerate(words):
                if w in self.title_begins and any(self.tree.nearest(words[k : k + n], DIFFERENCE * n) for n in self.title_lengths):
                    return True, None
        return False, None

    def of_ids(self, expression: str) -> str:
        expression = re.sub(r"\*/.*|-->.*|[()]", "", expression).strip()
        parts = [p.strip().lower() for p in re.split(r"(?i)\s+or\s+|\s*\|\|?\s*", expression)]
        known = [self.ids.get(p.split()[0] if p else p) for p in parts]
        return " OR ".join(sorted(set(known))) if all(known) and known else "unknown"

    def named(self, text: str) -> list[str]:
        """Licences that are in a flat text, by body, else by title."""
        got = [i for i, b in self.bodies if b in text]
        rest = text
        same = {}
        for i, b in self.bodies:
            same.setdefault(b, []).append(i)
        out: list[str] = []
        for b, ids in same.items():
            if b in text:
                titled = [i for i in ids if any(i in t and p.search(text) for p, t in self.titles)]
                out += titled[:1] if len(titled) == 1 else titled or ids[:1]
                rest = rest.replace(b, " ")
        for pattern, ids in self.titles:
            for m in pattern.finditer(rest):
                after = rest[m.end() : m.end() + 60]
                if len(ids) == 1:
                    out.append(ids[0])
                else:
                    later = [i for i in ids if "later" in i] if re.match(r"\s*(?:or|and)?\s*(?:\(?at your option\)?\s*)?(?:or\s+)?any later|\s*or later|\s*or newer", after) else [i for i in ids if "only" in i]
                    if not (set(ids) & set(got) and not re.match(r"\s*(?:or any later|and no other|or later|only)", after)):
                        out += later[:1] or ids[:1]
        return list(dict.fromkeys(out))

    def of(self, text: str, whole: bool) -> str | None:
        """The licence that a text states. whole: the text is a licence file's, so that it states one anyhow."""
        stated: list[str] = []
        for m in ID_LINE.finditer(text):
            if m[1].strip(" */-"):
                stated.append(self.of_ids(m[1]))
        text = ID_LINE.sub("\n", text)
        near, body = self.near(text)
        named = self.named(flat(text)) if near else []
        if not named and body:
            named = [body]
        if len(named) > 1 and EITHER.search(text):
            named = [" OR ".join(sorted(named))]
        if not named and not stated and (whole or STATES.search(re.sub(r"\s+", " ", text))):
            named = ["unknown"]
        stated = list(dict.fromkeys([*stated, *named]))
        return None if not stated else stated[0] if len(stated) == 1 else "conflict"


def own_statement(known: Licences, language: str, text: str) -> str | None:
    if language in ("json",):
        return None
    comments: list[str] = []
    end = -1
    for kind, t, at in tokens(language, text):
        if kind != "comment":
            continue
        if end < 0 or text[end:at].strip():
            comments.append("")
        comments[-1] += "\n".join(comment_lines(t)) + "\n"
        end = at + len(t)
    blocks = [b for c in comments for b in re.split(r"\n\s*\n", c) if b.strip()]
    return known.of("\n\n".join(comments), False) if blocks else None


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [tuple(r) for r in table(spark, sf_dir, "license_texts").select("license_id", "title", "notice", "full_text").distinct().collect()]
    repos = table(spark, sf_dir, "repos").groupBy("repo_id").agg(F.max("local_path").alias("root"))
    f = files(spark, sf_dir).join(repos, "repo_id", "left")
    inside = F.expr("case when root is not null and startswith(local_path, root || '/') then substr(local_path, length(root) + 2) end")
    f = f.withColumn("path", F.coalesce("path_in_repo", inside, "local_path"))

    def state(batches):
        known = Licences(rows)
        for b in batches:
            out = []
            for d, r, p, n, t in zip(b["doc_id"], b["repo_id"], b["path"], b["language"], b["content"]):
                p, t = p or "", t or ""
                licence = bool(LICENCE_FILE.match(p.rpartition("/")[2]))
                prose = n in ("text", "markdown")
                if licence or not prose:
                    out.append((d, r, p.rpartition("/")[0], licence, not prose, known.of(t, True) if licence else own_statement(known, n, t)))
            yield pd.DataFrame(out, columns=["doc_id", "repo_id", "dir", "licence", "code", "states"])

    s = f.select("doc_id", "repo_id", "path", "language", "content").mapInPandas(state, "doc_id bigint, repo_id bigint, dir string, licence boolean, code boolean, states string")
    s = s.persist()
    one = F.when(F.count_distinct("states") > 1, "conflict").otherwise(F.min("states"))
    licences = s.where("licence").groupBy("repo_id", "dir").agg(one.alias("near"))
    repo = licences.where("dir = ''").select(F.lit("repo").alias("scope"), F.col("repo_id").alias("key_id"), F.col("near").alias("license_id"))
    code = s.where("code").withColumn("parts", F.split("dir", "/"))
    up = code.withColumn("depth", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size("parts")))))
    up = up.select("doc_id", "repo_id", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("dir"))
    near = up.join(licences, ["repo_id", "dir"]).groupBy("doc_id").agg(F.max_by("near", "depth").alias("near"))
    each = code.select("doc_id", "states").join(near, "doc_id", "left")
    file = each.select(F.lit("file").alias("scope"), F.col("doc_id").alias("key_id"), F.coalesce("states", "near").alias("license_id")).where("license_id is not null")
    sure = ~F.col("states").isin("unknown", "conflict") & ~F.col("near").isin("unknown", "conflict")
    mismatch = each.where(sure & (F.col("states") != F.col("near"))).select(F.lit("mismatch").alias("scope"), F.col("doc_id").alias("key_id"), F.col("states").alias("license_id"))
    return repo.unionByName(file).unionByName(mismatch)
