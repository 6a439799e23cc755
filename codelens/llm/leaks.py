"""Problem 9: documents whose text holds passages of held-out test items.

Pigeonhole: of a stretch with so many errors, cut into one piece more, a piece is without
errors. Changes lie APART words from each other, so a stretch of WORDS has at most two, and
one of every three pieces is whole; pieces of PIECE_WORDS at fixed places of the item are
short enough that such a run holds one wherever the stretch begins (20 words with changes 15
apart keep 10 in a row, 40 characters keep 13). Exact hits of pieces are checked with Myers'
bit-parallel distance on the words after and before, then measured word by word."""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.corpus import table

SHARE, WORDS, CHARS, APART = 0.4, 20, 40, 15
PIECE_WORDS, PIECE_CHARS = 5, 7
#: Items looked for in one pass over the documents. More items mean more passes, each with a table of pieces of bounded size.
ITEMS_PER_PASS = 20_000

CJK = re.compile(r"[㐀-鿿぀-ヿ]")
MARKUP = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>|\]\([^)\s]*\)|^[ \t>]*\[\d\d?:\d\d(?::\d\d)?\]", re.M)
MOJIBAKE = re.compile("[\u0080-ÿŒœŠšŸŽžƒˆ˜–-›€™]{2,}")
WORD, CHAR = re.compile(r"[^\W_]+"), re.compile(r"[^\W_]")


def _bytes(run: str) -> bytes:
    return b"".join(c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252") for c in run)


def _decoded(m: re.Match) -> str:
    try:
        return _bytes(m[0]).decode("utf-8")
    except UnicodeError:
        return m[0]


def plain(text: str) -> str:
    """The text without mark-up, quoting and wrong decoding, case folded."""
    if not text.isascii():
        text = MOJIBAKE.sub(_decoded, text)
    return html.unescape(MARKUP.sub(" ", text)).casefold()


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.?!])\s+|(?<=[。？！])", text.strip()) if s.strip()]


def distance(pattern: list[str], text: list[str], most: int) -> bool:
    """Whether a beginning of the text is within so many errors of the pattern (Myers, with words for letters)."""
    m = len(pattern)
    if not m:
        return True
    places: dict[str, int] = {}
    for i, w in enumerate(pattern):
        places[w] = places.get(w, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << m - 1
    plus, minus, score = mask, 0, m
    if score <= most:
        return True
    for w in text:
        eq = places.get(w, 0)
        zero = ((eq & plus) + plus ^ plus) | eq | minus
        up = minus | ~(zero | plus) & mask
        down = plus & zero
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        if score <= most:
            return True
        up = up << 1 | 1
        plus = (down << 1 | ~(zero | up)) & mask
        minus = up & zero & mask
    return False


class Items:
    """Pieces of the items (own words only), and where they stand in them."""

    def __init__(self, rows: list[tuple[int, str]]):
        """rows: (item_id, text without shared sentences)"""
        self.words, self.chars = {"items": [], "pieces": {}}, {"items": [], "pieces": {}}
        for item, text in rows:
            own = plain(text)
            by_char = len(CJK.findall(own)) > len(own) / 3
            tokens = (CHAR if by_char else WORD).findall(own)
            need = max(CHARS if by_char else WORDS, math.ceil(SHARE * len(tokens)))
            if len(tokens) >= need:
                self._add(self.chars if by_char else self.words, item, tokens, need, PIECE_CHARS if by_char else PIECE_WORDS)

    @staticmethod
    def _add(index: dict, item: int, tokens: list[str], need: int, k: int) -> None:
        for p in range(0, len(tokens) - k + 1, k):
            index["pieces"].setdefault(tuple(tokens[p : p + k]), []).append((len(index["items"]), p))
        index["items"].append((item, tokens, need))

    def found(self, text: str) -> set[int]:
        text = plain(text)
        got = self._found(self.words, WORD.findall(text), PIECE_WORDS)
        if self.chars["items"] and CJK.search(text):
            got |= self._found(self.chars, CHAR.findall(text), PIECE_CHARS)
        return got

    @staticmethod
    def _found(index: dict, doc: list[str], k: int) -> set[int]:
        pieces = index["pieces"]
        got: set[int] = set()
        done: dict[tuple[int, int], int] = {}
        for i, run in enumerate(zip(*[doc[x:] for x in range(k)])):
            if run not in pieces:
                continue
            for n, p in pieces[run]:
                item, tokens, need = index["items"][n]
                if item in got or done.get((n, i - p), -1) >= i:
                    continue
                # a passage of need words through the piece has half of them on one side of it, with its errors
                half, most = (need + k) // 2, (need - 1) // APART + 1
                after = distance(tokens[p : p + half], doc[i : i + half + most], most)
                if not after and not distance(tokens[max(0, p + k - half) : p + k][::-1], doc[max(0, i + k - half - most) : i + k][::-1], most):
                    continue
                a, b = i, p
                while a and b and doc[a - 1] == tokens[b - 1]:
                    a, b = a - 1, b - 1
                e = p + k
                while e < len(tokens) and i - p + e < len(doc) and doc[i - p + e] == tokens[e]:
                    e += 1
                done[n, i - p] = i - p + e - k
                if stretch(doc, tokens, a, b) >= need:
                    got.add(item)
        return got


def stretch(doc: list[str], tokens: list[str], a: int, b: int) -> int:
    """Words of the item in the longest stretch through the right run that begins at doc[a] and tokens[b]."""
    best = right(doc, tokens, a, b, None)
    if b:
        for i in (a - 1, a):  # the word before is changed, or missing
            if n := left(doc, tokens, i - 1, b - 2, b - 1):
                best = max(best, n + 1 + right(doc, tokens, a, b, b - 1))
    return best


def right(doc: list[str], tokens: list[str], i: int, j: int, last: int | None) -> int:
    begin = j
    while i < len(doc) and j < len(tokens) and doc[i] == tokens[j]:
        i, j = i + 1, j + 1
    more = 0
    if j > begin and j + 1 < len(tokens) and (last is None or j - last >= APART):
        more = max(right(doc, tokens, i + 1, j + 1, j), right(doc, tokens, i, j + 1, j))
    return j - begin + (more and more + 1)


def left(doc: list[str], tokens: list[str], i: int, j: int, last: int) -> int:
    begin = j
    while i >= 0 and j >= 0 and doc[i] == tokens[j]:
        i, j = i - 1, j - 1
    more = 0
    if j < begin and j > 0 and last - j >= APART:
        more = max(left(doc, tokens, i - 1, j - 1, j), left(doc, tokens, i, j - 1, j))
    return begin - j + (more and more + 1)


def own_texts(items: DataFrame) -> DataFrame:
    """(item_id, text) without the sentences that several items share."""

    def split(batches):
        for b in batches:
            rows = [(i, n, x.strip()) for i, t in zip(b["item_id"], b["text"]) if t for n, x in enumerate(sentences(t))]
            yield pd.DataFrame(rows, columns=["item_id", "nth", "sentence"]).astype({"item_id": "int64", "nth": "int32"})

    each = items.where("item_id is not null").select("item_id", "text").distinct().mapInPandas(split, "item_id bigint, nth int, sentence string")
    shared = each.groupBy("sentence").agg(F.count_distinct("item_id").alias("n")).where("n > 1")
    own = each.join(shared, "sentence", "left_anti").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("nth", "sentence"))).alias("s"))
    return own.select("item_id", F.array_join(F.col("s.sentence"), " ").alias("text"))


def leaked(documents: DataFrame, items: DataFrame, items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """(doc_id, item_id). Items in blocks of bounded size against all documents. Null and empty texts hold nothing."""
    own = own_texts(items).persist()
    passes = max(1, -(-own.count() // items_per_pass))
    found = None
    for k in range(passes):
        rows = [(r.item_id, r.text) for r in own.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).collect()]

        def leaks(batches, rows=rows):
            block = Items(rows)
            for b in batches:
                yield pd.DataFrame([(d, i) for d, t in zip(b["doc_id"], b["text"]) if t for i in block.found(t)], columns=["doc_id", "item_id"]).astype("int64")

        one = documents.select("doc_id", "text").mapInPandas(leaks, "doc_id bigint, item_id bigint")
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
