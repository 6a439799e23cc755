"""Functions of text columns. All run in the JVM and take time linear in the text.

Places are bytes of UTF-8. Spark counts characters, so where places are needed a
text is first turned into one that has a character for every byte (byte_chars)."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

Text = Column | str
OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
LINE_BREAK = "(?<=\n)"
SPAN = "array<struct<start:int,end:int>>"


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Text) -> Column:
    """ASCII letters in lower case, all else as it is."""
    return F.translate(col(c), ascii_uppercase, ascii_lowercase)


def fold_str(s: str) -> str:
    return s.translate(str.maketrans(ascii_uppercase, ascii_lowercase))


def fold_wide(c: Text) -> Column:
    """fold, and the two other letters that fold to ASCII ones: for tests that must hold wherever a case-insensitive match is."""
    return F.translate(col(c), ascii_uppercase + "Kſ", ascii_lowercase + "ks")


def byte_chars(c: Text) -> Column:
    """A text with one character for every byte of c."""
    return F.decode(F.encode(col(c), "UTF-8"), "ISO-8859-1")


def byte_str(s: str) -> str:
    return s.encode("utf-8").decode("latin-1")


def java_quote(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def n_lines(c: Text) -> Column:
    """Line ends, and one more if the text ends with neither NUL nor a line end. Empty and null texts have none."""
    c = col(c)
    ends = F.octet_length(c) - F.octet_length(F.replace(c, F.lit("\n"), F.lit("")))
    last = (c != "") & ~F.endswith(c, F.lit("\n")) & ~F.endswith(c, F.lit("\x00"))
    return F.coalesce(ends + last.cast("int"), F.lit(0))


def line_array(c: Text) -> Column:
    """Lines with their ends; no empty one after a last line end."""
    return F.filter(F.split(col(c), LINE_BREAK), lambda x: x != "")


def lines(c: Text) -> Column:
    """array of (line_no, start, content)."""
    starts = F.concat(F.array(F.lit(0)), F.transform(marks(byte_chars(c), "\n"), lambda x: x + 1))
    each = F.zip_with(line_array(c), starts, lambda x, at: F.struct(at.alias("start"), x.alias("content")))
    numbered = F.transform(each, lambda x, i: F.struct(i.alias("line_no"), x["start"].alias("start"), x["content"].alias("content")))
    return F.filter(numbered, lambda x: x["content"].isNotNull())


def marks(chars: Column, mark: str) -> Column:
    """Places of a one-byte character."""
    at = F.transform(F.split(chars, ""), lambda x, i: F.when(x == mark, i))
    return F.array_compact(at)


def language_key(c: Text) -> Column:
    """Name of a language as it is compared: lower case, separators as _, ++ as pp, unknown if empty."""
    key = F.replace(F.translate(F.lower(col(c)), " .-", "___"), F.lit("++"), F.lit("pp"))
    return F.when(F.coalesce(key, F.lit("")) == "", "unknown").otherwise(key)


def literal_spans(c: Text, token: str, case_sensitive: bool) -> Column:
    """Spans of a literal, those that overlap included, in order."""
    if not token:
        raise ValueError("empty literal")
    t = byte_str(token if case_sensitive else fold_str(token))
    mark, other = [c for c in map(chr, range(1, 256)) if c not in t][:2]
    chars = F.translate(byte_chars(c if case_sensitive else fold(c)), mark, other)
    at = marks(F.regexp_replace(chars, f"(?={java_quote(t)})", mark), mark)
    return F.transform(at, lambda x, i: F.struct((x - i).alias("start"), (x - i + len(t)).alias("end")))


def count_literal(c: Text, token: str, case_sensitive: bool) -> Column:
    c, token = (col(c), token) if case_sensitive else (fold(c), fold_str(token))
    return F.size(F.split(F.concat(F.lit(OPEN), c), f"(?={java_quote(token)})")) - 1


def _marked(c: Column, java: str) -> Column:
    return F.regexp_replace(c, f"(?:{java})", f"{OPEN}$0{CLOSE}")


def _marked_spans(marked: Column) -> Column:
    chars = byte_chars(marked)
    starts = F.transform(marks(chars, OPEN), lambda x, i: x - 2 * i)
    ends = F.transform(marks(chars, CLOSE), lambda x, i: x - 2 * i - 1)
    spans = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return F.filter(spans, lambda s: s["end"] > s["start"])


def regex_spans(c: Text, java: str, holds=None) -> Column:
    """Spans of the matches that are not empty. holds: test of a line; with it every line that passes is searched for itself."""
    c = F.translate(col(c), OPEN + CLOSE, OTHER + OTHER)
    if holds is not None:
        c = F.array_join(F.transform(line_array(c), lambda x: F.when(holds(x), _marked(x, java)).otherwise(x)), "")
        return _marked_spans(c)
    return _marked_spans(_marked(c, java))


def union_spans(*spans: Column) -> Column:
    """Distinct spans of all, in order."""
    spans = [F.coalesce(s, F.array().cast(SPAN)) for s in spans]
    return F.array_sort(F.array_distinct(F.concat(*spans) if len(spans) > 1 else spans[0]))
