"""Content search: a query tree as one scan of the documents.

The tree becomes a test of a document. Spans are looked for afterwards, only in the
documents that pass and only for the positive leaves whose branch took part: in
(a AND b) OR c, a document with a and c but not b shows no spans of a. So every
positive leaf carries the tests of the AND groups above it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.functions import text as T
from codelens.query import re2
from codelens.query.tree import Leaf, Node, leaves


def java(leaf: Leaf, case_sensitive: bool) -> str:
    """The pattern of a regex leaf; the flag goes in before parsing, so that it is written out where letters stand."""
    return re2.compile(leaf.text if case_sensitive else f"(?i){leaf.text}").java


def clauses(leaf: Leaf) -> tuple[tuple[str, ...], ...]:
    return re2.compile(leaf.text).clauses


def clause_test(text: Column, leaf: Leaf, case_sensitive: bool) -> Column | None:
    """Whether a text holds every mandatory literal of a pattern: cheap, and true wherever the pattern matches."""
    out = None
    for clause in clauses(leaf):
        if case_sensitive:
            parts = [F.contains(text, F.lit(t)) for t in clause]
        else:
            # only ASCII letters are folded; longest part between other letters
            ascii_parts = [max("".join(c if ord(c) < 128 else "\n\n" for c in t).split("\n\n"), key=len) for t in clause]
            if not all(ascii_parts):
                continue
            parts = [F.contains(T.fold_wide(text), F.lit(T.fold_str(t))) for t in ascii_parts]
        test = parts[0]
        for p in parts[1:]:
            test = test | p
        out = test if out is None else out & test
    return out


def regex_test(text: Column, leaf: Leaf, case_sensitive: bool) -> Column:
    """With mandatory literals a pattern is searched for line by line, in the lines that hold them all; without, in the whole text."""
    pattern = java(leaf, case_sensitive)
    if not clauses(leaf):
        return text.rlike(pattern)
    whole = clause_test(text, leaf, case_sensitive)
    by_line = F.exists(T.line_array(text), lambda x: _line_test(x, leaf, case_sensitive) & x.rlike(pattern))
    return by_line if whole is None else whole & by_line


def _line_test(line: Column, leaf: Leaf, case_sensitive: bool) -> Column:
    test = clause_test(line, leaf, case_sensitive)
    return F.lit(True) if test is None else test


def literal_test(text: Column, leaf: Leaf, case_sensitive: bool) -> Column:
    return F.contains(text, F.lit(leaf.text)) if case_sensitive else F.contains(T.fold(text), F.lit(T.fold_str(leaf.text)))


def symbol_column(leaf: Leaf) -> str:
    return f"_sym_{leaf.text}".replace(".", "_dot_").replace("`", "_tick_")


def leaf_test(leaf: Leaf, case_sensitive: bool) -> Column:
    text = F.col("content")
    if leaf.symbol:
        test = F.col(f"`{symbol_column(leaf)}`").isNotNull()
    elif leaf.kind == "literal":
        test = literal_test(text, leaf, case_sensitive)
    else:
        test = regex_test(text, leaf, case_sensitive)
    return ~test if leaf.negated else test


def tree_test(node: Node, case_sensitive: bool) -> Column:
    """Parts stand in order of cost: literals, regexes, groups. Catalyst keeps that order."""
    if isinstance(node, Leaf):
        return leaf_test(node, case_sensitive)
    out = None
    for p in node.parts:
        test = tree_test(p, case_sensitive)
        out = test if out is None else out & test if node.op == "AND" else out | test
    return out


def positive_leaves(node: Node, case_sensitive: bool, above: Column | None = None) -> Iterator[tuple[Leaf, Column | None]]:
    """Positive leaves with the test of the groups they stand in; None where the tree's own test says it all."""
    if isinstance(node, Leaf):
        if not node.negated:
            yield node, above
        return
    for p in node.parts:
        path = above
        if node.op == "OR":
            test = tree_test(p, case_sensitive)
            path = test if above is None else above & test
        yield from positive_leaves(p, case_sensitive, path)


def leaf_spans(leaf: Leaf, case_sensitive: bool) -> Column:
    if leaf.symbol:
        return F.col(f"`{symbol_column(leaf)}`")
    if leaf.kind == "literal":
        return T.literal_spans("content", leaf.text, case_sensitive)
    line_test = (lambda x: _line_test(x, leaf, case_sensitive)) if clauses(leaf) else None
    return T.regex_spans("content", java(leaf, case_sensitive), line_test)


def spans(node: Node, case_sensitive: bool) -> Column:
    """Spans of all positive leaves that took part in a document, each once, in order."""
    each: dict[str, tuple[Leaf, list[Column | None]]] = {}
    for leaf, path in positive_leaves(node, case_sensitive):
        each.setdefault(str(leaf), (leaf, []))[1].append(path)
    columns = []
    for leaf, paths in each.values():
        found = leaf_spans(leaf, case_sensitive)
        if all(p is not None for p in paths):
            test = paths[0]
            for p in paths[1:]:
                test = test | p
            found = F.when(test, found)
        columns.append(found)
    return T.union_spans(*columns)


def with_symbols(docs: DataFrame, node: Node, symbols: DataFrame | None, case_sensitive: bool) -> DataFrame:
    """Adds the spans of each sym: leaf by document; null where a document has none."""
    for leaf in {str(x).lstrip("-"): x for x in leaves(node) if x.symbol}.values():
        if symbols is None:
            raise ValueError("sym: needs a table of symbols")
        docs = docs.join(symbol_spans(symbols, leaf.text, case_sensitive).withColumnRenamed("spans", symbol_column(leaf)), "doc_id", "left")
    return docs


def symbol_spans(symbols: DataFrame, token: str, case_sensitive: bool) -> DataFrame:
    """symbols: doc_id, sym, start (byte). Spans of a token inside of symbols: (doc_id, spans)."""
    text, t = (F.col("sym"), token) if case_sensitive else (T.fold("sym"), T.fold_str(token))
    inside = symbols.where(F.contains(text, F.lit(t))).select("doc_id", "start", F.explode(T.literal_spans("sym", token, case_sensitive)).alias("s"))
    span = F.struct((F.col("start") + F.col("s.start")).cast("int").alias("start"), (F.col("start") + F.col("s.end")).cast("int").alias("end"))
    return inside.groupBy("doc_id").agg(F.array_sort(F.collect_set(span)).alias("spans"))


def documents(docs: DataFrame, node: Node, case_sensitive: bool = False, symbols: DataFrame | None = None) -> DataFrame:
    """Documents that a content tree holds for. docs: doc_id, content and any other columns, which are kept."""
    kept = docs.columns
    return with_symbols(docs, node, symbols, case_sensitive).where(tree_test(node, case_sensitive)).select(*kept)


def sections(docs: DataFrame, node: Node, case_sensitive: bool = False, symbols: DataFrame | None = None) -> DataFrame:
    """documents, with their spans in sections (array of start, end in bytes, in order, each once)."""
    kept = docs.columns
    found = with_symbols(docs, node, symbols, case_sensitive).where(tree_test(node, case_sensitive))
    return found.select(*kept, spans(node, case_sensitive).alias("sections"))


def located_symbols(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """Where symbols stand: the first place of sym in its line (1-based). Each entry by itself, so several on a line are all found; one that does not stand there is none."""
    at = lines.select("doc_id", (F.col("line_no") + 1).alias("line_no"), "start", "content")
    byte = F.instr(T.byte_chars("content"), T.byte_chars("sym"))
    return symbols.join(at, ["doc_id", "line_no"]).withColumn("at", byte).where("at > 0").select("doc_id", "sym", (F.col("start") + F.col("at") - 1).alias("start")).distinct()
