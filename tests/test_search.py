"""Search against a plain evaluator, and the cases that the engine promises."""

import re

import pytest
from codelens.engine import Engine, NotFinished
from codelens.functions import text as T
from codelens.index import grams as G
from codelens.operators import filters, merge, present
from codelens.options import CtagsOptions, EngineOptions, IndexOptions, IngestOptions, SearchRequest, web_request
from codelens.plans import search as S
from codelens.query.analyse import analyse
from codelens.query.tree import Leaf, QueryError
from codelens.render import text as rendered
from codelens.sources import ingest, scan
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

TEXTS = ["aaaa", "bbbb", "cccc", "bb\naa", "dddd", "", None, "é ab É\nba\n", "ab\\E\x01x", "aAbB cC\r\nd", "a\x02b"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, content string").persist()


def found(docs, query):
    q = analyse(query)
    return {r.doc_id: [(s.start, s.end) for s in r.sections] for r in S.sections(docs, q.content, q.case_sensitive).collect()}


def fold(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def naive(node, text):
    """Spans of a tree in a text; None if it does not hold."""
    if isinstance(node, Leaf):
        data, t = fold(text).encode(), fold(node.text).encode()
        spans = {(i, i + len(t)) for i in range(len(data)) if data[i : i + len(t)] == t}
        if node.negated:
            return None if spans else set()
        return spans or None
    parts = [naive(p, text) for p in node.parts]
    if node.op == "AND":
        return None if None in parts else set().union(*parts)
    parts = [p for p in parts if p is not None]
    return set().union(*parts) if parts else None


WORD = st.sampled_from(["a", "b", "aa", "ab", "É", "c", "\\E", "d"])
TREE = st.recursive(WORD, lambda x: st.tuples(x, st.sampled_from(["and", "or", "and -"]), x).map(lambda t: f"({t[0]} {t[1]}{'' if t[1].endswith('-') else ' '}{t[2]})"), max_leaves=5)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(query=TREE)
def test_trees_give_what_merging_sets_gives(docs, query):
    try:
        q = analyse(query)
    except QueryError:
        return
    expected = {i: sorted(s) for i, t in enumerate(TEXTS) if t is not None and (s := naive(q.content, t)) is not None}
    assert found(docs, query) == expected


def test_spans_of_a_branch_that_failed_are_not_shown(docs):
    assert found(docs, "(aa and zz) or bb") == {1: [(0, 2), (1, 3), (2, 4)], 3: [(0, 2)], 9: [(2, 4)]}


def test_regex_spans(docs):
    assert found(docs, "a.*a or bbb") == {0: [(0, 4)], 1: [(0, 3), (1, 4)], 3: [(3, 5)], 9: [(0, 2)]}
    assert found(docs, "foo|bb") == {1: [(0, 2), (2, 4)], 3: [(0, 2)], 9: [(2, 4)]}
    assert found(docs, "bb$ or zz") == {1: [(2, 4)]}  # line by line, where a line ends after its line end


def test_regex_lists(spark):
    d = spark.createDataFrame([(i, "this is a document") for i in (1, 2, 4, 5)] + [(3, "thids is a document"), (6, "docs is good")], "doc_id bigint, content string")
    assert found(d, "this.*doc") == {i: [(0, 13)] for i in (1, 2, 4, 5)}
    assert set(found(merge.complement(d, d.where("doc_id = 1")), "this.*doc")) == {2, 4, 5}
    assert set(found(d.where("doc_id <= 3"), "is -this.*doc")) == {3}


def test_case(spark):
    d = spark.createDataFrame([(1, "KAFKA_LoG_PRODUCER_HELPER")], "doc_id bigint, content string")
    assert found(d, "case:yes A_LoG") == {1: [(4, 9)]} and found(d, "case:yes a_log") == {} and found(d, "a_log") == {1: [(4, 9)]}


def test_symbols(spark):
    content = "a1 a2 a3\nb1 b2 b3\nc1 c2 c3"
    d = spark.createDataFrame([(1, content)], "doc_id bigint, content string")
    lines = d.select("doc_id", F.inline(T.lines("content")))
    entries = spark.createDataFrame([(1, "a2", 1), (1, "b1", 2), (1, "c3", 3), (1, "b3", 1), (1, "c3", 3), (1, "x", None)], "doc_id bigint, sym string, line_no int")
    symbols = S.located_symbols(entries, lines)
    at = {}
    for token in ("a3", "b2", "b1", "a2", "c3"):
        q = analyse(f"sym:{token}")
        at[token] = [(s.start, s.end) for r in S.sections(d, q.content, False, symbols).collect() for s in r.sections]
    assert at == {"a3": [], "b2": [], "b1": [(9, 11)], "a2": [(3, 5)], "c3": [(24, 26)]}


def test_index_gives_what_a_scan_gives(spark, docs):
    p = G.build(docs)
    f = G.frequencies(p)
    for token in ("aa", "ab", "É", "b", "bb\naa", "É\nba", "zz", "ab\\E"):
        scanned = found(docs, f'"{token}"') if not token.isspace() else {}
        indexed = {r.doc_id: [(s.start, s.end) for s in r.sections] for r in G.search(docs, p, f, token).collect()}
        assert indexed == scanned, token
    with pytest.raises(QueryError):
        G.rarest_pair(f, " ")


def test_two_keys(spark):
    p = spark.createDataFrame([("x", 1, [1, 2, 32, 44]), ("y", 1, [4, 11, 35, 45])], "gram string, doc_id bigint, locations array<int>")
    at = lambda d: sorted(x for r in G.two_keys(p, "x", "y", d).collect() for x in r.locations)
    assert (at(1), at(3), at(9), at(19)) == ([44], [1, 32], [2], [])
    assert at(0) == [1, 2, 4, 11, 32, 35, 44, 45]


def test_gram_keys():
    assert G.decode_key(G.encode_key("é😀b")) == "é😀b" and G.encode_key("a b") == 0 and G.pretty_key(G.encode_key("a\n")) == "a\\n"


def test_coalesce(spark):
    one = lambda spans: sorted((r.start, r.end) for r in merge.coalesce_spans(spark.createDataFrame([(1, *s) for s in spans], "doc_id bigint, start int, end int")).collect())
    assert one([(1, 2), (4, 7), (4, 8), (6, 9), (11, 12)]) == [(1, 2), (4, 9), (11, 12)]
    assert one([(1, 2), (4, 7), (4, 7), (7, 11), (11, 12)]) == [(1, 2), (4, 12)]


def test_lines(spark):
    d = spark.createDataFrame([(1, "aaaa\nbbbb\ncccc\ndddd\neeee\nffff\ngggg")], "doc_id bigint, content string")

    def lines(spans, context=0, most=0):
        s = spark.createDataFrame([(1, *x) for x in spans], "doc_id bigint, start int, end int")
        return {r.line_no: [(h.start, h.end) for h in r.highlights or []] for r in present.lines_of_sections(s, d, context, most).collect()}

    assert lines([(0, 1), (3, 4), (6, 7), (11, 17)]) == {0: [(0, 1), (3, 4)], 1: [(1, 2)], 2: [(1, 5)], 3: [(0, 2)]}
    assert lines([(3, 4), (11, 17)], 1) == {0: [(3, 4)], 1: [], 2: [(1, 5)], 3: [(0, 2)], 4: []}
    assert lines([(0, 1), (6, 7), (11, 12)], 0, 2) == {0: [(0, 1)], 1: [(1, 2)]}
    assert lines([(30, 100), (10, 1)]) == {6: [(0, 4)]}


ROWS = [("repo_a/file_a", "aaaa"), ("repo_a/file_b", "bbbb"), ("repo_a/file_c", "cccc"), ("repo_b/file_a", "bb\naa"), ("repo_b/file_d", "dddd"), ("repo_c/file_d", "dddd"), ("repo_c/file_b", "bbbb")]
REPO_IDS = {f"me@git.com:repo_{x}": i for i, x in enumerate("abc", 1)}


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark, EngineOptions(ingest=IngestOptions(allow_unknown=True), index=IndexOptions(use_grams=True), repo_ids=REPO_IDS))
    with pytest.raises(NotFinished):
        e.search(SearchRequest("aa"))
    e.index_files(scan.memory(spark, ROWS + ROWS[:1]))
    e.index_repos(spark.createDataFrame([(f"repo_{x}", f"me@git.com:repo_{x}") for x in "abc"], "local_path string, remote_url string"))
    e.finish()
    with pytest.raises(NotFinished):
        e.index_files(scan.memory(spark, ROWS))
    return e


def shown(engine, query, **more):
    r = engine.search(SearchRequest(query, **more))
    out = [(d.filename, [(x.line_no, [(h.start, h.end) for h in x.highlights or []]) for x in d.lines or []]) for repo in r.nested().collect() for d in repo.documents]
    r.close()
    return out


@pytest.mark.parametrize(
    "query,expected",
    [
        ("aaaa", [("file_a", [(0, [(0, 4)])])]),
        ("aa", [("file_a", [(0, [(0, 4)])]), ("file_a", [(1, [(0, 2)])])]),
        ("aa and bb", [("file_a", [(0, [(0, 2)]), (1, [(0, 2)])])]),
        ("repo:repo_a (a.*a or bbb)", [("file_b", [(0, [(0, 4)])]), ("file_a", [(0, [(0, 4)])])]),
        ("repo:repox a", []),
    ],
)
def test_end_to_end(engine, query, expected):
    assert shown(engine, query) == expected


def test_files_repositories_and_lists(engine, spark):
    files = engine.search(SearchRequest("repo:repo_a file:b"))
    assert files.kind == "files" and [r.filename for r in files.documents.collect()] == ["file_b"]
    assert sorted(r.repo_id for r in engine.search(SearchRequest("repo:repo_[ab]")).repos.collect()) == [1, 2]
    assert [r.repo_id for r in engine.search(SearchRequest("repo:repo", page=1, page_size=2)).repos.collect()] == [3]
    assert [r.repo_id for r in engine.search(SearchRequest("aa", may_see_repo=lambda r: r == 2)).repos.collect()] == [2]
    assert [r.repo_id for r in engine.search(SearchRequest("aa", repo_ids=[1])).repos.collect()] == [1]
    with pytest.raises(QueryError):
        engine.search(SearchRequest("lang:go"))


def test_pages_of_one_repository(engine):
    assert [f for f, _ in shown(engine, "repo:repo_a (aa or bb or cc)", page=1, page_size=2)] == ["file_c"]


def test_response_as_json_and_text(engine):
    import json

    r = engine.search(web_request("aa", page_size=1))
    out = json.loads(r.to_json())
    assert (out["numRepos"], out["numDocuments"], out["numSections"], len(out["repos"])) == (2, 2, 4, 1)
    assert "1: aaaa" in rendered(r, colour=False)
    assert engine.health() == "ok" and engine.content(-1) is None
    assert [tuple(r) for r in engine.language_stats().select("n_files", "n_lines").collect()] == [(7, 8)]


def test_content_is_left_out_if_not_wanted(engine):
    assert "content" not in engine.search(SearchRequest("aa", return_content=False)).lines.columns


def test_folders(spark, tmp_path):
    for path, text in {"r/.git/config": '[remote "origin"]\n\turl = u1\n', "r/a.go": "package a\n", "r/sub/.git/config": '[remote "origin"]\n\turl = u2\n', "r/sub/b.py": "x = 1\n", ".hid/c.go": "x", "r/x.bin": "a\x00b"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    e = Engine(spark, EngineOptions(repo_ids={"u1": 1, "u2": 2}))
    e.index_dir(str(tmp_path))
    e.finish()
    assert sorted((r.repo_id, r.filename, r.language) for r in e.docs.collect()) == [(1, "a.go", "go"), (2, "b.py", "python")]
    assert {r.reason: r.n_files for r in e.reject_counts().collect()} == {"binary": 1}


def test_symbols_by_a_program(spark, tmp_path):
    program = tmp_path / "tags.py"
    program.write_text(
        "import sys, json\n"
        "while line := sys.stdin.buffer.readline():\n"
        "    q = json.loads(line); text = sys.stdin.buffer.read(q['size']).decode()\n"
        "    print('noise'); [print(json.dumps({'_type': 'tag', 'name': x.split()[1], 'line': i, 'kind': 'f'})) for i, x in enumerate(text.split(chr(10)), 1) if x.startswith('func ')]\n"
        "    print(json.dumps({'_type': 'completed'}), flush=True)\n"
    )
    e = Engine(spark, EngineOptions(ctags=CtagsOptions(("python3", str(program)))))
    e.index_files(scan.memory(spark, [("a.go", "package a\nfunc run {}\nrun\n"), ("b.go", "")]))
    e.finish()
    assert [d for d, _ in shown(e, "sym:run")] == ["a.go"] and shown(e, "sym:package") == []


def test_repository_id_zero_is_refused(spark):
    with pytest.raises(ValueError):
        scan.with_repo_ids(spark.createDataFrame([("a", "u")], "local_path string, remote_url string"), {"u": 0})


def test_reasons_in_order(spark):
    files = spark.createDataFrame(
        [("a.go", "x"), (".a.go", "x"), ("b.png", "x"), ("vendor/a.go", "x"), ("c.go", "// Code generated by x. DO NOT EDIT.\n"), ("d", "x"), ("e.go", "x\n" * 6), ("f.go", "y" * 30), ("g.go", None), ("h.js", "x")],
        "local_path string, content string",
    )
    got = {r.local_path: r.reason for r in ingest.reasons(files, IngestOptions(max_lines=5, max_bytes=29 + 9, deny_extensions=("js",))).collect()}
    assert got == {"a.go": None, ".a.go": "dot_file", "b.png": "image", "vendor/a.go": "vendored", "c.go": "generated", "d": "language_unknown", "e.go": "too_many_lines", "f.go": None, "g.go": "no_content", "h.js": "extension_denied"}


def test_modifiers_of_nulls_and_invalid_patterns(spark):
    d = spark.createDataFrame([(1, None, "go", "a/b.go"), (2, "r", None, None)], "doc_id bigint, repo_name string, language string, filename string")
    ids = lambda q: sorted(r.doc_id for r in filters.restrict(d, analyse(q).lang, analyse(q).repo, analyse(q).file).collect())
    assert ids("a -file:b") == [2] and ids("a -file:*x") == [1, 2] and ids("a file:*x") == [] and ids("a -repo:r") == [1] and ids("a lang:GO") == [1]
