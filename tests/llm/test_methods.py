"""The methods by themselves: against brute force, on cases at the edges, and held-out accuracy."""

import random

import __spark_entry__ as e
import numpy as np
import pyarrow as pa
import pytest
from codelens.llm import attributes, containers, grams, hmm, leaks, licences, syntax
from codelens.llm.foreign import mined
from codelens.llm.grammars import Parsed


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_bit_parallel_distances_are_edit_distances():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        assert licences.edit_distance(a, b) == levenshtein(a, b)
        most = rng.randrange(4)
        assert leaks.distance(a, b, most) == (min((levenshtein(a, b[:n]) for n in range(len(b) + 1)), default=len(a)) <= most)


def test_metric_tree_finds_the_nearest():
    rng = random.Random(2)
    words = lambda: [rng.choice("abcd") for _ in range(rng.randrange(1, 10))]
    templates = [(str(i), words()) for i in range(40)]
    tree = licences.MetricTree(templates)
    for _ in range(200):
        q, most = words(), rng.randrange(6)
        best = min(levenshtein(q, t) for _, t in templates)
        got = tree.nearest(q, most)
        assert (got is None) == (best > most) and (got is None or got[1] == best)


def test_last_seen_counters(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "B", "b", "x y", None]), rng.choice([1, 2, 3, None]), rng.choice([None, [], [1, 2, 2, None], [5], [2, 1]])) for _ in range(200)] + [("only", 1, None)]
    want = {}
    for g, d, at in rows:
        if g is not None and d is not None:
            want.setdefault(g.lower(), set()).update((d, x) for x in at or () if x is not None)
    got = {r.gram: (r.occurrences, r.documents) for r in grams.gram_counts(spark.createDataFrame(rows, "gram string, doc_id bigint, locations array<int>")).collect()}
    assert got == {g: (len(s), len({d for d, _ in s})) for g, s in want.items()}
    assert grams.gram_counts(spark.createDataFrame([], "gram string, doc_id bigint, locations array<int>")).count() == 0


def test_last_seen_over_batches():
    rows = [("a", 1, None), ("a", 1, 3), ("a", 1, 3), ("a", 2, 3), ("b", 2, 1)]
    batch = lambda x: pa.RecordBatch.from_pylist([dict(zip(("gram", "doc_id", "at"), r)) for r in x], pa.schema([("gram", pa.string()), ("doc_id", pa.int64()), ("at", pa.int32())]))
    for cut in range(len(rows) + 1):
        total = {}
        for b in grams.last_seen(batch(x) for x in (rows[:cut], rows[cut:])):
            for r in b.to_pylist():
                o, d = total.get(r["gram"], (0, 0))
                total[r["gram"]] = (o + r["occurrences"], d + r["documents"])
        assert total == {"a": (2, 2), "b": (1, 1)}, cut


def test_least_cost_capacity():
    assert containers.least_cost(1500, 1, 0) == 2048 and containers.least_cost(200, 1, 0) == 256 and containers.least_cost(200, 1, 10**6) == 2048 and containers.least_cost(200, 50, 0) == 2048


@pytest.mark.parametrize(
    "language,text,valid",
    [
        ("go", "package a\n\nfunc (t *T[K]) F(a, b int, c ...string) (int, error) {\n\tif x := f(); x != nil {\n\t\treturn T{a: 1}.b, nil\n\t}\n\tfor i := range xs {\n\t\tgo func() {}()\n\t}\n\tswitch v := x.(type) {\n\tcase int, *T:\n\t}\n\treturn 0, nil\n}\n", True),
        ("go", "package a\n\nfunc f() {\n\tif x {\n}\n", False),
        ("go", "func f() {}\n", False),
        ("java", "@A(x = 1) class A<T extends B & C> { int[] a = {1, 2}; <U> List<Map<U, int[]>> f(final U u) throws E { for (var x : xs) x.f(y -> y + 1); return (List<T>) g(A::new); } }", True),
        ("java", "class A { int f() { return 1 } }", False),
        ("java", "class A { int f( { return 1; } }", False),
        ("javascript", "const f = async ({a, b = 1}, ...c) => { await g`x`; return /a[/]b/.test(c) ? {a, [b]: 1, get x() { return 1 }} : null }\nclass A extends B { static #p = 1; *g() { yield 1 } }\nexport default f", True),
        ("javascript", "function f() { return 1 2 }", False),
        ("c", "typedef struct { int a; } T;\nstatic int (*f)(T *, ...) = 0;\nint main(void) { T t = { .a = 1 }; for (int i = 0; i < 2; i++) t.a += (int)sizeof(T); return *(&t.a) ? 1 : 0; }\nchar *s = \"a\" \"b\";\n", True),
        ("c", "int f(int a) { return a + ; }\n", False),
        ("c", "package example.a;\n\npublic class A {\n}\n", False),
        ("rust", "impl<'a, T: Clone + 'a> A<T> for B<'a> where T: X { pub fn f(&mut self, x: Option<Vec<u8>>) -> Result<(), E> { if let Some(ref y) = x { for i in 0..3 { println!(\"{}\", i); } } match x { None => Ok(()), Some(v) if v.len() > 2 => { Err(E { a: 1 })? } _ => y.map(|z| z as i64 + 1), } } }", True),
        ("rust", "fn f() -> i64 { let x = ; x }", False),
    ],
)
def test_grammars(language, text, valid):
    assert Parsed(language, text).valid is valid


def test_time_is_linear_in_nesting():
    import time

    begin = time.perf_counter()
    assert Parsed("java", f"class A {{ int a = {'(' * 200}1{')' * 200}; }}").valid and Parsed("go", "package a\n\nvar x = " + "[]" * 2000 + "int{}\n").valid
    assert time.perf_counter() - begin < 5


def test_verdicts():
    assert syntax.verdict("go", "def f(a):\n    return a\n") == ("wrong_extension", "python")
    assert syntax.verdict("java", "class A {\n<<<<<<< HEAD\n int a;\n=======\n>>>>>>> x\n}") == ("merge_conflict", None)
    assert syntax.verdict("rust", "fn f( {") == ("corrupt", None) and syntax.verdict("json", "") == ("corrupt", None) and syntax.verdict("go", "") is None and syntax.verdict("text", "((") is None


def test_attribute_files():
    rules = lambda text: [dict(zip(("nth", "pattern", "mark", "on"), r)) for r in attributes.rules(text)]
    root = rules("# x\n*.pb.go linguist-generated\nvendor/** linguist-vendored=true\n/a/*.js linguist-generated\n**/gen/* -linguist-generated\n!b linguist-generated\n")
    deep = rules("x.pb.go -linguist-generated\nown/** !linguist-vendored\n")
    marks = lambda p: attributes.marked(p, [("", root)] + ([("vendor", deep)] if p.startswith("vendor/") else []))
    assert marks("a/b/c.pb.go") == {"linguist-generated"} and marks("vendor/z/y.go") == {"linguist-vendored"} and marks("a/x.js") == {"linguist-generated"} and marks("a/b/x.js") == set()
    assert marks("q/gen/x.pb.go") == set() and marks("vendor/x.pb.go") == {"linguist-vendored"} and marks("vendor/own/x.go") == set() and marks("b") == set()


def test_declared_and_mined_from_declarations(spark):
    files = [(10 * r + n, r, p, t) for r in (1, 2) for n, (p, t) in enumerate([(".gitattributes", "copied/** linguist-vendored\n"), *((f"copied/f{k}.go", "x") for k in range(4)), ("src/a.go", "x")])]
    f = spark.createDataFrame([*files, (31, 3, "copied/f.go", "x"), (32, None, "copied/g.go", None), (33, 3, None, "x")], "doc_id bigint, repo_id bigint, path string, content string")
    declared = attributes.declared(f)
    assert sorted(r.doc_id for r in declared.collect()) == [11, 12, 13, 14, 21, 22, 23, 24]
    own = f.where("repo_id < 3 and path not like '.git%'")
    assert [r.folder for r in mined(own.drop("content"), declared).collect()] == ["copied"]


def test_hmm_on_held_out_lines(spark):
    from codelens.corpus import files, table
    from codelens.llm.prose import fitted

    d = "/root/testdata/sf0.01"
    model = fitted(table(spark, d, "documents"), files(spark, d).where("language not in ('text', 'markdown') and content is not null"))
    lines = {"en": "Every reader waits for the oldest lease before the page is closed.", "de": "Jeder Leser wartet auf die älteste Marke bevor die Seite geschlossen wird.", "fr": "Chaque lecteur attend le plus ancien bail avant que la page ne soit fermée.", "es": "Cada lector espera la marca más antigua antes de que se cierre la página.", "ru": "Каждый читатель ждёт самую старую метку перед закрытием страницы.", "zh": "每个读取器都会等待最旧的标记，直到本页关闭为止。", "code": "for (int i = 0; i < n_items; i++) { push_back(x[i], y + 1); }"}
    for (name, line), states in zip(lines.items(), model.states(list(lines.values()))):
        assert hmm.STATES[np.bincount(states).argmax()] == name
    assert [len(s) for s in model.states(["", "a", "ab\ud83d" if False else "ab", "x" * 5000])] == [0, 1, 2, 5000]


def test_p9_recall_on_planted_stretches():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30, 70)))) for i in range(40)]
    block, hit = leaks.Items(items), 0
    for _ in range(200):
        i, text = rng.choice(items)
        words = text.split()
        need = max(20, -(-len(words) * 2 // 5))
        begin = rng.randrange(len(words) - need + 1)
        piece = words[begin : begin + need]
        at = rng.randrange(1, len(piece) - 1)
        piece = piece[:at] + (["changed"] if rng.random() < 0.5 else []) + piece[at + 1 :] if rng.random() < 0.7 else piece
        filler = [rng.choice(vocabulary) for _ in range(30)]
        hit += i in block.found(" ".join(filler + piece + filler[::-1]))
    assert hit >= 190


ODD = [None, "", " ", "\r\n", "x" * 200_000, "a\x00b", "\ufeff", "@" * 50, "😀" * 100, "-----BEGIN PRIVATE KEY-----"]


@pytest.mark.parametrize("name", ["p1_found", "p1_faults", "p1_rates", "p3_found", "p4_found", "p4_masked", "p5_found", "p6_shares", "p7_found", "p8_containers", "p9_found", "p10_found", "p10_masked"])
@pytest.mark.parametrize("rows", [0, 1])
def test_odd_rows_and_empty_tables(spark, tmp_path, name, rows):
    from datetime import datetime

    at = datetime(2024, 1, 1)
    langs = ["go", "python", "java", "javascript", "c", "rust", "json", "yaml", "text", None]
    files = [(10 * k + n, None if n % 3 else f"/r/{n}/a.{n}", None if n % 2 else f"a{n}.go", None if n % 4 else 1, langs[k], None, None, t, at if n % 2 else None, "clash") for k in range(10) for n, t in enumerate(ODD)]
    tables = {
        "source_files": (files + files[:5], "doc_id bigint, local_path string, path_in_repo string, repo_id bigint, language string, size_bytes bigint, n_lines int, content string, walked_at timestamp, text string"),
        "documents": ([(n, t, None if n % 2 else "en", "clash", 1) for n, t in enumerate(ODD)], "doc_id bigint, text string, lang string, content string, part int"),
        "repos": ([(1, "/r", None, None), (1, "/r", None, None), (None, None, "", None)], "repo_id bigint, local_path string, remote_url string, name string"),
        "license_texts": ([("A-1", "Alpha Terms", "Use is ruled by the Alpha Terms.", "Alpha Terms\n\n1. a b c d.")], "license_id string, title string, notice string, full_text string"),
        "eval_items": ([(1, "s", "one two"), (2, "s", None), (None, "s", "x")], "item_id bigint, suite string, text string"),
    }
    for table, (data, schema) in tables.items():
        spark.createDataFrame(data if rows or table == "license_texts" else [], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    got = e.queries()[name](spark, str(tmp_path)).collect()
    assert rows or not got
