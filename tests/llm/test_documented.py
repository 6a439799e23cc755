"""Problem 7: what is passed over changes nothing."""

import ast
import random
import re

import pytest
from codelens.llm import grammars, peg, prose

TEXTS = {
    "go": "package a\n\n// The reader counts the remaining spans here.\nfunc (t *T) F(a, b int) (int, error) {\n\tif x := f(); x != nil {\n\t\treturn T{a: 1}.b, nil\n\t}\n\tfor i := range xs {\n\t\tgo func() {}()\n\t}\n\treturn 0, nil\n}\n",
    "java": "class A<T> { int[] a = {1, 2}; List<Map<U, int[]>> f(final U u) throws E { for (var x : xs) x.f(y -> y + 1); return (T) g(A::new); } }",
    "javascript": "const f = async ({a, b = 1}, ...c) => { return {a, [b]: 1, get x() { return 1 }} };\nclass A extends B { static #p = 1; *g() { yield 1 } }\nexport default f",
    "c": "typedef struct { int a; } T;\nint main(void) { T t = { .a = 1 }; for (int i = 0; i < 2; i++) t.a += (int)sizeof(T); return *(&t.a) ? 1 : 0; }\n",
    "rust": "impl<'a> A<T> for B<'a> where T: X { pub fn f(&mut self, x: Option<Vec<u8>>) -> Result<(), E> { for i in 0..3 { g(i); } match x { None => Ok(()), _ => y.map(|z| z as i64 + 1), } } }",
}


def interpreted(rules, kinds, texts):
    """The end of what the first rule matches, by going through every part of every choice."""
    kinds, texts, memo = [*kinds, "EOF", "EOF"], [*texts, "", ""], {}  # all on one line

    def many(e, p):
        while (q := at(e, p)) > p:
            p = q
        return p

    def at(e, p):
        kind, x = e
        if kind in ("lit", "text"):
            return p + 1 if (kinds if kind == "lit" else texts)[p] == x else -1
        if kind == "name" and x in rules:
            if (x, p) not in memo:
                memo[x, p] = at(rules[x][1], p)
            return memo[x, p]
        if kind == "name":
            if x == "NL":
                return -1
            return p + 1 if (kinds[p] not in peg.BRACKETS and kinds[p] != "EOF" if x == "ANY" else kinds[p] == x.lstrip("@")) else -1
        if kind == "seq":
            for part in x:
                if (p := at(part, p)) < 0:
                    return -1
            return p
        if kind == "choice":
            return next((q for part in x if (q := at(part, p)) >= 0), -1)
        if kind in ("and", "not"):
            return p if (at(x, p) >= 0) == (kind == "and") else -1
        q = at(x, p)
        return (p if kind != "plus" else -1) if q < 0 else q if kind == "opt" else many(x, q) if q > p else q

    return at(("name", next(iter(rules))), 0)


@pytest.mark.parametrize("language", TEXTS)
def test_parsers_agree_with_the_grammar_read_part_by_part(language, monkeypatch):
    rng, rules = random.Random(7), peg._Reader(grammars.SOURCES[language]).rules()
    seen = {}
    monkeypatch.setattr(peg.Grammar, "parse", lambda self, kinds, texts, breaks: seen.update(kinds=kinds, texts=texts))
    grammars.Parsed(language, TEXTS[language])
    monkeypatch.undo()
    for n in range(60):
        order = list(range(len(seen["kinds"])))
        for _ in range(min(n, 2)):
            i, j = rng.randrange(len(order)), rng.randrange(len(order))
            order[i : i + 1] = rng.choice(([], [order[j]], [order[i], order[j]]))
        kinds, texts = [seen["kinds"][k] for k in order], [seen["texts"][k] for k in order]
        got = grammars.grammar(language).parse(kinds, texts, [False] * len(kinds))
        assert (got is not None) == (interpreted(rules, kinds, texts) == len(kinds)), texts
        assert n or got is not None


def test_rules_are_not_tried_where_they_cannot_begin():
    assert grammars.Parsed("java", TEXTS["java"]).valid
    space = grammars.grammar("java").space
    assert not space["M_try"] and not space["M_switch"] and not space["M_interface"] and len(space["M_for"]) == 1


def test_files_without_what_could_document_are_not_parsed(monkeypatch):
    monkeypatch.setattr(prose, "Parsed", lambda *_: 1 / 0)
    for text in ("package a\n\nfunc f() {}\n", "// short\nfunc f() {}\n", "// The reader counts the remaining spans here.\n\nfunc f() {}\n"):
        assert prose.documented("go", text) == set()
    with pytest.raises(ZeroDivisionError):
        prose.documented("go", "// The reader counts\n// the remaining spans.\nfunc f() {}\n")


def test_documented_in_every_language():
    said, want = "The reader counts the remaining spans here.", {("f", 2)}
    for language, text in {"go": "//{}\nfunc f() {{}}\n", "c": "/*{}*/\nint f(void) {{ return 1; }}\n", "rust": "///{}\nfn f() {{}}\n", "javascript": "//{}\nfunction f() {{}}\n", "python": "#{}\ndef f(): pass\n"}.items():
        assert prose.documented(language, ("package a\n" if language == "go" else "") + text.format(said)) == ({("f", 3)} if language == "go" else want)
        assert prose.documented(language, ("package a\n" if language == "go" else "") + text.format(said) + "(") == set()


def test_all_functions_are_found():
    text = "def a():\n if x:\n  def b(): pass\n else:\n  class C:\n   async def d(self): pass\ntry:\n def e(): pass\nexcept X:\n def f(): pass\nelse:\n def g(): pass\nfinally:\n def h(): pass\nfor i in x:\n def j(): pass\nelse:\n def k(): pass\nmatch x:\n case 1:\n  def m(): pass\nwith x: \n async def n(): return lambda: 1\nwhile x:\n def o(): pass\n"
    tree = ast.parse(text)
    assert sorted(n.name for n in prose.functions(tree)) == sorted(n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))) == list("abdefghjkmno")


def test_lines_are_left_out_whatever_the_case():
    rng = random.Random(8)
    words = re.findall(r"[A-Za-z@:-]+|\W", " ".join((prose.NOTICE.pattern, prose.TOOL.pattern)))
    for _ in range(3000):
        line = "".join(rng.choice((str.upper, str.lower, str.title))(rng.choice((*words, " ", " do not edit", "generated by"))) for _ in range(rng.randrange(1, 8)))
        assert prose.notice(line) == bool(prose.NOTICE.search(line))
        if not (prose.TAG.match(line) or prose.SQL.match(line) or prose.COMMAND.match(line) or prose.CODE.search(line)):
            assert prose.left_out(line) == bool(prose.TOOL.search(line) or prose.NOTICE.search(line)), line
