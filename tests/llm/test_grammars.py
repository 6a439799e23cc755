"""Valid and invalid pieces that the grammars of rust and javascript once took wrongly, or must go on taking rightly."""

import pytest
from codelens.llm.grammars import Parsed


@pytest.mark.parametrize(
    "language,text,valid",
    [
        ("rust", "fn f() { if let Some(ref y) = x { } while let Some((a, b)) = it.next() { } let Some(z) = x else { return }; }", True),
        ("rust", "fn f() { match x { 1..=5 => 2, A::B..=A::C => 3, A::B(x, _) | A::D { y, .. } => 1, -1 => 2, N...M => 2, N => 1, \"s\" => 3, true => 4, a @ 1..=3 => 2, _ => 0, } }", True),
        ("rust", "fn f() { match x { Some(v => 1, } }", False),
        ("rust", "fn f() { let Some(a b) = x; }", False),
        ("javascript", "f = async (a) => { await g`x`; return tag`a``b${1}` }", True),
        ("javascript", "function f(a) { return /a[/]b/.test(a) }\nconst g = x => /\"/.test(x)", True),
        ("javascript", "switch (a) { case /[/]/.test(b): x }", True),
        ("javascript", "const inn = 4 / 2 / 1, y = o.return / 2 / 1", True),
        ("javascript", "import `a`", False),
        ("javascript", "x = {`a`: 1}", False),
    ],
)
def test_valid(language, text, valid):
    assert Parsed(language, text).valid is valid
