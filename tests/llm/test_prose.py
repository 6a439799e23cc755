"""Problem 6: what is done once, and that it finds what doing it for every line would."""

import random

import numpy as np
from codelens.llm import grammars, hmm, prose, syntax
from codelens.llm.source import tokens


def model():
    rng = random.Random(5)
    letters = dict(zip(hmm.STATES, ["(){};=_.", "abcdef ", "读写页面", "ghiäöü ", "jklñ ", "mnoéè ", "абвгд ", "かきくけ"]))
    return hmm.Model({s: ["".join(rng.choice(x) for _ in range(400))] for s, x in letters.items()}), letters


def test_states_are_those_of_the_likeliest_way():
    m, letters = model()
    rng = random.Random(6)
    texts = ["", "(", "\n\na", "".join(letters.values())] + ["".join(rng.choice("".join(rng.sample(list(letters.values()), 2))) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    for text, got in zip(texts, m.states(texts)):
        e = m.emissions(text)
        score, ways = e[:1].copy(), []
        for row in e[1:]:
            top = score[-1].argmax()
            moved = score[-1] < score[-1][top] - np.float32(hmm.SWITCH)
            ways.append(np.where(moved, top, range(len(hmm.STATES))))
            score = np.vstack([score, np.maximum(score[-1], score[-1][top] - np.float32(hmm.SWITCH)) + row])
        want = [int(score[-1].argmax())] if text else []
        for way in reversed(ways):
            want.append(int(way[want[-1]]))
        assert got.tolist() == want[::-1]


def test_emissions_are_reckoned_once_for_each_three_characters():
    codes, table = model()[0].emitted(["abcabcabc" * 50, "", "abc"])
    assert len(codes) == 453 and len(table) == 5  # a and b as a text begins, and abc, bca, cab


def test_text_is_split_into_tokens_once(monkeypatch):
    text = "package a\n\n// The merge step keeps nested groups once.\nfunc f() {}\n"
    toks = tokens("go", text)
    monkeypatch.setattr(grammars, "tokens", lambda *_: 1 / 0)
    assert prose.places_of_prose(text, toks) and syntax.valid("go", text, toks)


def test_lines_are_looked_at_only_for_languages_not_yet_found(monkeypatch):
    lines = ["# The merge step keeps the nested groups at once.\n"] * 300 + ["# Der Leser prüft die Seite noch nicht.\n"]
    text = "".join(lines)
    states = np.repeat([hmm.STATES.index("en"), hmm.STATES.index("de")], [len(text) - len(lines[-1]), len(lines[-1])]).astype(np.uint8)
    looked, at = [], prose.languages_at
    monkeypatch.setattr(prose, "languages_at", lambda *a: looked.append(a) or at(*a))
    assert prose.nl_languages(prose.places_of_prose(text, tokens("python", text)), states) == {"en", "de"} and len(looked) == 2


def test_room_is_never_denied_to_a_sentence():
    for line in ("one-two three`x`four five sixA seven", "每个读取器会丢弃上", "a b c d e", "x1y2z3a4b"):
        assert prose.ROOM.match(line)
    for line in ("a b c d", "foo-bar_baz(1, 2) = 3", "每个读取器会丢", "_" * 100_000, ""):
        assert not prose.ROOM.match(line)
