"""Packrat parsers from parsing-expression grammars over tokens.

A grammar is text:  rule = expression ;  with / for ordered choice, ? * + & ! and brackets.
'x' is a sign or reserved word, "x" any token of that text, an upper-case name a kind of
token, ANY any token but a bracket, NL (no token) that a line end stands before the next
token, EOF the end. @ID keeps the token as the name of what the rule defines; a rule written
rule := ... defines something, and is noted where it matches. Every rule keeps its result by
place, so that time is linear in the tokens. A grammar becomes Python functions, one a rule."""

from __future__ import annotations

import re
from itertools import count

TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<def>[a-z_]\w*)\s*(?P<eq>:?=)(?!=)|(?P<lit>'[^']+')|(?P<text>"[^"]+")|(?P<name>@?[A-Za-z_]\w*)|(?P<op>[/()?*+&!;])""")
BRACKETS = frozenset("()[]{}")


class _Reader:
    def __init__(self, text: str):
        self.toks = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"grammar: {text[at : at + 40]!r}")
            at = m.end()
            if m["def"]:
                self.toks.append(("def", m["def"], m["eq"] == ":="))
            elif m.lastgroup:
                self.toks.append((m.lastgroup, m[m.lastgroup]))
        self.i = 0

    def peek(self) -> tuple:
        return self.toks[self.i] if self.i < len(self.toks) else ("end", "")

    def take(self) -> tuple:
        self.i += 1
        return self.toks[self.i - 1]

    def rules(self) -> dict:
        out = {}
        while self.peek()[0] == "def":
            _, name, notes = self.take()
            out[name] = (notes, self.choice())
            if self.take() != ("op", ";"):
                raise ValueError(f"grammar: rule {name}")
        if self.peek()[0] != "end":
            raise ValueError(f"grammar: {self.peek()}")
        return out

    def choice(self):
        parts = [self.sequence()]
        while self.peek() == ("op", "/"):
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("choice", parts)

    def sequence(self):
        parts = []
        while self.peek()[0] in ("lit", "text", "name") or self.peek() in (("op", "("), ("op", "&"), ("op", "!")):
            parts.append(self.prefixed())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def prefixed(self):
        if self.peek() in (("op", "&"), ("op", "!")):
            return ("and" if self.take()[1] == "&" else "not", self.prefixed())
        kind, text = self.take()
        if kind == "op":
            e = self.choice()
            self.take()
        else:
            e = (kind, text if kind == "name" else text[1:-1])
        while self.peek() in (("op", "?"), ("op", "*"), ("op", "+")):
            e = ({"?": "opt", "*": "star", "+": "plus"}[self.take()[1]], e)
        return e


class _Begins:
    """Kinds of tokens that expressions may begin with: (kinds, None if any; whether nothing is a match as well)."""

    def __init__(self, rules: dict):
        self.rules = rules
        self.of: dict[str, tuple] = {name: (frozenset(), False) for name in rules}
        while any([self._set(name, e) for name, (_, e) in rules.items()]):
            pass

    def _set(self, name: str, e: tuple) -> bool:
        old, self.of[name] = self.of[name], self(e)
        return old != self.of[name]

    def __call__(self, e: tuple) -> tuple:
        kind = e[0]
        if kind == "lit":
            return frozenset((e[1],)), False
        if kind == "text":
            return (frozenset(("ID", e[1])) if e[1].isidentifier() else None), False
        if kind == "name" and e[1] in self.of:
            return self.of[e[1]]
        if kind == "name":
            return (None, False) if e[1] == "ANY" else (frozenset(), True) if e[1] == "NL" else (frozenset((e[1].lstrip("@"),)), False)
        if kind == "choice":
            parts = [self(x) for x in e[1]]
            return (None if any(k is None for k, _ in parts) else frozenset().union(*(k for k, _ in parts))), any(n for _, n in parts)
        if kind == "seq":
            kinds: frozenset | None = frozenset()
            for x in e[1]:
                more, empty = self(x)
                kinds = None if kinds is None or more is None else kinds | more
                if not empty:
                    return kinds, False
            return kinds, True
        if kind in ("and", "not"):
            return frozenset(), True
        kinds, empty = self(e[1])
        return kinds, empty or kind != "plus"


class _Writer:
    """Writes rules as Python. What cannot begin with the token at hand is passed over, which changes no result."""

    def __init__(self, rules: dict):
        self.rules, self.begins = rules, _Begins(rules)
        #: Names that the code needs: sets of kinds by rule, and which of a choice's parts a kind may begin.
        self.space: dict = {f"B_{name}": kinds for name, (kinds, empty) in self.begins.of.items() if kinds is not None and not empty}

    def write(self, e: tuple, a: str, out: str, pad: str, lines: list[str], fresh, begun: bool = False) -> None:
        """Code that sets out to the place after e at a, or to -1. begun: that the token at a may begin e is known."""
        kind = e[0]
        if kind == "name" and e[1] in self.rules and not self.rules[e[1]][0] and self.is_signs(self.rules[e[1]][1]):
            e = self.rules[e[1]][1]
            kind = e[0]
        if kind == "lit" or kind == "name" and e[1][0] != "@" and e[1].isupper() and e[1] not in ("NL", "ANY"):
            lines.append(f"{pad}{out} = {a} + 1 if K[{a}] == {e[1]!r} else -1")
        elif kind == "text":
            lines.append(f"{pad}{out} = {a} + 1 if T[{a}] == {e[1]!r} else -1")
        elif kind == "name" and e[1] == "NL":
            lines.append(f"{pad}{out} = {a} if L[{a}] else -1")
        elif kind == "name" and e[1] == "ANY":
            lines.append(f"{pad}{out} = {a} + 1 if K[{a}] not in BRACKETS and K[{a}] != 'EOF' else -1")
        elif kind == "name" and e[1][0] == "@":
            lines.append(f"{pad}{out} = {a} + 1 if K[{a}] == {e[1][1:]!r} else -1")
            lines.append(f"{pad}name = {a}")
        elif kind == "name":
            guard = f" if K[{a}] in B_{e[1]} else -1" if f"B_{e[1]}" in self.space and not begun else ""
            lines.append(f"{pad}{out} = {e[1]}_({a}){guard}")
        elif kind == "seq":
            lines.append(f"{pad}{out} = -1")
            at = a
            for n, part in enumerate(e[1]):
                v = out if n == len(e[1]) - 1 else f"v{next(fresh)}"
                self.write(part, at, v, pad, lines, fresh, begun and not n)
                if v != out:
                    lines.append(f"{pad}if {v} >= 0:")
                    pad += " "
                at = v
            if not e[1]:
                lines.append(f"{pad}{out} = {a}")
        elif kind == "choice":
            if self.is_signs(e):
                lines.append(f"{pad}{out} = {a} + 1 if K[{a}] in {{{', '.join(repr(p[1]) for p in e[1])}}} else -1")
            else:
                self.choice(e[1], a, out, pad, lines, fresh)
        elif kind == "opt":
            v = f"v{next(fresh)}"
            self.write(e[1], a, v, pad, lines, fresh)
            lines.append(f"{pad}{out} = {v} if {v} >= 0 else {a}")
        elif kind in ("star", "plus"):
            at, v = f"v{next(fresh)}", f"v{next(fresh)}"
            if kind == "plus":
                self.write(e[1], a, at, pad, lines, fresh)
                lines.append(f"{pad}while {at} >= 0:")
            else:
                lines.append(f"{pad}{at} = {a}")
                lines.append(f"{pad}while True:")
            self.write(e[1], at, v, pad + " ", lines, fresh)
            lines += [f"{pad} if {v} <= {at}: break", f"{pad} {at} = {v}", f"{pad}{out} = {at}"]
        else:
            v = f"v{next(fresh)}"
            self.write(e[1], a, v, pad, lines, fresh)
            lines.append(f"{pad}{out} = {a} if {v} {'>=' if kind == 'and' else '<'} 0 else -1")

    @staticmethod
    def is_signs(e: tuple) -> bool:
        return e[0] == "choice" and all(p[0] == "lit" for p in e[1])

    def choice(self, parts: list[tuple], a: str, out: str, pad: str, lines: list[str], fresh) -> None:
        begins = [self.begins(p) for p in parts]
        always = sum(1 << n for n, (kinds, empty) in enumerate(begins) if kinds is None or empty)
        named = {k for kinds, _ in begins for k in kinds or ()}
        may = {k: always | sum(1 << n for n, (kinds, _) in enumerate(begins) if kinds is not None and k in kinds) for k in named}
        table, m = f"C{len(self.space)}", f"v{next(fresh)}"
        self.space[table] = may.get
        lines += [f"{pad}{m} = {table}(K[{a}], {always})", f"{pad}{out} = -1"]

        def halves(low: int, high: int, pad: str) -> None:
            if high - low == 1:
                self.write(parts[low], a, out, pad, lines, fresh, not always >> low & 1)
                return
            middle = (low + high) // 2
            for x, y in ((low, middle), (middle, high)):
                lines.append(f"{pad}if {f'{out} < 0 and ' if x > 0 else ''}{m} & {(1 << y) - (1 << x)}:")
                halves(x, y, pad + " ")

        halves(0, len(parts), pad)


class Grammar:
    def __init__(self, text: str):
        rules = _Reader(text).rules()
        self.start = next(iter(rules))
        writer = _Writer(rules)
        lines = ["K = T = L = None", "NOTES = []", "MEMOS = []"]
        for name, (notes, e) in rules.items():
            body: list[str] = []
            writer.write(e, "p", "out", " ", body, count())
            lines += [f"M_{name} = {{}}", f"MEMOS.append(M_{name})", f"def {name}_(p):", f" out = M_{name}.get(p)", " if out is not None: return out", *body]
            if notes:
                lines.append(f" if out >= 0: NOTES.append((p, name, out, {name!r}))")
            lines += [f" M_{name}[p] = out", " return out"]
        self.space: dict = {"BRACKETS": BRACKETS, **writer.space}
        exec("\n".join(lines), self.space)
        self.rules = set(rules)

    def parse(self, kinds: list[str], texts: list[str], breaks: list[bool]) -> list[tuple[int, int, int, str]] | None:
        """What was defined, as (first token, token of the name, token after, rule); None if the tokens are not of the language.

        A text nested deeper than Python's stack allows is not either."""
        s = self.space
        for m in s["MEMOS"]:
            m.clear()
        s["NOTES"].clear()
        s["K"], s["T"], s["L"] = [*kinds, "EOF", "EOF"], [*texts, "", ""], [*breaks, True, True]
        try:
            end = s[f"{self.start}_"](0)
        except RecursionError:
            return None
        return list(dict.fromkeys(s["NOTES"])) if end == len(kinds) else None
