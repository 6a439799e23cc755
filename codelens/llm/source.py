"""Tokens of source text: comments, strings, words, numbers and signs with their places."""

from __future__ import annotations

import re

LINE = r"//[^\n]*"
BLOCK = r"/\*(?:[^*]|\*(?!/))*\*/"
DOUBLE, SINGLE = r'"(?:\\[\s\S]|[^"\\\n])*"', r"'(?:\\[\s\S]|[^'\\\n])*'"
NUMBER = r"(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.(?!\.)[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)(?:[uUlLfFdDnij]|[iu](?:8|16|32|64|128|size)|f32|f64)*(?![A-Za-z\d_])"
WORD = r"[A-Za-z_$\u0080-\U0010ffff][\w$]*"
SIGNS = r">>>=|<<=|>>=|\.\.\.|===|!==|\*\*=|&&=|\|\|=|\?\?=|&\^=|\.\.=|->|=>|::|:=|<-|\+\+|--|&&|\|\||\?\?|\?\.|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|\.\.|[-+*/%=<>!&|^~?:;,.(){}\[\]@#]"

STRINGS = {
    "go": rf"`[^`]*`|{DOUBLE}|'(?:\\.[^'\n]*|[^'\\\n])'",
    "java": rf'"""(?:\\[\s\S]|(?!""")[^\\])*"""|{DOUBLE}|\'(?:\\[^\n][^\'\n]*|[^\'\\\n])\'',
    "javascript": rf"`(?:\\[\s\S]|[^`\\])*`|{DOUBLE}|{SINGLE}",
    "c": rf"(?:L|u8|u|U)?{DOUBLE}|'(?:\\.[^'\n]*|[^'\\\n])+'",
    "rust": rf"b?r(#*)\"[\s\S]*?\"\1|b?\"(?:\\[\s\S]|[^\"\\])*\"|b?'(?:\\[^\n][^'\n]*|[^'\\\n])'",
    "python": rf"(?:[rRbBuUfF]{{0,2}})(?:\"\"\"(?:\\[\s\S]|(?!\"\"\")[^\\])*\"\"\"|'''(?:\\[\s\S]|(?!''')[^\\])*'''|{DOUBLE}|{SINGLE})",
    "json": DOUBLE,
    "yaml": r"\"(?:\\[\s\S]|[^\"\\])*\"|(?<![\w)])'(?:''|[^'])*'",
}
#: Words that an expression follows, so that a slash after them begins a pattern.
BEFORE_EXPRESSIONS = "return typeof case delete void throw new else do in of instanceof await yield".split()
AFTER = "|".join([r"(?<=[=(,:;!&|?{}\[])", "(?<==>)", *(rf"(?<=(?<![\w$.]){w})" for w in BEFORE_EXPRESSIONS)])
REGEX = rf"(?P<regex>(?<!\s)(?=\s*+/)(?:{AFTER})\s*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)"


def _lexer(language: str) -> re.Pattern:
    if language in ("python", "yaml"):
        comment = r"#[^\n]*" if language == "python" else r"(?:(?<=[\s])|^)#[^\n]*"
    else:
        comment = f"{LINE}|{BLOCK}"
    parts = [f"(?P<comment>{comment})"]
    strings = STRINGS[language].replace("(#*)", "(?P<hashes>#*)").replace(r"\1", "(?P=hashes)")
    parts.append(f"(?P<string>{strings})")
    if language == "javascript":
        parts.append(REGEX)
    if language == "rust":
        parts.append(r"(?P<life>'[A-Za-z_]\w*)")
    if language == "c":
        parts.append(r"(?P<pre>^[ \t]*\#(?:[^\n\\]|\\[\s\S])*)")
    parts += [f"(?P<number>{NUMBER})", f"(?P<word>{WORD})", f"(?P<sign>{SIGNS})", r"(?P<bad>[^\s\\])"]
    return re.compile("|".join(parts), re.M)


LEXERS = {language: _lexer(language) for language in STRINGS}


def tokens(language: str, text: str) -> list[tuple[str, str, int]]:
    """(kind, text, start); kinds comment, string, number, word, sign, regex, life, pre, bad."""
    return [(m.lastgroup if m.lastgroup != "hashes" else "string", m[0], m.start()) for m in LEXERS[language].finditer(text)]
