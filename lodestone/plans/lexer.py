"""T-SQL tokens."""

from __future__ import annotations

import re
from typing import NamedTuple

from .errors import syntax


class Token(NamedTuple):
    kind: str  #: word, quoted, var, str, num, bin, op, end
    text: str
    line: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


_RULES = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<str>[Nn]?'(?:[^']|'')*')
    |(?P<bin>0[xX][0-9a-fA-F]*)
    |(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<quoted>\[(?:[^\]]|\]\])*\]|"(?:[^"]|"")*")
    |(?P<var>@@?[\w$#@]+)
    |(?P<word>[^\W\d][\w$#@]*|\#\#?\w+)
    |(?P<op><=|>=|<>|!=|!<|!>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|::|[-+*/%&|^~=<>(),.;:?{}])""",
    re.X | re.S,
)


def tokenize(text: str) -> list[Token]:
    out, at, line = [], 0, 1
    while at < len(text):
        m = _RULES.match(text, at)
        if not m:
            raise syntax(text[at], line)
        kind, raw = m.lastgroup, m.group()
        if kind == "str":
            raw = raw[raw.index("'") + 1 : -1].replace("''", "'")
        elif kind == "quoted":
            raw = raw[1:-1].replace(raw[-1] * 2, raw[-1])
        if kind != "space":
            out.append(Token(kind, raw, line))
        line += m.group().count("\n")
        at = m.end()
    out.append(Token("end", "", line))
    return out
