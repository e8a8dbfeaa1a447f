"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import ParseError

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*)
      |(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
      |(?P<string>'(?:[^']|'')*')
      |(?P<quoted>"(?:[^"]|"")*"|`[^`]*`)
      |(?P<name>[A-Za-z_][A-Za-z_0-9]*)
      |(?P<op><=|>=|<>|!=|==|[-+*/%<>=(),.;])""",
    re.X,
)


@dataclass(frozen=True)
class Token:
    kind: str  # number, string, name, quoted, op or end
    text: str
    at: int

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else ""


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return [*out, Token("end", "", at)]


def statements(text: str) -> list[str]:
    """The texts between semicolons outside of strings; empty ones are left out."""
    out, start = [], 0
    for t in tokens(text):
        if t.kind == "end" or t.text == ";" and t.kind == "op":
            if text[start : t.at].strip():
                out.append(text[start : t.at].strip())
            start = t.at + 1
    return out
