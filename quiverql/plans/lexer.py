"""Query text to tokens."""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from ..errors import QueryError, QueryLimitError

MOST_CHARACTERS, MOST_TOKENS, MOST_DIGITS = 16_000, 4_000, 128
#: The symbols of the language; a longer one wins over one that it starts with.
SYMBOLS = "-> <- <= >= <> != .. ( ) [ ] { } , . : ; | + * / % < > = -".split()
#: What a backslash in a string may stand before, and what both stand for.
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "\\": "\\", "'": "'", '"': '"'}

BLANK = re.compile(r"(?:\s|//[^\n]*|/\*(?s:.*?)\*/)+")
WORD = re.compile(r"[A-Za-z_]\w*")
NUMBER = re.compile(r"\d+(?P<fraction>\.\d+)?(?P<power>[eE][+-]?\d+)?")
SYMBOL = re.compile("|".join(map(re.escape, SYMBOLS)))


class Token(NamedTuple):
    """kind is word, quoted, string, number, parameter, symbol or end; text of the query from at to end."""

    kind: str
    value: object
    at: int
    end: int

    @property
    def key(self) -> str:
        """How a keyword or symbol is compared; nothing for other tokens."""
        return str(self.value).upper() if self.kind in ("word", "symbol") else ""


def tokens(text: str) -> list[Token]:
    if not isinstance(text, str) or not text.strip():
        raise QueryError("There is no query.")
    if len(text) > MOST_CHARACTERS:
        raise QueryLimitError(f"A query may have {MOST_CHARACTERS:,} characters.")
    out: list[Token] = []
    at = 0
    while True:
        if blank := BLANK.match(text, at):
            at = blank.end()
        if at == len(text):
            return [*out, Token("end", "", at, at)]
        out.append(one(text, at))
        at = out[-1].end
        if len(out) > MOST_TOKENS:
            raise QueryLimitError(f"A query may have {MOST_TOKENS:,} tokens.")


def one(text: str, at: int) -> Token:
    """The token that starts there."""
    if text[at] in "'\"`":
        return quoted(text, at)
    if found := WORD.match(text, at):
        return Token("word", found[0], at, found.end())
    if found := NUMBER.match(text, at):
        return Token("number", number(found, at), at, found.end())
    if text[at] == "$" and (found := WORD.match(text, at + 1)):
        return Token("parameter", found[0], at, found.end())
    if found := SYMBOL.match(text, at):
        return Token("symbol", found[0], at, found.end())
    raise QueryError(f"{text[at]!r} has no meaning here.", at)


def number(found: re.Match, at: int) -> int | float:
    if len(found[0]) > MOST_DIGITS:
        raise QueryError(f"A number may have {MOST_DIGITS} characters.", at)
    if not (found["fraction"] or found["power"]):
        return int(found[0])
    value = float(found[0])
    if math.isinf(value):
        raise QueryError("The number is not finite.", at)
    return value


def quoted(text: str, at: int) -> Token:
    """A string, or a name in backticks; the doubled quote stands for one, and only strings have escapes."""
    quote, out, here = text[at], [], at + 1
    while here < len(text):
        c = text[here]
        if c == quote and text[here + 1 : here + 2] != quote:
            return Token("quoted" if quote == "`" else "string", "".join(out), at, here + 1)
        if c == quote:
            here += 1
        elif c == "\\" and quote != "`":
            here += 1
            if here == len(text):
                break
            if text[here] not in ESCAPES:
                raise QueryError(f"\\{text[here]} is no escape.", here - 1)
            c = ESCAPES[text[here]]
        out.append(c)
        here += 1
    raise QueryError("A quote is not closed.", at)
