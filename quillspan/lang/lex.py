"""One scanner for all dialects. Tokens carry offsets and together they make up the text.

The scanner looks at the character a token begins with and hands over to the reader for what that character can begin. What no reader
takes, an unclosed string or comment among it, is an operator of one character, so no text is refused and none is lost.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Token:
    kind: str  # space, comment, string, number, word, param, op, datalines
    text: str
    start: int
    line: int

    @property
    def end(self) -> int:
        return self.start + len(self.text)

    @property
    def low(self) -> str:
        return self.text.lower()


@dataclass(frozen=True)
class Dialect:
    """What differs between the dialects, by their language manuals."""

    quotes: str
    #: A backslash in a string takes the next character with it.
    escapes: bool
    #: A quote twice in a string is one quote.
    doubled: bool
    #: Operators of two characters.
    pairs: frozenset[str]
    #: What begins a comment that ends with its line.
    remark: str = ""
    #: A dollar begins a parameter or a field by place.
    dollars: bool = False
    #: A back quote begins a quoted name.
    quoted_names: bool = False
    #: Words behind which, and a semicolon, lines of data follow.
    data: frozenset[str] = frozenset()


DIALECTS = {
    "sas": Dialect("'\"", False, True, frozenset(("<=", ">=", "^=", "~=", "<>", "**", "||")), data=frozenset(("datalines", "cards"))),
    "pig": Dialect("'", True, False, frozenset(("==", "!=", "<=", ">=", "::")), remark="--", dollars=True),
    "hive": Dialect("'\"", True, True, frozenset(("!=", "<>", "<=", ">=", "||")), remark="--", quoted_names=True),
}
_BLANKS = frozenset(" \t\r\n\f")
_DIGITS = frozenset("0123456789")


def _name_start(c: str) -> bool:
    return c == "_" or (c.isascii() and c.isalpha())


def _name_part(c: str) -> bool:
    return c == "_" or c.isalnum()


class Scanner:
    """Reads one text; each reader returns the end of its token, or the place it began where it does not apply."""

    def __init__(self, text: str, dialect: Dialect):
        self.text, self.d, self.n = text, dialect, len(text)

    def tokens(self) -> list[Token]:
        out, at, line = [], 0, 1
        while at < self.n:
            kind, end = self.token(at)
            piece = self.text[at:end]
            out.append(Token(kind, piece, at, line))
            line += piece.count("\n")
            at = end
        return out

    def token(self, at: int) -> tuple[str, int]:
        c, d = self.text[at], self.d
        if c in _BLANKS:
            return "space", self.run(at, lambda x: x in _BLANKS)
        if _name_start(c):
            end = self.run(at, _name_part)
            if self.text[at:end].lower() in d.data and (last := self.data(end)) > end:
                return "datalines", last
            return "word", end
        if c in _DIGITS or (c == "." and self.char(at + 1) in _DIGITS):
            return "number", self.number(at)
        if c in d.quotes and (end := self.string(at)) > at:
            return "string", end
        if c == "/" and self.char(at + 1) == "*" and (end := self.text.find("*/", at + 2)) >= 0:
            return "comment", end + 2
        if d.remark and self.text.startswith(d.remark, at):
            end = self.text.find("\n", at)
            return "comment", self.n if end < 0 else end
        if d.dollars and c == "$" and (end := self.parameter(at)) > at:
            return "param", end
        if d.quoted_names and c == "`" and (end := self.text.find("`", at + 1)) > at + 1:
            return "word", end + 1
        return "op", at + (2 if self.text[at : at + 2] in d.pairs else 1)

    def char(self, at: int) -> str:
        return self.text[at] if at < self.n else ""

    def run(self, at: int, belongs) -> int:
        while at < self.n and belongs(self.text[at]):
            at += 1
        return at

    def digits(self, at: int) -> int:
        return self.run(at, _DIGITS.__contains__)

    def number(self, at: int) -> int:
        """Digits with a fraction and an exponent, or a fraction alone."""
        if self.text[at] == ".":
            return self.digits(at + 1)
        at = self.digits(at)
        if self.char(at) == "." and self.char(at + 1) in _DIGITS and self.char(at + 1):
            at = self.digits(at + 1)
        if self.char(at) in ("e", "E"):
            sign = at + 2 if self.char(at + 1) in ("+", "-") else at + 1
            end = self.digits(sign)
            if end > sign:
                return end
        return at

    def string(self, at: int) -> int:
        quote, end = self.text[at], at + 1
        while end < self.n:
            c = self.text[end]
            if c == "\\" and self.d.escapes:
                end += 2
            elif c != quote:
                end += 1
            elif self.d.doubled and self.char(end + 1) == quote:
                end += 2
            else:
                return end + 1
        return at

    def parameter(self, at: int) -> int:
        c = self.char(at + 1)
        if c and c in _DIGITS:
            return self.digits(at + 1)
        return self.run(at + 1, _name_part) if c and _name_start(c) else at

    def data(self, at: int) -> int:
        """The end of the data behind DATALINES: all lines up to the one that holds a semicolon, line by line."""
        semicolon = self.run(at, lambda x: x.isspace())
        if self.char(semicolon) != ";":
            return at
        end = semicolon + 1
        while True:
            stop = self.text.find("\n", end)
            if stop < 0:  # the last line: data unless it ends the data
                return end if ";" in self.text[end:] else self.n
            following = self.text.find("\n", stop + 1)
            if ";" in self.text[stop + 1 : self.n if following < 0 else following]:
                return stop
            end = stop + 1


def tokenize(text: str, dialect: str) -> list[Token]:
    return Scanner(text, DIALECTS[dialect]).tokens()


#: What a backslash makes of the letters behind it; it takes all other characters as they are.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def unquote(text: str, dialect: str) -> str:
    """The value of a string token."""
    d = DIALECTS[dialect]
    quote, body, out, i = text[0], text[1:-1], [], 0
    while i < len(body):
        c = body[i]
        if c == quote and d.doubled and body[i + 1 : i + 2] == quote:
            i += 1
        elif c == "\\" and d.escapes and i + 1 < len(body):
            i += 1
            c = ESCAPES.get(body[i], body[i])
        out.append(c)
        i += 1
    return "".join(out)
