"""The macro language, read without executing anything: definitions, %LET values, calls, includes.

Works on the tokens of the text, so nothing inside a comment or a single-quoted string is a call; in double-quoted strings only values
are put in. A call is replaced by the macro's body with its arguments, and that text is read again one level deeper.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import NamedTuple

from quillspan.lang.lex import Token, tokenize, unquote
from quillspan.lang.scan import Block, split_blocks

#: How many calls of a text are expanded, how deep they nest, and how deep includes nest. A text that reaches them says so.
EXPANSIONS, DEPTH, INCLUDE_DEPTH = 50, 5, 5


@dataclass
class Macro:
    name: str
    params: list[tuple[str, str | None]]
    body: str

    @property
    def of_steps(self) -> bool:
        """Whether the body holds whole steps, so that a call makes blocks of its own."""
        return any(b.kind != "libname" for b in split_blocks(self.body))


class Expanded(NamedTuple):
    """A text with its macros put in; the calls made (name, arguments); whether calls were left because a limit was reached."""

    text: str
    calls: list[tuple[str, dict]]
    cut: bool


def _text(toks: Iterable[Token]) -> str:
    return "".join(t.text for t in toks)


def _after_sign(toks: list[Token], i: int) -> str:
    """The name right behind a sign, in lower case; empty where there is none."""
    return toks[i + 1].low if i + 1 < len(toks) and toks[i + 1].kind == "word" else ""


def _skip_space(toks: list[Token], i: int) -> int:
    while i < len(toks) and toks[i].kind in ("space", "comment"):
        i += 1
    return i


def _brackets(toks: list[Token], i: int) -> tuple[list[list[Token]], int]:
    """The tokens between commas inside the brackets that begin at i, and the place behind them; nothing where none begin."""
    at = _skip_space(toks, i)
    if at == len(toks) or toks[at].text != "(":
        return [], i
    parts, depth, at = [[]], 1, at + 1
    while at < len(toks):
        t = toks[at]
        depth += (t.text == "(") - (t.text == ")")
        at += 1
        if not depth:
            return (parts if any(_text(p).strip() for p in parts) else []), at
        if t.text == "," and depth == 1:
            parts.append([])
        else:
            parts[-1].append(t)
    return [], i  # never closed: no arguments


def split_args(text: str) -> list[str]:
    """Arguments at commas outside brackets and strings."""
    return [_text(p).strip() for p in _brackets(tokenize(f"({text})", "sas"), 0)[0]]


def _keyword(part: list[Token]) -> tuple[str, str | None]:
    """``name=value`` as name and value; any other text as itself and no value."""
    at = _skip_space(part, 0)
    if at < len(part) and part[at].kind == "word":
        sign = _skip_space(part, at + 1)
        if sign < len(part) and part[sign].text == "=":
            return part[at].low, _text(part[sign + 1 :]).strip()
    return _text(part).strip(), None


def macros(text: str) -> tuple[dict[str, Macro], str]:
    """Macro definitions by lower-case name, and the text without them. A definition inside another stays in its body."""
    toks, rest, found, i = tokenize(text, "sas"), [], {}, 0
    while i < len(toks):
        if toks[i].text != "%" or _after_sign(toks, i) != "macro":
            rest.append(toks[i])
            i += 1
            continue
        at = _skip_space(toks, i + 2)
        name = toks[at].low if at < len(toks) and toks[at].kind == "word" else ""
        args, at = _brackets(toks, at + 1)
        while at < len(toks) and toks[at].text != ";":
            at += 1
        start = end = at + 1
        depth = 1
        while end < len(toks):
            word = _after_sign(toks, end) if toks[end].text == "%" else ""
            depth += (word == "macro") - (word == "mend")
            if not depth:
                break
            end += 1
        if not name or end >= len(toks):  # no name or no end: no definition
            rest.append(toks[i])
            i += 1
            continue
        params = []
        for part in args:
            key, value = _keyword(part)
            params.append((key.lower(), value))
        found[name] = Macro(name, params, _text(toks[start:end]))
        i = end
        while i < len(toks) and toks[i].text != ";":
            i += 1
        i += 1
    return found, _text(rest)


def bind(macro: Macro, args: list[list[Token]]) -> dict[str, str]:
    """Values of the parameters of a call. One that has neither an argument nor a default has no value."""
    values = {p: d for p, d in macro.params if d is not None}
    places = iter([p for p, _ in macro.params])
    for part in args:
        key, value = _keyword(part)
        if value is not None and key in dict(macro.params):
            values[key] = value
        elif (place := next(places, None)) is not None:
            values[place] = _text(part).strip()
    return values


def substitute(text: str, values: dict[str, str]) -> str:
    """&name references, in any case; a dot right behind is eaten; unknown ones stay. Single-quoted strings stay as they are."""
    toks, out, i = tokenize(text, "sas"), [], 0
    while i < len(toks):
        t = toks[i]
        name = _after_sign(toks, i) if t.text == "&" else ""
        if name and name in values:
            out.append(values[name])
            i += 2
            if i < len(toks) and toks[i].text.startswith(".") and toks[i].kind in ("op", "number"):
                out.append(toks[i].text[1:])
                i += 1
            continue
        out.append(f'"{substitute(t.text[1:-1], values)}"' if t.kind == "string" and t.text[0] == '"' and "&" in t.text else t.text)
        i += 1
    return "".join(out)


@dataclass
class _Run:
    known: dict[str, Macro]
    calls: list = field(default_factory=list)
    cut: bool = False

    def put(self, text: str, values: dict[str, str], depth: int) -> str:
        """The text with calls and values put in; what lies in front of a %LET takes the values from before it."""
        toks, done, out, i = tokenize(text, "sas"), [], [], 0
        while i < len(toks):
            word = _after_sign(toks, i) if toks[i].text == "%" else ""
            if word == "let":
                end = next((j for j in range(i, len(toks)) if toks[j].text == ";"), len(toks))
                name, value = _keyword(toks[i + 2 : end])
                if value is not None:
                    done.append(substitute("".join(out), values))
                    out = []
                    values[name] = substitute(value, values)
                    i = end + 1
                    continue
            if word not in self.known:
                out.append(toks[i].text)
                i += 1
                continue
            if depth >= DEPTH or len(self.calls) >= EXPANSIONS:
                self.cut = True
                out.append(toks[i].text)
                i += 1
                continue
            macro = self.known[word]
            args, i = _brackets(toks, i + 2)
            own = {p: substitute(v, values) for p, v in bind(macro, args).items()}
            self.calls.append((word, own))
            outer = {k: v for k, v in values.items() if k not in dict(macro.params)}
            # what the body leaves open belongs to its own names, so the outer values are not put into it
            done += [substitute("".join(out), values), self.put(macro.body, outer | own, depth + 1)]
            out = []
            if i < len(toks) and toks[i].text == ";":
                i += 1
        return "".join(done) + substitute("".join(out), values)


def expand(text: str, known: dict[str, Macro] | None = None) -> Expanded:
    """The text with macros and %LET values put in. A reference without a value stays, so its block is read as PARTIAL."""
    own, text = macros(text)
    run = _Run((known or {}) | own)
    out = run.put(text, {}, 0)
    return Expanded(out, run.calls, run.cut)


def step_blocks(macro: Macro, args: str = "", known: dict[str, Macro] | None = None, def_id: str | None = None, instance: int = 1) -> list[Block]:
    """A macro of steps as a table function: the blocks that one call makes, tables in and out.

    Their ids derive from that of the definition: ``<def>#<instance>`` for a single block, ``<def>#<instance>.<j>`` for several.
    """
    run = _Run(known or {})
    blocks = split_blocks(run.put(macro.body, bind(macro, _brackets(tokenize(f"({args})", "sas"), 0)[0]), 0))
    base = f"{def_id or f'm_{macro.name}'}#{instance}"
    for j, b in enumerate(blocks, 1):
        b.id = base if len(blocks) == 1 else f"{base}.{j}"
        b.status = "PARTIAL" if run.cut else b.status
    return blocks


def definitions(fileid: str, source: str) -> list[dict]:
    """Registry rows of the macros that a file defines, with the hash of the file they were read from."""
    code = hashlib.sha256(source.encode()).hexdigest()[:16]
    return [{"fileid": fileid, "sashashcode": code, "macroname": m.name, "params": [p if d is None else f"{p}={d}" for p, d in m.params], "definition": m.body} for m in macros(source)[0].values()]


def called(text: str, names: Iterable[str]) -> list[str]:
    """Names of known macros in the order in which a text calls them, repeats included; definitions are not calls."""
    toks, names = tokenize(text, "sas"), set(names)
    return [w for i, t in enumerate(toks) if t.text == "%" and (w := _after_sign(toks, i)) in names]


def include(text: str, read: Callable[[str], str | None], depth: int = INCLUDE_DEPTH) -> tuple[str, list[str]]:
    """The text with included files put in, to a depth; and the files that are missing or lie too deep."""
    toks, out, missing, i = tokenize(text, "sas"), [], [], 0
    while i < len(toks):
        if toks[i].text == "%" and _after_sign(toks, i) == "include":
            at = _skip_space(toks, i + 2)
            end = _skip_space(toks, at + 1)
            if at < len(toks) and toks[at].kind == "string" and end < len(toks) and toks[end].text == ";":
                path = unquote(toks[at].text, "sas")
                body = read(path) if depth else None
                if body is None:
                    missing.append(path)
                else:
                    inner, more = include(body, read, depth - 1)
                    out.append(inner)
                    missing.extend(more)
                i = end + 1
                continue
        out.append(toks[i].text)
        i += 1
    return "".join(out), missing
