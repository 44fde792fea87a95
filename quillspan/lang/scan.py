"""Reading raw programs without executing them: statements, step blocks, tables read and written, remarks."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass, field

from quillspan.lang.lex import Token, tokenize


@dataclass
class Scanned:
    """One statement: its tokens without spaces and comments, and its lines."""
    tokens: list[Token]
    first: int
    last: int

    @property
    def words(self) -> list[str]:
        return [t.low for t in self.tokens]


@dataclass
class Block:
    id: str
    kind: str
    statements: list[Scanned]
    first: int
    last: int
    reads: list[str] = field(default_factory=list)
    writes: list[str] = field(default_factory=list)
    #: (read, write) pairs; in PROC SQL only within a statement
    flows: list[tuple[str, str]] = field(default_factory=list)
    status: str = "PARSED"


def statements(text: str) -> list[Scanned]:
    """Statements split at semicolons outside strings and comments; a star at a statement's begin makes it a comment."""
    out, held = [], []
    for t in tokenize(text, "sas"):
        if t.kind in ("space", "comment"):
            continue
        if t.text == ";" or t.kind == "datalines":
            if t.kind == "datalines":
                held.append(t)
            if held and held[0].text not in ("*", "%*"):
                out.append(Scanned(held, held[0].line, t.line + t.text.count("\n")))
            held = []
        else:
            held.append(t)
    if held and held[0].text != "*":
        out.append(Scanned(held, held[0].line, held[-1].line))
    return out


#: Fixed value: the format of annotations that give a step its id.
_BLOCKID = re.compile(r"/\*BLOCKID\s+([\w:.]+).*?\*/", re.I | re.S)
_OPENERS = {"data", "proc"}


def split_blocks(text: str) -> list[Block]:
    """Steps from DATA or PROC to RUN, QUIT or the next step. Ids are b_<n>_<hash of the step's words>, or given by annotations."""
    given = [(text.count("\n", 0, m.start()) + 1, m[1]) for m in _BLOCKID.finditer(text)]
    out: list[Block] = []
    held: list[Scanned] = []

    def close() -> None:
        if held:
            words = " ".join(w for s in held for w in s.words)
            n = len(out) + 1
            own = [i for line, i in given if line <= held[0].first and not any(line <= b.first for b in out)]
            kind = held[0].words[0] if held[0].words[0] != "proc" else f"proc {held[0].words[1] if len(held[0].words) > 1 else ''}".strip()
            out.append(Block(own[-1] if own else f"b_{n}_{hashlib.sha1(words.encode()).hexdigest()[:8]}", kind, list(held), held[0].first, held[-1].last))
            held.clear()

    for s in statements(text):
        w = s.words[0]
        if w in _OPENERS:
            close()
            held.append(s)
        elif not held:
            if w == "libname":
                held.append(s)
                close()
        else:
            held.append(s)
            if w == "quit" or (w == "run" and held[0].words[:2] != ["proc", "sql"]):
                close()
    close()
    for b in out:
        _tables(b)
    return out


def _datasets(toks: list[Token]) -> list[str]:
    """Data set names in a list, their parenthesised options skipped; statement options behind a slash end it."""
    out, i, depth = [], 0, 0
    while i < len(toks):
        t = toks[i]
        if t.text == "(":
            depth += 1
        elif t.text == ")":
            depth -= 1
        elif depth == 0 and t.text == "/":
            break
        elif depth == 0 and t.kind == "word":
            if i + 1 < len(toks) and toks[i + 1].text == "=":
                i += 3  # option=value
                continue
            name = t.low
            if i + 2 < len(toks) and toks[i + 1].text == "." and toks[i + 2].kind == "word":
                name += "." + toks[i + 2].low
                i += 2
            out.append(name if "." in name else f"work.{name}")
        i += 1
    return out


def _option(s: Scanned, name: str) -> list[str]:
    w = s.words
    for i in range(len(w) - 2):
        if w[i] == name and w[i + 1] == "=":
            return _datasets(s.tokens[i + 2 : i + 5])[:1]
    return []


#: Words that end a list of tables in a query.
_CLAUSES = frozenset("where group having order union except intersect on using set values as select limit offset into".split())


class _Query:
    """The tables that one PROC SQL statement reads and writes, and whether all of it was understood."""

    def __init__(self, toks: list[Token]):
        self.toks, self.reads, self.writes, self.clear = toks, [], [], True
        self.local: set[str] = set()
        w = [t.low for t in toks]
        self.i = 0
        if w[:1] == ["create"] and w[1:2] in (["table"], ["view"]):
            self.i = 2
            self.write()
        elif w[:2] in (["insert", "into"], ["delete", "from"]):
            self.i = 2
            self.write()
        elif w[:1] == ["update"]:
            self.i = 1
            self.write()
        elif w[:1] == ["drop"]:
            self.i = len(w)
        self.rest()
        self.reads = [r for r in self.reads if r.removeprefix("work.") not in self.local]

    def word(self, ahead: int = 0) -> str:
        at = self.i + ahead
        return self.toks[at].low if at < len(self.toks) and self.toks[at].kind != "string" else ""

    def name(self) -> str | None:
        """A table name at this place."""
        if self.i >= len(self.toks) or self.toks[self.i].kind != "word":
            return None
        name = self.word()
        self.i += 1
        while self.word() == "." and self.i + 1 < len(self.toks) and self.toks[self.i + 1].kind == "word":
            name += "." + self.word(1)
            self.i += 2
        return name if "." in name else f"work.{name}"

    def write(self) -> None:
        name = self.name()
        if name:
            self.writes.append(name)
        else:
            self.clear = False

    def rest(self) -> None:
        """Everything behind the head. ``lists`` says for each open bracket whether it holds a query, and whether its table list is open."""
        lists = [{"query": True, "open": False}]
        while self.i < len(self.toks):
            w, level = self.word(), lists[-1]
            if w == "(":
                lists.append({"query": self.word(1) in ("select", "with"), "open": False})
                self.i += 1
            elif w == ")":
                if len(lists) > 1:
                    lists.pop()
                self.i += 1
            elif w == "with" or (w == "," and level.get("with")):
                self.i += 1
                self.with_name(level)
            elif level["query"] and (w in ("from", "join") or (w == "," and level["open"])):
                self.i += 1
                level["open"] = True
                self.source()
            else:
                if w in _CLAUSES:
                    level["open"] = False
                    level["with"] = False
                self.i += 1

    def with_name(self, level: dict) -> None:
        if self.i < len(self.toks) and self.toks[self.i].kind == "word" and self.word(1) in ("as", "("):
            self.local.add(self.word())
            self.i += 2 if self.word(1) == "as" else 1
            level["with"] = True
        else:
            self.clear = False

    def source(self) -> None:
        """One element of a table list: a name, or a bracket, which is read like everything else."""
        if self.word() == "(":
            return
        name = self.name()
        if name is None:
            self.clear = False
        else:
            self.reads.append(name)


#: Statements that show where a DATA step's rows come from when it reads no table.
_INLINE = frozenset(("datalines", "cards", "infile", "input"))


def _tables(b: Block) -> None:
    head = b.statements[0]
    clear = not any("&" in s.words or "%" in s.words for s in b.statements)
    if b.kind == "data":
        b.writes = [n for n in _datasets(head.tokens[1:]) if n != "work._null_"]
        for s in b.statements[1:]:
            if s.words[0] in ("set", "merge", "update", "modify"):
                found = _datasets(s.tokens[1:])
                clear = clear and bool(found)
                b.reads += found
            elif s.words[0] == "if" and "then" in s.words and s.words[s.words.index("then") + 1 :][:1] == ["set"]:
                b.reads += _datasets(s.tokens[s.words.index("then") + 2 :])
        b.flows = [(r, w) for r in b.reads for w in b.writes]
    elif b.kind == "proc sql":
        for s in b.statements[1:]:
            q = _Query(s.tokens)
            clear = clear and q.clear
            b.writes += q.writes
            b.reads += q.reads
            b.flows += [(r, x) for r in q.reads for x in q.writes]
    elif b.kind in ("proc sort", "proc transpose"):
        b.reads = _option(head, "data")
        b.writes = _option(head, "out") or (b.reads if b.kind == "proc sort" else [])
        clear = clear and bool(b.reads)
        b.flows = [(r, w) for r in b.reads for w in b.writes]
    elif b.kind == "proc append":
        b.reads, b.writes = _option(head, "data") or _option(head, "new"), _option(head, "base") or _option(head, "out")
        clear = clear and bool(b.reads and b.writes)
        b.flows = [(r, w) for r in b.reads for w in b.writes]
    elif b.kind != "libname":
        # no rule for this step: what its options name is listed, an OUTPUT statement's table among it
        b.reads, b.writes = _option(head, "data"), [w for s in b.statements for w in _option(s, "out")]
        b.flows = [(r, w) for r in b.reads for w in b.writes]
        b.status = "NOT_MATCHED"
    if not clear and b.status == "PARSED":
        b.status = "PARTIAL"
    b.reads, b.writes, b.flows = (list(dict.fromkeys(x)) for x in (b.reads, b.writes, b.flows))


# ---- remarks ----
def remarks(text: str) -> list[tuple[int, str]]:
    """The remarks of a program: line and text, without their signs. A statement that begins with a star is one too."""
    out, first = [], True
    toks = tokenize(text, "sas")
    i = 0
    while i < len(toks):
        t = toks[i]
        if t.kind == "comment":
            out.append((t.line, t.text[2:-2].strip()))
        elif t.kind != "space":
            if first and t.text == "*":
                end = next((j for j in range(i, len(toks)) if toks[j].text == ";"), len(toks))
                out.append((t.line, "".join(x.text for x in toks[i + 1 : end]).strip()))
                i = end
            first = i < len(toks) and toks[i].text == ";"
        i += 1
    return out


def _data_only(text: str) -> str:
    """Lines of data without the remarks that stand between them."""
    out, at = [], 0
    while (start := text.find("/*", at)) >= 0 and (end := text.find("*/", start + 2)) >= 0:
        out.append(text[at:start])
        at = end + 2
    return " ".join([*out, text[at:]])


def bare(text: str) -> str:
    """The program without its remarks, white space squeezed; strings stay as they are, whatever they hold. Remarks among data lines go too."""
    out, first, i = [], True, 0
    toks = tokenize(text, "sas")
    while i < len(toks):
        t = toks[i]
        if t.kind in ("comment", "space"):
            out.append(" ")
        elif first and t.text == "*":
            i = next((j for j in range(i, len(toks)) if toks[j].text == ";"), len(toks))
        elif t.kind == "datalines":
            out.append(_data_only(t.text))
            first = t.text.rstrip().endswith(";")  # no data at all
        else:
            out.append(t.text)
            first = t.text == ";"
        i += 1
    joined: list[str] = []
    for x in out:
        if x != " " or (joined and joined[-1] != " "):
            joined.append(x)
    return "".join(joined).strip()


def attach_remarks(text: str) -> list[tuple[int, str, str, int | None]]:
    """Each remark with the statement it speaks of: (line, text, position, number of the statement from 0).

    On a statement's lines a remark is ``inline``, on its last line ``trailing``. Between two statements it goes to the nearer one, and
    to the one that follows where both are as near: ``leading`` in front of a statement, ``trailing`` behind one. In a text without
    statements it is a ``prologue`` and has no statement.
    """
    parts = statements(text)
    firsts, lasts = [s.first for s in parts], [s.last for s in parts]
    out = []
    for line, said in remarks(text):
        at = bisect_left(lasts, line)  # the first statement that ends on the line or behind it
        if at < len(parts) and firsts[at] <= line:
            out.append((line, said, "trailing" if line == lasts[at] else "inline", at))
        elif at == len(parts):
            out.append((line, said, "trailing" if parts else "prologue", at - 1 if parts else None))
        elif at == 0 or firsts[at] - line <= line - lasts[at - 1]:
            out.append((line, said, "leading", at))
        else:
            out.append((line, said, "trailing", at - 1))
    return out
