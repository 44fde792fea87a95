"""Splitting texts over a token limit at natural boundaries: structure-tree packing.

A text is parsed into a tree (``read_tree``): sections nested by the rank of their headings, in them lists nested by indent, tables,
fenced code, HTML elements nested by tags, and paragraphs; the leaves are lines. A heading, a table's head and the line that opens a
fence belong to the first leaf that follows them, so none of them ever stands alone while something follows. A line that is itself
over the limit is opened into sentences, a sentence into words, a word into tokens.

Only a node over the limit is opened (``frontier``). What is left are the greatest subtrees within the limit; these are merged with their
neighbours from the bottom up as long as they fit together, whatever level they come from, so the rest of an opened node takes in the
sibling that follows it, and no two neighbouring pieces fit into one.

Pieces but the first begin with the last ``overlap`` tokens of the piece before. Tokens are those of the whole text; cuts are where a
token and a character begin. A piece counted by itself can differ from its share of the whole text's tokens where it begins or ends
inside a word. Such edges are counted again when a piece is closed; a piece over the limit gives back its last subtree, and one subtree
that does not fit by itself is opened further, so only that piece is packed tighter.

A text is read and tokenized once, within one call; texts with no more bytes than the limit are not even tokenized.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.tokens import DEFAULT, tokens
from quillspan.session import spread

_HASHES = re.compile(r"(#{1,6})[ \t]+\S")
_EQUALS = re.compile(r"(={2,6})[^=].*?=+$")
_NUMBERED = re.compile(r"\d+((?:\.\d+)+)\.?[ \t]+[^\W\d_]")
_RULE = re.compile(r"(?:={3,}|-{3,})$")
_ITEM = re.compile(r"(?:[-*+•]|\d{1,3}[.)])[ \t]+\S")
_TABLE_RULE = re.compile(r"\|?[ \t]*:?-+[-:| \t]*$")
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
#: HTML elements that make a node; others are text.
_ELEMENTS = frozenset("article aside blockquote body div dl footer form header html main nav ol p pre section table tbody thead tr ul li".split())
#: Elements that the next of their kind ends, and how deep elements nest; an element below that is a leaf.
_CLOSED_BY_NEXT, _DEEPEST = ("p", "li", "tr"), 200
_SENTENCE = re.compile(r"[.!?;:…。！？]+[\"')\]»”’]*\s+|[。！？]")
_WORD = re.compile(r"\s+")
_NOT_BLANK = re.compile(r"\S")


class Node:
    """A subtree: its kind, its level among nodes of its kind, and its kids (nodes, or the numbers of leaves)."""

    __slots__ = ("kind", "level", "kids", "first", "last")

    def __init__(self, kind: str, level: int = 0):
        self.kind, self.level, self.kids, self.first, self.last = kind, level, [], None, 0


class _Builder:
    """The tree under construction: the open nodes from the root to the innermost, and where each leaf begins."""

    def __init__(self):
        self.open = [Node("text")]
        #: Where each leaf begins with the headings in front of it, and where its own line begins.
        self.starts: list[int] = []
        self.lines: list[int] = []
        #: Where headings begin that wait for their first leaf.
        self.waiting: int | None = None

    @property
    def top(self) -> Node:
        return self.open[-1]

    def close(self, *kinds: str) -> None:
        while self.top.kind in kinds:
            self.open.pop()

    def close_to(self, kind: str, level: int) -> None:
        """Closes up to and with the innermost node of that kind and level, if there is one."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].kind == kind and self.open[i].level == level:
                del self.open[i:]
                return

    def push(self, kind: str, level: int = 0) -> None:
        self.open.append(Node(kind, level))

    def wait(self, start: int) -> None:
        if self.waiting is None:
            self.waiting = start

    def leaf(self, start: int) -> None:
        n = len(self.starts)
        self.starts.append(start if self.waiting is None else self.waiting)
        self.lines.append(start)
        self.waiting = None
        for i in range(len(self.open) - 1, 0, -1):  # nodes come into being with their first leaf
            node = self.open[i]
            if node.first is not None:
                break
            node.first = n
            self.open[i - 1].kids.append(node)
        self.top.kids.append(n)

    def finish(self) -> Node:
        """The root, once every node knows its last leaf."""
        root, nodes = self.open[0], [self.open[0]]
        for node in nodes:
            nodes.extend(k for k in node.kids if not isinstance(k, int))
        for node in reversed(nodes):
            k = node.kids[-1]
            node.last = k + 1 if isinstance(k, int) else k.last
        root.first = 0
        return root


_BLOCKS = ("paragraph", "table", "list", "item")


def _heading(s: str, after_blank: bool, next_line: str) -> int:
    """The rank of a heading, 0 for other lines."""
    c = s[0]
    if c == "#" and (m := _HASHES.match(s)):
        return len(m[1])
    if c == "=" and (m := _EQUALS.match(s)):
        return len(m[1])
    if c == "<" and (m := _TAG.match(s)) and not m[1] and len(m[2]) == 2 and m[2][0] in "hH" and m[2][1] in "123456":
        return int(m[2][1])
    if after_blank and len(s) <= 100:
        if c.isdigit() and (m := _NUMBERED.match(s)) and not next_line.strip():
            return min(6, 1 + m[1].count("."))
        rule = next_line.strip()
        if rule and c not in "|<-*+>" and len(rule) <= len(s) + 3 and _RULE.match(rule):
            return 1 if rule[0] == "=" else 2
    return 0


def read_tree(text: str) -> tuple[Node, list[int], list[int]]:
    """The tree of a text, where each leaf begins (headings in front included), and where each leaf's own line begins."""
    b = _Builder()
    lines = text.splitlines(keepends=True)
    at, blank, fence, skip = 0, True, "", False
    for i, line in enumerate(lines):
        start, at = at, at + len(line)
        s = line.strip()
        if not s:
            if fence or b.top.kind in ("paragraph", "table"):
                b.close("paragraph", "table")
            blank = True
            continue
        after, blank = blank, False
        if skip:  # the rule under a heading
            skip = False
            continue
        following = lines[i + 1] if i + 1 < len(lines) else ""
        if fence:
            if s.startswith(fence):
                b.leaf(start)
                b.close_to("fence", 0)
                fence = ""
            else:
                if b.top.kind != "paragraph":
                    b.push("paragraph")
                b.leaf(start)
            continue
        rank = _heading(s, after, following)
        if rank:
            while b.top.kind != "text" and not (b.top.kind == "section" and b.top.level < rank):
                b.open.pop()
            b.push("section", rank)
            b.wait(start)
            skip = bool(_RULE.match(following.strip())) and s[0] not in "#=<"
            continue
        if s[:3] in ("```", "~~~"):
            b.close(*_BLOCKS)
            b.push("fence")
            fence = s[:3]
            b.wait(start)
            continue
        tag = _TAG.match(s) if s[0] == "<" else None
        if tag and tag[2].lower() in _ELEMENTS and (tag[1] or len(b.open) < _DEEPEST):
            name = tag[2].lower()
            level = hash_of(name)
            b.close(*_BLOCKS)
            if tag[1]:
                b.leaf(start)
                b.close_to("element", level)
            else:
                if name in _CLOSED_BY_NEXT and b.top.kind == "element" and b.top.level == level:
                    b.open.pop()
                b.push("element", level)
                b.leaf(start)
                if f"</{name}" in s.lower():
                    b.open.pop()
            continue
        if _ITEM.match(s):
            indent = len(line) - len(line.lstrip())
            b.close("paragraph", "table")
            while b.top.kind == "item" and b.top.level >= indent:
                b.open.pop()
            if b.top.kind not in ("list", "item"):
                b.push("list")
            b.push("item", indent)
            b.leaf(start)
            continue
        if s[0] == "|":
            if b.top.kind != "table":
                b.close("paragraph")
                if not line[0].isspace():
                    b.close("item", "list")
                b.push("table")
                if _TABLE_RULE.match(following.strip()):
                    b.wait(start)
                    continue
            if b.waiting is not None and _TABLE_RULE.match(s):
                continue
            b.leaf(start)
            continue
        b.close("table")
        if b.top.kind == "item" and (not after or line[0].isspace()):
            b.leaf(start)  # goes on with the item
            continue
        if b.top.kind != "paragraph":
            b.close("item", "list")
            b.push("paragraph")
        b.leaf(start)
    if not b.starts:
        b.leaf(0)
    b.starts[0] = 0
    return b.finish(), b.starts, b.lines


def hash_of(name: str) -> int:
    """A number for an element's name."""
    return int.from_bytes(name.encode(), "big")


class _Text:
    """A text with its tokens and its tree; boundaries are token numbers at which a character begins."""

    def __init__(self, text: str, ids: list[int], tok):
        self.text, self.ids, self.tok = text, ids, tok
        raw = text.encode("utf-8", "surrogatepass")
        at = tok.bytes_before(ids)
        if len(raw) == len(text):
            self.char = at
            self.whole = np.ones(len(at), bool)
        else:
            begins = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
            before = np.concatenate([[0], np.cumsum(begins)])
            self.char = before[at]
            self.whole = np.concatenate([begins, [True]])[at]
        self._tree = None

    def _tokens_at(self, chars) -> np.ndarray:
        """The first whole token at or after each character."""
        at = np.searchsorted(self.char, np.asarray(chars, np.int64), "left")
        while len(at) and not self.whole[at].all():
            at = np.where(self.whole[at], at, at + 1)
        return at

    @property
    def tree(self) -> tuple[Node, list[int], list[int]]:
        """The root, the token at which each leaf begins (and the text ends), and the character of each leaf's own line."""
        if self._tree is None:
            root, starts, lines = read_tree(self.text)
            self._tree = root, [*self._tokens_at(starts).tolist(), len(self.ids)], lines
        return self._tree

    def frontier(self, room: int) -> list[int]:
        """Where the greatest subtrees of at most ``room`` tokens begin: only nodes over it are opened."""
        root, leaf, lines = self.tree
        out, stack = [], [root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                first, last = node, node + 1
            else:
                first, last = node.first, node.last
            lo, hi = leaf[first], leaf[last]
            if hi - lo <= room:
                if hi > lo:
                    out.append(lo)
            elif isinstance(node, int):
                out.extend(self._opened(lo, hi, room, lines[first]))
            else:
                stack.extend(reversed(node.kids))
        return out

    def _inside(self, pattern: re.Pattern, lo: int, hi: int, behind: bool, begin: int = 0) -> list[int]:
        """Boundaries by a pattern between two tokens, behind its matches or in front of them, and not before the character ``begin``."""
        found = [m.end() if behind else m.start() for m in pattern.finditer(self.text, max(begin, int(self.char[lo])), int(self.char[hi]))]
        return sorted({x for x in self._tokens_at(found).tolist() if lo < x < hi}) if found else []

    def _whole(self, lo: int, hi: int) -> list[int]:
        return (np.flatnonzero(self.whole[lo + 1 : hi]) + lo + 1).tolist()

    def _opened(self, lo: int, hi: int, room: int, begin: int) -> list[int]:
        """A line over ``room`` as sentences; sentences over it as words (cut before their blank, as tokens carry it in front); words as tokens."""
        out = []
        sentences = [lo, *self._inside(_SENTENCE, lo, hi, True, begin), hi]
        for a, z in zip(sentences, sentences[1:]):
            if z - a <= room:
                out.append(a)
                continue
            words = [a, *self._inside(_WORD, a, z, False, begin), z]
            for p, q in zip(words, words[1:]):
                out.append(p)
                if q - p > room:
                    out.extend(self._whole(p, q))
        return out

    def _finer(self, lo: int, hi: int) -> list[int]:
        """The coarsest boundaries inside one subtree that does not fit by itself."""
        _, leaf, _ = self.tree
        lines = sorted(set(leaf[bisect_right(leaf, lo) : bisect_left(leaf, hi)]))
        return lines or self._inside(_SENTENCE, lo, hi, True) or self._inside(_WORD, lo, hi, False) or self._whole(lo, hi)

    def own_count(self, lo: int, hi: int) -> int:
        """Tokens of the piece as a text by itself; only edges where the text would be read otherwise are counted again.

        An edge between a word and the blanks behind it is one in every text. At all others the word or the blanks at the edge are
        counted again, up to the next such place.
        """
        a, z = int(self.char[lo]), int(self.char[hi])
        t, head, tail = self.text, lo, hi
        if a > 0 and t[a - 1].isspace() == t[a].isspace():
            word = _NOT_BLANK.search(t, a, z)
            m = _WORD.search(t, word.start(), z) if word else None
            head = self._token_of(m.start()) if m else None
        if z < len(t) and (t[z - 1].isspace() or not t[z].isspace()):
            at = z
            while at > a and not t[at - 1].isspace():
                at -= 1
            while at > a and t[at - 1].isspace():
                at -= 1
            tail = self._token_of(at) if at > a else None
        if head is None or tail is None or head > tail:
            return len(self.tok.encode(t[a:z]))
        n = tail - head
        if head > lo:
            n += len(self.tok.encode(t[a : int(self.char[head])]))
        if tail < hi:
            n += len(self.tok.encode(t[int(self.char[tail]) : z]))
        return n

    def _token_of(self, char: int) -> int | None:
        i = int(np.searchsorted(self.char, char))
        return i if i < len(self.char) and self.char[i] == char and self.whole[i] else None

    def _begins(self, lo: int, overlap: int) -> list[int]:
        """Where a piece may begin whose own part begins at ``lo``: the overlap before it, at a character; nearer where that does not fit."""
        if not lo or not overlap:
            return [lo]
        wanted = max(0, lo - overlap)
        back = wanted
        while not self.whole[back]:
            back -= 1
        near = [x for x in range(wanted, lo) if self.whole[x]]
        return list(dict.fromkeys([back, *near, lo]))

    def pieces(self, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
        """(start, end, tokens shared with the piece before, tokens by itself)."""
        n = len(self.ids)
        bounds = [*self.frontier(limit - overlap), n]
        out, i = [], 0
        while i < len(bounds) - 1:
            lo = bounds[i]
            for start in self._begins(lo, overlap):
                j, count = self._merge(bounds, i, start, limit)
                if j > i:
                    break
            out.append((start, bounds[j], lo - start, count))
            i = j
        return out

    def _merge(self, bounds: list[int], i: int, start: int, limit: int) -> tuple[int, int]:
        """The last boundary up to which the subtrees from the i-th on fit into one piece, and its tokens; opens one that does not fit."""
        while True:
            j = bisect_right(bounds, start + limit, i) - 1
            while j > i:
                count = self.own_count(start, bounds[j])
                if count <= limit:
                    return j, count
                j -= 1
            finer = self._finer(bounds[i], bounds[i + 1])
            if not finer:
                return i, 0
            bounds[i + 1 : i + 1] = finer


def cut_text(text: str | None, limit: int, overlap: int, tokenizer: str = DEFAULT, known: _Text | None = None) -> list[tuple]:
    """Pieces of one text; nothing where the text has at most ``limit`` tokens."""
    whole = known or read_text(text, limit, tokenizer)
    if whole is None or len(whole.ids) <= limit:
        return []
    return [(i, int(whole.char[a]), int(whole.char[b]), a, b, shared, n, whole.text[whole.char[a] : whole.char[b]]) for i, (a, b, shared, n) in enumerate(whole.pieces(limit, overlap))]


def read_text(text: str | None, limit: int, tokenizer: str) -> _Text | None:
    if not text or len(text) * 4 <= limit or len(text.encode("utf-8", "surrogatepass")) <= limit:
        return None
    tok = tokens(tokenizer)
    return _Text(text, tok.encode(text), tok)


def cut(rows: DataFrame, key: str, text: str, limits: list[tuple[str, int, int]], tokenizer: str = DEFAULT) -> DataFrame:
    """The pieces of all texts over each of ``limits`` (name, most tokens, overlap).

    limit_name, key, piece (from 0), start_char, end_char, start_token, end_token (of the whole text), shared_tokens, n_tokens (of
    the piece by itself, never over the limit) and text. The pieces of a text without what they share make up the text. Texts within
    the limit, empty and null ones have no rows; equal texts and repeated rows are cut each by itself. ``shared_tokens`` is the
    overlap; up to three tokens more where that would begin inside a character, and fewer where a character would not fit beside it.
    An empty table gives no rows. A limit below 4 tokens cannot hold every character, and one not above twice the overlap leaves too
    little room; both are refused.
    """
    for name, most, overlap in limits:
        if most < 4 or overlap < 0 or 2 * overlap >= most:
            raise ValueError(f"{name}: a limit of {most} tokens with an overlap of {overlap} cannot be kept")
    kind = rows.schema[key].dataType.simpleString()
    least = min((m for _, m, _ in limits), default=0)
    fields = {"limit_name": pa.string(), "key": None, "piece": pa.int32(), "start_char": pa.int64(), "end_char": pa.int64(), "start_token": pa.int64(), "end_token": pa.int64(), "shared_tokens": pa.int32(), "n_tokens": pa.int32(), "text": pa.string()}

    def pieces(batches):
        for b in batches:
            fields["key"] = b.column(0).type
            out, held = [], 0
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                whole = read_text(t, least, tokenizer)
                if whole is None:
                    continue
                for name, most, overlap in limits:
                    out.extend((name, k, *p) for p in cut_text(t, most, overlap, tokenizer, whole))
                held += len(t)
                if held > 4_000_000:
                    yield _batch(out, fields)
                    out, held = [], 0
            yield _batch(out, fields)

    return spread(rows.select(F.col(key).alias("key"), F.col(text).alias("text")), "key").mapInArrow(pieces, f"limit_name string, key {kind}, piece int, start_char long, end_char long, start_token long, end_token long, shared_tokens int, n_tokens int, text string")


def _batch(rows: list[tuple], fields: dict) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, fields.values())], list(fields))
