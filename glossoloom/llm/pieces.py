"""Splitting oversized texts at natural boundaries by structure-tree packing.

A text is parsed into a tree: pages, sections nested by the depth of their headings, blocks, list items nested by their
indent, table rows and lines. Sibling subtrees are merged bottom-up as long as they fit; only nodes over the limit are
opened, and only a node without structure is cut into sentences, clauses, words and at last characters. Token counts of
any span are exact: the words of the tokenizer inside it plus the words that its ends cut, split and encoded anew.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as K

LIMIT, OVERLAP = 512, 64
#: A fragment of an opened node is merged with what stands beside the node when either holds less than this part of the room.
CRUMB = 0.25
#: Levels of the tree, coarse to fine: the whole text, pages, six depths of sections, blocks, list items by nesting (deeper ones
#: count as the deepest), lines that are units, then what a node without structure is cut into.
TEXT, PAGE, SECTION, BLOCK, ITEM, LINE, SENTENCE, CLAUSE, WORD, SYMBOL, CHARACTER = 0, 1, 2, 8, 9, 25, 26, 27, 28, 29, 30

_END = r"[.!?…。！？][\"'”’“»«›‹」』）)\]]*"
_LINE = re.compile(r"[^\n\f]*[\n\f]|[^\n\f]+")
_HEADING = re.compile(r"(\#{1,6})[ \t]+\S")
_MARK = re.compile(r"([ \t　]*)(?:[-*•–→‣·+]|\(?\[?\d{1,4}[\])]|\d{1,3}\.|[a-z]\)|[A-Z]{2,8} [-–—]|[\U0001F300-\U0001FAFF])[ \t]")
_CLOSED = re.compile(rf"(?:{_END}|[:：])[ \t　]*$")
_CUTS = {
    SENTENCE: re.compile(rf"{_END}(?=\s)|[。！？…][”’」』）)]*(?=\S)"),
    CLAUSE: re.compile(r"[,;:，；：、](?=\s)|[，；：、](?=\S)|[–—](?=\s)"),
    WORD: re.compile(r"\n|(?<=\S)(?=[ \t])|(?<=[㐀-鿿])(?=[㐀-鿿])"),
    SYMBOL: re.compile(r"(?<=[_\W])(?=\w)"),
}
_WORD = regex.compile(K.PYTHON_PATTERN)


class Counter:
    """Exact number of tokens of spans of one text."""

    def __init__(self, text: str, chars: list[int], tokens: list[int], encode: Callable[[str], int]):
        self.text, self.encode = text, encode
        self.chars = chars  # start of each word, then the length of the text
        self.tokens = tokens  # tokens before each word, then all

    def __call__(self, a: int, b: int) -> int:
        """Tokens of text[a:b] by itself. Its words are those of the text but at its ends: a first word that is cut is split
        anew up to the next common boundary, and so are the last word that is cut and the blanks at the end, which
        make one word there."""
        if a >= b:
            return 0
        text, chars = self.text, self.chars
        n, i = 0, bisect_left(chars, a)
        while chars[i] != a:
            end = _WORD.match(text, a, b).end()
            n += self.encode(text[a:end])
            a = end
            if a >= b:
                return n
            i = bisect_left(chars, a, i)
        j = bisect_right(chars, b) - 1
        while j > i and text[chars[j] - 1].isspace() and text[chars[j - 1] : chars[j]].isspace():
            j -= 1
        n += self.tokens[j] - self.tokens[i]
        at = chars[j]
        while at < b:
            end = _WORD.match(text, at, b).end()
            n += self.encode(text[at:end])
            at = end
        return n


@dataclass
class Node:
    """A span of the text with its parts; ``level`` is that of the boundary it begins with."""

    start: int
    end: int
    level: int
    children: list[Node] = field(default_factory=list)


def boundaries(text: str) -> list[tuple[int, int]]:
    """(place, level) of the starts of all structural parts, in order; the first is that of the text."""
    out = [(0, TEXT)]
    indents: list[int] = []  # of the list items that are open
    blank, closed, table, page, title = False, True, False, False, False
    for m in _LINE.finditer(text):
        line = m.group()
        body = line.strip(" \t　\n\f")
        level = None
        if not body:
            blank = blank or line.endswith("\n")
        else:
            heading, item = _HEADING.match(line), _MARK.match(line)
            row = "\t" in line.strip("\n\f") or body.startswith("|")
            if heading:
                level, indents = SECTION + len(heading.group(1)) - 1, []
            elif item and not (row and table):
                indent = len(item.group(1).expandtabs(4))
                while indents and indents[-1] >= indent:
                    indents.pop()
                indents.append(indent)
                level = min(ITEM + len(indents) - 1, LINE - 1)
            elif blank:
                inside = len(line) - len(line.lstrip(" \t　")) > 0 and indents
                level = LINE if inside else BLOCK
                if not inside:
                    indents = []
            elif row or table or closed or title:
                level = LINE
            if page:
                level = PAGE
            title = heading is not None or not out[1:] and level is None and not _CLOSED.search(body)
            blank, page, table, closed = False, False, row, bool(_CLOSED.search(body)) or heading is not None
        if level is not None and m.start() > 0:
            out.append((m.start(), level))
        page = page or line.endswith("\f")
    return out


def parse(text: str) -> Node:
    """The tree of a text. A part belongs to the last part before it that begins with a coarser boundary; what a part says
    before its own parts is its first child."""
    root = Node(0, len(text), TEXT)
    open_nodes = [root]
    parts = boundaries(text)[1:]
    if any(level == PAGE for _, level in parts):
        parts = [(0, PAGE), *parts]
    for at, level in parts:
        while len(open_nodes) > 1 and open_nodes[-1].level >= level:
            open_nodes.pop().end = at
        parent = open_nodes[-1]
        if not parent.children and at > parent.start:
            parent.children.append(Node(parent.start, at, CHARACTER))
        node = Node(at, parent.end, level)
        parent.children.append(node)
        open_nodes.append(node)
    for node in open_nodes:
        node.end = len(text)
    return root


def _characters(text: str, a: int, b: int, limit: int, count: Counter) -> list[int]:
    """Ends of parts of a span without any boundary: as many characters as fit, never before a combining mark or joiner."""
    ends = []
    while count(a, b) > limit:
        step = 4 * limit
        while a + step < b and count(a, a + step) <= limit:
            step *= 2
        lo, hi = a + 1, min(b - 1, a + step)
        while lo < hi:  # longest prefix that fits; counts grow with length up to a token or two
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if count(a, mid) <= limit else (lo, mid - 1)
        cut = lo
        while cut > a + 1 and (re.match(r"[̀-ͯ‍︀-️]", text[cut]) or text[cut - 1] == "‍"):
            cut -= 1
        ends.append(cut)
        a = cut
    return [*ends, b]


def _open(text: str, node: Node, limit: int, count: Counter) -> list[Node]:
    """Parts of a node over the limit: those of its structure, or the finest cuts of the coarsest kind that divides it."""
    if node.children:
        return node.children
    for level in range(max(node.level + 1, SENTENCE) if node.level < CHARACTER else SENTENCE, CHARACTER):
        ends = [e for m in _CUTS[level].finditer(text, node.start, node.end) if node.start < (e := m.end()) < node.end]
        if ends:
            return [Node(x, y, level) for x, y in zip([node.start, *ends], [*ends, node.end])]
    ends = _characters(text, node.start, node.end, limit, count)
    return [Node(x, y, CHARACTER) for x, y in zip([node.start, *ends[:-1]], ends)]


def _widen(node: Node, start: int) -> None:
    """Let a node, and the first of its parts, begin earlier."""
    node.start = start
    if node.children:
        _widen(node.children[0], start)


def pack(text: str, node: Node, limit: int, count: Counter) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of pieces that tile a node, each at most ``limit`` tokens; whole ones are siblings merged."""
    if count(node.start, node.end) <= limit:
        return [(node.start, node.end, True)]
    out: list[tuple[int, int, bool]] = []
    for child in _open(text, node, limit, count):
        if out and out[-1][2] and count(child.start, child.end) > limit and count(*out[-1][:2]) < CRUMB * limit:
            _widen(child, out.pop()[0])  # a heading stays with what it heads
        parts = pack(text, child, limit, count)
        for k, (start, end, _) in enumerate(parts):
            whole = len(parts) == 1
            if out and not k:  # fragments of one child are merged already
                first, last, before = out[-1]
                fit = whole and before or min(count(first, last), count(start, end)) < CRUMB * limit
                if fit and count(first, end) <= limit:
                    out[-1] = (first, end, whole and before)
                    continue
            out.append((start, end, whole))
    return out


def _overlap_start(text: str, prev_start: int, end: int, overlap: int, count: Counter) -> int:
    """Earliest word start after ``prev_start`` from which the tokens up to ``end`` are at most ``overlap``."""
    if overlap <= 0:
        return end
    lo, hi = prev_start + 1, end
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if count(mid, end) <= overlap else (mid + 1, hi)
    m = re.compile(r"(?<!\s)(?=\s)|(?<=\s)(?=\S)|(?<=[㐀-鿿，；：。！？、])(?=[㐀-鿿])").search(text, lo, end)
    at = m.start() if m else lo
    return at if at < end and count(at, end) <= overlap else (lo if count(lo, end) <= overlap else end)


def cut(text: str, count: Counter, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces of a text as (start, end, fresh_start): each at most ``limit`` tokens, each but the first beginning with up to
    ``overlap`` tokens of the one before. Together they cover the text; without overlap they tile it."""
    if overlap >= limit or limit < 4:
        raise ValueError("the overlap must be smaller than the limit, and the limit at least 4")
    n = len(text)
    if count(0, n) <= limit:
        return [(0, n, 0)]
    pieces: list[tuple[int, int, int]] = []
    for fresh, end, _ in pack(text, parse(text), limit - overlap, count):
        start, room = fresh, overlap
        while pieces and room > 0:
            start = _overlap_start(text, pieces[-1][0], fresh, room, count)
            if (over := count(start, end) - limit) <= 0:
                break
            start, room = fresh, room - over  # joined words may take more tokens than both parts
        pieces.append((start, end, fresh))
    return pieces


def split_texts(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, table_size: int = K.TABLE_SIZE) -> DataFrame:
    """Pieces of every text: (key, piece, start, end, fresh_start, n_tokens, text); positions count code points.

    A text within the limit is one piece, also the empty one; null gives one piece with null text and no tokens. A
    piece is the exact span [start, end) of its text. Repeated rows are cut as often as they stand; other columns are
    not read. Texts of any length are handled whole.
    """
    table = K.build_word_table(df, path, text, table_size)
    kind = df.schema[key].dataType.simpleString()
    names = [key, "piece", "start", "end", "fresh_start", "n_tokens", text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = K.load_encoding(path)
        memo: dict[str, int] = {}

        def encode(s: str) -> int:
            if len(s) > 64:
                return len(encoding._encode_single_piece(s))
            n = memo.get(s)
            if n is None:
                if len(memo) > 100_000:
                    memo.clear()
                n = memo[s] = len(encoding._encode_single_piece(s))
            return n

        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                bounds, n = table.value.counts_of(b.column(2))
                words = b.column(2).flatten()
                ends = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)])
                tokens = np.concatenate([[0], np.cumsum(n)])
                rows, spans = [], []
                texts = b.column(1)
                for r in range(b.num_rows):
                    lo, hi = bounds[r], bounds[r + 1]
                    total = int(tokens[hi] - tokens[lo])
                    if total <= limit:
                        rows.append(r)
                        spans.append((0, 0, int(ends[hi] - ends[lo]), 0, total))
                        continue
                    count = Counter(texts[r].as_py(), (ends[lo : hi + 1] - ends[lo]).tolist(), (tokens[lo : hi + 1] - tokens[lo]).tolist(), encode)
                    for k, (s, e, f) in enumerate(cut(count.text, count, limit, overlap)):
                        rows.append(r)
                        spans.append((k, s, e, f, count(s, e)))
                take = pa.array(rows, pa.int64())
                whole_text = texts.take(take)
                k, s, e, f, t = (pa.array(x, pa.int32()) for x in (zip(*spans) if spans else [[]] * 5))
                cut_text = pa.array([x if x is None or not i and len(x) == j else x[i:j] for x, (_, i, j, _, _) in zip(whole_text.to_pylist(), spans)], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), k, s, e, f, t, cut_text], names)

    schema = f"`{key}` {kind}, piece int, start int, `end` int, fresh_start int, n_tokens int, `{text}` string"
    return df.select(F.col(key), F.col(text), K.words_of(F.col(text)).alias("_words")).mapInArrow(run, schema)
