"""Cutting oversized texts at natural boundaries by packing a structure tree.

Headings, blank lines, list items by their indent, closing tags and lines make
a tree of the text.  Whole sibling subtrees are merged bottom-up as long as
they fit; only nodes that are too large are opened, down to sentences, words
and, where a stretch without white space alone exceeds the limit, its inside.
Each piece after the first repeats the end of the one before.

A piece begins with the white space before its first word, so cuts lie right
at the end of a paragraph, line, sentence or word, and the tokens of a piece
are the sum of those of its units.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.llm.tokens import ATOMS, DEFAULT_VOCABULARY, WHITE, Counter, counter, ship

#: What an overlap may exceed the asked tokens by so that it starts at a word.
SLACK = 16
_LINES = re.compile(rf"[{WHITE}]*[^{WHITE}](?:[^\n]*[^{WHITE}])?|[{WHITE}]+")
_LEADING = re.compile(rf"[{WHITE}]*")
_START = re.compile(r"(#{1,6})(?=\s|$)|<h([1-6])\b|(```|~~~)|((?:[-*+•]|\d{1,4}[.)])\s|<(?:li|p|div|section|tr)\b)", re.I)
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
_GOOD_INSIDE = re.compile(r"[。！？；]|[、，：,;:.!?)\]}>|/&=]")
#: Boundaries by strength: headings by their level (0 to 5), then these; list items lie between ITEM and LINE by their depth.
PARAGRAPH, ITEM, LINE, SENTENCE, WORD, INSIDE = range(6, 12)
_CLOSING = re.compile(r"</(?:section|article|div|ul|ol|li|table|tr|p|h[1-6])>\s*$", re.I)

Unit = tuple[str, int, float]  # text, tokens, rank of the boundary before it (lower is stronger)


def name_of(rank: float) -> str:
    """The name of a boundary's kind."""
    if rank < PARAGRAPH:
        return "heading"
    return {PARAGRAPH: "paragraph", SENTENCE: "sentence", WORD: "word", INSIDE: "inside"}.get(rank, "line")


def _item_rank(depth: int) -> float:
    return ITEM + depth / (depth + 1)


def _indent(blank: str) -> int:
    """Columns before the first sign of a line; a tab counts as four."""
    own = blank[max(blank.rfind("\n"), blank.rfind("\r")) + 1 :]
    return len(own) + 3 * own.count("\t")


def _line_units(text: str, counts: Counter) -> list[Unit]:
    units: list[Unit] = []
    fenced = closed = False
    lists: list[int] = []  # indents of the items that enclose the line
    for line in _LINES.findall(text):
        lead = _LEADING.match(line).end()
        blank = line[:lead]
        breaks = blank.count("\n") or blank.count("\r")
        rank: float = PARAGRAPH if breaks > 1 or closed else LINE
        closed = not fenced and _CLOSING.search(line) is not None
        start = _START.match(line, lead)
        marks, tag, fence, item = start.groups() if start else (None,) * 4
        if fence:
            fenced = not fenced
        elif not fenced:
            if marks or tag:
                rank = len(marks) - 1 if marks else int(tag) - 1
                lists = []
            else:
                indent = _indent(blank)
                while lists and lists[-1] >= indent and (item or rank == PARAGRAPH):
                    lists.pop()
                # what is indented below an item belongs to it, even after a blank line
                if item and (lists or rank == LINE) or lists and rank == PARAGRAPH:
                    rank = _item_rank(len(lists))
                if item:
                    lists.append(indent)
        units.append((line, counts.count(line), rank))
    return units


def _open(unit: Unit, room: int, limit: int, counts: Counter) -> tuple[list[Unit], bool]:
    """A line that is too large as sentences, words and parts of words; whether a stretch had to be cut inside."""
    text, _, rank = unit
    out: list[Unit] = []
    forced = False
    for atom in ATOMS.findall(text):
        n = counts[atom]
        if n <= limit:
            out.append((atom, n, rank))
        else:
            lead = _LEADING.match(atom).end()
            # the blank right before a word belongs to its first token
            blank, stretch = (atom[: lead - 1], atom[lead - 1 :]) if 0 < lead < len(atom) and atom[lead - 1] == " " else (atom[:lead], atom[lead:])
            for part in _inside(blank, room, counts):
                out.append((part, counts.count(part), rank))
                rank = WORD
            if stretch:
                alone = counts[stretch.lstrip(" ")] > limit
                forced |= alone
                for part in _inside(stretch, room, counts) if counts[stretch] > limit else [stretch]:
                    out.append((part, counts.count(part), rank))
                    rank = INSIDE
        rank = SENTENCE if _SENTENCE_END.search(atom) else WORD
    return out, forced


def _inside(stretch: str, room: int, counts: Counter) -> Iterator[str]:
    """Parts of a stretch of at most ``room`` tokens, cut behind a sign where one is near."""
    at = 0
    while at < len(stretch):
        # a character is a token at most four times, so the first guess is short enough to be counted cheaply
        end = min(len(stretch), at + 4 * room)
        n = counts.count(stretch[at:end])
        while n > room:
            end = at + max(1, min(end - at - 1, (end - at) * room // n))
            n = counts.count(stretch[at:end])
            if end - at == 1:
                break
        if end < len(stretch):
            signs = [m.end() for m in _GOOD_INSIDE.finditer(stretch, at + (end - at) // 2, end)]
            end = signs[-1] if signs else end
        yield stretch[at:end]
        at = end


def tree_chunks(sizes: list[int], ranks: list[float], room: int, first: int | None = None) -> list[tuple[int, int]]:
    """Ranges of units, each within ``room`` where its units allow, merged bottom-up along the tree that ``ranks`` describe.

    A node that fits is whole; neighbours that are whole are merged while they
    fit.  A node that is too large is opened, and what comes of it is never
    joined with its siblings: no range holds a boundary stronger than one that
    was cut within it.  The range that begins the text may hold ``first``.
    """
    to = [0, *accumulate(sizes)]
    first = room if first is None else first
    fits = lambda lo, hi: to[hi] - to[lo] <= (room if lo else first)
    chunks: list[tuple[int, int]] = []
    pending = [(0, len(sizes))]
    while pending:
        lo, hi = pending.pop()
        if fits(lo, hi) or hi - lo == 1:
            chunks.append((lo, hi))
            continue
        level = min(ranks[lo + 1 : hi])
        starts = [lo, *(i for i in range(lo + 1, hi) if ranks[i] <= level), hi]
        merged: list[tuple[int, int]] = []
        whole = False
        for a, b in zip(starts, starts[1:]):
            alone = fits(a, b)
            if whole and alone and fits(merged[-1][0], b):
                merged[-1] = (merged[-1][0], b)
            else:
                merged.append((a, b))
            whole = alone
        pending += reversed(merged)
    return chunks


def _overlap(units: list[Unit], end: int, floor: int, wanted: int, most: int, counts: Counter) -> tuple[int, int, bool]:
    """(characters, tokens, whether it starts within a word) to repeat of the units before ``end``, not reaching below unit ``floor``."""
    chars = tokens = 0
    wanted = min(wanted, most)
    i = end - 1
    while i >= floor and tokens < wanted:
        text, n, _ = units[i]
        if tokens + n <= wanted:
            chars, tokens = chars + len(text), tokens + n
        else:
            for atom in reversed(ATOMS.findall(text)):
                if tokens >= wanted:
                    break
                n = counts[atom]
                if tokens + n <= min(wanted + SLACK, most):
                    chars, tokens = chars + len(atom), tokens + n
                else:
                    # within a long word: the shortest tail with the tokens still wanted
                    low, high = 1, len(atom)
                    while low < high:
                        middle = (low + high) // 2
                        if counts.count(atom[-middle:]) >= wanted - tokens:
                            high = middle
                        else:
                            low = middle + 1
                    while low > 1 and counts.count(atom[-low:]) > min(wanted + SLACK, most) - tokens:
                        low -= 1
                    n = counts.count(atom[-low:])
                    if tokens + n <= most:
                        chars, tokens = chars + low, tokens + n
                    return chars, tokens, True
        i -= 1
    return chars, tokens, False


def split_text(text: str | None, limit: int, overlap: int, counts: Counter) -> list[tuple[int, int, int, int, int, str, bool]]:
    """(start, new_from, end, tokens, overlap tokens, cut, forced) of each piece, in order; offsets in characters.

    ``start`` is where the overlap begins, ``new_from`` where the piece goes
    beyond the one before; the parts ``text[new_from:end]`` joined are the text.
    """
    if not text:
        return []
    units = _line_units(text, counts)
    total = sum(n for _, n, _ in units)
    if total <= limit:
        return [(0, 0, len(text), total, 0, "end", False)]
    room = max(1, limit - overlap - SLACK)
    opened: list[Unit] = []
    inside: set[int] = set()
    for unit in units:
        if unit[1] <= room:
            opened.append(unit)
        else:
            parts, forced = _open(unit, room, limit, counts)
            if forced:
                inside.update(len(opened) + i for i, p in enumerate(parts) if p[2] == INSIDE)
            opened += parts
    ranks = [r for _, _, r in opened]
    # the first piece repeats nothing
    chunks = tree_chunks([n for _, n, _ in opened], ranks, room, limit)
    at = [0, *accumulate(len(t) for t, _, _ in opened)]
    broken = INSIDE in ranks
    pieces = []
    last_start = 0
    for k, (lo, hi) in enumerate(chunks):
        own = sum(n for _, n, _ in opened[lo:hi])
        chars = shared = 0
        n, torn = own, broken and INSIDE in ranks[lo:hi]
        if k and overlap:
            # the piece before is repeated with its own overlap, but not beyond it
            chars, shared, within = _overlap(opened, lo, bisect_right(at, last_start) - 1, overlap, limit - own, counts)
            beyond = chars > at[lo] - last_start
            chars = min(chars, at[lo] - last_start)
            n, torn = own + shared, torn or within or beyond or (broken and INSIDE in ranks[bisect_right(at, at[lo] - chars) - 1 : lo])
        if torn:
            # tokens need not add up where a word is cut
            n = counts.count(text[at[lo] - chars : at[hi]])
            while chars and n > limit:
                chars -= 1 + chars // 8
                n = counts.count(text[at[lo] - chars : at[hi]])
            shared = counts.count(text[at[lo] - chars : at[lo]])
        cut = "end" if hi == len(opened) else name_of(ranks[hi])
        pieces.append((at[lo] - chars, at[lo], at[hi], n, shared, cut, hi in inside))
        last_start = at[lo] - chars
    return pieces


_PIECE_FIELDS = [
    ("piece", T.IntegerType(), pa.int32()),
    ("start", T.LongType(), pa.int64()),
    ("new_from", T.LongType(), pa.int64()),
    ("end", T.LongType(), pa.int64()),
    ("n_tokens", T.IntegerType(), pa.int32()),
    ("overlap_tokens", T.IntegerType(), pa.int32()),
    ("cut", T.StringType(), pa.string()),
    ("forced", T.BooleanType(), pa.bool_()),
]


def split_texts(df: DataFrame, keys: dict[str, Column], text: str, limit: int, overlap: int, vocabulary: str = DEFAULT_VOCABULARY, with_text: bool = True) -> DataFrame:
    """The pieces of each text: the ``keys``, ``piece`` (from 0), offsets, ``n_tokens``, ``overlap_tokens``, ``cut``, ``forced`` and ``text``.

    A text within ``limit`` tokens is one piece.  ``cut`` names the boundary at
    the piece's end: 'heading', 'paragraph', 'line', 'sentence', 'word',
    'inside' or 'end'.  ``forced`` marks a cut inside a stretch free of white
    space that alone exceeds the limit.  No piece exceeds ``limit``, its
    overlap included; where a word leaves too little room the overlap is
    shorter.  Null and empty texts have no pieces, blank ones do; CRLF ends a
    line; repeated rows are split each; an empty table gives no rows.
    """
    if limit < 1 or overlap < 0 or overlap >= limit:
        raise ValueError("the limit is positive and larger than the overlap")
    small = df.select(*(c.alias(k) for k, c in keys.items()), F.col(text).alias("_text")).filter("_text is not null and _text <> ''")
    key_fields = small.drop("_text").schema.fields
    sent = ship(df.sparkSession, vocabulary)
    schema = T.StructType([*key_fields, *(T.StructField(n, t) for n, t, _ in _PIECE_FIELDS), *([T.StructField("text", T.StringType())] if with_text else [])])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(vocabulary, sent)

        def emit() -> pa.RecordBatch:
            columns = batch.select(range(batch.num_columns - 1)).take(pa.array(origin, pa.int32())).columns
            columns += [pa.array(c, t) for c, (_, _, t) in zip(zip(*rows), _PIECE_FIELDS)]
            return pa.RecordBatch.from_arrays([*columns, *([pa.array(texts, pa.string())] if with_text else [])], names=schema.names)

        for batch in batches:
            rows: list[tuple] = []
            origin: list[int] = []
            texts: list[str] = []
            held = 0
            for i, whole in enumerate(batch.column(batch.num_columns - 1)):
                whole = whole.as_py()
                for k, piece in enumerate(split_text(whole, limit, overlap, counts)):
                    rows.append((k, *piece))
                    origin.append(i)
                    if with_text:
                        texts.append(whole[piece[0] : piece[2]])
                        held += len(texts[-1])
                if len(rows) > 5_000 or held > 8_000_000:
                    yield emit()
                    rows, origin, texts, held = [], [], [], 0
            if rows:
                yield emit()

    return small.mapInArrow(run, schema)
