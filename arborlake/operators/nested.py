"""Deeply nested semi-structured records as related flat tables.

Each payload is parsed as a stream of triples of path, value and ordinal; the
triples are grouped by their repeated ancestors, as a ``Shape`` names them, and
each group is pivoted into one row that names its parent.  A path is a chain of
links to the enclosing containers, so a triple costs the same at any depth, and
no more than the open containers and the rows are ever held.  A record is whole
within one task, so parsing, grouping and pivoting need no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE, _PLAIN = r"[ \t\n\r]*+", r'"([^"\\\x00-\x1f]*+)"'
_SCALAR = rf"(?:{_PLAIN}|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)|(true|false|null)|([{{\[]))"
# A whole member or element at a time; what has escapes or is at fault is left to the slow steps.
_MEMBER = re.compile(rf"{_SPACE}{_PLAIN}{_SPACE}:{_SPACE}{_SCALAR}")
_NEXT_MEMBER = re.compile(rf"{_SPACE},{_SPACE}{_PLAIN}{_SPACE}:{_SPACE}{_SCALAR}")
_ELEMENT = re.compile(rf"{_SPACE}(){_SCALAR}")
_NEXT_ELEMENT = re.compile(rf"{_SPACE},{_SPACE}(){_SCALAR}")
_BLANKS = re.compile(_SPACE)
_WORDS = {"true": True, "false": False, "null": None}
_STRING, _NUMBER, _WORD, _OPENING = range(2, 6)


class NotJson(ValueError):
    pass


class Place:
    """A container and the way to it: the place of the container around it and the member name or list position there."""

    __slots__ = ("up", "step", "is_list", "state", "row")

    def __init__(self, up: Place | None, step: str | int | None, is_list: bool):
        self.up, self.step, self.is_list = up, step, is_list
        # what the reader of the triples knows of it
        self.state = self.row = None

    def path(self) -> tuple[str | int, ...]:
        steps, place = [], self
        while place is not None:
            if place.step is not None:
                steps.append(place.step)
            place = place.up
        return tuple(reversed(steps))


Triple = tuple[Place | None, str | int | None, object, int]


def json_triples(text: str, lenient: bool = False, up: Place | None = None, at: str | int | None = None) -> Iterator[Triple]:
    """(place, step, value, ordinal) of every object, list and scalar of a JSON text, in document order.

    The path of a value is that of its ``place`` and the ``step`` from there;
    the ordinal is the position among the siblings; objects and lists are
    given as their own ``Place``.  ``lenient`` passes over a comma right before
    a closing bracket or brace.  Of members with the same name each is given.
    Raises ``NotJson``, possibly after some triples.
    """
    value, i = _slow_value(text, _BLANKS.match(text, 0).end(), up, at)
    yield up, at, value, 0
    stack: list[tuple[Place, int]] = []
    place, count = (value, 0) if value.__class__ is Place else (None, 0)
    while place is not None:
        is_list = place.is_list
        first, later = (_ELEMENT, _NEXT_ELEMENT) if is_list else (_MEMBER, _NEXT_MEMBER)
        found = (later if count else first).match(text, i)
        while found:
            kind = found.lastindex
            step = count if is_list else found[1]
            if kind == _STRING:
                yield place, step, found[2], count
            elif kind == _NUMBER:
                yield place, step, _number(found[3]), count
            elif kind == _WORD:
                yield place, step, _WORDS[found[4]], count
            else:
                inner = Place(place, step, found[5] == "[")
                yield place, step, inner, count
                stack.append((place, count + 1))
                place, count, i = inner, 0, found.end()
                break
            count += 1
            i = found.end()
            found = later.match(text, i)
        if found:
            continue
        # no plain member follows: the container ends, or something is escaped or at fault
        closing = "]" if is_list else "}"
        i = _BLANKS.match(text, i).end()
        sign = text[i : i + 1]
        if sign == ",":
            after = _BLANKS.match(text, i + 1).end()
            if text[after : after + 1] == closing:
                if not lenient:
                    raise NotJson(f"a comma before {closing} at {i}")
                i, sign = after, closing
            elif count:
                i, sign = after, ""
        elif not count and sign != closing:
            sign = ""
        if sign == closing:
            i += 1
            place, count = stack.pop() if stack else (None, 0)
            continue
        if sign:
            raise NotJson(f"neither comma nor {closing} at {i}")
        if is_list:
            step = count
        else:
            step, i = _string(text, i)
            i = _BLANKS.match(text, i).end()
            if text[i : i + 1] != ":":
                raise NotJson(f"no colon at {i}")
            i = _BLANKS.match(text, i + 1).end()
        value, i = _slow_value(text, i, place, step)
        yield place, step, value, count
        if value.__class__ is Place:
            stack.append((place, count + 1))
            place, count = value, 0
        else:
            count += 1
    i = _BLANKS.match(text, i).end()
    if i != len(text):
        raise NotJson(f"more text at {i}")


_ANY = re.compile("()" + _SCALAR)


def _slow_value(text: str, i: int, up: Place | None, step: str | int | None) -> tuple[object, int]:
    found = _ANY.match(text, i)
    if not found:
        return _string(text, i)
    kind, end = found.lastindex, found.end()
    if kind == _STRING:
        return found[2], end
    if kind == _NUMBER:
        return _number(found[3]), end
    if kind == _WORD:
        return _WORDS[found[4]], end
    return Place(up, step, found[5] == "["), end


def _string(text: str, i: int) -> tuple[str, int]:
    if text[i : i + 1] != '"':
        raise NotJson(f"no value or name at {i}")
    try:
        return scanstring(text, i + 1, True)
    except ValueError as e:
        raise NotJson(str(e)) from None


def _number(digits: str) -> int | str:
    """Whole numbers of up to 18 digits as such, others as they are written."""
    return int(digits) if len(digits) <= 18 and digits.lstrip("-").isdigit() else digits


def read_triples(text: str, up: Place | None = None, at: str | int | None = None) -> list[Triple] | None:
    """All triples of a short text that is JSON, strictly or but for commas before a closing sign; else None.

    A string that itself holds JSON stands for what it holds.
    """
    for lenient in (False, True):
        try:
            triples = list(json_triples(text, lenient, up, at))
        except NotJson:
            continue
        inner = _held(triples[0][2], text) if len(triples) == 1 else None
        return triples if inner is None else read_triples(inner, up, at) or triples
    return None


def _held(value: object, text: str) -> str | None:
    """The text itself if a string may hold JSON."""
    if isinstance(value, str) and value != text and value.lstrip(" \t\n\r")[:1] in ("{", "[", '"'):
        return value
    return None


@dataclass(frozen=True)
class Shape:
    """One table of the result and where its rows are found.

    ``fields``: canonical member path, dots between the names, to column type.
    ``single``: member path to the shape of an object that occurs once.
    ``repeated``: member path to (shape, field): a list of objects, or an
    object whose member names stand for ``field``.
    ``key``: the field that names a row to its descendants.
    ``text``: members that may hold JSON in a string.
    ``anywhere``: the rows lie below unknown wrappers; an object is a row if it has any of these members.
    """

    name: str
    fields: Mapping[str, str]
    single: Mapping[str, Shape] = field(default_factory=dict)
    repeated: Mapping[str, tuple[Shape, str]] = field(default_factory=dict)
    key: str | None = None
    text: frozenset[str] = frozenset()
    anywhere: frozenset[str] = frozenset()
    recursive: tuple[str, str] | None = None  # (member, key field): children of the same shape

    @cached_property
    def children(self) -> dict[str, tuple[Shape, str | None, bool]]:
        out = {k: (s, None, False) for k, s in self.single.items()} | {k: (s, f, True) for k, (s, f) in self.repeated.items()}
        return out | ({self.recursive[0]: (self, self.recursive[1], True)} if self.recursive else {})

    def shapes(self) -> dict[str, Shape]:
        out = {self.name: self}
        for shape, _, _ in self.children.values():
            if shape.name not in out:
                out |= shape.shapes()
        return out


@lru_cache(maxsize=100_000)
def canonical(name: str) -> str:
    """A member name in camelCase; names in snake_case are rewritten."""
    if "_" not in name:
        return name
    head, *rest = name.strip("_").split("_")
    return head + "".join(x[:1].upper() + x[1:] for x in rest)


class Row:
    """One row of a flat table; ``near`` is the closest enclosing row that has a key."""

    __slots__ = ("shape", "number", "parent", "near", "top", "depth", "ordinal", "values")

    def __init__(self, shape: Shape, number: int, parent: Row | None, ordinal: int):
        self.shape, self.number, self.parent, self.ordinal, self.values = shape, number, parent, ordinal, {}
        self.near = None if parent is None else parent if parent.shape.key else parent.near
        self.top = self if parent is None else parent.top
        self.depth = 0 if self.near is None else self.near.depth + 1

    def key(self) -> object:
        return self.values.get(self.shape.key)


def shred(text: str | None, root: Shape) -> list[Row]:
    """The rows of one payload, parents before children; none if it can't be read."""
    while text is not None:
        held = None
        for lenient in (False, True):
            rows: list[Row] = []
            try:
                only = _group(json_triples(text, lenient), root, rows)
            except NotJson:
                continue
            if not isinstance(only, str):
                return rows
            held = _held(only, text)
            break
        text = held
    return []


def _group(triples: Iterable[Triple], root: Shape, rows: list[Row]) -> object:
    """Add the rows that the triples make to ``rows``; the first value, for texts that are one scalar."""
    # state of a container that is looked at: its row (none among wrappers), the member path below the row, what its elements are
    anywhere = root.anywhere
    top = None

    def visit(place: Place | None, step: str | int | None, value: object, ordinal: int) -> None:
        container = value.__class__ is Place
        if place is None:
            if container:
                value.state = (None, "", None)
            return
        owner, below, members = place.state
        if members is not None:  # an element of a repeated container
            shape, keyed = members
            is_object = container and not value.is_list
            if is_object or step.__class__ is str:
                row = Row(shape, len(rows), owner, ordinal)
                rows.append(row)
                if keyed and step.__class__ is str:
                    row.values[keyed] = step
                if is_object:
                    value.state = (row, "", None)
            return
        named = step.__class__ is str
        name = canonical(step) if named else None
        if owner is None:  # among the wrappers
            if named and name in anywhere:
                owner = place.row
                if owner is None:
                    owner = place.row = Row(root, len(rows), None, place.step if place.step.__class__ is int else 0)
                    rows.append(owner)
            else:
                if container:
                    value.state = (None, "", None)
                return
        elif not named:
            return  # an element of a list that is no table
        if below:
            name = f"{below}.{name}"
        shape = owner.shape
        if not container:
            if value.__class__ is str and name in shape.text:
                inner = read_triples(value, place, step)
                if inner and inner[0][2].__class__ is Place:
                    for triple in inner:
                        if triple[0] is place or triple[0].state is not None:
                            visit(*triple)
                    return
            if value is not None and name in shape.fields:
                owner.values[name] = value
            return
        child = shape.children.get(name)
        if child is None:
            if not value.is_list:
                value.state = (owner, name, None)
            return
        inner_shape, keyed, many = child
        if many:
            value.state = (owner, "", (inner_shape, keyed))
        elif not value.is_list:
            row = Row(inner_shape, len(rows), owner, 0)
            rows.append(row)
            value.state = (row, "", None)

    for triple in triples:
        place = triple[0]
        if place is None:
            top = triple[2]
            visit(*triple)
        elif place.state is not None:
            visit(*triple)
    return top


def _text(value: object) -> str | None:
    if value.__class__ is str:
        return value if value.isascii() else value.encode("utf-8", "replace").decode()
    if value is None:
        return None
    if value is True or value is False:
        return "true" if value else "false"
    return str(value)


_NODES = pa.schema(
    [
        ("table", pa.string()), ("row_id", pa.int64()), ("parent_table", pa.string()), ("parent_id", pa.int64()), ("ordinal", pa.int64()), ("depth", pa.int32()),
        ("top_key", pa.string()), ("above_key", pa.string()), ("owner_key", pa.string()), ("values", pa.list_(pa.string())),
    ]
)
_NODE_DDL = "table string, row_id bigint, parent_table string, parent_id bigint, ordinal bigint, depth int, top_key string, above_key string, owner_key string, values array<string>"


def shred_records(df: DataFrame, keys: Sequence[str], payload: str, root: Shape, tables: Sequence[str] | None = None) -> DataFrame:
    """The rows of the named tables, all by default: the ``keys`` of the record, ``table``, ``row_id``, ``parent_table``, ``parent_id``, ``ordinal``,
    ``depth``, ``top_key``, ``above_key``, ``owner_key``, ``values``.

    ``row_id`` counts the rows of all tables within the payload, so the rows of
    a record's copies agree and can be made one by (keys, row_id), and the
    tables fit together whichever are asked for.  ``owner_key`` is the key of
    the closest enclosing row that has one, ``above_key`` that of the one
    around it, ``top_key`` that of the outermost row; ``depth`` counts the
    enclosing rows with keys.  ``values`` are the fields in the order of the
    shape.  Payloads that are null, empty, cut off or no JSON give no rows;
    null and missing fields are null; a repeated object without members is a
    row with null fields; of members of the same name the last counts; an
    empty table gives no rows.
    """
    schema = T.StructType([*df.select(*keys).schema.fields, *T._parse_datatype_string(_NODE_DDL).fields])
    wanted = None if tables is None else frozenset(tables)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            origin: list[int] = []
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                for row in shred(text.as_py(), root):
                    shape = row.shape
                    if wanted is not None and shape.name not in wanted:
                        continue
                    parent, near, values = row.parent, row.near, row.values
                    above = near and near.near
                    out.append(
                        (
                            shape.name, row.number, parent and parent.shape.name, parent and parent.number, row.ordinal, row.depth,
                            _text(row.top.key()), _text(above.key()) if above else None, _text(near.key()) if near else None, [_text(values.get(f)) for f in shape.fields],
                        )
                    )
                    origin.append(i)
                if len(out) > 20_000:
                    yield _node_batch(batch, origin, out)
                    out, origin = [], []
            if out:
                yield _node_batch(batch, origin, out)

    return df.select(*keys, payload).mapInArrow(run, schema)


def _node_batch(batch: pa.RecordBatch, origin: list[int], rows: list[tuple]) -> pa.RecordBatch:
    keys = batch.select(range(batch.num_columns - 1)).take(pa.array(origin, pa.int32()))
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _NODES)]
    return pa.RecordBatch.from_arrays([*keys.columns, *columns], names=[*keys.schema.names, *_NODES.names])


def flat_table(nodes: DataFrame, keys: Sequence[str], shape: Shape) -> DataFrame:
    """One table of ``shred_records``: the record's keys, ``row_id``, ``parent_id``, ``ordinal`` and the shape's typed fields.

    Copies of a record are made one.  A value that isn't of the field's type is null.
    """
    names = {f: re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", f.rsplit(".", 1)[-1]).lower() for f in shape.fields}
    typed = [F.expr(f"try_cast(values[{i}] as {kind})").alias(names[f]) for i, (f, kind) in enumerate(shape.fields.items())]
    return nodes.filter(F.col("table") == shape.name).dropDuplicates([*keys, "row_id"]).select(*keys, "row_id", "parent_table", "parent_id", "ordinal", *typed)
