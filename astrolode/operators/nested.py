"""Related flat tables with parent-child links from texts that hold nested JSON, of any depth and of more than one shape."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.json_events import ARRAY, OBJECT, Malformed, events

UNREADABLE = "unreadable"

#: Columns of one table, at most; leaves beyond these stand in a map.
MOST_COLUMNS = 500


@dataclass(frozen=True)
class Shape:
    """A list that comes in more than one writing, and the lists within its elements.

    label: its name in paths. wrappers: keys of an object that wraps the list. name: the keys that name an element, the
    first present wins; the value may be an object with its own such key. under: keys of an element of the list around
    it under which it lies. inner: the lists in its elements. plain_list: a text that does not begin like JSON is a
    comma-separated list of trimmed names. Lists that no shape tells of are told by their keys.
    """

    label: str
    wrappers: tuple[str, ...] = ()
    name: tuple[str, ...] = ("name",)
    under: tuple[str, ...] = ()
    inner: tuple[Shape, ...] = ()
    plain_list: bool = False

    @cached_property
    def lists(self) -> frozenset[str]:
        """Keys whose value is a list, or stands for one."""
        return frozenset(self.wrappers + self.under).union(*[s.lists for s in self.inner])

    @cached_property
    def below(self) -> dict[str, Shape]:
        return {key: shape for shape in self.inner for key in shape.under}

    @cached_property
    def names(self) -> tuple[str, ...]:
        """Leaves that may hold the name of an element, in their order; '' is the element itself."""
        return tuple(dict.fromkeys(["", *[x for n in self.name for x in (n, *[f"{n}.{m}" for m in (*self.name, "name")])]]))

    def levels(self, above: str = "") -> dict[str, Shape]:
        """This shape and those within it, by their ancestors."""
        at = f"{above}.{self.label}" if above else self.label
        return {at: self} | {k: v for s in self.inner for k, v in s.levels(at).items()}


#: ancestor (the lists around a leaf, joined by points), ordinals (one for each of them), leaf, value
Triple = tuple[str, tuple[int, ...], str, str | None]


def _like_json(text: str) -> bool:
    head = text.lstrip(" \t\n\r")
    return head[:1] in ("[", "{", '"') or head.rstrip(" \t\n\r") in ("null", "true", "false")


def _value(value: object) -> str | None:
    return value[0] if isinstance(value, tuple) else value


def triples(text: str, shape: Shape) -> list[Triple]:
    """A text as (repeated ancestor and its ordinals, leaf, value), one triple per leaf.

    The leaf '' says that the element is there, with its value if it is a bare one; others are the paths of keys from
    the element, joined by points. Strings in the place of a list or an element that hold JSON are read as what they
    hold. Null elements and null leaves give no triple. Raises Malformed.
    """
    if not text.strip():
        return []
    if not _like_json(text):
        parts = text.split(",") if shape.plain_list else [text]
        return [(shape.label, (i,), "", part.strip()) for i, part in enumerate(parts)]
    found = _Leaves(shape)
    for path, value in events(text):
        if isinstance(value, str) and not path:
            return triples(value, shape)
        if isinstance(value, str) and (isinstance(path[-1], int) or path[-1] in shape.lists) and _like_json(value):
            try:
                inside = list(events(value))
            except Malformed:
                if path[-1] in shape.lists:
                    raise
                inside = [((), value)]
            for step, held in inside:
                found.add((*path, *step), held)
        else:
            found.add(path, value)
    return found.triples()


class _Leaves:
    """Groups paths by their repeated ancestors, whether lists are wrapped, single or plain."""

    def __init__(self, shape: Shape):
        self.shape = shape
        self.out: list[tuple[Triple, list[tuple]]] = []
        self.wrapped: set[tuple] = set()  # the places of lists that an object wraps

    def add(self, path: tuple, value: object) -> None:
        shape, labels, ordinals, i, bare = self.shape, [], [], 0, []
        while True:
            place = (*labels, shape.label, *ordinals)
            if i < len(path) and path[i] in shape.wrappers:
                self.wrapped.add(place)
                i += 1
            else:
                bare.append(place)
            labels.append(shape.label)
            listed = i < len(path) and isinstance(path[i], int)
            ordinals.append(path[i] if listed else 0)
            i += listed
            if i == len(path) or path[i] not in shape.below:
                break
            shape = shape.below[path[i]]
            i += 1
        leaf: list[str] = []
        for step in path[i:]:  # what no shape tells of
            if isinstance(step, int):
                labels.append(".".join(leaf) or "list")
                ordinals.append(step)
                leaf = []
            else:
                leaf.append(step)
        if value is ARRAY or value is None or value is OBJECT and leaf:
            return
        self.out.append(((".".join(labels), tuple(ordinals), ".".join(leaf), None if value is OBJECT else _value(value)), bare))

    def triples(self) -> list[Triple]:
        if not self.wrapped:
            return [t for t, _ in self.out]
        return [t for t, bare in self.out if not any(place in self.wrapped for place in bare)]


_TRIPLES = "key long, field string, version long, ancestor string, ordinals array<int>, leaf string, value string"


def explode_triples(texts: DataFrame, shapes: dict[str, Shape], wanted: Callable[[str, str, str], bool] | None = None) -> DataFrame:
    """Triples of all texts: key, field, version (tells different texts of one key apart), ancestor, ordinals, leaf, value.

    texts: key, field (a key of shapes), text. A malformed text gives one triple without ancestor, with the value
    'unreadable'. wanted: tells by field, ancestor and leaf which triples are made.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str, str], bool] = {}
        for batch in batches:
            rows, size = [], 0
            for key, field, version, text in zip(*(batch.column(c).to_pylist() for c in ("key", "field", "version", "text")), strict=True):
                try:
                    got = triples(text, shapes[field])
                except Malformed:
                    got = [("", (), "", UNREADABLE)]
                for t in got:
                    at = (field, t[0], t[2])
                    if wanted is None or known.setdefault(at, not t[0] or wanted(*at)):
                        rows.append((key, field, version, *t))
                size += len(text)
                if size > 1 << 23:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)

    versioned = texts.select("key", "field", F.xxhash64("text").alias("version"), "text").where("key IS NOT NULL AND text IS NOT NULL")
    return versioned.mapInArrow(read, _TRIPLES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.string()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "field", "version", "ancestor", "ordinals", "leaf", "value"])


def paths(texts: DataFrame, shapes: dict[str, Shape]) -> DataFrame:
    """field, ancestor, leaf and n, the number of elements that have it: the columns of all tables that tables() gives."""
    return explode_triples(texts, shapes).where("ancestor <> ''").groupBy("field", "ancestor", "leaf").agg(F.count(F.lit(1)).alias("n"))


def tables(texts: DataFrame, shapes: dict[str, Shape], *, columns: dict[tuple[str, str], list[str]] | None = None, most: int = MOST_COLUMNS) -> dict[tuple[str, str], DataFrame]:
    """One table for each field and repeated ancestor, of whatever depth: its elements with all their leaves.

    Columns: key, version (tells different texts of one key apart), parent (the ordinals of the element around it, which
    with key and version is that element's ordinals in the table of the ancestor before; empty for the outermost),
    ordinals (its own, the last of them its position), bare (the value of an element that is no object), and
    one column per leaf, under its path; a path that is the name of another column, up to letter case, gets ~2, ~3 and so
    on behind it. Elements that have no leaf at all have a row with nulls.

    columns: the leaves of each table; without it the texts are read once to find them. Leaves beyond the ``most``
    first ones, in their order, and those that columns doesn't name, stand in the map ``others``. Malformed texts give
    no rows here; flatten() reports them.
    """
    if columns is None:
        columns = {}
        for r in paths(texts, shapes).select("field", "ancestor", "leaf").orderBy("field", "ancestor", "leaf").limit(most * 20).collect():
            columns.setdefault((r["field"], r["ancestor"]), []).append(r["leaf"])
    held = explode_triples(texts, shapes)
    out = {}
    for (field, ancestor), leaves in columns.items():
        named = [x for x in leaves if x][:most]
        mine = held.where((F.col("field") == field) & (F.col("ancestor") == ancestor))
        pick = [F.max(F.when(F.col("leaf") == x, F.col("value"))).alias(f"leaf{i}") for i, x in enumerate(["", *named])]
        rest = F.collect_set(F.when(~F.col("leaf").isin("", *named), F.struct("leaf", "value")))
        wide = mine.groupBy("key", "version", "ordinals").agg(*pick, rest.alias("rest"))
        keys = F.array_distinct(F.transform("rest", lambda x: x["leaf"]))
        others = F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter("rest", lambda x: x["leaf"] == k)[0]["value"]))
        taken = {"key", "version", "parent", "ordinals", "bare", "others"}
        own = [F.col(f"leaf{i}").alias(_free(x, taken)) for i, x in enumerate(named, 1)]
        parent = F.slice("ordinals", 1, F.size("ordinals") - 1).alias("parent")
        out[field, ancestor] = wide.select("key", "version", parent, "ordinals", F.col("leaf0").alias("bare"), *own, F.when(F.size("rest") > 0, others).alias("others"))
    return out


def _free(name: str, taken: set[str]) -> str:
    n, out = 1, name
    while out.lower() in taken:
        n += 1
        out = f"{name}~{n}"
    taken.add(out.lower())
    return out


def flatten(texts: DataFrame, shapes: dict[str, Shape]) -> DataFrame:
    """Distinct elements of the outer lists and of the lists within: key, field, parent_pos, child_pos (-1: outer), item.

    1. Each text is read as a stream of (path, value, ordinals); it is never built as a whole.
    2. Paths are grouped by their repeated ancestors: the outer list, and the list within each of its elements.
    3. The triples of one element are pivoted into one row; its item is the first name that it has, '' without any.
       Of the leaves only names are made here; tables() has all of them, and deeper ancestors.

    Null and blank texts, JSON null and empty lists give no rows; a null element keeps its place and gives none. Texts
    that begin like JSON but are malformed give one row with positions -1 and the item 'unreadable'. Rows without key
    are left out. Partial aggregation merges the triples of an element before they move.
    """
    levels = {(field, at): s for field, shape in shapes.items() for at, s in shape.levels().items() if at.count(".") <= 1}
    leaves = list(dict.fromkeys([x for s in levels.values() for x in s.names]))
    held = explode_triples(texts, shapes, lambda field, ancestor, leaf: (field, ancestor) in levels and leaf in levels[field, ancestor].names)
    wide = held.groupBy("key", "field", "version", "ancestor", "ordinals").agg(*[F.max(F.when(F.col("leaf") == leaf, F.col("value"))).alias(f"leaf{i}") for i, leaf in enumerate(leaves)])
    item = F.when(F.col("ancestor") == "", F.col(f"leaf{leaves.index('')}"))
    for (field, at), shape in levels.items():
        item = item.when((F.col("field") == field) & (F.col("ancestor") == at), F.coalesce(*[F.col(f"leaf{leaves.index(x)}") for x in shape.names], F.lit("")))
    at = lambda i: F.coalesce(F.get("ordinals", F.lit(i)), F.lit(-1))
    return wide.select("key", "field", at(0).alias("parent_pos"), at(1).alias("child_pos"), item.alias("item")).distinct()
