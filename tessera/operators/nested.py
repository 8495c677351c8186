"""Deeply nested records turned into flat tables that keep parent-child links.

A bottom-up tree automaton gives every JSON value a state: its kind, and for containers the states of what they hold.
A state is a hash of its shape, so all workers name equal shapes alike without talking to each other. Rules name the
subtypes of objects by the members they need and by the subtypes of these; a state is of one subtype, which is found
once for each state, and rows are routed by it. Every value becomes one row of a supertype table (record, path, parent
path, key, position, kind, state, subtype, owner, route, places, value), from which the typed tables are drawn.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "path string, parent_path string, key string, pos int, level int, kind string, state string, value string, subtype string, owner string, route string, places array<int>"

#: Subtypes by name: the members an object needs, each with the subtype that it or an item of it must have (None: any).
Rules = dict[str, dict[str, str | None]]


def _reject(_: str) -> None:
    raise ValueError("not JSON")


_decode = json.JSONDecoder(parse_constant=_reject)
_SPACE = re.compile(r"[ \t\n\r]*")


def _deep(text: str):
    """The value of a JSON text of any depth: containers are kept on a list instead of the call stack."""
    stack: list = []  # open containers, each with the key that waits for a value
    at, value, done = _SPACE.match(text).end(), None, False
    while True:
        if not done:
            c = text[at : at + 1]
            if c in ("{", "["):
                stack.append([{} if c == "{" else [], None])
                at = _SPACE.match(text, at + 1).end()
                if text[at : at + 1] == ("}" if c == "{" else "]"):
                    value, done, at = stack.pop()[0], True, at + 1
                elif c == "{":
                    at = _member(text, at, stack[-1])
                continue
            value, at = _decode.raw_decode(text, at)
            done = True
        at = _SPACE.match(text, at).end()
        if not stack:
            if at != len(text):
                raise ValueError("text after JSON")
            return value
        box, key = stack[-1]
        if isinstance(box, dict):
            box[key] = value
        else:
            box.append(value)
        c, at = text[at : at + 1], _SPACE.match(text, at + 1).end()
        if c == ",":
            done = False
            if isinstance(box, dict):
                at = _member(text, at, stack[-1])
        elif c == ("}" if isinstance(box, dict) else "]"):
            value = stack.pop()[0]
        else:
            raise ValueError("not JSON")


def _member(text: str, at: int, top: list) -> int:
    if text[at : at + 1] != '"':
        raise ValueError("not JSON")
    top[1], at = _decode.raw_decode(text, at)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError("not JSON")
    return _SPACE.match(text, at + 1).end()


def _load(text: str):
    try:
        return json.loads(text, parse_constant=_reject)
    except RecursionError:
        return _deep(text)


def parse(text: str | None):
    """The value of a JSON text, read through texts that hold JSON; (False, None) if null, empty or unreadable."""
    if text is None or not text.strip():
        return False, None
    try:
        v = _load(text)
        while isinstance(v, str):  # each is shorter than the text around it
            v = _load(v)
    except ValueError:
        return False, None
    return True, v


def _inside(v):
    """A string value that is itself the JSON text of an object or list, however often wrapped, as that value."""
    w = v
    while isinstance(w, str) and w.lstrip()[:1] in ("{", "[", '"'):
        try:
            w = _load(w)
        except ValueError:
            break
    return w if isinstance(w, (dict, list)) else v


def _kind(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, (int, float)):
        return "number"
    return "text" if isinstance(v, str) else "object" if isinstance(v, dict) else "list"


def _scalar(v, kind: str) -> str | None:
    return None if v is None else v if kind == "text" else json.dumps(v)


def _hash(*parts: str) -> str:
    return hashlib.blake2b("\x1f".join(parts).encode(), digest_size=8).hexdigest()


class Automaton:
    """Bottom-up: the state of a value follows from its kind and the states of its children, its subtype from its state."""

    def __init__(self, rules: Rules | None = None, limit: int = 100_000):
        self.seen: dict[tuple, tuple[str, frozenset]] = {}
        self.rules = rules or {}
        self.limit = limit

    def _of(self, kind: str, kids: tuple) -> tuple[str, frozenset]:
        """(state, subtypes) of a container by its children's (key, state, subtypes); those of a list are its items'."""
        shape = (kind, *kids)
        s = self.seen.get(shape)
        if s is None:
            if len(self.seen) >= self.limit:
                self.seen.clear()
            if kind == "list":
                types = frozenset().union(*(t for _, _, t in kids))
            else:
                has = {k: t for k, _, t in kids}
                name = next((n for n, need in self.rules.items() if all(m in has and (t is None or t in has[m]) for m, t in need.items())), None)
                types = frozenset() if name is None else frozenset([name])
            s = self.seen[shape] = _hash(kind, *(f"{k}\x1e{st}" if k is not None else st for k, st, _ in kids)), types
        return s

    def walk(self, top, under: tuple[str, ...] | None) -> list[list]:
        """Rows of NODE_SCHEMA in document order; `under` keeps only the parts below these top-level keys.

        The stack is explicit, so depth is bounded by memory alone.
        """
        plain = frozenset()
        root = _inside(top)
        k = _kind(root)
        rows: list[list] = [["", None, None, -1, 0, k, k, _scalar(root, k), None, None, "", []]]
        if k not in ("object", "list"):
            return rows
        ups = [-1]  # the parent's row number of each row
        # a frame: row number, children left to visit, (key, state, subtypes) of the children visited
        stack: list[tuple] = [(0, self._children(root, under), [])]
        while stack:
            at, it, kids = stack[-1]
            nxt = next(it, None)
            if nxt is None:
                stack.pop()
                r = rows[at]
                r[6], types = self._of(r[5], tuple(sorted(kids)) if r[5] == "object" else tuple(sorted(set(kids), key=lambda x: x[1])))
                if r[5] == "object":
                    r[8] = next(iter(types), None)
                if stack:
                    stack[-1][2].append((r[2], r[6], types))
                continue
            key, pos, v = nxt
            parent = rows[at]
            if type(v) is str and v[:1].strip() in ("{", "[", '"', ""):
                v = _inside(v)
            k = _kind(v)
            path = f"{parent[0]}[{pos}]" if key is None else f"{parent[0]}.{key}" if parent[0] else key
            row = [path, parent[0], key, pos, parent[4] + 1, k, k, None, None, None, None, None]
            rows.append(row)
            ups.append(at)
            if k in ("object", "list"):
                stack.append((len(rows) - 1, self._children(v, None), []))
            else:
                row[7] = _scalar(v, k)
                kids.append((key, k, plain))
        for row, up in zip(rows[1:], ups[1:]):  # downward, when all subtypes are known
            over = rows[up]
            if over[5] == "object":
                row[9], row[10], row[11] = over[8], f"{over[10]}/{over[8]}.{row[2]}" if self.rules else None, [*over[11], -1]
            else:
                row[9] = over[9]
                taken = over[11][-1:] in ([], [-1])  # the place in the list that a member holds
                row[10] = over[10] if taken else f"{over[10]}[]" if self.rules else None
                row[11] = [*over[11][:-1], row[3]] if taken and over[11] else [*over[11], row[3]]
        return rows

    @staticmethod
    def _children(v, under: tuple[str, ...] | None):
        if isinstance(v, dict):
            return iter([(str(k), -1, x) for k, x in v.items() if under is None or k in under])
        return iter([(None, i, x) for i, x in enumerate(v)])


def shred(df: DataFrame, ids: list[str], column: str, under: tuple[str, ...] | None = None, rules: Rules | None = None, routes: tuple[str, ...] | None = None, scalars: bool = False) -> DataFrame:
    """The supertype table: the ids and NODE_SCHEMA, one row per JSON value inside `column`.

    path joins keys by '.' and positions as [i]; the top value has path ''. pos is the place in a list, -1 for object
    members. level is the depth. value is a scalar's text (null for JSON null and for containers). subtype is that of
    an object, by `rules`; owner is that of the nearest object above. route names, for each object above, its subtype
    and the member taken ('/payload.runs/run.name'), and places has for each of these the position in the list that
    the member holds, or -1. Null, empty and unreadable JSON gives no row; JSON text inside JSON text is read through.
    An empty object or list is one row. Rows are never joined or shuffled: each record becomes its rows where it is
    read. `routes` keeps the rows of these routes only, `scalars` leaves containers out.
    """
    names = [f.split()[0] for f in NODE_SCHEMA.split(", ")]
    types = [pa.list_(pa.int32()) if n == "places" else pa.int32() if n in ("pos", "level") else pa.string() for n in names]
    kinds = [df.schema[i].dataType.simpleString() for i in ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Automaton(rules)
        for b in batches:
            take: list[int] = []
            out: list[list] = []
            texts = b.column(len(ids))
            for i in range(b.num_rows):
                ok, v = parse(texts[i].as_py())
                if ok:
                    rows = m.walk(v, under)
                    if routes is not None:
                        rows = [r for r in rows if r[10] in routes]
                    if scalars:
                        rows = [r for r in rows if r[5] not in ("object", "list")]
                    take.extend([i] * len(rows))
                    out.extend(rows)
                if out and (len(out) > 50_000 or i == b.num_rows - 1):
                    at = pa.array(take, pa.int32())
                    cols = [b.column(j).take(at) for j in range(len(ids))] + [pa.array(c, t) for c, t in zip(zip(*out), types)]
                    yield pa.RecordBatch.from_arrays(cols, names=[f"_id{j}" for j in range(len(ids))] + names)
                    take, out = [], []

    src = df.select(*[F.col(c).alias(f"_id{j}") for j, c in enumerate(ids)], F.col(column).cast("string").alias("_json")).where(F.col("_json").isNotNull())
    nodes = src.mapInArrow(run, ", ".join(f"_id{j} {k}" for j, k in enumerate(kinds)) + ", " + NODE_SCHEMA)
    return nodes.select(*[F.col(f"_id{j}").alias(c) for j, c in enumerate(ids)], *names)


def shred_typed(df: DataFrame, ids: list[str], column: str, rules: Rules) -> DataFrame:
    """The objects of a column of type array<struct>: the ids, path, pos, state, subtype and `_e` (the object).

    The column's type fixes all but which members are null, so the automaton is an expression: a member's state is its
    kind or 'null', an object's a hash of them, and a subtype needs its members not null. Null objects give no row.
    """
    fields = df.schema[column].dataType.elementType.fieldNames()
    rows = df.select(*ids, F.posexplode(column).alias("pos", "_e")).where(F.col("_e").isNotNull())
    state = F.xxhash64(*[F.col(f"_e.{f}").isNull() for f in fields])
    subtype = F.coalesce(*[F.when(_all(F.col(f"_e.{m}").isNotNull() for m in need), F.lit(n)) for n, need in rules.items()], F.lit(None).cast("string"))
    return rows.select(*ids, F.format_string("[%d]", "pos").alias("path"), "pos", state.alias("state"), subtype.alias("subtype"), "_e")


def _all(tests):
    return functools.reduce(lambda a, b: a & b, tests, F.lit(True))


def variants(nodes: DataFrame) -> DataFrame:
    """The object shapes met: state, the subtype it is routed to, how many objects have it, and an example's path."""
    return nodes.where(F.col("kind") == "object").groupBy("state", "subtype").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("example_path"))


def subtype_table(nodes: DataFrame, ids: list[str], subtype: str, members: dict[str, str]) -> DataFrame:
    """The typed table of the objects that the automaton's states route to `subtype`.

    One row per object: the ids, path and parent_path (the link), pos, state (its variant), and `members` (name -> SQL
    type), null where the variant lacks one or where the value doesn't read as the type.
    """
    kids = nodes.where((F.col("owner") == subtype) & F.col("key").isin(list(members)) & ~F.col("kind").isin("object", "list"))
    objects = nodes.where(F.col("subtype") == subtype)
    # an object and its members meet in one grouping by the object's path
    own = objects.select(*ids, "path", F.struct("parent_path", "pos", "state").alias("_o"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"))
    rows = own.unionByName(kids.select(*ids, F.col("parent_path").alias("path"), F.lit(None).alias("_o"), "key", "value"))
    wide = rows.groupBy(*ids, "path").agg(F.max("_o").alias("_o"), *[F.max(F.when(F.col("key") == m, F.expr(f"try_cast(value as {t})"))).alias(m) for m, t in members.items()])
    return wide.select(*ids, "path", "_o.parent_path", "_o.pos", "_o.state", *members)
