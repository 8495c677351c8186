"""The general training-data operators on small tables: nulls, empties, ties, repeats, clashing columns."""

import datetime as dt
import json

import pytest

from tessera.operators.hierarchy import descendants, hierarchy
from tessera.operators.nested import shred, shred_typed, subtype_table, variants
from tessera.operators.ordinals import Bitmap
from tessera.operators.packed_fields import split_packed
from tessera.operators.reconcile import diff_copies
from tessera.operators.references import Child, Parent, orphan_counts, orphan_rows
from tessera.operators.snapshots import snapshot_changes


def tags(spark, fields):
    df = spark.createDataFrame([(i, f, "x") for i, f in enumerate(fields)], "id int, tags string, value string")
    out: dict = {}
    for r in split_packed(df, ["id"], "tags").orderBy("pos").collect():
        assert r.pos == len(out.setdefault(r.id, []))
        out[r.id].append(r.value)
    return out


FIELDS = {
    "a, b, c": ["a", "b", "c"],
    " ; b ;; c;": ["b", "c"],
    '"x, y plane", b': ["x, y plane", "b"],
    '"so-called ""fast"" path"|b': ['so-called "fast" path', "b"],
    r'["width \"w\", depth", "波形"]': ['width "w", depth', "波形"],
    "['i/o', 'R&D']": ["i/o", "R&D"],
    '{"1/f noise",beta}': ["1/f noise", "beta"],
    "Newton's method; Bayes' rule": ["Newton's method", "Bayes' rule"],
    "'width \"w\", depth' ,c": ['width "w", depth', "c"],
    "a|b; c、d · e": ["a", "b", "c", "d", "e"],
    "b,b": ["b", "b"],
    "a\tb\nc": ["a", "b", "c"],
    '"open, b': ['"open', "b"],
    ",,": None,
    "[a, b],[c]": ["[a", "b]", "[c]"],
    "[a, [b]]": ["a", "[b]"],
    "": None,
    "  　": None,
    None: None,
}


def test_split_packed(spark):
    got = tags(spark, list(FIELDS))
    assert got == {i: v for i, v in enumerate(FIELDS.values()) if v}


def test_split_packed_hot_and_long_fields(spark):
    long = "; ".join(f"tag{i}" for i in range(5000))
    got = tags(spark, ["a, b"] * 50 + [long])
    assert got[0] == got[49] == ["a", "b"] and got[50] == [f"tag{i}" for i in range(5000)]
    assert tags(spark, []) == {}


def leaves(v, path=""):
    if isinstance(v, dict):
        return [x for k, w in v.items() for x in leaves(w, f"{path}.{k}" if path else k)]
    if isinstance(v, list):
        return [x for i, w in enumerate(v) for x in leaves(w, f"{path}[{i}]")]
    return [(path, v)]


def test_shred(spark):
    doc = {"a": {"b": [{"c": 1}, {"c": None}, "t", []]}, "d": True, "e": {}, "f": '{"g": [1.5]}', "h": "[not json"}
    texts = {1: json.dumps(doc), 2: json.dumps(json.dumps([1, [2]])), 3: None, 4: "", 5: '{"cut": ', 6: "null", 7: "[" * 50 + "]" * 50, 8: '"text"'}
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "id int, payload string, path string")
    rows = shred(df, ["id"], "payload").collect()
    flat = {(r.id, r.path, r.value) for r in rows if r.kind not in ("object", "list") and r.level}
    doc["f"] = {"g": [1.5]}
    want = {(1, p, None if v is None else v if isinstance(v, str) else json.dumps(v)) for p, v in leaves(doc)} | {(2, "[0]", "1"), (2, "[1][0]", "2")}
    assert flat == want
    assert {r.id for r in rows} == {1, 2, 6, 7}
    by_path = {(r.id, r.path): r for r in rows}
    assert by_path[1, "a.b[1].c"].parent_path == "a.b[1]" and by_path[1, "a.b[2]"].pos == 2
    assert by_path[1, "a.b[0]"].state != by_path[1, "a.b[1]"].state  # number and null members are other shapes
    v = variants(shred(df, ["id"], "payload")).collect()
    assert sum(r.n for r in v) == sum(r.kind == "object" for r in rows)
    rules = {"leaf": {"c": None}, "top": {"a": None}}
    t = subtype_table(shred(df, ["id"], "payload", rules=rules), ["id"], "leaf", {"c": "int"}).collect()
    assert [(r.path, r.parent_path, r.c) for r in sorted(t, key=lambda r: r.path)] == [("a.b[0]", "a.b", 1), ("a.b[1]", "a.b", None)]


def test_rows_are_routed_by_state(spark):
    rules = {"leaf": {"tags": None}, "entry": {"leaf": "leaf"}, "payload": {"runs": "entry"}}
    docs = {
        1: {"runs": [{"leaf": {"tags": ["a", "b"]}}, {"leaf": {"other": ["no"]}}, None, {"leaf": {"tags": "c"}}]},
        2: {"runs": {"leaf": json.dumps({"tags": {"x": 1}})}},
        3: {"runs": {"leaf": json.dumps(json.dumps(json.dumps({"tags": ["d"]})))}},
        4: {"other": {"leaf": {"tags": ["no"]}}},
        5: {"runs": [[{"leaf": {"tags": ["nested"]}}]]},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "id int, payload string")
    route = "/payload.runs/entry.leaf/leaf.tags"
    got = {(r.id, r.places[0], r.places[2], r.value) for r in shred(df, ["id"], "payload", rules=rules, routes=(route,), scalars=True).collect()}
    assert got == {(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 3, -1, "c"), (3, -1, 0, "d")}
    other = {(r.id, r.route) for r in shred(df, ["id"], "payload", rules=rules, scalars=True).collect() if r.value == "no" or r.value == "nested"}
    assert other == {(1, "/payload.runs/None.leaf/None.other"), (4, "/None.other/entry.leaf/leaf.tags"), (5, "/payload.runs[]/entry.leaf/leaf.tags")}


def test_json_of_any_depth(spark):
    from tessera.operators.nested import _deep, parse

    for text in ('{"a": [1, {"b": null}, []], "c": {}}', "[ ]", "3", ' {"x" : "y" , "z":[true,false] } '):
        assert _deep(text) == json.loads(text)
    for text in ('{"a" 1}', "[1,]", "[1 2]", '{"a": 1,}', "", "[", "{1: 2}", "[] x"):
        with pytest.raises((ValueError, StopIteration)):
            _deep(text)
    n = 100_000
    ok, v = parse("[" * n + "1" + "]" * n)
    assert ok
    wrapped = json.dumps({"a": 1})
    for _ in range(12):  # each round doubles the escapes, none is a limit
        wrapped = json.dumps(wrapped)
    assert parse(wrapped) == (True, {"a": 1})
    df = spark.createDataFrame([(1, '{"a":' * 3000 + "7" + "}" * 3000)], "id int, j string")
    assert [r.value for r in shred(df, ["id"], "j", scalars=True).collect()] == ["7"]


def test_shred_typed(spark):
    s = "id int, ports array<struct<name string, kind string>>"
    df = spark.createDataFrame([(1, [("a", None), None, (None, "k"), ("b", "k")]), (2, None), (3, [])], s)
    rows = shred_typed(df, ["id"], "ports", {"port": {"name": None}}).collect()
    assert [(r.id, r.pos, r.subtype, r._e.name) for r in rows] == [(1, 0, "port", "a"), (1, 2, None, None), (1, 3, "port", "b")]
    assert len({r.state for r in rows}) == 3


def test_bitmap():
    np = pytest.importorskip("numpy")
    r = np.random.default_rng(0)
    for density in (0, 0.001, 0.2, 0.5, 0.999, 1):
        for n in (1, 7, 8, 1000, 32768):
            a, b = r.random(n) < density, r.random(n) < 0.5
            x, y = Bitmap(a), Bitmap(b)
            assert list(x.and_not(y)) == list(np.flatnonzero(a & ~b)) and list(y.and_not(x)) == list(np.flatnonzero(b & ~a))
            assert list(x.both(y)) == list(np.flatnonzero(a & b))


def test_ordinals_persist(spark, tmp_path):
    from tessera.operators import ordinals
    from tessera.operators.ordinals import Dictionary

    d = Dictionary(spark, f"file://{tmp_path}/d", "string")
    one = {r.k: r._ord for r in d.extend(spark.createDataFrame([(f"k{i}",) for i in range(500)], "k string").repartition(5), "k").collect()}
    assert sorted(one.values()) == list(range(500))
    two = {r.k: r._ord for r in d.extend(spark.createDataFrame([(f"k{i}",) for i in range(300, 800)], "k string"), "k").collect()}
    assert all(two[k] == one[k] for k in two if k in one) and sorted(one | two, key=(one | two).get)[:500] == sorted(one, key=one.get)
    assert sorted((one | two).values()) == list(range(800))
    assert d.extend(spark.createDataFrame([], "k string"), "k").count() == 0


def test_snapshots_over_one_dictionary(spark, tmp_path, monkeypatch):
    import datetime as dt

    from tessera.operators import ordinals

    monkeypatch.setattr(ordinals, "WIDTH", 3)  # more dates than one run takes
    monkeypatch.setattr("tessera.operators.snapshots.WIDTH", 3)
    r, day = __import__("random").Random(4), lambda i: dt.date(2024, 1, 1 + i)
    state: dict = {}
    rows, want = [], set()
    for i in range(7):
        old = dict(state)
        for k in range(60):
            x = r.random()
            if x < 0.1:
                state.pop(k, None)
            elif x < 0.3:
                state[k] = r.choice([None, "a", "b"])
        rows += [(day(i), 1, k, v) for k, v in state.items()]
        if i:
            want |= {(day(i), k, "added", "") for k in state.keys() - old.keys()} | {(day(i), k, "removed", "") for k in old.keys() - state.keys()} | {(day(i), k, "changed", "v") for k in old.keys() & state.keys() if old[k] != state[k]}
    df = spark.createDataFrame(rows, "d date, at int, k int, v string")
    path = f"file://{tmp_path}/d"
    got = lambda x: {tuple(r) for r in snapshot_changes(x, "d", "at", "k", ["v"], path).collect()}
    assert got(df.where(f"d <= '{day(3)}'")) == {w for w in want if w[0] <= day(3)}
    first = {r.key: r.ordinal for r in spark.read.parquet(path).collect()}
    assert got(df) == want
    later = {r.key: r.ordinal for r in spark.read.parquet(path).collect()}
    assert later.items() >= first.items() and sorted(later.values()) == list(range(len(later)))


def test_diff_copies(spark):
    s = "id string, v string, w int, side string"
    left = spark.createDataFrame([("a", "1", 1, "x"), ("b", "1", None, "x"), ("c", None, 3, "x"), ("c", None, 3, "y"), ("d", "1", 1, "x"), (None, "1", 1, "x"), ("e", "1", None, "x")], s)
    right = spark.createDataFrame([("a", "1", 1, "x"), ("b", "2", 7, "x"), ("c", "3", 3, "x"), ("f", "1", 1, "x"), ("e", "1", None, "q")], s)
    got = {tuple(r) for r in diff_copies(left, right, "id", ["v", "w"]).collect()}
    assert got == {("d", "missing_in_right", ""), ("f", "missing_in_left", ""), ("b", "differs", "v"), ("b", "differs", "w"), ("c", "differs", "v")}
    none = spark.createDataFrame([], s)
    assert {tuple(r) for r in diff_copies(none, right, "id", ["v"]).collect()} == {(k, "missing_in_left", "") for k in "abcef"}
    assert diff_copies(none, none, "id", ["v"]).count() == 0


def test_diff_copies_over_chunks(spark):
    left = spark.range(100_000).selectExpr("id", "id % 7 AS v")
    right = spark.range(50, 100_050).selectExpr("id", "IF(id % 1000 = 0, -1, id % 7) AS v")
    got = diff_copies(left, right, "id", ["v"]).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in got} == {"missing_in_right": 50, "missing_in_left": 50, "differs": 99}


def test_snapshot_changes(spark):
    d = [dt.date(2024, 1, x) for x in (1, 5, 9)]
    t = lambda n: dt.datetime(2024, 2, n)
    rows = [
        (d[0], t(1), "a", "1"), (d[0], t(1), "a", "1"), (d[0], t(1), "b", None), (d[0], t(1), None, "1"),
        (d[1], t(2), "z", "9"), (d[1], t(3), "a", "2"), (d[1], t(3), "b", "1"), (d[1], t(3), "c", "1"),
        (d[2], t(4), "c", "1"), (d[2], None, "q", "1"),
    ]
    df = spark.createDataFrame(rows, "day date, at timestamp, id string, v string").withColumnRenamed("at", "at")
    got = {tuple(r) for r in snapshot_changes(df, "day", "at", "id", ["v"]).collect()}
    assert got == {(d[1], "a", "changed", "v"), (d[1], "b", "changed", "v"), (d[1], "c", "added", ""), (d[2], "a", "removed", ""), (d[2], "b", "removed", "")}
    assert snapshot_changes(df.where(df.day == d[0]), "day", "at", "id", ["v"]).count() == 0
    assert snapshot_changes(df.limit(0), "day", "at", "id", ["v"]).count() == 0


def test_many_snapshots(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(i), dt.datetime(2024, 6, 1), f"k{j}", str(i // 30)) for i in range(60) for j in range(3) if (i + j) % 20]
    df = spark.createDataFrame(rows, "day date, at timestamp, id string, v string")
    got = snapshot_changes(df, "day", "at", "id", ["v"]).collect()
    at = {(r[0], r[2]): r[3] for r in rows}
    days = sorted({r[0] for r in rows})
    want = set()
    for a, b in zip(days, days[1:]):
        for k in ("k0", "k1", "k2"):
            x, y = at.get((a, k)), at.get((b, k))
            if x is None and y is not None:
                want.add((b, k, "added", ""))
            elif y is None and x is not None:
                want.add((b, k, "removed", ""))
            elif x != y:
                want.add((b, k, "changed", "v"))
    assert {tuple(r) for r in got} == want


def test_orphans(spark):
    from pyspark.sql import functions as F

    t = lambda m: dt.datetime(2024, m, 1)
    parent = spark.createDataFrame([("a", t(3)), ("a", t(5)), ("b", t(1))], "k string, loaded timestamp_ntz")
    gone = spark.createDataFrame([("g",), ("a",)], "k string")
    rows = [("1", "a", t(4)), ("2", "a", t(2)), ("2", "a", t(9)), ("3", "g", t(4)), ("4", "m", t(6)), ("4", "m", t(5)), ("5", None, t(1)), ("6", "b", None), ("7", "m", None), (None, "m", t(1))]
    child = spark.createDataFrame(rows + [(f"h{i}", "hot", t(1)) for i in range(200)], "id string, k string, loaded timestamp_ntz")
    kids = [Child("c", child, F.col("id"), F.col("k"), F.col("loaded"), "p")]
    ps = [Parent("p", parent, F.col("k"), F.col("loaded")), Parent("p", gone, F.col("k"), gone=True)]
    got = {(r.row_key, r.kind, r.loaded and r.loaded.month) for r in orphan_rows(kids, ps).collect() if not r.row_key.startswith("h")}
    assert got == {("2", "late", 2), ("3", "removed", 4), ("4", "missing", 5), ("7", "missing", None)}
    n = {(r.kind, r.period): r.n for r in orphan_counts(kids, ps).collect()}
    assert n["missing", "2024-01"] == 200 and n["removed", "2024-04"] == 1 and n["missing", None] == 1
    assert orphan_rows([Child("c", child.limit(0), F.col("id"), F.col("k"), F.col("loaded"), "p")], ps).count() == 0


def brute_tree(links):
    out = {}
    kids: dict = {}
    up = {n: (p if p in links else None) for n, p in links.items()}
    for n, p in up.items():
        kids.setdefault(p, []).append(n)

    def size(n):
        return 1 + sum(size(k) for k in kids.get(n, []))

    for n in links:
        path, x, seen = [n], up[n], {n}
        while x is not None and x not in seen:
            seen.add(x)
            path.append(x)
            x = up[x]
        if x is None:
            out[n] = ("tree", path[-1], len(path) - 1, size(n), "/".join(reversed(path)))
        else:
            out[n] = ("cycle", None, None, None, None) if x == n else None
    ring = {n for n, v in out.items() if v and v[0] == "cycle"}
    for n, v in out.items():
        if v is None:
            out[n] = ("below", None, None, size(n), None) if n not in ring else v
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_hierarchy(spark, seed):
    import random

    r = random.Random(seed)
    links = {f"n{i}": (f"n{r.randrange(i)}" if i and r.random() > 0.05 else r.choice([None, "nowhere"])) for i in range(300)}
    links |= {f"d{i}": f"d{i - 1}" if i else None for i in range(70)}  # a long chain
    links |= {f"s{i}": "n0" for i in range(150)}  # many siblings
    links |= {"c0": "c2", "c1": "c0", "c2": "c1", "self": "self", "u0": "c1", "u1": "u0", "u2": "u0", "w": "self"}
    rows = [(n, p, "x") for n, p in links.items()]
    df = spark.createDataFrame(rows + rows[:20] + [(None, "n0", "x")], "node string, parent string, path string")
    h = hierarchy(df, "node", "parent").cache()
    got = {x.node: (x.state, x.root, x.depth, x["size"], x.path) for x in h.collect()}
    assert got == brute_tree(links)
    # the nested sets hold just the descendants
    below = {(x.ancestor, x.node) for x in descendants(h, "node").collect()}
    want = {(a, n) for n, v in got.items() if v[4] for a in v[4].split("/")[:-1]}
    assert below == want


def test_hierarchy_in_many_chunks(spark, monkeypatch):
    from tessera.operators import hierarchy as module

    monkeypatch.setattr(module, "CHUNK", 7)
    links = {i: (i - 1 if i % 40 else None) for i in range(120)} | {1000 + i: i % 3 for i in range(50)} | {5000: 5000}
    df = spark.createDataFrame(list(links.items()), "id bigint, up bigint")
    h = hierarchy(df, "id", "up", ">").cache()
    got = {x.id: (x.root, x.depth, x.path) for x in h.collect()}
    assert got[39] == (0, 39, ">".join(map(str, range(40)))) and got[1001] == (0, 2, "0>1>1001") and got[5000] == (None, None, None)
    sets = sorted((x.left, x.right) for x in h.collect() if x.left is not None)
    assert [a for a, _ in sets] == list(range(170))  # one numbering without gaps
    far = {(x.ancestor, x.node): x.distance for x in descendants(h, "id").collect()}
    assert far[0, 39] == 39 and far[2, 1002] == 1 and len(far) == sum(v[1] for v in got.values() if v[1] is not None)


def test_hierarchy_empty(spark):
    assert hierarchy(spark.createDataFrame([], "node string, parent string"), "node", "parent").count() == 0
