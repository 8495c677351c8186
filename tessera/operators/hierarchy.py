"""Parent-child links to full hierarchies by nested sets.

Upward, subtree sizes add up; downward, prefix sums of the sizes over siblings give each child its offset in the
parent's preorder range, and the offsets from the root add up to each node's nested-set range [left, right). Both ways
go in rounds that double the reach of each node's pointer, so their number grows with the logarithm of the depth, and
rounds carry numbers only. Nodes whose pointer never runs out are left unprocessed: they are on or below a cycle.

Ancestors and descendants then come from the ranges: nodes are cut by their left into chunks of CHUNK, each chunk gets
the ranges that are open where it starts, and one pass in order of left keeps the open ranges on a stack. The stack at
a node is its path; each node on it has this one as a descendant.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import Written, partitions

#: Parts of a sibling group in its prefix sum (at least the shuffle partitions), so that no group is sorted in one task.
SIBLING_PARTS = 64
#: Nodes of a chunk of the preorder. More nodes make more chunks, not larger ones.
CHUNK = 1 << 15
#: Sizes and depths of nodes on cycles grow without end; they are held here.
_ENDLESS = 1 << 50


def _numbered(df: DataFrame, node: str, parent: str) -> tuple[Written, Written]:
    """The nodes (node, parent, id) with their numbers, and the links (id, pid) between numbers; pid is null for roots."""
    rows = df.select(F.col(node).alias("node"), F.col(parent).alias("parent")).where(F.col("node").isNotNull())
    # written once, so the numbers stay the same
    nodes = Written(rows.groupBy("node").agg(F.min("parent").alias("parent")).withColumn("id", F.monotonically_increasing_id()))
    up = nodes.df.select(F.col("node").alias("parent"), F.col("id").alias("pid"))
    return nodes, Written(nodes.df.join(up, "parent", "left").select("id", "pid"))


def _sizes(links: DataFrame) -> Written:
    """id, pid, size, state: 'tree', 'cycle' or 'below'."""
    cur = Written(links.select("id", "pid", F.col("pid").alias("up"), F.lit(1).cast("bigint").alias("size")))
    left, ring, on_ring = -1, -1, None
    while True:
        # nodes whose pointer still leads somewhere, and the places those pointers lead to
        n = cur.df.agg(F.count("up").alias("left")).first()["left"]
        image = cur.df.where(F.col("up").isNotNull()).groupBy("up").agg(F.sum("size").alias("below"))
        if n == left or n == 0:
            # all that is left is on or below cycles; the image stops shrinking once only cycle nodes are in it
            m = image.count() if n else 0
            if m == ring or n == 0:
                on_ring = image.select(F.col("up").alias("id"), F.lit(True).alias("ring"))
                break
            ring = m
        left = n
        ahead = cur.df.where(F.col("up").isNotNull()).select(F.col("id").alias("up"), F.col("up").alias("up2"))
        new = Written(
            cur.df.join(image.withColumnRenamed("up", "id"), "id", "left")
            .withColumn("size", F.least(F.col("size") + F.coalesce("below", F.lit(0)), F.lit(_ENDLESS)))
            .drop("below")
            .join(ahead, "up", "left")
            .select("id", "pid", F.col("up2").alias("up"), "size")
        )
        cur.drop()
        cur = new
    state = F.when(F.col("up").isNull(), "tree").when(F.col("ring"), "cycle").otherwise("below")
    out = Written(cur.df.join(on_ring, "id", "left").select("id", "pid", "size", state.alias("state")))
    cur.drop()
    return out


def _offsets(tree: DataFrame) -> DataFrame:
    """Each tree node's offset in its parent's range: 1 and the sizes of the siblings before it. Roots are siblings, too, from 0."""
    parts = max(SIBLING_PARTS, partitions(tree.sparkSession))
    kids = tree.select("id", "pid", F.coalesce("pid", F.lit(-1)).alias("of"), "size", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
    sums = kids.groupBy("of", "part").agg(F.sum("size").alias("s"))
    before = sums.select("of", "part", (F.sum("s").over(Window.partitionBy("of").orderBy("part")) - F.col("s")).alias("base"))
    inner = F.sum("size").over(Window.partitionBy("of", "part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    off = F.col("base") + F.coalesce("inner", F.lit(0)) + F.when(F.col("pid").isNull(), 0).otherwise(1)
    return kids.withColumn("inner", inner).join(before, ["of", "part"]).select("id", F.col("pid").alias("up"), off.cast("bigint").alias("left"))


def nested_sets(links: DataFrame) -> tuple[DataFrame, Written]:
    """(id, left, right) of each tree node, all trees in one numbering from 0 without gaps; and the sizes and states."""
    sized = _sizes(links)
    tree = sized.df.where(F.col("state") == "tree")
    cur = Written(_offsets(tree))
    while cur.df.where(F.col("up").isNotNull()).limit(1).count():
        ahead = cur.df.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("left").alias("left2"))
        new = Written(cur.df.join(ahead, "up", "left").select("id", F.col("up2").alias("up"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left")))
        cur.drop()
        cur = new
    return cur.df.join(tree.select("id", "size"), "id").select("id", "left", (F.col("left") + F.col("size")).alias("right")), sized


def _sweep(ranges: DataFrame, run, schema: str) -> DataFrame:
    """`run` over the chunks' rows (chunk, inside, left, right, node) in order: first the ranges open where a chunk starts."""
    first = F.expr(f"left div {CHUNK}")
    own = ranges.select(first.alias("chunk"), F.lit(True).alias("inside"), "left", "right", "node")
    last = F.expr(f"(right - 1) div {CHUNK}")
    open_ = ranges.where(last > first).select(F.explode(F.sequence(first + 1, last)).alias("chunk"), F.lit(False).alias("inside"), "left", "right", "node")
    rows = own.unionByName(open_).repartition(partitions(ranges.sparkSession), "chunk").sortWithinPartitions("chunk", "left")
    return rows.mapInArrow(run, schema)


def _stacks(batches: Iterator[pa.RecordBatch]):
    """(node, stack of open nodes with it on top) of each node, as batches are read; None after each batch."""
    chunk, rights, stack = None, [], []
    for b in batches:
        for c, inside, left, right, node in zip(*(x.to_pylist() for x in b.columns)):
            if c != chunk:
                chunk, rights, stack = c, [], []
            while rights and rights[-1] <= left:
                rights.pop()
                stack.pop()
            rights.append(right)
            stack.append(node)
            if inside:
                yield node, stack
        yield None


def hierarchy(df: DataFrame, node: str, parent: str, sep: str = "/") -> DataFrame:
    """One row per node: node, parent, root, depth, size, state, left, right, path.

    A node whose parent is null or no node is a root with depth 0 (callers turn blank parents into null). Tree nodes
    have state 'tree' and the nested-set range [left, right) in one numbering of all trees; root, depth and path (the
    nodes from the root, joined) are read off the ranges. Nodes on a cycle have state 'cycle', nodes below one 'below',
    both with null root, depth, range and path; a node below a cycle has its own subtree's size. Repeated rows are one;
    of a node with several parents the least counts. Null nodes are left out; an empty table gives no row. Other
    columns are not read.
    """
    nodes, links = _numbered(df, node, parent)
    sets, sized = nested_sets(links.df)
    told = Written(nodes.df.join(sized.df.drop("pid"), "id").join(sets, "id", "left"))
    for t in (nodes, links, sized):
        t.drop()
    kind = df.schema[node].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for x in _stacks(batches):
            if x is not None:
                out.append((x[0], x[1][0], len(x[1]) - 1, sep.join(map(str, x[1]))))
            elif out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["node", "root", "depth", "path"])
                out = []

    above = _sweep(told.df.where("state = 'tree'"), run, f"node {kind}, root {kind}, depth bigint, path string")
    # one join brings the rest of each row; the sweep moves only what it needs
    return told.df.join(above, "node", "left").select(
        F.col("node").alias(node), F.col("parent").alias(parent) if parent != node else F.col("parent"), "root", "depth", F.when(F.col("state") != "cycle", F.col("size")).alias("size"), "state", "left", "right", "path"
    )


def descendants(nodes: DataFrame, node: str) -> DataFrame:
    """All pairs (ancestor, node, distance) of the tree nodes of `hierarchy`, from their ranges. There are as many as the sum of all depths."""
    kind = nodes.schema[node].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: list = []
        down: list = []
        far: list[int] = []
        for x in _stacks(batches):
            if x is not None:
                n = len(x[1]) - 1
                up.extend(x[1][:n])
                down.extend([x[0]] * n)
                far.extend(range(n, 0, -1))
            if up and (x is None or len(up) > 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(up), pa.array(down), pa.array(far, pa.int64())], names=["ancestor", "node", "distance"])
                up, down, far = [], [], []

    tree = nodes.where(F.col("state") == "tree").select("left", "right", F.col(node).alias("node"))
    return _sweep(tree, run, f"ancestor {kind}, node {kind}, distance bigint")
