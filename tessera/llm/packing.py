"""Items packed into containers of one capacity by harmonic classes.

An item of length l is of class k = floor(capacity / l): k items of its class fit one container, k + 1 don't. Each
worker takes a share of all items and fills each class's containers with just that count, without regard to other
classes or workers. Plain classes leave up to a third of a container of large items unused, so a second pass gives up
containers of the smallest items and fills the rooms of the others with what they held. Both passes run in one task a
group; a class that is larger than a group is spread over all of them.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items a worker packs at once. More items make more groups, not larger ones. Each group leaves room in about one
#: container, so the size costs little: the README has figures for other sizes.
GROUP = 20_000


def fill_classes(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers (lists of items) of the reciprocal classes: each class by itself, its containers with its count.

    Items of a class are taken by length, so that a container's room is known by its class and the room of like
    containers is alike. Only the last container of a class may hold fewer.
    """
    cls = capacity // lengths
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    out: list[list[int]] = []
    for k in np.unique(cls):
        own = order[cls[order] == k]
        out.extend(own[at : at + k].tolist() for at in range(0, len(own), int(k)))
    return out


def pack_group(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container and place in it of each item; lengths are from 1 to capacity.

    First each class fills its containers with its count. Their rooms are then filled in a second pass: containers
    are given up, those of the smallest items first and not full ones before full ones of their class, as long as what
    they hold fits into the rooms of the others; their items go into the rooms, largest room first and the largest item
    that fits first. Items that found no room are packed by the largest that fits.
    """
    boxes = fill_classes(lengths, capacity)
    used = np.array([lengths[b].sum() for b in boxes], np.int64)
    cls = np.array([capacity // lengths[b[0]] for b in boxes], np.int64)
    rank = np.lexsort((used, -cls))  # the order in which containers are given up
    gone, held = np.cumsum(used[rank]), np.cumsum((capacity - used)[rank])
    n_gone = int(np.searchsorted(gone > held[-1] - held, True)) if len(boxes) else 0
    kept = [boxes[i] for i in sorted(rank[n_gone:], key=lambda i: (used[i], i))]
    stacks: dict[int, list[int]] = {}
    for i in sorted((i for b in rank[:n_gone] for i in boxes[b]), reverse=True):
        stacks.setdefault(int(lengths[i]), []).append(i)
    sizes = sorted(stacks)  # lengths with items left, ascending

    def fill(items: list[int], room: int) -> list[int]:
        while sizes and (k := bisect.bisect_right(sizes, room) - 1) >= 0:
            n = sizes[k]
            items.append(stacks[n].pop())
            if not stacks[n]:
                del sizes[k]
            room -= n
        return items

    for items in kept:
        fill(items, capacity - int(lengths[items].sum()))
    while sizes:
        kept.append(fill([], capacity))
    box, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int32)
    for n, items in enumerate(kept):
        box[items], place[items] = n, np.arange(len(items))
    return box, place


def pack(items: DataFrame, key: str, length: str, capacity: int, group: int = GROUP) -> DataFrame:
    """One row per piece of an item: key, part, start, size, container (string), place.

    An item up to the capacity is one piece (part 0). A longer one is cut at multiples of the capacity; its full
    pieces are containers of their own, the rest is packed like an item. Items of length 0 or null need no room: they
    have one row with size 0 and null container and place. Repeated rows are separate items; they are counted first, so
    that a key which holds a third of all rows is spread over all groups. An empty table gives no row. Other columns
    are not read.

    `items` is read twice (once to be counted), so it should be a written table if it is costly.
    """
    src = items.select(F.col(key).alias("_k"), F.coalesce(F.col(length), F.lit(0)).cast("bigint").alias("_n"))
    src = src.groupBy("_k", "_n").agg(F.count(F.lit(1)).alias("_c")).select("_k", "_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_c"))).alias("_copy"))
    cap = F.lit(capacity).cast("bigint")
    zero = F.lit(0).cast("bigint")
    none = src.where("_n <= 0").select("_k", zero.alias("part"), zero.alias("start"), zero.alias("size"), F.lit(None).cast("string").alias("container"), F.lit(None).cast("int").alias("place"))
    full = src.where(F.col("_n") >= cap).select("_k", "_copy", F.explode(F.sequence(zero, F.expr(f"_n div {capacity}") - 1)).alias("part"))
    full = full.select("_k", "part", (F.col("part") * cap).alias("start"), cap.alias("size"), F.concat_ws("-", F.lit("whole"), F.col("_k").cast("string"), F.col("part").cast("string"), F.col("_copy").cast("string")).alias("container"), F.lit(0).alias("place"))
    rest = src.where((F.col("_n") > 0) & (F.col("_n") % cap != 0)).select("_k", "_copy", F.expr(f"_n div {capacity}").alias("part"), (F.col("_n") % cap).alias("size"))
    groups = max(1, -(-rest.count() // group))
    rest = rest.withColumn("_g", F.pmod(F.xxhash64("_k", "_copy", "part"), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        # the order within a group is fixed by size, then key, so that a repeated task gives the same containers
        table = table.combine_chunks().sort_by([("size", "descending"), ("_k", "ascending"), ("part", "ascending"), ("_copy", "ascending")])
        box, place = pack_group(table.column("size").to_numpy(), capacity)
        g = table.column("_g")[0].as_py()
        return pa.table({"_k": table.column("_k"), "part": table.column("part"), "start": pa.array(table.column("part").to_numpy() * capacity), "size": table.column("size"), "container": pa.array([f"{g}-{b}" for b in box]), "place": pa.array(place)})

    kind = items.schema[key].dataType.simpleString()
    packed = rest.groupBy("_g").applyInArrow(run, f"_k {kind}, part bigint, start bigint, size bigint, container string, place int")
    return packed.unionByName(full).unionByName(none).withColumnRenamed("_k", key)
