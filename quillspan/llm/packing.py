"""Filling containers of fixed capacity with texts: large-item matching on the table of sizes.

Only sizes matter for packing, and a size is one of at most ``capacity`` numbers. So the plan is made on the histogram of sizes, which
has at most that many rows whatever the number of texts, and the texts are then dealt out to the planned places by their rank among
the texts of the same size, in parallel:

1. a text above the capacity is split into full containers and a rest; nothing else is split;
2. sizes above a third of the capacity go at most two to a container: from the largest down, each is matched with the largest that
   still fits beside it, or stands alone;
3. the others, from the largest down, go into the smallest gap they fit, as often as they fit; new containers are opened only when
   no gap is left for them.

Steps 2 and 3 move whole groups of equal containers at a time, with the outcome of moving the texts one by one. Each size makes at most
three new groups, and a group holds fewer than sqrt(2 * capacity) different sizes, as these add up to the capacity at most; so a plan has
fewer than 3 * capacity * sqrt(2 * capacity) places, whatever the number of texts. That bounds what is broadcast; in practice it is some
three places per size.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.running import running_total
from quillspan.llm.tokens import DEFAULT, count_column
from quillspan.session import Scratch, spread


def sized(rows: DataFrame, key: str, text: str, tokenizer: str = DEFAULT) -> DataFrame:
    """key and n_tokens of each row."""
    def count(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), count_column(b.column(1), tokenizer)], ["key", "n_tokens"])

    kind = rows.schema[key].dataType.simpleString()
    return spread(rows.select(F.col(key).alias("key"), F.col(text).alias("text")), "key").mapInArrow(count, f"key {kind}, n_tokens long")


def plan(histogram: dict[int, int], capacity: int) -> tuple[dict[str, np.ndarray], int]:
    """Places for the items of a histogram (size -> count, all sizes from 1 to capacity).

    Returns places, sorted by size and first rank: the items of ``size`` from rank ``first`` on go ``each`` to a container, from
    container ``base`` on; and the number of containers.
    """
    left = {s: n for s, n in histogram.items() if n}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("sizes must be from 1 to the capacity")
    gaps: list[int] = []
    groups: dict[int, list] = {}

    def add(gap: int, count: int, content: tuple) -> None:
        if count:
            if gap not in groups:
                groups[gap] = []
                insort(gaps, gap)
            groups[gap].append((count, content))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        if at < 0:
            add(capacity - a, left[a], ((a, 1),))
            large.pop()
            continue
        b = large[at]
        if a == b:
            add(capacity - 2 * a, left[a] // 2, ((a, 2),))
            left[a] %= 2
            if left[a]:
                # one is left over: its partner is the next smaller, if any
                if at:
                    c = large[at - 1]
                    add(capacity - a - c, 1, ((a, 1), (c, 1)))
                    left[c] -= 1
                    if not left[c]:
                        large.pop(at - 1)
                else:
                    add(capacity - a, 1, ((a, 1),))
            large.pop()
            continue
        n = min(left[a], left[b])
        add(capacity - a - b, n, ((a, 1), (b, 1)))
        left[a] -= n
        left[b] -= n
        if not left[b]:
            large.pop(at)
        if not left[a]:
            large.pop()
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect_left(gaps, s)
            if at == len(gaps):
                m = capacity // s
                add(capacity - m * s, n // m, ((s, m),))
                if n % m:
                    add(capacity - n % m * s, 1, ((s, n % m),))
                break
            gap = gaps[at]
            count, content = groups[gap].pop()
            m = gap // s
            full = min(count, n // m)
            add(gap - m * s, full, (*content, (s, m)))
            n -= full * m
            count -= full
            if n and n < m and count:
                add(gap - n * s, 1, (*content, (s, n)))
                n, count = 0, count - 1
            if count:
                groups[gap].append((count, content))
            if not groups[gap]:
                del groups[gap]
                gaps.remove(gap)
    places, base, rank = [], 0, dict.fromkeys(histogram, 0)
    for gap in gaps:
        for count, content in groups[gap]:
            for s, m in content:
                places.append((s, rank[s], m, base))
                rank[s] += m * count
            base += count
    places.sort()
    cols = np.array(places, np.int64).reshape(-1, 4)
    return {"size": cols[:, 0], "first": cols[:, 1], "each": cols[:, 2], "base": cols[:, 3]}, base


def pack(sizes: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """Where each piece of each text goes: ``container``, ``key``, ``piece``, ``start_token``, ``n_tokens``.

    ``sizes`` has unique ``key`` and ``n_tokens``. Every token is in exactly one piece and no container holds more than ``capacity``.
    A text of no tokens (null, empty) takes no room: one row with a null container. Equal texts are packed one by one. An empty
    table gives no rows. Containers are numbered from 0 without gaps.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kind = sizes.schema["key"].dataType.simpleString()
    items = sizes.select("key", "n_tokens", F.floor(F.col("n_tokens") / capacity).cast("long").alias("full"), (F.col("n_tokens") % capacity).alias("size"))
    rest = items.filter("size > 0").select("key", "size", "full", F.lit(1).cast("long").alias("one"))
    histogram = {r["size"]: r["n"] for r in rest.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity - 1 rows
    places, n_containers = plan(histogram, capacity)
    # items in the order of size and rank are numbered through, so a number tells both and is at most the number of items
    known = np.array(sorted(histogram), np.int64)
    below = np.cumsum([0, *(histogram[s] for s in sorted(histogram))])[:-1].astype(np.int64)
    held = sizes.sparkSession.sparkContext.broadcast((places, known, below))

    def deal(batches):
        p, known, below = held.value
        number = below[np.searchsorted(known, p["size"])] + p["first"]
        for b in batches:
            size, rank = b.column("size").to_numpy(), b.column("before").to_numpy()
            at = np.searchsorted(number, below[np.searchsorted(known, size)] + rank, "right") - 1
            yield pa.record_batch([pa.array(p["base"][at] + (rank - p["first"][at]) // p["each"][at]), b.column("key"), b.column("full"), b.column("size")], ["container", "key", "full", "size"])

    ranked = running_total(rest, ["size"], "key", "one")
    dealt = ranked.select("key", "full", "size", "before").mapInArrow(deal, f"container long, key {kind}, full long, size long")
    dealt = dealt.select("container", "key", F.col("full").cast("int").alias("piece"), (F.col("full") * capacity).alias("start_token"), F.col("size").alias("n_tokens"))
    big = running_total(items.filter("full > 0").select("key", "full", F.lit(0).alias("all")), ["all"], "key", "full")
    big = big.select("key", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("i"))
    whole = big.select((F.col("before") + F.col("i") + n_containers).alias("container"), "key", F.col("i").cast("int").alias("piece"), (F.col("i") * capacity).alias("start_token"), F.lit(capacity).cast("long").alias("n_tokens"))
    none = items.filter("n_tokens = 0").select(F.lit(None).cast("long").alias("container"), "key", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start_token"), F.lit(0).cast("long").alias("n_tokens"))
    return dealt.unionByName(whole).unionByName(none)
