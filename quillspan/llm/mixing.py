"""Mixing sources to target weights: min-cost flow over membership patterns.

A text that occurs in several sources may be used for any of them. Texts are grouped by their membership pattern (the sorted numbers of
the listed sources they occur in), so the flow network has one node per source and per pattern that occurs and few arcs, whatever the
number of texts. Sizes, quotas and flows are whole tokens. A pattern with T tokens and cap m has m arcs of capacity T with costs 0, 1, ..., m - 1: the r-th
use of a text costs more than the one before (convex), so nothing is repeated while fresh text is left for the same quota. Each
source's arc to the sink has its quota. The cheapest flow tells how many tokens of each pattern go to each source; the texts of a
pattern, in a seeded order that knows nothing of their sizes, are then laid out pass by pass along that many tokens and cut at the
sources' borders. A text that lies across a border goes to the side that has its middle; the few texts next to the border then make up
for what that side has too much or too little.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.running import running_total
from quillspan.llm.tokens import DEFAULT, tokens
from quillspan.session import Scratch, spread

#: Sources a text occurs in, as sorted numbers.
Pattern = tuple[int, ...]
#: Texts that may make up for the error of a border lie within so many texts of mean size of it, on either side.
REACH = 200


def cheapest_flow(sizes: dict[Pattern, int], caps: list[int], quotas: list[int]) -> tuple[dict[tuple[Pattern, int], int], int]:
    """Tokens of each (pattern, source) at least repetition cost, and the total. sizes: tokens by pattern."""
    patterns = sorted(p for p in sizes if sizes[p] > 0)
    n = 2 + len(patterns) + len(quotas)
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    endless = sum(quotas) + 1

    def arc(a: int, b: int, c: int, w: int) -> int:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((c, 0))
        cost.extend((w, -w))
        return len(to) - 2

    first = 2 + len(patterns)
    into = {}
    for i, p in enumerate(patterns):
        for r in range(min(caps[s] for s in p)):
            arc(0, 2 + i, sizes[p], r)
        for s in p:
            into[p, s] = arc(2 + i, first + s, endless, 0)
    for s, q in enumerate(quotas):
        arc(first + s, 1, q, 0)
    height, total, far = [0] * n, 0, 1 << 60
    while True:
        dist, via = [far] * n, [-1] * n
        dist[0] = 0
        heap = [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for e in out[a]:
                if cap[e] > 0 and d + cost[e] + height[a] - height[to[e]] < dist[to[e]]:
                    dist[to[e]] = d + cost[e] + height[a] - height[to[e]]
                    via[to[e]] = e
                    heapq.heappush(heap, (dist[to[e]], to[e]))
        if via[1] < 0:
            break
        height = [h + min(d, dist[1]) for h, d in zip(height, dist)]
        b, push = 1, endless
        while b:
            push = min(push, cap[via[b]])
            b = to[via[b] ^ 1]
        b = 1
        while b:
            cap[via[b]] -= push
            cap[via[b] ^ 1] += push
            b = to[via[b] ^ 1]
        total += push
    return {k: cap[e ^ 1] for k, e in into.items() if cap[e ^ 1] > 0}, total


def in_shares(total: int, shares: list[float]) -> list[int]:
    """Whole tokens of each source at a total."""
    return [round(q * total) for q in shares]


def largest_total(sizes: dict[Pattern, int], caps: list[int], shares: list[float]) -> int:
    """The largest total at which every source that has any text can get its share (relative to those sources) in full."""
    there = [s for s in range(len(shares)) if shares[s] > 0 and any(s in p and n > 0 for p, n in sizes.items())]
    weight = sum(shares[s] for s in there)
    if not there:
        return 0
    own = [shares[s] / weight if s in there else 0.0 for s in range(len(shares))]

    def fills(total: int) -> bool:
        quotas = in_shares(total, own)
        return cheapest_flow(sizes, caps, quotas)[1] == sum(quotas)

    low, high = 0, int(min(sum(n for p, n in sizes.items() if s in p) * caps[s] / own[s] for s in there))
    if fills(high):
        return high
    while high - low > max(1, low >> 30):
        mid = (low + high) // 2
        low, high = (mid, high) if fills(mid) else (low, mid)
    return low


def passes(size: int, ends: np.ndarray) -> list[int]:
    """The pass over a pattern's texts in which each border lies; one at the end of a pass belongs to it."""
    return [max(0, int(np.ceil(e / size - 1e-9)) - 1) for e in ends]


def windows(size: int, ends: np.ndarray, reach: float) -> list[tuple[float, float]]:
    """Where in the seeded order the texts near the borders lie; a window over the end of a pass goes on at its beginning."""
    out = []
    for e, r in zip(ends, passes(size, ends)):
        at = e - r * size
        out.append((at - reach, at + reach))
        if at < reach and r:
            out.append((at - reach + size, float(size)))
        if at + reach > size:
            out.append((0.0, at + reach - size))
    return out


def settle(size: int, cap: int, ends: np.ndarray, sources: list[int], near: list[tuple[int, int]], owed: list[float]) -> list[tuple[int, int, int]]:
    """(before, place in sources, +1 or -1): uses to add or take away so that the borders of a pattern are met.

    near has (before, n) of the texts near the borders. owed has the tokens that each source lacks from other patterns; the last border
    makes up for those of its source too, and what this pattern leaves open is put back. The nearest texts that fit are moved, so the
    seeded order decides; at the last border a text larger than its source's whole part is left out.
    """
    at = passes(size, ends)
    rounds = {r for x in at for r in (x - 1, x, x + 1) if 0 <= r < cap}
    line = sorted((r * size + b, n, r, b) for r in rounds for b, n in near)
    slot = [int(np.searchsorted(ends, x + n / 2, "left")) for x, n, _, _ in line]
    was, over, last = list(slot), [0.0] * (len(ends) + 1), len(ends) - 1
    for j in range(last, -1, -1):
        e, wanted, out = ends[j], owed[sources[j]] if j == last else 0.0, None
        lacks = wanted
        for i, (x, n, _, _) in enumerate(line):
            if x < e < x + n:
                lacks -= (x + n - e) if slot[i] <= j else (x - e)
                if j == last and slot[i] == j and n > e - (ends[j - 1] if j else 0.0):
                    slot[i], out = j + 1, i
                    lacks += n
        for i in sorted(range(len(line)), key=lambda i: (slot[i] > last and line[i][2] > at[last], abs(line[i][0] + line[i][1] / 2 - e), line[i][0])):  # no repeats while fresh text fits
            n = line[i][1]
            if lacks > 0 and slot[i] == j + 1 and n <= lacks and i != out:
                slot[i] = j
                lacks -= n
            elif lacks < 0 and slot[i] == j and n <= -lacks:
                slot[i] = j + 1
                lacks += n
        over[j] = wanted - lacks
    for j in range(len(ends)):
        owed[sources[j]] -= over[j] - (over[j - 1] if j else 0.0)
    moved = [(line[i][3], was[i], slot[i]) for i in range(len(line)) if was[i] != slot[i]]
    return [(b, k, d) for b, a, z in moved for k, d in ((a, -1), (z, 1)) if k <= last]


class Mix:
    """Texts combined so that each source gets its share of the total.

    rows       the texts; ``key`` unique, ``text``, ``source``: columns. Equal texts are one text, whose key is the least of them; it
               belongs to every listed source that any of its copies has. Null or empty texts and texts of unlisted or null sources
               only are not used.
    targets    (source, share, cap) rows: share of the total in tokens, most uses of a text. A text of several sources is used at
               most as often as the least of their caps says, over all sources together.
    total      tokens wanted (rounded to whole ones). None: the largest total at which every source that has any text gets its share exactly; sources without
               any text stay at 0. With a total that some source cannot fill, the source gives all it may, and the report shows it.
    part       instead of total: the total as a multiple of the tokens of all texts of listed sources, each counted once.

    ``uses`` has one row per text and source it is used for; ``report`` has one row per listed source with target and reached share.
    Texts are taken in the seeded order, whatever their size. Where a border between sources in a pattern cuts a text, texts next to it
    make up for the difference; what is left is less than the smallest of them as a rule, and at most half of the text cut unless that is
    larger than its source's whole part. Empty tables give no uses and shares of 0.
    """

    def __init__(self, rows: DataFrame, key: str, text: str, source: str, targets: list[tuple[str, float, int]], total: float | None = None, seed: int = 0, tokenizer: str = DEFAULT, part: float | None = None):
        if total is not None and part is not None:
            raise ValueError("a mix takes a total or a part, not both")
        if len({t[0] for t in targets}) < len(targets):
            raise ValueError("a mix lists each source once")
        self.spark = rows.sparkSession
        self.targets = targets
        scratch = Scratch(self.spark, "mix")
        listed = F.broadcast(self.spark.createDataFrame([(t[0], i) for i, t in enumerate(targets)], "__source string, s int"))  # a row per target
        kind = rows.schema[key].dataType.simpleString()

        def count(batches):
            known: dict = {}
            for b in batches:
                n = []
                for h, x in zip(zip(b.column("h0").to_pylist(), b.column("h1").to_pylist()), b.column("text").to_pylist()):
                    if h not in known:
                        known[h] = tokens(tokenizer).count(x)
                    n.append(known[h])
                yield pa.record_batch([b.column("key"), b.column("s"), b.column("h0"), b.column("h1"), pa.array(n, pa.int64())], ["key", "s", "h0", "h1", "n"])

        texts = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).cast("string").alias("__source")).filter("text is not null and text != ''")
        # spread before the join, whose size the optimizer cannot tell
        texts = spread(texts, "key").join(listed, "__source").select("key", "s", F.xxhash64(F.lit(1), "text").alias("h0"), F.xxhash64(F.lit(2), "text").alias("h1"), "text")
        counted = texts.mapInArrow(count, f"key {kind}, s int, h0 long, h1 long, n long")
        units = counted.groupBy("h0", "h1").agg(F.min("key").alias("key"), F.concat_ws(",", F.sort_array(F.collect_set("s"))).alias("pattern"), F.max("n").alias("n")).select("key", "pattern", "n")
        self.units = scratch.write(units.filter("n > 0"), "units")
        totals = self.units.groupBy("pattern").agg(F.sum("n").alias("n"), F.avg("n").alias("mean")).collect()  # a row per pattern that occurs
        as_pattern = lambda text: tuple(map(int, text.split(",")))
        sizes = {as_pattern(r.pattern): r.n for r in totals}
        caps, shares = [t[2] for t in targets], [t[1] for t in targets]
        there = [any(s in p for p in sizes) for s in range(len(targets))]
        weight = sum(q for q, t in zip(shares, there) if t) or 1.0
        if part is not None:
            total = part * sum(sizes.values())
        if total is None:
            total = largest_total(sizes, caps, shares)
            shares = [q / weight if t else 0.0 for q, t in zip(shares, there)]
        flow, _ = cheapest_flow(sizes, caps, in_shares(total, shares))
        lines = {}
        for p in sizes:
            mine = [(s, flow[p, s]) for s in range(len(targets)) if (p, s) in flow]
            if mine:
                lines[p] = (sizes[p], min(caps[s] for s in p), np.cumsum([float(f) for _, f in mine]), [s for s, _ in mine])
        order = scratch.write(running_total(self.units, ["pattern"], "key", "n", seed).select("key", "pattern", "n", "before"), "order")
        around = self.spark.createDataFrame([(r.pattern, float(lo), float(hi)) for r in totals if as_pattern(r.pattern) in lines for lo, hi in windows(r.n, lines[as_pattern(r.pattern)][2], REACH * r.mean)], "p string, lo double, hi double")
        near: dict[Pattern, list[tuple[int, int]]] = {}
        # as many rows as lie in the windows, some REACH on either side of each border
        for r in order.join(F.broadcast(around), F.expr("pattern = p and before < hi and before + n > lo")).select("pattern", "before", "n").distinct().collect():
            near.setdefault(as_pattern(r.pattern), []).append((r.before, r.n))
        owed, moves = [0.0] * len(targets), {}
        for p in sorted(lines, key=lambda p: (-len(p), p)):  # texts of one source come last and make up for the others
            size, cap, ends, sources = lines[p]
            moves[p] = np.array(sorted(settle(size, cap, ends, sources, near.get(p, []), owed)), np.int64).reshape(-1, 3)
        held = self.spark.sparkContext.broadcast({",".join(map(str, p)): (*lines[p], moves[p]) for p in lines})  # a line per pattern that occurs

        def lay(batches):
            for b in batches:
                key_at, src, times = [], [], []
                coded = b.column("pattern").dictionary_encode()
                pattern, n, before = coded.indices.to_numpy(), b.column("n").to_numpy(), b.column("before").to_numpy()
                for code, p in enumerate(coded.dictionary.to_pylist()):
                    if p not in held.value:
                        continue
                    size, cap, ends, sources, moved = held.value[p]
                    rows_at = np.flatnonzero(pattern == code)
                    middle = before[rows_at] + n[rows_at] / 2
                    uses = np.zeros((len(rows_at), len(sources)), np.int64)
                    for r in range(cap):
                        at = np.searchsorted(ends, middle + r * size, "left")
                        inside = at < len(ends)
                        uses[np.flatnonzero(inside), at[inside]] += 1
                    by = np.argsort(before[rows_at])
                    at = np.searchsorted(before[rows_at], moved[:, 0], sorter=by).clip(max=len(by) - 1)
                    hit = before[rows_at][by[at]] == moved[:, 0]
                    np.add.at(uses, (by[at[hit]], moved[hit, 1]), moved[hit, 2])
                    i, j = np.nonzero(uses)
                    key_at.append(rows_at[i])
                    src.append(np.asarray(sources)[j])
                    times.append(uses[i, j])
                at = np.concatenate(key_at) if key_at else np.empty(0, np.int64)
                yield pa.record_batch([b.column("key").take(pa.array(at)), pa.array((np.concatenate(src) if src else at).astype(np.int32)), pa.array((np.concatenate(times) if times else at).astype(np.int32)), pa.array(n[at])], ["key", "s", "uses", "n_tokens"])

        laid = order.mapInArrow(lay, f"key {kind}, s int, uses int, n_tokens long")
        self.uses = laid.select("key", F.element_at(F.array(*[F.lit(t[0]) for t in targets]) if targets else F.array(F.lit("")), F.col("s") + 1).alias("source"), "uses", "n_tokens")

    def report(self) -> DataFrame:
        """source, target_share, n_texts, n_uses, n_tokens, share; one row per listed source."""
        got = self.uses.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum("uses").alias("n_uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("n_tokens"))
        want = self.spark.createDataFrame([(s, float(q), int(c)) for s, q, c in self.targets], "source string, target_share double, max_repeats int")
        from pyspark.sql import Window

        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        full = want.join(got, "source", "left").select("source", "target_share", "max_repeats", zero("n_texts"), zero("n_uses"), zero("n_tokens"))
        # a row per target
        return full.withColumn("share", F.coalesce(F.try_divide(F.col("n_tokens").cast("double"), F.sum("n_tokens").over(Window.partitionBy(F.lit(0)))), F.lit(0.0)))
