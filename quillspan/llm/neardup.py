"""Near-duplicate texts: all pairs whose sets of k-word runs have a Jaccard similarity of at least t, without comparing each with each.

Texts with equal sets form a class; only classes are compared. The texts are read once: a pass writes each class's sorted set of hashed
runs, and all that follows reads those sets. Classes meet in tiles. A tile is a run out of the rarest part of their sets and a band of
sizes; band b meets itself and the small end of band b + 1, as no similar set lies further off. In a tile, hashed bitmap signatures,
whose width grows with the band, bound the overlap of each pair from above; so does, over all tiles of a pair, the number of runs that
the rare parts share. What remains is settled by an exact intersection of the two sorted arrays. Nothing is lost:

* if J(A, B) >= t, then A and B share one of the first n - ceil(t n) + 1 runs of each in any common order (prefix filter), and at least
  need - (ceil(t n) - 1) of them, n being the larger size, where need = ceil(t / (1 + t) (n_A + n_B)) is the overlap J >= t asks for;
* t n_A <= n_B <= n_A / t, and |A & B| <= (n_A + n_B - popcount(a xor b)) / 2 for the bitmaps a and b;
* the order puts runs of little load first. Each task tells which of the slots that runs are hashed to stand out from its other slots, and
  these loads are added up; the table has LOAD_SLOTS entries and only steers the work.

Scale: copies are emitted once per map task, so a class with a third of all rows costs one row per task. Tiles are counted before they
are built, and one of more than CHUNK rows is cut into chunks that meet two by two, so no task holds more than two chunks and as many
rows as there are map tasks. What is broadcast is the table of LOAD_SLOTS bytes. Results: classes with members, links between classes;
``pairs`` expands both to pairs of keys where that is asked for.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.shingles import class_ids, mix, pack_runs, shingle_sets, unpack_runs
from quillspan.session import Scratch, spread

#: Slots of the load table, a byte each.
LOAD_SLOTS = 1 << 20
#: Rows of a tile from which on it is cut into chunks, and pairs whose bitmaps are compared at once.
CHUNK, BLOCK = 8192, 1 << 20
#: A band is so many steps of 1 / t wide; one in so many rows then also meets the band below.
BAND_STEPS = 4
#: Bits of the bitmaps carried in tile rows, and the largest sets of a band that has them; from larger bands on a class has one signature
#: of two bits or more per run.
NARROW, WIDE = (128, 100), (256, 400)


def _slot(run: np.ndarray) -> np.ndarray:
    return (run >> np.uint64(40)).astype(np.int64) & (LOAD_SLOTS - 1)


class Bands:
    """Bands of set sizes for a threshold: ``low[b]`` is the least size in band b."""

    def __init__(self, t: float):
        self.t = t
        low, step = [1], (1 / t) ** BAND_STEPS
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, math.ceil(step ** len(low))))
        self.low = np.array(low, np.int64)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1

    def meets_below(self, n: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Whether sets of size n can be alike with one of the band below."""
        return (band > 0) & (np.ceil(self.t * n - 1e-9) < self.low[band])

    @property
    def signed(self) -> int:
        """The least size in a band whose tiles carry no bitmaps: sets from it on have a signature."""
        return int(self.low[int(np.argmin(self.bits(np.arange(len(self.low) - 1))))])

    def bits(self, band: np.ndarray) -> np.ndarray:
        """Bits of the bitmaps in a band's tiles, 0 where none are carried."""
        top = self.low[band + 1] - 1
        return np.where(top <= NARROW[1], NARROW[0], np.where(top <= WIDE[1], WIDE[0], 0))


def _least_shared(n: np.ndarray, t: float) -> np.ndarray:
    return np.ceil(t * n - 1e-9).astype(np.int64)


def _need(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    return np.ceil(t / (1 + t) * (a + b) - 1e-9).astype(np.int64)


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of ``words`` words from wider ones, whose widths are powers of two times as large."""
    return np.bitwise_or.reduce(bits.reshape(-1, bits.shape[-1] // words, words), axis=1) if bits.shape[-1] > words else bits


def _bitmaps(run: np.ndarray, doc: np.ndarray, n_docs: int, words: int) -> np.ndarray:
    """A bitmap of ``words`` 64-bit words per set, one bit per run by its hash; narrower ones are folds of it."""
    bits = np.zeros(n_docs * words, np.uint64)
    h = mix(run + np.uint64(77))
    np.bitwise_or.at(bits, doc * words + ((h >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
    return bits.reshape(n_docs, words)


def signature(run: np.ndarray) -> bytes:
    """The bitmap of one large set: at least two bits per run."""
    words = 1 << max(2, math.ceil(math.log2(max(2, 2 * len(run)) / 64)))
    return _bitmaps(run, np.zeros(len(run), np.int64), 1, words).tobytes()


def _sets(texts: DataFrame, k: int, t: float) -> DataFrame:
    """key, c0, c1, n, runs (the sorted set), sig (of large sets). Sets are given once per class and task, and not for texts without runs."""

    signed = Bands(t).signed

    def emit(batches):
        seen: set = set()
        for b in batches:
            run, _, count = shingle_sets(b.column("text"), k)
            c0, c1 = class_ids(run, count)
            first = np.cumsum(count) - count
            runs, sigs = [None] * len(count), [None] * len(count)
            for i, c in enumerate(zip(c0.tolist(), c1.tolist())):
                if count[i] and c not in seen:
                    seen.add(c)
                    mine = run[first[i] : first[i] + count[i]]
                    runs[i] = pack_runs(mine)
                    if count[i] >= signed:
                        sigs[i] = signature(mine)
            yield pa.record_batch({"key": b.column("key"), "c0": c0, "c1": c1, "n": count.astype(np.int32), "runs": pa.array(runs, pa.binary()), "sig": pa.array(sigs, pa.binary())})

    key = texts.schema["key"].dataType.simpleString()
    return texts.mapInArrow(emit, f"key {key}, c0 long, c1 long, n int, runs binary, sig binary")


def _unpack(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of a batch of sets, the set of each, and the sizes."""
    n = b.column("n").to_numpy().astype(np.int64)
    return unpack_runs(b.column("runs").to_pylist()), np.repeat(np.arange(len(n)), n), n


def _load_table(sets: DataFrame) -> np.ndarray:
    """For each slot the load of runs that stand out in the tasks they are in, as log2 in quarter steps; 0 for all others."""

    def count(batches):
        total = np.zeros(LOAD_SLOTS, np.int64)
        for b in batches:
            total += np.bincount(_slot(_unpack(b)[0]), minlength=LOAD_SLOTS)
        slot = np.flatnonzero(total > 3 * total.mean() + 16)
        yield pa.record_batch({"slot": slot.astype(np.int32), "n": total[slot]})

    # at most LOAD_SLOTS rows
    sums = sets.select("n", "runs").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    level = np.zeros(LOAD_SLOTS, np.uint8)
    level[sums.column("slot").to_numpy()] = np.minimum(255, 1 + np.round(4 * np.log2(np.maximum(sums.column("n").to_numpy(), 1))))
    return level


def _prefixes(b: pa.RecordBatch, levels: np.ndarray, t: float) -> tuple:
    """The runs of the rare part of each set in a batch: all runs and their sets, then run and set of the prefixes, and the sizes."""
    run, doc, n = _unpack(b)
    level = levels[_slot(run)]
    order = np.lexsort((run, level, doc))
    rank = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    keep = rank < (n - _least_shared(n, t) + 1)[doc]
    at = order[keep]
    return run, doc, run[at], doc[at], n


def _large_tiles(sets: DataFrame, t: float, load) -> DataFrame:
    """run, band, rows of the tiles with more than CHUNK rows. A task reports tiles of which it has at least two rows."""
    bands = Bands(t)

    def count(batches):
        runs, at = [], []
        for b in batches:
            _, _, run, doc, n = _prefixes(b, load.value, t)
            band = bands.of(n)
            below = bands.meets_below(n, band)[doc]
            runs += [run, run[below]]
            at += [band[doc], band[doc][below] - 1]
        run = np.concatenate(runs) if runs else np.empty(0, np.uint64)
        band = np.concatenate(at) if at else np.empty(0, np.int64)
        order = np.lexsort((band, run))
        run, band = run[order], band[order]
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (band[1:] != band[:-1])
        first = np.flatnonzero(new)
        rows = np.diff(np.append(first, len(run)))
        some = rows > 1
        yield pa.record_batch({"run": run[first][some].view(np.int64), "band": band[first][some].astype(np.int32), "rows": rows[some].astype(np.int64)})

    return sets.select("n", "runs").mapInArrow(count, "run long, band int, rows long").groupBy("run", "band").agg(F.sum("rows").alias("rows")).filter(F.col("rows") > CHUNK)


_ROW = "run long, band int, home boolean, n int, c0 long, c1 long, bits binary"


def _tile_rows(sets: DataFrame, t: float, load) -> DataFrame:
    """(run, band, home, n, class, bitmap) for each run of each class's prefix, in the tile of its band and, where it may matter, of the one below."""
    bands = Bands(t)

    def emit(batches):
        for b in batches:
            run, doc, prefix, owner, n = _prefixes(b, load.value, t)
            if not len(prefix):
                continue
            c0, c1 = b.column("c0").to_numpy(), b.column("c1").to_numpy()
            band = bands.of(n)
            full = _bitmaps(run, doc, len(n), WIDE[0] // 64)
            below = bands.meets_below(n, band)
            for shift, mine in ((0, np.ones(len(n), bool)), (1, below)):
                tile = band - shift
                width = np.where(mine, bands.bits(np.maximum(tile, 0)), 0)
                coded = np.full(len(n), None, object)
                for bits in (NARROW[0], WIDE[0]):
                    which = np.flatnonzero(width == bits)
                    words = _fold(full[which], bits // 64)
                    coded[which] = [w.tobytes() for w in words]
                at = np.flatnonzero(mine[owner])
                for lo in range(0, len(at), 50_000):
                    i = at[lo : lo + 50_000]
                    d = owner[i]
                    yield pa.record_batch({"run": prefix[i].view(np.int64), "band": tile[d].astype(np.int32), "home": np.full(len(i), shift == 0), "n": n[d].astype(np.int32), "c0": c0[d], "c1": c1[d], "bits": pa.array(coded[d], pa.binary())})

    return sets.select("c0", "c1", "n", "runs").mapInArrow(emit, _ROW)


def _chunked(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Rows with their tile's part (chunk pair) and their own chunk. A tile that is not large has one part; in a large one each row meets every chunk."""
    big = large.select("run", "band", F.ceil(F.col("rows") / CHUNK).cast("int").alias("chunks"))
    j = rows.join(big, ["run", "band"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    j = j.withColumn("chunk", F.pmod(F.xxhash64("c0", "c1"), F.col("chunks")).cast("int"))
    j = j.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return j.withColumn("part", F.struct(F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi")))


def _tile_pairs(rows: dict, t: float):
    """Pairs of sorted tile rows that pass the size and bitmap bounds: one row per tile in which they meet."""
    edge = (rows["run"][1:] != rows["run"][:-1]) | (rows["band"][1:] != rows["band"][:-1]) | (rows["lo"][1:] != rows["lo"][:-1]) | (rows["hi"][1:] != rows["hi"][:-1])
    group = np.cumsum(np.r_[True, edge])
    new = np.ones(len(group), bool)
    new[1:] = edge | (rows["c0"][1:] != rows["c0"][:-1]) | (rows["c1"][1:] != rows["c1"][:-1])
    size = np.bincount(group[new], minlength=group[-1] + 1)
    use = np.flatnonzero(new & (size[group] > 1))
    if not len(use):
        return
    r, group = {c: v[use] for c, v in rows.items() if c != "bits"}, group[use]
    bits = rows["bits"].take(pa.array(use))
    length = pc.binary_length(bits).fill_null(0).to_numpy()
    n = r["n"].astype(np.int64)
    place = group * np.int64(1 << 32) + n
    end = np.searchsorted(place, group * np.int64(1 << 32) + np.floor(n / t + 1e-9).astype(np.int64), "right")
    many = np.where(r["home"], end - np.arange(len(n)) - 1, 0)
    words = np.zeros((len(n), WIDE[0] // 64), np.uint64)
    for width in (NARROW[0] // 8, WIDE[0] // 8):
        which = np.flatnonzero(length == width)
        if len(which):
            words[which, : width // 8] = np.frombuffer(b"".join(bits.take(pa.array(which)).to_pylist()), np.uint64).reshape(len(which), -1)
    diagonal = r["lo"] == r["hi"]
    upto = np.cumsum(many)
    at = 0
    while at < len(many):
        base = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, base + BLOCK, "right")))
        m = many[at:stop]
        i = np.repeat(np.arange(at, stop), m)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
        at = stop
        ok = diagonal[i] | (r["chunk"][i] != r["chunk"][j])
        i, j = i[ok], j[ok]
        need = _need(n[i], n[j], t)
        for half in (slice(0, 2), slice(2, 4)):  # bits in which the first words differ bound the overlap too
            far = np.bitwise_count(words[i, half] ^ words[j, half]).sum(1, dtype=np.int64)
            far = far if half.start == 0 else far + first
            ok = (n[i] + n[j] - far) // 2 >= need
            i, j, need, first = i[ok], j[ok], need[ok], far[ok]
        if len(i):
            swap = (r["c0"][i] > r["c0"][j]) | ((r["c0"][i] == r["c0"][j]) & (r["c1"][i] > r["c1"][j]))
            a, z = np.where(swap, j, i), np.where(swap, i, j)
            yield pa.record_batch({"a0": r["c0"][a], "a1": r["c1"][a], "z0": r["c0"][z], "z1": r["c1"][z], "na": n[a].astype(np.int32), "nz": n[z].astype(np.int32)})


def _candidates(rows: DataFrame, t: float) -> DataFrame:
    """Pairs of classes that pass the bounds: a0, a1, z0, z1, na, nz."""
    plain = ["run", "band", "lo", "hi", "chunk", "home", "n", "c0", "c1"]

    def meet(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = {c: b.column(c).to_numpy(zero_copy_only=False) for c in plain} | {"bits": b.column("bits")}
            if held is not None:
                rows = {c: np.concatenate([held[c], rows[c]]) for c in plain} | {"bits": pa.concat_arrays([held["bits"], rows["bits"]])}
            # the last tile may go on in the next batch
            last = np.ones(len(rows["run"]), bool)
            for c in ("run", "band", "lo", "hi"):
                last &= rows[c] == rows[c][-1]
            cut = int(np.argmax(last))
            held = {c: v[cut:] for c, v in rows.items()}
            if cut:
                yield from _tile_pairs({c: v[:cut] for c, v in rows.items()}, t)
        if held is not None:
            yield from _tile_pairs(held, t)

    tiles = rows.select("run", "band", F.col("part.lo").alias("lo"), F.col("part.hi").alias("hi"), "chunk", "home", "n", "c0", "c1", "bits")
    tiles = tiles.repartition("run", "band", "lo", "hi").sortWithinPartitions("run", "band", "lo", "hi", "n", "c0", "c1")
    met = tiles.mapInArrow(meet, "a0 long, a1 long, z0 long, z1 long, na int, nz int")
    pairs = met.groupBy("a0", "a1", "z0", "z1").agg(F.count("*").alias("shared"), F.max("na").alias("na"), F.max("nz").alias("nz"))
    need = F.ceil(F.lit(t / (1 + t)) * (F.col("na") + F.col("nz")) - 1e-9)
    return pairs.filter(F.col("shared") >= need - (F.ceil(t * F.greatest("na", "nz") - 1e-9) - 1)).drop("shared")


def _held(scratch: Scratch, sets: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """c0, c1 and a column of each class that is in a pair, once. The classes are written, so that their size is known to the join."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a0").alias("c0"), F.col("a1").alias("c1")), F.struct(F.col("z0").alias("c0"), F.col("z1").alias("c1")))).alias("c"))
    wanted = scratch.write(ends.select("c.c0", "c.c1").distinct(), "wanted")
    mine = sets.filter(F.col(column).isNotNull()).select("c0", "c1", column).join(wanted, ["c0", "c1"], "left_semi")
    return mine.groupBy("c0", "c1").agg(F.first(column).alias(column))


def _both(pairs: DataFrame, held: DataFrame, column: str) -> DataFrame:
    """Pairs with a column of both classes beside them, as x and y."""
    a = held.select(F.col("c0").alias("a0"), F.col("c1").alias("a1"), F.col(column).alias("x"))
    z = held.select(F.col("c0").alias("z0"), F.col("c1").alias("z1"), F.col(column).alias("y"))
    return pairs.join(a, ["a0", "a1"]).join(z, ["z0", "z1"])


_PAIR = "a0 long, a1 long, z0 long, z1 long, na int, nz int"


def _near(pairs: DataFrame, t: float) -> DataFrame:
    """Pairs of large classes whose signatures (x, y) allow the overlap they need."""
    names = ["a0", "a1", "z0", "z1", "na", "nz"]

    def check(batches):
        for b in batches:
            far = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64)[None], np.frombuffer(y, np.uint64)[None]
                words = min(x.shape[1], y.shape[1])
                far.append(int(np.bitwise_count(_fold(x, words) ^ _fold(y, words)).sum()))
            a, z = b.column("na").to_numpy().astype(np.int64), b.column("nz").to_numpy().astype(np.int64)
            ok = pa.array((a + z - np.array(far, np.int64)) // 2 >= _need(a, z, t))
            yield pa.RecordBatch.from_arrays([b.column(c).filter(ok) for c in names], names)

    return pairs.mapInArrow(check, _PAIR)


def _exact(pairs: DataFrame, t: float) -> DataFrame:
    """Pairs whose sorted sets (x, y) are alike enough, with their similarity."""
    def check(batches):
        for b in batches:
            sim = np.empty(b.num_rows)
            for i, (x, y) in enumerate(zip(b.column("x").to_pylist(), b.column("y").to_pylist())):
                x, y = unpack_runs(x), unpack_runs(y)
                at = y.searchsorted(x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                sim[i] = both / (len(x) + len(y) - both)
            ok = pa.array(sim >= t - 1e-12)
            yield pa.RecordBatch.from_arrays([*(b.column(c).filter(ok) for c in ("a0", "a1", "z0", "z1")), pa.array(sim).filter(ok)], ["a0", "a1", "z0", "z1", "similarity"])

    return pairs.mapInArrow(check, "a0 long, a1 long, z0 long, z1 long, similarity double")


class NearDuplicates:
    """All groups of near-duplicates among ``rows``.

    key, text   columns of ``rows``; the text is lower-cased, its words are the longest runs of a-z, 0-9 and _.
    k, t        words per run; the least Jaccard similarity of two sets of runs.

    Null, empty and wordless texts and texts of fewer than k words have no runs and are like nothing; they keep a class of their own
    (n = 0, not listed as copies of each other). Rows with a null key are ignored. Repeated rows of a key count once; where the texts
    of a key differ, all of them count and the key is in several classes. Other columns are ignored. Empty tables give empty results.
    """

    def __init__(self, rows: DataFrame, key: str, text: str, k: int = 5, t: float = 0.8):
        spark = rows.sparkSession
        self.scratch = scratch = Scratch(spark, "neardup")
        texts = spread(rows.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text")).filter("key is not null"), "key")
        read = scratch.write(_sets(texts, k, t), "sets")
        self.members = scratch.write(read.select("key", "c0", "c1", "n").distinct(), "members")
        sets = read.filter("runs is not null")
        load = spark.sparkContext.broadcast(_load_table(sets))
        large = scratch.write(_large_tiles(sets, t, load), "large")
        candidates = scratch.write(_candidates(_chunked(_tile_rows(sets, t, load), large), t), "candidates")
        # pairs of the larger bands meet by their signatures; the bitmaps of the others were compared in the tiles
        signed = F.least("na", "nz") >= Bands(t).signed
        far = candidates.filter(signed)
        near = candidates.filter(~signed).unionAll(_near(_both(far, _held(scratch, sets, far, "sig"), "sig"), t))
        near = scratch.write(near, "near")
        #: Links between different classes: a0, a1, z0, z1, similarity.
        self.links = scratch.write(_exact(_both(near, scratch.write(_held(scratch, sets, near, "runs"), "held"), "runs"), t), "links")

    def classes(self) -> DataFrame:
        """key, class_key (the least key with the same set), n_copies (others in the class), n_links (links of the class to others)."""
        m = self.members
        size = m.filter("n > 0").groupBy("c0", "c1").agg(F.min("key").alias("class_key"), (F.count("*") - 1).alias("n_copies"))
        ends = self.links.select(F.explode(F.array(F.struct(F.col("a0").alias("c0"), F.col("a1").alias("c1")), F.struct(F.col("z0").alias("c0"), F.col("z1").alias("c1")))).alias("c"))
        links = ends.groupBy("c.c0", "c.c1").agg(F.count("*").alias("n_links"))
        # the class rows are unique, so a class with a third of all members splits on the members' side
        one = m.join(size.join(links, ["c0", "c1"], "left"), ["c0", "c1"], "left")
        return one.select("key", F.coalesce("class_key", "key").alias("class_key"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def class_links(self) -> DataFrame:
        """class_a < class_b, similarity: the links between classes by their least keys, so copies add no rows.

        A key whose texts differ may be the least of several classes: its link to itself is left out, and the best of equal pairs counts.
        """
        least = self.members.filter("n > 0").groupBy("c0", "c1").agg(F.min("key").alias("key"))
        a = least.select(F.col("c0").alias("a0"), F.col("c1").alias("a1"), F.col("key").alias("x"))
        z = least.select(F.col("c0").alias("z0"), F.col("c1").alias("z1"), F.col("key").alias("y"))
        both = self.links.join(a, ["a0", "a1"]).join(z, ["z0", "z1"]).filter("x != y")
        return both.groupBy(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b")).agg(F.max("similarity").alias("similarity"))

    def pairs(self) -> DataFrame:
        """key_a < key_b for every pair of keys that are alike, copies included: as many rows as there are such pairs."""
        m = self.members.filter("n > 0")
        left = m.select(F.col("c0").alias("a0"), F.col("c1").alias("a1"), F.col("key").alias("x"))
        right = m.select(F.col("c0").alias("z0"), F.col("c1").alias("z1"), F.col("key").alias("y"))
        between = self.links.join(left, ["a0", "a1"]).join(right, ["z0", "z1"]).filter("x != y").select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
        shared = m.groupBy("c0", "c1").agg(F.count("*").alias("size")).filter("size > 1").select("c0", "c1")
        copies = m.select("c0", "c1", "key").join(shared, ["c0", "c1"], "left_semi")
        twin = copies.select("c0", "c1", F.col("key").alias("y"))
        within = copies.join(twin, ["c0", "c1"]).filter("key < y").select(F.col("key").alias("key_a"), F.col("y").alias("key_b"))
        return between.union(within).distinct()
