"""Near-duplicates, term counts, packing, mixing and cutting: against brute force and round trips."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillspan.llm import neardup
from quillspan.llm.cutting import cut, cut_text, read_tree
from quillspan.llm.mixing import Mix, cheapest_flow, largest_total, settle
from quillspan.llm.neardup import NearDuplicates
from quillspan.llm.packing import pack, plan
from quillspan.llm.running import running_total
from quillspan.llm.shingles import RUN_BYTES, pack_runs, shingle_sets, unpack_runs
from quillspan.llm.termfreq import marked_terms, term_counts
from quillspan.llm.tokens import tokens
from quillspan.session import Scratch


def word_sets(text, k):
    w = re.findall("[a-z0-9_]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_shingle_sets():
    rnd = random.Random(1)
    texts = ["", None, "a b c", "  a  b--c ", "a b", "x", "ä b c d", *(" ".join(rnd.choice(["aa", "b_", "c1", "é"]) + rnd.choice(["", ";", "\n"]) for _ in range(rnd.randrange(40))) for _ in range(50))]
    for arr in (pa.array(texts), pa.array(["zz zz", *texts])[1:]):
        run, doc, count = shingle_sets(arr, 3)
        assert count.tolist() == [len(word_sets(t, 3)) for t in texts]
        for i, j in [(2, 3), (6, 2), *((rnd.randrange(len(texts)), rnd.randrange(len(texts))) for _ in range(200))]:
            assert len(np.intersect1d(run[doc == i], run[doc == j])) == len(word_sets(texts[i], 3) & word_sets(texts[j], 3))


def test_packed_runs():
    run, _, _ = shingle_sets(pa.array(["a b c d e f g h"]), 3)
    assert (unpack_runs(pack_runs(run)) == run).all() and len(pack_runs(run)) == RUN_BYTES * len(run)
    assert (unpack_runs([pack_runs(run[:2]), b"", pack_runs(run[2:])]) == run).all() and len(unpack_runs([])) == len(unpack_runs(b"")) == 0


def fixture(rnd):
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        base = [rnd.choice(words) for _ in range(rnd.randrange(5, 220))]
        texts.append(base)
        for _ in range(rnd.randrange(4)):
            new = list(base)
            for _ in range(rnd.randrange(6)):
                new[rnd.randrange(len(new))] = rnd.choice(words)
            texts.append(new)
    for n in (127, 128, 129, 130, 131, 132, 135, 256, 257):  # sizes on both sides of the bitmap widths, nearly the same text
        texts.append([f"v{i}" for i in range(n + 2)])
    boiler = ["proc", "sql", "create", "table", "as", "select", "from"]
    out = [" ".join(t) for t in texts] + [" ".join(boiler * 3 + [rnd.choice(words) for _ in range(4)]) for _ in range(80)]
    return out + [out[3]] * 40 + [out[0].upper(), "", None, "one two", "-- !!"]


@pytest.mark.parametrize("chunk", [8192, 5])
def test_near_duplicates(spark, monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    rnd = random.Random(7)
    texts = fixture(rnd)
    data = [(i, t, i % 3) for i, t in enumerate(texts)] + [(0, texts[0], 1), (None, "a b c d e", 1)]
    df = spark.createDataFrame(data, "id long, t string, n int").repartition(5)
    found = NearDuplicates(df, "id", "t", k=3, t=0.7)
    sets = [word_sets(t, 3) for t in texts]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and len(sets[i] & sets[j]) * 10 >= 7 * len(sets[i] | sets[j])}
    got = [tuple(r) for r in found.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    classes = {r.key: r for r in found.classes().collect()}
    assert len(classes) == len(texts)
    for i, s in enumerate(sets):
        same = [j for j, z in enumerate(sets) if s and z == s] or [i]
        links = {frozenset(z) for z in sets if s and z and z != s and len(s & z) * 10 >= 7 * len(s | z)}
        assert (classes[i].class_key, classes[i].n_copies, classes[i].n_links) == (min(same), len(same) - 1, len(links))


def test_large_sets(spark):
    """Sets of all sizes on both sides of the bands and signature widths, many of them nearly alike."""
    rnd = random.Random(11)
    texts = []
    for n in (60, 99, 101, 110, 300, 390, 401, 405, 430, 800, 1300, 3000):
        base = [f"u{n}_{i}" for i in range(n + 4)]
        texts.append(base)
        for share in (0.02, 0.05, 0.1, 0.2):
            new = base[: int(len(base) * (1 - share * rnd.random()))]
            for _ in range(max(1, int(share * n / 10))):
                new[rnd.randrange(len(new))] = f"x{rnd.randrange(10**6)}"
            texts.append(new)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, t string").repartition(3)
    sets = [word_sets(" ".join(t), 5) for t in texts]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) * 10 >= 8 * len(sets[i] | sets[j])}
    assert len(want) > 20 and {tuple(r) for r in NearDuplicates(df, "id", "t").pairs().collect()} == want


@pytest.mark.parametrize("t", [0.5, 0.7, 0.8, 0.95])
def test_bands(t):
    bands = neardup.Bands(t)
    n = np.arange(1, 5000)
    band = bands.of(n)
    assert (bands.low[band] <= n).all() and (n < bands.low[band + 1]).all()
    for a in range(1, 700, 7):
        for b in range(a, int(a / t + 1e-9) + 1):  # similar sizes lie in one band or two neighbours, the larger then meets the band below
            x, y = band[a - 1], band[b - 1]
            assert x == y or (y == x + 1 and bands.meets_below(np.array([b]), np.array([y]))[0])


def test_near_duplicates_class_links(spark):
    texts = fixture(random.Random(8))
    found = NearDuplicates(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t", k=3, t=0.7)
    least = {}
    for i, t in enumerate(texts):
        least.setdefault(frozenset(word_sets(t, 3)), i)
    least.pop(frozenset(), None)
    like = {(i, j): len(s & z) / len(s | z) for s, i in least.items() for z, j in least.items() if i < j}
    got = {(r.class_a, r.class_b): r.similarity for r in found.class_links().collect()}
    assert got and got == pytest.approx({p: s for p, s in like.items() if s >= 0.7 - 1e-12})


def test_near_duplicates_empty(spark):
    df = spark.createDataFrame([], "id long, t string")
    found = NearDuplicates(df, "id", "t")
    assert found.pairs().count() == 0 and found.classes().count() == 0


def test_term_counts(spark):
    rnd = random.Random(2)
    data = [("hot" if rnd.random() < 0.5 else f"t{int(rnd.paretovariate(0.6)) % 900}", f"f{rnd.randrange(60)}", "x") for _ in range(6000)]
    data += [(None, "f1", ""), ("t1", None, ""), ("long" * 9000, "f1", "")]
    df = spark.createDataFrame(data, "term string, file string, n string").repartition(5)
    kept = [(t, f) for t, f, _ in data if t is not None and f is not None]
    n, files = Counter(t for t, _ in kept), Counter(t for t, _ in set(kept))
    assert {r.term: (r.n, r.n_records) for r in term_counts(df, "term", "file").collect()} == {t: (n[t], files[t]) for t in n}
    total = len({f for _, f in kept})
    got = {r.term: r.mark for r in marked_terms(df, "term", "file").collect()}
    assert got == {t: "rare" if files[t] <= 2 else "common" if files[t] * 10 > total else None for t in n}
    assert term_counts(df.limit(0), "term", "file").count() == 0


def test_running_total(spark):
    rnd = random.Random(4)
    data = [(rnd.choice(["a", "a", "b", None]), i, rnd.randrange(9)) for i in range(3000)]
    got = running_total(spark.createDataFrame(data, "g string, id int, w int"), ["g"], "id", "w", 5).collect()
    assert len(got) == len(data)
    for g in ("a", "b", None):
        at = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: (r.before, r.before + r.w)):
            assert r.before == at
            at += r.w


def test_running_total_by_rank(spark):
    data = [("a", i, i % 7, i % 3) for i in range(500)]
    got = sorted(running_total(spark.createDataFrame(data, "g string, id int, w int, r int"), ["g"], "id", "w", 5, "r").collect(), key=lambda r: (r.before, r.before + r.w))
    assert [r.r for r in got if r.w] == sorted(r.r for r in got if r.w)


def best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= s]
        if fit:
            bins[min(fit, key=bins.__getitem__)] -= s
        else:
            bins.append(capacity - s)
    return len(bins)


def test_plan():
    rnd = random.Random(6)
    for trial in range(60):
        capacity = rnd.choice([1, 7, 64, 512])
        sizes = [min(capacity, 1 + int(rnd.paretovariate(0.7))) if trial % 2 else rnd.randint(1, capacity) for _ in range(rnd.randrange(500))]
        places, n = plan(Counter(sizes), capacity)
        fill = Counter()
        for s, count in Counter(sizes).items():
            mine = [i for i in range(len(places["size"])) if places["size"][i] == s]
            for rank in range(count):
                i = max(i for i in mine if places["first"][i] <= rank)
                fill[int(places["base"][i] + (rank - places["first"][i]) // places["each"][i])] += s
        assert sum(fill.values()) == sum(sizes) and set(fill) == set(range(n)) and max(fill.values(), default=0) <= capacity
        assert n <= best_fit(sizes, capacity) * 1.05 + 2


def test_pack(spark):
    rnd = random.Random(8)
    data = [(i, rnd.choice([0, 1, 7, 30, 64, 65, 200, rnd.randrange(64)])) for i in range(900)]
    out = pack(spark.createDataFrame(data, "key long, n_tokens long"), 64, Scratch(spark, "t")).collect()
    cover, fill = {}, Counter()
    for r in out:
        if r.container is None:
            assert r.n_tokens == 0
        else:
            fill[r.container] += r.n_tokens
        cover.setdefault(r.key, []).append((r.start_token, r.n_tokens))
    assert max(fill.values()) <= 64 and set(fill) == set(range(len(fill)))
    for k, n in data:
        at = 0
        for start, m in sorted(cover[k]):
            assert start == at
            at += m
        assert at == n and (n > 64 or len(cover[k]) == 1)
    assert sum(fill.values()) / (64 * len(fill)) > 0.95
    assert pack(spark.createDataFrame([], "key long, n_tokens long"), 64, Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("capacity", [1 << 19, 1 << 24])
def test_pack_large_capacities(spark, capacity):
    rnd = random.Random(2)
    data = [(i, rnd.choice([capacity, capacity - 1, capacity + 5, 3 * capacity + 1, capacity // 2, rnd.randrange(capacity)])) for i in range(300)]
    out = pack(spark.createDataFrame(data, "key long, n_tokens long"), capacity, Scratch(spark, "t")).collect()
    fill, got = Counter(), Counter()
    for r in out:
        if r.container is not None:
            fill[r.container] += r.n_tokens
        got[r.key] += r.n_tokens
    assert got == Counter(dict(data)) and max(fill.values()) <= capacity and set(fill) == set(range(len(fill)))


def test_flow_prefers_fresh_text():
    flow, total = cheapest_flow({(0,): 10, (1,): 100, (0, 1): 50}, [3, 3], [45, 100])
    assert total == 145
    assert flow[(0,), 0] == 10 and flow[(0, 1), 0] == 35  # no repeats while shared text is fresh
    huge = 10**14 + 7
    flow, total = cheapest_flow({(0,): huge, (1,): 3}, [2, 2], [2 * huge, 5])
    assert total == 2 * huge + 5 and flow[(0,), 0] == 2 * huge  # whole tokens, however many
    assert largest_total({(0,): huge, (1,): huge // 4}, [1, 2], [0.5, 0.5]) == pytest.approx(huge, rel=1e-8)


def test_mix_of_many_sources(spark):
    names = [f"s{i:02d}" for i in range(40)]
    data = [(i, f"row {i} alpha beta", names[i % 40]) for i in range(4000)] + [(9000 + i, f"row {i} alpha beta", names[39 - i % 40]) for i in range(0, 400, 3)]
    m = Mix(spark.createDataFrame(data, "id long, text string, src string"), "id", "text", "src", [(n, 1 / 40, 1) for n in names])
    shares = [r.share for r in m.report().collect()]
    assert len(shares) == 40 and max(abs(x - 1 / 40) for x in shares) < 0.002


def test_mix(spark):
    rnd = random.Random(9)
    data = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", "row", "key"]) for _ in range(rnd.randrange(1, 60))) + f" {i}", rnd.choice(["a"] * 6 + ["b"] * 3 + ["c", None, "zz"])) for i in range(1500)]
    data += [(5000 + i, data[i][1], "b") for i in range(200)] + [(9000, None, "a"), (9001, "", "a"), (9002, "long " * 3000, None)]
    df = spark.createDataFrame(data, "id long, text string, src string").selectExpr("*", "1 as n", "2 as pattern")
    m = Mix(df, "id", "text", "src", [("a", 0.4, 1), ("b", 0.4, 2), ("c", 0.15, 3), ("none", 0.05, 2)], seed=1)
    shares = {r.source: r for r in m.report().collect()}
    assert set(shares) == {"a", "b", "c", "none"} and shares["none"].n_tokens == 0
    for s, want in (("a", 0.4 / 0.95), ("b", 0.4 / 0.95), ("c", 0.15 / 0.95)):
        assert shares[s].share == pytest.approx(want, abs=0.003)
    sources = {}
    for i, t, s in data:
        sources.setdefault(t, set()).add(s)
    text = {i: t for i, t, _ in data}
    cap, used = {"a": 1, "b": 2, "c": 3}, Counter()
    for r in m.uses.collect():
        assert r.source in sources[text[r.key]]
        used[text[r.key]] += r.uses
    assert all(n <= min(cap[s] for s in sources[t] if s in cap) for t, n in used.items())
    again = Mix(df.repartition(7), "id", "text", "src", [("a", 0.4, 1), ("b", 0.4, 2), ("c", 0.15, 3), ("none", 0.05, 2)], seed=1)
    assert sorted(map(tuple, again.uses.collect())) == sorted(map(tuple, m.uses.collect()))
    much = {r.source: r for r in Mix(df, "id", "text", "src", [("a", 0.5, 1), ("c", 0.5, 2)], total=1e6).report().collect()}
    assert much["c"].share < 0.5 and much["c"].n_uses == 2 * much["c"].n_texts
    none = Mix(df.limit(0), "id", "text", "src", [("a", 1.0, 1)])
    assert none.uses.count() == 0 and none.report().first().share == 0.0


def test_mix_takes_texts_of_all_sizes(spark):
    rnd = random.Random(3)
    sized = lambda n: " ".join(rnd.choice(["alpha", "beta", "row"]) for _ in range(n))
    data = [(i, sized(rnd.randrange(200, 400) if i % 10 == 0 else rnd.randrange(3, 15)) + f" {i}", "a") for i in range(2000)]
    data += [(5000 + i, sized(rnd.randrange(3, 15)) + f" {i}", "b") for i in range(700)]
    df = spark.createDataFrame(data, "id long, text string, src string")
    m = Mix(df, "id", "text", "src", [("a", 0.5, 1), ("b", 0.5, 1)], seed=1)
    for r in m.report().collect():
        assert r.share == pytest.approx(0.5, abs=0.003)
    a = [r.n_tokens for r in m.uses.collect() if r.source == "a"]
    all_a = [r.n for r in m.units.filter("pattern = '0'").collect()]
    big = lambda ns: sum(n for n in ns if n > 100) / sum(ns)
    assert sum(a) < 0.2 * sum(all_a) and big(a) == pytest.approx(big(all_a), abs=0.15)


def test_mix_of_a_part(spark):
    data = [(i, f"row {i} alpha", "a") for i in range(500)] + [(1000 + i, f"key {i} beta", "b") for i in range(20)]
    df = spark.createDataFrame(data, "id long, text string, src string")
    m = Mix(df, "id", "text", "src", [("a", 0.5, 1), ("b", 0.5, 3)], part=1.0)
    n = {r.source: r for r in m.report().collect()}
    listed = m.units.groupBy().sum("n").first()[0]
    assert n["b"].n_texts == 20 and n["b"].n_uses == 60 and n["b"].share < 0.3  # short: all it may give
    assert n["a"].n_tokens == pytest.approx(listed / 2, abs=5)
    with pytest.raises(ValueError):
        Mix(df, "id", "text", "src", [("a", 1.0, 1)], total=10.0, part=1.0)


def test_settle_meets_borders():
    rnd = random.Random(6)
    for _ in range(300):
        ns = [rnd.randrange(1, 60) if rnd.random() < 0.9 else rnd.randrange(200, 2000) for _ in range(300)]
        before, size, cap = np.cumsum([0, *ns[:-1]]).tolist(), sum(ns), 3
        ends = np.sort(np.array([rnd.uniform(0, cap * size) for _ in range(rnd.randint(1, 3))]))
        k = len(ends)
        uses = np.zeros((len(ns), k + 1), int)
        for r in range(cap):
            for i, (b, n) in enumerate(zip(before, ns)):
                uses[i, np.searchsorted(ends, r * size + b + n / 2, "left")] += 1
        owed = [0.0] * k
        for b, j, d in settle(size, cap, ends, list(range(k)), list(zip(before, ns)), owed):
            uses[before.index(b), j] += d
        assert uses.min() >= 0 and uses[:, :k].sum(axis=1).max() <= cap
        got = uses[:, :k].T @ np.array(ns)
        assert np.allclose(np.diff([0, *ends]) - got, owed)
        if min(np.diff([0, *ends, cap * size])) > 10000:
            assert np.abs(owed).max() < 60


def test_cut(spark):
    rnd = random.Random(10)
    sentence = lambda: " ".join(rnd.choice(["The", "merge", "schlüssel", "表", "keeps", "dwh.calendar_dim", "😀"]) for _ in range(rnd.randrange(3, 15))) + rnd.choice([". ", "! ", "。", ".\n"])
    texts = ["", None, "short", "x" * 5000, "表" * 900, " " * 3000, "\r\n" * 800, "a-b;" * 900, "".join(rnd.choice("ab表é😀 \n") for _ in range(4000))]
    for _ in range(30):
        t = ""
        for s in range(rnd.randrange(1, 6)):
            t += "#" * rnd.randint(1, 4) + f" Part {s}\n\n" + "".join(sentence() for _ in range(rnd.randrange(40))) + "\n\n- one item\n- two\n\n"
        texts.append(t)
    data = list(enumerate(texts))
    limits = [("small", 40, 8), ("plain", 100, 0)]
    out = cut(spark.createDataFrame(data, "id long, t string").selectExpr("*", "1 as text", "2 as key"), "id", "t", limits).collect()
    tok = tokens()
    for name, most, overlap in limits:
        for i, t in data:
            mine = sorted((r for r in out if r.limit_name == name and r.key == i), key=lambda r: r.piece)
            ids = tok.encode(t) if t else []
            if len(ids) <= most:
                assert not mine
                continue
            assert mine[0].start_token == 0 and mine[-1].end_token == len(ids)
            for r in mine:
                assert r.text == t[r.start_char : r.end_char] and len(tok.encode(r.text)) == r.n_tokens <= most
            for a, b in zip(mine, mine[1:]):
                assert b.start_token + b.shared_tokens == a.end_token and a.end_token < b.end_token
                assert b.shared_tokens == overlap or 0 < b.shared_tokens - overlap <= 3 or b.start_token == 0
    assert cut(spark.createDataFrame([], "id long, t string"), "id", "t", limits).count() == 0


def test_cut_prefers_structure(spark):
    text = "".join(f"# Head {i}\n\n" + "A line of some plain words.\n" * 8 + "\n" for i in range(6))
    out = cut(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t", [("x", 130, 0)]).collect()
    assert all(r.text.startswith("# Head") for r in out)


def outline(node):
    """The tree as nested lists: kinds with levels, and the numbers of leaves."""
    return [node.kind if node.kind not in ("section", "item") else f"{node.kind} {node.level}", *[k if isinstance(k, int) else outline(k) for k in node.kids]]


def test_read_tree():
    text = (
        "intro line\n\n# One\n\n## Two\npara a\npara b\n\n- item\n  more\n  - inner\n- last\n\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n\n```sas\ndata a;\n\nrun;\n```\n"
        "Under\n\nTitle\n=====\n<div>\n<p>x</p>\ny\n</div>\n\n## Empty\n\n## End\n"
    )
    root, starts, lines = read_tree(text)
    assert outline(root) == [
        "text", ["paragraph", 0],
        ["section 1", ["section 2", ["paragraph", 1, 2], ["list", ["item 0", 3, 4, ["item 2", 5]], ["item 0", 6]], ["table", 7, 8], ["fence", ["paragraph", 9], ["paragraph", 10, 11]], ["paragraph", 12]]],
        ["section 1", ["element", 13, ["element", 14], ["paragraph", 15], 16]],
    ]
    begins = [text[a : a + 5] for a in starts]
    assert begins[0] == "intro" and begins[1] == "# One" and begins[7] == "| a |" and begins[9] == "```sa" and begins[13] == "Title"
    assert text[lines[1] :].startswith("para a") and text[lines[7] :].startswith("| 1") and starts == sorted(starts)
    assert outline(read_tree("# a\n# b")[0]) == ["text", ["section 1", 0]] and read_tree("# a\n# b")[1] == [0]
    deep = "".join("<div>\n" for _ in range(3000)) + "x " * 3000
    assert cut_text(deep, 64, 8)


def test_cut_small_limits_and_headings():
    rnd = random.Random(12)
    tok = tokens()
    for limit, overlap in ((4, 1), (6, 2), (40, 8)):
        for _ in range(40):
            t = "".join(rnd.choice("ab表é😀 \n\n  .#|-1") for _ in range(rnd.randrange(5, 500)))
            at = 0
            for _, a, z, start, end, shared, n, piece in cut_text(t, limit, overlap):
                assert piece == t[a:z] and n == len(tok.encode(piece)) <= limit and start + shared == at < end
                at = end
    for _ in range(30):
        parts = []
        for i in range(rnd.randrange(2, 12)):
            parts.append("#" * rnd.randint(1, 3) + f" Heading {i}\n\n")
            parts.append("".join("- " * rnd.randint(0, 1) + "some words of a line " * rnd.randint(1, 9) + "\n" * rnd.randint(1, 2) for _ in range(rnd.randrange(0, 12))))
        text = "".join(parts) + "the last words\n"
        rows = cut_text(text, 60, 6)
        for (*_, start, end, shared, _, _), (*_, end_b, _, _, _) in zip(rows, rows[1:]):
            assert end_b - start > 60  # no two neighbours fit into one
        for _, a, z, _, _, _, _, piece in rows:
            last = piece.rstrip().splitlines()[-1] if piece.strip() else ""
            assert z == len(text) or not last.startswith("#")  # a heading goes with what follows it
