"""Near duplicates and repeated passages against brute force."""

import hashlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from common import WORDS, documents, empty, rows
from pyspark.sql import functions as F

from kvlake.llm import near_dup, substring

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(data):
    sets = {i: shingles(t) for i, t, *_ in data}
    part = {i: i for i in sets}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            part[y] = x
    return Counter((i, len(sets[i]), root(i), root(i) == i) for i, *_ in data)


def result(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


NEAR = ("doc_id", "n_shingles", "component_id", "kept")


def test_near_duplicates(spark):
    assert result(near_dup.near_duplicates(documents(spark)), *NEAR) == brute_components(rows())


@pytest.mark.parametrize("options", [{"node": 8, "depth": 1}, {"node": 6, "depth": 2, "budget": 900}])
def test_near_duplicates_beyond_every_limit(spark, options):
    """Large nodes and groups over the budget go their own ways, with the same result."""
    data = [(i, t, *x) for i, (_, t, *x) in enumerate(rows() + [(0, rows()[8][1] + f" w{n}", "en", "s", 1) for n in range(40)])]
    df = spark.createDataFrame(data, documents(spark).schema)
    assert result(near_dup.near_duplicates(df, **options), *NEAR) == brute_components(data)


def test_near_duplicates_of_nothing(spark):
    assert near_dup.near_duplicates(empty(spark)).count() == 0
    clash = documents(spark).limit(3).withColumns({c: F.lit(1) for c in ("node", "component", "sketch", "kept", "n_shingles")})
    assert near_dup.near_duplicates(clash).count() == 3


def test_settling_compares_all_pairs():
    r = np.random.default_rng(2)
    sets = [np.unique(r.choice(60, size=r.integers(5, 30)).astype(np.uint64)) for _ in range(80)]
    linked = near_dup.joined(list(range(80)), near_dup.settle(sets, 50, 100))
    want = {i: i for i in range(80)}
    for a, b in combinations(range(80), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 50 * (len(sets[a]) + len(sets[b]) - both) and want[a] != want[b]:
            lo, hi = sorted((want[a], want[b]))
            want = {k: lo if v == hi else v for k, v in want.items()}
    assert dict(linked) == {k: v for k, v in want.items() if k != v}


def repeated_ids():
    """Ids in several rows, of different and of equal texts, and near copies of only one of the texts."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    data = [(1, a), (1, b), (5, a + " x"), (7, b + " x"), (9, a), (9, "c " * 30), (4, "c " * 30 + "d"), (8, None), (8, a), (3, "other words of no other text"), (3, "other words of no other text")]
    return [*data, *[(2, f"only this text number {i} " + " ".join(f"z{i}.{k}" for k in range(9))) for i in range(3)]]


@pytest.mark.parametrize("options", [{}, {"budget": 60}])
def test_near_duplicates_of_repeated_ids(spark, options):
    """Every row's component, where all rows of one id are one document."""
    data = repeated_ids()
    got = near_dup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), **options)
    part = {i: i for i, _ in data}
    for (i, s), (j, t) in combinations([(i, shingles(t)) for i, t in data], 2):
        both = len(s & t)
        if both and 100 * both >= 75 * len(s | t):
            x, y = sorted((part[i], part[j]))
            part = {k: x if v == y else v for k, v in part.items()}
    of = lambda i, t: part[i] if shingles(t) else i
    assert result(got, *NEAR) == Counter((i, len(shingles(t)), of(i, t), of(i, t) == i) for i, t in data)


def test_components_of_hubs_and_chains(spark):
    """A hub amid its neighbours, a chain that runs up and down, and a pair; links repeat and meet themselves."""
    hub = [(500, n) for n in range(400, 600)]
    chain = [(1000 + (n * 37) % 101, 1000 + ((n + 1) * 37) % 101) for n in range(100)]
    links = spark.createDataFrame([*hub, *hub[:3], *chain, (8, 9)], "a long, b long")
    found, _ = near_dup.components(links)
    expected = {n: 400 for n in range(400, 600)} | {n: 1000 for n in range(1000, 1101)} | {8: 8, 9: 8}
    assert sorted(map(tuple, found.collect())) == sorted(expected.items())


def test_sketch_recall():
    """One step of twelve trees finds pairs at the threshold: of 20,000 pairs whose tokens agree by chance of 0.75, all meet in some node."""
    r, met = np.random.default_rng(4), 0
    for _ in range(20):
        n = 1000
        a, b = (r.integers(0, 2**32, (n, near_dup.SKETCH)).astype(np.uint32) for _ in range(2))
        b = np.where(r.random(a.shape) < 0.75, a, b)
        found = np.zeros(n, bool)
        for tree in range(12):
            root = near_dup.mix(np.full(n, tree + 1, np.uint64))
            pairs = [set(zip(*map(np.ndarray.tolist, near_dup._children(root, x, 0.75)), strict=True)) for x in (a, b)]
            found[[i for i, _ in pairs[0] & pairs[1]]] = True
        met += int(found.sum())
    assert met == 20_000


def test_sketches_agree_as_sets_do():
    r = np.random.default_rng(5)
    both, apart = r.integers(0, 2**63, 1500).astype(np.uint64), r.integers(0, 2**63, 500).astype(np.uint64)
    shares = []
    for k in range(20):
        seed = near_dup.mix(np.full(1, k, np.uint64))
        x, y = (np.frombuffer(t, np.uint32) for t in near_dup.sketches([np.concatenate([both, p]) ^ seed for p in (apart[:250], apart[250:])]))
        shares.append((x == y).mean())
    assert abs(np.mean(shares) - 0.75) < 0.04


def brute_repeats(data, length=20):
    """n_words, n_removed, sha256 of the rest and the longest doubling of length that repeats, of documents with unique or wholly equal rows."""
    seen, places, out = {}, {}, Counter()
    for i, t, *_ in sorted(data, key=lambda x: x[0]):
        w = WORDS.findall(t or "")
        for n in (length << k for k in range(20)):
            for p in range(len(w) - n + 1):
                places.setdefault(tuple(w[p : p + n]), set()).add((i, p))
    for i, t, *_ in sorted(data, key=lambda x: x[0]):
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            key = tuple(w[p : p + length])
            if seen.setdefault(key, (i, p)) < (i, p):
                gone[p : p + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        longest = max((n for n in (length << k for k in range(20)) if any(len(places[tuple(w[p : p + n])]) > 1 for p in range(len(w) - n + 1))), default=0)
        out[(i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), longest)] += 1
    return out


REPEATS = ("doc_id", "n_words", "n_removed", "kept_sha256", "longest_repeat")


@pytest.mark.parametrize("seed", [1, 5])
def test_repeats(spark, seed):
    assert result(substring.remove_repeats(documents(spark, seed), levels=True), *REPEATS) == brute_repeats(rows(seed))


def test_repeats_at_other_lengths_and_of_nothing(spark):
    assert result(substring.remove_repeats(documents(spark), length=7, levels=True), *REPEATS) == brute_repeats(rows(), 7)
    assert substring.remove_repeats(empty(spark)).count() == 0
    clash = documents(spark).withColumns({c: F.lit(1) for c in ("h", "start", "starts", "own", "sha")})
    assert result(substring.remove_repeats(clash, levels=True), *REPEATS) == brute_repeats(rows())


def test_levels_double_until_none_survives(spark):
    """Passages of 100 and 333 words, words that repeat within one text, and a very long text."""
    r = np.random.default_rng(1)
    prose = lambda n: " ".join(map(str, r.integers(0, 10**9, n)))
    short, long = prose(100), prose(333)
    data = [(1, f"{short} {prose(9)}"), (2, f"{prose(50)} {short}"), (3, f"{long} {prose(5)} {long}"), (4, "the same " * 400), (5, prose(19)), (6, prose(20_000)), (7, f"{prose(3)} {short} {long}")]
    got = result(substring.remove_repeats(spark.createDataFrame(data, "doc_id long, text string"), levels=True), *REPEATS)
    assert got == brute_repeats(data) and {x[0]: x[4] for x in got} == {1: 80, 2: 80, 3: 320, 4: 640, 5: 0, 6: 0, 7: 320}


def test_rows_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (None, text), (5, text), (7, text)], "doc_id long, text string")
    assert result(near_dup.near_duplicates(df), *NEAR) == Counter({(None, 26, None, True): 2, (5, 26, 5, True): 1, (7, 26, 5, False): 1})
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring.remove_repeats(df).collect()) == [(0, 0), (0, 0), (5, 0), (7, 30)]
