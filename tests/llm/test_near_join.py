"""The near-dedup stage against a brute-force Jaccard join over five-word shingles."""

import itertools
import random

import numpy as np

from panelspark.llm import shingle_join, simhash_dedup


def plain_kept(rows, words=5):
    """Ids left when each component of pairs at Jaccard 0.8 or more keeps its smallest, and how many pairs there are."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n = 0
    for a, b in itertools.combinations(sorted(sets), 2):
        both, all_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if 5 * both >= 4 * all_:
            n += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}, n


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_components(spark):
    """Against the join of all pairs: no text goes that should stay, and nearly all go that should."""
    rng = random.Random(5)
    body = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    common = body(40)
    texts = [None, "", "one two", "One  two", "one two three"]
    for _ in range(60):
        base = body(rng.randint(20, 200))
        texts += [base] + [edited(rng, base, rng.randint(0, len(base.split()) // 40 + 1)) for _ in range(rng.randint(1, 4))]
    crowd = body(150)
    texts += [edited(rng, crowd, rng.randint(0, 4)) for _ in range(60)]
    texts += [common + " " + body(rng.randint(5, 60)) for _ in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want, pairs = plain_kept(rows)
    got = {r.doc_id for r in simhash_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert pairs > 1000 and want <= got and len(got - want) <= 1


def test_crowd_of_distant_copies(spark):
    """Copies of one text, many of them near only each other: links inside a bucket are found beside its centre."""
    rng = random.Random(9)
    base = " ".join(f"w{rng.randrange(3000)}" for _ in range(150))
    texts = [base] + [edited(rng, base, rng.randint(1, 8)) for _ in range(250)]
    texts += [edited(rng, t, 1) for t in texts[1:120]]
    rows = list(enumerate(texts))
    want, _ = plain_kept(rows)
    got = {r.doc_id for r in simhash_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= got and len(got - want) <= 1 and 0 < len(want) < len(rows) / 2


def test_bands_and_sketches():
    rng = random.Random(2)
    hits = n = 0
    for _ in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(40, 400))]
        a = " ".join(words)
        b = edited(rng, a, len(words) // 60 + 1)
        x, y = shingle_join.shingle_set(a, 5), shingle_join.shingle_set(b, 5)
        both = len(np.intersect1d(x, y))
        apart = int(np.bitwise_count((shingle_join.sketch(x) ^ shingle_join.sketch(y)).view(np.uint64)).sum())
        assert apart <= len(x) + len(y) - 2 * both
        if 5 * both >= 4 * (len(x) + len(y) - both):
            n += 1
            hits += bool((shingle_join.band_keys(x) == shingle_join.band_keys(y)).any())
    assert n > 100 and hits / n > 0.98


def test_fingerprints_propose_candidates(spark, monkeypatch):
    """Pairs within RADIUS bits are joined; near copies are found by their fingerprints alone where no band is shared."""
    rng = random.Random(13)
    prints = [rng.getrandbits(63) for _ in range(60)]
    prints += [p ^ 1 << rng.randrange(63) ^ 1 << rng.randrange(63) for p in prints for _ in range(2)] + prints[:20]
    df = spark.createDataFrame([(bytes([i // 256, i % 256]), p) for i, p in enumerate(prints)], "sig binary, fp long")
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in ((int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in simhash_dedup.candidates(df).collect()):
        assert a < b
        root[find(b)] = find(a)
    assert all(find(a) == find(b) for a, b in itertools.combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= simhash_dedup.RADIUS)
    monkeypatch.setattr(shingle_join, "band_keys", lambda s: np.array([int(s.sum(dtype=np.uint64)) >> 1], dtype=np.int64))
    base = " ".join(f"w{rng.randrange(3000)}" for _ in range(2000))
    rows = [(1, base), (2, base + " end"), (3, "other words of another text")]
    got = {r.doc_id for r in simhash_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1, 3}
