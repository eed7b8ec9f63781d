"""URL models: what they are counted over, and exact counts against plain dictionaries."""

import math
import random
from collections import Counter, defaultdict

import pytest

from panelspark.llm import url_filter

LEARNT = [(i, f"http://good{i % 17}.example.net/en/{i}?tone=calm" if i % 2 else f"http://bad{i % 13}.example.com/de/{i}?tone=loud") for i in range(200)]


def test_the_whole_url_is_scored(spark):
    asked = [(900, "http://a.other.io/p?tone=calm"), (901, "http://a.other.io/p?tone=loud"), (902, "a.example.net/en/?tone=calm"), (903, "a.example.com/de/?tone=loud"), (904, None), (905, "")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(LEARNT + asked, "page_id long, url string")).collect()}
    assert got[900].score > got[901].score and got[902].score > got[903].score
    assert got[904].score == got[905].score and got[904].host == got[902].host == got[902].path == ""


def plain_scores(learnt, texts):
    """learnt: (label, text); Witten-Bell in dictionaries of byte strings."""
    order, nodes = url_filter.ORDER, (defaultdict(Counter), defaultdict(Counter))
    cut = lambda t: b"\x02" * order + t.encode() + b"\x03"
    for label, t in learnt:
        b = cut(t)
        for i in range(order, len(b)):
            for k in range(order + 1):
                nodes[label][b[i - k : i]][b[i]] += 1
    for t in texts:
        b, total = cut(t), 0.0
        for i in range(order, len(b)):
            p = [1 / 256, 1 / 256]
            for label in (0, 1):
                for k in range(order + 1):
                    if (node := nodes[label].get(b[i - k : i])):
                        p[label] = (node[b[i]] + len(node) * p[label]) / (sum(node.values()) + len(node))
                        assert p[label] <= 1
            total += math.log(p[1]) - math.log(p[0])
        yield total / (len(b) - order)


def test_scores_are_exact_over_many_contexts(spark):
    """More distinct contexts than any fixed table of 2^16 has slots, repeated URLs, and texts with unseen bytes."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789-_") for _ in range(60))
    rows = [(word() + ("é" if i % 50 == 0 else ""), rng.choice([0, 1, None]), rng.randrange(5)) for i in range(6000)] + [("", None, 0), ("日本?#", None, 3)]
    rows += rows[:40] * 2
    learnt = [(label, t) for t, label, fold in rows if label is not None and fold]
    assert len({t[i : i + 5] for _, t in learnt for i in range(len(t) - 4)}) > 1 << 17
    got = {(r.text, r.label, r.fold): r for r in url_filter.scores(spark.createDataFrame(rows, "text string, label int, fold int")).collect()}
    assert {k: r.n for k, r in got.items()} == Counter(rows)
    for r, want in zip(got.values(), plain_scores(learnt, [t for t, *_ in got])):
        assert r.score == pytest.approx(want, abs=1e-9)


def test_one_class_scores_nothing(spark):
    got = url_filter.scores(spark.createDataFrame([("abc", 1, 1), ("abd", None, 1)], "text string, label int, fold int")).collect()
    assert {r.score for r in got} == {0.0}
