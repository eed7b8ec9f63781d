"""Row operators against plain versions: quality rules, exact dedup, sharding, mixing, pipeline."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import exact_dedup, mixing, quality_rules, sharding
from tests.conftest import SF
from tests.llm.conftest import odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {p + j for v in at.values() if len(v) > 1 for p in v for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(lines), sum(c.isupper() for c in t)


def test_measures(odd):
    got = quality_rules.measure(odd).select("text", *quality_rules.MEASURES).collect()
    assert len(got) == len(odd_rows())
    for text, *values in got:
        assert tuple(values) == measures(text)


def test_quality_groups_and_fences(spark, odd, none, clashing):
    judged = quality_rules.quality(odd).collect()
    for r in judged:
        n, _, _, _, repeats, _, _ = measures(r.text)
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n)
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality(none).count() == 0
    assert quality_rules.quality(clashing, keep_text=False).columns.count("kept") == 1
    clean = [(i, " ".join(f"w{(i * 7 + j * j) % 997}" for j in range(60)), "en", "s") for i in range(300)]
    junk = [(1000, " ".join(f"w{j}### ***" for j in range(60)), "en", "s"), (1001, " ".join(f"W{j}ABC" for j in range(60)), "en", "s")]
    kept = {r.doc_id for r in quality_rules.quality(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).where("kept").collect()}
    assert kept == {i for i, *_ in clean}


def test_every_measure_rejects(spark):
    """One odd text for each measure among clean ones, whatever its group's size; clean texts of all groups stay."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9))))
    line = lambda: " ".join(word() for _ in range(8))
    clean = [(i, "\n".join(line() for _ in range(11)).capitalize(), "en", f"s{i % 40 if i % 3 else 0}") for i in range(600)]
    repeated = line()
    phrase = " ".join(word() for _ in range(5))
    texts = {
        "symbols": " ".join(word() + "#$" for _ in range(90)),
        "dup_lines": "\n".join([repeated.split()[0] if i % 2 else line() for i in range(20)]),
        "repeats": " ".join([phrase] + [word() for _ in range(30)] + [phrase] + [word() for _ in range(17)]),
        "upper": " ".join(word().upper() if i % 2 else word() for i in range(90)),
        "word_length": " ".join(word() * 4 for i in range(90)),
    }
    odd = [(1000 + i, t, "en", s) for s in ("s0", "s7") for i, t in enumerate(texts.values(), 100 * (s == "s7"))]
    docs = spark.createDataFrame(clean + odd, "doc_id long, text string, lang string, source string")
    judged = quality_rules.quality(docs).cache()
    assert {r.doc_id for r in judged.where("not kept").collect()} == {i for i, *_ in odd}
    assert judged.where("base_failed").count() == 0
    fences = quality_rules.limits(quality_rules.sketches(quality_rules.measure(docs)))
    counts = quality_rules.rejections(judged, fences).first().asDict()
    assert counts.pop("passed") == len(clean + odd) and set(counts) == set(quality_rules.VALUES) and all(n >= 2 for n in counts.values())
    # A group's limits move with its rows, without a jump at any size.
    assert sorted(r.hi_upper for r in fences.collect())[0] > 0.05


def test_sketches_merge(odd):
    measured = quality_rules.measure(odd)
    whole = quality_rules.sketches(measured).groupBy("lang", "source", "measure", "bin").agg(F.sum("n").alias("n"))
    parts = quality_rules.sketches(measured.where("doc_id % 2 = 0")).unionByName(quality_rules.sketches(measured.where("doc_id % 2 <> 0 or doc_id is null")))
    merged = parts.groupBy("lang", "source", "measure", "bin").agg(F.sum("n").alias("n"))
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, merged.collect()))


@pytest.mark.parametrize("n", [0, 1, 2, 999])
def test_golomb_round_trip(n):
    values = np.sort(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
    gaps = np.diff(np.concatenate([values, values[-3:]])) if n == 2 else np.diff(values)
    gaps = np.abs(gaps.view(np.int64)).view(np.uint64) if n == 2 else gaps
    assert (exact_dedup.golomb_decode(len(gaps), *exact_dedup.golomb_encode(gaps)) == gaps).all()


def test_exact_dedup(odd, none, clashing):
    rows = odd_rows()
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(plain(t), []).append(i)
    got = exact_dedup.exact_dedup(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by_hash[r.text_sha256]
        least = min((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (least, len(ids))
        assert not r.kept or r.doc_id == least
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(list(by_hash))
    assert exact_dedup.exact_dedup(none).count() == 0
    left = exact_dedup.drop_copies(clashing)
    assert left.columns == clashing.columns and left.count() == len(groups)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000])
def test_permutation(spark, n):
    got = [r.p for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 5).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    assert n < 100 or got != list(range(n))


def test_shards(odd, none, clashing):
    rows = odd.select("doc_id", "text")
    a = sharding.shard(rows, 5).collect()
    b = sharding.shard(rows.repartition(7, "text"), 5).collect()
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))
    counts = Counter(r.shard for r in a)
    assert max(counts.values()) - min(counts.values()) <= 1 and sum(counts.values()) == len(odd_rows())
    for s, n in counts.items():
        assert sorted(r.slot for r in a if r.shard == s) == list(range(n))
    assert sharding.shard(none, 5).count() == 0
    assert sharding.shard(clashing, 3).count() == len(odd_rows())


def test_many_repeats_are_numbered(spark):
    rows = spark.range(1).selectExpr("1L as doc_id", "'t' as text").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(25_000)))).drop("x").union(
        spark.createDataFrame([(2, "u")], "doc_id long, text string"))
    assert sorted(r.row_number for r in sharding.row_numbers(rows).collect()) == list(range(25_001))


def mixed(rows, mix):
    return [r.asDict(recursive=True) for r in mixing.mixture(mixing.counted(rows), mix).collect()]


def test_mixture_meets_its_targets(spark):
    docs = [(i, "w " * (10 + i % 13), f"s{min(i % 12, 8 + i % 3)}" if i % 3 else "hot") for i in range(900)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, source string")
    tokens, natural = {i: 10 + i % 13 for i, *_ in docs}, Counter()
    for i, _, s in docs:
        natural[s] += tokens[i]
    entropy = lambda p: -sum(x * math.log(x) for x in p if x)
    share = {s: n / sum(natural.values()) for s, n in natural.items()}
    free = mixed(rows, mixing.Mix(entropy=0.5, repeats=100.0, block=500))
    weight = {r["source"]: r["weight"] for r in free}
    target = entropy(share.values()) + 0.5 * (math.log(len(share)) - entropy(share.values()))
    assert abs(entropy(weight.values()) - target) < 1e-4
    taken = Counter()
    for r in free:
        taken[r["source"]] += r["tokens"]
    total = sum(taken.values())
    assert all(abs(taken[s] / total - w) < 0.01 for s, w in weight.items())
    assert {r["doc"]["doc_id"] for r in free} == set(tokens)
    # Blocks hold the sources in the same proportions, to a document or two.
    for b in {r["block"] for r in free}:
        own = Counter()
        for r in free:
            own[r["source"]] += r["tokens"] * (r["block"] == b)
        assert all(abs(own[s] - w * 500) <= 45 for s, w in weight.items())
    limited = mixed(rows, mixing.Mix(entropy=1.0, repeats=1.5))
    assert max(Counter(r["doc"]["doc_id"] for r in limited).values()) <= 2
    passes = {s: sum(r["tokens"] for r in limited if r["source"] == s) / natural[s] for s in natural}
    assert max(passes.values()) <= 1.6 and min(passes.values()) >= 1
    half = mixed(rows, mixing.Mix(budget=sum(natural.values()) // 2, repeats=5))
    assert abs(sum(r["tokens"] for r in half) - sum(natural.values()) // 2) <= 23 * len(natural)


def test_mixture_of_odd_rows(odd, none, clashing):
    got = mixed(odd, mixing.Mix())
    assert {(r["doc"]["doc_id"], r["doc"]["text"]) for r in got} == {(i, t) for i, t, *_ in odd_rows()}
    assert None in {r["source"] for r in got}
    assert mixing.mixed_documents(none).count() == 0
    assert mixing.mixed_documents(clashing).columns == clashing.columns


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    assert [f.__name__ for _, f in pipeline.STAGES] == ["quality", "exact", "near", "mix", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = pipeline.quality(spark, docs, SF).cache()
    texts = [r.text for r in good.collect()]
    assert 0 < len(texts) < docs.count() and all(measures(t)[0] >= 10 for t in texts)
    once = pipeline.exact(spark, good, SF).cache()
    assert Counter(re.sub(r"\s+", " ", r.text) for r in once.collect()).most_common(1)[0][1] == 1
    assert once.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in texts})
    assert once.columns == docs.columns
    out = pipeline.run(spark, SF)
    assert out.where("not round_trip").count() == 0 and out.select("doc_id").distinct().count() <= once.count()


def test_pipeline_of_odd_tables(spark, none, clashing, tmp_path):
    """Null, empty, very long, repeated texts and clashing columns: what each stage must leave follows from the texts."""
    import corpus_pipeline as pipeline

    clashing.write.parquet(str(tmp_path / "odd/documents.parquet"))
    none.write.parquet(str(tmp_path / "none/documents.parquet"))
    got = pipeline.run(spark, str(tmp_path / "odd")).collect()
    rows = {}
    for i, t, *_ in odd_rows():
        rows.setdefault(i, set()).add(t)
    assert got and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    texts = [t for r in got for t in rows[r.doc_id]]
    assert all(t is not None and measures(t)[0] >= 10 for t in texts)
    # Copies of one text stand under ids 100 to 111 and null: the smallest stays.
    assert {r.doc_id for r in got} & {None, *range(100, 112)} == {100} and 203 not in {r.doc_id for r in got}
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0
