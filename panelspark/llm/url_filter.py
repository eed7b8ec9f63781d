"""URL filter: rules on host and path, and beyond them the ratio of two character language models.

One model is counted over URLs that the rules allow, one over those they block: byte contexts of 0 to ORDER, each
interpolated with the next shorter one by Witten-Bell weights. A URL's score is the difference of both log
likelihoods per byte of the whole string, scheme and query string included; the limit is calibrated on URLs that the
counts leave out.

Counts are exact: a context and its byte are one integer of six bytes at most, which is a key of a distributed table.
Distinct URLs are dealt to chunks; every distinct string of ORDER + 1 bytes is priced once, order after order, by joins
whose keys have 256 rows at most, and its price goes back to the chunks that hold it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.llm.common import blocks, shared_table

ORDER = 5
#: Bytes of distinct URLs in a chunk, on average, and those worked on at a time.
CHUNK_BYTES, PART_BYTES = 16_000_000, 2_000_000
#: Score bins for the calibration, and the range they cover.
BINS, REACH = 2048, 8.0
#: One URL in so many is left out of the counts and calibrates the limit.
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query (fixed values).
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path (up to ``?``, ``#`` or the end); empty without ``://``."""
    whole = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.locate("://", whole)
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits the host or a parent domain and starts the path; else null.
    Of equally long ones the longer host wins, then a block."""
    text = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block")):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return (text, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _mask(order: int) -> int:
    return (1 << 8 * (order + 1)) - 1


def slots(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, contexts with their byte) of every byte and order, order x bytes, as integers with the newest byte
    lowest, and how many bytes each text has with its end."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    pad = b"\x02" * ORDER
    flat = np.frombuffer(b"".join(pad + r + b"\x03" for r in raw), dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    at = np.arange(sizes.sum()) + np.repeat(np.arange(1, len(raw) + 1) * ORDER, sizes)
    longest = np.zeros(len(at), dtype=np.int64)
    for k in range(ORDER + 1):
        longest |= flat[at - k] << 8 * k
    pairs = np.stack([longest & _mask(k) for k in range(ORDER + 1)])
    return pairs >> 8, pairs, sizes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts in memory (label, order, context, pair, n), for ``Models``."""
    for batch in batches:
        label = np.array(batch["label"].to_pylist(), dtype=np.int64)
        _, pairs, sizes = slots(batch["text"].to_pylist())
        for k in range(ORDER + 1):
            u, n = np.unique(np.repeat(label, sizes) << 8 * (ORDER + 1) | pairs[k], return_counts=True)
            pair = u & _mask(ORDER)
            yield pa.RecordBatch.from_pydict({
                "label": pa.array((u >> 8 * (ORDER + 1)).astype(np.int32)), "k": pa.array(np.full(len(u), k, dtype=np.int32)),
                "context": pa.array(pair >> 8), "pair": pa.array(pair), "n": pa.array(n.astype(np.int64))})


class Models:
    """Both models in memory, for few URLs: what the prices of ``scores`` are held against."""

    def __init__(self, contexts: pd.DataFrame, pairs: pd.DataFrame):
        self.contexts = {(r.label, r.k, r.context): (r.n, r.kinds) for r in contexts.itertuples()}
        self.pairs = {(r.label, r.k, r.pair): r.n for r in pairs.itertuples()}
        self.both = len(contexts["label"].unique()) == 2

    def score(self, texts: list[str]) -> np.ndarray:
        """Mean over a text's bytes and its end of log P(allowed) - log P(blocked); 0 if a class has no URLs."""
        if not len(texts) or not self.both:
            return np.zeros(len(texts))
        contexts, pairs, sizes = slots(texts)
        p = np.full((2, contexts.shape[1]), 1 / 256)
        for label in (0, 1):
            for i in range(contexts.shape[1]):
                for k in range(ORDER + 1):
                    n, kinds = self.contexts.get((label, k, contexts[k, i]), (0, 0))
                    if n:
                        p[label, i] = (self.pairs.get((label, k, pairs[k, i]), 0) + kinds * p[label, i]) / (n + kinds)
        return np.add.reduceat(np.log(p[1]) - np.log(p[0]), np.cumsum(sizes) - sizes) / sizes


def _parts(rows: pa.Table) -> Iterator[tuple[slice, list[str]]]:
    """Rows PART_BYTES at a time; a longer text comes alone."""
    start, part, size = 0, [], 0
    for i, t in enumerate(rows["text"]):
        part.append(t.as_py())
        size += len(part[-1])
        if size >= PART_BYTES:
            yield slice(start, i + 1), part
            start, part, size = i + 1, [], 0
    if part:
        yield slice(start, start + len(part)), part


def _learn(rows: pa.Table) -> pa.Table:
    """The chunk's distinct strings with their counts among allowed and blocked URLs that are learnt from."""
    weights = [rows[c].to_numpy() for c in ("allowed", "blocked")]
    keys, sums = np.zeros(0, dtype=np.int64), np.zeros((2, 0), dtype=np.int64)
    for at, texts in _parts(rows):
        _, pairs, sizes = slots(texts)
        keys, place = np.unique(np.concatenate([keys, pairs[ORDER]]), return_inverse=True)
        every = [np.concatenate([old, np.repeat(w[at], sizes)]) for old, w in zip(sums, weights)]
        sums = np.zeros((2, len(keys)), dtype=np.int64)
        for total, more in zip(sums, every):
            np.add.at(total, place, more)
    chunk = rows["chunk"][0].as_py()
    return pa.table({"chunk": pa.array(np.full(len(keys), chunk), pa.int32()), "key": pa.array(keys), "allowed": pa.array(sums[0]), "blocked": pa.array(sums[1])})


def _apply(rows: pa.Table, known: pa.Table) -> pa.Table:
    known = known.sort_by("key")
    keys, values, found = known["key"].to_numpy(), known["value"].to_numpy(), [np.zeros(0)]
    for _, texts in _parts(rows):
        _, pairs, sizes = slots(texts)
        found.append(np.add.reduceat(values[np.searchsorted(keys, pairs[ORDER])], np.cumsum(sizes) - sizes) / sizes)
    return rows.drop_columns(["chunk", "allowed", "blocked"]).append_column("score", pa.array(np.concatenate(found)))


def prices(counts: DataFrame) -> DataFrame:
    """From (key, allowed, blocked), distinct: (key, value), log P(allowed) - log P(blocked) of the key's last byte.
    Null where a class has no counts at all."""
    found = None
    sums = [F.sum(c).alias(c) for c in ("allowed", "blocked")]
    for k in range(ORDER + 1):
        here = counts if k == ORDER else counts.groupBy(F.col("key").bitwiseAND(F.lit(_mask(k))).alias("key")).agg(*sums)
        context = W.partitionBy("context")
        here = here.withColumn("context", F.shiftright("key", 8))
        for c in ("allowed", "blocked"):
            here = here.withColumn(f"n_{c}", F.sum(c).over(context)).withColumn(f"kinds_{c}", F.count(F.when(F.col(c) > 0, 1)).over(context))
        if found is not None:
            here = here.withColumn("shorter", F.col("key").bitwiseAND(F.lit(_mask(k - 1)))).join(found, "shorter")
        new = {}
        for c in ("allowed", "blocked"):
            # Before the first order every byte is as likely; a class that was never counted has no price.
            before = F.when(F.col(f"n_{c}") > 0, F.lit(1 / 256)) if found is None else F.col(f"p_{c}")
            new[f"q_{c}"] = F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"kinds_{c}") * before) / (F.col(f"n_{c}") + F.col(f"kinds_{c}"))).otherwise(before)
        here = here.withColumns(new)
        found = here.select(F.col("key").alias("shorter"), F.col("q_allowed").alias("p_allowed"), F.col("q_blocked").alias("p_blocked"))
    return found.select(F.col("shorter").alias("key"), (F.log("p_allowed") - F.log("p_blocked")).alias("value"))


def scores(labelled: DataFrame) -> DataFrame:
    """From (text, label, fold): its distinct rows with ``n``, how often each is there, and ``score``, the mean over a
    text's bytes and its end of log P(allowed) - log P(blocked). Label 1 is allowed, 0 blocked, null neither; fold 0 is
    scored only. Without learnt URLs of both classes every score is 0."""
    spark = labelled.sparkSession
    texts = shared_table(labelled.groupBy("text", "label", "fold").agg(F.count(F.lit(1)).alias("n")))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(blocks(spark), -(-size // CHUNK_BYTES))
    learnt = lambda label: F.when((F.col("label") == label) & (F.col("fold") > 0), F.col("n")).otherwise(F.lit(0).cast("long"))
    dealt = texts.select("*", F.pmod(F.xxhash64("text"), F.lit(chunks)).cast("int").alias("chunk"), learnt(1).alias("allowed"), learnt(0).alias("blocked"))
    facts = shared_table(dealt.groupBy("chunk").applyInArrow(_learn, "chunk int, key long, allowed long, blocked long"))
    counts = shared_table(facts.groupBy("key").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")))
    priced = prices(counts).withColumn("value", F.coalesce("value", F.lit(0.0)))
    known = facts.select("chunk", "key").join(priced, "key")
    return dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_apply, "text string, label int, fold int, n long, score double")


def calibrate(scored: DataFrame) -> float:
    """The limit with the fewest errors, both classes weighing the same, from (label, score, n); in the middle of the best
    stretch. Without URLs of both classes nothing is blocked."""
    at = F.least(F.greatest(F.floor((F.col("score") + REACH) / (2 * REACH) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    bins = scored.groupBy("label", at.alias("bin")).agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, BINS))
    counts[bins["label"].astype(int), bins["bin"].astype(int)] = bins["n"]
    if not counts.sum(axis=1).all():
        return -np.inf
    upto = np.concatenate([np.zeros((2, 1)), np.cumsum(counts / counts.sum(axis=1, keepdims=True), axis=1)], axis=1)
    wrong = upto[1] + 1 - upto[0]
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float((best[0] + best[-1]) / 2 / BINS * 2 * REACH - REACH)


def judge(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict``, ``score`` and ``limit``; same-named columns are replaced.

    A rule decides where one fits; else a URL is allowed if its score reaches the limit. Null and odd URLs have an empty
    host and path; the whole string is learnt from and scored, null as empty; repeated URLs count each; an empty table gives no rows.
    """
    new = ["host", "path", "rule", "verdict", "score", "limit"]
    kept = [c for c in pages.columns if c not in new]
    host, path = host_and_path(url)
    cut = pages.select(*kept, F.col(url).cast("string").alias("_url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = cut.withColumns({"rule": rule, "_ruled": verdict, "_text": F.coalesce("_url", F.lit(""))})
    fold = F.pmod(F.xxhash64("_text"), F.lit(FOLDS)).cast("int")
    scored = shared_table(scores(ruled.select(F.col("_text").alias("text"), (F.col("_ruled") == "allow").cast("int").alias("label"), fold.alias("fold"))))
    limit = calibrate(scored.where("label is not null and fold = 0"))
    return (ruled.join(scored.select(F.col("text").alias("_text"), "score"), "_text").withColumn("limit", F.lit(limit))
            .withColumn("verdict", F.coalesce("_ruled", F.when(F.col("score") >= F.col("limit"), "allow").otherwise("block"))).select(*kept, *new))
