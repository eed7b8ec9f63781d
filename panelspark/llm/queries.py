"""The operators of this folder as registered queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import (bpe, exact_dedup, fill_middle, language_id, merkle, mixing, packing, ppm, quality_rules, secrets, sharding, simhash_dedup,
                            url_filter)
from panelspark.llm.common import shared_table, text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Limits and verdicts in SQL: quartile bins per language and source, weighted with those of the language and of all.
_QUALITY = rf"""
WITH cut AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS w,
       list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 1))) AS i, w FROM cut),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM windows),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) q WHERE c > 1),
spans AS (SELECT doc_id, least(5, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 5)) AS n FROM twice),
covered AS (SELECT doc_id, sum(n)::BIGINT AS n_repeat_words FROM spans GROUP BY doc_id),
measured AS (SELECT c.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
       (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
       (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
       length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
       FROM cut c LEFT JOIN covered USING (doc_id)),
flagged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured),
vals AS (SELECT *, {", ".join(f"({v}) AS v_{m}" for m, (v, _, _, _) in quality_rules.VALUES.items())} FROM flagged),
bins AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS m, floor(v_{m} * {per})::INT AS b FROM vals WHERE NOT base_failed" for m, (_, per, _, _) in quality_rules.VALUES.items())}),
levels AS (SELECT 0 AS level, lang, source, m, b FROM bins UNION ALL SELECT 1, lang, NULL, m, b FROM bins UNION ALL SELECT 2, NULL, NULL, m, b FROM bins),
ranked AS (SELECT level, lang, source, m, b, row_number() OVER g AS r, count(*) OVER (PARTITION BY level, lang, source, m) AS n
       FROM levels WINDOW g AS (PARTITION BY level, lang, source, m ORDER BY b)),
quart AS (SELECT level, lang, source, m, max(n) AS n, min(b) FILTER (4 * r >= n) AS q1, min(b) FILTER (4 * r >= 3 * n) AS q3 FROM ranked GROUP BY ALL),
edges AS (SELECT level, lang, source, m, n, q3 / per + 3.0 * greatest(q3 / per - q1 / per, least) AS hi, q1 / per - 3.0 * greatest(q3 / per - q1 / per, least) AS lo
       FROM quart JOIN (VALUES ('symbols', 512e0, 0.015e0), ('dup_lines', 512e0, 0.1e0), ('repeats', 512e0, 0.05e0), ('upper', 512e0, 0.02e0), ('word_length', 64e0, 0.1e0)) s(m, per, least) USING (m)),
picked AS (SELECT o.lang, o.source, o.m, (o.n * o.hi + 100 * ((l.n * l.hi + 100 * a.hi) / (l.n + 100))) / (o.n + 100) AS hi,
       (o.n * o.lo + 100 * ((l.n * l.lo + 100 * a.lo) / (l.n + 100))) / (o.n + 100) AS lo
       FROM edges o JOIN edges l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM o.lang AND l.m = o.m JOIN edges a ON a.level = 2 AND a.m = o.m WHERE o.level = 0),
fences AS (SELECT lang, source, {", ".join(f"max(hi) FILTER (m = '{m}') AS hi_{m}, max(lo) FILTER (m = '{m}') AS lo_{m}" for m in quality_rules.VALUES)}
       FROM picked GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce({" AND ".join(f"v_{m} <= hi_{m}" + (f" AND v_{m} >= lo_{m}" if low else "") for m, (_, _, _, low) in quality_rules.VALUES.items())}, true) AS kept
FROM vals v LEFT JOIN fences f ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source
"""


@query("op3_quality_rules", _QUALITY)
def _(spark, sf_dir):
    return quality_rules.quality(_documents(spark, sf_dir), keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_feistel_shards")
def _(spark, sf_dir):
    text = text_of("text")
    rows = _documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return sharding.shard(rows, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


@query("op10_golomb_exact_dedup", r"""
WITH plain AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM plain WINDOW g AS (PARTITION BY t)""")
def _(spark, sf_dir):
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


@query("op2_temperature_mixing")
def _(spark, sf_dir):
    rows = mixing.counted(_documents(spark, sf_dir))
    narrow = shared_table(rows.select(F.struct("doc.doc_id").alias("doc"), "row", "source", "tokens"))
    return mixing.mixture(narrow).select("doc.doc_id", "source", "tokens", "turn", "block", "place", F.round("weight", 9).alias("weight"))


@query("op9_covering_simhash")
def _(spark, sf_dir):
    return simhash_dedup.near_duplicates(_documents(spark, sf_dir))


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_bpe_rounds")
def _(spark, sf_dir):
    back = bpe.round_trip(_documents(spark, sf_dir), tokenizer(), "doc_id")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_ppm_scores")
def _(spark, sf_dir):
    return ppm.score(_documents(spark, sf_dir))


@query("op8_viterbi_language")
def _(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))


@query("op1_url_model_ratio")
def _(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


@query("op5_credential_links")
def _(spark, sf_dir):
    found = secrets.scan(_documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.STRONG))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(secrets.named(base), 256).alias("base_sha256"), secrets.named(F.col("spans")).alias("spans"))


def _level(k: int, group: str) -> str:
    """SQL of a tree's level over that before it; a tree with one node left stays as it is."""
    return f"""nodes{k} AS (SELECT DISTINCT {group} AS g, p, n, d FROM level{k - 1} WHERE n > 1),
runs{k} AS (SELECT g, p // 8 AS q, list(d ORDER BY p) AS ds FROM nodes{k} GROUP BY g, p // 8),
level{k} AS (SELECT l.* REPLACE (CASE WHEN n > 1 THEN p // 8 ELSE p END AS p, CASE WHEN n > 1 THEN (n + 7) // 8 ELSE n END AS n,
       CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE d END AS d,
       CASE WHEN n > 1 THEN proof || array_to_string(ds[1:p % 8], '') || array_to_string(ds[p % 8 + 2:], '') ELSE proof END AS proof,
       CASE WHEN n > 1 THEN sha256(array_to_string(ds[1:p % 8], '') || fold || array_to_string(ds[p % 8 + 2:], '')) ELSE fold END AS fold)
       FROM level{k - 1} l LEFT JOIN runs{k} r ON r.g = {group} AND r.q = p // 8 AND n > 1)"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


_NAMED = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))
#: CRC-32 bit by bit: each byte of the id, then seven steps without one.
_CRC = ("xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0])), "
        "lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)")
#: Ten levels within a language hold 8^10 leaves; three above them hold 512 languages.
_MERKLE = f"""
WITH leaves AS (SELECT doc_id, lang, sha256({_NAMED} || {_field("text")}) AS leaf,
       CASE WHEN {_CRC} % 3 = 0 THEN sha256({_NAMED} || {_field(f"translate(text, '{merkle._UPPER}', '{merkle._LOWER}')")}) END AS changed FROM documents),
level0 AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree, leaf, coalesce(changed, leaf) AS fold, '' AS proof, leaf AS d, leaf AS subroot,
       row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
{", ".join(_level(k, "tree") for k in range(1, 11))},
level11 AS (SELECT * REPLACE (tree - 1 AS p, max(tree) OVER () AS n, d AS subroot) FROM level10),
{", ".join(_level(k, "0") for k in range(12, 15))}
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = d AS verified FROM level14
"""


@query("op11_merkle_manifest", _MERKLE)
def _(spark, sf_dir):
    return merkle.verified_manifest(_documents(spark, sf_dir))


_FILL = r"""
WITH units AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
       ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM units),
cut AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
       array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS a,
       array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS b,
       array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS c FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM cut
"""


@query("op12_chunked_fill_middle", _FILL)
def _(spark, sf_dir):
    done = fill_middle.fill_in_middle(_documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))


@query("op13_bounded_packing")
def _(spark, sf_dir):
    return packing.pack(_documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))
