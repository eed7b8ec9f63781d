"""Secret scan with linking of multipart credentials.

Strong findings (assignments, access keys, long hexadecimal runs) stand alone. Identifiers, bare tokens and endpoints are
weak: each is reported only where its counterparts stand in the same scope, apart from itself. A scope is a block of text
between blank lines or section headings, or what one pair of braces encloses. Parts and scopes are intervals of their text:
one ordered sweep a text places every part in its scopes and finds which parts overlap, then parts meet by scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.llm.common import row_key, shared_table, text_of

#: kind: (pattern, group that must be of that length, that length). The first three are fixed values; where only the
#: length of the whole match counts, it is in the pattern, which finds the same matches.
PATTERNS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "id": (r"""(?i:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]+)""", 1, 3),
    "secret": (r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
    "endpoint": (r"(?:[a-z][a-z0-9+]*://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+|(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]+)?)", 0, 1),
    # Not reported: what ends a block, and what braces enclose.
    "break": (r"\n[\x20\t\r]*\n|\n\[[A-Za-z0-9_.\x20-]+\][\x20\t\r]*\n", 0, 1),
    "braces": (r"\{[^{}]*\}", 0, 1),
}
KINDS = list(PATTERNS)
STRONG = ("assign", "access", "hex")
WEAK = ("id", "secret", "endpoint")
#: What a part is in a credential, and which other parts a weak one needs in its scope.
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "id": "id", "secret": "secret", "endpoint": "endpoint"}
NEEDS = {"id": ["secret"], "secret": ["id"], "endpoint": ["id", "secret"]}

_MATCH = "array<struct<kind: int, i: int, gap: int, size: int, ok: boolean>>"


def _matches(text: Column, kind: str, where: Column) -> Column:
    """All matches of a kind, left to right: the gap before each, its length, and whether it counts."""
    pattern, group, least = PATTERNS[kind]
    gaps = F.split(text, pattern, -1)
    ok = lambda v: F.length(v) >= least
    if kind == "secret":  # a word of letters only is no token
        ok = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    sized = F.zip_with(gaps, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m")))
    checked = F.zip_with(sized, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda s, v: F.struct(
        s["gap"].alias("gap"), F.length(s["m"]).alias("size"), ok(v).alias("ok")))
    numbered = F.transform(checked, lambda s, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), s["gap"].alias("gap"), s["size"].alias("size"), s["ok"].alias("ok")))
    # What follows the last match has a gap but no match.
    return F.when(where & text.rlike(pattern), F.filter(numbered, lambda s: s["size"].isNotNull())).otherwise(F.array().cast(_MATCH))


def parts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, kind, start, end) of every strong or weak candidate, for distinct ``key`` (a column of ``docs``).

    Weak candidates are looked for only in texts that have an identifier, without which none can be reported.
    """
    whole = F.col("_text")
    named = docs.select("key", text_of(text).alias("_text"))
    has_id = whole.rlike(PATTERNS["access"][0]) | whole.rlike(PATTERNS["id"][0])
    found = F.concat(*[_matches(whole, k, F.lit(True) if k in STRONG else F.col("_has_id")) for k in KINDS])
    rows = named.withColumn("_has_id", has_id).select("key", found.alias("found")).where(F.size("found") > 0)
    # Equal rows have equal parts; one of them is enough.
    rows = rows.groupBy("key").agg(F.first("found").alias("found")).select("key", F.inline("found"))
    upto = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("key", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("end", upto).where("ok").select("key", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def placed(found: DataFrame) -> DataFrame:
    """The strong and the weak rows of ``parts`` with their scopes (``block``, ``braces``: null outside any) and whether a
    strong part (``on_strong``), an endpoint (``on_endpoint``) or an identifier (``on_id``) overlaps them, itself aside."""
    rows = W.partitionBy("key").orderBy("start", "kind", "end")
    upto, before, after = rows.rowsBetween(W.unboundedPreceding, 0), rows.rowsBetween(W.unboundedPreceding, -1), rows.rowsBetween(1, W.unboundedFollowing)
    kind = lambda *names: F.col("kind").isin([KINDS.index(n) for n in names])

    def overlapped(*names: str) -> Column:
        ends, starts = F.max(F.when(kind(*names), F.col("end"))).over(before), F.min(F.when(kind(*names), F.col("start"))).over(after)
        return F.coalesce(ends > F.col("start"), F.lit(False)) | F.coalesce(starts < F.col("end"), F.lit(False))

    inside = F.max(F.when(kind("braces"), F.col("end"))).over(upto) > F.col("start")
    return found.select(
        "key", "kind", "start", "end", F.count_if(kind("break")).over(upto).alias("block"), F.when(inside, F.count_if(kind("braces")).over(upto)).alias("braces"),
        overlapped(*STRONG).alias("on_strong"), overlapped("endpoint").alias("on_endpoint"), overlapped("id").alias("on_id"),
    ).where(kind(*STRONG, *WEAK))


def linked(found: DataFrame) -> DataFrame:
    """The strong rows of ``parts``, and the weak ones whose counterparts all stand in one of their scopes.

    A weak part on a strong one is the same thing. A bare token in an endpoint or in an identifier is part of that; no
    secret in an endpoint counts as a counterpart. Counterparts don't overlap what asks for them.
    """
    role = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) if k in ROLES for x in (i, ROLES[k])]), F.col("kind"))
    strong = F.col("kind") < len(STRONG)
    token = F.col("kind") == KINDS.index("secret")
    needs = F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(KINDS.index(k)), F.array(*map(F.lit, v)))])
    every = placed(found).where(strong | ~F.col("on_strong") & ~(token & (F.col("on_endpoint") | F.col("on_id"))))
    scopes = F.explode(F.filter(F.array(F.struct(F.lit("block").alias("of"), F.col("block").alias("n")), F.struct(F.lit("braces").alias("of"), F.col("braces").alias("n"))),
                                lambda s: s["n"].isNotNull()))
    others = every.where((role != "secret") | ~F.col("on_endpoint")).select("key", role.alias("need"), F.col("start").alias("s"), F.col("end").alias("e"), scopes.alias("scope"))
    asking = every.where(~strong).select("key", "kind", "start", "end", scopes.alias("scope"), "block").select(
        "*", F.explode(F.element_at(needs, F.col("kind"))).alias("need"))
    met = asking.alias("a").join(others.alias("o"), F.expr("a.key = o.key and a.scope = o.scope and a.need = o.need and (o.e <= a.start or a.end <= o.s)"), "left_semi")
    met = met.groupBy("key", "kind", "start", "end").agg(F.count_distinct("need").alias("n"))
    enough = met.where(F.col("n") == F.size(F.element_at(needs, F.col("kind")))).select("key", "kind", "start", "end")
    return found.where(strong).unionByName(enough)


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ``spans`` (array of kind number, start, end in code points, end exclusive), by
    start, then kind. Null and empty texts have none; repeated rows have the same; an empty table gives no rows. A text of
    any length is searched as a whole, its parts in one sweep; other columns, whatever their names, take no part."""
    keyed = docs.select(F.col(id).alias("id"), text_of(text).alias("text"), row_key(id, text).alias("key"))
    found = shared_table(parts(keyed))
    spans = linked(found).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    return keyed.select("id", "key").join(spans, "key", "left").select(
        F.col("id").alias(id), F.coalesce("spans", F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")).alias("spans"))


def named(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
