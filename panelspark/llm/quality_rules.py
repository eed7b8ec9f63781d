"""Quality rules whose limits adapt to each language and source.

Every text is measured with built-in functions. Each measure's values are counted in a quantile sketch (a histogram of
even bins, so sketches of parts merge by adding counts) per language and source; limits are fences read off the
sketches, joined back to the rows on language and source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.llm.common import BLANKS, SPACE, WORD, shared_table, text_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Appended by ``measure``.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns in ``MEASURES`` (long), each over the whole text; a null text counts as empty.

    A text is cut into words and its five-word windows hashed once. Only where two hashes of a text agree are the
    windows themselves sorted; positions in windows that occur twice are then counted in one fold.
    """
    kept = [c for c in docs.columns if c not in MEASURES]
    whole = text_of(text)
    words = F.split(F.trim(whole, F.lit(BLANKS)), SPACE)
    cut = docs.select(*kept, words.alias("_words"), whole.alias("_text"), F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD)).alias("_lines"))
    glued = cut.select(*kept, "_words", "_lines", "_text", F.array_join("_words", "").alias("_glued"), F.transform("_words", lambda x: F.xxhash64(x)).alias("_prints"))
    sized = glued.select(
        *kept, "_words",
        F.when(F.col("_glued") == "", F.lit(0)).otherwise(F.size("_words")).cast("long").alias("n_words"),
        F.length("_glued").cast("long").alias("word_chars"),
        F.regexp_count("_glued", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.length("_glued") - F.length(F.regexp_replace("_glued", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        F.transform("_prints", lambda x, i: F.xxhash64(x, *[F.get("_prints", i + j) for j in range(1, WINDOW)])).alias("_hashes"),
    )
    places = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(1), F.col("n_words").cast("int") - (WINDOW - 1))).otherwise(
        F.expr("cast(array() as array<int>)"))
    windows = F.array_sort(F.transform(places, lambda i: F.struct(F.array_join(F.slice("_words", i, WINDOW), " ").alias("w"), i.alias("i"))))
    return (
        sized
        .withColumn("_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), windows))
        .withColumn("_twice", F.expr(
            "array_sort(transform(filter(_sorted, (x, k) -> coalesce(get(_sorted, k - 1).w = x.w, false) or coalesce(get(_sorted, k + 1).w = x.w, false)), x -> x.i))"))
        .withColumn("n_repeat_words", F.coalesce(F.expr(
            f"aggregate(_twice, named_struct('end', 0, 'n', 0L), (s, i) -> named_struct('end', i + {WINDOW}, 'n', s.n + least({WINDOW}, i + {WINDOW} - s.end)), s -> s.n)"), F.lit(0)).cast("long"))
        # Through a generator: conditions on the measures are never copied into the expressions above, where each
        # element of an array would evaluate the array again.
        .select(*kept, F.inline(F.array(F.struct(*MEASURES))))
    )


@dataclass(frozen=True)
class Rules:
    """Fixed base rules, and how far from the middle half of its group a text may lie."""

    least_words: int = 10
    most_repeat_percent: int = 20
    #: A limit lies this many spreads beyond the upper (or under the lower) quartile.
    reach: float = 3.0
    #: A group's limits count as its rows do, those of its language as so many rows; a language's and those of all alike.
    prior_rows: int = 100


#: name: (value as a Spark and DuckDB expression, bins per unit, smallest spread, has a lower limit). With the smallest
#: spread a limit lies under what the base rules take, and above what clean texts of any group have.
VALUES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", 512, 0.015, False),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", 512, 0.1, False),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", 512, 0.05, False),
    # As if ten words of five letters stood in front, so that a few words alone decide nothing.
    "upper": ("n_upper / (word_chars + 50)", 512, 0.02, False),
    "word_length": ("log2(1 + (word_chars + 50) / (n_words + 10))", 64, 0.1, True),
}


def base_failed(rules: Rules = Rules()) -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeat_percent * F.col("n_words"))


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source", rules: Rules = Rules()) -> DataFrame:
    """(lang, source, measure, bin, n) over the texts that pass the base rules. Adding up ``n`` merges sketches."""
    bins = F.array(*[F.struct(F.lit(m).alias("measure"), F.floor(F.expr(v) * per).cast("int").alias("bin")) for m, (v, per, _, _) in VALUES.items()])
    return (measured.where(~base_failed(rules)).select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.inline(bins))
            .groupBy("lang", "source", "measure", "bin").agg(F.count(F.lit(1)).alias("n")))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, measure, n, q1, q3): the bins that hold the quartiles."""
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys, "measure")
    ranked = merged.select(*keys, "measure", "bin", F.sum("n").over(group.orderBy("bin")).alias("upto"), F.sum("n").over(group).alias("total"))
    at = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("bin")))
    return ranked.groupBy(*keys, "measure").agg(F.max("total").alias("n"), at(1).alias("q1"), at(3).alias("q3"))


def _fences(measure: str, q: str, rules: Rules) -> list[Column]:
    """The upper and the lower limit of a measure that follow from quartile bins."""
    _, per, least, _ = VALUES[measure]
    q1, q3 = F.col(f"{q}.q1") / per, F.col(f"{q}.q3") / per
    reach = rules.reach * F.greatest(q3 - q1, F.lit(least))
    return [q3 + reach, q1 - reach]


def limits(sketch: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per language and source with ``lo_<measure>`` and ``hi_<measure>``: the group's own limits and those of its
    language, weighted by the group's rows against ``prior_rows``; a language's are weighted with those of all alike."""
    own = quartiles(sketch, "lang", "source")
    of_lang = quartiles(sketch, "lang").select(F.col("lang").alias("l"), F.col("measure").alias("m"), F.struct("n", "q1", "q3").alias("by_lang"))
    of_all = quartiles(sketch).select(F.col("measure").alias("m"), F.struct("n", "q1", "q3").alias("by_all"))
    rows = (
        own.select("lang", "source", "measure", F.struct("n", "q1", "q3").alias("own"))
        .join(of_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m"))).drop("l", "m")
        .join(of_all, F.col("measure") == F.col("m")).drop("m")
    )
    mixed = lambda q, a, b: (F.col(f"{q}.n") * a + rules.prior_rows * b) / (F.col(f"{q}.n") + rules.prior_rows)
    out = []
    for m, (_, _, _, low) in VALUES.items():
        levels = [_fences(m, q, rules) for q in ("own", "by_lang", "by_all")]
        for side, name in enumerate(("hi", "lo") if low else ("hi",)):
            a, b, c = (level[side] for level in levels)
            out.append(F.max(F.when(F.col("measure") == m, mixed("own", a, mixed("by_lang", b, c)))).alias(f"{name}_{m}"))
    return rows.groupBy("lang", "source").agg(*out)


def judge(measured: DataFrame, fences: DataFrame, lang: str = "lang", source: str = "source", rules: Rules = Rules()) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``. A group without limits has no text that passes the base rules."""
    fences = fences.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    inside = F.lit(True)
    for m, (v, _, _, low) in VALUES.items():
        inside = inside & (F.expr(v) <= F.col(f"hi_{m}"))
        if low:
            inside = inside & (F.expr(v) >= F.col(f"lo_{m}"))
    kept = [c for c in measured.columns if c not in ("base_failed", "kept")]
    return (measured.join(fences, F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")), "left")
            .select(*kept, base_failed(rules).alias("base_failed"), (~base_failed(rules) & F.coalesce(inside, F.lit(True))).alias("kept")))


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep_text: bool = True, rules: Rules = Rules()) -> DataFrame:
    """``docs`` with ``MEASURES``, ``base_failed`` and ``kept``; columns of these names are replaced.

    Null texts are empty and fail the base rule; null languages and sources are groups of their own; repeated rows count
    each time; an empty table gives no rows. The measures are written once, beside the texts with ``keep_text``.
    """
    measured = measure(docs, text)
    stored = shared_table(measured if keep_text else measured.drop(text))
    return judge(stored, shared_table(limits(sketches(stored, lang, source, rules), rules)), lang, source, rules)


def rejections(judged: DataFrame, fences: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """A row of counts: the texts that pass the base rules, and how many of these each measure's limits reject."""
    fences = fences.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    met = judged.where("not base_failed").join(fences, F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")))
    over = {m: (F.expr(v) > F.col(f"hi_{m}")) | ((F.expr(v) < F.col(f"lo_{m}")) if low else F.lit(False)) for m, (v, _, _, low) in VALUES.items()}
    return met.agg(F.count(F.lit(1)).alias("passed"), *[F.count_if(c).alias(m) for m, c in over.items()])
