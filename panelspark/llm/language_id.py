"""Language spans: script ranges narrow the candidates, a Viterbi pass over per-word scores labels mixed text.

A word's score for a language is the log likelihood of its letter n-grams, from counts over all labelled training
documents in a table of fixed size. Words of one script compete only among languages that the training texts show in
that script. A path over a document's words pays SWITCH for each change of language.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import text_of

#: Letter n-grams of a word with its edges, up to so many letters, hashed to 2^SLOT_BITS slots.
GRAM, SLOT_BITS = 4, 16
#: Cost of changing the language between two words, in natural log units; no word speaks for more than 1.5 of it.
SWITCH = 12.0
SMOOTHING = 0.5
#: A language is a candidate in a script that holds at least this part of its letters.
LEAST_SCRIPT = 0.02
#: Words that a task remembers before it starts over; characters worked on together.
REMEMBERED, BATCH = 300_000, 2_000_000

#: Script ranges (first code point, name), each up to the next start; fixed values of the Unicode blocks.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"),
    (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB07, "Other"),
]
_STARTS = [a for a, _ in SCRIPTS]
WORDS = regex.compile(r"\p{L}+")


def script_of(word: str) -> str:
    """The script of a word's first letter."""
    return SCRIPTS[bisect.bisect_right(_STARTS, ord(word[0])) - 1][1]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of all words in a row, and how many each word has."""
    codes = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    last = np.repeat(first + sizes, sizes)
    slots, owners = [], []
    rolled = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, GRAM + 1):
        # rolled: the hash of the n symbols from each place on.
        rolled[: len(codes) - n + 1] = (rolled[: len(codes) - n + 1] ^ codes[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        fits = np.flatnonzero(np.arange(len(codes)) + n <= last)
        slots.append((rolled[fits] >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
        owners.append(word[fits])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(slots)[order], np.bincount(owner, minlength=len(words))


def _words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, n) and (lang, script, letters) of a task's documents; both bounded by the tables' size."""
    words: dict[str, Counter] = {}
    slots: dict[str, np.ndarray] = {}
    scripts: dict[str, Counter] = {}

    def settle(lang: str) -> None:
        names = list(words[lang])
        counts = np.fromiter(words[lang].values(), dtype=np.float64, count=len(names))
        if names:
            at, n = grams(names)
            slots[lang] += np.bincount(at, weights=np.repeat(counts, n), minlength=1 << SLOT_BITS)
            for w, c in zip(names, counts):
                scripts[lang][script_of(w)] += int(c) * len(w)
        words[lang] = Counter()

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            if lang not in words:
                words[lang], slots[lang], scripts[lang] = Counter(), np.zeros(1 << SLOT_BITS), Counter()
            words[lang].update(_words(text))
            if len(words[lang]) > REMEMBERED:
                settle(lang)
    for lang in list(words):
        settle(lang)
        at = np.flatnonzero(slots[lang])
        names = list(scripts[lang])
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([lang] * (len(at) + len(names)), pa.string()),
            "slot": pa.array([*at.tolist(), *[None] * len(names)], pa.int32()),
            "script": pa.array([*[None] * len(at), *names], pa.string()),
            "n": pa.array([*slots[lang][at].astype(np.int64).tolist(), *[scripts[lang][s] for s in names]], pa.int64())})


class Model:
    """Log likelihoods (slot x language), and which languages each script allows. Its size follows from the number of
    languages only."""

    def __init__(self, rows: pd.DataFrame):
        self.languages = sorted(rows["lang"].unique()) if len(rows) else []
        index = {lang: i for i, lang in enumerate(self.languages)}
        table = np.full((1 << SLOT_BITS, len(self.languages)), SMOOTHING)
        of_slot = rows[rows["slot"].notna()]
        table[of_slot["slot"].astype(int), of_slot["lang"].map(index)] += of_slot["n"]
        self.logs = np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32)
        self.allowed: dict[str, np.ndarray] = {}
        of_script = rows[rows["script"].notna()]
        total = of_script.groupby("lang")["n"].sum()
        for lang, script, n in of_script[["lang", "script", "n"]].itertuples(index=False):
            if n >= LEAST_SCRIPT * total[lang]:
                self.allowed.setdefault(script, np.zeros(len(self.languages), dtype=bool))[index[lang]] = True

    def scores(self, words: list[str]) -> np.ndarray:
        """Word x language: each word's log likelihood less that of its best candidate; languages that its script rules
        out stay a switch and a half behind; all are even where the script is unknown."""
        if not words or not self.languages:
            return np.zeros((len(words), len(self.languages)), dtype=np.float32)
        at, n = grams(words)
        sums = np.add.reduceat(self.logs[at], np.cumsum(n) - n, axis=0)
        # N-grams overlap; their mean per letter times the letters counts each letter once.
        sums *= (np.array([len(w) for w in words]) / n)[:, None]
        for script, places in pd.Series(np.arange(len(words))).groupby([script_of(w) for w in words]):
            allowed = self.allowed.get(script)
            if allowed is None:
                sums[places] = 0
            else:
                sums[np.ix_(places, ~allowed)] = -np.inf
        return np.maximum(sums - sums.max(axis=1, keepdims=True), -1.5 * SWITCH)


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of every word; ``scores`` holds all texts' words in a row, ``sizes`` how many each has.

    All texts advance together, the longest first, so that those still running are the first ones. Ties go to the
    language that is first in order.
    """
    order = np.argsort(-sizes, kind="stable")
    length, first = sizes[order], (np.cumsum(sizes) - sizes)[order]
    longest = int(length[0]) if len(length) else 0
    running = np.searchsorted(-length, -np.arange(longest), side="left")
    best = np.zeros((len(sizes), scores.shape[1]), dtype=np.float32)
    back = np.full(len(scores), 0, dtype=np.int16)
    stays = np.zeros(scores.shape, dtype=bool)
    for t in range(longest):
        m = running[t]
        at = first[:m] + t
        if t:
            top = best[:m].argmax(axis=1)
            change = best[np.arange(m), top][:, None] - switch
            stays[at] = best[:m] >= change
            back[at] = top
            best[:m] = np.maximum(best[:m], change)
        best[:m] += scores[at]
        best[:m] -= best[:m].max(axis=1, keepdims=True)
    state = best.argmax(axis=1).astype(np.int16)
    path = np.zeros(len(scores), dtype=np.int16)
    for t in range(longest - 1, -1, -1):
        m = running[t]
        at = first[:m] + t
        path[at] = state[:m]
        state[:m] = np.where(stays[at, state[:m]], state[:m], back[at])
    return path


class Labeller:
    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.table = np.zeros((0, len(model.languages)), dtype=np.float32)

    def label(self, texts: list[str]) -> list[tuple[str, float, list[dict]]]:
        """(language, score, spans) of each text."""
        names = self.model.languages
        if not names:
            return [("und", 0.0, []) for _ in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.table = {}, self.table[:0]
        lists = [_words(t) for t in texts]
        new = list({w for ws in lists for w in ws if w not in self.known})
        if new:
            self.known.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, self.model.scores(new)])
        flat = [w for ws in lists for w in ws]
        number = np.array([self.known[w] for w in flat], dtype=np.int64)
        sizes = np.array([len(ws) for ws in lists], dtype=np.int64)
        scores = self.table[number]
        path = viterbi(scores, sizes)
        # Words that no language explains are even, and count for none.
        letters = np.where((scores != 0).any(axis=1) | (len(names) == 1), [len(w) for w in flat], 0.0) if flat else np.zeros(0)
        ends = np.cumsum(sizes)
        text_of_word = np.repeat(np.arange(len(texts)), sizes)
        share = np.bincount(text_of_word * len(names) + path, weights=letters, minlength=len(texts) * len(names)).reshape(len(texts), -1)
        out = []
        for i, (text, end, n) in enumerate(zip(texts, ends, sizes)):
            if not n:
                out.append(("und", 0.0, []))
                continue
            top = int(share[i].argmax())
            sure = float(share[i, top] / share[i].sum()) if share[i].any() else 1 / len(names)
            changes = np.flatnonzero(np.diff(path[end - n : end])) + 1
            spans = self._spans(text, path[end - n : end], changes) if len(changes) else [{"lang": names[top], "start": 0, "end": len(text)}]
            out.append((names[top], sure, spans))
        return out

    def _spans(self, text: str, path: np.ndarray, changes: np.ndarray) -> list[dict]:
        """Spans cover the text; each but the first starts with its first word."""
        starts = [m.start() for m in WORDS.finditer(text.lower())] if len(text.lower()) == len(text) else [m.start() for m in WORDS.finditer(text)]
        cuts = [0, *[starts[c] for c in changes if c < len(starts)], len(text)]
        return [{"lang": self.model.languages[int(path[c])], "start": a, "end": b} for c, a, b in zip([0, *changes], cuts, cuts[1:])]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts over all rows with a language. What comes to the driver: 2^SLOT_BITS rows a language at most, and its scripts."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), text_of(text).alias("text"))
    counted = rows.mapInArrow(_count, "lang string, slot int, script string, n long").groupBy("lang", "slot", "script").agg(F.sum("n").alias("n"))
    return Model(counted.toPandas())


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` (most letters; ``und`` without letters or without a learnt language), ``score`` (their
    share of the letters, 0 for ``und``) and ``spans`` (lang, start, end in code points). Same-named columns are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, spans: array<struct<lang: string, start: int, end: int>>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = Labeller(shared.value)
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])
        for batch in batches:
            out, part, size = [], [], 0
            for t in batch.to_pylist():
                part.append(t or "")
                size += len(part[-1])
                if size >= BATCH:
                    out += labeller.label(part)
                    part, size = [], 0
            out += labeller.label(part) if part else []
            yield pa.array([{"lang_pred": a, "score": b, "spans": c} for a, b, c in out], kind)

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    return docs.select(*kept, run(F.col(text)).alias("_found")).select(*kept, "_found.*")


def held_out(id: str = "doc_id", folds: int = 4, held: int = 2):
    """Whether crc32 of the id as text leaves ``held``; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(F.col(id).cast("string"), "UTF-8")) % folds == held, F.lit(False))
