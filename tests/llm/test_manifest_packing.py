"""Merkle manifest, fill-in-the-middle and packing against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from panelspark.llm import fill_middle, merkle, packing
from panelspark.llm.queries import tokenizer
from tests.llm.conftest import COLUMNS, odd_rows

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """The last node over ``nodes``, and each one's siblings as (left, right) texts, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p - p % 8 : p - p % 8 + 8]
            paths[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        nodes, at = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [p // 8 for p in at]
    return nodes[0], paths


def plain_manifest(rows):
    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        changed = text
        if text is not None and i is not None and zlib.crc32(str(i).encode()) % 3 == 0:
            changed = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        groups[lang].append((i, plain_leaf(i, source, lang, n, text), plain_leaf(i, source, lang, n, changed)))
    order = lambda v: (v is not None, v if v is not None else 0)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    under = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (order(r[0]), r[1]))
        under[lang] = climb([r[1] for r in groups[lang]])
    if not langs:
        return
    root, above = climb([under[x][0] for x in langs])
    for lang, top in zip(langs, above):
        for (i, leaf, changed), path in zip(groups[lang], under[lang][1]):
            fold = changed
            for a, b in [*path, *top]:
                fold = H(a, fold, b)
            yield i, leaf, under[lang][0], root, H(*[a + b for a, b in [*path, *top]]), fold, fold == root


def many_rows(n, langs):
    rng = random.Random(n)
    return [(rng.randrange(n) if rng.random() < 0.1 else i, f"Text {i} é", rng.choice(langs), rng.choice(["A", None]), i) for i in range(n)]


@pytest.mark.parametrize("rows", [
    odd_rows(), many_rows(1, ["en"]), many_rows(1, [None]), many_rows(8, ["en"]), many_rows(9, ["en"]), many_rows(1200, ["de", "en", None, "é", ""]),
    many_rows(700, [f"l{i}" for i in range(90)]), [(5, "T", "en", None, None)] * 70])
def test_manifest(spark, rows, monkeypatch):
    monkeypatch.setattr(merkle, "MEET", 20)
    got = merkle.verified_manifest(spark.createDataFrame(rows, COLUMNS).repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(rows))


def test_manifest_of_odd_tables(none, clashing):
    assert merkle.verified_manifest(none).count() == 0
    rows = clashing.drop("id").withColumnsRenamed({"row": "digest", "kept": "group", "fp": "tree", "key": "pos"})
    assert Counter(map(tuple, merkle.verified_manifest(rows).collect())) == Counter(plain_manifest(odd_rows()))


def plain_fill(i, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = H(f"7:{'' if i is None else i}")
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, odd, none, clashing, monkeypatch):
    rng = random.Random(3)
    bits = ["\n", "\n\n", "word ", "é", "日本", "<", "P>", "<P", "<S", ">", "x" * 90, " ", "👍", "\x00", "M>"]
    shared = "".join(rng.choice(bits[:5]) for _ in range(3000))
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 400)))) for i in range(300)]
    rows += [(1000 + i, "".join(rng.choice("abc\n") for _ in range(i)) + shared + str(i)) for i in range(40)]
    rows += [(2000, "a" * 100_000), (2001, "\n" * 9000), (2002, "x" * 63 + "<P>"), (2003, "x" * 4095 + "<M>" + "y" * 4095), (None, "a\nb"), (2004, None), (2004, None)]
    rows += [(i, t) for i, t, *_ in odd_rows()]
    done = fill_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    got = done.select("doc_id", "text", *fill_middle.COLUMNS, fill_middle.restored().alias("back")).collect()
    assert Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter((i, t, *plain_fill(i, t)) for i, t in rows)
    assert all(r.back == (r.text or "") for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(none).count() == 0
    assert fill_middle.fill_in_middle(clashing.withColumnsRenamed({"row": "n", "kept": "output"})).columns.count("output") == 1


def test_chunks_follow_their_content():
    """Equal passages fall into equal chunks wherever they stand, and few summaries serve many texts."""
    rng = random.Random(1)
    passage = bytes(rng.choice(b"abcdefgh \n") for _ in range(20_000))
    raw = [bytes(rng.choice(b"xyz\n") for _ in range(rng.randint(1, 500))) + passage for _ in range(20)]
    data = fill_middle._APART.join(raw)
    sizes = np.array([len(t) for t in raw])
    starts = np.cumsum(sizes + fill_middle.SEEN) - sizes - fill_middle.SEEN
    known = fill_middle.Summaries()
    for t, start, ends in zip(raw, starts.tolist(), fill_middle.cuts(np.frombuffer(data, dtype=np.uint8), starts, starts + sizes)):
        cut = [data[a:b] for a, b in zip([start, *ends[:-1]], ends)]
        assert b"".join(cut) == t and all(fill_middle.LEAST <= len(c) <= fill_middle.MOST for c in cut[:-1])
        parts = [known.of(c) for c in cut]
        assert sum(len(p.ends) for p in parts) == t.count(b"\n")
    pieces = sum(sizes) / (20_000 / len(known.known))
    assert len(known.known) < pieces / 5


def ids_of(texts):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    return [theirs.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def check_packing(rows, got, window):
    """Every id of every document in one piece; sequences gapless, with at most ``window`` tokens."""
    docs = Counter((i, tuple(ids)) for (i, _), ids in zip(rows, ids_of([t for _, t in rows])))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    wanted = defaultdict(Counter)
    for (i, ids), n in docs.items():
        wanted[i, len(ids)][ids] += n
    assert set(pieces) == set(wanted)
    for key, own in pieces.items():
        copies, length = sum(wanted[key].values()), key[1]
        assert sum(n for _, n, _ in own) == copies * length
        covered = Counter(p for s, n, _ in own for p in range(s, s + n))
        assert set(covered) == set(range(length)) and set(covered.values()) == {copies}
        sums = {zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes()) for s, n, _ in own for ids in wanted[key]}
        assert {c for _, _, c in own} <= sums
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
        total += at
    return padding / max(1, total)


def test_tokens_are_those_of_the_library():
    rng = random.Random(0)
    texts = [t or "" for _, t, *_ in odd_rows()] + ["", "don't  WE'LL", "İstanbul ΣΑΣ é é ́", "a\x1cb　c d\t\r\ne", "x<|endoftext|>y <|startoftext|>", "½ ² 12", "it's' 'sun' don't. (x) a!? é'", "İ. İ, ΑΣ."]
    texts += ["".join(rng.choice(" \n\tab'1.é́　<|ΣIİ") for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    own = packing.Tokens(tokenizer("word_bpe_49k.json"))
    for half in (texts[::2], texts[1::2]):
        ids, n = own.encode(pa.array(half), 1)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == ids_of(half)


@pytest.mark.parametrize("window,most,slack,parts", [(2048, 32, 8, 4), (64, 3, 4, 40), (64, 1, 0, 3)])
def test_packing(spark, window, most, slack, parts):
    rng = random.Random(parts)
    rows = [(i, " ".join(rng.choice(["sun", "panels", "dust", "Regen", "é", "x9"]) for _ in range(int(rng.expovariate(1 / 60))))) for i in range(600)]
    rows += [(i, t) for i, t, *_ in odd_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = packing.pack(docs, tokenizer("word_bpe_49k.json"), window=window, most=most, slack=slack).collect()
    assert check_packing(rows, got, window) <= slack / (window - slack)


def test_packing_of_odd_tables(none, clashing):
    path = tokenizer("word_bpe_49k.json")
    assert packing.pack(none, path).count() == 0
    got = packing.pack(clashing.withColumnsRenamed({"row": "start", "kept": "part", "fp": "window"}), path).collect()
    check_packing([(i, t) for i, t, *_ in odd_rows()], got, packing.WINDOW)


def test_whole_table_is_packed_with_little_padding(spark):
    from panelspark.llm.queries import QUERIES
    from tests.conftest import SF

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert check_packing(rows, QUERIES["op13_bounded_packing"](spark, SF).collect(), packing.WINDOW) < 0.004
