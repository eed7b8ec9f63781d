"""Exact deduplication by exchange of Golomb-coded fingerprints.

Every sender block sorts the 64-bit fingerprints of its rows and sends each owner (a range of fingerprints) its part
as Golomb-Rice coded gaps. An owner answers every sender with one bit per fingerprint: seen more than once or not.
Only rows whose bit is set are suspects; only their texts are shuffled, and compared byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import SPACE, blocks, flagged, row_key, shared_table, sifted, text_of


def golomb_encode(gaps: np.ndarray) -> tuple[int, bytes, bytes]:
    """(k, quotients in unary, k low bits of each) of non-negative gaps (uint64); k follows from their mean."""
    mean = float(gaps.astype(np.float64).mean()) if len(gaps) else 0.0
    k = min(63, max(0, int(np.log2(max(mean * 0.6931, 1.0)))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.ones(int(ends[-1]) + 1 if len(gaps) else 0, dtype=np.uint8)
    unary[ends] = 0
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(low.ravel()).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, low: bytes) -> np.ndarray:
    """The ``n`` gaps that ``golomb_encode`` coded."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, dtype=np.uint8)) == 0)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(low, dtype=np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
    return (quotients.astype(np.uint64) << np.uint64(k)) | (bits << np.arange(k, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)


def _distinct(prints: pa.ChunkedArray, copies: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints, the place of each row's among them, and how many rows each has."""
    values, place = np.unique(prints.to_numpy().view(np.uint64), return_inverse=True)
    return values, place, np.bincount(place, weights=copies.to_numpy(), minlength=len(values))


def _owner(values: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold ranges of fingerprints, so a sorted list falls into runs."""
    return ((values >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _send(owners: int):
    schema = pa.schema([("owner", pa.int32()), ("sender", pa.int32()), ("n", pa.int64()), ("first", pa.int64()), ("k", pa.int32()),
                        ("unary", pa.binary()), ("low", pa.binary()), ("repeated", pa.binary())])

    def run(rows: pa.Table) -> pa.Table:
        values, _, copies = _distinct(rows["fp"], rows["n"])
        owner = _owner(values, owners)
        edges = np.flatnonzero(np.diff(owner, prepend=-1))
        out = []
        for a, b in zip(edges, [*edges[1:], len(values)]):
            k, unary, low = golomb_encode(np.diff(values[a:b]))
            out.append((int(owner[a]), rows["sender"][0].as_py(), int(b - a), int(values[a : a + 1].view(np.int64)[0]), k, unary, low,
                        np.packbits(copies[a:b] > 1).tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _answer(rows: pa.Table) -> pa.Table:
    lists = []
    for r in rows.to_pylist():
        gaps = golomb_decode(r["n"] - 1, r["k"], r["unary"], r["low"])
        first = np.array([r["first"]], dtype=np.int64).view(np.uint64)
        lists.append((np.cumsum(np.concatenate([first, gaps]), dtype=np.uint64), np.unpackbits(np.frombuffer(r["repeated"], dtype=np.uint8))[: r["n"]]))
    everything = np.sort(np.concatenate([v for v, _ in lists]))
    twice = np.unique(np.concatenate([everything[1:][everything[1:] == everything[:-1]], *[v[m == 1] for v, m in lists]]))
    bits = [np.packbits(np.isin(v, twice, assume_unique=True)).tobytes() for v, _ in lists]
    return pa.table({"sender": rows["sender"], "owner": rows["owner"], "n": rows["n"], "bits": pa.array(bits, pa.binary())})


def _mark(rows: pa.Table, answers: pa.Table) -> pa.Table:
    _, place, _ = _distinct(rows["fp"], rows["n"])
    order = answers.sort_by("owner")
    flags = np.concatenate([np.unpackbits(np.frombuffer(b, dtype=np.uint8))[:n] for b, n in zip(order["bits"].to_pylist(), order["n"].to_pylist())])
    return rows.drop_columns(["sender", "fp"]).append_column("suspect", pa.array(flags[place] == 1))


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct (id, text): ``id``, ``row`` (its key), ``copies`` (how often the row itself repeats),
    ``sha`` (SHA-256 of the normalised text, binary), ``keep_id``, ``group_size``, ``first`` (this row stays).

    Texts are equal when identical after replacing each run of ASCII white space by one space. Null texts count as
    empty; the smallest id stays, a null id last; of rows that repeat an id and an equal text exactly one stays. An
    empty table gives no rows. Other columns are ignored.
    """
    parts = blocks(docs.sparkSession)
    named = docs.select(F.col(id).alias("id"), text_of(text).alias("text"), row_key(id, text).alias("row"))
    plain = F.regexp_replace("text", SPACE, " ")
    prints = shared_table(
        named.select("id", "row", plain.alias("plain"))
        .select("id", "row", F.xxhash64("plain").alias("fp"), F.unhex(F.sha2("plain", 256)).alias("sha"))
        .groupBy("id", "row", "fp", "sha").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("sender", F.pmod("row.h1", F.lit(parts)).cast("int")))
    sent = prints.select("sender", "fp", "n").groupBy("sender").applyInArrow(
        _send(parts), "owner int, sender int, n long, first long, k int, unary binary, low binary, repeated binary")
    answers = sent.groupBy("owner").applyInArrow(_answer, "sender int, owner int, n long, bits binary")
    marked = shared_table(prints.select("id", "row", "sha", "n", "sender", "fp").groupBy("sender").cogroup(answers.groupBy("sender")).applyInArrow(
        _mark, f"id {dict(prints.dtypes)['id']}, row struct<h1: long, h2: long>, sha binary, n long, suspect boolean"))
    # Only the suspects' texts move, picked out where they lie. The smallest id stays; ids that are null come last.
    suspects = marked.where("suspect").select("row").distinct()
    equal = (
        sifted(named, suspects, "row").join(suspects, "row")
        .select("id", "row", F.regexp_replace("text", SPACE, " ").alias("plain"))
        .groupBy("plain").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        # Never null, and said so: else the optimizer hashes every text once more, to filter nulls out before the exchange.
        .select(F.coalesce(F.unhex(F.sha2("plain", 256)), F.lit(bytearray())).alias("sha"), "keep", "group_size")
        .groupBy("sha").agg(F.min("keep").alias("keep"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
        .withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256")).cast("long")))
    )
    alone = F.col("keep").isNull()
    return marked.join(equal, "sha", "left").select(
        "id", "row", F.col("n").alias("copies"), "sha",
        F.when(alone, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        (alone | (F.col("keep.row") == F.col("row"))).alias("first"),
    )


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``. See ``exact_groups``."""
    return exact_groups(docs, id, text).select(
        F.col("id").alias(id), "keep_id", "group_size", "first", F.lower(F.hex("sha")).alias("text_sha256"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth"),
    ).select(id, "keep_id", "group_size", (F.col("first") & (F.col("nth") == 1)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. See ``exact_groups``."""
    groups = shared_table(exact_groups(docs, id, text).where(~F.col("first") | (F.col("copies") > 1)).select("row", "first"))
    keyed = docs.select(F.struct("*").alias("doc"), row_key(id, text).alias("row"))
    return settled(keyed, groups).select("doc.*")


def settled(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``keyed`` (doc, row) without those in ``groups`` (row, first), of which one stays where ``first``.

    Rows that the groups can't hold stay where they lie; the others, told by a filter, meet the groups in a join."""
    told = flagged(keyed, groups, "row")
    touched, rest = told.where("_may").drop("_may"), told.where("not _may").drop("_may")
    met = touched.join(groups.select(F.col("row").alias("_row"), "first"), F.col("row") == F.col("_row"), "left")
    gone = met.where("first is null").select("doc", "row")
    return rest.unionByName(gone).unionByName(met.where("first").dropDuplicates(["row"]).select("doc", "row"))
