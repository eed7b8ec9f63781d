"""Merkle manifest of a table, with a proof for every row found by pointer jumping.

Leaves stand in order within their group; runs of ``fan`` neighbours become their parent, until one node is left, the
group's subroot; subroots, in the groups' order, become the root the same way.

Proofs: a node holds the siblings on its way to an ancestor, at first those of its own run on the way to its parent. A
round joins the nodes with themselves on ancestor = node, which appends the ancestor's siblings and doubles the distance,
until all have reached the root. Leaves of one run share everything above it, so a run goes through the rounds as one row
that stands for its leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.llm.common import blocks, shared_table

FAN = 8
#: Nodes below one ancestor that meet it in one part of a join; further ones meet copies of it.
MEET = 4096
#: The tree over the subroots, and the level at which they stand in it.
TOP, SUBROOT = -1, -1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*inputs: Column) -> Column:
    """SHA-256 (binary) of the inputs' texts, one after the other."""
    return F.unhex(F.sha2(F.concat(*inputs), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon, and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows``, stored, with ``tree`` (a number of their group that ascends with it), ``pos`` (place in it, from 0, by
    ``order``, nulls first) and ``n`` (the group's size).

    Rows are range-partitioned and sorted; only rows per partition and group are then added up, so neither a group nor
    the table passes through one task. Rows that tie stand in any order; a number drawn per row splits many of them.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    drawn = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = drawn.repartitionByRange(blocks(rows.sparkSession), *keys, F.col("_tie")).sortWithinPartitions(*keys, "_tie").drop("_tie")
    stored = shared_table(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    spans = stored.groupBy("_part", F.col(group).alias("_group")).agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy("_group")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = shared_table(spans.select(F.col("_part").alias("_p"), "_group", (before - F.col("_first")).alias("_shift"),
                                      F.min("_first").over(whole).alias("tree"), F.sum("_n").over(whole).alias("n")))
    met = stored.join(spans, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group")))
    return met.withColumn("pos", F.col("_i") + F.col("_shift")).drop("_part", "_i", "_p", "_group", "_shift")


def _node(tree: Column, level: Column, pos: Column) -> Column:
    return F.struct(tree.cast("long").alias("tree"), level.cast("int").alias("level"), pos.cast("long").alias("pos"))


def _joined(members: str) -> Column:
    """The digest of a run: a lone last node is hashed too."""
    return digest(F.array_join(F.transform(members, lambda m: hexed(m["digest"])), ""))


def _runs(nodes: DataFrame, *carry: str) -> DataFrame:
    """(tree, pos, n, members, alone, digest): the runs of nodes (tree, pos, n, digest) as their parents. Members keep
    ``carry``. The only node of a tree is alone: it is no run, and its digest stays."""
    members = F.array_sort(F.collect_list(F.struct("pos", "digest", *carry)))
    at = F.floor(F.col("pos") / FAN).cast("long").alias("pos")
    runs = nodes.groupBy("tree", at).agg(F.ceil(F.max("n") / FAN).cast("long").alias("n"), members.alias("members"), (F.max("n") == 1).alias("alone"))
    return shared_table(runs.withColumn("digest", F.when(F.col("alone"), F.col("members")[0]["digest"]).otherwise(_joined("members"))))


def _beside(members: str, m: Column) -> Column:
    """What the run holds to the left and to the right of a member, as digests end to end."""
    side = lambda there: F.array_join(F.transform(F.filter(members, there), lambda o: F.hex(o["digest"])), "")
    return F.struct(F.unhex(side(lambda o: o["pos"] < m["pos"])).alias("left"), F.unhex(side(lambda o: o["pos"] > m["pos"])).alias("right"))


_SEGMENT = "array<struct<left: binary, right: binary>>"


def _climb(level: int, nodes: DataFrame, name, above) -> tuple[list[DataFrame], DataFrame | None, int]:
    """Builds the tree over ``nodes`` (tree, pos, n, digest) that stand at ``level``, level by level.

    Returns the jump rows (id, up, segments, subroot) of all nodes below the trees' last ones, the last ones (tree,
    digest), and how many levels were built. ``name(tree, level, pos)`` is a node's id, ``above(level)`` that of its parent's.
    """
    rows, last, height = [], None, 0
    while True:
        done = nodes.where("n = 1").select("tree", "digest")
        last = done if last is None else last.unionByName(done)
        nodes = nodes.where("n > 1")
        if nodes.isEmpty():
            return rows, last, height
        runs = _runs(nodes)
        up = above(level)
        segment = F.array(_beside("members", F.col("m"))).cast(_SEGMENT)
        rows.append(runs.select("*", F.explode("members").alias("m")).select(
            name(F.col("tree"), F.lit(level), F.col("m.pos")).alias("id"), up.alias("up"), segment.alias("segments"),
            F.when(up["level"] == SUBROOT, F.col("digest")).alias("subroot")))
        nodes, level, height = runs.select("tree", "pos", "n", "digest"), level + 1, height + 1


def manifest(leaves: DataFrame, group: str, order: str) -> DataFrame:
    """From ``leaves`` (group, order, ``digest`` binary, further columns): the further columns with ``leaf``, ``subroot``,
    ``root`` (binary) and ``path``, the segments (left, right: siblings' digests end to end) from the leaf to the root.

    Groups and rows ascend, nulls first, strings bytewise; rows that tie in both stand by their digest. Equal rows are
    leaves of their own. An empty table gives no rows; the only leaf of a table is its root, with an empty path.
    """
    carry = tuple(c for c in leaves.columns if c not in (group, order, "digest"))
    placed = numbered(leaves.select(group, order, "digest", F.struct(order, *carry).alias("row")), group, order, "digest")
    lower = _runs(placed, "row")
    within = lambda tree, level, pos: _node(tree, level, pos)
    over = lambda level: F.when(F.col("n") == 1, _node(F.col("tree"), F.lit(SUBROOT), F.lit(0))).otherwise(
        _node(F.col("tree"), F.lit(level + 1), F.col("pos")))
    rows, last, height = _climb(1, lower.select("tree", "pos", "n", "digest"), within, over)
    tops = numbered(last.select(F.lit(0).alias("all"), F.col("tree").alias("of"), "digest"), "all", "of").select(
        F.lit(TOP).cast("long").alias("tree"), "of", "pos", "n", "digest")
    name = lambda tree, level, pos: _node(F.lit(TOP), level, pos)
    more, top, high = _climb(0, tops.drop("of"), name, lambda level: _node(F.lit(TOP), F.lit(level + 1), F.col("pos")))
    # A subroot stands in the upper tree under its own name.
    if more:
        own = tops.select(F.struct(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), "pos").alias("id"), "of", F.col("digest").alias("own"))
        more[0] = more[0].join(own, "id").select(_node(F.col("of"), F.lit(SUBROOT), F.lit(0)).alias("id"), "up", "segments", F.col("own").alias("subroot"))
    jumps = None
    for part in (*rows, *more):
        jumps = part if jumps is None else jumps.unionByName(part)
    lower = lower.withColumn("id", over(0))
    root = top.select(F.col("digest").alias("root"))
    if jumps is None:  # one run at most
        found = lower.withColumn("segments", F.array().cast(_SEGMENT)).withColumn("subroot", F.col("digest"))
    else:
        jumps = shared_table(jumps)
        total = jumps.count()
        for k in range(max(0, height + high - 1).bit_length()):
            jumps = shared_table(_jump(jumps, 1 << k, min(FAN ** (1 << k), total)))
        found = lower.join(jumps.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
        found = found.withColumn("segments", F.coalesce("segments", F.array().cast(_SEGMENT))).withColumn("subroot", F.coalesce("subroot", "digest"))
    leaf = found.select("subroot", "segments", "members", "alone", F.explode("members").alias("m"))
    first = F.when(F.col("alone"), F.array().cast(_SEGMENT)).otherwise(F.array(_beside("members", F.col("m"))).cast(_SEGMENT))
    return leaf.select("m.row.*", F.col("m.digest").alias("leaf"), "subroot", F.concat(first, "segments").alias("path")).crossJoin(F.broadcast(root))


def _jump(rows: DataFrame, distance: int, below: int) -> DataFrame:
    """Every row's ancestor, so far above, replaced by that ancestor's, with the siblings on the way. An ancestor has
    ``below`` rows under it at most; they are dealt over so many copies of it that each meets few."""
    copies = -(-below // MEET)
    above = rows.where((F.col("id.tree") == TOP) | (F.col("id.level") == SUBROOT) | (F.col("id.level") > distance))
    ancestors = above.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("segments").alias("_segments"), F.col("subroot").alias("_subroot"),
                             F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(copies))).join(ancestors, ["up", "salt"], "left").select(
        "id", F.coalesce("_up", "up").alias("up"), F.concat("segments", F.coalesce("_segments", F.array().cast(_SEGMENT))).alias("segments"),
        F.coalesce("subroot", "_subroot").alias("subroot"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and the siblings on its path."""
    return F.aggregate(path, leaf, lambda own, s: digest(hexed(s["left"]), hexed(own), hexed(s["right"])))


def proof(path: Column) -> Column:
    """All siblings on the path as hex text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(hexed(s["left"]), hexed(s["right"]))), "")


def leaf(columns: list[Column]) -> Column:
    """The digest of a row's columns in that order."""
    return digest(*[field(c) for c in columns])


def tampered(text: str) -> Column:
    """The text with A-Z in lower case; null stays."""
    return F.translate(text, _UPPER, _LOWER)


def verified_manifest(docs: DataFrame, id: str = "doc_id", text: str = "text", group: str = "lang", columns: tuple[str, ...] = ("source", "lang", "n_chars"),
                      every: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` (hex), ``verified``.

    A leaf covers the id, ``columns`` and the whole text; nulls count as ``-``. Rows whose id's CRC-32 ``every`` divides
    are tampered with (``tampered``) before their root is folded; a null id is never. A text that tampering leaves as it
    is verifies. Repeated rows are leaves of their own; columns not named take no part; an empty table gives no rows.
    """
    named = lambda t: leaf([F.col(id), *[F.col(c) for c in columns], t])
    hit = F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(every)) == 0
    leaves = docs.select(F.col(id).alias("id"), F.col(group).alias("group"), named(F.col(text)).alias("digest"),
                         F.when(hit, named(tampered(text))).alias("changed"))
    found = manifest(leaves, "group", "id")
    again = folded(F.coalesce("changed", "leaf"), F.col("path"))
    rooted = found.select("id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), again.alias("again"))
    return rooted.select(F.col("id").alias(id), hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"),
                         "proof_sha256", hexed(F.col("again")).alias("folded_root"), (F.col("again") == F.col("root")).alias("verified"))
