"""Trie of shared conversation prefixes, by ROLLUP over positional turn-id columns.

Conversations are cut into blocks of ``WIDTH`` turns. A block is one row with a
turn id per position, filed under the node at which the block before it ends.
Grouping by that node and ROLLUP over the positions aggregates all prefixes of
all blocks at once; ``grouping_id`` tells how many positions a group holds.
A second ROLLUP sums over subtrees: what a node adds is booked on the smallest
conversation that passes it, at its position, so the sum over the members of a
node from their position on is the sum over its subtree.

A turn id is 128 bits of SHA-256 of role and text. A node is known by its depth
and two 64-bit values, the XOR of a hash of every position and turn id on its path.

Turns are ordered by ``turn``, null first; ties by the first 64 characters of
role and text, then by the id of the turn. Null role and text are empty. Rows
without a conversation id belong to none and are left out. Repeated rows are
repeated turns. Very long texts are read once for their id; very long
conversations are many blocks. An empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelab.llm.common import map_partitions
from placelab.operators import skew
from placelab.operators.rows import with_row_id
from placelab.session import materialize

WIDTH = 8
#: Blocks of a conversation that share a window, and conversation ids joined in one piece of text.
STRETCH, PIECE = 4096, 4096
TIE_CHARS = 64
SLOTS = range(1, WIDTH + 1)
NODE = ["depth", "k1", "k2"]
WORD = r"[^\x20\x09-\x0D]+"


def turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, id, words, n): turns with their 1-based place; n is the length of the conversation.

    Places come from a range partitioning with offsets, so a conversation may
    hold any share of the rows. Texts are not shuffled.
    """
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    named = F.concat(F.length(who).cast("string"), F.lit(":"), who, said)
    known = rows.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv_id"), F.col(turn).alias("_turn"),
        F.left(who, F.lit(TIE_CHARS)).alias("_role"), F.left(said, F.lit(TIE_CHARS)).alias("_text"),
        F.substring(F.unhex(F.sha2(named, 256)), 1, 16).alias("id"),
        F.regexp_count(said, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("_row"),
    )
    order = ["conv_id", F.asc_nulls_first("_turn"), "_role", "_text", "id", "_row"]
    numbered = with_row_id(known, *order, name="_at").select("conv_id", "_at", "id", "words")
    sizes = materialize(numbered.groupBy("conv_id").agg(
        F.min("_at").alias("_first"), F.count("*").alias("n"), F.count("*").alias("_n")))
    placed = skew.join_per_key(numbered, sizes, ["conv_id"], "_n")
    return placed.select("conv_id", (F.col("_at") - F.col("_first") + 1).alias("pos"), "id", "words", "n")


def with_shared_heads(placed: DataFrame, heads: Column, donor: Column) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) rebuilt: the first ``heads`` turns come from conversation ``donor``.

    ``heads`` and ``donor`` are functions of conv_id. If the donor has fewer
    turns, all of them; none if it is absent. The conversation's own turns follow
    after its first ``heads``. Conversations are (conv_id, n), n may be 0.
    """
    convs = materialize(placed.groupBy("conv_id").agg(F.first("n").alias("n")).select(
        "conv_id", "n", heads.cast("long").alias("h"), donor.cast("long").alias("donor")))
    lengths = convs.select(F.col("conv_id").alias("donor"), F.col("n").alias("_has"))
    taken = F.least("h", F.coalesce("_has", F.lit(0)))
    convs = materialize(convs.join(lengths, "donor", "left").select("conv_id", "n", "h", "donor", taken.alias("taken")))
    plan = convs.select("conv_id", "h", "taken", F.col("n").alias("_n"))
    own = skew.join_per_key(placed.drop("n"), plan, ["conv_id"], "_n").filter(F.col("pos") > F.col("h")).select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "id", "words")
    most = convs.agg(F.max("taken")).first()[0] or 0
    offered = placed.filter(F.col("pos") <= most).select(F.col("conv_id").alias("donor"), "pos", "id", "words")
    borrowed = offered.join(convs, "donor").filter(F.col("pos") <= F.col("taken")).select("conv_id", "pos", "id", "words")
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return own.unionByName(borrowed), convs.select("conv_id", length.alias("n"))


def _lane(seed: int, pos: str, turn_id: str) -> str:
    """A hash of a turn at its position; a node's value is the XOR of those on its path."""
    return f"xxhash64({seed}, {pos}, {turn_id})"


def _over_blocks(rows: DataFrame, values: dict[str, str], how: str, later: bool) -> DataFrame:
    """Add the aggregate ``how`` of ``values`` (name: column) over the earlier or later blocks of each conversation.

    Blocks of a long conversation are looked at in stretches, and the stretches'
    totals once more, so that no window holds more than a small part of them.
    """
    order, join = "DESC" if later else "ASC", "^" if how == "bit_xor" else "+"
    cut = rows.withColumn("_stretch", F.expr(f"block div {STRETCH}"))
    # only conversations of several stretches have something to hand over
    several = cut.filter("_stretch > 0").select("conv_id").distinct()
    totals = cut.join(several, "conv_id", "left_semi").groupBy("conv_id", "_stretch").agg(
        *[F.expr(f"{how}({c}) AS _total_{c}") for c in values.values()])
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    handed = totals.selectExpr("conv_id", "_stretch", *[
        f"{how}(_total_{c}) OVER (PARTITION BY conv_id ORDER BY _stretch {order} {before}) AS _handed_{c}" for c in values.values()])
    near = cut.selectExpr("*", *[
        f"{how}({c}) OVER (PARTITION BY conv_id, _stretch ORDER BY block {order} {before}) AS _near_{c}" for c in values.values()])
    return near.join(handed, ["conv_id", "_stretch"], "left").selectExpr(
        *rows.columns, *[f"coalesce(_near_{c}, 0L) {join} coalesce(_handed_{c}, 0L) AS {name}" for name, c in values.items()])


def blocks(rebuilt: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per conversation and block: t1..tk, w1..wk, and the node (b1, b2) that the block continues.

    Conversations without turns have one block without any.
    """
    none = convs.filter("n = 0").selectExpr("conv_id", "1L AS pos", "CAST(NULL AS binary) AS id", "0L AS words")
    rows = rebuilt.unionByName(none).selectExpr(
        "conv_id", "(pos - 1) div %d AS block" % WIDTH, "1 + (pos - 1) %% %d AS slot" % WIDTH, "id", "words",
        *[f"CASE WHEN id IS NOT NULL THEN {_lane(i, 'pos', 'id')} ELSE 0L END AS x{i}" for i in (1, 2)])
    cut = rows.groupBy("conv_id", "block").agg(
        *[F.expr(f"max({c}) FILTER (WHERE slot = {j}) AS {name}{j}") for name, c in (("t", "id"), ("w", "words")) for j in SLOTS],
        F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"),
    )
    return materialize(_over_blocks(materialize(cut), {"b1": "x1", "b2": "x2"}, "bit_xor", later=False))


def _rolled_up(cut: DataFrame, measures: str) -> DataFrame:
    """All prefixes of all blocks as nodes: (depth, k1, k2, p1, p2, level, measures); p1 and p2 are the parent's.

    Groups whose last position is empty are shorter conversations; level 0 is a
    node of its own at the start only, since elsewhere it is the end of the block before.
    """
    names = ", ".join(f"t{j}" for j in SLOTS)
    level = f"{WIDTH} - bit_count(grouping_id())"  # one bit for every position that is grouped away
    groups = cut.sparkSession.sql(
        f"SELECT block, b1, b2, {level} AS level, {names}, {measures} FROM {{cut}} GROUP BY block, b1, b2, ROLLUP({names})",
        cut=cut)
    kept = groups.withColumn("last", F.expr(_by_level("t"))).filter("last IS NOT NULL OR block = 0 AND level = 0")
    path = {
        i: " ^ ".join([f"b{i}", *[
            f"CASE WHEN level >= {j} THEN {_lane(i, f'(block * {WIDTH} + {j})', f't{j}')} ELSE 0L END" for j in SLOTS]])
        for i in (1, 2)
    }
    return kept.selectExpr("*", f"block * {WIDTH} + level AS depth", *[f"{path[i]} AS k{i}" for i in (1, 2)]).selectExpr(
        "*", *[f"k{i} ^ {_lane(i, 'depth', 'last')} AS p{i}" for i in (1, 2)]).drop("block", "b1", "b2", "last", *names.split(", "))


def _by_level(prefix: str) -> str:
    return "CASE level " + " ".join(f"WHEN {j} THEN {prefix}{j}" for j in SLOTS) + " END"


def _members(cut: DataFrame) -> DataFrame:
    """(depth, k1, k2, p1, p2, conv_id, n_convs, words): every node with its smallest member."""
    most = ", ".join(f"max(w{j}) AS w{j}" for j in SLOTS)
    nodes = _rolled_up(cut, f"count(*) AS n_convs, min(conv_id) AS conv_id, {most}")
    return nodes.selectExpr(*NODE, "p1", "p2", "conv_id", "n_convs", f"coalesce({_by_level('w')}, 0L) AS words")


def _ends(cut: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, k1, k2, n_ends, ends_sha256): conversations that end at a node, and the digest of their ids.

    Ids are numbered in order and joined in pieces of bounded size everywhere at
    once; a digest is then taken over the pieces of a node as they stream by.
    """
    whole = cut.groupBy("conv_id").agg(F.bit_xor("x1").alias("k1"), F.bit_xor("x2").alias("k2"))
    ends = whole.join(convs, "conv_id").select(F.col("n").alias("depth"), "k1", "k2", "conv_id")
    numbered = with_row_id(ends, *NODE, "conv_id", name="_at").withColumn("_piece", F.floor(F.col("_at") / PIECE))
    texts = numbered.groupBy(*NODE, "_piece").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, count, digest = None, 0, None
        for batch in batches:
            out: list[tuple] = []
            for *now, n, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5))):
                if now != node:
                    if node:
                        out.append((*node, count, digest.hexdigest()))
                    node, count, digest = now, 0, hashlib.sha256()
                digest.update((("," if count else "") + ids).encode())
                count += n
            yield from _digest_rows(out)
        if node:
            yield from _digest_rows([(*node, count, digest.hexdigest())])

    ordered = texts.select(*NODE, "_piece", "n", "ids").repartition(*NODE).sortWithinPartitions(*NODE, "_piece")
    return map_partitions(ordered, digests, "depth long, k1 long, k2 long, n_ends long, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        columns = list(zip(*rows))
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4])], [*NODE, "n_ends", "ends_sha256"])


def _below(cut: DataFrame, nodes: DataFrame) -> DataFrame:
    """(depth, k1, k2, n_leaves, saved_tokens): sums over the subtree of every node, itself included.

    ``nodes`` has what each adds in ``saved`` and ``leaf``. Both are booked on
    the node's smallest member: its block holds, per position, what it adds from there on.
    """
    own = nodes.filter("saved > 0 OR leaf > 0").selectExpr(
        "conv_id", f"greatest((depth - 1) div {WIDTH}, 0L) AS block", "depth", "saved", "leaf")
    booked = own.groupBy("conv_id", "block").agg(
        *[F.expr(f"sum(saved) FILTER (WHERE depth >= block * {WIDTH} + {j}) AS s{j}") for j in SLOTS], F.sum("leaf").alias("leaf"))
    sums = [f"s{j}" for j in SLOTS]
    filled = materialize(
        cut.select("conv_id", "block", "b1", "b2", *[f"t{j}" for j in SLOTS]).join(booked, ["conv_id", "block"], "left").fillna(
            0, [*sums, "leaf"]))
    later = _over_blocks(filled, {"_saved": "s1", "_leaf": "leaf"}, "sum", later=True)
    nodes = _rolled_up(later, ", ".join(f"sum({s} + _saved) AS {s}" for s in sums) + ", sum(leaf + _leaf) AS n_leaves")
    return nodes.selectExpr(*NODE, "n_leaves", f"CASE level WHEN 0 THEN s1 ELSE {_by_level('s')} END AS saved_tokens")


def trie(rebuilt: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``conv_id`` is the smallest member and ``parent_conv_id`` that of the parent,
    null for the root. ``saved_tokens`` sums (n_convs - 1) times the words of the
    last text over the subtree.
    """
    cut = blocks(rebuilt, convs)
    ends = _ends(cut, convs)
    nothing = hashlib.sha256().hexdigest()
    nodes = materialize(_members(cut).join(ends, NODE, "left").withColumns({
        "ends_sha256": F.coalesce("ends_sha256", F.lit(nothing)),
        "leaf": F.when(F.col("n_ends") == F.col("n_convs"), 1).otherwise(0).cast("long"),
        "saved": (F.col("n_convs") - 1) * F.col("words"),
    }))
    children = nodes.filter("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")
    ).agg(F.count("*").alias("n_children"))
    whole = materialize(nodes.join(children, NODE, "left").join(_below(cut, nodes), NODE).withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))))
    parents = whole.filter("n_children > 0").select(
        F.col("depth").alias("_above"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
        F.col("conv_id").alias("parent_conv_id"), "n_children")
    wanted = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below = whole.filter("depth > 0").withColumnRenamed("n_children", "_children").withColumn("_above", F.col("depth") - 1)
    joined = skew.join_per_key(below, parents, ["_above", "p1", "p2"], "n_children").withColumnRenamed("_children", "n_children")
    root = whole.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return joined.select(*wanted).unionByName(root.select(*wanted))
