"""Prefix trie of conversations in minimal-perfect-hash node tables.

A node is a distinct sequence of first turns (role and text); the root has none. ``conversation_paths`` numbers the turns of
every conversation and digests them, ``with_shared_openings`` puts the first turns of one conversation of a family in front of
the others, and ``prefix_trie`` describes every node.

A prefix is known by a 120-bit digest: the digests of its turns, each mixed with its place, are summed up, so that a very long
conversation is summed up in segments that any task may take. Segments are dealt out evenly to shards. A shard enumerates its
distinct prefixes and gives them slots by a minimal perfect hash that keeps the keys and so refuses strange ones; counts are
scattered into flat arrays by slot, and what belongs to subtrees is carried up through the array of parent slots, deepest
nodes first. Every node is credited to the smallest conversation that holds it, so the sums of shards add up to those of
the tree, however many conversations share a prefix; what is credited in later segments of a conversation comes in at the
end of the segment before.

Defined results: rows without a conversation id take no part. Turns without a number come first; turns of equal number are
ordered by role and then by their digest. A null role or text is empty. Repeated rows are turns of their own. An empty table
gives no nodes, not even a root. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secret_audit.llm.spark_tools import quoted, stored
from secret_audit.llm.textkit import mix

#: Turns in a segment of a conversation, and rows in a shard.
SEGMENT, SHARD_ROWS = 1024, 1 << 17
#: A parent with more children than one in so many nodes (and at least as many) is joined by broadcast: at most this number of rows.
HOT_PARENTS = 1000
_LANE = 40
#: A word is a run of anything but blanks and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


# paths


def _lanes(digest: Column) -> list[Column]:
    """Three numbers of 40 bits from a hexadecimal digest."""
    return [F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 10).cast("long") for i in range(3)]


def conversation_paths(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """_conv, _depth, _turn (digest of role and text) and _words of every turn, and a row of depth 0 for each conversation.

    Turns are numbered without a window over a conversation: rows are sorted in ranges, and each range of a conversation
    is shifted by the sizes of those before it.
    """
    c = lambda name: F.col(quoted(name))
    role_text, said = (F.coalesce(c(x).cast("string"), F.lit("")) for x in (role, text))
    rows = df.where(c(conversation).isNotNull()).select(
        c(conversation).cast("long").alias("_conv"), c(turn).alias("_order"), role_text.alias("_role"),
        F.sha2(F.concat(F.length(role_text).cast("string"), F.lit(":"), role_text, said), 256).alias("_turn"),
        F.regexp_count(said, F.lit(WORD)).cast("long").alias("_words"),
    )
    order = ["_conv", F.col("_order").asc_nulls_first(), "_role", "_turn"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = stored(ranged.drop("_order", "_role"), "turns")
    inside = ranged.withColumn("_range", F.shiftright("_id", 33)).withColumn("_id", F.col("_id").bitwiseAND((1 << 33) - 1))
    sizes = inside.groupBy("_conv", "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_conv").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_conv", "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    turns = inside.join(shift, ["_conv", "_range"]).select("_conv", (F.col("_id") + F.col("_shift")).alias("_depth"), "_turn", "_words")
    roots = sizes.where(F.col("_first").isNotNull()).select("_conv").distinct()
    return turns.unionByName(roots.select("_conv", F.lit(0).cast("long").alias("_depth"), F.lit("").alias("_turn"), F.lit(0).cast("long").alias("_words")))


def with_shared_openings(paths: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Paths in which every conversation c opens with turns of c - c % family.

    Its first h turns, h being the CRC-32 of c modulo ``most``, make room for the first h turns (all, if fewer) of that one.
    """
    paths = stored(paths, "paths")
    h = F.crc32(F.col("_conv").cast("string").cast("binary")) % most
    base = F.col("_conv") - F.col("_conv") % family
    opening = paths.where(F.col("_depth").between(1, most - 1)).groupBy(F.col("_conv").alias("_base"))
    opening = opening.agg(F.sort_array(F.collect_list(F.struct("_depth", "_turn", "_words"))).alias("_opening"))
    roots = paths.where("_depth = 0").withColumn("_base", base).join(opening, "_base", "left").withColumn("_h", h)
    taken = F.slice("_opening", 1, F.greatest(F.col("_h"), F.lit(0)).cast("int"))
    openings = roots.select("_conv", F.inline(F.when(F.col("_h") > 0, taken))).select(*paths.columns)
    # What follows moves up where the opening is shorter than the turns that it replaces.
    short = roots.select("_conv", (F.col("_h") - F.least(F.col("_h"), F.greatest(F.size("_opening"), F.lit(0)))).alias("_less"))
    rest = paths.where((F.col("_depth") == 0) | (F.col("_depth") > h)).join(short.where("_less > 0"), "_conv", "left")
    moved = F.when(F.col("_depth") > 0, F.col("_depth") - F.coalesce("_less", F.lit(0))).otherwise(F.col("_depth"))
    return openings.unionByName(rest.withColumn("_depth", moved).select(*paths.columns))


def prefixes(paths: DataFrame) -> DataFrame:
    """Key (two numbers, 120 bits) of each prefix and of its parent, with conversation, depth, segment, words and a check number.

    ``_opens`` marks the first row of a segment, ``_final`` its last one, and ``_last`` the end of a conversation.
    """
    lanes = [F.pmod(F.xxhash64(F.lit(i), "_turn", "_depth"), F.lit(1 << _LANE)) for i in range(3)]
    own = [F.when(F.col("_depth") > 0, x).otherwise(0).alias(f"_x{i}") for i, x in enumerate(lanes)]
    rows = paths.select(
        "_conv", "_depth", F.floor(F.greatest(F.col("_depth") - 1, F.lit(0)) / SEGMENT).alias("_segment"), "_words",
        F.when(F.col("_depth") > 0, F.xxhash64(F.lit(9), "_turn")).otherwise(0).alias("_check"), *own,
    )
    x, wrap = [f"_x{i}" for i in range(3)], lambda c: F.pmod(c, F.lit(1 << _LANE))
    sums = rows.groupBy("_conv", "_segment").agg(*[wrap(F.sum(c)).alias(c) for c in x], F.max("_depth").alias("_end"))
    before = Window.partitionBy("_conv").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_conv").orderBy("_segment")
    carried = sums.select(
        "_conv", "_segment", "_end", F.lead("_end").over(after).isNull().alias("_ends"),
        *[F.coalesce(wrap(F.sum(c).over(before)), F.lit(0)).alias(f"{c}c") for c in x],
    )
    inside = Window.partitionBy("_conv", "_segment").orderBy("_depth")
    rows = rows.join(carried, ["_conv", "_segment"]).select("*", *[wrap(F.sum(c).over(inside) + F.col(f"{c}c")).alias(f"{c}p") for c in x])
    parent = [wrap(F.col(f"{c}p") - F.col(c)) for c in x]
    key = lambda a, b, c: (
        F.shiftleft(a, 20).bitwiseOR(F.shiftright(b, 20)), F.shiftleft(b.bitwiseAND((1 << 20) - 1), _LANE).bitwiseOR(c),
    )
    k, p = key(*[F.col(f"{c}p") for c in x]), key(*parent)
    final = F.col("_depth") == F.col("_end")
    return rows.select(
        "_conv", "_depth", "_segment", "_words", "_check", k[0].alias("_ka"), k[1].alias("_kb"), p[0].alias("_pa"), p[1].alias("_pb"),
        (F.col("_depth") == F.col("_segment") * SEGMENT + F.when(F.col("_segment") > 0, 1).otherwise(0)).alias("_opens"),
        final.alias("_final"), (final & F.col("_ends")).alias("_last"),
    )


# shards


class SlotTable:
    """A minimal perfect hash over distinct keys of two numbers: n keys have the slots 0 to n - 1.

    On each level the keys left over hash into twice as many places; a key that is alone in its place is done, and its slot is
    the rank of the place. The keys are kept by slot, so that a key that isn't in the table is told from one that is.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        slots, left, done = np.zeros(len(a), np.int64), np.arange(len(a)), 0
        while len(left):
            at = self.place(a[left], b[left], len(self.levels), 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left)) == 1
            rank = np.cumsum(alone) - alone + done
            self.levels.append((alone, rank))
            placed = alone[at]
            slots[left[placed]] = rank[at[placed]]
            done, left = done + int(placed.sum()), left[~placed]
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        self.a[slots], self.b[slots] = a, b

    @staticmethod
    def place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(mix(a.astype(np.uint64) + np.uint64(level * 0x9E3779B9 + 1)) ^ b.astype(np.uint64)) % np.uint64(size)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that the table doesn't have."""
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (alone, rank) in enumerate(self.levels):
            at = self.place(a[left], b[left], level, len(alone))
            slot = rank[at[alone[at]]]
            hit = left[alone[at]]
            same = (self.a[slot] == a[hit]) & (self.b[slot] == b[hit])
            out[hit[same]] = slot[same]
            left = left[~alone[at]]
        return out


def distinct_keys(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    return a[first], b[first]


def _columns(part: pa.Table, names: list[str]) -> list[np.ndarray]:
    return [part.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in names]


def count_nodes(part: pa.Table) -> pa.Table:
    """Node table of a shard: members, smallest conversation, depth, words and parent of each prefix."""
    conv, depth, words, check, a, b, pa_, pb = _columns(part, ["_conv", "_depth", "_words", "_check", "_ka", "_kb", "_pa", "_pb"])
    table = SlotTable(*distinct_keys(a, b))
    slot, n = table.find(a, b), len(table.a)
    out = {"_conv": np.full(n, np.iinfo(np.int64).max)}
    np.minimum.at(out["_conv"], slot, conv)
    for name, values in (("_depth", depth), ("_words", words), ("_check", check), ("_pa", pa_), ("_pb", pb)):
        out[name] = np.zeros(n, np.int64)
        out[name][slot] = values
        if name != "_words" and (out[name][slot] != values).any():
            raise ValueError("two prefixes have the same digest")
    return pa.table({"_ka": table.a, "_kb": table.b, "_n": np.bincount(slot, minlength=n), **out})


def sum_subtrees(part: pa.Table) -> pa.Table:
    """What a shard adds to each of its prefixes and all that they begin: leaves and saved tokens."""
    names = ["_depth", "_opens", "_ka", "_kb", "_pa", "_pb", "_leaf", "_saved", "_leaf_later", "_saved_later"]
    depth, opens, a, b, pa_, pb, leaf, saved, leaf_later, saved_later = _columns(part, names)
    table = SlotTable(*distinct_keys(a, b))
    slot, n = table.find(a, b), len(table.a)
    level, parent = np.zeros(n, np.int64), np.zeros(n, np.int64)
    level[slot] = depth
    parent[slot] = np.where(opens, -1, table.find(pa_, pb))  # a segment is credited to those before it by its totals
    sums = np.zeros((2, n), np.int64)
    for own, more, total in ((leaf, leaf_later, sums[0]), (saved, saved_later, sums[1])):
        np.add.at(total, slot, own + more)
    order = np.argsort(-level, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(level[order]) != 0, [True]))) if n else [0]
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[s:e][parent[order[s:e]] >= 0]
        for total in sums:
            np.add.at(total, parent[own], total[own])
    return pa.table({"_ka": table.a, "_kb": table.b, "_leaves": sums[0], "_saved": sums[1]})


# ends


def _joined_ends(ends: DataFrame) -> DataFrame:
    """_ka, _kb, _ends: SHA-256 of the conversations that end in a node, ascending and joined by commas.

    Ranges of a node's conversations become pieces of text in tasks of their own; only the hash runs over the pieces in order.
    """
    order = ["_ka", "_kb", "_conv"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, conv = (batch.column(n).to_numpy() for n in order)
            cut = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True]))) if len(a) else np.zeros(1, np.int64)
            text, first = conv.astype(str).tolist(), cut[:-1]
            made = [",".join(text[s:e]) for s, e in zip(first.tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(conv[first]), pa.array(made, pa.string())], names=[*order, "_ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(*(batch.column(n).to_pylist() for n in ("_ka", "_kb", "_ids")), strict=True):
                if node != (a, b):
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(("_ka", "_kb", "_ends"), d, strict=True)) for d in done])
        if node:
            yield pa.RecordBatch.from_pylist([{"_ka": node[0], "_kb": node[1], "_ends": state.hexdigest()}])

    ranged = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    made = ranged.mapInArrow(pieces, "_ka long, _kb long, _conv long, _ids string")
    return made.repartition("_ka", "_kb").sortWithinPartitions(*order).mapInArrow(digests, "_ka long, _kb long, _ends string")


def _same(low: str, high: str) -> Column:
    return F.when(F.col(low) == F.col(high), F.col(low)).otherwise(F.raise_error(F.lit("two prefixes have the same digest")))


def prefix_trie(paths: DataFrame) -> DataFrame:
    """A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``saved_tokens`` sums up over the subtree what a cache of prefixes saves: the words of a node's last turn for every member
    but one.
    """
    key = ["_ka", "_kb"]
    rows = stored(prefixes(paths), "prefixes")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("_conv", "_segment"), F.lit(shards))
    counted = rows.withColumn("_shard", shard).groupBy("_shard").applyInArrow(
        count_nodes, "_ka long, _kb long, _n long, _conv long, _depth long, _words long, _check long, _pa long, _pb long"
    )
    same = ["_depth", "_words", "_check", "_pa", "_pb"]
    nodes = counted.groupBy(*key).agg(
        F.sum("_n").alias("_n"), F.min("_conv").alias("_conv"), *[F.min(c).alias(c) for c in same], *[F.max(c).alias(f"{c}_") for c in same]
    )
    nodes = stored(nodes.select(*key, "_n", "_conv", *[_same(c, f"{c}_").alias(c) for c in same]).drop("_check"), "nodes")
    children = nodes.where("_depth > 0").groupBy(F.col("_pa").alias("_ka"), F.col("_pb").alias("_kb")).agg(F.count("*").alias("_children"))
    nodes = stored(nodes.join(children, key, "left").fillna(0, ["_children"]), "nodes")
    # A node is credited to its smallest conversation, which is at the node's depth there.
    credit = nodes.select(
        "_conv", "_depth", (F.col("_children") == 0).cast("long").alias("_leaf"), ((F.col("_n") - 1) * F.col("_words")).alias("_saved")
    )
    credited = rows.join(credit, ["_conv", "_depth"], "left").fillna(0, ["_leaf", "_saved"])
    later = Window.partitionBy("_conv").orderBy("_segment").rowsBetween(1, Window.unboundedFollowing)
    totals = credit.groupBy("_conv", F.floor(F.greatest(F.col("_depth") - 1, F.lit(0)) / SEGMENT).alias("_segment"))
    totals = totals.agg(F.sum("_leaf").alias("_leaf"), F.sum("_saved").alias("_saved"))
    segments = rows.where("_final").select("_conv", "_segment", "_depth").join(totals, ["_conv", "_segment"], "left")
    from_later = segments.select("_conv", "_depth", F.sum("_leaf").over(later).alias("_leaf_later"), F.sum("_saved").over(later).alias("_saved_later"))
    from_later = from_later.where("_leaf_later > 0 OR _saved_later > 0")
    credited = credited.join(from_later, ["_conv", "_depth"], "left").fillna(0, ["_leaf_later", "_saved_later"])
    summed = credited.withColumn("_shard", shard).groupBy("_shard").applyInArrow(sum_subtrees, "_ka long, _kb long, _leaves long, _saved long")
    summed = summed.groupBy(*key).agg(F.sum("_leaves").alias("n_leaves"), F.sum("_saved").alias("saved_tokens"))
    ends = _joined_ends(rows.where("_last"))
    hot = max(HOT_PARENTS, nodes.count() // HOT_PARENTS)
    parents = nodes.where("_children > 0").select(F.col("_ka").alias("_pa"), F.col("_kb").alias("_pb"), F.col("_conv").alias("_parent"), "_children")
    many = F.broadcast(parents.where(F.col("_children") > hot).select("_pa", "_pb", F.col("_parent").alias("_hot")))
    few = parents.where(F.col("_children") <= hot).drop("_children")
    placed = nodes.join(many, ["_pa", "_pb"], "left")
    found = placed.where(F.col("_hot").isNotNull() | (F.col("_depth") == 0)).withColumn("_parent", F.col("_hot"))
    found = found.unionByName(placed.where(F.col("_hot").isNull() & (F.col("_depth") > 0)).join(few, ["_pa", "_pb"]).select(*found.columns))
    out = found.join(summed, key, "left").join(ends, key, "left")
    return out.select(
        F.col("_conv").alias("conv_id"), F.col("_depth").alias("depth"), F.when(F.col("_depth") > 0, F.col("_parent")).alias("parent_conv_id"),
        F.col("_n").alias("n_convs"), F.col("_children").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("_ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
