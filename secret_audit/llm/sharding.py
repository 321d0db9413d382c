"""Shards by a hierarchical weighted hash tree.

A topology is a tree of regions, racks and shards with weights, kept as a list of growth steps: each step is a tree of its
own over the shards it added. A row descends from the top: the regions of all steps draw for it (a hashed exponential
number, divided by the weight below that node), the smallest draw wins, then the racks of that region and step, then the
shards of that rack. Each node's share is its weight. A further step only adds nodes to the first draw, so rows move only
into the shards that it adds; a changed weight moves rows only into or out of the subtree that holds it.

``assign_shards`` keeps the law ``key``: the row's id and the topology decide. Slots number the rows of a shard without gaps;
they are counted within each input partition and shifted by the partitions before, so no shard is sorted as a whole.

Defined results: a null text has no bytes and the checksum of an empty text. A null id is a key like any other. Repeated rows
get the same shard and slots of their own. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secret_audit.llm.spark_tools import stored

_SPAN = 1 << 53


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree; shards of one step were added together."""

    number: int
    region: str
    rack: str
    weight: float = 1.0
    step: int = 0


@dataclass(frozen=True)
class Topology:
    shards: tuple[Shard, ...]

    def grown(self, region: str, rack: str, weight: float = 1.0) -> Topology:
        """One more shard, as a step of its own."""
        new = Shard(max((s.number for s in self.shards), default=-1) + 1, region, rack, weight, max((s.step for s in self.shards), default=-1) + 1)
        return Topology((*self.shards, new))

    def reweighted(self, number: int, weight: float) -> Topology:
        """Another weight for one shard."""
        return Topology(tuple(replace(s, weight=weight) if s.number == number else s for s in self.shards))

    def children(self) -> dict[str, list[tuple[str, float]]]:
        """Names and weights of the nodes below each node; the top has the empty name, a shard's node ends in its number."""
        weight: dict[str, float] = defaultdict(float)
        below: dict[str, list[str]] = defaultdict(list)
        for s in self.shards:
            if s.weight <= 0:
                continue
            region = f"{s.step}/{s.region}"
            path = ["", region, f"{region}/{s.rack}", f"{region}/{s.rack}/{s.number}"]
            for parent, node in zip(path, path[1:], strict=False):
                weight[node] += s.weight
                if node not in below[parent]:
                    below[parent].append(node)
        return {parent: [(n, weight[n]) for n in nodes] for parent, nodes in below.items()}


def even_topology(shards: int, regions: int = 4, racks: int = 5) -> Topology:
    """Equal shards dealt over regions and racks."""
    return Topology(tuple(Shard(n, f"region{n % regions}", f"rack{n // regions % racks}") for n in range(shards)))


def _winner(key: Column, nodes: Column) -> Column:
    def draw(node: Column) -> Column:
        part = (F.pmod(F.xxhash64(key, node["name"]), F.lit(_SPAN)) + 0.5) / float(_SPAN)
        return F.struct((-F.log(part) / node["weight"]).alias("draw"), node["name"].alias("name"))

    return F.array_min(F.transform(nodes, draw))["name"]


def shard_of(key: Column, topology: Topology) -> Column:
    """Number of the shard that a row with this key belongs to."""
    tree = topology.children()

    def nodes(parent: str) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in tree[parent]])

    inner = F.create_map(*[x for parent in tree if parent for x in (F.lit(parent), nodes(parent))])
    node = _winner(key, nodes(""))
    for _ in range(2):
        node = _winner(key, F.element_at(inner, node))
    return F.substring_index(node, "/", -1).cast("int")


def assign_shards(
    df: DataFrame, topology: Topology, grown: Topology | None = None, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null without a grown topology) of every row."""
    key, body = F.col(f"`{id_column}`"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.select(
        key.alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), shard_of(key, topology).alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
        F.monotonically_increasing_id().alias("_row"),
    ).withColumn("_part", F.shiftright("_row", 33))
    rows = stored(rows, "sharded")
    counts = rows.groupBy("shard", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("shard", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift"))
    place = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_row")) - 1
    numbered = rows.withColumn("_place", place).join(shifts, ["shard", "_part"])
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("_shift") + F.col("_place")).cast("long").alias("slot"), "grown_shard")
