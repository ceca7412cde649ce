"""Connected components of a link table.

Parts of HELD links at most are first contracted to stars within a task each. Where there is more than
one part, alternating large and small stars join the parts' stars until nothing changes; a component
that spans p parts takes some log2(p) rounds.

Defined cases: links with a null end and links of a node to itself are left out; repeated links count
once; an empty table gives an empty result; of equal nodes there is one, so roots have no ties.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minnow.llm.cluster import ship, stored

#: Links that one task contracts.
HELD = 1 << 20


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (v, u) of a part as links of each node to the least node of its component there."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    ends = pa.chunked_array([*table.column("v").chunks, *table.column("u").chunks]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(ends.dictionary)
    nodes, rank = ends.dictionary.take(order), np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    v, u = np.split(rank[ends.indices.to_numpy()], 2)
    root = np.arange(len(nodes))
    while True:  # the least root over each link, then pointers to pointers
        low = np.minimum(root[v], root[u])
        new = root.copy()
        for x in (v, u, root[v], root[u]):
            np.minimum.at(new, x, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(root != np.arange(len(nodes)))
    for k in range(0, len(at), 1 << 16):
        mine = at[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(mine)), nodes.take(pa.array(root[mine]))], ["v", "u"])


def components(links: DataFrame) -> DataFrame:
    """node, root of every node of links (a, b); root is the least node of its component."""
    ship(links.sparkSession)
    edges = stored(links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    parts = max(1, math.ceil(edges.count() / HELD))
    edges = stored(edges.repartition(parts).mapInArrow(stars, edges.schema))
    before = None
    while parts > 1:
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy(F.col("v").alias("node")).agg(F.least(F.min("u"), F.col("node")).alias("m"))
        # Large star: neighbours above a node go to the least of its neighbourhood.
        large = edges.join(least, edges["u"] == least["node"]).select(edges["v"], F.col("m").alias("u")).filter("v <> u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        # Small star: neighbours below a node, and the node itself, go to the least of them.
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u").union(low.select("v", F.col("m").alias("u")))
        edges = stored(small.distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u")), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(edges.select(F.col("u"), F.col("u")).distinct())
