"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.staging import stage


#: Links between whole numbers that one task joins at once; more are joined in rounds.
FEW_LINKS = 1 << 18


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links ``(a, b)`` and the smallest node of its component."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        differ = p != q
        if not differ.any():
            return nodes, nodes[label]
        np.minimum.at(label, np.maximum(p, q)[differ], np.minimum(p, q)[differ])
        while (label[label] != label).any():
            label = label[label]


def _at_once(links: DataFrame) -> DataFrame:
    kind = links.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            both = pa.Table.from_batches(held)
            found = local_components(both["a"].to_numpy(), both["b"].to_numpy())
            for i in range(0, len(found[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)], both.schema.field("a").type) for x in found], ["node", "root"])

    return links.select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"] or 0


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Label every node that has a link: ``(node, root)``, root being the component's smallest node.

    ``edges`` holds undirected links in two columns of one orderable type; direction,
    repeats, self-links and rows with a null do not matter. An empty table gives an
    empty result. Each round keeps at most two rows a link, takes minima with map-side
    combining, and joins them back on the node, which AQE splits where a node is hot;
    no group is ever collected. Rounds are staged in the shared folder. Where few links are left (a fixed
    number), one task joins them all instead of further rounds, each of which is several jobs.
    """
    start = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
    current = stage(start.where("a is not null and b is not null and a <> b").distinct(), "links")
    before = _state(current)
    whole = current.schema["a"].dataType.simpleString() in ("bigint", "int")
    while before[0]:
        if whole and before[0] <= FEW_LINKS:
            return _at_once(current)
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = stage(moved.unionByName(low.withColumnRenamed("m", "b")).distinct(), "links")
        now = _state(current)
        if now == before:
            break
        before = now
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
