"""Connected components by alternating large-star and small-star rounds.

Each round sends a node's edges to the smallest node it knows (Kiveris et al.,
SoCC 2014). The minimum of a neighbourhood is a partial aggregate, so a hub
that holds a third of all edges is summed up before the shuffle, and the join
that brings the minimum back is one that adaptive execution can split.

A graph of at most ``ONE_TASK`` edges, 16 MB of long ids, is solved whole by one
task instead; rounds over it would cost many small stages. Both give the same
components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from kinweave.sources.scratch import drop_scratch, scratch_table

ONE_TASK = 1 << 20


def smallest_reachable(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 to n - 1 the smallest one that it reaches.

    Roots are hooked to the smallest root across an edge, then paths are
    shortened until every node points to its root.
    """
    root = np.arange(n)
    while len(src):
        low, high = np.minimum(root[src], root[dst]), np.maximum(root[src], root[dst])
        apart = low != high
        src, dst = src[apart], dst[apart]
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(further := root[root], root):
            root = further
    return root


def _in_one_task(edges: DataFrame) -> DataFrame:
    """``node, component`` of a small graph; edges aren't null."""
    kind = edges.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        ends = pa.chunked_array([b.column(end) for end in (0, 1) for b in got]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(ends.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        src, dst = place[ends.indices.to_numpy()].reshape(2, -1)
        node = ends.dictionary.take(order)
        yield pa.RecordBatch.from_arrays([node, node.take(pa.array(smallest_reachable(src, dst, len(order))))], ["node", "component"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
    return both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("low"))
    moved = down.join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.union(least.select("src", F.col("low").alias("dst"))).where("src <> dst").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node on an edge; component = smallest node.

    Edges are undirected; null ends and self-loops are ignored; repeated edges
    count once. An empty edge table gives an empty result. Lineage is cut before
    the first round and after each with a table in the shared folder.
    """
    now = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    now = scratch_table(now, "cc")
    kinds = {kind for _, kind in now.dtypes}
    if len(kinds) == 1 and kinds < {"int", "bigint", "string"} and now.count() <= ONE_TASK:
        return _in_one_task(now)
    seen = None
    for _ in range(max_rounds):
        after = scratch_table(_small_star(_large_star(now)), "cc")
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        drop_scratch(now.sparkSession, now)
        now = after
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = now.select(F.col("dst").alias("node")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots.select("node", F.col("node").alias("component")))
