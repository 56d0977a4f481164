"""Connected components of an edge table, by DataFrame rounds; of a small one on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

SMALL = 1 << 16  # edges whose ends are long: so many go to the driver (16 bytes each), as rounds over them are all overhead


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root of each of n nodes under the edges a-b, the smallest node that they lead to."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return root


def _on_driver(edges: DataFrame) -> DataFrame:
    ends = edges.toArrow()
    ids, at = np.unique(np.concatenate([ends["u"].to_numpy(), ends["v"].to_numpy()]), return_inverse=True)
    a, b = at.reshape(2, -1)
    made = pa.table({"node": pa.array(ids, type=pa.int64()), "component": pa.array(ids[forest(len(ids), a, b)], type=pa.int64())})
    return store.materialise(edges.sparkSession.createDataFrame(made, "node long, component long"), "components")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of edges; component is its smallest node.

    Each round every node takes the smallest label among its neighbours and
    then its label's own label, so a path of n nodes needs about log n rounds.
    A node's neighbours meet only in a minimum, which is taken before and after
    the exchange, and a hub's edges are joined to one row that holds its label,
    a join whose large partitions Spark may split.  Each round's labels are
    written to the shared folder.

    Edges with a null end are left out; loops and repeated edges change nothing;
    no edges give no rows.  Edges with long ends should be in files, as they are
    counted first.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    if {t for _, t in e.dtypes} == {"bigint"} and e.count() <= SMALL:
        return _on_driver(e)
    both = store.materialise(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = store.materialise(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("v"), "label"), "v")
        near = seen.groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        hop = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        step = step.join(hop, "next", "left").select("node", F.col("label").alias("old"), F.least("next", F.coalesce("far", "next")).alias("label"))
        step = store.materialise(step, "labels")
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
