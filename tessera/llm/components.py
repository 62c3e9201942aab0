"""Connected components of a membership table, by local contraction and joins.

Input rows say that ``node`` belongs to ``grp``; nodes that share a group are
connected.  First each task contracts what it has: a union-find over a bounded
number of rows turns any tangle into stars, without a shuffle and then once
more with each group's rows together.  Then each round gives every group the
least label of its nodes, every node the least label of its groups, and the
label of its label, so the number of rounds follows the logarithm of what
diameter is left.  Group labels are minima with partial aggregation, so a group
that holds a third of all nodes costs each task one row.  Labels are written to
the shared folder each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import durable, release, shuffle_width

#: Rows that a task contracts at once.
CHUNK = 400_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Memberships -> stars: nodes belong to the least node of their tangle, so do groups by that node."""
    root: dict[int, int] = {}
    first: dict[str, int] = {}
    seen = 0

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def flush() -> pa.RecordBatch:
        ends = [find(x) for x in root]
        groups = [f"d{r}" for r in ends] + list(first)
        nodes = list(root) + [find(x) for x in first.values()]
        root.clear()
        first.clear()
        return pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(nodes, pa.int64())], ["grp", "node"])

    for batch in batches:
        for grp, node in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root.setdefault(node, node)
            a, b = find(first.setdefault(grp, node)), find(node)
            if a != b:
                root[max(a, b)] = min(a, b)
        seen += batch.num_rows
        if seen >= CHUNK:
            yield flush()
            seen = 0
    if root:
        yield flush()


def components(members: DataFrame) -> DataFrame:
    """``members(grp string, node long)`` -> ``(node, comp)``: the least node within reach.

    Groups are named apart from ``d<node>`` unless they mean that node's own group.
    """
    schema = "grp string, node long"
    local = members.select("grp", "node").mapInArrow(_contract, schema).distinct()
    met = local.repartition(shuffle_width(members.sparkSession), "grp").mapInArrow(_contract, schema).distinct()
    members = durable(met, "members")
    labels = durable(members.groupBy("node").agg(F.min("node").alias("comp")), "labels")
    while True:
        groups = members.join(labels, "node").groupBy("grp").agg(F.min("comp").alias("low"))
        near = members.join(groups, "grp").groupBy("node").agg(F.min("low").alias("low"))
        step = labels.withColumnRenamed("comp", "old").join(near, "node")
        jumped = step.alias("a").join(labels.select(F.col("node").alias("low"), F.col("comp").alias("root")), "low", "left")
        new = durable(jumped.select("node", "old", F.least("low", F.coalesce("root", "low")).alias("comp")), "labels")
        changed = not new.where("comp < old").isEmpty()
        release(labels)
        labels = new.select("node", "comp")
        labels._tessera_path = new._tessera_path
        if not changed:
            release(members)
            return labels
