"""Connected components of a link table that never leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common

#: Links that one task reduces to a forest.
FOREST_LINKS = 400_000
#: Rows from which on the keys of a join are counted, and of a key that is hot then.
HOT_ROWS = 1_000_000


def by_label(rows: DataFrame, n: int, values: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows(comp, ...), n of them, joined with values(comp, ...), which has at most one row for each comp.

    Hot comps, such as a giant component's, are at most n / hot_rows; their values are broadcast if that is few, so
    that their rows stay where they are and no task gets a whole component.
    """
    if n <= hot_rows:
        return rows.join(values, "comp")
    hot = common.written(rows.groupBy("comp").count().where(F.col("count") > hot_rows).select("comp"), "cc-hot")
    few = hot.count()
    if not 0 < few <= common.BROADCAST_ROWS:
        common.drop_written(hot)
        return rows.join(values, "comp")
    own = values.join(F.broadcast(hot), "comp", "left_semi")
    return rows.join(F.broadcast(own), "comp").unionByName(rows.join(F.broadcast(hot), "comp", "left_anti").join(values, "comp"))


def forest(edges: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same nodes: of every task's links one for each node at most, to the smallest node it reaches there."""

    def reduce(batches):
        import pyarrow as pa

        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := up.setdefault(x, x)) != x:
                up[x] = up[p]
                x = p
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
        rows = [(x, r) for x in list(up) if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], names=["a", "b"])

    parts = max(1, -(-edges.count() // FOREST_LINKS))
    common.small_batches(edges.sparkSession)
    return edges.coalesce(parts).mapInArrow(reduce, "a long, b long")


def connected_components(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Written table node, comp (the smallest node reachable) of edges(a long, b long); loops and repeats do no harm.

    Links are first reduced to forests, task by task. Each round takes the smallest label among the neighbours and then the label's own label, so the distance to the
    smallest node at least halves; rounds end when no label falls. Every round's labels are a written table.
    """
    links = forest(edges.select("a", "b").where("a <> b"))
    sym = common.written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-links")
    labels = common.written(sym.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp"), F.lit(True).alias("moved")), "cc-labels")
    n = labels.count()
    while not labels.where("moved").isEmpty():
        seen = labels.select(F.col("node").alias("b"), F.col("comp").alias("c"))
        near = sym.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("m"))
        own = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("c"))
        new = by_label(own, n, up, hot_rows).select("node", F.least("comp", "c").alias("comp"), (F.least("comp", "c") < F.col("old")).alias("moved"))
        after = common.written(new, "cc-labels")
        common.drop_written(labels)
        labels = after
    common.drop_written(sym)
    return labels
