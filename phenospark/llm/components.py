"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.llm.common import written


def components(edges: DataFrame, folder: str) -> DataFrame:
    """``id, component`` (smallest id) of every id in ``edges`` (``a``, ``b``, any order).

    Each round hooks every id to the smallest label around it and then follows
    labels once more, so paths halve; a hub's edges are spread over tasks because
    minima are taken before the shuffle.  Each round is a written table.  Rounds
    end when no label changes."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), folder, "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
                     .select("id", F.least("id", "m").alias("label")), folder, "labels-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("new"))
        # the label's own label: what it hooks to, if it is an id of the table
        far = hooked.select(F.col("id").alias("new"), F.col("new").alias("far"))
        jumped = hooked.join(far, "new", "left").select("id", F.least("new", F.coalesce("far", "new")).alias("label"),
                                                        (F.col("label") != F.least("new", F.coalesce("far", "new"))).alias("changed"))
        table = written(jumped, folder, f"labels-{step}")
        labels = table.select("id", "label")
        if not table.filter("changed").limit(1).count():
            return labels.select("id", F.col("label").alias("component"))
