"""Connected components of a link table, by minimum labels and pointer jumping on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b); the label is the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours, then follows labels once (label of the label),
    so long chains shorten by powers of two. Rows with a null end and self-links are ignored; repeats do no harm. An
    empty table gives an empty table. Rounds are written to the checkpoint folder; only counts reach the driver.
    """
    links = links.filter("a <> b").select("a", "b")
    both = stored(links.union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a").agg(F.min("label").alias("near"))
        )
        pulled = (
            labels.join(near, labels["node"] == near["a"])
            .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        )
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("upper"))
        nxt = pulled.join(up, pulled["label"] == up["up"], "left").select(
            "node", "old", F.least("label", F.coalesce("upper", "label")).alias("label")
        )
        nxt = stored(nxt, "labels")
        changed = nxt.filter("label <> old").limit(1).count()
        labels = nxt.select("node", "label")
        if not changed:
            return labels
