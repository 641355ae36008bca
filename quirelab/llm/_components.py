"""Connected components from links that point to smaller ids, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Workspace


def flatten_parents(ws: Workspace, parents: DataFrame) -> DataFrame:
    """(id, root) from (id, parent) with parent < id: every chain of parents followed to its end.

    Each round doubles the length that is followed. Both sides of the join are stored tables, so Spark may split the
    part of a parent that has very many children.
    """
    now = ws.save(parents.select("id", F.col("parent").alias("root")), "roots")
    while True:
        up = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        jumped = ws.save(now.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not jumped.filter("moved").isEmpty()
        ws.drop(now)
        now = jumped.select("id", "root")
        now._quire_path = jumped._quire_path
        if not moved:
            return now


def relabel(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct links between the components of the ends of (a, b), larger first."""
    for c in ("a", "b"):
        r = roots.select(F.col("id").alias(c), F.col("root").alias(f"_{c}"))
        pairs = pairs.join(r, c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def components(ws: Workspace, links: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each id of the links (a, b) reaches. Ids that are their own root are left out.

    Each round hooks every component to its smallest neighbour, follows the hooks, and draws the links anew between the
    components that result, until none is left.
    """
    left = ws.save(relabel(links, links.sparkSession.createDataFrame([], "id long, root long")), "links")
    total = None
    while not left.isEmpty():
        parents = left.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("parent"))
        roots = flatten_parents(ws, parents)
        if total is None:
            total = roots
        else:
            r = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
            old = total.join(r, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
            total = ws.save(old.unionByName(roots), "components")
        nxt = ws.save(relabel(left, roots), "links")
        ws.drop(left)
        left = nxt
    return total if total is not None else links.sparkSession.createDataFrame([], "id long, root long")
