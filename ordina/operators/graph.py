"""Reachability by frontier rounds, and what counted references keep alive without a root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordina.plans.scratch import discard, materialise


def reachable(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """id of every vertex reachable from the roots (id) along edges (src, dst), roots included.

    Each round joins the new vertices with the edges; found ones and the frontier
    are tables in the shared folder, so plans stay short and a lost executor costs
    a round at most.
    """
    frontier = materialise(roots.select("id").where("id is not null").distinct(), "frontier")
    found = frontier
    while not frontier.isEmpty():
        step = frontier.join(edges, frontier["id"] == edges["src"]).select(F.col("dst").alias("id")).where("id is not null").distinct()
        new = materialise(step.join(found, "id", "left_anti"), "frontier")
        if new.isEmpty():
            break
        grown = materialise(found.unionAll(new), "found")
        discard(found, *([frontier] if frontier is not found else []))
        found, frontier = grown, new
    return found


def leaked(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices (id, strong, weak) that are alive but that no root reaches.

    Dead ones (no references at all) don't count.  A root has more strong
    references than weak ones.
    """
    alive = vertices.where("strong > 0 or weak > 0").dropDuplicates(["id"])
    marked = reachable(alive.where("strong > weak").select("id"), edges)
    return alive.where("strong > 0").join(marked, "id", "left_anti").select("id")
