"""Paths in a hierarchy stored as parent ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.sources.store import staged, work_folder


def hierarchy_paths(
    nodes: DataFrame,
    id: str = "id",
    name: str = "name",
    parent: str = "parentId",
    root_prefix: str = "r-",
) -> DataFrame:
    """``(id, name, path, depth)`` of every node reachable from a root.

    Nodes whose parent id starts with ``root_prefix`` are at the top and have the
    path ``/<name>``. Every node carries the path up to some ancestor, at first
    itself, and a round joins it to that ancestor's own path, so the length doubles:
    a tree of any depth takes a number of rounds logarithmic in it. Rounds end when
    one completes no further path; nodes on a cycle or below a missing parent never
    get one. Only unfinished nodes are joined again. In the join an ancestor has one
    row, while its very many descendants lie on the other side, which Spark
    can split.
    """
    folder = work_folder(nodes.sparkSession)
    steps = staged(
        nodes.select(
            F.col(id).alias("id"),
            F.col(name).alias("name"),
            F.col(parent).alias("up"),
            F.concat(F.lit("/"), F.col(name)).alias("path"),
            F.lit(1).alias("depth"),
        ),
        folder,
    )
    at_root = F.coalesce(F.col("up").startswith(root_prefix), F.lit(False))
    finished, open_ = steps.filter(at_root), steps.filter(~at_root)
    newest = finished
    while not newest.isEmpty():
        above = finished.unionByName(open_).select(
            F.col("id").alias("up"),
            F.col("up").alias("_up"),
            F.col("path").alias("_path"),
            F.col("depth").alias("_depth"),
        )
        longer = staged(
            open_.join(above, "up").select(
                "id",
                "name",
                F.col("_up").alias("up"),
                F.concat("_path", "path").alias("path"),
                (F.col("depth") + F.col("_depth")).alias("depth"),
            ),
            folder,
        )
        newest, open_ = longer.filter(at_root), longer.filter(~at_root)
        finished = finished.unionByName(newest)
    return finished.select("id", "name", "path", "depth")
