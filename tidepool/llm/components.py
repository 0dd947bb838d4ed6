"""Connected components of a graph of links, by contraction.

In each round every node takes the smallest node among itself and its neighbours, and that node's own choice; links are
then drawn between what was chosen. Rounds go on until no link is left. All of it is joins and aggregates: no
neighbourhood is gathered anywhere, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.scratch import cut


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b): nodes share a root if and only if links lead from one to the other.

    Self links and repeated links change nothing; an empty table gives an empty table.
    """
    links = cut(links.select("a", "b").where("a <> b"), "links")
    steps: list[DataFrame] = []
    for _ in range(rounds):
        if links.isEmpty():
            break
        both = links.union(links.select("b", "a"))
        # a scrambled order keeps long chains of ascending nodes from taking a round for each node
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("n"))).alias("m"))
        mine = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("n"))
        choice = least.select("node", F.least(mine, F.col("m")).getField("n").alias("to"))
        choice = cut(choice, "choice")
        onward = choice.select(F.col("node").alias("to"), F.col("to").alias("onward"))
        step = cut(choice.join(onward, "to").select("node", F.col("onward").alias("to")), "step")
        steps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = links.join(left, "a").join(right, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        links = cut(moved.where("a <> b").distinct(), "links")
    else:
        raise RuntimeError(f"links remain after {rounds} rounds")
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0].withColumnRenamed("to", "root")
    for step in steps[1:]:
        onward = step.select(F.col("node").alias("root"), "to")
        out = out.join(onward, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out
