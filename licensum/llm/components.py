"""Connected components of a distributed edge list."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from licensum.llm.common import stored


def connected(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that can be reached.

    Large-star and small-star rounds: each hangs the neighbours of a node below the smallest of them, and the number
    of edges never grows. They end when a round changes nothing. A node with very many neighbours is the hot side of a
    join with one row per node, which Spark splits.
    """
    edges = stored(edges.filter("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    seen = _digest(edges)
    for _ in range(rounds):
        both = edges.unionAll(edges.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
        large = both.join(least, "a").filter("b > a AND b <> m").selectExpr("b AS a", "m AS b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").selectExpr("explode(array(struct(b AS a, m AS b), struct(a AS a, m AS b))) AS e").selectExpr("e.a", "e.b").filter("a <> b").distinct()
        edges = stored(small)
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")

    return edges.selectExpr("a AS node", "b AS root").unionAll(edges.selectExpr("b AS node", "b AS root").distinct())


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.selectExpr("count(*)", "bit_xor(xxhash64(a, b))").first())
