"""Transitive closure of relations whose pairs are far more than their edges.

A graph with a large cycle has about as many pairs as the square of its nodes, nearly all of them through any one node
of the cycle. So pairs are not derived one by one: hubs are chosen, what reaches a hub and what it reaches are two lists,
and the pairs through it are their product, which is written out at the end only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import materialize

#: Rounds of hubs, at most; each is a bit of a node's masks.
PHASES = 16
#: Up to so many paths of two edges the semi-naive join is the shorter way.
PATHS = 1_000
#: Nodes of a list that go together, about; a product of two such lists is one row until it is written out.
BLOCK = 512
#: Pairs that a task writes out, about.
PAIRS = 10_000_000


def closure(edges: DataFrame) -> DataFrame:
    """All pairs predicate, a, b such that a path of edges predicate, a, b leads from a to b, each once.

    In a phase every weakly connected component gets one hub, the node with the most paths of two edges through it. Pairs
    through it are the product of its ancestors and descendants. A pair that is in no product has no edge on its paths
    that is in one, so the next phase, and at last a semi-naive join, goes on with the other edges only. oa and ib are the
    phases in which a reaches a hub and b is reached from one: a pair is in a product when they have a bit in common, and
    is written out with the first.
    """
    zero = F.lit(0).cast("long")
    edges = edges.select("predicate", "a", "b").distinct().withColumns({"oa": zero, "ib": zero})
    edges = materialize(edges, "edges")
    blocks: DataFrame | None = None
    pairs = 0
    for phase in range(PHASES):
        nodes = _nodes(edges)
        size = nodes.agg(F.sum("paths").alias("paths"), F.sum("out").alias("edges")).first()
        if not size.edges or size.paths <= max(PATHS, size.edges / 2):  # few edges lead on to others
            break
        members = materialize(_members(edges, nodes), "members")
        counts = _product(members, lambda side, key: side.groupBy(*key).agg(F.count(F.lit(1)).alias("n")))
        pairs += counts.agg(F.sum(F.col("left.n") * F.col("right.n")).alias("n")).first().n or 0
        more = _product(members, _lists).select("left.predicate", F.col("left.nodes").alias("as"), F.col("right.nodes").alias("bs"))
        blocks = more if blocks is None else blocks.unionByName(more)
        for end, mask, flag in (("a", "oa", "o"), ("b", "ib", "i")):
            bit = F.when(F.col(flag), F.lit(1 << phase)).otherwise(0).cast("long")
            seen = members.select("predicate", F.col("v").alias(end), flag)
            edges = edges.join(seen, ["predicate", end], "left").withColumn(mask, F.col(mask).bitwiseOR(bit)).drop(flag)
        edges = materialize(edges.where(_apart("oa", "ib")), "edges")
    out = _derived(edges)
    if blocks is None:
        return out
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-pairs // PAIRS))
    spread = blocks.repartition(tasks).select("predicate", F.explode("as").alias("a"), "bs").select("predicate", "a", F.explode("bs").alias("b"))
    return out.unionByName(spread)


def _apart(a: str, b: str) -> Column:
    return F.col(a).bitwiseAND(F.col(b)) == 0


def _nodes(edges: DataFrame) -> DataFrame:
    """predicate, v, its masks, the number of edges out, and of paths of two edges through it."""
    zero = F.lit(0).cast("long")
    starts = edges.select("predicate", F.col("a").alias("v"), "oa", zero.alias("ib"), F.lit(1).alias("out"), F.lit(0).alias("in"))
    ends = edges.select("predicate", F.col("b").alias("v"), zero.alias("oa"), "ib", F.lit(0).alias("out"), F.lit(1).alias("in"))
    sums = starts.unionByName(ends).groupBy("predicate", "v").agg(F.max("oa").alias("oa"), F.max("ib").alias("ib"), F.sum("out").alias("out"), F.sum("in").alias("in"))
    return sums.select("predicate", "v", "oa", "ib", "out", (F.col("out") * F.col("in")).alias("paths"))


def _spread(links: DataFrame, state: DataFrame, sent: dict[str, Column]) -> DataFrame:
    """The values of all nodes once nothing changes any more: each value that grew goes along its node's links as the
    message sent, and the largest counts. A round is written to the shared folder as a whole, one row a node."""
    state = materialize(state.withColumn("grown", F.lit(True)), "state")
    while not state.where("grown").isEmpty():
        news = links.join(state.where("grown"), ["predicate", "v"]).select("predicate", F.col("to").alias("v"), *[m.alias(k) for k, m in sent.items()])
        news = news.where(reduce(or_, [F.col(k).isNotNull() for k in sent]))
        old = state.select("predicate", "v", *sent, *[F.col(k).alias(f"old_{k}") for k in sent])
        best = old.unionByName(news, allowMissingColumns=True).groupBy("predicate", "v").agg(*[F.max(k).alias(k) for x in sent for k in (x, f"old_{x}")])
        grown = reduce(or_, [F.coalesce(F.col(k) > F.col(f"old_{k}"), F.col(k).isNotNull()) for k in sent])
        state = materialize(best.select("predicate", "v", *sent, grown.alias("grown")), "state")
    return state.drop("grown")


def _members(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that reach their component's hub (o) or are reached from it (i), with the hub, their masks, and whether they
    are a hub that is on no cycle (alone). A hub is both."""
    forth = edges.select("predicate", F.col("a").alias("v"), F.col("b").alias("to"), F.lit(False).alias("back"))
    links = materialize(forth.unionByName(edges.select("predicate", F.col("b").alias("v"), F.col("a").alias("to"), F.lit(True).alias("back"))), "links")
    labels = _spread(links, nodes.select("predicate", "v", F.struct("paths", "v").alias("label")), {"label": F.col("label")})
    labels = labels.select("predicate", "v", F.col("label.v").alias("hub"), F.col("label.paths").alias("paths"))
    yes, back = F.lit(True), F.col("back")
    hubs = labels.where("v = hub and paths > 0").select("predicate", "v")
    reach = _spread(links, hubs.withColumns({"o": yes, "i": yes}), {"o": F.when(back, F.col("o")), "i": F.when(~back, F.col("i"))})
    returning = reach.where("o").select("predicate", F.col("v").alias("b"))
    cyclic = edges.join(returning, ["predicate", "b"], "left_semi").join(hubs.withColumnRenamed("v", "a"), ["predicate", "a"], "left_semi")
    cyclic = cyclic.select("predicate", F.col("a").alias("v"), yes.alias("cyclic")).distinct()
    rows = reach.join(labels, ["predicate", "v"]).join(nodes, ["predicate", "v"]).join(cyclic, ["predicate", "v"], "left")
    flags = [F.coalesce(k, F.lit(False)).alias(k) for k in ("o", "i")]
    return rows.select("predicate", "v", "hub", "oa", "ib", *flags, ((F.col("v") == F.col("hub")) & F.col("cyclic").isNull()).alias("alone"))


def _lists(side: DataFrame, key: list[str]) -> DataFrame:
    """The nodes of a key in lists of about BLOCK."""
    n = side.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / BLOCK)).alias("part")
    return side.join(n, key).groupBy(*key, part).agg(F.collect_list("v").alias("nodes"))


def _product(members: DataFrame, gathered: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """What is gathered of the nodes that reach a hub (left) by that of the nodes it reaches (right), without pairs of
    earlier products and the pair of a hub on no cycle with itself."""
    key = ["predicate", "hub", "alone"]
    left = gathered(members.where("o"), [*key, "oa"]).alias("left")
    right = gathered(members.where("i"), [*key, "ib"]).alias("right")
    same = (F.col("left.predicate") == F.col("right.predicate")) & (F.col("left.hub") == F.col("right.hub"))
    return left.join(right, same & _apart("left.oa", "right.ib") & ~(F.col("left.alone") & F.col("right.alone")))


def _derived(edges: DataFrame) -> DataFrame:
    """Pairs of paths of edges that are in no product, semi-naive: the newest pairs are joined with the edges. A pair of a
    product is not followed, as all that it leads to is in the same product."""
    onward = edges.select("predicate", F.col("a").alias("b"), F.col("b").alias("c"), "ib")
    known = delta = edges.select("predicate", "a", "b", "oa")
    rounds = 0
    while True:
        found = delta.join(onward, ["predicate", "b"]).where(_apart("oa", "ib")).select("predicate", "a", F.col("c").alias("b"), "oa").distinct()
        delta = materialize(found.join(known, ["predicate", "a", "b"], "left_anti"), "delta")
        if delta.isEmpty():
            return known.select("predicate", "a", "b")
        rounds += 1
        known = known.unionByName(delta)
        if rounds % 8 == 0:
            known = materialize(known, "known")
