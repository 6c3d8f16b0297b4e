"""One group for all records that links connect, by low-diameter decomposition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.storage import stored

#: With so few links left, the contracted graph is finished in one task.
LAST_LINKS = 20_000
#: The same where groups are the result: all but the smallest graphs are decomposed.
FEW_LINKS = 1_000


def _finish(links: DataFrame) -> DataFrame:
    """Components of at most LAST_LINKS links, by union-find in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for b in batches:
            for x, y in zip(b["a"].tolist(), b["b"].tolist()):
                if (p := top(x)) != (q := top(y)):
                    up[max(p, q)] = min(p, q)
        yield pd.DataFrame({"node": list(up), "group": [top(x) for x in list(up)]}, dtype="int64")

    return links.coalesce(1).mapInPandas(run, "node long, group long")


def decompose(links: DataFrame, beta: float, reach: int, seed: int) -> DataFrame:
    """(node, center): clusters of a low-diameter decomposition of the graph links (a, b), both directions given.

    Every node draws a shift from an exponential distribution of rate beta,
    cut at reach, and starts a cluster at reach minus its shift. Clusters grow
    a hop in a unit of time; a node belongs to the cluster that comes first.
    No cluster has a radius above reach, so reach relaxations settle it.
    """
    # The start carries a fraction of its own for each node, so equal arrivals mean the same center.
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("node")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    start = F.greatest(F.lit(0.0), reach + F.log(u) / beta) + F.pmod(F.xxhash64(F.lit(seed + 1), F.col("node")), F.lit(1 << 40)) / float(1 << 44)
    state = links.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("center"), start.alias("at"))
    for _ in range(reach):
        come = links.join(state, links["a"] == state["node"]).select(F.col("b").alias("node"), "center", (F.col("at") + 1).alias("at"))
        state = state.unionByName(come).groupBy("node").agg(F.min_by("center", "at").alias("center"), F.min("at").alias("at"))
    return state.select("node", "center")


def group_links(links: DataFrame, beta: float = 0.35, reach: int = 4, last: int = LAST_LINKS) -> DataFrame:
    """(node, group) for every node of links (a long, b long): group is the same for nodes connected directly or indirectly.

    Clusters of decompose() are contracted to super-vertices, the links between
    clusters are taken on to the next level (each pair once), until at most
    `last` links are left, which one task finishes; then the assignments of all
    levels are composed. Each level is written to the shared folder, so a lost
    executor costs no more than that level. Links of a node with itself give the
    node a group of its own; null ends are left out; repeated links count once.
    Both shuffles of a relaxation combine by node before they send, so a node
    with very many links costs its owner one row from each task; the join by
    node leaves its splitting to adaptive execution.
    """
    links = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    lone = links.filter(F.col("a") == F.col("b")).select(F.col("a").alias("node")).distinct()
    left = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    levels: list[DataFrame] = []
    while left.count() > last:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        level = stored(decompose(both, beta, reach, 7 + 2 * len(levels)), "level")
        levels.append(level)
        # Ends are renamed one after the other; most links fall within clusters and end here.
        one = left.join(level.select(F.col("node").alias("a"), F.col("center").alias("ca")), "a").select("ca", "b")
        two = one.join(level.select(F.col("node").alias("b"), F.col("center").alias("cb")), "b").filter("ca <> cb")
        left = stored(two.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "links")
    group = _finish(left)
    for level in reversed(levels):
        top = group.select(F.col("node").alias("center"), "group")
        group = level.join(top, "center", "left").select("node", F.coalesce("group", "center").alias("group"))
    return group.unionByName(lone.join(group, "node", "left_anti").select("node", F.col("node").alias("group")))


def follow(pointers: DataFrame) -> DataFrame:
    """(node, group) of a forest: pointers (node, to), one for each node, to a smaller node; group is the root.

    Doubles the reach of every pointer each round, until none leads further.
    """
    now = stored(pointers.select("node", "to"), "pointers")
    while True:
        far = now.select(F.col("node").alias("to"), F.col("to").alias("next"))
        new = stored(now.join(far, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "pointers")
        now = new.select("node", "to")
        if new.filter("moved").isEmpty():
            roots = now.select(F.col("to").alias("node")).distinct()
            return now.select("node", F.col("to").alias("group")).unionByName(roots.select("node", F.col("node").alias("group")))


def group_stars(first: DataFrame, links: DataFrame, joined: Callable[[DataFrame], DataFrame] = group_links) -> DataFrame:
    """(node, group) for every node of links that lead to smaller nodes: group is the same for nodes connected directly or indirectly.

    first: node, to (one of its links); a row for each node with links. links:
    node, to, all of them, each once. Those of first form a forest, whose trees
    follow() finds in a few joins; of the others only those between two trees
    are left for joined.
    """
    tree = stored(follow(first), "trees")
    at = tree.select(F.col("node").alias("to"), F.col("group").alias("b"))
    other = links.join(tree.select("node", F.col("group").alias("a")), "node").filter("a <> to").select("a", "to").distinct()
    crossing = other.join(at, "to", "left").select("a", F.coalesce("b", "to").alias("b")).filter("a <> b").distinct()
    upper = joined(crossing).select(F.col("node").alias("group"), F.col("group").alias("top"))
    upper = stored(upper, "upper")
    alone = upper.select(F.col("group").alias("node"), F.col("top").alias("group")).join(tree.select("node"), "node", "left_anti")
    return tree.join(upper, "group", "left").select("node", F.coalesce("top", "group").alias("group")).unionByName(alone)


def linked_pairs(pairs: DataFrame) -> DataFrame:
    """(source_id_1, source_id_2) of the rows that say match, whatever the case and spaces around, of two different ids."""
    said = F.lower(F.regexp_replace("match_decision", r"^\s+|\s+$", "")) == "match"
    return pairs.filter(said & (F.col("source_id_1") != F.col("source_id_2"))).select("source_id_1", "source_id_2")


def consolidate(pairs: DataFrame, beta: float = 0.35, reach: int = 4, last: int = FEW_LINKS) -> DataFrame:
    """(source_id, group_id) of every id with a link; group_id is the smallest id it can reach.

    pairs: source_id_1, source_id_2 STRING. Null ids are no link, an id linked
    to itself only is its own group, an empty table gives no rows. Ids are told
    apart by 64-bit hashes; should two ids share one, other hashes are taken.
    """
    pairs = pairs.select("source_id_1", "source_id_2").filter(F.col("source_id_1").isNotNull() & F.col("source_id_2").isNotNull())
    for salt in range(8):
        h = lambda c: F.xxhash64(F.lit(salt), F.col(c))  # noqa: E731, B023
        hashed = pairs.select("source_id_1", "source_id_2", h("source_id_1").alias("a"), h("source_id_2").alias("b"))
        ends = hashed.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("source_id_1").alias("source_id")), F.struct(F.col("b").alias("node"), F.col("source_id_2").alias("source_id")))).alias("e")).select("e.*")
        nodes = stored(ends.groupBy("node").agg(F.min("source_id").alias("source_id"), F.max("source_id").alias("other")), "nodes")
        if nodes.filter("source_id <> other").isEmpty():
            break
    else:
        raise RuntimeError("no 64-bit hash tells all ids apart")
    group = stored(group_links(hashed.select("a", "b"), beta, reach, last).join(nodes.select("node", "source_id"), "node").select("source_id", "group"), "groups")
    name = group.groupBy("group").agg(F.min("source_id").alias("group_id"))
    return group.join(name, "group").select("source_id", "group_id")
