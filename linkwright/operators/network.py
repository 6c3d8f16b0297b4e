"""Referral network: edges, metrics, PageRank, colleagues. edges: (src, dst, referral_count, last_referral_date)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.functions.names import given, strip
from linkwright.storage import stored

#: Pairs of colleagues are made at facilities with at most so many physicians; larger ones say little.
MOST_AT_FACILITY = 99
COLLEAGUE_STRENGTH = 0.6


def referral_edges(referrals: DataFrame, ids: DataFrame) -> DataFrame:
    """Directed edges between entities: number of referrals and last date (as text) of each ordered pair.

    referrals: referring_npi, receiving_npi, referral_date; ids: npi,
    canonical_id. Rows with a missing or unknown npi, and those that end where
    they begin, are left out. Rows are counted by pairs of npis before any join,
    so an npi that receives a third of all referrals is a few rows in the join.
    """
    rows = referrals.select(given(F.col("referring_npi")).alias("a"), given(F.col("receiving_npi")).alias("b"), F.coalesce(F.col("referral_date").cast("string"), F.lit("")).alias("d")).filter("a is not null and b is not null")
    counted = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d"))
    known = ids.filter("npi is not null").groupBy("npi").agg(F.min("canonical_id").alias("id"))
    named = counted.join(known.select(F.col("npi").alias("a"), F.col("id").alias("src")), "a").join(known.select(F.col("npi").alias("b"), F.col("id").alias("dst")), "b")
    return named.filter("src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("referral_count"), F.max("d").alias("last_referral_date"))


def metrics(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, in_volume, out_volume) of every node."""
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i")))
    e = edges.select("referral_count", F.explode(ends).alias("e")).select("e.*", "referral_count")
    n = F.col("referral_count")
    return e.groupBy("id").agg(F.count_if(F.col("i") == 1).alias("in_degree"), F.count_if(F.col("i") == 0).alias("out_degree"), F.sum(F.when(F.col("i") == 1, n).otherwise(0)).alias("in_volume"), F.sum(F.when(F.col("i") == 0, n).otherwise(0)).alias("out_volume"))


def stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, referrals, their mean by edge, largest and mean degrees over all nodes."""
    m = metrics(edges).agg(F.count(F.lit(1)).alias("nodes"), F.max("in_degree").alias("max_in_degree"), F.max("out_degree").alias("max_out_degree"), F.avg("in_degree").alias("avg_in_degree"), F.avg("out_degree").alias("avg_out_degree"))
    return m.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges"), F.sum("referral_count").alias("referrals"), F.avg("referral_count").alias("avg_referrals"))).filter("edges > 0")


def top_referrers(edges: DataFrame, n: int = 10) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.sum("referral_count").alias("referrals")).orderBy(F.desc("referrals"), "id").limit(n)


def top_receivers(edges: DataFrame, n: int = 10) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.sum("referral_count").alias("referrals")).orderBy(F.desc("referrals"), "id").limit(n)


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, weight: str | None = "referral_count", exact_rounds: bool = False) -> DataFrame:
    """(id, score), scores summing to 1: weighted PageRank with the mass of nodes without way out spread evenly.

    Stops when the sum of changes is below nodes * tolerance; if that isn't
    reached in the given rounds, the ranks are computed without weights.
    exact_rounds makes just that many rounds. Edges are stored once with their
    transition probability; a round joins them with the ranks and sums by
    target, combined before it is sent.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    out = edges.groupBy("src").agg(F.sum(w).alias("out"))
    moves = stored(edges.join(out, "src").select("src", "dst", (w / F.col("out")).alias("p")), "moves")
    nodes = stored(metrics(edges.withColumn("referral_count", F.lit(1))).select("id", (F.col("out_degree") == 0).alias("dangling")), "nodes")
    n = nodes.count()
    if not n:
        return edges.sparkSession.createDataFrame([], "id string, score double")
    ranks = stored(nodes.select("id", "dangling", F.lit(1.0 / n).alias("score")), "ranks")
    for _ in range(rounds):
        lost = ranks.filter("dangling").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        come = moves.join(ranks.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("score")).alias("come"))
        new = ranks.join(come, "id", "left").select("id", "dangling", ((1.0 - damping) / n + damping * (F.coalesce("come", F.lit(0.0)) + lost / n)).alias("new"), "score")
        new = stored(new, "ranks")
        change = new.agg(F.sum(F.abs(F.col("new") - F.col("score")))).first()[0]
        ranks = new.select("id", "dangling", F.col("new").alias("score"))
        if not exact_rounds and change < n * tolerance:
            return ranks.select("id", "score")
    if exact_rounds or weight is None:
        return ranks.select("id", "score")
    return pagerank(edges, damping, rounds, tolerance, None)


def top_influencers(scores: DataFrame, n: int = 20) -> DataFrame:
    return scores.orderBy(F.desc("score"), "id").limit(n)


def colleagues(entities: DataFrame, most: int = MOST_AT_FACILITY) -> DataFrame:
    """(id_1, id_2, relationship, strength): physicians whose primary facility is the same in its first fifty letters, at facilities with 2 to most of them."""
    at = entities.select(F.col("id"), F.substring(F.upper(strip(F.col("primary_facility"))), 1, 50).alias("facility")).filter("facility <> ''")
    fit = at.groupBy("facility").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & (F.col("n") <= most)).select("facility")
    small = at.join(fit, "facility", "left_semi")
    a, b = small.alias("a"), small.alias("b")
    return a.join(b, (F.col("a.facility") == F.col("b.facility")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("id_1"), F.col("b.id").alias("id_2"), F.lit("same_facility").alias("relationship"), F.lit(COLLEAGUE_STRENGTH).alias("strength"))


def coauthors(spark: SparkSession) -> DataFrame:
    """A place for pairs from publications; none so far."""
    return spark.createDataFrame([], "id_1 string, id_2 string, relationship string, strength double")


def colleague_graph(pairs: DataFrame) -> DataFrame:
    """(id_1, id_2, strength, relationships): parallel edges joined, the largest strength, all kinds."""
    return pairs.groupBy(F.least("id_1", "id_2").alias("id_1"), F.greatest("id_1", "id_2").alias("id_2")).agg(F.max("strength").alias("strength"), F.sort_array(F.collect_set("relationship")).alias("relationships"))


def ego_network(node: str, edges: DataFrame, colleague_edges: DataFrame | None = None) -> DataFrame:
    """(relation, id, weight) of the neighbours of a node: referral_in, referral_out and, if given, colleague."""
    out = edges.filter(F.col("dst") == node).select(F.lit("referral_in").alias("relation"), F.col("src").alias("id"), F.col("referral_count").cast("double").alias("weight"))
    out = out.unionByName(edges.filter(F.col("src") == node).select(F.lit("referral_out").alias("relation"), F.col("dst").alias("id"), F.col("referral_count").cast("double").alias("weight")))
    if colleague_edges is not None:
        near = colleague_edges.filter((F.col("id_1") == node) | (F.col("id_2") == node))
        out = out.unionByName(near.select(F.lit("colleague").alias("relation"), F.when(F.col("id_1") == node, F.col("id_2")).otherwise(F.col("id_1")).alias("id"), F.col("strength").alias("weight")))
    return out
