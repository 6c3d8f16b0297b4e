"""The weighted identity graph: components, inspection, quality. vertices: (id, npi, specialty, facility_state, ...); edges: (src, dst, weight), src < dst."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.functions.names import given, strip
from linkwright.storage import stored

# How far a source is relied on as an edge's end, and specialties that don't go together.
RELIABILITY = {"cms": 1.0, "license": 0.9, "hospital": 0.8, "publication": 0.6}
INCOMPATIBLE = (("PEDIATRICS", "GERIATRICS"), ("OBSTETRICS", "UROLOGY"), ("DERMATOLOGY", "CARDIOLOGY"), ("PSYCHIATRY", "ORTHOPEDIC SURGERY"), ("OPHTHALMOLOGY", "GASTROENTEROLOGY"))


def _lookup(values: dict, key: Column, other) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(other))


def edge_type(npi_1: Column, npi_2: Column, weight: Column) -> Column:
    same = given(npi_1).isNotNull() & (npi_1 == npi_2)
    return F.when(same, "npi_exact").when(weight >= 0.85, "name_strong").when(weight >= 0.6, "name_moderate").otherwise("weak")


def build_graph(records: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of records (one row for each source_id) and matches (source_id_1, source_id_2, weight).

    Matches with an end that is no record, or with two equal ends, are left
    out; of repeated pairs, in either order, the heaviest stays.
    """
    vertices = records.select(F.col("source_id").alias("id"), "source", "npi", "name_raw", "name_first", "name_last", "specialty", "facility_name", "facility_city", "facility_state")
    pairs = matches.filter("source_id_1 <> source_id_2").groupBy(F.least("source_id_1", "source_id_2").alias("src"), F.greatest("source_id_1", "source_id_2").alias("dst")).agg(F.max("weight").alias("weight"))
    end = lambda s: vertices.select(F.col("id").alias(s), F.col("npi").alias(f"npi_{s}"), F.col("source").alias(f"source_{s}"))
    both = pairs.join(end("src"), "src").join(end("dst"), "dst")
    edges = both.select("src", "dst", "weight", edge_type(F.col("npi_src"), F.col("npi_dst"), F.col("weight")).alias("match_type"), F.array("source_src", "source_dst").alias("sources"))
    return vertices, edges


def reweighted(edges: DataFrame) -> DataFrame:
    """Weights times the mean reliability of the two sources, a tenth more across sources, at most 0.99."""
    a, b = F.col("sources")[0], F.col("sources")[1]
    mean = (_lookup(RELIABILITY, a, 0.5) + _lookup(RELIABILITY, b, 0.5)) / 2
    return edges.withColumn("weight", F.least(F.lit(0.99), F.col("weight") * mean * F.when(a != b, 1.1).otherwise(1.0)))


def connected_components(vertices: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): component is the smallest id that can be reached; a vertex without edges is its own.

    Alternates large-star and small-star steps until no edge changes: the
    number of rounds follows the logarithm of the longest path, and each round
    leaves at most as many edges as before. Every round is written to the
    shared folder. A vertex with very many edges is a window of its own that is
    sorted outside memory; it is never collected.
    """
    now = stored(edges.filter("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct(), "stars")

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(now)
    for _ in range(most_rounds):
        # Large star: every larger neighbour of a vertex goes to the smallest of the vertex and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = F.least("u", F.min("v").over(Window.partitionBy("u")))
        large = both.withColumn("m", low).filter("v > u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        # Small star: the smaller neighbours of a vertex, and itself, go to the smallest of them.
        least = F.min("u").over(Window.partitionBy("v"))
        pulled = large.withColumn("m", least)
        small = pulled.select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(pulled.select(F.col("m").alias("u"), "v")).filter("u <> v").distinct()
        now = stored(small, "stars")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    return vertices.select("id").distinct().join(now.select(F.col("v").alias("id"), F.col("u").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def clusters(components: DataFrame) -> DataFrame:
    """(component, n) by size, largest first."""
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component")


def cluster_of(components: DataFrame, node: str) -> DataFrame:
    """Ids in the component of one node; none if there is no such node."""
    return components.join(components.filter(F.col("id") == node).select("component"), "component", "left_semi").select("id")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (id)."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def cluster_names(components: DataFrame) -> DataFrame:
    """(id, cluster_id): CLUSTER_00000 is the largest cluster; ties go by the smaller component.

    Only the components are numbered in one order, not their members.
    """
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    n = F.row_number().over(Window.orderBy(F.desc("n"), "component")) - 1
    return components.join(sizes.select("component", F.format_string("CLUSTER_%05d", n).alias("cluster_id")), "component").select("id", "cluster_id")


def size_classes(components: DataFrame) -> DataFrame:
    """One row: clusters in all, of 1, 2, 3 to 5, 6 to 10 and more than 10."""
    s = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return s.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") == 2).alias("pairs"), F.count_if(F.col("n").between(3, 5)).alias("small"), F.count_if(F.col("n").between(6, 10)).alias("medium"), F.count_if(F.col("n") > 10).alias("large"))


def size_histogram(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("clusters"))


def graph_stats(vertices: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """One row: nodes, edges, components, density, average degree."""
    n, m = vertices.agg(F.count(F.lit(1)).alias("nodes")), edges.agg(F.count(F.lit(1)).alias("edges"))
    c = components.agg(F.count_distinct("component").alias("components"))
    full = F.col("nodes") * (F.col("nodes") - 1)
    return n.crossJoin(m).crossJoin(c).withColumns({"density": F.when(F.col("nodes") > 1, 2 * F.col("edges") / full).otherwise(0.0), "average_degree": F.when(F.col("nodes") > 0, 2 * F.col("edges") / F.col("nodes")).otherwise(0.0)})


def edges_by_component(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges with their component (of src)."""
    return edges.join(components.select(F.col("id").alias("src"), "component"), "src")


def _sizes(vertices: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    w = edges_by_component(edges, components).groupBy("component").agg(F.count(F.lit(1)).alias("edges"), F.avg("weight").alias("avg_weight"), F.min("weight").alias("min_weight"))
    count = lambda c: F.count_distinct(given(F.col(c)))
    v = vertices.join(components, "id").groupBy("component").agg(F.count(F.lit(1)).alias("size"), count("npi").alias("npi_count"), count("facility_state").alias("state_count"), count("specialty").alias("specialty_count"), count("source").alias("source_count"))
    n = F.col("size")
    return v.join(w, "component", "left").withColumns({
        "edges": F.coalesce("edges", F.lit(0)), "avg_weight": F.coalesce("avg_weight", F.lit(0.0)), "min_weight": F.coalesce("min_weight", F.lit(0.0)),
        "density": F.when(n > 1, 2 * F.coalesce("edges", F.lit(0)) / (n * (n - 1))).otherwise(1.0),
    })


def cohesion(vertices: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, cohesion): 1 for a single record, 0 without edges, else 0.6 of the mean weight and 0.4 of the density."""
    s = _sizes(vertices, edges, components)
    return s.select("component", F.when(F.col("size") <= 1, 1.0).when(F.col("edges") == 0, 0.0).otherwise(0.6 * F.col("avg_weight") + 0.4 * F.col("density")).alias("cohesion"))


def quality(vertices: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """One row a cluster: size, weights, density, distinct npis, states and specialties, conflict, warnings, score, has_issues."""
    s = _sizes(vertices, edges, components)
    c = F.col
    warn = lambda cond, fmt, *xs: F.when(cond, F.format_string(fmt, *xs))
    warnings = F.array_compact(F.array(
        warn(c("npi_count") > 1, "NPI conflict: %d different NPIs found", c("npi_count")), warn(c("state_count") > 3, "Geographic spread: records in %d states", c("state_count")),
        warn(c("specialty_count") > 3, "Multiple specialties: %d found", c("specialty_count")), warn(c("size") > 20, "Large cluster: %d records", c("size")),
    ))
    base = 0.4 * c("avg_weight") + 0.2 * c("min_weight") + 0.4
    less = lambda cond, step, over: F.when(cond, F.greatest(F.lit(0.5), 1.0 - step * over)).otherwise(1.0)
    score = base * F.when(c("size") <= 5, 0.3 * c("density") + 0.7).otherwise(1.0)
    score = score * less(c("state_count") > 1, 0.15, c("state_count") - 1) * less(c("specialty_count") > 2, 0.1, c("specialty_count") - 2) * less(c("size") > 10, 0.02, c("size") - 10)
    out = s.withColumns({"npi_conflict": c("npi_count") > 1, "warnings": warnings, "quality_score": F.when(c("npi_count") > 1, 0.1).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))})
    return out.withColumn("has_issues", c("npi_conflict") | (F.size("warnings") > 0)).drop("edges", "source_count")


def quality_summary(q: DataFrame) -> DataFrame:
    """One row over all clusters; none if there are no clusters."""
    s = F.col("quality_score")
    return q.agg(F.count(F.lit(1)).alias("clusters"), F.avg(s).alias("avg_score"), F.min(s).alias("min_score"), F.max(s).alias("max_score"), F.count_if("npi_conflict").alias("npi_conflicts"), F.count_if(F.size("warnings") > 0).alias("with_warnings"), F.count_if(s >= 0.8).alias("high"), F.count_if((s >= 0.5) & (s < 0.8)).alias("medium"), F.count_if(s < 0.5).alias("low")).filter("clusters > 0")


def conflicting_specialties(vertices: DataFrame, components: DataFrame) -> DataFrame:
    """(component, specialty_1, specialty_2): pairs of specialties of a cluster that name different sides of an incompatible pair."""
    s = vertices.join(components, "id").select("component", F.upper(strip(F.col("specialty"))).alias("s")).filter("s <> ''").distinct()
    sides = lambda g: F.concat(*(F.when(F.col("s").contains(x), F.lit(k)).otherwise("") for k, x in zip("ab", g)))
    named = s.select("component", "s", F.explode(F.array(*(F.struct(F.lit(i).alias("g"), sides(g).alias("side")) for i, g in enumerate(INCOMPATIBLE)))).alias("m")).filter("m.side <> ''")
    a, b = named.alias("a"), named.alias("b")
    on = (F.col("a.component") == F.col("b.component")) & (F.col("a.m.g") == F.col("b.m.g")) & (F.col("a.s") < F.col("b.s")) & (F.col("a.m.side") != F.col("b.m.side"))
    return a.join(b, on).select(F.col("a.component").alias("component"), F.col("a.s").alias("specialty_1"), F.col("b.s").alias("specialty_2")).distinct()


def bridges_and_cuts(pairs: Iterable[tuple[str, str]]) -> tuple[set[tuple[str, str]], set[str]]:
    """Bridges (smaller end first) and articulation points of a graph, by low links without recursion."""
    near: dict[str, list[str]] = {}
    for u, v in sorted(pairs):
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    bridges, cuts = set(), set()
    for root in sorted(near):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack, roots_children = [(root, None, iter(near[root]))], 0
        while stack:
            u, parent, it = stack[-1]
            v = next(it, None)
            if v is None:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[u])
                    if low[u] > order[parent]:
                        bridges.add((min(u, parent), max(u, parent)))
                    if parent == root:
                        roots_children += 1
                    elif low[u] >= order[parent]:
                        cuts.add(parent)
            elif v not in order:
                order[v] = low[v] = len(order)
                stack.append((v, u, iter(near[v])))
            elif v != parent:
                low[u] = min(low[u], order[v])
        if roots_children > 1:
            cuts.add(root)
    return bridges, cuts


def _by_component(edges: DataFrame, components: DataFrame, run, schema: str) -> DataFrame:
    return edges_by_component(edges, components).select("component", "src", "dst", "weight").groupBy("component").applyInPandas(run, schema)


def weak_bridges(edges: DataFrame, components: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(component, src, dst, weight) of bridges lighter than threshold. Components without a light edge stay in the JVM."""
    light = edges_by_component(edges, components).filter(F.col("weight") < threshold).select("component").distinct()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found, _ = bridges_and_cuts(zip(part["src"], part["dst"]))
        hit = [(u, v) in found and w < threshold for u, v, w in zip(part["src"], part["dst"], part["weight"])]
        return part[hit]

    return _by_component(edges, components.join(light, "component", "left_semi"), run, "component string, src string, dst string, weight double")


def articulation_points(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, id) of the vertices whose removal splits their component."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        _, cuts = bridges_and_cuts(zip(part["src"], part["dst"]))
        return pd.DataFrame([(part["component"].iloc[0], x) for x in sorted(cuts)], columns=["component", "id"], dtype=object)

    return _by_component(edges, components, run, "component string, id string")


def suggested_splits(vertices: DataFrame, edges: DataFrame, components: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(component, id, part): the parts that remain of each cluster with weak bridges when these are taken out."""
    weak = weak_bridges(edges, components, threshold)
    hit = components.join(weak.select("component").distinct(), "component", "left_semi")
    kept = edges.join(weak.select("src", "dst"), ["src", "dst"], "left_anti")
    parts = connected_components(hit.select("id"), induced(kept, hit))
    return hit.join(parts.withColumnRenamed("component", "part"), "id").select("component", "id", "part")


def overmatching(vertices: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, warnings) of clusters with signs of too many matches: several npis, size, specialties, states, weak bridges."""
    s = _sizes(vertices.withColumn("facility_state", F.upper("facility_state")), edges, components)
    spec = conflicting_specialties(vertices, components).groupBy("component").agg(F.count(F.lit(1)).alias("pairs"))
    weak = weak_bridges(edges, components).groupBy("component").agg(F.count(F.lit(1)).alias("weak"))
    c = F.col
    warn = lambda cond, fmt, x: F.when(cond, F.format_string(fmt, x))
    warnings = F.array_compact(F.array(
        warn(c("npi_count") > 1, "CRITICAL: NPI conflict - %d different NPIs", c("npi_count")),
        F.when(c("size") > 50, F.format_string("WARNING: Very large cluster with %d records", c("size"))).when(c("size") > 20, F.format_string("NOTICE: Large cluster with %d records", c("size"))),
        warn(c("pairs") > 0, "WARNING: Conflicting specialties found: %d", c("pairs")), warn(c("state_count") > 3, "WARNING: Records span %d states", c("state_count")),
        warn(c("weak") > 0, "WARNING: Cluster connected by %d weak edge(s)", c("weak")),
    ))
    return s.join(spec, "component", "left").join(weak, "component", "left").select("component", warnings.alias("warnings")).filter(F.size("warnings") > 0)
