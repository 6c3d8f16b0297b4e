"""From source files to entities, scores, reports and exports."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.config import ResolveConfig, run_folder
from linkwright.operators import canonical, graph, matching, network, pruning, reports
from linkwright.operators.blocking import latest_records
from linkwright.sources import normalize, readers, sinks
from linkwright.storage import stored


def resolve(records: DataFrame, referrals: DataFrame | None = None, config: ResolveConfig | None = None) -> dict[str, DataFrame]:
    """records (with record_id, the order in which they came) to the tables of a run: records, matches, vertices, edges, components, entities, mapping, referral_edges, scores."""
    config = config or ResolveConfig()
    records = stored(latest_records(records), "records")
    matches = stored(matching.find_matches(records, config), "matches")
    vertices, edges = graph.build_graph(records, matching.confirmed(matches, config.include_uncertain_matches))
    vertices, edges = stored(vertices, "vertices"), stored(edges, "edges")
    kept = stored(pruning.prune_all(vertices, edges, config.min_edge_weight, config.max_cluster_size, config.prune_npi_conflicts), "kept")
    components = stored(graph.connected_components(vertices, kept), "components")
    entities = stored(canonical.merge_clusters(vertices, kept, components), "entities")
    mapping = stored(canonical.source_mapping(vertices, components), "mapping")
    out = {"records": records, "matches": matches, "vertices": vertices, "all_edges": edges, "edges": kept, "components": components, "entities": entities, "mapping": mapping}
    if referrals is not None:
        own = stored(network.referral_edges(referrals, canonical.npi_to_canonical(records, mapping)), "referral_edges")
        out |= {"referral_edges": own, "scores": network.pagerank(own, config.pagerank_damping, config.pagerank_rounds).withColumnRenamed("id", "canonical_id")}
    return out


def run(spark: SparkSession, data_folder: str, output: str | Path = "outputs", config: ResolveConfig | None = None, centroids: str | None = None) -> dict:
    """Reads the five files of data_folder, resolves them, writes exports and reports; gives counts and the folder."""
    folder = run_folder(output)
    sources = readers.load_all(spark, data_folder)
    records = normalize.normalize_all(sources, readers.load_centroids(spark, centroids)).withColumn("record_id", F.monotonically_increasing_id())
    t = resolve(records, sources["referral"], config)
    quality = graph.quality(t["vertices"], t["edges"], t["components"])
    found = {
        "data_quality": reports.data_quality_report(t["records"]), "match_quality": reports.match_quality_report(t["matches"]),
        "cluster_report": reports.cluster_report(t["vertices"], quality, graph.quality_summary(quality), t["components"], t["entities"]),
    }
    sinks.export(t["entities"], t["mapping"], t["scores"], found, folder)
    edges, kept = t["all_edges"].count(), t["edges"].count()
    return {
        "status": "success", "output_dir": str(folder), "source_counts": {s: df.count() for s, df in sources.items()}, "total_records": t["records"].count(), "match_count": t["matches"].filter("decision = 'match'").count(),
        "graph_nodes": t["vertices"].count(), "graph_edges": edges, "pruned_edges": edges - kept, "cluster_count": t["components"].select("component").distinct().count(), "canonical_physician_count": t["entities"].count(), "referral_edges": t["referral_edges"].count(),
    }
