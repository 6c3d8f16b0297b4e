"""One entity for each cluster: id, surviving attributes, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.functions.names import given, strip
from linkwright.functions.similarity import VALID_NPI
from linkwright.operators.graph import _lookup, _sizes

# Which source's spelling wins, and what a lone record of a source is worth.
PRIORITY = {"cms": 4, "license": 3, "hospital": 2, "publication": 1}
PRIOR = {"cms": 0.85, "license": 0.80, "hospital": 0.70, "publication": 0.50}


def _npi() -> Column:
    return F.when(F.col("npi").rlike(VALID_NPI), F.col("npi"))


def _most_common(rows: DataFrame, value: Column, to: str) -> DataFrame:
    """(component, to): the most frequent value, the smallest of ties."""
    n = rows.select("component", value.alias("v")).filter("v is not null").groupBy("component", "v").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("component").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("m")).select("component", F.col("m.v").alias(to))


def canonical_ids(vertices: DataFrame, components: DataFrame) -> DataFrame:
    """(component, canonical_id): PHY_ and the most frequent valid npi, else 12 hex digits of the md5 of the smallest source_id."""
    npi = _most_common(vertices.join(components, "id"), _npi(), "npi")
    return components.select("component").distinct().join(npi, "component", "left").select("component", F.concat(F.lit("PHY_"), F.coalesce("npi", F.substring(F.md5("component"), 1, 12))).alias("canonical_id"))


def source_mapping(vertices: DataFrame, components: DataFrame) -> DataFrame:
    """(source_id, canonical_id)."""
    return components.join(canonical_ids(vertices, components), "component").select(F.col("id").alias("source_id"), "canonical_id")


def id_stats(mapping: DataFrame) -> DataFrame:
    by = F.col("canonical_id").rlike("^PHY_[0-9]{10}$")
    return mapping.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("entities"), F.count_if(by).alias("npi_based"), F.count_if(~by).alias("hash_based"), F.sum("n").alias("records"), F.avg("n").alias("records_each"))


def entity_confidence(vertices: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, confidence)."""
    s = _sizes(vertices, edges, components)
    lone = vertices.join(components, "id").groupBy("component").agg(F.max(_lookup(PRIOR, F.col("source"), 0.5)).alias("prior"))
    c = F.col
    value = 0.30 * c("avg_weight") + 0.15 * c("min_weight") + 0.15 * c("density") + 0.25 * F.when(c("npi_count") <= 1, 1.0).otherwise(0.3) + 0.15 * F.least(c("source_count") / 3.0, F.lit(1.0))
    score = F.when(c("size") == 1, c("prior")).when(c("edges") == 0, 0.3).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
    return s.join(lone, "component").select("component", score.alias("confidence"))


def record_confidence(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(source_id, confidence): 0.8 alone, 0.4 without edges, else 0.6 of the mean and 0.4 of the largest weight of its edges."""
    ends = edges.select(F.col("src").alias("id"), "weight").unionByName(edges.select(F.col("dst").alias("id"), "weight"))
    w = ends.groupBy("id").agg(F.avg("weight").alias("mean"), F.max("weight").alias("most"))
    n = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * F.col("mean") + 0.4 * F.col("most")))
    return components.join(n, "component").join(w, "id", "left").select(F.col("id").alias("source_id"), F.when(F.col("n") == 1, 0.8).when(F.col("mean").isNull(), 0.4).otherwise(value).alias("confidence"))


def merge_clusters(vertices: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """One row a cluster: canonical_id, npi, name, specialty, primary_facility, city, state, confidence, source_count, all_facilities, source_records.

    name: of the best source, the longest, the smallest. specialty: the most
    frequent but for case, in the best source's spelling. primary_facility: the
    most frequent, then of the best source. Values are counted before they are
    ranked, so a cluster of any size is spread over tasks; the two lists hold a
    cluster's own ids and facilities.
    """
    rows = vertices.join(components, "id").withColumn("priority", _lookup(PRIORITY, F.col("source"), 0))
    text = lambda c: given(strip(F.col(c)))
    name = rows.filter(given(F.col("name_raw")).isNotNull()).groupBy("component").agg(F.min(F.struct((-F.col("priority")).alias("p"), (-F.length("name_raw")).alias("l"), "name_raw")).alias("m")).select("component", F.col("m.name_raw").alias("name"))
    spelt = rows.select("component", F.upper(text("specialty")).alias("k"), text("specialty").alias("v"), "priority").filter("k is not null").groupBy("component", "k").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("priority")).alias("p"), "v")).alias("best"))
    specialty = spelt.groupBy("component").agg(F.min(F.struct((-F.col("n")).alias("n"), "k", "best.v")).alias("m")).select("component", F.col("m.v").alias("specialty"))
    at = rows.select("component", text("facility_name").alias("v"), "priority").filter("v is not null").groupBy("component", "v").agg(F.count(F.lit(1)).alias("n"), F.max("priority").alias("p"))
    facility = at.groupBy("component").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("p")).alias("p"), "v")).alias("m"), F.sort_array(F.collect_list("v")).alias("all_facilities")).select("component", F.col("m.v").alias("primary_facility"), "all_facilities")
    members = rows.groupBy("component").agg(F.count(F.lit(1)).cast("int").alias("source_count"), F.sort_array(F.collect_list("id")).alias("source_records"))
    out = members.join(canonical_ids(vertices, components), "component").join(_most_common(rows, _npi(), "npi"), "component", "left")
    for part in (name, specialty, facility, _most_common(rows, text("facility_city"), "city"), _most_common(rows, text("facility_state"), "state"), entity_confidence(vertices, edges, components)):
        out = out.join(part, "component", "left")
    return out.select("canonical_id", "npi", "name", "specialty", "primary_facility", "city", "state", "confidence", "source_count", F.coalesce("all_facilities", F.array().cast("array<string>")).alias("all_facilities"), "source_records")


def npi_to_canonical(records: DataFrame, mapping: DataFrame, order: str = "record_id") -> DataFrame:
    """(npi, canonical_id): of the last record with the npi."""
    own = records.filter(given(F.col("npi")).isNotNull()).join(mapping, "source_id")
    return own.groupBy("npi").agg(F.max_by("canonical_id", order).alias("canonical_id"))


def repeated_ids(entities: DataFrame) -> DataFrame:
    """(canonical_id, n) of ids that several clusters share, as pruned clusters of one npi do."""
    return entities.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
