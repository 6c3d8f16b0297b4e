"""Reports on records, matches, clusters and entities, as small DataFrames; to_dict() makes one nested dict of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.functions.names import given

KEY_COLUMNS = ("npi", "specialty", "facility_name", "facility_state", "source")


def _has(c: str) -> Column:
    return given(F.col(c)).isNotNull()


def source_coverage(records: DataFrame) -> DataFrame:
    """A row for each source and one for all (source null): records and the shares that have npi, last name, specialty and state; distinct npis and states."""
    share = lambda c: (F.count_if(_has(c)) / F.count(F.lit(1)))
    return records.rollup("source").agg(
        F.count(F.lit(1)).alias("records"), share("npi").alias("npi_coverage"), share("name_last").alias("name_coverage"), share("specialty").alias("specialty_coverage"), share("facility_state").alias("location_coverage"),
        F.count_distinct(given(F.col("npi"))).alias("unique_npis"), F.count_distinct(given(F.col("facility_state"))).alias("unique_states"),
    )


def missing_values(df: DataFrame) -> DataFrame:
    """(column, missing): nulls and empty strings of every column, in one pass."""
    counts = df.agg(*(F.count_if(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) == "").alias(c) for c in df.columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing")) for c in df.columns))).alias("x")).select("x.*")


def distinct_values(df: DataFrame, columns: tuple[str, ...] = KEY_COLUMNS) -> DataFrame:
    use = [c for c in columns if c in df.columns]
    counts = df.agg(*(F.count_distinct(F.col(c)).alias(c) for c in use))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("distinct")) for c in use))).alias("x")).select("x.*")


def npi_names(records: DataFrame) -> DataFrame:
    """(npi, names, spellings) of npis with more than one distinct "LAST, FIRST"."""
    key = F.concat(F.upper("name_last"), F.lit(", "), F.coalesce(F.upper("name_first"), F.lit("")))
    pairs = records.filter(_has("npi") & _has("name_last")).select("npi", key.alias("name")).distinct()
    return pairs.groupBy("npi").agg(F.count(F.lit(1)).alias("names"), F.array_join(F.sort_array(F.collect_list("name")), "; ").alias("spellings")).filter("names > 1")


def duplicate_npis(records: DataFrame, examples: int = 10) -> dict:
    """Counts of npis and of those with several names, and the first examples by npi."""
    total = records.filter(_has("npi") & _has("name_last")).agg(F.count_distinct("npi")).first()[0]
    many = npi_names(records)
    return {"total_npis": total, "npis_with_multiple_names": many.count(), "examples": {r["npi"]: r["spellings"].split("; ") for r in many.orderBy("npi").limit(examples).collect()}}


def decisions(matches: DataFrame) -> DataFrame:
    """(decision, pairs, share)."""
    return matches.groupBy("decision").agg(F.count(F.lit(1)).alias("pairs")).withColumn("share", F.col("pairs") / F.sum("pairs").over(Window.partitionBy()))


def match_types(matches: DataFrame) -> DataFrame:
    return matches.filter("decision = 'match'").groupBy("match_type").agg(F.count(F.lit(1)).alias("pairs"))


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., median): of n sorted values the one at n div 2, counted from 0; taken from value counts, so no group is collected."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    at = n.withColumns({"_upto": F.sum("_n").over(Window.partitionBy(*by).orderBy("_value")), "_all": F.sum("_n").over(Window.partitionBy(*by))})
    return at.filter(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*by).agg(F.min("_value").alias("median"))


def score_stats(matches: DataFrame, by: str = "decision", value: str = "overall") -> DataFrame:
    s = matches.groupBy(by).agg(F.count(value).alias("pairs"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))
    return s.join(upper_median(matches, [by], value), by, "left")


def confidence_classes(matches: DataFrame) -> DataFrame:
    """One row over the matches: confidence of 0.9 and more, 0.7 to 0.9, less."""
    c = F.col("confidence")
    return matches.filter("decision = 'match'").agg(F.count_if(c >= 0.9).alias("high"), F.count_if((c >= 0.7) & (c < 0.9)).alias("medium"), F.count_if(c < 0.7).alias("low"))


def npi_report(matches: DataFrame) -> DataFrame:
    m = F.col("npi_match")
    return matches.agg(F.count_if(m == 1.0).alias("exact"), F.count_if(m == 0.0).alias("conflict"), F.count_if(m.isNull()).alias("unavailable"), (F.count_if(m == 1.0) / F.nullif(F.count(m), F.lit(0))).alias("rate"))


def low_confidence(matches: DataFrame, below: float = 0.7, n: int = 20) -> DataFrame:
    return matches.filter((F.col("decision") == "match") & (F.col("confidence") < below)).orderBy("confidence", "source_id_1", "source_id_2").limit(n)


def cluster_sizes(components: DataFrame) -> DataFrame:
    """One row: clusters, records, least, most, mean and upper median size, and six classes of size."""
    s = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    within = lambda a, b, name: F.count_if(n.between(a, b)).alias(name)
    row = s.agg(
        F.count(F.lit(1)).alias("clusters"), F.sum(n).alias("records"), F.min(n).alias("least"), F.max(n).alias("most"), F.avg(n).alias("mean"),
        within(1, 1, "singletons"), within(2, 2, "pairs"), within(3, 5, "small"), within(6, 10, "medium"), within(11, 20, "large"), F.count_if(n > 20).alias("very_large"),
    )
    return row.crossJoin(upper_median(s, [], "n"))


def sources_per_cluster(vertices: DataFrame, components: DataFrame) -> DataFrame:
    """(sources, clusters)."""
    per = vertices.join(components, "id").groupBy("component").agg(F.count_distinct("source").alias("sources"))
    return per.groupBy("sources").agg(F.count(F.lit(1)).alias("clusters"))


def entity_report(entities: DataFrame, confidence: str = "confidence") -> DataFrame:
    """One row: entities, share with npi, classes and range of confidence, range of source counts."""
    c = F.col(confidence)
    return entities.agg(
        F.count(F.lit(1)).alias("entities"), (F.count_if(_has("npi")) / F.count(F.lit(1))).alias("npi_coverage"), F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"), F.count_if(c < 0.5).alias("low"),
        F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"), F.avg(c).alias("mean_confidence"), F.min("source_count").alias("min_sources"), F.max("source_count").alias("max_sources"), F.avg("source_count").alias("mean_sources"),
    )


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values that are there; ties by the smaller value."""
    return df.filter(_has(column)).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def pair_evaluation(components: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: pairs predicted, true, both; precision, recall, f1. components: (id, component), truth: (id, true_id).

    Pairs are counted from group sizes, never made. Records without a label
    count in predicted pairs and in no true ones.
    """
    pairs = lambda df, by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).cast("long").alias("p"))
    t = truth.filter("true_id is not null").select("id", "true_id").distinct()
    both = components.join(t, "id")
    row = pairs(components, ["component"]).withColumnRenamed("p", "predicted").crossJoin(pairs(t, ["true_id"]).withColumnRenamed("p", "actual")).crossJoin(pairs(both, ["component", "true_id"]).withColumnRenamed("p", "correct"))
    precision = F.when(F.col("predicted") > 0, F.col("correct") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("actual") > 0, F.col("correct") / F.col("actual")).otherwise(0.0)
    return row.withColumns({"precision": precision, "recall": recall}).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def wrong_groups(components: DataFrame, truth: DataFrame) -> DataFrame:
    """(kind, group, others): clusters of several true entities ('merged') and true entities in several clusters ('split')."""
    both = components.join(truth.filter("true_id is not null"), "id")
    merged = both.groupBy(F.col("component").alias("group")).agg(F.count_distinct("true_id").alias("others")).select(F.lit("merged").alias("kind"), "group", "others")
    split = both.groupBy(F.col("true_id").alias("group")).agg(F.count_distinct("component").alias("others")).select(F.lit("split").alias("kind"), "group", "others")
    return merged.unionByName(split).filter("others > 1")


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def data_quality_report(records: DataFrame) -> dict:
    """Coverage over all and by source, npis with several names, missing values by source: a few rows each."""
    rows = {r["source"]: r for r in _rows(source_coverage(records))}
    by_source = {s: {x["column"]: x["missing"] for x in _rows(missing_values(records.filter(F.col("source") == s)))} for s in sorted(x for x in rows if x)}
    return {"overall": rows.get(None, {}), "sources": {s: r for s, r in rows.items() if s}, "duplicate_npis": duplicate_npis(records), "missing": by_source}


def match_quality_report(matches: DataFrame) -> dict:
    return {
        "decisions": _rows(decisions(matches)), "types": _rows(match_types(matches)), "scores": _rows(score_stats(matches)), "confidence": _rows(confidence_classes(matches))[0],
        "npi": _rows(npi_report(matches))[0], "low_confidence": _rows(low_confidence(matches)),
    }


def cluster_report(vertices: DataFrame, quality: DataFrame, summary: DataFrame, components: DataFrame, entities: DataFrame) -> dict:
    return {
        "sizes": _rows(cluster_sizes(components))[0], "quality": _rows(summary), "issues": _rows(quality.filter("has_issues").orderBy("component").limit(10)), "sources": _rows(sources_per_cluster(vertices, components)),
        "entities": _rows(entity_report(entities))[0], "top_states": _rows(top_values(entities, "state")), "top_specialties": _rows(top_values(entities, "specialty")),
    }
