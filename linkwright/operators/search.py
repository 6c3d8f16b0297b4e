"""Interactive queries over entities, scores and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Colours of relations and specialties in a drawing.
RELATION_COLORS = {"referral_in": "#4ecdc4", "referral_out": "#45b7d1", "colleague": "#96ceb4"}
SPECIALTY_COLORS = (("CARDIO", "#ff6b6b"), ("SURGERY", "#4ecdc4"), ("ORTHO", "#4ecdc4"), ("MEDICINE", "#45b7d1"), ("INTERNAL", "#45b7d1"), ("PEDIATRIC", "#96ceb4"), ("ONCOLOGY", "#dda0dd"))
DEFAULT_COLOR = "#97c2fc"


def apply_filters(df: DataFrame, states: list[str] | None = None, specialties: list[str] | None = None, min_confidence: float | None = None, name: str | None = None, columns: tuple[str, str, str, str] = ("state", "specialty", "confidence", "name")) -> DataFrame:
    """Rows that pass every filter given; a filter on a column that isn't there is ignored. name is a pattern, whatever the case; rows without a name don't match it."""
    state, specialty, confidence, names = columns
    if states and state in df.columns:
        df = df.filter(F.col(state).isin(*states))
    if specialties and specialty in df.columns:
        df = df.filter(F.col(specialty).isin(*specialties))
    if min_confidence and confidence in df.columns:
        df = df.filter(F.col(confidence) >= min_confidence)
    if name and names in df.columns:
        df = df.filter(F.coalesce(F.col(names).rlike(f"(?i){name}"), F.lit(False)))
    return df


def choices(df: DataFrame, column: str) -> DataFrame:
    """The values of a column that are there, sorted."""
    return df.select(column).dropna().distinct().orderBy(column)


def headline(entities: DataFrame, confidence: str = "confidence") -> DataFrame:
    """One row: entities, mean confidence, entities with npi, mean source count."""
    return entities.agg(F.count(F.lit(1)).alias("entities"), F.avg(confidence).alias("avg_confidence"), F.count("npi").alias("with_npi"), F.avg("source_count").alias("avg_sources"))


def with_influence(entities: DataFrame, scores: DataFrame, key: str = "canonical_id") -> DataFrame:
    """entities with their score, 0 where there is none."""
    s = scores.select(F.col(scores.columns[0]).alias(key), F.col("score").alias("influence"))
    return entities.join(s, key, "left").withColumn("influence", F.coalesce("influence", F.lit(0.0)))


def influence_by(entities: DataFrame, group: str = "specialty", n: int = 15) -> DataFrame:
    """Mean, sum and number of influence by group, the n largest sums; rows without a group are left out."""
    return entities.filter(F.col(group).isNotNull()).groupBy(group).agg(F.avg("influence").alias("mean"), F.sum("influence").alias("total"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("total"), group).limit(n)


def influence_histogram(entities: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, n) over the positive influences, equal widths from the least to the most; the most falls in the last bin."""
    positive = entities.filter("influence > 0").select("influence")
    ends = positive.agg(F.min("influence").alias("lo"), F.max("influence").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("influence") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return positive.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def provenance(entities: DataFrame, mapping: DataFrame, records: DataFrame, name: str | None = None, npi: str | None = None, canonical_id: str | None = None, key: str = "canonical_id") -> DataFrame:
    """(canonical_id, source_id, source, name_raw): the records behind the entities found by name pattern, npi or id."""
    if name:
        entities = entities.filter(F.coalesce(F.col("name").rlike(f"(?i){name}"), F.lit(False)))
    if npi:
        entities = entities.filter(F.col("npi") == npi)
    if canonical_id:
        entities = entities.filter(F.col(key) == canonical_id)
    found = entities.select(F.col(key).alias("canonical_id"))
    members = mapping.select("source_id", "canonical_id").distinct().join(found, "canonical_id")
    return members.join(records.select("source_id", "source", "name_raw"), "source_id").select("canonical_id", "source_id", "source", "name_raw").distinct()


def specialty_color(c: Column) -> Column:
    up = F.upper(F.coalesce(c, F.lit("")))
    out = F.when(up == "", DEFAULT_COLOR)
    for word, color in SPECIALTY_COLORS:
        out = out.when(up.contains(word), color)
    return out.otherwise(DEFAULT_COLOR)


def network_nodes(scores: DataFrame, entities: DataFrame, n: int = 30, key: str = "canonical_id") -> DataFrame:
    """(id, label, size, color) of the n entities with the largest scores."""
    top = scores.select(F.col(scores.columns[0]).alias("id"), "score").orderBy(F.desc("score"), "id").limit(n)
    return top.join(entities.withColumnRenamed(key, "id"), "id").select("id", F.substring(F.coalesce("name", "id"), 1, 20).alias("label"), (10 + F.col("score") * 1000).alias("size"), specialty_color(F.col("specialty")).alias("color"))


def ego_nodes(ego: DataFrame) -> DataFrame:
    """(id, relation, color) of an ego network."""
    colors = F.create_map(*[F.lit(x) for kv in RELATION_COLORS.items() for x in kv])
    return ego.select("id", "relation", F.coalesce(F.element_at(colors, F.col("relation")), F.lit(DEFAULT_COLOR)).alias("color"))
