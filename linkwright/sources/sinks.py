"""Exports, reports and database tables."""

from __future__ import annotations

import json
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.functions.names import given

# Columns of the exported and stored tables.
PHYSICIAN_COLUMNS = ("canonical_id", "npi", "name", "specialty", "primary_facility", "city", "state", "confidence", "source_count")
ROW_COLUMNS = ("source", "source_id", "npi", "name_raw", "name_first", "name_last", "name_middle", "specialty", "facility_name", "facility_city", "facility_state", "facility_zip", "latitude", "longitude")
TABLES = {
    "source_records": "source string, source_id string, npi string, name_raw string, name_first string, name_last string, name_middle string, specialty string, facility_name string, facility_city string, facility_state string, facility_zip string, latitude decimal(10,7), longitude decimal(10,7), created_at timestamp",
    "canonical_physicians": "id string, npi string, name string, specialty string, primary_facility string, city string, state string, confidence_score decimal(4,3), source_count int, created_at timestamp, updated_at timestamp",
    "source_canonical_mapping": "source_id string, canonical_id string, confidence decimal(4,3), match_type string",
    "match_pairs": "id string, source_id_1 string, source_id_2 string, similarity_score decimal(4,3), match_decision string, match_type string, created_at timestamp",
    "referrals": "referring_id string, receiving_id string, referral_count int, last_referral_date date",
    "influence_scores": "physician_id string, pagerank_score decimal(10,8), in_referral_count int, out_referral_count int, computed_at timestamp",
}
BATCH = 1000


def write_csv(df: DataFrame, path: str | Path, single: bool = True) -> None:
    """A CSV with a header. single: one file of that name, for results that fit one (reports, small exports); else a folder of parts."""
    path = Path(path)
    if not single:
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(str(path))
        return
    parts = path.with_suffix(".parts")
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(str(parts))
    shutil.move(next(parts.glob("part-*.csv")), path)
    shutil.rmtree(parts)


def export(entities: DataFrame, mapping: DataFrame, scores: DataFrame, reports: dict[str, dict], folder: str | Path) -> None:
    """canonical_physicians.csv, source_to_canonical_mapping.csv, influence_scores.csv (by score, if there are any) and a JSON file for each report."""
    exports, at = Path(folder) / "exports", Path(folder) / "reports"
    for p in (exports, at):
        p.mkdir(parents=True, exist_ok=True)
    write_csv(entities.select(*PHYSICIAN_COLUMNS), exports / "canonical_physicians.csv")
    write_csv(mapping.select("source_id", "canonical_id"), exports / "source_to_canonical_mapping.csv")
    if not scores.isEmpty():
        write_csv(scores.orderBy(F.desc("score"), "canonical_id"), exports / "influence_scores.csv")
    for name, report in reports.items():
        (at / f"{name}.json").write_text(json.dumps(report, indent=2, default=str))


def record_rows(records: DataFrame) -> DataFrame:
    """The columns of the stored table: no suffix, no address."""
    return records.select(*ROW_COLUMNS)


def create_tables(spark: SparkSession, database: str = "default") -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def drop_tables(spark: SparkSession, database: str = "default") -> None:
    for name in reversed(TABLES):
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")


def insert_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = BATCH) -> None:
    """Rows into a database table, in batches, from all tasks at once."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).mode(mode).save()


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("source", "source_id")) -> DataFrame:
    """old with the rows of new put in place of those of equal keys; of rows of new with equal keys one is kept (the largest as a whole)."""
    best = new.groupBy(*keys).agg(F.max(F.struct(*(c for c in new.columns if c not in keys))).alias("_v")).select(*keys, "_v.*").select(*new.columns)
    return old.join(best.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(best, allowMissingColumns=True)


def seed_rows(exported: DataFrame) -> DataFrame:
    """canonical_physicians as stored from its export: empty strings null, numbers cast."""
    text = [given(F.col(c)).alias(c) for c in ("npi", "name", "specialty", "primary_facility", "city", "state")]
    return exported.select(F.col("canonical_id").alias("id"), *text, given(F.col("confidence")).cast("decimal(4,3)").alias("confidence_score"), given(F.col("source_count")).cast("int").alias("source_count"))


def seed_scores(exported: DataFrame) -> DataFrame:
    return exported.select(F.col("canonical_id").alias("physician_id"), given(F.col("score")).cast("decimal(10,8)").alias("pagerank_score"))
