"""CSV sources, all columns as strings."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File and columns of each source.
SOURCES = {
    "cms": ("cms_claims.csv", "source_id npi provider_name provider_specialty facility_name facility_npi procedure_code procedure_date patient_id true_physician_id"),
    "license": ("state_licenses.csv", "source_id license_number physician_name specialty license_state license_status address_line1 address_city address_state address_zip medical_school graduation_year true_physician_id"),
    "hospital": ("hospital_affiliations.csv", "source_id hospital_id hospital_name physician_name department title phone email start_date npi true_physician_id"),
    "publication": ("publications.csv", "source_id publication_id title author_name author_position author_affiliation publication_date journal true_physician_id"),
    "referral": ("referrals.csv", "referring_npi receiving_npi patient_id referral_date diagnosis_code referring_true_id receiving_true_id"),
    "ground_truth": ("ground_truth.csv", "source_id true_physician_id source"),
}
#: Texts read as missing.
NA_VALUES = ("", "NA", "N/A", "NULL", "None", "NaN", "nan", "null", "n/a", "<NA>")


def read_csv(spark: SparkSession, path: str, na_values: Sequence[str] = NA_VALUES) -> DataFrame:
    """A CSV file with a header, every column a string; quotes are doubled inside quotes, fields may hold line breaks. A missing file raises."""
    with_header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False)
    df = with_header.csv(path)
    return df.select(*(F.when(~F.col(f"`{c}`").isin(*na_values), F.col(f"`{c}`")).alias(c) for c in df.columns))


def load(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """One source with its own columns in order; columns that the file lacks are null, others are kept behind them."""
    file, names = SOURCES[source]
    df = read_csv(spark, str(Path(folder) / file))
    wanted = names.split()
    have = [F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(T.StringType()).alias(c) for c in wanted]
    return df.select(*have, *(F.col(f"`{c}`") for c in df.columns if c not in wanted))


def load_all(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five sources of a run; raises if a file is missing."""
    return {s: load(spark, s, folder) for s in SOURCES if s != "ground_truth"}


def load_ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, "ground_truth", folder)


def load_centroids(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(zip, latitude, longitude) of a CSV file or, where there is none or it can't be read, the defaults."""
    from linkwright.functions.geo import default_centroids

    if path and Path(path).exists():
        df = read_csv(spark, path)
        if {"zip", "latitude", "longitude"} <= set(df.columns):
            return df.select(F.lpad("zip", 5, "0").alias("zip"), F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"))
    return default_centroids(spark).drop("ordinal")


def load_exports(spark: SparkSession, run: str) -> dict[str, DataFrame]:
    """The tables that a run exported, by name, for search."""
    exports = Path(run) / "exports"
    return {p.stem: read_csv(spark, str(p)) for p in sorted(exports.glob("*.csv"))}
