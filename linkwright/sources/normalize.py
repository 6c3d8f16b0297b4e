"""The four record sources in one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.functions.geo import geocode
from linkwright.functions.names import given, parse_name, strip

# Columns of a record, in order.
RECORD = ("source", "source_id", "npi", "name_raw", "name_first", "name_last", "name_middle", "name_suffix", "specialty", "facility_name", "facility_address", "facility_city", "facility_state", "facility_zip")


def _text(df: DataFrame, name: str) -> Column:
    return given(F.col(f"`{name}`")) if name in df.columns else F.lit(None).cast("string")


def _ordinal(df: DataFrame) -> DataFrame:
    return df.withColumn("_row", F.monotonically_increasing_id())


def _id(df: DataFrame, source: str, *parts: Column | str) -> Column:
    """source_id of the file, else the first 16 hex digits of the md5 of the row's own fields."""
    key = F.concat_ws("_", F.lit(source), *(F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.col(p).cast("string") for p in parts))
    return F.coalesce(_text(df, "source_id"), F.substring(F.md5(key), 1, 16))


def _record(df: DataFrame, source: str, source_id: Column, name: str, **columns: Column) -> DataFrame:
    parsed = df.withColumn("_name", parse_name(_text(df, name))).withColumn("_id", source_id)
    null = F.lit(None).cast("string")
    values = {"source": F.lit(source), "source_id": F.col("_id"), "name_raw": _text(df, name), "name_first": F.col("_name.first"), "name_last": F.col("_name.last"), "name_middle": F.col("_name.middle"), "name_suffix": F.col("_name.suffix"), **columns}
    return parsed.select(*(values.get(c, null).alias(c) for c in RECORD), *(columns.get(c, F.lit(None).cast("double")).alias(c) for c in ("latitude", "longitude")))


def normalize_cms(df: DataFrame) -> DataFrame:
    """npi is null if it holds an X."""
    df = _ordinal(df)
    npi = _text(df, "npi")
    own = F.when(npi.isNotNull(), F.concat_ws("_", F.lit("cms"), npi, F.coalesce(_text(df, "procedure_date"), F.lit("")), F.col("_row").cast("string"))).otherwise(F.concat_ws("_", F.lit("cms"), F.col("_row").cast("string")))
    source_id = F.coalesce(_text(df, "source_id"), F.substring(F.md5(own), 1, 16))
    return _record(df, "cms", source_id, "provider_name", npi=F.when(~npi.contains("X"), npi), specialty=_text(df, "provider_specialty"), facility_name=_text(df, "facility_name"))


def normalize_licenses(df: DataFrame, centroids: DataFrame) -> DataFrame:
    """No npi; address and zip centroid."""
    df = geocode(_ordinal(df), "address_zip", centroids)
    number = F.coalesce(_text(df, "license_number"), F.col("_row").cast("string"))
    return _record(
        df, "license", _id(df, "license", number), "physician_name", specialty=_text(df, "specialty"), facility_address=_text(df, "address_line1"), facility_city=_text(df, "address_city"),
        facility_state=F.coalesce(_text(df, "address_state"), _text(df, "license_state")), facility_zip=_text(df, "address_zip"), latitude=F.col("latitude"), longitude=F.col("longitude"),
    )


def normalize_hospitals(df: DataFrame) -> DataFrame:
    """The department is the specialty; the npi is kept as it is."""
    df = _ordinal(df)
    return _record(df, "hospital", _id(df, "hospital", _text(df, "hospital_id"), _text(df, "physician_name"), "_row"), "physician_name", npi=_text(df, "npi"), specialty=_text(df, "department"), facility_name=_text(df, "hospital_name"))


def normalize_publications(df: DataFrame) -> DataFrame:
    """The affiliation holds facility, city and state: a last part of two letters is the state, the part before it the city if there are more than two; without a comma nothing is taken."""
    df = _ordinal(df)
    parts = F.transform(F.split(_text(df, "author_affiliation"), ","), strip)
    several = F.size(parts) >= 2
    state = several & (F.length(F.element_at(parts, -1)) == 2)
    return _record(
        df, "publication", _id(df, "pub", _text(df, "publication_id"), _text(df, "author_name"), "_row"), "author_name", facility_name=F.when(several, given(parts[0])),
        facility_city=F.when(state & (F.size(parts) > 2), F.element_at(parts, -2)), facility_state=F.when(state, F.upper(F.element_at(parts, -1))),
    )


def normalize_all(sources: dict[str, DataFrame], centroids: DataFrame) -> DataFrame:
    """All records of cms, license, hospital and publication."""
    out = normalize_cms(sources["cms"])
    for df in (normalize_licenses(sources["license"], centroids), normalize_hospitals(sources["hospital"]), normalize_publications(sources["publication"])):
        out = out.unionByName(df)
    return out
