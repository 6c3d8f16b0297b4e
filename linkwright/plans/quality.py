"""Queries on the quality of source_records' loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.operators.profile import profile, unusual_loads, value_counts
from linkwright.storage import stored

FIELDS = ("npi", "facility_zip", "facility_state")


def well_formed(zips: DataFrame) -> dict:
    """Well-formed values of the three fields; states are those of zip_centroids, a reference list that doesn't grow."""
    states = [r["state"] for r in zips.select("state").filter("state is not null").distinct().limit(1001).collect()]
    if len(states) > 1000:
        raise ValueError("more than 1000 states")
    return {
        "npi": F.col("value").rlike(r"\A[0-9]{10}\z"),
        "facility_zip": F.col("value").rlike(r"\A[0-9]{5}(-[0-9]{4})?\z"),
        "facility_state": F.col("value").isin(states),
    }


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = spark.read.parquet(f"{sf_dir}/source_records.parquet").select("source", "load_id", *FIELDS)
    return stored(value_counts(records, FIELDS, ("source", "load_id")), "profile")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = well_formed(spark.read.parquet(f"{sf_dir}/zip_centroids.parquet"))
    return unusual_loads(_counts(spark, sf_dir), tests, "load_id", "source").select("load_id", "field", "finding")


def p5_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = well_formed(spark.read.parquet(f"{sf_dir}/zip_centroids.parquet"))
    counts = _counts(spark, sf_dir)
    return profile(counts, tests, ("source", "load_id")).select(
        "source", "load_id", "field", "n_rows", "n_missing", "n_malformed", "n_distinct", "least", "greatest", "top_value", "top_rows", F.round("entropy", 6).alias("entropy"), F.round("share_missing", 6).alias("share_missing"), F.round("share_malformed", 6).alias("share_malformed")
    )


_MARKED = r"""
with u as (
  select source, load_id, 'npi' as field, npi as value from source_records
  union all select source, load_id, 'facility_zip', facility_zip from source_records
  union all select source, load_id, 'facility_state', facility_state from source_records),
m as (
  select *, (value is null or replace(value, ' ', '') = '') as missing,
    coalesce(case field when 'npi' then regexp_full_match(value, '[0-9]{10}')
         when 'facility_zip' then regexp_full_match(value, '[0-9]{5}(-[0-9]{4})?')
         else value in (select state from zip_centroids where state is not null) end, false) as formed from u),
w as (select *, not missing and formed as well from m)
"""

P5_FOUND_SQL = (
    _MARKED
    + """,
s as (
  select source, load_id, field, avg(case when missing then 1.0::double else 0 end) as missing_share,
    case when count(*) filter (not missing) > 0 then count(*) filter (not missing and not well) / (count(*) filter (not missing))::double end as malformed_share
  from w group by all),
t as (select source, load_id, field, max(n) / sum(n)::double as top_share from (select source, load_id, field, value, count(*) as n from w where well group by all) group by all),
l as (
  select source, load_id, field, 'missing' as finding, missing_share as share from s
  union all select source, load_id, field, 'malformed', malformed_share from s where malformed_share is not null
  union all select source, load_id, field, 'repeated', top_share from t),
a as (select load_id, field, finding from (select *, median(share) over (partition by source, field, finding) as usual from l) where share - usual > 0.25),
c as (select source, load_id, field, substr(value, 1, 1) as f, count(*) as n from w where well group by all),
q as (select source, field, f, sum(n) / sum(sum(n)) over (partition by source, field)::double as q from c group by source, field, f),
tot as (select source, load_id, field, sum(n) as total from c group by all),
d as (
  select tot.load_id, tot.source, tot.field, sum(abs(coalesce(c.n, 0) / total::double - q.q)) / 2 as distance
  from tot join q using (source, field) left join c on c.source = tot.source and c.load_id = tot.load_id and c.field = tot.field and c.f = q.f group by all)
select load_id, field, finding from a union select load_id, field, 'shifted' from d where distance > 0.4
"""
)

P5_PROFILE_SQL = (
    _MARKED
    + """,
v as (select source, load_id, field, value, bool_or(missing) as missing, bool_or(well) as well, count(*) as n from w group by all),
p as (select *, n / sum(n) over (partition by source, load_id, field)::double as p from v)
select source, load_id, field, sum(n)::bigint as n_rows, coalesce(sum(n) filter (missing), 0)::bigint as n_missing, coalesce(sum(n) filter (not missing and not well), 0)::bigint as n_malformed,
  count(*) filter (not missing) as n_distinct, min(value) filter (not missing) as least, max(value) filter (not missing) as greatest,
  arg_min(value, {'n': -n, 'v': value}) filter (well) as top_value, max(n) filter (well) as top_rows, round(sum(-p * log2(p)), 6) as entropy,
  round(coalesce(sum(n) filter (missing), 0) / sum(n)::double, 6) as share_missing,
  case when sum(n) filter (not missing) > 0 then round(coalesce(sum(n) filter (not missing and not well), 0) / (sum(n) filter (not missing))::double, 6) end as share_malformed
from p group by source, load_id, field
"""
)

QUERIES = {"p5_found": p5_found, "p5_profile": p5_profile}
ORACLE_SQL = {"p5_found": P5_FOUND_SQL, "p5_profile": P5_PROFILE_SQL}
