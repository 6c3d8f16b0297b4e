"""Queries for the operators on records, pairs and the identity graph, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.functions.geo import distance_miles, geocode, nearby
from linkwright.functions.names import SUFFIXES, TITLES, display_name, names_match, parse_name, standardize_name
from linkwright.functions.similarity import classify, location_score, score_pairs
from linkwright.operators import blocking, canonical, graph, matching, pruning, reports
from linkwright.storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.latest_records(table(spark, sf_dir, "source_records"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def identity_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices, edges and components of the stated matches of match_pairs, written once."""
    said = table(spark, sf_dir, "match_pairs").filter(F.lower(F.trim("match_decision")) == "match")
    v, e = graph.build_graph(latest(spark, sf_dir), said.select("source_id_1", "source_id_2", F.col("similarity_score").alias("weight")))
    v, e = stored(v, "vertices"), stored(e, "edges")
    return v, e, stored(graph.connected_components(v, e), "components")


REC = "rec as (select * from source_records where source_id is not null qualify row_number() over (partition by source_id order by record_id desc) = 1)"
EDGES = (
    REC
    + """,
e as (select least(source_id_1, source_id_2) as src, greatest(source_id_1, source_id_2) as dst, max(similarity_score) as weight
  from match_pairs where lower(trim(match_decision)) = 'match' and source_id_1 <> source_id_2
    and source_id_1 in (select source_id from rec) and source_id_2 in (select source_id from rec) group by 1, 2)"""
)
COMPONENTS = (
    EDGES
    + """,
both_ways as (select src as a, dst as b from e union all select dst, src from e),
reach(id, r) as (select source_id, source_id from rec union select reach.id, both_ways.b from reach join both_ways on reach.r = both_ways.a where both_ways.b < reach.id or both_ways.b > reach.id),
comp as (select id, min(r) as component from reach group by id)"""
)
SIZES = (
    COMPONENTS
    + """,
v as (select comp.component, count(*) as size, count(distinct nullif(npi, '')) as npi_count, count(distinct nullif(facility_state, '')) as state_count,
    count(distinct nullif(specialty, '')) as specialty_count, count(distinct source) as source_count from rec join comp on rec.source_id = comp.id group by 1),
w as (select component, count(*) as edges, avg(weight) as aw, min(weight) as mw from e join comp on e.src = comp.id group by 1),
s as (select v.*, coalesce(w.edges, 0) as edges, coalesce(aw, 0) as avg_weight, coalesce(mw, 0) as min_weight,
    case when size > 1 then 2 * coalesce(w.edges, 0) / (size * (size - 1))::double else 1.0::double end as density from v left join w using (component))"""
)

# --- names ---------------------------------------------------------------------------------------------------------

_SUF = r"(?i),?\s*(" + "|".join(x.replace(".", r"\.") for x in sorted(SUFFIXES, key=len, reverse=True)) + r")\.?\s*$"
_TIT = r"(?i)^(" + "|".join(x.replace(".", r"\.") for x in sorted(TITLES, key=len, reverse=True)) + r")\s+"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _parsed_sql() -> str:
    # One row for each suffix taken off; the last one of a record is what is left.
    hit = f"regexp_extract(x, '{_SUF}', 1)"
    steps = [
        f"n as (select record_id, name_raw, {_STRIP.format('name_raw')} as x, [] :: varchar[] as suf, 0 as k from source_records where name_raw is not null union all select record_id, name_raw, {_STRIP.format(f"regexp_replace(x, '{_SUF}', '')")}, list_prepend(replace(upper({hit}), '.', ''), suf), k + 1 from n where {hit} <> '')",
        "bare as (select record_id, name_raw, arg_max(x, k) as x, array_to_string(arg_max(suf, k), ', ') as suf from n group by 1, 2)",
        f"t as (select record_id, suf, nullif(replace(upper(regexp_extract(x, '{_TIT}', 1)), '.', ''), '') as title, regexp_replace({_STRIP.format(f"regexp_replace(x, '{_TIT}', '')")}, '\\s+', ' ', 'g') as nm, {_STRIP.format('name_raw')} = '' as blank from bare)",
    ]
    steps.append(r"u as (select *, regexp_extract(nm, '^([^,]+),\s*(.+)$', 1) as lf, string_split(regexp_extract(nm, '^([^,]+),\s*(.+)$', 2), ' ') as tail, string_split(nm, ' ') as ws from t)")
    steps.append(r"k as (select *, len(ws) as n, regexp_extract(ws[1], '^(\p{L})\.(\p{L})\.$', 1) as f1, regexp_extract(ws[1], '^(\p{L})\.(\p{L})\.$', 2) as f2 from u)")
    single = "case when {0} like '% %' then {0} when length({0}) <= 2 and length(replace({0}, '.', '')) = 1 then upper(replace({0}, '.', '')) else {0} end"
    steps.append(
        "p as (select record_id, case when blank then null when lf <> '' then tail[1] when nm = '' then null when f1 <> '' and n = 2 then f1 when n = 2 then ws[1] when n > 2 then case when length(ws[1]) <= 2 and ws[1] like '%.' then ws[1][1] else ws[1] end end as first, "
        f"case when blank then null when lf <> '' then {_STRIP.format('lf')} when nm = '' then null else ws[n] end as last, "
        f"case when blank then null when lf <> '' then case when len(tail) > 1 then {single.format("array_to_string(tail[2:], ' ')")} end when f1 <> '' and n = 2 then f2 when n > 2 then {single.format("array_to_string(ws[2:n-1], ' ')")} end as middle, "
        "case when blank then null else nullif(suf, '') end as suffix, case when blank then null else title end as title from k)"
    )
    return "with recursive " + ",\n".join(steps)


_NULLS = " union all select record_id, null, null, null, null, null from source_records where name_raw is null"


@query(_parsed_sql() + "\nselect record_id, first, last, middle, suffix, title from p" + _NULLS)
def parsed_names(spark, sf_dir):
    return table(spark, sf_dir, "source_records").select("record_id", parse_name(F.col("name_raw")).alias("p")).select("record_id", "p.*")


_FULL = "case when coalesce(l, '') = '' then {none} when coalesce(f, '') = '' then {lone} else upper(l) || ', ' || concat_ws(' ', nullif(upper(f), ''), upper(substr(nullif(m, ''), 1, 1))) end"
_N = "with n as (select record_id, name_first as f, name_last as l, name_middle as m from source_records)"


@query(f"{_N} select record_id, {_FULL.format(none="''", lone="upper(l) || ','")} as name from n")
def standardized_names(spark, sf_dir):
    return table(spark, sf_dir, "source_records").select("record_id", standardize_name(F.col("name_first"), F.col("name_last"), F.col("name_middle")).alias("name"))


@query(f"{_N} select record_id, {_FULL.format(none="coalesce(upper(f), '')", lone='upper(l)')} as name from n")
def display_names(spark, sf_dir):
    return table(spark, sf_dir, "source_records").select("record_id", display_name(F.col("name_first"), F.col("name_last"), F.col("name_middle")).alias("name"))


def _pairs(spark, sf_dir, *columns):
    pairs = table(spark, sf_dir, "match_pairs").select("id", "source_id_1", "source_id_2")
    return matching.with_records(pairs, latest(spark, sf_dir), columns)


_PAIR = f"with {REC}, p as (select m.id, a as a, b as b from match_pairs m join rec a on m.source_id_1 = a.source_id join rec b on m.source_id_2 = b.source_id)"
_KEY = r"translate(upper(regexp_replace(coalesce({}, ''), '^\s+|\s+$', '', 'g')), '-'' ', '')"
_FST = r"regexp_replace(upper(regexp_replace(coalesce({}, ''), '^\s+|\s+$', '', 'g')), '\.$', '')"


@query(
    _PAIR
    + f""", k as (select id, {_KEY.format('a.name_last')} as l1, {_KEY.format('b.name_last')} as l2, {_FST.format('a.name_first')} as f1, {_FST.format('b.name_first')} as f2 from p)
select id, l1 <> '' and l1 = l2 and (f1 = '' or f2 = '' or f1 = f2 or ((length(f1) = 1 or length(f2) = 1) and f1[1] = f2[1])) as same from k"""
)
def fuzzy_name_matches(spark, sf_dir):
    p = _pairs(spark, sf_dir, "name_first", "name_last")
    return p.select("id", names_match(*(F.col(c) for c in ("name_first_1", "name_last_1", "name_first_2", "name_last_2"))).alias("same"))


# --- places --------------------------------------------------------------------------------------------------------


@query(
    r"""with z as (select record_id, case when regexp_replace(facility_zip, '^\s+|\s+$', '', 'g') <> '' then lpad(substr(regexp_replace(facility_zip, '^\s+|\s+$', '', 'g'), 1, 5), 5, '0') end as z from source_records),
five as (select zip, arg_min({'a': latitude, 'b': longitude}, zip) as p from zip_centroids where zip is not null group by zip),
three as (select substr(zip, 1, 3) as z3, arg_min({'a': latitude, 'b': longitude}, zip) as p from zip_centroids where zip is not null group by 1)
select record_id, coalesce(five.p, three.p).a as latitude, coalesce(five.p, three.p).b as longitude from z left join five on z.z = five.zip left join three on substr(z.z, 1, 3) = three.z3"""
)
def geocoded(spark, sf_dir):
    records = table(spark, sf_dir, "source_records").select("record_id", "facility_zip")
    return geocode(records, "facility_zip", table(spark, sf_dir, "zip_centroids")).select("record_id", "latitude", "longitude")


_D = "3959.0::double * 2 * atan2(sqrt(h), sqrt(1 - h))"
_H = "sin((radians(b.latitude) - radians(a.latitude)) / 2) ** 2 + cos(radians(a.latitude)) * cos(radians(b.latitude)) * sin((radians(b.longitude) - radians(a.longitude)) / 2) ** 2"
_LOC = "case when d is not null then case when d < 0.5 then 1.0 when d < 10 then 0.8 when d < 50 then 0.5 when d < 100 then 0.3 else 0.1 end when nullif(upper(a.facility_state), '') is null or nullif(upper(b.facility_state), '') is null then 0.2 when upper(a.facility_state) = upper(b.facility_state) then 0.3 else 0.1 end::double"


@query(_PAIR + f", h as (select *, {_H} as h from p), d as (select *, {_D} as d from h) select id, round(d, 4) as miles, {_LOC} as score, coalesce(d <= 50, false) as near from d")
def location_scores(spark, sf_dir):
    p = _pairs(spark, sf_dir, "latitude", "longitude", "facility_state")
    at = [F.col(c) for c in ("latitude_1", "longitude_1", "latitude_2", "longitude_2")]
    return p.select("id", F.round(distance_miles(*at), 4).alias("miles"), location_score(*at, F.col("facility_state_1"), F.col("facility_state_2")).alias("score"), nearby(*at).alias("near"))


# --- blocks and pairs ----------------------------------------------------------------------------------------------

_LAST = r"nullif(upper(regexp_replace(name_last, '^\s+|\s+$', '', 'g')), '')"
_STATE = "coalesce(nullif(upper(facility_state), ''), 'XX')"
_BLOCK = {"npi": "nullif(npi, '')", "last_state": f"case when {_LAST} is not null then {_LAST} || '|' || {_STATE} end", "last_initial": rf"case when {_LAST} is not null and regexp_replace(name_first, '^\s+|\s+$', '', 'g') <> '' then {_LAST} || '|' || upper(substr(regexp_replace(name_first, '^\s+|\s+$', '', 'g'), 1, 1)) end"}


def _blocks_sql(kind: str) -> str:
    return f"with {REC} select block, count(*) as n from (select {_BLOCK[kind]} as block from rec) where block is not null group by 1 having count(*) >= 2"


@query(_blocks_sql("npi"))
def blocks_npi(spark, sf_dir):
    return blocking.blocks(latest(spark, sf_dir), "npi")


@query(_blocks_sql("last_state"))
def blocks_last_state(spark, sf_dir):
    return blocking.blocks(latest(spark, sf_dir), "last_state")


@query(_blocks_sql("last_initial"))
def blocks_last_initial(spark, sf_dir):
    return blocking.blocks(latest(spark, sf_dir), "last_initial")


# American soundex: the first letter, then the digits of those that follow, H and W passed over, runs once, vowels and other signs dropped.
_CODE = "translate({}, 'BFPVCGJKQSXZDTLMNRAEIOUYbfpvcgjkqsxzdtlmnraeiouyHWhw', '111122222222334556000000111122222222334556000000')"
_DIGITS = "(case when name_last[1] in ('H', 'W', 'h', 'w') then '7' else " + _CODE.format("name_last[1]") + " end || " + _CODE.format("regexp_replace(substr(name_last, 2), '[^A-Za-z]', '0', 'g')") + ")"
for _d in range(7):
    _DIGITS = f"regexp_replace({_DIGITS}, '{_d}{_d}+', '{_d}', 'g')"
_SOUNDEX = f"case when regexp_matches(name_last, '^[A-Za-z]') then upper(name_last[1]) || left(replace(substr({_DIGITS}, 2), '0', '') || '000', 3) else name_last end"
_BLOCK["sound_state"] = f"case when name_last <> '' then ({_SOUNDEX}) || '|' || {_STATE} end"


@query(_blocks_sql("sound_state"))
def blocks_sound_state(spark, sf_dir):
    return blocking.blocks(latest(spark, sf_dir), "sound_state")


_KEYED = f"with {REC}, k as (select source_id, {_BLOCK['npi']} as k1, {_BLOCK['last_state']} as k2 from rec)"


@query(_KEYED + " select a.source_id as source_id_1, b.source_id as source_id_2 from k a join k b on a.k1 = b.k1 and a.source_id < b.source_id union select a.source_id, b.source_id from k a join k b on a.k2 = b.k2 and a.source_id < b.source_id")
def candidate_pairs(spark, sf_dir):
    return blocking.candidate_pairs(latest(spark, sf_dir), sound=False, hot_block=1000)


_KEYED_SOUND = f"with {REC}, k as (select source_id, {_BLOCK['npi']} as k1, {_BLOCK['last_state']} as k2, {_BLOCK['sound_state']} as k3 from rec)"


@query(_KEYED_SOUND + " union ".join(f" select a.source_id as source_id_1, b.source_id as source_id_2 from k a join k b on a.{x} = b.{x} and a.source_id < b.source_id" for x in ("k1", "k2", "k3")))
def candidate_pairs_with_sound(spark, sf_dir):
    return blocking.candidate_pairs(latest(spark, sf_dir), sound=True, hot_block=1000)


# DuckDB's metric compares bytes: characters of several bytes are written as signs that upper-case names don't have.
_ONE = "translate({}, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÖØÙÚÛÜ’', 'abcdefghijklmnopqrstuvwxyz#')"
_SIM = (
    _PAIR
    + r""", k as (select id, a, b, translate(upper(regexp_replace(a.name_last, '^\s+|\s+$', '', 'g')), '''- ', '') as l1, translate(upper(regexp_replace(b.name_last, '^\s+|\s+$', '', 'g')), '''- ', '') as l2,
  upper(regexp_replace(a.name_first, '^\s+|\s+$', '', 'g')) as f1, upper(regexp_replace(b.name_first, '^\s+|\s+$', '', 'g')) as f2 from p)"""
    + f""", h as (select *, {_H} as h from k), d as (select *, {_D} as d from h),
s as (select id, case when coalesce(l1, '') = '' or coalesce(l2, '') = '' then 0 when l1 = l2 then 1 else jaro_winkler_similarity({_ONE.format('l1')}, {_ONE.format('l2')}) end as last_score,
  case when coalesce(f1, '') = '' or coalesce(f2, '') = '' then 0.5 when f1 = f2 then 1 when (length(f1) = 1 or length(f2) = 1) and f1[1] = f2[1] then 0.8 else jaro_winkler_similarity({_ONE.format('f1')}, {_ONE.format('f2')}) end as first_score,
  {_LOC} as location_score, case when regexp_full_match(a.npi, '[0-9]{{10}}') and regexp_full_match(b.npi, '[0-9]{{10}}') then case when a.npi = b.npi then 1.0::double else 0.0::double end end as npi_match from d)
select id, npi_match, round(last_score, 6) as last_score, round(first_score, 6) as first_score, round(0.6 * last_score + 0.4 * first_score, 6) as name_score, location_score from s"""
)


@query(_SIM)
def scored_pairs(spark, sf_dir):
    p = score_pairs(_pairs(spark, sf_dir, *matching.COMPARED))
    return rounded(p.select("id", "npi_match", "last_score", "first_score", "name_score", "location_score"))


@query()
def classified_pairs(spark, sf_dir):
    p = classify(score_pairs(_pairs(spark, sf_dir, *matching.COMPARED)))
    return rounded(p.select("id", "specialty_match", "overall", "decision", "confidence", "match_type"))


@query()
def found_matches(spark, sf_dir):
    return rounded(matching.find_matches(latest(spark, sf_dir)))


# --- identity graph ------------------------------------------------------------------------------------------------


@query(
    f"""with {EDGES} select src, dst, round(weight, 6) as weight, case when nullif(a.npi, '') is not null and a.npi = b.npi then 'npi_exact' when weight >= 0.85 then 'name_strong' when weight >= 0.6 then 'name_moderate' else 'weak' end as match_type
from e join rec a on e.src = a.source_id join rec b on e.dst = b.source_id"""
)
def graph_edges(spark, sf_dir):
    _, e, _ = identity_graph(spark, sf_dir)
    return rounded(e.drop("sources"))


_REL = "case {}.source when 'cms' then 1.0 when 'license' then 0.9 when 'hospital' then 0.8 when 'publication' then 0.6 else 0.5 end::double"


@query(f"with {EDGES} select src, dst, round(least(0.99, weight * (({_REL.format('a')} + {_REL.format('b')}) / 2) * case when a.source <> b.source then 1.1 else 1.0 end::double), 6) as weight from e join rec a on e.src = a.source_id join rec b on e.dst = b.source_id")
def reweighted_edges(spark, sf_dir):
    _, e, _ = identity_graph(spark, sf_dir)
    return rounded(graph.reweighted(e).select("src", "dst", "weight"))


@query(f"with recursive {COMPONENTS} select id, component from comp")
def components(spark, sf_dir):
    return identity_graph(spark, sf_dir)[2]


@query(f"with recursive {COMPONENTS}, c as (select component, count(*) as n from comp group by 1) select component, n from c")
def cluster_list(spark, sf_dir):
    return graph.clusters(identity_graph(spark, sf_dir)[2])


@query(f"with recursive {COMPONENTS}, c as (select component, row_number() over (order by count(*) desc, component) - 1 as r from comp group by 1) select id, format('CLUSTER_{{:05d}}', r) as cluster_id from comp join c using (component)")
def cluster_names(spark, sf_dir):
    return graph.cluster_names(identity_graph(spark, sf_dir)[2])


@query(f"with recursive {COMPONENTS}, c as (select count(*) as n from comp group by component) select count(*) as total, count(*) filter (n = 1) as singletons, count(*) filter (n = 2) as pairs, count(*) filter (n between 3 and 5) as small, count(*) filter (n between 6 and 10) as medium, count(*) filter (n > 10) as large from c")
def size_classes(spark, sf_dir):
    return graph.size_classes(identity_graph(spark, sf_dir)[2])


@query(f"with recursive {COMPONENTS} select size, count(*) as clusters from (select count(*) as size from comp group by component) group by 1")
def size_histogram(spark, sf_dir):
    return graph.size_histogram(identity_graph(spark, sf_dir)[2])


@query(f"with recursive {COMPONENTS}, x as (select (select count(*) from rec) as nodes, (select count(*) from e) as edges, (select count(distinct component) from comp) as components) select *, round(2 * edges / (nodes * (nodes - 1))::double, 6) as density, round(2 * edges / nodes::double, 6) as average_degree from x")
def graph_stats(spark, sf_dir):
    return rounded(graph.graph_stats(*identity_graph(spark, sf_dir)))


@query(f"with recursive {SIZES} select component, round(case when size <= 1 then 1.0 when edges = 0 then 0.0 else 0.6 * avg_weight + 0.4 * density end, 6) as cohesion from s")
def cohesion(spark, sf_dir):
    return rounded(graph.cohesion(*identity_graph(spark, sf_dir)))


_QUALITY = (
    SIZES
    + """,
q as (select component, size, npi_count, state_count, specialty_count, avg_weight, min_weight, density,
  case when npi_count > 1 then 0.1 else greatest(0, least(1, (0.4 * avg_weight + 0.2 * min_weight + 0.4) * case when size <= 5 then 0.3 * density + 0.7 else 1 end
    * case when state_count > 1 then greatest(0.5, 1 - 0.15 * (state_count - 1)) else 1 end * case when specialty_count > 2 then greatest(0.5, 1 - 0.1 * (specialty_count - 2)) else 1 end
    * case when size > 10 then greatest(0.5, 1 - 0.02 * (size - 10)) else 1 end)) end::double as quality_score,
  (npi_count > 1)::int + (state_count > 3)::int + (specialty_count > 3)::int + (size > 20)::int as n_warnings from s)"""
)


@query(f"with recursive {_QUALITY} select component, size, npi_count, state_count, specialty_count, round(avg_weight, 6) as avg_weight, round(min_weight, 6) as min_weight, round(density, 6) as density, round(quality_score, 6) as quality_score, n_warnings, n_warnings > 0 as has_issues from q")
def cluster_quality(spark, sf_dir):
    q = graph.quality(*identity_graph(spark, sf_dir)).withColumn("n_warnings", F.size("warnings"))
    return rounded(q.select("component", "size", "npi_count", "state_count", "specialty_count", "avg_weight", "min_weight", "density", "quality_score", "n_warnings", "has_issues"))


@query(f"with recursive {_QUALITY} select count(*) as clusters, round(avg(quality_score), 6) as avg_score, round(min(quality_score), 6) as min_score, round(max(quality_score), 6) as max_score, count(*) filter (npi_count > 1) as npi_conflicts, count(*) filter (n_warnings > 0) as with_warnings, count(*) filter (quality_score >= 0.8) as high, count(*) filter (quality_score >= 0.5 and quality_score < 0.8) as medium, count(*) filter (quality_score < 0.5) as low from q")
def quality_summary(spark, sf_dir):
    return rounded(graph.quality_summary(graph.quality(*identity_graph(spark, sf_dir))))


@query()
def overmatched_clusters(spark, sf_dir):
    return graph.overmatching(*identity_graph(spark, sf_dir)).select("component", F.array_join("warnings", "; ").alias("warnings"))


# By trial: an edge is a bridge if its end can't be reached from its start without it; a vertex is a cut if one of its neighbours can't reach another without it.
_WEAK = (
    COMPONENTS
    + """,
walk(s, d, here) as (select src, dst, src from e where weight < 0.8 union select s, d, both_ways.b from walk join both_ways on walk.here = both_ways.a where not (both_ways.a = s and both_ways.b = d) and not (both_ways.a = d and both_ways.b = s)),
weak as (select comp.component, src, dst, weight from e join comp on e.src = comp.id where weight < 0.8 and not exists (select 1 from walk where walk.s = e.src and walk.d = e.dst and walk.here = e.dst))"""
)
_CUTS = (
    COMPONENTS
    + """,
walk(v, here) as (select a, min(b) from both_ways group by 1 union select v, both_ways.b from walk join both_ways on walk.here = both_ways.a where both_ways.b <> v)"""
)
_PARTS = (
    _WEAK
    + """,
hit as (select id, component from comp where component in (select component from weak)),
kept as (select a, b from both_ways where not exists (select 1 from weak where (weak.src = a and weak.dst = b) or (weak.src = b and weak.dst = a))),
piece(id, r) as (select id, id from hit union select piece.id, kept.b from piece join kept on piece.r = kept.a)"""
)


@query(f"with recursive {_WEAK} select component, src, dst, weight from weak")
def weak_bridges(spark, sf_dir):
    _, e, c = identity_graph(spark, sf_dir)
    return graph.weak_bridges(e, c, 0.8)


@query(f"with recursive {_CUTS} select component, id from comp where exists (select 1 from both_ways n where n.a = comp.id and not exists (select 1 from walk where walk.v = comp.id and walk.here = n.b))")
def articulation_points(spark, sf_dir):
    _, e, c = identity_graph(spark, sf_dir)
    return graph.articulation_points(e, c)


@query(f"with recursive {_PARTS} select hit.component, hit.id, min(piece.r) as part from hit join piece on hit.id = piece.id group by 1, 2")
def suggested_splits(spark, sf_dir):
    return graph.suggested_splits(*identity_graph(spark, sf_dir), 0.8)


@query()
def pruned_edges(spark, sf_dir):
    v, e, _ = identity_graph(spark, sf_dir)
    return rounded(pruning.prune_all(v, e).drop("sources"))


@query(f"with {EDGES} select src, dst, round(weight, 6) as weight from e where weight >= 0.8")
def edges_without_light(spark, sf_dir):
    _, e, _ = identity_graph(spark, sf_dir)
    return rounded(pruning.prune_light(e, 0.8).select("src", "dst", "weight"))


# --- entities ------------------------------------------------------------------------------------------------------

_ENTITY = (
    SIZES
    + r""",
m as (select comp.component, rec.*, case source when 'cms' then 4 when 'license' then 3 when 'hospital' then 2 when 'publication' then 1 else 0 end as pr,
  case when regexp_full_match(npi, '[0-9]{10}') then npi end as good, nullif(regexp_replace(specialty, '^\s+|\s+$', '', 'g'), '') as sp, nullif(regexp_replace(facility_name, '^\s+|\s+$', '', 'g'), '') as fa,
  nullif(regexp_replace(facility_city, '^\s+|\s+$', '', 'g'), '') as ci, nullif(regexp_replace(facility_state, '^\s+|\s+$', '', 'g'), '') as st from rec join comp on rec.source_id = comp.id),
npis as (select component, good as npi from (select component, good, count(*) as n from m where good is not null group by 1, 2) qualify row_number() over (partition by component order by n desc, good) = 1),
names as (select component, name_raw as name from m where nullif(name_raw, '') is not null qualify row_number() over (partition by component order by pr desc, length(name_raw) desc, name_raw) = 1),
spk as (select component, upper(sp) as k, count(*) as n from m where sp is not null group by 1, 2 qualify row_number() over (partition by component order by n desc, k) = 1),
sps as (select m.component, sp as specialty from m join spk on m.component = spk.component and upper(m.sp) = spk.k qualify row_number() over (partition by m.component order by pr desc, sp) = 1),
fas as (select component, fa as primary_facility from (select component, fa, count(*) as n, max(pr) as p from m where fa is not null group by 1, 2) qualify row_number() over (partition by component order by n desc, p desc, fa) = 1),
cis as (select component, ci as city from (select component, ci, count(*) as n from m where ci is not null group by 1, 2) qualify row_number() over (partition by component order by n desc, ci) = 1),
sts as (select component, st as state from (select component, st, count(*) as n from m where st is not null group by 1, 2) qualify row_number() over (partition by component order by n desc, st) = 1),
pri as (select component, max(case source when 'cms' then 0.85 when 'license' then 0.80 when 'hospital' then 0.70 when 'publication' then 0.50 else 0.5 end)::double as prior from m group by 1),
conf as (select s.component, case when size = 1 then prior when edges = 0 then 0.3 else greatest(0, least(1, 0.30 * avg_weight + 0.15 * min_weight + 0.15 * density + 0.25 * case when npi_count <= 1 then 1.0 else 0.3 end + 0.15 * least(source_count / 3.0::double, 1))) end::double as confidence from s join pri using (component)),
ids as (select distinct comp.component, 'PHY_' || coalesce(npis.npi, substr(md5(comp.component), 1, 12)) as canonical_id from comp left join npis using (component))"""
)


@query(f"with recursive {_ENTITY} select canonical_id, npis.npi, name, specialty, primary_facility, city, state, round(confidence, 6) as confidence, s.size::int as source_count from ids join s using (component) left join npis using (component) left join names using (component) left join sps using (component) left join fas using (component) left join cis using (component) left join sts using (component) left join conf using (component)")
def canonical_entities(spark, sf_dir):
    return rounded(canonical.merge_clusters(*identity_graph(spark, sf_dir)).drop("all_facilities", "source_records"))


@query(f"with recursive {_ENTITY} select comp.id as source_id, canonical_id from comp join ids using (component)")
def source_mapping(spark, sf_dir):
    v, _, c = identity_graph(spark, sf_dir)
    return canonical.source_mapping(v, c)


@query(f"with recursive {_ENTITY}, i as (select canonical_id, count(*) as n from comp join ids using (component) group by 1) select count(*) as entities, count(*) filter (regexp_full_match(canonical_id, 'PHY_[0-9]{{10}}')) as npi_based, count(*) filter (not regexp_full_match(canonical_id, 'PHY_[0-9]{{10}}')) as hash_based, sum(n)::bigint as records, round(avg(n), 6) as records_each from i")
def canonical_id_stats(spark, sf_dir):
    v, _, c = identity_graph(spark, sf_dir)
    return rounded(canonical.id_stats(canonical.source_mapping(v, c)))


@query(f"with recursive {_ENTITY} select component, round(confidence, 6) as confidence from conf")
def entity_confidence(spark, sf_dir):
    return rounded(canonical.entity_confidence(*identity_graph(spark, sf_dir)))


@query(
    f"""with recursive {COMPONENTS}, i as (select src as id, weight from e union all select dst, weight from e), k as (select id, avg(weight) as a, max(weight) as m from i group by 1), c as (select component, count(*) as n from comp group by 1)
select comp.id as source_id, round(case when n = 1 then 0.8 when a is null then 0.4 else greatest(0, least(1, 0.6 * a + 0.4 * m)) end::double, 6) as confidence from comp join c using (component) left join k on comp.id = k.id"""
)
def record_confidence(spark, sf_dir):
    _, e, c = identity_graph(spark, sf_dir)
    return rounded(canonical.record_confidence(e, c))


@query(f"with recursive {COMPONENTS}, t as (select distinct source_id as id, canonical_id as true_id from source_canonical_mapping where canonical_id is not null), b as (select comp.*, true_id from comp join t using (id)), x as (select (select coalesce(sum(n * (n - 1) / 2), 0)::bigint from (select count(*) as n from comp group by component)) as predicted, (select coalesce(sum(n * (n - 1) / 2), 0)::bigint from (select count(*) as n from t group by true_id)) as actual, (select coalesce(sum(n * (n - 1) / 2), 0)::bigint from (select count(*) as n from b group by component, true_id)) as correct) select *, round(correct / predicted::double, 6) as precision, round(correct / actual::double, 6) as recall, round(2 * (correct / predicted::double) * (correct / actual::double) / (correct / predicted::double + correct / actual::double), 6) as f1 from x")
def pair_evaluation(spark, sf_dir):
    truth = table(spark, sf_dir, "source_canonical_mapping").select(F.col("source_id").alias("id"), F.col("canonical_id").alias("true_id"))
    return rounded(reports.pair_evaluation(identity_graph(spark, sf_dir)[2], truth))


@query(f"with recursive {COMPONENTS}, b as (select comp.component, m.canonical_id as t from comp join (select distinct source_id, canonical_id from source_canonical_mapping where canonical_id is not null) m on comp.id = m.source_id) select 'merged' as kind, component as \"group\", count(distinct t) as others from b group by 2 having count(distinct t) > 1 union all select 'split', t, count(distinct component) from b group by 2 having count(distinct component) > 1")
def wrong_groups(spark, sf_dir):
    truth = table(spark, sf_dir, "source_canonical_mapping").select(F.col("source_id").alias("id"), F.col("canonical_id").alias("true_id")).distinct()
    return reports.wrong_groups(identity_graph(spark, sf_dir)[2], truth)


@query(f"with recursive {COMPONENTS}, c as (select component, count(*) as n from comp group by 1) select count(*) as clusters, sum(n)::bigint as records, min(n) as least, max(n) as most, round(avg(n), 6) as mean, count(*) filter (n = 1) as singletons, count(*) filter (n = 2) as pairs, count(*) filter (n between 3 and 5) as small, count(*) filter (n between 6 and 10) as medium, count(*) filter (n between 11 and 20) as large, count(*) filter (n > 20) as very_large, (list_sort(list(n)))[(count(*) // 2) + 1] as median from c")
def cluster_size_report(spark, sf_dir):
    return rounded(reports.cluster_sizes(identity_graph(spark, sf_dir)[2]))


@query(f"with recursive {COMPONENTS}, c as (select component, count(distinct source) as sources from rec join comp on rec.source_id = comp.id group by 1) select sources, count(*) as clusters from c group by 1")
def sources_per_cluster(spark, sf_dir):
    v, _, c = identity_graph(spark, sf_dir)
    return reports.sources_per_cluster(v, c)


