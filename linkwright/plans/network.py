"""Queries for the referral network, reports and search, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.operators import network, reports, search
from linkwright.plans.resolution import rounded, table
from linkwright.sources.sinks import record_rows, seed_rows, upsert
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


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "canonical_physicians").select("npi", F.col("id").alias("canonical_id"))
    return network.referral_edges(table(spark, sf_dir, "referrals"), ids)


E = """ids as (select npi, min(id) as id from canonical_physicians where npi is not null group by 1),
e as (select a.id as src, b.id as dst, count(*) as referral_count, max(coalesce(strftime(referral_date, '%Y-%m-%d %H:%M:%S'), '')) as last_referral_date
  from referrals join ids a on referring_npi = a.npi join ids b on receiving_npi = b.npi where nullif(referring_npi, '') is not null and nullif(receiving_npi, '') is not null and a.id <> b.id group by 1, 2)"""
M = E + """,
m as (select id, sum(i) as in_degree, sum(1 - i) as out_degree, sum(i * n) as in_volume, sum((1 - i) * n) as out_volume from (select src as id, 0 as i, referral_count as n from e union all select dst, 1, referral_count from e) group by 1)"""


@query(f"with {E} select * from e")
def referral_edges(spark, sf_dir):
    return edges_of(spark, sf_dir)


@query(f"with {M} select id, in_degree::bigint as in_degree, out_degree::bigint as out_degree, in_volume::bigint as in_volume, out_volume::bigint as out_volume from m")
def referral_metrics(spark, sf_dir):
    return network.metrics(edges_of(spark, sf_dir))


@query(f"with {E} select src as id, sum(referral_count)::bigint as referrals from e group by 1 order by 2 desc, 1 limit 10")
def top_referrers(spark, sf_dir):
    return network.top_referrers(edges_of(spark, sf_dir))


@query(f"with {E} select dst as id, sum(referral_count)::bigint as referrals from e group by 1 order by 2 desc, 1 limit 10")
def top_receivers(spark, sf_dir):
    return network.top_receivers(edges_of(spark, sf_dir))


@query(f"with {M} select (select count(*) from m) as nodes, (select max(in_degree) from m)::bigint as max_in_degree, (select max(out_degree) from m)::bigint as max_out_degree, round((select avg(in_degree) from m), 6) as avg_in_degree, round((select avg(out_degree) from m), 6) as avg_out_degree, count(*) as edges, sum(referral_count)::bigint as referrals, round(avg(referral_count), 6) as avg_referrals from e")
def referral_stats(spark, sf_dir):
    return rounded(network.stats(stored(edges_of(spark, sf_dir), "edges")))


def _rank_sql(rounds: int, select: str, more: str = "") -> str:
    """PageRank by one common table expression a round."""
    sql = M + ", o as (select src, sum(referral_count) as o from e group by 1), p as (select e.src, e.dst, referral_count / o.o::double as p from e join o using (src)), c as (select count(*)::double as n from m), r0 as (select id, 1 / c.n as s from m, c)"
    for i in range(1, rounds + 1):
        sql += f", d{i} as (select coalesce(sum(s), 0) as d from r{i - 1} join m using (id) where out_degree = 0), i{i} as (select dst as id, sum(p * s) as x from p join r{i - 1} on p.src = r{i - 1}.id group by 1), r{i} as (select m.id, 0.15::double / c.n + 0.85::double * (coalesce(x, 0) + d / c.n) as s from m cross join c cross join d{i} left join i{i} using (id))"
    return f"with {sql}, r as (select id, s as score from r{rounds}){more} {select}"


ROUNDS = 5


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.pagerank(stored(edges_of(spark, sf_dir), "edges"), rounds=ROUNDS, exact_rounds=True)


@query(_rank_sql(ROUNDS, "select id, round(score, 9) as score from r"))
def pagerank_5(spark, sf_dir):
    return rounded(ranks(spark, sf_dir), 9)


@query()
def influence_scores(spark, sf_dir):
    return rounded(network.pagerank(stored(edges_of(spark, sf_dir), "edges")), 9)


@query(_rank_sql(ROUNDS, "select id, round(score, 9) as score from r order by r.score desc, id limit 20"))
def top_influencers(spark, sf_dir):
    return rounded(network.top_influencers(ranks(spark, sf_dir)), 9)


_FAC = r"places as (select id, substr(upper(regexp_replace(primary_facility, '^\s+|\s+$', '', 'g')), 1, 50) as f from canonical_physicians), fit as (select f from places where f <> '' group by 1 having count(*) between 2 and 99), small as (select * from places where f in (select f from fit)), col as (select a.id as id_1, b.id as id_2 from small a join small b on a.f = b.f and a.id < b.id)"


@query(f"with {_FAC} select id_1, id_2, 'same_facility' as relationship, 0.6::double as strength from col")
def colleagues(spark, sf_dir):
    return network.colleagues(table(spark, sf_dir, "canonical_physicians"))


@query(f"with {_FAC} select id_1, id_2, 0.6::double as strength, ['same_facility'] as relationships from col")
def colleague_graph(spark, sf_dir):
    return network.colleague_graph(network.colleagues(table(spark, sf_dir, "canonical_physicians")).unionByName(network.coauthors(spark)))


_HUB = "hub as (select dst as h from e group by 1 order by sum(referral_count) desc, 1 limit 1)"
_EGO = f"with {E}, {_FAC}, {_HUB}, g as (select 'referral_in' as relation, src as id, referral_count::double as weight from e, hub where dst = h union all select 'referral_out', dst, referral_count::double from e, hub where src = h union all select 'colleague', case when id_1 = h then id_2 else id_1 end, 0.6::double from col, hub where id_1 = h or id_2 = h)"


def _ego(spark, sf_dir):
    e = stored(edges_of(spark, sf_dir), "edges")
    hub = network.top_receivers(e, 1).first()
    col = network.colleague_graph(network.colleagues(table(spark, sf_dir, "canonical_physicians")))
    return network.ego_network(hub["id"] if hub else "", e, col)


@query(_EGO + " select * from g")
def ego_network(spark, sf_dir):
    return _ego(spark, sf_dir)


@query(_EGO + " select id, relation, case relation when 'referral_in' then '#4ecdc4' when 'referral_out' then '#45b7d1' else '#96ceb4' end as color from g")
def ego_nodes(spark, sf_dir):
    return search.ego_nodes(_ego(spark, sf_dir))


# --- reports -------------------------------------------------------------------------------------------------------

_COV = "count(*) as records, {0} as npi_coverage, {1} as name_coverage, {2} as specialty_coverage, {3} as location_coverage, count(distinct nullif(npi, '')) as unique_npis, count(distinct nullif(facility_state, '')) as unique_states".format(*(f"round(count(nullif({c}, '')) / count(*)::double, 6)" for c in ("npi", "name_last", "specialty", "facility_state")))


@query(f"select source, {_COV} from source_records group by rollup (source)")
def source_coverage(spark, sf_dir):
    return rounded(reports.source_coverage(table(spark, sf_dir, "source_records")))


_COLUMNS = "record_id source source_id npi name_raw name_first name_last name_middle name_suffix specialty facility_name facility_address facility_city facility_state facility_zip latitude longitude as_of created_at load_id".split()


@query(" union all ".join(f"select '{c}' as \"column\", count(*) filter (coalesce({c}::varchar, '') = '') as missing from source_records" for c in _COLUMNS))
def missing_values(spark, sf_dir):
    return reports.missing_values(table(spark, sf_dir, "source_records").select(*_COLUMNS))


@query(" union all ".join(f"select '{c}' as \"column\", count(distinct {c}) as \"distinct\" from source_records" for c in reports.KEY_COLUMNS))
def distinct_values(spark, sf_dir):
    return reports.distinct_values(table(spark, sf_dir, "source_records"))


@query("with p as (select distinct npi, upper(name_last) || ', ' || coalesce(upper(name_first), '') as name from source_records where nullif(npi, '') is not null and nullif(name_last, '') is not null) select npi, count(*) as names, string_agg(name, '; ' order by name) as spellings from p group by 1 having count(*) > 1")
def npi_names(spark, sf_dir):
    return reports.npi_names(table(spark, sf_dir, "source_records"))


def _said(spark, sf_dir):
    m = table(spark, sf_dir, "match_pairs")
    return m.select("source_id_1", "source_id_2", F.lower(F.trim("match_decision")).alias("decision"), "match_type", F.col("similarity_score").alias("overall"), F.col("similarity_score").alias("confidence"))


_SAID = "with m as (select *, lower(trim(match_decision)) as decision, similarity_score as c from match_pairs)"


@query(f"{_SAID} select decision, count(*) as pairs, round(count(*) / sum(count(*)) over ()::double, 6) as share from m group by 1")
def decisions(spark, sf_dir):
    return rounded(reports.decisions(_said(spark, sf_dir)))


@query(f"{_SAID} select match_type, count(*) as pairs from m where decision = 'match' group by 1")
def match_types(spark, sf_dir):
    return reports.match_types(_said(spark, sf_dir))


@query(f"{_SAID} select decision, count(c) as pairs, min(c) as least, max(c) as most, round(avg(c), 6) as mean, (list_sort(list(c) filter (c is not null)))[(count(c) // 2) + 1] as median from m where decision is not null group by 1")
def score_stats(spark, sf_dir):
    return rounded(reports.score_stats(_said(spark, sf_dir).filter("decision is not null")))


@query(f"{_SAID} select count(*) filter (c >= 0.9) as high, count(*) filter (c >= 0.7 and c < 0.9) as medium, count(*) filter (c < 0.7) as low from m where decision = 'match'")
def confidence_classes(spark, sf_dir):
    return reports.confidence_classes(_said(spark, sf_dir))


@query(f"{_SAID} select source_id_1, source_id_2, decision, match_type, c as overall, c as confidence from m where decision = 'match' and c < 0.7 order by c, 1, 2 limit 20")
def low_confidence(spark, sf_dir):
    return reports.low_confidence(_said(spark, sf_dir))


@query(
    """with rec as (select * from source_records where source_id is not null qualify row_number() over (partition by source_id order by record_id desc) = 1),
x as (select case when regexp_full_match(a.npi, '[0-9]{10}') and regexp_full_match(b.npi, '[0-9]{10}') then (a.npi = b.npi)::int end as m from match_pairs p join rec a on p.source_id_1 = a.source_id join rec b on p.source_id_2 = b.source_id)
select count(*) filter (m = 1) as exact, count(*) filter (m = 0) as conflict, count(*) filter (m is null) as unavailable, round(count(*) filter (m = 1) / nullif(count(m), 0)::double, 6) as rate from x"""
)
def npi_report(spark, sf_dir):
    from linkwright.functions.similarity import npi_match
    from linkwright.plans.resolution import _pairs

    p = _pairs(spark, sf_dir, "npi")
    return rounded(reports.npi_report(p.select(npi_match(F.col("npi_1"), F.col("npi_2")).alias("npi_match"))))


@query("select count(*) as entities, round(count(nullif(npi, '')) / count(*)::double, 6) as npi_coverage, count(*) filter (confidence_score >= 0.8) as high, count(*) filter (confidence_score >= 0.5 and confidence_score < 0.8) as medium, count(*) filter (confidence_score < 0.5) as low, min(confidence_score) as min_confidence, max(confidence_score) as max_confidence, round(avg(confidence_score), 6) as mean_confidence, min(source_count) as min_sources, max(source_count) as max_sources, round(avg(source_count), 6) as mean_sources from canonical_physicians")
def entity_report(spark, sf_dir):
    return rounded(reports.entity_report(table(spark, sf_dir, "canonical_physicians"), "confidence_score"))


@query("select state as value, count(*) as n from canonical_physicians where nullif(state, '') is not null group by 1 order by 2 desc, 1 limit 10")
def top_states(spark, sf_dir):
    return reports.top_values(table(spark, sf_dir, "canonical_physicians"), "state")


@query("select specialty as value, count(*) as n from canonical_physicians where nullif(specialty, '') is not null group by 1 order by 2 desc, 1 limit 10")
def top_specialties(spark, sf_dir):
    return reports.top_values(table(spark, sf_dir, "canonical_physicians"), "specialty")


# --- search --------------------------------------------------------------------------------------------------------

_STATES = ["MA", "WA", "NY", "CO"]
_COLS = ("state", "specialty", "confidence_score", "name")


@query("select id, name, state, specialty, confidence_score from canonical_physicians where state in ('MA', 'WA', 'NY', 'CO') and confidence_score >= 0.7 and regexp_matches(name, 'an|er', 'i')")
def search_filter(spark, sf_dir):
    found = search.apply_filters(table(spark, sf_dir, "canonical_physicians"), _STATES, None, 0.7, "an|er", _COLS)
    return found.select("id", "name", "state", "specialty", "confidence_score")


@query("select distinct state from canonical_physicians where state is not null order by 1")
def state_choices(spark, sf_dir):
    return search.choices(table(spark, sf_dir, "canonical_physicians"), "state")


@query("select count(*) as entities, round(avg(confidence_score), 6) as avg_confidence, count(npi) as with_npi, round(avg(source_count), 6) as avg_sources from canonical_physicians")
def headline(spark, sf_dir):
    return rounded(search.headline(table(spark, sf_dir, "canonical_physicians"), "confidence_score"))


_INF = ", f as (select c.*, coalesce(r.score, 0) as influence from canonical_physicians c left join r using (id))"


def _influence(spark, sf_dir):
    return search.with_influence(table(spark, sf_dir, "canonical_physicians"), ranks(spark, sf_dir), "id")


@query(_rank_sql(ROUNDS, "select id, round(influence, 9) as influence from f", _INF))
def entity_influence(spark, sf_dir):
    return rounded(_influence(spark, sf_dir).select("id", "influence"), 9)


@query(_rank_sql(ROUNDS, "select specialty, round(avg(influence), 9) as mean, round(sum(influence), 9) as total, count(*) as n from f where specialty is not null group by 1 order by sum(influence) desc, 1 limit 15", _INF))
def influence_by_specialty(spark, sf_dir):
    return rounded(search.influence_by(_influence(spark, sf_dir)), 9)


@query()
def influence_histogram(spark, sf_dir):
    return search.influence_histogram(_influence(spark, sf_dir))


@query("select distinct m.canonical_id, m.source_id, s.source, s.name_raw from canonical_physicians c join source_canonical_mapping m on c.id = m.canonical_id join source_records s on m.source_id = s.source_id where regexp_matches(c.name, 'ab', 'i')")
def provenance(spark, sf_dir):
    return search.provenance(table(spark, sf_dir, "canonical_physicians"), table(spark, sf_dir, "source_canonical_mapping"), table(spark, sf_dir, "source_records"), name="ab", key="id")


@query(
    _rank_sql(
        ROUNDS,
        "select r.id, substr(coalesce(c.name, r.id), 1, 20) as label, round(10 + score * 1000, 6) as size, case when upper(coalesce(specialty, '')) = '' then '#97c2fc' when upper(specialty) like '%CARDIO%' then '#ff6b6b' when upper(specialty) like '%SURGERY%' or upper(specialty) like '%ORTHO%' then '#4ecdc4' when upper(specialty) like '%MEDICINE%' or upper(specialty) like '%INTERNAL%' then '#45b7d1' when upper(specialty) like '%PEDIATRIC%' then '#96ceb4' when upper(specialty) like '%ONCOLOGY%' then '#dda0dd' else '#97c2fc' end as color from (select * from r order by score desc, id limit 30) r join canonical_physicians c on r.id = c.id",
    )
)
def network_nodes(spark, sf_dir):
    return rounded(search.network_nodes(ranks(spark, sf_dir), table(spark, sf_dir, "canonical_physicians"), key="id"))


# --- sinks ---------------------------------------------------------------------------------------------------------


@query("select source, source_id, npi, name_raw, name_first, name_last, name_middle, specialty, facility_name, facility_city, facility_state, facility_zip, latitude, longitude from source_records")
def stored_rows(spark, sf_dir):
    return record_rows(table(spark, sf_dir, "source_records"))


@query("with f as (select source, source_id, min(record_id) as record_id from source_records where source_id is not null group by 1, 2), l as (select source, source_id, max(record_id) as record_id from source_records where source_id is not null and load_id >= 20 group by 1, 2) select source, source_id, coalesce(l.record_id, f.record_id) as record_id from f left join l using (source, source_id)")
def upserted_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "source_records").filter("source_id is not null")
    old = rows.groupBy("source", "source_id").agg(F.min("record_id").alias("record_id"))
    return upsert(old, rows.filter("load_id >= 20").select("source", "source_id", "record_id"))


@query("select id, nullif(npi, '') as npi, nullif(name, '') as name, nullif(specialty, '') as specialty, nullif(primary_facility, '') as primary_facility, nullif(city, '') as city, nullif(state, '') as state, confidence_score::decimal(4,3)::double as confidence_score, source_count::int as source_count from canonical_physicians")
def seeded_entities(spark, sf_dir):
    c = table(spark, sf_dir, "canonical_physicians")
    exported = c.select(F.col("id").alias("canonical_id"), "npi", "name", "specialty", "primary_facility", "city", "state", F.col("confidence_score").cast("string").alias("confidence"), F.col("source_count").cast("string").alias("source_count"))
    return seed_rows(exported).withColumn("confidence_score", F.col("confidence_score").cast("double"))
