"""The pN_ queries of this subpackage: name to callable(spark, directory of tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkwright.llm.values import mapped_values

    return mapped_values(_table(spark, sf_dir, "source_records"), _table(spark, sf_dir, "ref_specialties"), _table(spark, sf_dir, "ref_facilities"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkwright.llm.entities import match_entities, person_rows

    rows = person_rows(_table(spark, sf_dir, "source_records"), _table(spark, sf_dir, "source_canonical_mapping"), _table(spark, sf_dir, "ref_specialties"), _table(spark, sf_dir, "ref_facilities"))
    return match_entities(rows).select("source_id_1", "source_id_2")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from linkwright.llm.entities import person_rows
    from linkwright.llm.variants import link_variants, spelling, variant_pairs

    records, mapping = _table(spark, sf_dir, "source_records"), _table(spark, sf_dir, "source_canonical_mapping")
    rows = person_rows(records.withColumn("raw", spelling(F.col("name_raw"))), mapping, _table(spark, sf_dir, "ref_specialties"), _table(spark, sf_dir, "ref_facilities"), ("raw",), 0)
    return variant_pairs(link_variants(rows))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkwright.llm.survivors import held_worse

    return held_worse(*(_table(spark, sf_dir, t) for t in ("canonical_physicians", "source_records", "source_canonical_mapping", "ref_specialties", "ref_facilities")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkwright.llm.groups import consolidate, linked_pairs

    return consolidate(linked_pairs(_table(spark, sf_dir, "match_pairs")))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkwright.llm.packing import containers, sized

    return containers(sized(_table(spark, sf_dir, "documents")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkwright.llm.leakage import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_passages")).select("doc_id", "eval_id").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkwright.llm.lookalikes import equal_pairs

    return equal_pairs(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p4_found, p6_found, p7_containers, p8_found, p9_found)}
P6_SQL = """
with recursive l as (select source_id_1 as a, source_id_2 as b from match_pairs where lower(trim(match_decision)) = 'match' and source_id_1 <> source_id_2),
both_ways as (select a, b from l union select b, a from l),
reach(id, r) as (select a, a from both_ways union select reach.id, both_ways.b from reach join both_ways on reach.r = both_ways.a)
select id as source_id, min(r) as group_id from reach group by 1
"""

ORACLE_SQL: dict[str, str] = {"p6_found": P6_SQL}
