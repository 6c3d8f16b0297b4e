"""Blocks of records and candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.functions.names import given, strip


def _last(c: str = "name_last") -> Column:
    return given(F.upper(strip(F.col(c))))


def npi_key() -> Column:
    """The npi as it is, malformed ones too."""
    return given(F.col("npi"))


def last_state_key() -> Column:
    return F.when(_last().isNotNull(), F.concat_ws("|", _last(), F.coalesce(given(F.upper(F.col("facility_state"))), F.lit("XX"))))


def sound_state_key() -> Column:
    last = given(F.col("name_last"))
    return F.when(last.isNotNull(), F.concat_ws("|", F.soundex(last), F.coalesce(given(F.upper(F.col("facility_state"))), F.lit("XX"))))


def last_initial_key() -> Column:
    first = given(strip(F.col("name_first")))
    return F.when(_last().isNotNull() & first.isNotNull(), F.concat_ws("|", _last(), F.upper(F.substring(first, 1, 1))))


KEYS = {"npi": npi_key, "last_state": last_state_key, "sound_state": sound_state_key, "last_initial": last_initial_key}


def blocks(records: DataFrame, strategy: str) -> DataFrame:
    """(block, n) of the blocks with at least two records."""
    return records.select(KEYS[strategy]().alias("block")).filter("block is not null").groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


def block_members(records: DataFrame, strategy: str) -> DataFrame:
    """(block, source_id) of the blocks with at least two records: a row for each record, so a block may have any size."""
    w = Window.partitionBy("block")
    return records.select(KEYS[strategy]().alias("block"), "source_id").filter("block is not null").withColumn("n", F.count(F.lit(1)).over(w)).filter("n >= 2").drop("n")


def latest_records(records: DataFrame, order: str = "record_id") -> DataFrame:
    """One row for each source_id, the last by order."""
    rest = [c for c in records.columns if c != "source_id"]
    return records.filter("source_id is not null").groupBy("source_id").agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in rest)), order).alias("_r")).select("source_id", "_r.*").select(*records.columns)


def candidate_pairs(records: DataFrame, sound: bool = True, initial: bool = False, hot_block: int | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """(source_id_1, source_id_2), the smaller first: each pair that shares a block, once.

    records has one row for each source_id. Pairs of one source are kept. One
    self-join serves all strategies; a pair is kept where its first shared
    strategy meets, so no second pass is needed to drop repeats. hot_block: a
    block with more records is cut by a hash into pieces of about so many, and
    each two pieces meet under a key of their own, so that its pairs, all of
    them, are spread over tasks; None: every block meets under one key. The
    pairs are the same. columns of records come with both sides, suffixed _1 and
    _2, so that pairs need no join with their records.
    """
    use = ["npi", "last_state", *(["sound_state"] if sound else []), *(["last_initial"] if initial else [])]
    own = [f"own{i}" for i in range(len(use) - 1)]
    # A row has the keys of the strategies before its own, where its pairs may have met already.
    keys = F.array(*(F.struct(F.lit(i).alias("s"), F.col(f"key{i}").alias("block"), *(F.when(F.lit(j < i), F.col(f"key{j}")).alias(o) for j, o in enumerate(own))) for i in range(len(use))))
    carried = [F.col(c).alias(f"with_{c}") for c in columns]
    rows = records.select("source_id", *(KEYS[k]().alias(f"key{i}") for i, k in enumerate(use)), *carried)
    rows = rows.select("source_id", *(f"with_{c}" for c in columns), F.explode(F.filter(keys, lambda k: k["block"].isNotNull())).alias("k")).select("source_id", *(f"with_{c}" for c in columns), "k.*")
    a = b = rows
    on = ["s", "block"]
    ordered = F.col("a.source_id") < F.col("b.source_id")
    if hot_block is not None:
        pieces = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("s", "block")) / hot_block).cast("int")
        rows = rows.withColumn("pieces", pieces).withColumn("piece", F.pmod(F.xxhash64("source_id"), F.col("pieces")).cast("int"))
        # Two pieces meet once, the lower from the left; within a piece the ids decide.
        a = rows.withColumn("low", F.col("piece")).withColumn("high", F.explode(F.sequence("piece", F.col("pieces") - 1))).drop("pieces", "piece")
        b = rows.withColumn("high", F.col("piece")).withColumn("low", F.explode(F.sequence(F.lit(0), F.col("piece")))).drop("pieces", "piece")
        on = [*on, "low", "high"]
        ordered = (F.col("a.low") < F.col("a.high")) | ordered
    met = ordered
    for c in on:
        met = met & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    for o in own:
        met = met & ~F.coalesce(F.col(f"a.{o}") == F.col(f"b.{o}"), F.lit(False))
    pairs = a.alias("a").join(b.alias("b"), met)
    if hot_block is None:
        return pairs.select(F.col("a.source_id").alias("source_id_1"), F.col("b.source_id").alias("source_id_2"), *(F.col(f"{x}.with_{c}").alias(f"{c}_{side}") for side, x in (("1", "a"), ("2", "b")) for c in columns))
    first = F.col("a.source_id") < F.col("b.source_id")
    of = [F.when(first, F.col(f"{x}.with_{c}")).otherwise(F.col(f"{y}.with_{c}")).alias(f"{c}_{side}") for side, x, y in (("1", "a", "b"), ("2", "b", "a")) for c in columns]
    return pairs.select(F.least("a.source_id", "b.source_id").alias("source_id_1"), F.greatest("a.source_id", "b.source_id").alias("source_id_2"), *of)
