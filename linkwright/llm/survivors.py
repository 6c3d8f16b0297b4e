"""The best value of each group of duplicate records, field by field, by skyline selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.people import features, given_names, name_words
from linkwright.llm.text import blank, squeezed
from linkwright.llm.values import FIELDS, UNMATCHED, field_values, map_fields
from linkwright.storage import join_checked, stored

# How far each source is trusted.
TRUST = {"cms": 3, "license": 2, "hospital": 1, "publication": 0}
#: Most fields that a record is complete in.
MOST_FIELDS = 15


def layers(records: DataFrame) -> DataFrame:
    """(group, record, completeness, trust, recency, layer): the dominance layer (1: undominated) of each record within its group.

    records: group STRING, record (a number), completeness (0 to MOST_FIELDS),
    trust (0 to 3), recency (a timestamp). One dominates another if it is at
    least as good in all three and better in one; a record's layer is one more
    than that of the highest layer that dominates it. Records equal in all three
    share a layer. A missing recency is the oldest.

    Rows of a group come sorted, newest first, so the state held is one number
    for each combination of the other two: a group may have any number of rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, moment, top, fresh = None, None, None, {}
        for b in batches:
            out = np.empty(len(b), dtype="int32")
            for at, (g, c, t, r) in enumerate(zip(b["group"], b["completeness"], b["trust"], b["seconds"])):
                if g != key:
                    key, moment, fresh = g, None, {}
                    top = [[0] * 4 for _ in range(MOST_FIELDS + 1)]
                # Within a group rows of one moment come best first, so those that dominate have been seen.
                if r != moment:
                    moment, fresh = r, {}
                lay = fresh.get((c, t)) or max(max(row[t:]) for row in top[c:]) + 1
                fresh[c, t] = lay
                top[c][t] = max(top[c][t], lay)
                out[at] = lay
            if len(b):
                yield b.drop(columns="seconds").assign(layer=out)

    rows = records.select("group", F.col("record").cast("long").alias("record"), "completeness", "trust", F.coalesce(F.unix_micros(F.col("recency").cast("timestamp")), F.lit(-(2**62))).alias("seconds"), F.col("recency").cast("timestamp").alias("recency"))
    rows = rows.repartition("group").sortWithinPartitions("group", F.desc("seconds"), F.desc("completeness"), F.desc("trust"))
    return rows.mapInPandas(run, "group string, record long, completeness int, trust int, recency timestamp, layer int")


def survivors(evidence: DataFrame) -> DataFrame:
    """(group, field, value, form, ties, votes): the surviving value of each group and field, all values with as many records, and their number.

    evidence: group, field, record, value (null: the record has none), form (how
    it is written), completeness (0 to 3: how fully), trust (0 to 3), recency.
    First what a group's records outvote (a value that fewer of them have) and
    what one of them writes more fully is made null. Then whole records are
    ranked: dominance over completeness (fields left), recency and trust gives
    layers; within a layer the policy is completeness, recency, trust, then the
    smaller form and value. The first record of the first layer survives, and
    each of its nulls is filled from the first record, in the same order, that
    has the field: of the rest of its layer, then of the next ones. Repeated rows
    of a record count once. Groups without any value for a field have no row for
    it. At most MOST_FIELDS fields.
    """
    seen = evidence.filter(F.col("group").isNotNull() & F.col("value").isNotNull()).select("group", "field", F.xxhash64("record").alias("record"), "value", "form", "completeness", "trust", "recency")
    # Votes are counted over copies merged before, so a hot group sends few rows.
    support = stored(seen.groupBy("group", "field", "value").agg(F.count_distinct("record").alias("votes"), F.max("completeness").alias("completeness")), "support")
    most = support.groupBy("group", "field").agg(F.max("votes").alias("votes"))
    kept = stored(support.join(most, ["group", "field", "votes"]), "kept")
    fields = stored(seen.join(kept, ["group", "field", "value", "completeness"]).select("group", "record", "field", "value", "form", "trust", "recency"), "fields")
    whole = fields.groupBy("group", "record").agg(F.size(F.collect_set("field")).alias("completeness"), F.max("trust").alias("trust"), F.max("recency").alias("recency"))
    ranked = layers(whole)
    order = F.struct("layer", (-F.col("completeness")).alias("c"), (-F.coalesce(F.unix_micros("at"), F.lit(-(2**62)))).alias("r"), (-F.col("by")).alias("t"), "form", "value")
    chosen = fields.join(ranked.select("group", "record", "completeness", F.col("recency").alias("at"), F.col("trust").alias("by"), "layer"), ["group", "record"]).groupBy("group", "field").agg(F.min(order).alias("b"))
    ties = kept.groupBy("group", "field").agg(F.sort_array(F.collect_list("value")).alias("ties"), F.max("votes").alias("votes"))
    return chosen.select("group", "field", F.col("b.value").alias("value"), F.col("b.form").alias("form")).join(ties, ["group", "field"])


def group_evidence(records: DataFrame, mapping: DataFrame, specialties: DataFrame, facilities: DataFrame, spec_ids: DataFrame, fac_ids: DataFrame) -> DataFrame:
    """What the records of each group say: rows for survivors(), for surname, given, middle, specialty and facility."""
    pairs = stored(mapping.select("source_id", F.col("canonical_id").alias("group")).filter("source_id is not null and group is not null").distinct(), "pairs")
    said = join_checked(records, pairs, "source_id", "inner")
    labels = stored(pairs.groupBy("source_id").agg(F.min("group").alias("label")), "labels")
    rows = features(said, stored(given_names(said, labels), "givens"), specialties, facilities, ("group", "as_of", F.col("specialty").alias("spec"), F.col("facility_name").alias("fac")), True, False)
    rows = join_checked(rows, spec_ids.select(F.col("value").alias("spec"), F.col("ref_id").alias("spec_id"), F.col("full").alias("spec_full")), "spec")
    rows = join_checked(rows, fac_ids.select(F.col("value").alias("fac"), F.col("ref_id").alias("fac_id"), F.col("full").alias("fac_full")), "fac")
    trust = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TRUST.items() for x in kv]), F.col("source")), F.lit(0))
    known = F.col("known_given").isNotNull()
    said_of = [
        ("surname", F.when(F.length("surname_written") > 1, F.col("surname_written")), F.col("surname_written"), F.lit(1)),
        ("given", F.when(F.length("given_written") > 2, F.col("given")), F.col("given_written"), F.when(F.col("given") == F.col("given_written"), 2).otherwise(0) + known.cast("int")),
        ("middle", F.when(F.length("middle_written") > 1, F.col("middle_written")), F.col("middle_written"), F.lit(1)),
        ("specialty", F.col("spec_id"), F.col("spec"), F.when(F.col("spec_full"), 3).otherwise(1)),
        ("primary_facility", F.col("fac_id"), F.col("fac"), F.when(F.col("fac_full"), 3).otherwise(1)),
    ]
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), v.alias("value"), form.alias("form"), c.cast("int").alias("completeness")) for f, v, form, c in said_of)))
    return rows.select("group", F.xxhash64("source_id").alias("record"), trust.cast("int").alias("trust"), F.col("as_of").alias("recency"), each.alias("e")).select("group", "record", "trust", "recency", "e.*").filter("value is not null")


def typed_ids(mapping: DataFrame, refs: DataFrame, number: int, stand_ins: tuple[str, ...]) -> DataFrame:
    """(value, ref_id, full): the entry a value of one list stands for; a facility on no list stands for itself by its letters, stand-in text for nothing.

    full: the value has the entry's letters, whatever their case, or is on no list.
    """
    _, ref_id, name, code = FIELDS[number]
    names = refs.select(F.col(ref_id).alias("ref_id"), squeezed(F.col(name)).alias("letters")).filter("ref_id is not null")
    out = mapping.filter((F.col("list") == number) & ~blank(F.col("value"))).select("value", "ref_id").join(F.broadcast(names), "ref_id", "left")  # reference lists don't grow
    letters = squeezed(F.col("value"))
    own = (F.col("ref_id") == UNMATCHED) & F.lit(code is None)
    return out.select("value", F.when(own & ~letters.isin(*stand_ins) & (F.length(letters) > 14), letters).when(F.col("ref_id") != UNMATCHED, F.col("ref_id")).alias("ref_id"), F.coalesce(F.col("letters") == letters, own).alias("full")).filter("ref_id is not null")


# Letters of texts that stand in for a value.
STAND_INS = ("na", "none", "nonegiven", "unknown", "unk", "tbd", "xxx", "other", "seenotes", "seeaddress", "notonfile", "notavailable", "selfemployed", "homeoffice", "locum", "pending", "null", "")


def held_worse(held: DataFrame, records: DataFrame, mapping: DataFrame, specialties: DataFrame, facilities: DataFrame) -> DataFrame:
    """(canonical_id, field): the held values that the survivors of their groups better.

    held: canonical_physicians. A held value is worse if it is null, blank or
    stands for nothing while the group has one; if it is not the survivor of
    survivors(); or if it is not written in full while a record does so. Names
    are compared part by part, whatever case, order, accents, titles and
    credentials. Among values tied for most support the survivor alone is good.
    """
    values = records.select("specialty", "facility_name").unionByName(held.select("specialty", F.col("primary_facility").alias("facility_name")))
    mapping_of = map_fields(field_values(values, "specialty", "facility_name"), specialties, facilities)
    spec_ids, fac_ids = stored(typed_ids(mapping_of, specialties, 0, STAND_INS), "spec_ids"), stored(typed_ids(mapping_of, facilities, 1, STAND_INS), "fac_ids")
    evidence = stored(group_evidence(records, mapping, specialties, facilities, spec_ids, fac_ids), "evidence")
    best = stored(survivors(evidence), "survivors")
    in_full = evidence.filter("completeness = 3").select("group", "field", "value").distinct().groupBy("group", "field").agg(F.collect_set("value").alias("written"))
    best = best.join(in_full, ["group", "field"], "left")

    rows = held.select("id", "name", "specialty", "primary_facility").filter("id is not null")
    found = []
    for field, ids in (("specialty", spec_ids), ("primary_facility", fac_ids)):
        mine = rows.select("id", F.col(field).alias("value")).join(ids.select("value", "ref_id", "full"), "value", "left")
        b = best.filter(F.col("field") == field).select(F.col("group").alias("id"), F.col("value").alias("survivor"), "written")
        worse = F.col("ref_id").isNull() | (F.col("ref_id") != F.col("survivor")) | (~F.col("full") & F.coalesce(F.array_contains("written", F.col("ref_id")), F.lit(False)))
        found.append(mine.join(b, "id").filter(worse).select("id", F.lit(field).alias("field")))
    parts = best.filter(F.col("field").isin("surname", "given", "middle")).groupBy("group").pivot("field", ["surname", "given", "middle"]).agg(F.first(F.struct("value", "form", "votes")))
    words = name_words(F.col("name"))
    whole = F.array_join("words", "")
    named = rows.select("id", F.coalesce(words, F.array().cast("array<string>")).alias("words")).join(parts.withColumnRenamed("group", "id"), "id")
    count = lambda w: F.size(F.filter("words", lambda x: x == w))
    twice = F.when(F.coalesce(F.col("given.form") == F.col("middle.form"), F.lit(False)), 2).otherwise(1)
    lacks = (
        (F.col("surname").isNotNull() & ~F.contains(whole, F.col("surname.value")))
        | (F.col("given").isNotNull() & (count(F.col("given.form")) < 1) & ~F.exists("words", lambda w: F.startswith(w, F.col("given.value"))))
        | (F.col("middle").isNotNull() & (count(F.col("middle.value")) < twice) & ~((F.col("middle.votes") == 1) & (twice == 1) & F.exists("words", lambda w: (F.length(w) > 2) & (F.levenshtein(w, F.col("middle.value"), 2) >= 0))))
    )
    found.append(named.filter(F.coalesce(lacks, F.lit(False)) | ((F.size("words") == 0) & F.coalesce(F.col("surname"), F.col("given")).isNotNull())).select("id", F.lit("name").alias("field")))
    return found[0].unionByName(found[1]).unionByName(found[2]).select(F.col("id").alias("canonical_id"), "field").distinct()
