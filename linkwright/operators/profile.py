"""Exact column profiles from unpivoted column-value counts, and loads that depart from the usual."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A value counts as well-formed if its column's test holds for the value exactly as stored.
Tests = Mapping[str, Column]


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., field, value, n): how often each column has each value, in one pass.

    Columns are unpivoted as strings. The counts are combined in each task
    before they are sent, so a value that a third of all rows have costs one
    row a task. Null is a value. Columns named like by, field, value or n don't
    clash: only the columns asked for are read.
    """
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))
    return df.select(*(F.col(f"`{b}`").alias(f"by_{b}") for b in by), F.explode(pairs).alias("p")).groupBy(*(f"by_{b}" for b in by), "p").agg(F.count(F.lit(1)).alias("n")).select(*(F.col(f"by_{b}").alias(b) for b in by), "p.field", "p.value", "n")


def _missing() -> Column:
    return F.col("value").isNull() | ~F.col("value").rlike("[^ ]")


def marked(counts: DataFrame, tests: Tests) -> DataFrame:
    """counts with missing (null or spaces only) and well (present and of the form that tests asks of the field; without a test any present value)."""
    well = F.lit(True)
    for field, test in tests.items():
        well = F.when(F.col("field") == field, F.coalesce(test, F.lit(False))).otherwise(well)
    return counts.withColumn("missing", _missing()).withColumn("well", ~F.col("missing") & well)


def profile(counts: DataFrame, tests: Tests, by: Sequence[str] = ()) -> DataFrame:
    """One row for each group of by and field, exact: rows, missing, malformed, distinct values, smallest and largest value, most frequent well-formed value and its rows, entropy.

    counts: value_counts(). Shares are null where nothing is there to share.
    Ties for the most frequent value go to the smaller. An empty table gives no rows.
    """
    m = marked(counts, tests)
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*by, "field"))
    present, well = ~F.col("missing"), F.col("well")
    return (
        m.withColumn("part", -p * F.log2(p))
        .groupBy(*by, "field")
        .agg(
            F.sum("n").alias("n_rows"), F.sum(F.when(F.col("missing"), F.col("n")).otherwise(0)).alias("n_missing"),
            F.sum(F.when(present & ~well, F.col("n")).otherwise(0)).alias("n_malformed"), F.sum(F.when(well, F.col("n")).otherwise(0)).alias("n_well"),
            F.count(F.when(present, F.lit(1))).alias("n_distinct"), F.min(F.when(present, F.col("value"))).alias("least"), F.max(F.when(present, F.col("value"))).alias("greatest"),
            F.min(F.when(well, F.struct((-F.col("n")).alias("n"), "value"))).alias("top"), F.sum("part").alias("entropy"),
        )
        .select(
            *by, "field", "n_rows", "n_missing", "n_malformed", "n_distinct", "least", "greatest", F.col("top.value").alias("top_value"), (-F.col("top.n")).alias("top_rows"), "entropy",
            (F.col("n_missing") / F.col("n_rows")).alias("share_missing"),
            F.when(F.col("n_rows") > F.col("n_missing"), F.col("n_malformed") / (F.col("n_rows") - F.col("n_missing"))).alias("share_malformed"),
            F.when(F.col("n_well") > 0, -F.col("top.n") / F.col("n_well")).alias("share_top"),
        )
    )


def distribution_change(counts: DataFrame, tests: Tests, load: str, group: str, floor: float = 1e-4) -> DataFrame:
    """(group, load, field, distance, psi, chi_square): first characters of a load's well-formed values against all of its group's.

    distance: half the sum of absolute differences of the shares; psi: the
    population stability index, shares below floor taken as floor; chi_square:
    of the load's counts against those expected from the group's shares. Loads
    without well-formed values are left out. Counts, not rows, are compared, so
    the work follows the number of distinct first characters.
    """
    first = marked(counts, tests).filter("well").withColumn("first", F.substring("value", 1, 1)).groupBy(group, load, "field", "first").agg(F.sum("n").alias("n"))
    # Every first character of the group takes part in every load, with a count of 0 where it is missing.
    totals = first.groupBy(group, "field", "first").agg(F.sum("n").alias("all"))
    whole = totals.withColumn("q", F.col("all") / F.sum("all").over(Window.partitionBy(group, "field"))).select(group, "field", "first", "q")
    loads = first.groupBy(group, load, "field").agg(F.sum("n").alias("total"))
    grid = loads.join(whole, [group, "field"]).join(first, [group, load, "field", "first"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    p, q, e = F.col("n") / F.col("total"), F.col("q"), F.col("q") * F.col("total")
    pf, qf = F.greatest(p, F.lit(floor)), F.greatest(q, F.lit(floor))
    return grid.groupBy(group, load, "field").agg((F.sum(F.abs(p - q)) / 2).alias("distance"), F.sum((pf - qf) * F.log(pf / qf)).alias("psi"), F.sum((F.col("n") - e) ** 2 / e).alias("chi_square"))


def unusual_loads(counts: DataFrame, tests: Tests, load: str, group: str, excess: float = 0.25, distance: float = 0.4) -> DataFrame:
    """(load, field, finding): loads whose share of missing, malformed or most repeated values exceeds their group's median by more than excess, or whose first characters are further than distance from the group's.

    Medians are over the loads of the group for which the share is defined,
    the mean of the middle two if their number is even. A load of several
    groups is looked at in each, and listed once for each finding.
    """
    shares = profile(counts, tests, (group, load))
    found = F.array(F.struct(F.lit("missing").alias("finding"), F.col("share_missing").alias("share")), F.struct(F.lit("malformed").alias("finding"), F.col("share_malformed").alias("share")), F.struct(F.lit("repeated").alias("finding"), F.col("share_top").alias("share")))
    long = shares.select(group, load, "field", F.explode(found).alias("f")).select(group, load, "field", "f.*").filter("share is not null")
    medians = long.groupBy(group, "field", "finding").agg(F.expr("percentile(share, 0.5)").alias("usual"))  # exact; as many numbers as loads
    over = long.join(medians, [group, "field", "finding"]).filter(F.col("share") - F.col("usual") > excess).select(load, "field", "finding")
    shifted = distribution_change(counts, tests, load, group).filter(F.col("distance") > distance).select(load, "field", F.lit("shifted").alias("finding"))
    return over.unionByName(shifted).distinct()
