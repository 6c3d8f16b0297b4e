"""Referral edges kept up to date as referrals arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def referral_counts(stream: DataFrame, delay: str = "30 days", window: str = "7 days", time: str = "referral_date") -> DataFrame:
    """(window, referring_npi, receiving_npi, referrals, last_referral): counts by week and pair, final once the watermark has passed.

    Rows later than delay are dropped from the state by the watermark; the
    batch operator counts them.
    """
    rows = stream.filter("referring_npi is not null and receiving_npi is not null and referring_npi <> receiving_npi").withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, delay).groupBy(F.window(time, window), "referring_npi", "receiving_npi").agg(F.count(F.lit(1)).alias("referrals"), F.max(time).alias("last_referral"))
