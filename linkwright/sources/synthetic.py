"""Invented source tables: every value follows from the row's number and a seed, so any part can be made again."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = ("Ada", "Boris", "Clara", "Deniz", "Emil", "Farah", "Goran", "Hana", "Ivan", "Jana", "Kofi", "Lena", "Mario", "Nadia", "Omar", "Petra", "Quinn", "Rosa", "Sven", "Tara")
LAST_A = ("Bar", "Cor", "Dal", "Fen", "Gar", "Hol", "Kir", "Lom", "Mar", "Nor", "Pel", "Rad", "Sel", "Tor", "Var", "Wen")
LAST_B = ("berg", "dale", "field", "gard", "holt", "kov", "lund", "man", "ner", "shaw", "son", "ski", "stein", "ton", "vale", "wood")
SPECIALTIES = {
    "Internal Medicine": ("Internal Med", "Int Medicine", "IM"), "Family Medicine": ("Family Med", "FP"), "Cardiology": ("Cardiovascular Disease", "CV"), "General Surgery": ("Gen Surgery",), "Pediatrics": ("Peds",), "Gastroenterology": ("GI", "Gastro"), "Emergency Medicine": ("EM",), "Neurology": ("Neuro",),
}
HOSPITALS = ("Saint Alma Hospital", "Lakeside Medical Center", "Northgate Hospital", "Riverton Medical Center", "Hillcrest Hospital", "Oakfield Medical Center")
PLACES = (("Boston", "MA", "02101"), ("New York", "NY", "10001"), ("Chicago", "IL", "60601"), ("Houston", "TX", "77001"), ("Denver", "CO", "80201"), ("Seattle", "WA", "98101"))


def draw(salt: str, *keys: str | Column) -> Column:
    """A number from 0 to 1 that follows from the keys and the salt."""
    return F.pmod(F.xxhash64(F.lit(salt), *(F.col(k) if isinstance(k, str) else k for k in keys)), F.lit(1 << 30)) / float(1 << 30)


def pick(values: tuple, salt: str, *keys: str | Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(draw(salt, *keys) * len(values)) + 1).cast("int"))


def add_typo(c: Column, salt: str, *keys: str | Column, rate: float = 0.1) -> Column:
    """Swaps, drops, doubles or replaces one letter in a share of the rows."""
    at = (F.floor(draw(salt + "at", *keys) * F.length(c)) + 1).cast("int")
    kind = F.floor(draw(salt + "kind", *keys) * 4)
    before, letter, after = F.substr(c, F.lit(1), at - 1), F.substr(c, at, F.lit(1)), F.substr(c, at + 1)
    swap = F.concat(before, F.substr(c, at + 1, F.lit(1)), letter, F.substr(c, at + 2))
    changed = F.when(kind == 0, swap).when((kind == 1) & (F.length(c) > 3), F.concat(before, after)).when(kind == 2, F.concat(before, letter, letter, after)).otherwise(F.concat(before, pick(tuple("aeinorst"), salt + "new", *keys), after))
    return F.when((draw(salt, *keys) < rate) & (F.length(c) > 0), changed).otherwise(c)


def maybe_upper(c: Column, salt: str, *keys: str | Column, rate: float = 0.3) -> Column:
    return F.when(draw(salt, *keys) < rate, F.upper(c)).otherwise(c)


def maybe_missing(c: Column, salt: str, *keys: str | Column, rate: float = 0.1) -> Column:
    return F.when(draw(salt, *keys) >= rate, c)


def vary_hospital(c: Column, salt: str, *keys: str | Column) -> Column:
    k = F.floor(draw(salt, *keys) * 8)
    return F.when(k == 0, F.replace(c, F.lit("Hospital"), F.lit("Hosp"))).when(k == 1, F.replace(c, F.lit("Medical Center"), F.lit("Med Ctr"))).when(k == 2, F.replace(c, F.lit("Saint"), F.lit("St."))).when(k == 3, F.concat(c, F.lit(" - Main Campus"))).when(k == 4, F.concat(c, F.lit(" East"))).when(k == 5, add_typo(c, salt, *keys, rate=0.5)).otherwise(c)


def vary_specialty(c: Column, salt: str, *keys: str | Column) -> Column:
    out = c
    for name, forms in SPECIALTIES.items():
        out = F.when((c == name) & (draw(salt, *keys) > 0.5), pick(forms, salt + name, *keys)).otherwise(out)
    return out


def vary_address(c: Column, salt: str, *keys: str | Column) -> Column:
    k = F.floor(draw(salt, *keys) * 4)
    return F.when(k == 0, F.regexp_replace(c, " St$", " Street")).when(k == 1, F.regexp_replace(c, " Ave$", " Avenue")).when(k == 2, F.upper(c)).otherwise(c)


def corrupt_npi(c: Column, salt: str, *keys: str | Column, rate: float = 0.05) -> Column:
    k = F.floor(draw(salt + "kind", *keys) * 3)
    return F.when(draw(salt, *keys) < rate, F.when(k == 0, F.lit(None)).when(k == 1, F.concat(F.substring(c, 1, 5), F.lit("XXXXX"))).otherwise(F.substring(c, 1, 8))).otherwise(c)


def physicians(spark: SparkSession, n: int = 500, seed: int = 42) -> DataFrame:
    """The true entities behind all sources."""
    p = spark.range(n).withColumn("seed", F.lit(seed))
    k = ("id", "seed")
    place = pick(tuple(range(len(PLACES))), "place", *k)
    at = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in PLACES)), place + 1)
    return p.select(
        F.concat(F.lit("TRUE_"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("true_physician_id"), "id", "seed", F.concat(F.lit("1"), F.lpad(F.pmod(F.xxhash64(*k), F.lit(999_999_999)).cast("string"), 9, "0")).alias("npi"),
        pick(FIRST, "first", *k).alias("first"), F.concat(pick(LAST_A, "la", *k), F.lower(pick(LAST_A, "lm", *k)), pick(LAST_B, "lb", *k)).alias("last"), F.when(draw("m", *k) < 0.7, pick(tuple("ABCDEFGHJKLM"), "mid", *k)).alias("middle"),
        pick(tuple(SPECIALTIES), "spec", *k).alias("specialty"), pick(HOSPITALS, "hosp", *k).alias("hospital"), at(0).alias("city"), at(1).alias("state"), at(2).alias("zip"),
    )


def _repeated(p: DataFrame, salt: str, most: int, share: float = 1.0) -> DataFrame:
    n = F.when(draw(salt + "has", "id", "seed") < share, (F.floor(draw(salt + "n", "id", "seed") * most) + 1).cast("int")).otherwise(0)
    return p.withColumn("n", n).filter("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))


def _date(salt: str) -> Column:
    return F.date_format(F.date_add(F.lit("2022-01-01").cast("date"), F.floor(draw(salt, "id", "seed", "k") * 1000).cast("int")), "yyyy-MM-dd")


def tables(spark: SparkSession, n: int = 500, seed: int = 42) -> dict[str, DataFrame]:
    """cms, license, hospital, publication, referral and ground_truth with the columns of sources.readers."""
    p = physicians(spark, n, seed)
    k = ("id", "seed", "k")
    sid = lambda s: F.concat(F.lit(s + "_"), F.col("id").cast("string"), F.lit("_"), F.col("k").cast("string")).alias("source_id")
    mid = F.when(draw("showm", *k) > 0.4, F.col("middle"))
    first_last = F.concat_ws(" ", "first", F.concat(mid, F.lit(".")), "last")
    cms = _repeated(p, "cms", 5).select(sid("cms"), corrupt_npi(F.col("npi"), "npi", *k).alias("npi"), F.upper(F.concat_ws(" ", F.concat("last", F.lit(",")), "first", mid)).alias("provider_name"), vary_specialty(F.col("specialty"), "vs", *k).alias("provider_specialty"), vary_hospital(F.col("hospital"), "vh", *k).alias("facility_name"), F.lit(None).cast("string").alias("facility_npi"), F.concat(F.lit("99"), F.pmod(F.xxhash64(*k), F.lit(1000)).cast("string")).alias("procedure_code"), _date("pd").alias("procedure_date"), F.concat(F.lit("PAT_"), F.pmod(F.xxhash64("k", "id"), F.lit(10_000)).cast("string")).alias("patient_id"), "true_physician_id")
    lic = p.withColumn("k", F.lit(1)).select(sid("lic"), F.concat(F.col("state"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("license_number"), F.concat(add_typo(first_last, "lt", *k, rate=0.05), F.lit(", MD")).alias("physician_name"), vary_specialty(F.col("specialty"), "ls", *k).alias("specialty"), F.col("state").alias("license_state"), F.lit("active").alias("license_status"), vary_address(F.concat(F.pmod(F.xxhash64("id"), F.lit(9000)).cast("string"), F.lit(" Main St")), "va", *k).alias("address_line1"), F.col("city").alias("address_city"), F.col("state").alias("address_state"), maybe_missing(F.col("zip"), "mz", *k).alias("address_zip"), F.lit(None).cast("string").alias("medical_school"), F.lit(None).cast("string").alias("graduation_year"), "true_physician_id")
    hosp = _repeated(p, "hosp", 2, 0.9).select(sid("hosp"), F.hash("hospital").cast("string").alias("hospital_id"), vary_hospital(F.col("hospital"), "hh", *k).alias("hospital_name"), maybe_upper(F.concat(F.lit("Dr. "), first_last), "hu", *k).alias("physician_name"), vary_specialty(F.col("specialty"), "hs", *k).alias("department"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("email"), _date("hd").alias("start_date"), maybe_missing(F.col("npi"), "hn", *k, rate=0.4).alias("npi"), "true_physician_id")
    pub = _repeated(p, "pub", 5, 0.4).select(sid("pub"), F.concat(F.lit("PUB"), F.xxhash64(*k).cast("string")).alias("publication_id"), F.lit("A study").alias("title"), F.when(draw("style", *k) < 0.5, F.concat(F.substring("first", 1, 1), F.lit(". "), F.col("last"))).otherwise(first_last).alias("author_name"), F.lit("1").alias("author_position"), F.concat_ws(", ", "hospital", "city", "state").alias("author_affiliation"), _date("ud").alias("publication_date"), F.lit("Journal").alias("journal"), "true_physician_id")
    other = F.pmod(F.xxhash64("id", "seed", "k"), F.lit(n))
    to = p.select(F.col("id").alias("to"), F.col("npi").alias("receiving_npi"), F.col("true_physician_id").alias("receiving_true_id"))
    ref = _repeated(p, "ref", 15, 0.12).withColumn("to", other).join(to, "to").select(F.col("npi").alias("referring_npi"), "receiving_npi", F.concat(F.lit("PAT_"), F.pmod(F.xxhash64("k", "id"), F.lit(10_000)).cast("string")).alias("patient_id"), _date("rd").alias("referral_date"), F.lit("Z00").alias("diagnosis_code"), F.col("true_physician_id").alias("referring_true_id"), "receiving_true_id")
    truth = [t.select("source_id", "true_physician_id", F.lit(s).alias("source")) for s, t in (("cms", cms), ("license", lic), ("hospital", hosp), ("publication", pub))]
    return {"cms": cms, "license": lic, "hospital": hosp, "publication": pub, "referral": ref, "ground_truth": truth[0].unionByName(truth[1]).unionByName(truth[2]).unionByName(truth[3])}


def write_all(spark: SparkSession, folder: str | Path, n: int = 500, seed: int = 42) -> None:
    from linkwright.sources.readers import SOURCES
    from linkwright.sources.sinks import write_csv

    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, df in tables(spark, n, seed).items():
        write_csv(df, Path(folder) / SOURCES[name][0])
