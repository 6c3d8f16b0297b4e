import json

from pyspark.sql import functions as F

from linkwright.operators.profile import distribution_change, profile, unusual_loads, value_counts
from linkwright.operators.search import apply_filters, influence_histogram
from linkwright.plans.pipeline import run
from linkwright.plans.quality import well_formed
from linkwright.sources import normalize, readers, sinks
from linkwright.sources.synthetic import write_all
from linkwright.streaming.referrals import referral_counts


def test_run(spark, tmp_path):
    write_all(spark, tmp_path / "in", 40)
    got = run(spark, str(tmp_path / "in"), tmp_path / "out")
    assert got["status"] == "success" and got["total_records"] == sum(n for s, n in got["source_counts"].items() if s != "referral")
    exports = readers.load_exports(spark, got["output_dir"])
    assert exports["canonical_physicians"].count() == got["canonical_physician_count"]
    assert json.loads(next((tmp_path / "out").glob("runs/*/reports/data_quality.json")).read_text())["overall"]["records"] == got["total_records"]
    assert sinks.seed_rows(exports["canonical_physicians"]).filter("id is null").count() == 0


def test_normalize(spark):
    cms = spark.createDataFrame([("s1", "12345XXXXX", "SMITH, JOHN", "CV", "H"), (None, "1234567890", "LEE, ANN", None, None)], "source_id string, npi string, provider_name string, provider_specialty string, facility_name string")
    r = {x["name_last"]: x for x in normalize.normalize_cms(cms).collect()}
    assert r["SMITH"]["npi"] is None and r["LEE"]["npi"] == "1234567890" and len(r["LEE"]["source_id"]) == 16
    pub = spark.createDataFrame([("p1", "J. Smith", "Clinic, Boston, ma"), ("p2", "A B", "Clinic, Boston"), ("p3", "A B", "Clinic"), ("p4", None, None)], "source_id string, author_name string, author_affiliation string")
    p = {x["source_id"]: (x["facility_name"], x["facility_city"], x["facility_state"]) for x in normalize.normalize_publications(pub).collect()}
    assert p == {"p1": ("Clinic", "Boston", "MA"), "p2": ("Clinic", None, None), "p3": (None, None, None), "p4": (None, None, None)}


def test_upsert(spark):
    old = spark.createDataFrame([("a", "1", 1), ("a", "2", 1)], "source string, source_id string, v int")
    new = spark.createDataFrame([("a", "2", 5), ("a", "2", 7), ("b", "1", 2)], old.schema)
    assert sorted(map(tuple, sinks.upsert(old, new).collect())) == [("a", "1", 1), ("a", "2", 7), ("b", "1", 2)]


def test_tables(spark):
    sinks.create_tables(spark)
    sinks.create_tables(spark)
    assert {"match_pairs", "referrals"} <= {t.name for t in spark.catalog.listTables()}
    sinks.drop_tables(spark)


def test_filters(spark):
    df = spark.createDataFrame([("Ann", "MA", 0.9), (None, "MA", 0.9), ("Bob", "NY", 0.1)], "name string, state string, confidence double")
    assert apply_filters(df, ["MA"], ["x"], 0.5, "a").count() == 1 and apply_filters(df).count() == 3
    assert influence_histogram(df.withColumn("influence", F.col("confidence")), 2).count() == 2


def _profiled(spark, rows):
    counts = value_counts(spark.createDataFrame(rows, "source string, load_id long, npi string, field string"), ["npi"], ("source", "load_id"))
    return counts, {"npi": F.col("value").rlike(r"\A[0-9]{10}\z")}


def test_profile(spark):
    rows = [("a", 1, "1234567890", "x"), ("a", 1, "1234567890", "x"), ("a", 1, None, "x"), ("a", 1, "  ", None), ("a", 1, "12345", "x"), ("a", 1, "1234567890\n", "x"), ("b", 2, None, None)]
    counts, tests = _profiled(spark, rows)
    got = {r["source"]: r for r in profile(counts, tests, ("source", "load_id")).collect()}
    a = got["a"]
    assert (a["n_rows"], a["n_missing"], a["n_malformed"], a["n_distinct"], a["top_value"], a["top_rows"]) == (6, 2, 2, 3, "1234567890", 2)
    assert got["b"]["share_malformed"] is None and got["b"]["share_top"] is None and got["b"]["share_missing"] == 1
    assert profile(counts.limit(0), tests, ("source", "load_id")).count() == 0


def test_unusual_loads(spark):
    good = [(s, load, f"1{load}{i:08d}"[:10], None) for s in "ab" for load in (1, 2, 3) for i in range(10)]
    bad = [("a", 4, None, None)] * 8 + [("a", 4, "9123456789", None)] * 2
    counts, tests = _profiled(spark, [r for r in good if r[0] == "a"] + bad)
    got = {tuple(r) for r in unusual_loads(counts, tests, "load_id", "source").collect()}
    assert got == {(4, "npi", "missing"), (4, "npi", "repeated"), (4, "npi", "shifted")}
    change = {r["load_id"]: r for r in distribution_change(counts, tests, "load_id", "source").collect()}
    assert abs(change[4]["distance"] - 30 / 32) < 1e-9 and change[1]["psi"] >= 0


def test_states(spark):
    zips = spark.createDataFrame([("MA",), (None,)], "state string")
    df = spark.createDataFrame([("MA",), ("ma",), (None,)], "value string")
    assert [r[0] for r in df.select(F.coalesce(well_formed(zips)["facility_state"], F.lit(False))).collect()] == [True, False, False]


def test_stream(spark, tmp_path):
    rows = [("1", "2", "2024-01-01"), ("1", "2", "2024-01-02"), ("1", "1", "2024-01-02"), (None, "2", "2024-01-02")]
    spark.createDataFrame(rows, "referring_npi string, receiving_npi string, referral_date string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("referring_npi string, receiving_npi string, referral_date string").parquet(str(tmp_path / "in"))
    q = referral_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert spark.table("counts").select("referrals").collect()[0][0] == 2
    finally:
        q.stop()
