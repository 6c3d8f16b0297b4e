import math
import random

import pytest
from pyspark.sql import functions as F

from linkwright.functions import geo, strings
from linkwright.functions.names import display_name, names_match, parse_name, standardize_name
from linkwright.functions.similarity import location_score, name_similarity, npi_match, score_pairs

NAMES = [
    ("SMITH, JOHN A", ("JOHN", "SMITH", "A", None, None)),
    ("John A. Smith, MD", ("John", "Smith", "A", "MD", None)),
    ("Dr. John Smith", ("John", "Smith", None, None, "DR")),
    ("prof John Smith", ("John", "Smith", None, None, "PROF")),
    ("John Smith MD PhD FACS FACC Jr", ("John", "Smith", None, "MD, PHD, FACS, FACC, JR", None)),
    ("John Smith, M.D., Ph.D., F.A.C.S., F.A.C.C., F.A.C.P., Sr., III", ("John", "Smith", None, "MD, PHD, FACS, FACC, FACP, SR, III", None)),
    ("Smith,", (None, "Smith,", None, None, None)),
    ("John Smith MD, PhD", ("John", "Smith", None, "MD, PHD", None)),
    ("Smith", (None, "Smith", None, None, None)),
    ("J. Smith", ("J.", "Smith", None, None, None)),
    ("J.A. Smith", ("J", "Smith", "A", None, None)),
    ("J. A. Smith", ("J", "Smith", "A", None, None)),
    ("DE LA CRUZ, JOHN", ("JOHN", "DE LA CRUZ", None, None, None)),
    ("John  De La Cruz", ("John", "Cruz", "De La", None, None)),
    ("  ", (None,) * 5),
    (None, (None,) * 5),
    ("MD", (None, None, None, "MD", None)),
    ("O'Brien, Mary Kate Ann", ("Mary", "O'Brien", "Kate Ann", None, None)),
]


def test_parse_name(spark):
    df = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(NAMES)], "i int, n string").select("i", parse_name(F.col("n")).alias("p"))
    got = {r["i"]: tuple(r["p"]) for r in df.collect()}
    assert [got[i] for i in range(len(NAMES))] == [x for _, x in NAMES]


def test_written_names(spark):
    df = spark.createDataFrame([("John", "Smith", "Andrew"), (None, "Smith", None), ("John", None, None)], "f string, l string, m string")
    c = [F.col(x) for x in "flm"]
    assert [r[0] for r in df.select(standardize_name(*c)).collect()] == ["SMITH, JOHN A", "SMITH,", ""]
    assert [r[0] for r in df.select(display_name(*c)).collect()] == ["SMITH, JOHN A", "SMITH", "JOHN"]


def test_names_match(spark):
    rows = [("John", "Smith", "J", "SMITH", True), ("John", "Smith-Jones", "John", "SmithJones", True), (None, "Smith", "John", "Smith", True), ("John", "Smith", "Mary", "Smith", False), ("John", "", "John", "", False), ("John", None, "John", "Smith", False)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e boolean")
    assert all(r[0] == r[1] for r in df.select(names_match(*(F.col(x) for x in "abcd")), "e").collect())


@pytest.mark.parametrize(("a", "b", "s"), [("MARTHA", "MARHTA", 0.9611), ("DIXON", "DICKSONX", 0.8133), ("SMITH", "SMYTH", 0.8933), ("ABXYZQ", "ABMNOP", 0.5556), ("", "A", 0.0), ("A", "A", 1.0)])
def test_jaro_winkler(a, b, s):
    assert strings.jaro_winkler(a, b) == pytest.approx(s, abs=1e-4)


def test_ratios():
    assert strings.ratio("ABCD", "BCDE") == 75 and strings.token_sort_ratio("B A", "A B") == 100 and strings.partial_ratio("BCD", "ABCDE") == 100 and strings.ratio("", "") == 100


def test_places(spark):
    z = geo.geocode(spark.createDataFrame([("02101-1234",), ("02199",), ("99999",), (None,), ("2101",), ("",)], "z string"), "z", geo.default_centroids(spark), "ordinal")
    got = {r["z"]: r["latitude"] for r in z.collect()}
    assert got == {"02101-1234": 42.3601, "02199": 42.3601, "99999": None, None: None, "2101": 42.3601, "": None}
    df = spark.createDataFrame([(42.36, -71.06, 40.75, -74.0, "MA", "NY"), (1.0, 1.0, 1.0, 1.0, "A", "B"), (None, 1.0, 1.0, 1.0, "MA", "ma"), (None, None, None, None, "MA", "NY"), (None, None, None, None, None, "NY")], "a double, b double, c double, d double, s string, t string")
    at = [F.col(x) for x in "abcd"]
    assert df.select(geo.distance_miles(*at)).first()[0] == pytest.approx(190, abs=5)
    assert [r[0] for r in df.select(location_score(*at, F.col("s"), F.col("t"))).collect()] == [0.1, 1.0, 0.3, 0.1, 0.2]
    assert [r[0] for r in df.select(geo.nearby(*at)).collect()] == [False, True, False, False, False]


def test_npi_match(spark):
    rows = [("1234567890", "1234567890", 1.0), ("1234567890", "1234567891", 0.0), ("123", "1234567890", None), (None, "1234567890", None)]
    assert all(r[0] == r[1] for r in spark.createDataFrame(rows, "a string, b string, e double").select(npi_match(F.col("a"), F.col("b")), "e").collect())


def test_scores(spark):
    def side(k, npi, first, last, spec):
        return {f"npi_{k}": npi, f"name_first_{k}": first, f"name_last_{k}": last, f"specialty_{k}": spec}

    cases = [(side(1, None, "John", "Smith", "Cardiology") | side(2, None, "J", "SMITH", "CV"), 1.0, 0.8, 1.0), (side(1, None, None, "O'Brien", "Cardiology") | side(2, None, "Al", "OBRIEN", "Dermatology"), 1.0, 0.5, 0.0), (side(1, None, "Ann", None, None) | side(2, None, "Ann", "Lee", "x"), 0.0, 1.0, None), (side(1, None, "Ann", "Lee", "Cardiologi") | side(2, None, "Anne", "Leigh", "Cardiology"), strings.jaro_winkler("LEE", "LEIGH"), strings.jaro_winkler("ANN", "ANNE"), 0.9)]
    cols = "npi name_first name_last specialty".split()
    schema = ", ".join(f"{c}_{k} string" for k in (1, 2) for c in cols) + ", i int"
    df = spark.createDataFrame([(*(d[f"{c}_{k}"] for k in (1, 2) for c in cols), i) for i, (d, *_) in enumerate(cases)], schema)
    for k in (1, 2):
        df = df.withColumns({f"latitude_{k}": F.lit(None).cast("double"), f"longitude_{k}": F.lit(None).cast("double"), f"facility_state_{k}": F.lit(None).cast("string")})
    got = {r["i"]: r for r in score_pairs(df).collect()}
    for i, (_, last, first, spec) in enumerate(cases):
        assert (got[i]["last_score"], got[i]["first_score"]) == pytest.approx((last, first))
        assert got[i]["specialty_match"] == (None if spec is None else pytest.approx(spec))
        assert math.isclose(got[i]["name_score"], 0.6 * last + 0.4 * first)


def test_name_similarity(spark):
    df = spark.createDataFrame([("John Smith", " JOHN SMITH "), (None, "x"), ("", "x"), ("John Smith", "Smith John")], "a string, b string")
    got = [r[0] for r in name_similarity(df.coalesce(1), "a", "b").orderBy("a", "b").select("name_similarity").collect()]
    assert sorted(got)[:2] == [0.0, 0.0] and max(got) == 1.0 and 0.5 < sorted(got)[2] < 1.0


def test_metrics_of_many_words_are_those_of_one():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ABCÉ -'") for _ in range(rng.choice((0, 1, 2, 5, 9, 30, 64))))
    pairs = [(word(), word()) for _ in range(3000)] + [(w := word(), w) for _ in range(50)] + [("MARTHA", "MARHTA"), ("", "")]
    for name, many in strings.MANY.items():
        assert many([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [strings.METRICS[name](a, b) for a, b in pairs]


def test_metrics_of_pairs_need_no_shuffle(spark):
    df = spark.createDataFrame([("LEE", "LEIGH"), ("A" * 70, "A" * 69), ("A\x00", "A"), ("Lee", None), ("same", "same")], "a string, b string")
    got = strings.with_metric(df, "m", F.col("a"), F.col("b"), "ratio", F.col("a") != F.col("b"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(a, b): strings.ratio(a, b) if b and a != b else None for a, b in df.collect()}
    assert {(r["a"], r["b"]): r["m"] for r in got.collect()} == want
