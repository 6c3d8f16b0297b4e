import itertools

import pytest

from linkwright.llm.values import UNMATCHED, SHORT_FORMS, WordIndex, edit_distance, map_typed, mapped_values

SPEC = [("SP1", "Pediatric Surgery", "PDS"), ("SP2", "Hand Surgery", "HND"), ("SP3", "Allergy and Immunology", "AI"), ("SP4", "Otolaryngology", "ENT"), ("SP5", "Family and Community Medicine", "FCM"), ("SP6", "Adult Cardiology", "CARD"), ("SP7", "Pediatric Cardiology", "PCARD"), (None, "Ghost", "G"), ("SP8", None, None)]
CASES = [
    ("pEDIATRIC sURGERY", "SP1"), ("Surgery, Pediatric", "SP1"), ("Ped Sx", "SP1"), ("P.D.S.", "SP1"), ("pds", "SP1"), ("Dept. of Pediatric Surgery", "SP1"), ("Pediattric Surgrey (staff)", "SP1"), ("PediatricSurgery", "SP1"),
    ("Hand_Surgery", "SP2"), ("Allergy & Immunol.", "SP3"), ("A.I.", "SP3"), ("otolaryng", "SP4"), ("E.N.T.", "SP4"), ("Family/Commun. Med", "SP5"), ("Cardiology - Adult", "SP6"), ("Paediatric Cardiology", "SP7"), ("Cardio Pediatric", "SP7"),
    ("n/a", UNMATCHED), ("-", UNMATCHED), ("Front Desk", UNMATCHED), ("Surgery", UNMATCHED), ("Hand Modelling Studio", UNMATCHED),
]


def test_typed_values(spark):
    refs = spark.createDataFrame(SPEC, "specialty_id string, specialty_name string, short_code string")
    rows = spark.createDataFrame([(v, "clash") for v, _ in CASES] + [(None, "x"), ("", "x"), ("  ", "x"), ("x" * 20_000, "x")], "v string, n string")
    got = {r["value"]: r["ref_id"] for r in map_typed(rows, "v", refs, "specialty_id", "specialty_name", "short_code").collect()}
    assert {v: got[v] for v, _ in CASES} == dict(CASES)
    assert got[None] == got[""] == got["x" * 20_000] == UNMATCHED


def test_empty(spark):
    refs = spark.createDataFrame(SPEC, "specialty_id string, specialty_name string, short_code string")
    rows = spark.createDataFrame([("Hand Surgery",)], "v string")
    assert map_typed(rows.limit(0), "v", refs, "specialty_id", "specialty_name", "short_code").count() == 0
    assert [r["ref_id"] for r in map_typed(rows, "v", refs.limit(0), "specialty_id", "specialty_name", "short_code").collect()] == [UNMATCHED]


def test_words_of_their_own(spark):
    """A frequent word is no slip of another, a rare one is."""
    refs = spark.createDataFrame([("F1", "Falcombe Hospital")], "id string, name string")
    rows = spark.createDataFrame([("Falcombe Hospital",)] * 40 + [("Marcombe Hospital",)] * 30 + [("Falcomeb Hospital",)], "v string")
    got = {r["value"]: r["ref_id"] for r in map_typed(rows, "v", refs, "id", "name").collect()}
    assert got == {"Falcombe Hospital": "F1", "Marcombe Hospital": UNMATCHED, "Falcomeb Hospital": "F1"}


def test_ties(spark):
    refs = spark.createDataFrame([("B", "Eye Center"), ("A", "Eye Center")], "id string, name string")
    got = map_typed(spark.createDataFrame([("eye center",)], "v string"), "v", refs, "id", "name").first()
    assert got["ref_id"] == UNMATCHED


def test_rows(spark):
    specs = spark.createDataFrame(SPEC, "specialty_id string, specialty_name string, short_code string")
    facs = spark.createDataFrame([("F1", "Ivel Infirmary", 1)], "facility_id string, facility_name string, record_id int")
    rows = spark.createDataFrame([(1, "Hand Surgery", "ivel infmy"), (2, "hand surgery", None), (3, " ", "TBD"), (3, " ", "TBD")], "record_id long, specialty string, facility_name string")
    got = sorted(tuple(r) for r in mapped_values(rows, specs, facs).collect())
    assert got == [(1, "facility_name", "F1"), (2, "specialty", "SP2"), (3, "facility_name", UNMATCHED), (3, "facility_name", UNMATCHED)]


@pytest.mark.parametrize(("a", "b", "d"), [("abc", "acb", 1), ("abc", "abc", 0), ("abcd", "badc", 2), ("a", "abcd", 3), ("kitten", "sitting", 3)])
def test_edit_distance(a, b, d):
    assert edit_distance(a, b, 3) == d


def test_word_index():
    ix = WordIndex({"hospital": 100, "health": 100, "center": 100, "surgery": 100}, SHORT_FORMS)
    assert ix.find("hosp", 5, 0.04) == {"hospital": 1} and ix.find("hsptl", 5, 0.04) == {"hospital": 2} and ix.find("ctr", 1, 0.04)["center"] <= 2
    assert ix.find("hopsital", 1, 0.04) == {"hospital": 1} and ix.find("sx", 9, 0.04)["surgery"] == 1 and not ix.find("zzz", 1, 0.04)


def test_many_entries_and_long_values(spark):
    from itertools import product

    from linkwright.llm.values import Form, resolve_values

    words = ["".join(w) for w in product("bcdfghjklmnpqrstvwxz", "aeiou", "bcdfghjklmnpqrstvwxz", "aeioubcdfghjklmnpq")][:34_000]
    forms = [Form(0, str(i), (w,), False) for i, w in enumerate(words)]
    spread = [Form(1, "wide", tuple(sorted(words[:300])), False)]
    values = spark.createDataFrame([(0, words[33_999], 1), (0, words[7], 5), (1, " ".join(words[:300]), 1), (1, words[0], 1)], "list int, value string, n long")
    got = {(r["list"], r["value"]): r["ref_id"] for r in resolve_values(values, forms + spread).collect()}
    assert got[0, words[33_999]] == "33999" and got[0, words[7]] == "7"
    assert got[1, " ".join(words[:300])] == "wide" and got[1, words[0]] == "UNMATCHED"


def test_bitmap_tells_tokens_apart():
    from linkwright.llm.values import BITMAPS, bitmap

    # One number of 64 bits let 0 pass for 64; no two of the first 384 tokens share a bit now.
    each = [bitmap([t]) for t in range(64 * len(BITMAPS))]
    assert len(set(each)) == len(each) and all(sum(b != 0 for b in m) == 1 for m in each)
    assert bitmap([0, 63, 64, 500]) == tuple(a | b | c | d for a, b, c, d in zip(bitmap([0]), bitmap([63]), bitmap([64]), bitmap([500])))


def test_values_of_the_same_words_are_tied_once(spark, monkeypatch):
    from linkwright.llm import values

    refs = spark.createDataFrame(SPEC, "specialty_id string, specialty_name string, short_code string")
    rows = spark.createDataFrame([(v,) for v in ("Hand Surgery", "HAND SURGERY", "hand-surgery", "(Hand) Surgery", "Hand Surgery, MD", "HandSurgery", "Surgery Hand", "P.D.S.", "pds", "other")], "v string")
    kept = {}
    store = values.stored
    monkeypatch.setattr(values, "stored", lambda df, name: kept.setdefault(name, store(df, name)))
    got = {r["value"]: r["ref_id"] for r in map_typed(rows, "v", refs, "specialty_id", "specialty_name", "short_code").collect()}
    assert got == {r[0]: "SP2" for r in rows.collect()} | {"P.D.S.": "SP1", "pds": "SP1", "other": UNMATCHED}
    bags = [r["bag"] for r in kept["bags"].collect()]
    assert sorted(bags) == ["hand surgery", "handsurgery", "handsurgerymd", "other", "pds", "surgery hand", "surgeryhand"]


def test_edit_distance_without_ends_that_agree():
    def whole(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
                if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    words = ["".join(w) for n in range(6) for w in itertools.product("ab", repeat=n)] + ["abcab", "acbab", "bcaab", "abcabc"]
    assert all(edit_distance(a, b, most) == min(whole(a, b), most + 1) for a in words for b in words for most in (1, 2, 9))
