import random
import re

import numpy as np
from pyspark.sql import functions as F

from linkwright.llm.entities import NONE, _mode, keyed, links_of, match_entities
from linkwright.llm.people import features, given_names, name_words, state_code, surname_of, valid_npi, zip5
from linkwright.llm.survivors import held_worse, layers, survivors
from linkwright.llm.variants import SIGMA, agree, average_linkage, link_variants, name_vectors, spelling, variant_pairs, vectors


def test_columns(spark):
    df = spark.createDataFrame([("Dr. Zoë M.D. O'Neil-Smith, Jr",), (None,), ("",)], "n string")
    assert [r[0] for r in df.select(name_words(F.col("n"))).collect()] == [["zoe", "oneilsmith"], None, []]
    df = spark.createDataFrame([("Van der Berg",), ("Smith-Jones",), ("Jones Smith",), ("de la",), (None,)], "n string")
    assert [r[0] for r in df.select(surname_of(F.col("n"))).collect()] == ["berg", "jonessmith", "jonessmith", "dela", None]
    df = spark.createDataFrame([("MA ", "NPI1234567893", "02139-1234"), ("Mass.", "1111111111", "2139"), ("m.a.", "123", None), ("Virginia", None, "abc"), ("??", "1234567890", "021391234"), (None, "2345678901", "02139")], "s string, n string, z string")
    assert [tuple(r) for r in df.select(state_code(F.col("s")), valid_npi(F.col("n")), zip5(F.col("z"))).collect()] == [("MA", "1234567893", "02139"), ("MA", None, None), ("MA", None, None), ("VA", None, None), (None, None, "02139"), (None, "2345678901", "02139")]


RECORD = "record_id long, source string, source_id string, npi string, name_raw string, name_first string, name_last string, name_middle string, specialty string, facility_name string, facility_state string, facility_zip string, as_of timestamp, label string"


def people(spark, n=40, seed=1):
    """Physicians with 1 to 6 records in four sources, typed with slips; the last half is labelled."""
    rng = random.Random(seed)
    firsts = ["Albert", "Beatrice", "Clifford", "Deborah", "Eleanor", "Ferdinand"]
    lasts = ["".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)) + rng.choice("nskt") for _ in range(n)]
    rows, truth, i = [], {}, 0
    for p in range(n):
        first, last, npi, fac, spec = rng.choice(firsts), lasts[p], f"{1_000_000_000 + p * 7919}", rng.randrange(4), rng.randrange(3)
        for _ in range(rng.randint(2, 6)):
            src = rng.choice(["cms", "license", "hospital", "publication"])
            la = last if rng.random() < 0.8 else last[:3] + last[4:]
            fi = first if rng.random() < 0.7 else first[0]
            sid = f"{src}_{i:05d}"
            rows.append((i, src, sid, npi if src == "cms" else None, f"{la.upper()}, {fi}" if src == "cms" else f"{fi} {la}", fi, la, None, ["Hand Surgery", "Sleep Medicine", "Wound Care"][spec], f"Clinic {'ABCD'[fac]} of the North", "MA", "02139", None, None))
            truth[sid] = p
            i += 1
    return spark.createDataFrame(rows, RECORD), truth


def refs(spark):
    return spark.createDataFrame([("S1", "Hand Surgery", "HND"), ("S2", "Sleep Medicine", "SLP"), ("S3", "Wound Care", "WND")], "specialty_id string, specialty_name string, short_code string"), spark.createDataFrame([(f"F{k}", f"Clinic {k} of the North") for k in "ABCD"], "facility_id string, facility_name string")


def person_features(spark, records, extra=()):
    spec, fac = refs(spark)
    labels = spark.createDataFrame([], "source_id string, label string")
    rows = features(records, given_names(records, labels), spec, fac, (*extra, "label"))
    return rows.withColumns({"npi9": F.substring("npi", 2, 9), "head": F.when(F.length("surname") >= 5, F.substring("surname", 1, 4)), "tail": F.when(F.length("surname") >= 5, F.expr("right(surname, 5)"))})


def test_entities(spark):
    records, truth = people(spark)
    pairs = match_entities(person_features(spark, records.unionByName(records.limit(20)))).collect()
    assert len({tuple(p)[:2] for p in pairs}) == len(pairs)
    assert all(a < b and a.split("_")[0] != b.split("_")[0] for a, b, *_ in pairs)
    right = sum(truth[a] == truth[b] for a, b, *_ in pairs)
    want = sum(truth[a] == truth[b] and a < b and a.split("_")[0] != b.split("_")[0] for a in truth for b in truth)
    assert right / len(pairs) > 0.9 and right / want > 0.8
    assert match_entities(person_features(spark, records.limit(0))).count() == 0


def test_labelled_are_left_out(spark):
    records, truth = people(spark)
    known = spark.createDataFrame([(s, f"E{p}") for s, p in truth.items() if p % 2], "source_id string, label string")
    half = person_features(spark, records).drop("label").join(known, "source_id", "left")
    labelled = {r[0] for r in half.filter("label is not null").select("source_id").collect()}
    pairs = match_entities(half, floor=0.8).collect()
    assert pairs and not {x for p in pairs for x in tuple(p)[:2]} & labelled and all(0 < p["confidence"] < 1 for p in pairs)


def test_variants(spark):
    records, truth = people(spark, seed=2)
    records = records.withColumn("raw", spelling(F.col("name_raw")))
    clusters = link_variants(person_features(spark, records, ("raw",)))
    pairs = variant_pairs(clusters).collect()
    raw = {r["source_id"]: r["raw"] for r in records.select("source_id", "raw").collect()}
    assert all(a < b and a.split("_")[0] == b.split("_")[0] and raw[a] != raw[b] for a, b in pairs)
    want = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b] and a.split("_")[0] == b.split("_")[0] and raw[a] != raw[b]}
    got = {tuple(p) for p in pairs}
    assert len(got & want) / len(got) > 0.9 and len(got & want) / len(want) > 0.8
    assert variant_pairs(link_variants(person_features(spark, records.limit(0), ("raw",)))).count() == 0


def test_vectors():
    import numpy as np

    w = np.ones(SIGMA * SIGMA)
    x = vectors(np.array(["thornton", "thronton", "", "zzz"]), w)
    assert np.allclose((x * x).sum(axis=1), [1, 1, 0, 1])
    assert 0.4 < x[0] @ x[1] < 1 and x[0] @ x[3] == 0
    n = name_vectors(np.array(["thornton", "thornton", "thornton"]), np.array(["", "ann", "bob"]), w)
    assert np.isclose(n[0] @ n[1], 0.8**0.5) and n[1] @ n[2] < 0.85


def test_agree():
    import numpy as np

    def ok(a, b):
        row = lambda t: {"initial": np.array([ord(t[0]) if t[0] else 0]), "middle": np.array([ord(t[1]) if t[1] else 0]), "known": np.array([t[2]])}
        assert agree(row(a), row(b)) == agree(row(b), row(a))
        return bool(agree(row(a), row(b))[0])

    assert ok(("j", "", 1), ("j", "", 0)) and ok(("j", "", 0), ("", "", 0)) and ok(("j", "a", 1), ("a", "", 2))
    assert not ok(("j", "", 1), ("j", "", 2)) and not ok(("j", "a", 1), ("j", "b", 1)) and not ok(("j", "", 1), ("k", "", 2))


def test_average_linkage():
    import numpy as np

    s = np.array([[1, 0.9, 0.1, 0.0], [0.9, 1, 0.5, 0.0], [0.1, 0.5, 1, 0.8], [0, 0, 0.8, 1.0]])
    assert average_linkage(s, np.ones(4), 0.5) == [0, 0, 2, 2]
    assert average_linkage(s, np.ones(4), 0.1) == [0, 0, 0, 0] and average_linkage(s[:1, :1], np.ones(1), 0.5) == [0]


def test_layers(spark):
    rng = random.Random(3)
    rows = [(f"g{rng.randrange(3)}", i, rng.randrange(4), rng.randrange(3), rng.choice([None, "2024-01-01", "2024-01-02", "2024-01-03"])) for i in range(150)]
    df = spark.createDataFrame(rows, "group string, record long, completeness int, trust int, recency string").withColumn("recency", F.col("recency").cast("timestamp"))
    got = {r["record"]: r["layer"] for r in layers(df).collect()}
    of = {r[1]: (r[0], (r[2], r[3], r[4] or "")) for r in rows}
    beats = lambda a, b: a != b and all(x >= y for x, y in zip(a, b))
    for v, (g, x) in of.items():
        above = [got[u] for u, (h, y) in of.items() if h == g and beats(y, x)]
        assert got[v] == 1 + max(above, default=0), v


def test_nulls_are_filled_from_later_layers(spark):
    """The survivor is the newest and most complete record; what it lacks comes from the first layer that has it, not from the newest record that has it."""
    rows = [
        ("g", "a", 1, "x", 3, "2024-06-01"), ("g", "b", 1, "y", 3, "2024-06-01"),
        ("g", "c", 2, "old", 0, "2024-01-01"),  # layer 3, tied with the next for c
        ("g", "c", 3, "trusted", 2, "2023-01-01"), ("g", "a", 3, "x", 2, "2023-01-01"),  # fewer than none: layer 2
        ("g", "a", 4, "outvoted", 3, "2025-01-01"),
    ]
    df = spark.createDataFrame(rows, "group string, field string, record long, value string, trust int, recency string").withColumns({"recency": F.col("recency").cast("timestamp"), "form": F.col("value"), "completeness": F.lit(1)})
    got = {r["field"]: r["value"] for r in survivors(df).collect()}
    assert got == {"a": "x", "b": "y", "c": "trusted"}
    newest = max((r for r in rows if r[1] == "c"), key=lambda r: r[5])[3]
    assert newest == "old"  # a plain sort by recency takes another


def test_survivors(spark):
    rows = [("a", "n", "r1", "x", "X", 1, 0, "2020-01-01"), ("a", "n", "r2", "x", "xx", 3, 0, "2020-01-01"), ("a", "n", "r3", "y", "Y", 3, 3, "2024-01-01"), ("a", "n", "r4", None, None, 3, 3, "2024-01-01"), ("b", "n", "r5", None, None, 0, 0, None), ("a", "n", "r3", "y", "Y", 3, 3, "2024-01-01"), (None, "n", "r6", "z", "z", 1, 1, None)]
    df = spark.createDataFrame(rows, "group string, field string, record string, value string, form string, completeness int, trust int, recency string").withColumn("recency", F.col("recency").cast("timestamp"))
    assert [(r["group"], r["value"], r["form"], r["ties"]) for r in survivors(df).collect()] == [("a", "x", "xx", ["x"])]
    assert survivors(df.limit(0)).count() == 0


def test_held(spark):
    spec, fac = refs(spark)
    rec = lambda i, src, first, last, mid, sp, fa: (i, src, f"s{i}", None, f"{first} {mid or ''} {last}", first, last, mid, sp, fa, None, None, None, None)
    rows = [rec(1, "cms", "Albert", "Krablo", "Boris", "Hand Surgery", "Clinic A of the North"), rec(2, "license", "Al", "Krablo", None, "HND", "Clinic A of the North"), rec(3, "hospital", "Albert", "Krablo", None, "Wound Care", None), rec(4, "cms", "Deborah", "Vintes", None, None, " ")]
    records = spark.createDataFrame(rows, RECORD)
    mapping = spark.createDataFrame([("s1", "P1"), ("s2", "P1"), ("s3", "P1"), ("s1", "P2"), ("s2", "P2"), ("s3", "P2"), ("s4", "P3"), ("s4", "P3"), (None, "P1"), ("s9", None)], "source_id string, canonical_id string")
    held = spark.createDataFrame([("P1", "KRABLO, ALBERT BORIS, MD", "hand surgery", "CLINIC A OF THE NORTH", "x"), ("P2", "Krablo, Al", "HND", "tbd", "x"), ("P3", "Deborah Vintes", None, None, "x"), ("P4", None, None, None, "x"), (None, "x", "y", "z", "x")], "id string, name string, specialty string, primary_facility string, field string")
    assert sorted(tuple(r) for r in held_worse(held, records, mapping, spec, fac).collect()) == [("P2", "name"), ("P2", "primary_facility"), ("P2", "specialty")]
    assert held_worse(held.limit(0), records, mapping, spec, fac).count() == 0


def test_survivor_decides_ties(spark):
    from datetime import datetime

    spec, fac = refs(spark)
    rec = lambda i, src, fa, year: (i, src, f"s{i}", None, "Albert Krablo", "Albert", "Krablo", None, "Hand Surgery", fa, None, None, datetime(year, 1, 1), None)
    records = spark.createDataFrame([rec(1, "cms", "Clinic A of the North", 2020), rec(2, "hospital", "Clinic B of the North", 2024)], RECORD)
    mapping = spark.createDataFrame([(s, p) for s in ("s1", "s2") for p in ("P1", "P2")], "source_id string, canonical_id string")
    held = spark.createDataFrame([("P1", "Albert Krablo", "Hand Surgery", "Clinic A of the North"), ("P2", "Albert Krablo", "Hand Surgery", "Clinic B of the North")], "id string, name string, specialty string, primary_facility string")
    assert [tuple(r) for r in held_worse(held, records, mapping, spec, fac).collect()] == [("P1", "primary_facility")]


def test_clashing_keys_are_divided(spark):
    columns = "source_id string, source string, label string, known_given string, middle string, initial string, npi9 string, surname string, given string"
    row = lambda i, src, npi: (f"{src}_{i}", src, None, "albert", None, "a", npi, "krablo", "albert")
    df = spark.createDataFrame([row(1, "cms", "1"), row(2, "hospital", "1"), row(3, "license", None), row(4, "cms", "1"), row(5, "hospital", "2")], columns)
    got = {tuple(p)[:2] for p in match_entities(df, (("name", ("surname", "given")),)).collect()}
    assert got == {("cms_1", "hospital_2"), ("cms_1", "license_3"), ("cms_4", "hospital_2"), ("cms_4", "license_3"), ("hospital_2", "license_3")}


def test_few_labelled_links_leave_a_rule_in(spark):
    columns = "source_id string, source string, label string, known_given string, middle string, initial string, npi9 string, surname string, given string"
    row = lambda i, src, last, label: (f"{src}_{i}", src, label, "albert", None, "a", None, last, "albert")
    df = spark.createDataFrame([row(1, "cms", "krablo", "E1"), row(2, "hospital", "krablo", "E1"), row(3, "cms", "vintes", None), row(4, "hospital", "vintes", None)], columns)
    assert [tuple(p)[:2] for p in match_entities(df, (("name", ("surname", "given")),)).collect()] == [("cms_3", "hospital_4")]


def test_unlabelled_meet_without_a_labelled_centre(spark):
    columns = "source_id string, source string, label string, known_given string, middle string, initial string, npi9 string, surname string, given string"
    people = lambda k: [(f"{src}_{last}", src, "E1" if i == k else None, "albert", None, "a", None, last, "albert") for last in ("krablo", "vintes") for i, src in enumerate(("cms", "hospital", "license"))]
    for k in range(3):  # one of them has the smallest hash
        assert match_entities(spark.createDataFrame(people(k), columns), (("name", ("surname", "given")),), floor=0.0).count() == 2


def test_large_components_cluster_alike(spark, monkeypatch):
    from linkwright.llm import variants

    records, _ = people(spark, 6, seed=2)
    rows = person_features(spark, records.withColumn("raw", spelling(F.col("name_raw"))), ("raw",)).cache()
    pairs = lambda: sorted(tuple(p) for p in variant_pairs(link_variants(rows, least=0.4)).collect())
    want = pairs()
    monkeypatch.setattr(variants, "MOST_NAMES", 1)
    assert want and pairs() == want


def test_tiles_and_top_give_the_same_links(spark):
    records, _ = people(spark, 40, seed=2)
    rows = person_features(spark, records.withColumn("raw", spelling(F.col("name_raw"))), ("raw",)).withColumn("npi9", F.lit("234567890")).cache()
    pairs = lambda **more: sorted(tuple(p) for p in variant_pairs(link_variants(rows, **more)).collect())
    want = pairs()
    assert want and pairs(tile=3) == want and pairs(top=10_000) == want
    assert set(pairs(top=1)) <= set(want)


def test_blocks_stay_whole_in_a_broadcast_join(spark):
    names = ["thornton", "thronton"]
    rows = [(f"cms_{i:02d}", "cms", names[i % 2], names[i % 2], None, None, None, None, f"{i // 2}", None, None, None, None) for i in range(60)]
    df = spark.createDataFrame(rows, "source_id string, source string, raw string, surname string, given string, known_given string, middle string, initial string, npi9 string, zip string, facility_id string, specialty_id string, state string")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "64m", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "4k"}
    keep = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted(tuple(p) for p in variant_pairs(link_variants(df)).collect())
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert got == [(f"cms_{i:02d}", f"cms_{i + 1:02d}") for i in range(0, 60, 2)]


def test_npi_of_many_is_none(spark):
    from linkwright.llm.entities import person_rows

    rng = random.Random(5)
    row = lambda i, npi, last: (i, "cms", f"cms_{i:03d}", npi, f"Albert {last}", "Albert", last, None, "Hand Surgery", None, "MA", None, None, None)
    others = ["".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(30)]
    rows = [row(i, "1999999999", last) for i, last in enumerate(others)] + [row(100 + i, "1234567893", "Thornton" if i % 3 else "Thronton") for i in range(30)] + [row(200 + i, "1222222222", last) for i, last in enumerate(others[:4])]
    records = spark.createDataFrame(rows, RECORD).drop("label")
    mapping = spark.createDataFrame([], "source_id string, canonical_id string")
    got = {r["source_id"]: r["npi9"] for r in person_rows(records, mapping, *refs(spark)).collect()}
    assert got == {r[2]: None if r[3] == "1999999999" else r[3][1:] for r in rows}


def test_cosines_are_bounded_from_above():
    from linkwright.llm.variants import FOLDED, Cosines

    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghinorst") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    weights = np.linspace(0.3, 2, SIGMA * SIGMA).astype("float32")
    x, cosines = vectors(np.array(words), weights), Cosines(np.array(words), weights)
    p, q = (v.ravel() for v in np.meshgrid(np.arange(200), np.arange(200)))
    assert np.allclose(cosines.exact(p, q), (x @ x.T)[p, q], atol=1e-5) and (cosines.bound(p, q) >= cosines.exact(p, q) - 1e-5).all()
    assert cosines.folded.shape == (200, FOLDED)


def test_large_and_small_blocks_link_alike(spark):
    from linkwright.llm.variants import _near

    rng = random.Random(4)
    names = [f"{a}{b}" for a in ("thorn", "brand", "kelm", "ostr") for b in ("ton", "tno", "berg", "ebrg", "sen")]
    rows = [(1, False, i, rng.choice(names), "albert", False, "", "a") for i in range(300)]
    schema = "key long, sure boolean, node long, surname string, given string, known boolean, middle string, initial string"
    got = _near(spark.createDataFrame(rows, schema).coalesce(1), np.ones(SIGMA * SIGMA, dtype="float32"), 0.62, None).collect()
    x = vectors(np.array([r[3] for r in rows]), np.ones(SIGMA * SIGMA, dtype="float32"))
    root = list(range(300))
    for i in range(300):
        for j in range(i):
            if x[i] @ x[j] >= 0.62 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert dict(map(tuple, got)) == {i: r for i, r in enumerate(root) if r != i}


def test_links_of_keys_need_no_window(spark):
    assert _mode(np.array([5, 3, 3, 5, NONE, NONE]), np.array([1, 1, 1, 1, 1, 2])).tolist() == [3, 3, 3, 3, 3, NONE]
    rows = [(n, "smith", "ann", "ann", "f", None, npi9) for n, npi9 in ((1, "111"), (2, "111"), (3, "222"), (4, "222"), (5, None))] + [(6, "jones", "bo", None, "f", None, None)]
    nodes = spark.createDataFrame(rows, "node long, surname string, given string, known_given string, facility_id string, middle string, npi9 string").withColumn("label", F.lit(None).cast("string"))
    links = links_of(keyed(nodes, [("name", ("surname", "given"))]), [])
    assert "Window" not in links._jdf.queryExecution().executedPlan().toString()
    found = {r["node"]: (r["to"], r["rule"]) for r in links.collect()}
    assert found[2] == (1, 1) and found[4] == (3, 1) and set(found) == {2, 4, 5} and found[5][1] == 2


def test_generated_methods_of_features_are_compiled(spark):
    """The JVM leaves methods of more than 8,000 bytes to its interpreter."""
    records, _ = people(spark, 4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = person_features(spark, records, ("record_id", "as_of"))._jdf.queryExecution()
        text = plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) <= 8000


def test_white_space_is_no_part_of_a_name(spark):
    df = spark.createDataFrame([("Smith\n",), ("Lee",), ("MD",), ("Ng",)], "n string")
    assert [tuple(r) for r in df.select(name_words(F.col("n")), surname_of(F.col("n"))).collect()] == [(["smith"], "smith"), (["lee"], "lee"), ([], ""), (["ng"], "ng")]


def test_rules_of_one_place_share_a_row(spark):
    """A record goes to each of a few homes once, whatever the number of rules; their keys give the links that each rule alone gives."""
    from linkwright.llm.entities import RULES, ends_of, homes_of

    rng = random.Random(3)
    one = lambda *xs: rng.choice([*xs, xs[0], None])
    names = ["krablo", "krabla", "vintes", "vintel"]
    rows = [(n, "E1" if n % 7 == 0 else None, one("albert", "bo"), one("a", "b"), one("a", "b"), one("11", "12"), (last := rng.choice(names)), one("albert", "bea", "bo"), last[:4], last[-5:], one("F1", "F2"), one("S1", "S2"), one("MA", "NY"), one("1", "2")) for n in range(1, 120)]
    nodes = spark.createDataFrame(rows, "node long, label string, known_given string, middle string, initial string, npi9 string, surname string, given string, head string, tail string, facility_id string, specialty_id string, state string, zip string").cache()
    keys = keyed(nodes, RULES)
    full = nodes.filter("initial = 'a' and given = 'albert' and node is not null" + "".join(f" and {c} is not null" for c in ("middle", "npi9", "facility_id", "specialty_id", "state", "zip")))
    most = keys.groupBy("node").count().agg(F.max("count")).first()[0]
    assert full.count() and 3 <= keys.join(full, "node").groupBy("node").count().agg(F.max("count")).first()[0] <= 5 and most <= len(homes_of(RULES)) == 7
    loose = [i for i, (_, a) in enumerate(RULES) if "letter" in a]
    alone = {(r["node"], r["to"], 3 * i + r["rule"] % 3) for i, rule in enumerate(RULES) for r in links_of(keyed(nodes, [rule]), [0] if i in loose else []).collect()}
    assert {tuple(r) for r in links_of(keys, loose).collect()} == alone
    ends = ends_of(keys, loose, 3 * len(RULES)).collect()
    assert {(r["node"], r["to"], i) for r in ends for i in range(3 * len(RULES)) if r["kinds_0"] >> i & 1} == alone and len(ends) < len(alone) / 2
    many = ends_of(keyed(nodes, (*RULES, *RULES)), [*loose, *(len(RULES) + i for i in loose)], 6 * len(RULES)).collect()
    assert {(r["node"], r["to"], i) for r in many for i in range(114) if (r["kinds_0"], r["kinds_1"])[i // 63] >> i % 63 & 1} == alone | {(n, to, i + 57) for n, to, i in alone}
