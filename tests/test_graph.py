import random

import pytest
from pyspark.sql import functions as F

from linkwright.config import ResolveConfig
from linkwright.operators import blocking, canonical, graph, matching, network, pruning, reports
from linkwright.plans import resolution
from linkwright.plans.pipeline import resolve


def components_of(nodes, pairs):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        p, q = top(a), top(b)
        up[max(p, q)] = min(p, q)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_components(spark, kind):
    rng = random.Random(3)
    nodes = [f"n{i:04d}" for i in range(300)]
    pairs = {"random": [tuple(rng.sample(nodes, 2)) for _ in range(220)], "chain": list(zip(nodes, nodes[1:])), "star": [(nodes[7], n) for n in nodes if n != nodes[7]], "none": []}[kind]
    v = spark.createDataFrame([(n,) for n in nodes], "id string")
    e = spark.createDataFrame([(*p, 1.0) for p in pairs], "src string, dst string, weight double")
    assert dict(graph.connected_components(v, e).collect()) == components_of(nodes, pairs)


def brute_bridges(pairs):
    nodes = sorted({x for p in pairs for x in p})
    count = lambda ns, ps: len(set(components_of(ns, ps).values()))
    base = count(nodes, pairs)
    bridges = {p for p in pairs if count(nodes, [q for q in pairs if q != p]) > base}
    cuts = {n for n in nodes if count([m for m in nodes if m != n], [q for q in pairs if n not in q]) > base}
    return bridges, cuts


@pytest.mark.parametrize("seed", range(15))
def test_bridges(seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(12)]
    pairs = {tuple(sorted(rng.sample(nodes, 2))) for _ in range(rng.randint(5, 20))}
    bridges, cuts = graph.bridges_and_cuts(pairs)
    b, c = brute_bridges(sorted(pairs))
    assert bridges == b
    assert cuts == {x for x in c if True}


def test_five_records(spark, five, edges):
    v, e = graph.build_graph(five, edges)
    assert (v.count(), e.count()) == (5, 4)
    c = graph.connected_components(v, e)
    assert sorted(r["n"] for r in graph.clusters(c).collect()) == [2, 3]
    m = {r["canonical_id"]: r for r in canonical.merge_clusters(v, e, c).collect()}
    assert m["PHY_1234567890"]["name"] == "SMITH, JOHN A" and m["PHY_1234567890"]["source_count"] == 3 and m["PHY_1234567890"]["state"] == "MA"
    q = graph.quality(v, e, c).collect()
    assert all(0 <= r["quality_score"] <= 1 and not r["npi_conflict"] for r in q)
    assert all(0 <= r["confidence"] <= 1 for r in canonical.record_confidence(e, c).collect())


def test_pairs(spark, five):
    pairs = blocking.candidate_pairs(five).collect()
    assert len({tuple(p) for p in pairs}) == len(pairs) and all(a < b for a, b in pairs)
    assert {("cms_001", "lic_001"), ("cms_002", "lic_002")} <= {tuple(p) for p in pairs}
    fewer = {tuple(p) for p in blocking.candidate_pairs(five, sound=False).collect()}
    assert fewer <= {tuple(p) for p in pairs}
    assert {tuple(p) for p in blocking.candidate_pairs(five, hot_block=1).collect()} <= {tuple(p) for p in pairs}
    assert blocking.candidate_pairs(five.limit(0)).count() == 0


def test_hot_blocks_keep_all_pairs(spark, five):
    rows = [("1234567890", f"A{i}", f"Name{i % 7}", "MA") if i % 3 else (None, None if i % 2 else "B", "Smith", "MA") for i in range(60)]
    df = spark.createDataFrame([(f"s{i:02d}", *r) for i, r in enumerate(rows)], "source_id string, npi string, name_first string, name_last string, facility_state string")
    every = sorted(tuple(p) for p in blocking.candidate_pairs(df).collect())
    assert sorted(tuple(p) for p in blocking.candidate_pairs(df, hot_block=4).collect()) == every and len(set(every)) == len(every)
    assert {(f"s{a:02d}", f"s{b:02d}") for a in range(60) for b in range(a + 1, 60) if bool(a % 3) == bool(b % 3)} <= set(every)


def test_pairs_are_met_in_generated_code(five):
    plan = blocking.candidate_pairs(five, hot_block=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" not in plan and "arrays_zip" not in plan  # such functions are interpreted, for every two rows that meet


def test_candidate_pairs_cuts_hot_blocks(spark, tmp_path):
    rows = [(i, f"s{i:04d}", "1234567890", f"Name{i}", None) for i in range(1100)]
    spark.createDataFrame(rows, "record_id long, source_id string, npi string, name_last string, facility_state string").write.parquet(f"{tmp_path}/source_records.parquet")
    pairs = resolution.candidate_pairs(spark, str(tmp_path))
    assert "high" in pairs._jdf.queryExecution().optimizedPlan().toString() and pairs.count() == 1100 * 1099 // 2


def test_soundex(spark):
    df = spark.createDataFrame([("Smith",), ("Smyth",), ("O'Brien",), ("Ashcraft",), ("Tymczak",)], "n string")
    assert [r[0] for r in df.select(F.soundex("n")).collect()] == ["S530", "S530", "O165", "A261", "T522"]


def test_matches(spark, five):
    m = {(r["source_id_1"], r["source_id_2"]): r for r in matching.find_matches(five).collect()}
    assert m["cms_001", "hosp_001"]["decision"] == "match" and m["cms_001", "hosp_001"]["match_type"] == "npi_exact" and m["cms_001", "hosp_001"]["confidence"] == 0.95
    assert all(r["decision"] != "match" for r in m.values() if r["npi_match"] == 0.0)


def test_resolve(spark, five):
    refs = spark.createDataFrame([("1234567890", "9876543210", "2024-01-01"), ("1234567890", "9876543210", "2024-02-01"), ("1234567890", "1234567890", "2024-02-01"), (None, "9876543210", None)], "referring_npi string, receiving_npi string, referral_date string")
    t = resolve(five, refs, ResolveConfig(match_threshold=0.7))
    e = t["referral_edges"].collect()
    assert [(r["referral_count"], r["last_referral_date"]) for r in e] == [(2, "2024-02-01")]
    assert t["scores"].agg(F.sum("score")).first()[0] == pytest.approx(1)
    assert {r["canonical_id"] for r in t["mapping"].collect()} == {r["canonical_id"] for r in t["entities"].collect()}
    assert t["entities"].filter("source_count = 3").count() == 1


def brute_conflicts(edges, npis):
    left = dict(edges)
    while True:
        comp = components_of({x for p in edges for x in p}, left)
        bad = [c for c in set(comp.values()) if len({npis[n] for n in comp if comp[n] == c and n in npis}) > 1]
        if not bad:
            return set(left)
        c = min(bad)
        del left[min((w, p) for p, w in left.items() if comp[p[0]] == c and (p[0] in npis or p[1] in npis))[1]]


@pytest.mark.parametrize("seed", range(20))
def test_prune_conflicts(seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(9)]
    edges = {tuple(sorted(rng.sample(nodes, 2))): round(rng.random(), 2) for _ in range(14)}
    npis = {n: rng.choice("12") for n in nodes if rng.random() < 0.5}
    assert pruning.prune_component([(*p, w) for p, w in edges.items()], npis, True, None, None) == brute_conflicts(edges, npis)


def test_prune(spark):
    v = spark.createDataFrame([("a", "111"), ("b", "222"), ("c", "111")], "id string, npi string")
    e = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.9)], "src string, dst string, weight double")
    left = pruning.prune_npi_conflicts(v, e)
    assert [tuple(r) for r in left.collect()] == [("a", "c", 0.9)]
    light = spark.createDataFrame([("a", "b", 0.8), ("b", "c", 0.2)], "src string, dst string, weight double")
    assert [tuple(r)[:2] for r in pruning.prune_light(light, 0.5).collect()] == [("a", "b")]
    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", 0.5 + i / 100) for i in range(9)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(f"n{i:02d}", None) for i in range(10)], "id string, npi string")
    kept = pruning.prune_oversized(nodes, chain, 4)
    assert max(r["n"] for r in graph.clusters(graph.connected_components(nodes, kept)).collect()) <= 4
    assert pruning.prune_weak_bridges(nodes, chain, 0.53).count() == 6


def test_pagerank(spark):
    rng = random.Random(5)
    nodes = [f"n{i}" for i in range(8)]
    e = {(a, b): rng.randint(1, 5) for a in nodes[:6] for b in nodes if a != b and rng.random() < 0.4}
    df = spark.createDataFrame([(*p, n) for p, n in e.items()], "src string, dst string, referral_count long")
    got = dict(network.pagerank(df, rounds=12, exact_rounds=True).collect())
    ids = sorted(got)
    r = dict.fromkeys(ids, 1 / len(ids))
    out = {a: sum(n for (s, _), n in e.items() if s == a) for a in ids}
    for _ in range(12):
        lost = sum(r[a] for a in ids if not out[a])
        r = {b: 0.15 / len(ids) + 0.85 * (lost / len(ids) + sum(r[a] * n / out[a] for (a, x), n in e.items() if x == b)) for b in ids}
    assert got == pytest.approx(r)
    assert sum(dict(network.pagerank(df).collect()).values()) == pytest.approx(1)
    assert network.pagerank(df.limit(0)).count() == 0


def test_evaluation(spark):
    c = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "x")], "id string, component string")
    t = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "id string, true_id string")
    r = reports.pair_evaluation(c, t).first()
    assert (r["predicted"], r["actual"], r["correct"]) == (3, 3, 1)
    assert {(x["kind"], x["group"]) for x in reports.wrong_groups(c, t).collect()} == {("split", "1")}


def test_upper_median(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", 5.0)], "k string, v double")
    assert dict(reports.upper_median(df, ["k"], "v").collect()) == {"a": 3.0, "b": 5.0}
