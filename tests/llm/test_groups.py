import random

import pytest

from linkwright.llm.groups import consolidate, linked_pairs


def truth(pairs):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            p, q = top(a), top(b)
            up[max(p, q)] = min(p, q)
    return {x: top(x) for x in list(up)}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "cliques"])
@pytest.mark.parametrize("last", [0, 50])
def test_groups(spark, kind, last):
    rng = random.Random(kind)
    ids = [f"id_{i:04d}" for i in range(400)]
    rng.shuffle(ids)
    pairs = {
        "random": [(rng.choice(ids), rng.choice(ids)) for _ in range(350)], "chain": list(zip(ids, ids[1:])), "star": [(ids[0], x) for x in ids[1:]],
        "cliques": [(a, b) for k in range(0, 60, 6) for a in ids[k : k + 6] for b in ids[k : k + 6]],
    }[kind]
    df = spark.createDataFrame(pairs + pairs[:20], "source_id_1 string, source_id_2 string")
    got = consolidate(df.filter("source_id_1 <> source_id_2"), last=last).collect()
    assert len(got) == len({r[0] for r in got}) and {r[0]: r[1] for r in got} == truth(pairs)


def test_odd_rows(spark):
    rows = [("a", "b", " Match "), ("b", "a", "MATCH"), ("c", "c", "match"), ("d", None, "match"), ("e", "f", None), ("g", "h", "non_match"), ("b", "z" * 10_000, "match\t")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "source_id_1 string, source_id_2 string, match_decision string, group_id int")
    assert {tuple(r) for r in consolidate(linked_pairs(df)).collect()} == {("a", "a"), ("b", "a"), ("z" * 10_000, "a")}
    assert consolidate(linked_pairs(df.limit(0))).count() == 0
