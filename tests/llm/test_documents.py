import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwright.llm.leakage import FMIndex, WaveletMatrix, leaks, suffix_array
from linkwright.llm.lookalikes import Rewriter, consistent_form, equal_pairs, rewriting
from linkwright.llm.packing import containers, pack, sized


@pytest.mark.parametrize("seed", range(6))
def test_wavelet_and_suffixes(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 7, 200)
    wm = WaveletMatrix(x, 3)
    i, c = rng.integers(0, 201, 100), rng.integers(0, 7, 100)
    assert list(wm.rank(c, i)) == [int((x[:k] == v).sum()) for k, v in zip(i, c)]
    assert list(wm.access(np.arange(200))) == list(x)
    y = np.concatenate([x[:50], x[:50], [9]])
    assert list(suffix_array(y)) == sorted(range(len(y)), key=lambda k: tuple(y[k:]))


@pytest.mark.parametrize("seed", range(6))
def test_fm_index(seed):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(1, 5, rng.integers(3, 30)) for _ in range(12)]
    texts += [texts[0], texts[1]]
    seq = np.concatenate([y for t in texts for y in (t, [0])])
    index = FMIndex(seq, 5, sample=7)
    patterns = np.array([[a, b, c] for a in range(1, 5) for b in range(1, 5) for c in range(1, 5)])
    lo, hi = index.search(patterns)
    for p, a, b in zip(patterns, lo, hi):
        where = sorted(index.locate(np.arange(a, b)))
        assert where == [k for k in range(len(seq) - 2) if (seq[k : k + 3] == p).all()]


WORDS = [f"w{i}" for i in range(60)]


def test_leaks(spark):
    rng = random.Random(4)
    passages = [(f"E{k}", " ".join(rng.choice(WORDS) for _ in range(40))) for k in range(6)] + [("short", "w1 w2"), (None, "x"), ("null", None)]
    docs, i = [], 0
    for _ in range(120):
        ws = [rng.choice(WORDS) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            p = rng.choice(passages[:6])[1].split()
            a, n = rng.randint(0, 28), rng.choice([8, 11, 12, 13, 25])
            ws[10:10] = p[a : a + n]
        text = " ".join(ws)
        docs.append((i, rng.choice([text, text.upper(), text.replace(" ", ", "), text.replace("w1", "w​1")])))
        i += 1
    docs += [(1000, None), (1001, ""), (None, passages[0][1]), (1002, passages[0][1] + " \n" + passages[1][1]), (1002, passages[0][1])]
    form = Rewriter(rewriting({}))

    def grams(t):
        import re

        w = re.findall(r"[^\W_]+", form(t).lower())
        return {tuple(w[k : k + 12]) for k in range(len(w) - 11)}

    want = {(d, e) for d, t in docs if d is not None and t for e, p in passages if e and p and grams(t) & grams(p)}
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, eval_id string")
    e = spark.createDataFrame(passages, "eval_id string, passage string")
    for shard in (50, 1_000_000):
        spans = leaks(d, e, shard_words=shard).collect()
        assert {(r["doc_id"], r["eval_id"]) for r in spans} == want
        assert all(r["last_word"] - r["first_word"] >= 11 for r in spans)
    assert leaks(d.limit(0), e).count() == 0 and leaks(d, e.limit(0)).count() == 0


PAIRS = [("ｆｕｌｌ，１２", "full,12"), ("été", "été"), ("ﬁne oﬃce", "fine office"), ("za​p it x", "zap it x"), ("𝗵𝗲𝗹𝗹𝗼", "hello"), ("Аррle Рie", "Apple Pie"), ("όνer", "óver"), ("ça", "ça"), ("ä́", "ä́")]


@pytest.mark.parametrize(("odd", "usual"), PAIRS)
def test_form(odd, usual):
    form = Rewriter(rewriting({c: 5 for c in "abcdefghijklmnopqrstuvwxyz"}))
    assert form(odd) == form(usual)
    assert form(form(odd)) == form(odd)
    if usual.isascii():
        assert form(odd) == usual


def test_equal_texts(spark):
    rows = [(1, "Apple pie"), (2, "Аpple pie"), (3, "Apple pie"), (4, "apple pie"), (5, "Apple pie"), (6, None), (7, ""), (8, "​"), (None, "Apple pie"), (9, "x" * 30_000), (10, "x" * 29_999 + "ｘ"), (11, "e = mc²"), (12, "e = mc2")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, form string")
    assert {tuple(r) for r in equal_pairs(df).collect()} == {(1, 2), (1, 3), (2, 3), (2, 5), (3, 5), (7, 8), (9, 10)}
    assert equal_pairs(df.limit(0)).count() == 0
    form = {r["doc_id"]: r["form"] for r in consistent_form(df).collect()}
    assert form[2] == "Apple pie" and form[6] is None and form[7] == ""


@pytest.mark.parametrize("seed", range(5))
def test_pack(seed):
    rng = np.random.default_rng(seed)
    tokens = rng.integers(0, 101, 400)
    loss = (tokens * rng.random(400)).astype(int)
    most = 80 if seed % 2 else 100
    loss = np.minimum(loss, most)
    got = pack(tokens, loss, 100, 12, most)
    for b in np.unique(got):
        assert tokens[got == b].sum() <= 100 and (got == b).sum() <= 12
    assert len(np.unique(got)) <= 1.1 * tokens.sum() / 100 + 2


def test_containers(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 120), rng.randint(0, 60)) for i in range(500)] + [(900, 2500, 2400), (901, None, None), (902, 0, 0), (None, 5, 5), (7, 10, 10)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, loss long")
    got = containers(df, 1000, 40, 700, shard_items=100)
    c = got.groupBy("container").agg(F.sum("tokens").alias("t"), F.sum("loss").alias("l"), F.count("*").alias("n"))
    top = c.agg(F.max("t"), F.max("l"), F.max("n")).first()
    assert top[0] <= 1000 and top[1] <= 700 and top[2] <= 40
    pieces = {r["doc_id"]: (r["n"], r["t"]) for r in got.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()}
    assert pieces[900] == (4, 2500) and pieces[901] == (1, 0) and pieces[902] == (1, 0) and pieces[7][0] == 2 and None not in pieces
    assert sum(t for _, t in pieces.values()) == sum(t or 0 for d, t, _ in rows if d is not None)
    assert containers(df.limit(0)).count() == 0


def test_sized(spark):
    pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, "One. Two three."), (2, None), (3, ""), (4, "word " * 5000), (5, "<|endoftext|>")], "doc_id long, text string")
    got = {r["doc_id"]: (r["tokens"], r["loss"]) for r in sized(df).collect()}
    assert got[2] == got[3] == (0, 0) and got[1][0] > got[1][1] > 0 and got[4][0] == got[4][1] >= 5000 and got[5][0] > 1
