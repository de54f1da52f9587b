"""The pipeline's stages and run() against plain versions, and the cascade, the search and the shards on planted rows."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import near_dedup, quality_model, quality_rules, secrets, sharding
from tests.llm.test_operators import components_of, words

pytest.importorskip("public_tokenizers")
PROSE = [f"the {a} of {b} was as {c} in the {d} that we saw on day {i}" for i, (a, b, c, d) in enumerate([("house", "stone", "old", "town"), ("river", "light", "wide", "north"), ("garden", "roses", "green", "valley"), ("letter", "thanks", "short", "drawer")])]
ROWS = [(i, t, i) for i, t in enumerate(PROSE)] + [(10, PROSE[0], 1), (11, None, 2), (12, "", 3), (13, "too short", 4), (3, PROSE[3], 3), (14, "# $ % & | # $ % & | # $ %", 5), (15, PROSE[1] + " password=abcdefgh", 6)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, n_chars long").withColumn("_words", F.lit("x")).withColumn("rejected", F.lit(7)).withColumn("n_words", F.lit(0))


def judged(text):
    """What the rules say of a text, on all but repeats, stutter and lines, which no text here has."""
    w = words(text)
    n, chars = len(w), sum(map(len, w))
    symbols, upper = sum(text.count(c) for c in "#*$%&|<>") if text else 0, sum("A" <= c <= "Z" for c in text or "")
    return n >= 10 and 100 * symbols <= 30 * n and 100 * upper <= 40 * chars and 15 * n <= 10 * chars <= 200 * n


def test_stages(spark, rows, monkeypatch):
    kept = corpus_pipeline.quality_rules(spark, rows, "")
    assert kept.columns == rows.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, t, _ in ROWS if judged(t))
    monkeypatch.setattr(corpus_pipeline, "fitted", lambda spark, sf: 0.3)
    assert corpus_pipeline.quality_classifier(spark, rows, "").count() == len(ROWS)
    monkeypatch.setattr(corpus_pipeline, "fitted", lambda spark, sf: 0.2)
    assert corpus_pipeline.quality_classifier(spark, rows, "").count() == 0
    one = corpus_pipeline.near_dedup(spark, rows, "")
    parts = components_of({i: t or "" for i, t, _ in ROWS}, 5, 80)
    assert one.columns == rows.columns and sorted(r["doc_id"] for r in one.collect()) == sorted({c for _, c in parts.values()})
    clean = {r["doc_id"]: r for r in corpus_pipeline.secret_scan(spark, rows, "").collect()}
    for i, t, _ in ROWS:
        want = t and secrets.redact(t, secrets.find(t)[1])
        assert clean[i]["text"] == want and clean[i]["n_chars"] == (None if want is None else len(want))
    assert "abcdefgh" not in clean[15]["text"]
    packed = corpus_pipeline.best_fit_packing(spark, rows, "").collect()
    assert Counter(r["doc_id"] for r in packed) == Counter(i for i, _, _ in ROWS) and len({r["sequence_id"] for r in packed}) == 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows.filter("doc_id < 0"), "").count() == 0


def test_run(spark, rows, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "documents", lambda spark, sf: rows)
    monkeypatch.setattr(corpus_pipeline, "fitted", lambda spark, sf: 1.0)
    left = {i: t for i, t, _ in ROWS if judged(t)}
    want = {c for _, c in components_of(left, 5, 80).values()}
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, "").collect()) == sorted(want)


def test_op2_short_circuits(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string")
    stop = quality_rules.Rule("stop", lambda c: c["n_words"] == 3)
    fails = quality_rules.Rule("fails", lambda c: F.raise_error(F.lit("evaluated")).cast("boolean") | (c["n_words"] < 0))
    of = quality_rules.Texts.of(df.filter("doc_id = 1"), "text")
    assert of.rows.filter(~quality_rules.cascade([stop, fails], of.signals())).count() == 0
    of = quality_rules.Texts.of(df, "text")
    with pytest.raises(Exception, match="evaluated"):
        of.rows.filter(~quality_rules.cascade([stop, fails], of.signals())).count()


def test_op2_order(spark):
    df = spark.createDataFrame([(i, "w " * (i % 10)) for i in range(400)], "doc_id long, text string")
    rules = [quality_rules.Rule("never", lambda c: c["n_words"] > 99), quality_rules.Rule("often", lambda c: c["n_words"] < 9)]
    assert [r.name for r in quality_rules.order_rules(df, rules)] == ["often", "never"]


def test_op3_half_similar_copies(spark):
    """A large group around one text, most of it too far from each other: the search by differences loses no link."""
    r = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(260):
        w = list(base)
        for j in r.sample(range(120), r.choice([1, 2, 3, 4, 5, 6, 7])):
            w[j] = f"x{r.randrange(60)}"  # few words, so that copies also share what is not in the text
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x["id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.link_classes(df, k=4).collect()}
    assert got == components_of(texts, 4, 80)


def test_op3_null_ids_and_repeats(spark):
    df = spark.createDataFrame([(None, PROSE[0]), (1, PROSE[0]), (1, PROSE[0]), (2, PROSE[1])], "doc_id long, text string")
    found = near_dedup.link_classes(df).collect()
    assert Counter((x["id"], x["component_id"]) for x in found) == Counter([(None, None), (1, 1), (1, 1), (2, 2)])
    assert Counter(x["doc_id"] for x in near_dedup.keep_one(df).collect()) == Counter([None, 1, 2])


def test_op1_balance_and_groups(spark):
    r = random.Random(2)
    texts = [f"text {i} " + "y" * r.randrange(400) for i in range(1500)] + ["heavy " * 10] * 180 + ["giant " * 30] * 600
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    size = F.octet_length("text") + 16
    out = sharding.shard(df, {"n": F.length("text") / 1000}, size, [F.col("text")], ["doc_id"], shards=10).collect()
    total, at = Counter(), defaultdict(set)
    for x in out:
        total[x["shard"]] += x["weight"]
        at[texts[x["doc_id"]]].add(x["shard"])
    assert len(out) == len(texts) and set(total) == set(range(10))
    assert max(total.values()) <= 1.1 * min(total.values())
    whole = sum(total.values()) / 10
    for t, shards in at.items():
        assert len(shards) == 1 or texts.count(t) * (len(t.encode()) + 16) > whole
    assert sharding.seated([5, 4, 3], 2, 8.0) == ([0, 1, 1], [3.0, 1.0])


def test_op5_odd_texts(spark):
    net = quality_model.ByteConvNet.start()
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "x"), (None, "é" * 300_000)], "doc_id long, text string")
    got = quality_model.score(df, net).collect()
    assert len(got) == 5 and all(0 <= x["score"] <= 1 for x in got) and len({x["score"] for x in got if x["id"] in (1, 2)}) == 1
    assert quality_model.score(df.filter("doc_id < 0"), net).count() == 0
    texts = [b"a" * n for n in (0, 1, 20, 21, 255, 256, 257, 500, 2000)]
    data, count = quality_model.chunked(texts)
    own = quality_model._own(texts, count)
    start = 0
    for t, n in zip(texts, count.tolist(), strict=True):  # the fit's maxima are those that scoring pools
        rows_, _ = net.pooled([t])
        best = quality_model._best(net, data[start : start + n], own[start : start + n])
        for i in range(n):
            for f in range(3):
                window = data[start + i][best[i, f] : best[i, f] + quality_model.WIDTH]
                assert abs(max(float(net.embed[window].ravel() @ net.filters[:, f] + net.bias[f]), 0) - float(rows_[i, f])) < 1e-4
        start += n
