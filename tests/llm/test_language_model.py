"""Deleted interpolation against a plain version, and its probabilities' sum."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import language_model as lm

TEXTS = [(1, "a b a c a b"), (2, "a b c d"), (3, "b a b a B A"), (4, None), (5, ""), (6, "c c c c d"), (7, "a b a c a b"), (7, "a b a c a b"), (20, "a b zz"), (21, "zz yy"), (None, "a b")]


def plain(learned):
    """p(word, before) of the model of some token lists; None is the end, "" the start."""
    pairs, words = Counter(), Counter()
    for t in learned:
        pairs.update(zip(["", *t], t))
        words.update(t)
    n, v, docs = sum(words.values()), len(words), len(learned)
    context = lambda b: docs if b == "" else words[b]
    bucket = lambda c: min(math.ceil(math.log2(c + 1)), lm.BUCKETS - 1)
    cells = Counter()
    for (b, w), c in pairs.items():
        rest = context(b) - 1
        p2, p1 = (c - 1) / rest if rest else 0.0, (words[w] - 1) / max(n - 1, 1)
        cells[(bucket(rest), *lm._level(np.array([p2, p1])).tolist())] += c
    weights = lm.learn_weights(np.array(sorted((*k, c) for k, c in cells.items()), np.int64), 1 / (v + 1))

    def p(w, b):
        c = context(b)
        a = weights[bucket(c)]
        return a[0] * (pairs[(b, w)] / c if c else 0) + a[1] * words[w] / n + a[2] / (v + 1)

    return p, words


def test_scores_and_sums(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    tokens = lambda t: [*(t or "").lower().split(), None]
    p, words = plain([tokens(t) for i, t in TEXTS if i is not None and i < 10])
    want = Counter()
    for i, t in TEXTS:
        ws = tokens(t)
        want[(i, len(ws), round(sum(math.log10(p(w, b)) for w, b in zip(ws, ["", *ws])), 9))] += 1
    got = lm.model_scores(df, F.col("doc_id") < 10).collect()
    assert Counter((r["id"], r["n_tokens"], round(r["score"], 9)) for r in got) == want
    for b in ["", "a", "b", "zz", None]:
        if b is not None or words[None]:
            assert math.isclose(sum(p(w, b) for w in words) + p("zz", b), 1, rel_tol=1e-9) or b in ("zz", None)
    assert spark.sql("SHOW TABLES").filter("tableName like 'tessera%'").count() == 0
    assert lm.model_scores(df.filter("doc_id < 0"), F.lit(True)).count() == 0
