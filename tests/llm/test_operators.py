"""The operators against plain versions on the smallest tables and on odd rows."""

import itertools
import math
import re
import zlib
from array import array
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tessera.llm import language_model, near_dedup, packing, pii, quality_model, quality_rules, secrets, sharding, topk
from tessera.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "x"), (4, "x"), (5, "word " * 3000), (6, "\t \n"), (7, "a b c d e f g h i j k"), (7, "a b c d e f g h i j k"), (8, "é Ü <|endoftext|> 'S  two")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("_w", F.lit(1)).withColumn("shard", F.lit(2))


def run(spark, name):
    return QUERIES[next(k for k in QUERIES if k.startswith(name + "_"))](spark, SF).collect()


def test_op1_law(spark, docs):
    rows = run(spark, "op1")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    total, slots = Counter(), defaultdict(list)
    for r in rows:
        data = docs[r["doc_id"]].encode()
        assert r["size"] == len(data) + 16 and r["text_crc32"] == zlib.crc32(data)
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(total) <= set(range(40))


def test_op2_counts(spark, docs):
    for r in run(spark, "op2"):
        text = docs[r["doc_id"]]
        w = words(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        at = defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        repeat = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
        symbols = len(re.findall(r"[#*$%&|<>]", text))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), symbols, dup, len(repeat))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(repeat) > 20 * len(w))


def components_of(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = lower(t).encode().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_op3_components(spark, docs):
    want = components_of(docs, 4, 80)
    rows = run(spark, "op3")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want and len(rows) == len(docs)


def test_op3_chain_of_near_copies(spark):
    base = [f"w{i}" for i in range(100)]
    texts = {}
    for i in range(60):  # each differs from the next by two words, the first from the last by far more
        texts[i] = " ".join(base[i * 2 :] + [f"n{j}" for j in range(i * 2)])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in near_dedup.link_classes(df, k=4).collect()}
    assert got == {i: c for i, (_, c) in components_of(texts, 4, 80).items()}


def test_op4_tokenizers(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    P = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in run(spark, "op4"):
        ids = t.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha256(array("I", ids).tobytes()).hexdigest())
        assert r["decoded_sha256"] == sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op5_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in QUERIES["op5_quality_classifier"](spark, "/root/testdata/sf0.01").collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in rows) / len(rows) > 0.9


def test_op6_brute_force(spark):
    same(QUERIES["op6_topk_search"](spark, SF), connect(SF), ORACLE_SQL["op6_topk_search"])


def test_op6_ties_and_nulls(spark):
    rows = [(0, [1, -2]), (1, [1, 0]), (2, [1, 0]), (3, None), (4, [None, 1]), (5, [0, 0]), (6, [-1, -3])]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = [tuple(r) for r in topk.top_k(df.filter("id = 0"), df, 3).orderBy("rank").collect()]
    assert got == [(0, 1, 6, 5), (0, 2, 1, 1), (0, 3, 2, 1)]
    assert topk.top_k(df.filter("id < 0"), df.filter("id < 0")).collect() == []


def test_op7_packing(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    P = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = run(spark, "op7")
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in docs.items()}
    pieces, spans = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(array("I", part).tobytes()) and len(part) == r["length"]
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, p in pieces.items():
        p.sort()
        assert [x[0] for x in p] == list(range(len(p))) and sum(x[2] for x in p) == len(ids[i])
        assert all(x[2] == 1024 for x in p[1:])
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(map(len, ids.values()))
    assert len(spans) <= math.ceil(total / 1024) * 1.03 + 1


def test_op7_two_fit_beats_greedy():
    made = packing.plan({600: 1, 300: 1, 250: 1, 150: 1}, 1000)
    assert made[0] == ((600, 250, 150), 1)


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def personal(text):
    out = []
    for rank, (kind, pattern) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_op8_base(spark, docs):
    for r in run(spark, "op8"):
        spans = personal(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in spans) for k in pii.KINDS]
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        assert r["base_sha256"] == sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


def test_op8_hard_texts_and_learned_contexts(spark):
    texts = ["a@b.c_d@e.f x@y @z.w a@b.c.d@e.f", "1.2.3.4.5.6.7.8 999.1.1.1 01.02.03.004", "4111 1111 1111 1111-4111", "+1 (222) 333-4444 + 5 +12", "é" * 50 + " me@x.org", "9" * 3000, "a" * 3000 + "@"]
    texts += [f"send it to card no {n} now" for n in ("4111111111111111", "5500005555555559", "340000000000009", "30000000000004", "6011000000000004", "3530111333300000")] + ["send it to card no 12-34567-8 now", "no card 77-88 here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r for r in pii.extract(df).collect()}
    for i, t in enumerate(texts):
        assert [(s["start"], s["rank"], s["kind"], s["stop"]) for s in got[i]["base"]] == personal(t), t
    found = [(t[s["start"] : s["stop"]], s["kind"]) for i, t in enumerate(texts) for s in got[i]["found"]]
    assert found == [("12-34567-8", "card")]


def secret_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_op9_base(spark, docs):
    for r in run(spark, "op9"):
        spans = secret_base(docs[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert r["base_sha256"] == sha256(secrets.written(spans).encode()).hexdigest()


def test_op9_links():
    text = "user=bob key Ab3dEf6hIj9kLm2nOp at https://db.example.com"
    assert [secrets.KINDS[k] for _, k, _ in secrets.find(text)[1]] == ["id", "key", "endpoint"]
    assert secrets.find("key Ab3dEf6hIj9kLm2nOp and https://db.example.com")[1] == []  # no identifier near
    assert secrets.find("user=bob" + " x" * 300 + " Ab3dEf6hIj9kLm2nOp")[1] == []  # another scope
    assert secrets.find("token=token: abcdefgh")[0] == secret_base("token=token: abcdefgh") == []
    assert secrets.redact("a password=abcdefgh b", secrets.find("a password=abcdefgh b")[1]) == "a [secret] b"


def test_op10_base_and_model(spark, docs):
    train = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i in docs}
    tokens = {i: [*lower(t).encode().split(), None] for i, t in docs.items()}
    count = Counter(w for i, ws in tokens.items() if train[i] for w in ws)
    n, v = sum(count.values()), len(count)
    rows = run(spark, "op10")
    assert len(rows) == len(docs)
    for r in rows:
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not train[r["doc_id"]], len(ws), sum(w in count for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op10_probabilities_sum_to_one(spark):
    train = spark.createDataFrame([(1, "a b a c"), (2, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(10 + i, f"a {w}") for i, w in enumerate(["a", "b", "c"])] + [(20, "a"), (30, "a zz")], "doc_id long, text string")
    got = {r["id"]: r["score"] for r in language_model.model_scores(train.union(asked), F.col("doc_id") < 10).collect()}
    assert all(math.isfinite(s) and s < 0 for s in got.values()) and got[11] > got[30]


def test_odd_rows(spark, odd):
    P = pytest.importorskip("public_tokenizers")
    from tessera.llm import bpe

    assert quality_rules.apply_rules(odd).count() == len(ODD)
    assert near_dedup.link_classes(odd).count() == len(ODD)
    assert near_dedup.keep_one(odd).columns == odd.columns
    assert pii.extract(odd).count() == len(ODD)
    assert secrets.scan(odd).count() == len(ODD)
    assert bpe.encode(odd, P.path("word_bpe_49k.json")).count() == len(ODD)
    packed = packing.pack(odd, P.path("byte_bpe_50k.json"))
    assert packed.select("id", "piece").count() >= len(ODD)
    assert packing.sequences(packed).filter(F.size("ids") > 1024).count() == 0
    assert language_model.model_scores(odd, F.lit(True)).count() == len(ODD)
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 16
    one = odd.select("doc_id", "text")
    assert sharding.shard(one, {"n": F.length("text") / 100000}, size, [F.col("text")], ["doc_id"], shards=3).count() == len(ODD)


def test_empty_tables(spark, odd):
    P = pytest.importorskip("public_tokenizers")
    none = odd.filter("doc_id < 0")
    assert quality_rules.apply_rules(none).count() == 0
    assert near_dedup.link_classes(none).count() == 0
    assert pii.extract(none).count() == 0
    assert packing.pack(none, P.path("byte_bpe_50k.json")).count() == 0
    assert language_model.model_scores(none, F.lit(True)).count() == 0
    assert sharding.shard(none.select("doc_id", "text"), {"n": F.lit(0.5)}, F.lit(1), [F.col("text")], ["doc_id"], shards=3).count() == 0


def test_op8_bootstraps_values_of_all_shapes(spark):
    mails = [f"u{i}@x{i}.org" for i in range(12)]
    texts = [f"please write to {m} today" for m in mails]
    texts += ["please write to john at host today", "please write to jdoe, today", "please write to j.doe(at)x today"]
    numbers = [f"+44 20 7946 00{i:02d}" for i in range(12)]
    texts += [f"then simply dial {n}, thanks" for n in numbers] + ["then simply dial 555 123 4567, thanks"]
    discovered = [f"55{i}-1{i}2" for i in range(6)]
    texts += [f"then simply dial {n}, thanks" for n in discovered]
    texts += [f"ask on extension {n} there" for n in discovered] + ["ask on extension 98 there", "and 555 123 4567 elsewhere"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(texts[r["id"]][s["start"] : s["stop"]], s["kind"], r["id"]) for r in pii.extract(df).collect() for s in r["found"]}
    pairs = {(v, k) for v, k, _ in found}
    assert {("john at host", "email"), ("jdoe", "email"), ("j.doe(at)x", "email"), ("555 123 4567", "phone")} <= pairs
    assert ("555 123 4567", "phone", len(texts) - 1) in found  # at all its places
    assert ("98", "phone") in pairs  # its context has only discovered seeds
    assert {v for v, _ in pairs} == {"john at host", "jdoe", "j.doe(at)x", "555 123 4567", "98", *discovered}


def test_op9_gaps_and_one_case_keys():
    kinds = lambda text: [secrets.KINDS[k] for _, k, _ in secrets.find(text)[1]]
    assert kinds("Ab3" * 90 + " user=bob") == ["key", "id"]
    assert kinds("token=" + "x" * 400 + " account: bob") == ["assign", "id"]
    assert kinds("token=" + "x" * 400 + " password=abcdef" + "\n\naccount: bob") == ["assign", "assign"]
    assert kinds("login: bob key " + "A1B2C3D4" * 3 + " at https://db.example.com") == ["id", "key", "endpoint"]
    assert kinds("user=bob k " + "a1z2c3d4" * 3) == ["id", "key"]
    assert kinds("user=bobsmith1234567890 secret=abcdefgh") == ["id", "assign"]
    text = "Ab3" * 90 + " user=bob"
    assert secrets.redact(text, secrets.find(text)[1]) == "[secret] user=[secret]"


def test_op5_fits_on_all_chunks(spark, monkeypatch):
    long = " ".join(f"w{i}" for i in range(3000))
    df = spark.createDataFrame([(i, f"{long} {i}", i % 2) for i in range(6)] + [(6, None, 0)], "doc_id long, text string, quality int")
    seen = []
    monkeypatch.setattr(quality_model, "fit", lambda texts, labels, prior: seen.extend(zip(texts, labels, strict=True)) or prior)
    assert quality_model.train(df, df) == 3 / 7
    assert seen == [(f"{long} {i}".encode(), i % 2) for i in range(6)] + [(b"", 0)]
    data, count = quality_model.chunked([t for t, _ in seen])
    step, chunk = quality_model.STEP, quality_model.CHUNK
    whole = lambda rows: (b"".join(bytes(r[:step]) for r in rows[:-1]) + bytes(rows[-1])).rstrip(b"\0")
    assert data.shape[1] == chunk and whole(data[: count[0]]) == seen[0][0]


def test_op8_counts_only_what_matters(spark):
    known = spark.createDataFrame([("mail me", "email", 9, 10), ("the the", "email", 5, 5000), ("of the", "email", 5, 4000)], "context string, kind string, hits long, total long")
    rows = [("mail me", "jdoe", 1), ("the the", "jdoe", 1), ("the the", "house", 9), ("the the", "tree", 4), ("of the", "tree", 7), ("of the", "sea", 2), ("in a", "lake", 3)]
    candidates = spark.createDataFrame([(c, "email", v, n) for c, v, n in rows], "context string, kind string, value string, n long")
    counts = spark.createDataFrame([("email", v, 20) for v in ("house", "tree", "sea", "lake")] + [("email", "jdoe", 2)], "kind string, value string, places long")
    values = lambda df: {r["value"] for r in df.collect()}
    assert values(pii.reached(known, candidates, 1)) == {"jdoe"}
    assert values(pii.reached(known, candidates, 2)) == {"jdoe", "house", "tree"}
    assert values(pii.reached(known, candidates)) == {"jdoe", "house", "tree", "sea"}
    assert pii.reached(known.filter("context != 'mail me'"), candidates).count() == 0
    right = values(pii.confident_values(known, candidates, counts))
    assert right == values(pii.confident_values(known, pii.reached(known, candidates), counts)) == {"jdoe"}


def test_op8_blocks_are_short_and_places_exact(spark):
    text = " ".join(f"(w{i % 7}) x@y.org" if i % 50 == 0 else f"w{i % 7}" for i in range(900)) + " w1-w2 w3 w4."
    cut = pii.blocks(spark.createDataFrame([(text,)], "text string"), F.col("text")).cache()
    assert cut.agg(F.max(F.size("parts"))).first()[0] <= 100 < cut.agg(F.sum("n")).first()[0]
    values = spark.createDataFrame([("w3", "email"), ("w3 w4", "email"), ("w1-w2", "email"), ("org", "email")], "value string, kind string")
    wanted = {v: [m.start() for m in re.finditer(rf"(?<![\w-]){v}(?![\w-])", text)] for v in ("w3", "w3 w4", "w1-w2")}
    got = {}
    for r in pii._occurrences(cut, values).collect():
        got.setdefault(r["value"], []).append(r["start"])
    assert {v: sorted(at) for v, at in got.items()} == wanted
    assert {r["value"]: r["places"] for r in pii._counts(cut, values).collect()} == {v: len(at) for v, at in wanted.items()}


def test_op8_makes_no_candidates_in_common_contexts(spark, monkeypatch):
    """Two words that stand before five seeds and before very many other words are no pattern; rare ones beside them still are."""
    texts = [f"go of the u{i}@x{i}.org now" for i in range(6)] + [f"text {i} " + "and of the sea " * 40 for i in range(100)]
    texts += [f"Please Write\tto u{i}@x{i}.org today" for i in range(12)] + ["please write to john at host today", "see of the john at home"]
    made = []
    written = pii.materialize
    monkeypatch.setattr(pii, "materialize", lambda df, kept=None: made.append(written(df, kept)) or made[-1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(texts[r["id"]][s["start"] : s["stop"]], s["kind"], r["id"]) for r in pii.extract(df).collect() for s in r["found"]}
    assert found == {("john at host", "email", len(texts) - 2)}
    candidates = [df for df in made if df.columns == ["context", "kind", "value", "n"]]
    assert [(r["context"], r["value"]) for df in candidates for r in df.filter("context is not null").collect()] == [("write to", "john at host")]


def test_op8_possible_contexts(spark):
    texts = ["in of the sea " * 30 + "my mail: a1 b (mail:b2) e-mail: b3 Write  to\nx3 write to y"]
    part = pii.blocks(spark.createDataFrame([(t,) for t in texts], "text string"), F.col("text"))
    rows = [("of the", "email", 2), ("of the", "ip", 40), ("mail:", "email", 1), ("write to", "card", 1), ("of sea", "ip", 1), ("of sea", "card", 11)]
    seeds = spark.createDataFrame([(c, "v", k, n) for c, k, n in rows], "context string, value string, kind string, n long")
    contexts = seeds.select("context", "kind")
    got = {(r["context"], r["kind"]) for r in pii.possible(part, seeds, contexts).collect()}
    assert got == {("of the", "ip"), ("mail:", "email"), ("write to", "card"), ("of sea", "card")}  # not 42 + 30 places for 2, nor 12 for 1
    values = {(r["context"], r["kind"], r["value"], r["n"]) for r in pii._candidates(part, contexts).collect()}
    assert values == {("of the", "email", "sea", 30), ("mail:", "email", "a1", 1), ("write to", "card", "x3", 1)}  # `(mail:` and `e-mail:` are other labels


def test_op8_reads_only_texts_that_may_matter(spark):
    df = spark.createDataFrame([(1, "Write to x"), (2, "no 7"), (3, "write it"), (4, "ΟΔΟΣ x"), (5, None)], "doc_id long, text string")
    t = F.coalesce("text", F.lit(""))
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    of = lambda *rows: spark.createDataFrame(rows, "context string, kind string")
    assert ids(pii.around(df, t, of(("write to", "email")))) == [1]
    assert ids(pii.around(df, t, of(("write to", "email"), ("a b", "ip")))) == [1, 2]
    assert ids(pii.around(df, t, of(("a b", "ip")))) == [2]
    assert ids(pii.around(df, t, of(("\u03bf\u03b4\u03bf\u03c2 x", "email")))) == [1, 4]  # the word isn't ASCII and not looked for
    assert ids(pii.around(df, t, of(*[(f"a{i} b", "email") for i in range(pii.FEW + 1)]))) == [1, 2, 3, 4, 5]
    values = lambda *v: spark.createDataFrame([(x, "email") for x in v], "value string, kind string")
    assert ids(pii.having(df, t, values("Write to", "7."))) == [1, 2]
    assert ids(pii.having(df, t, values(*[f"v{i}" for i in range(pii.FEW + 1)]))) == [1, 2, 3, 4, 5]


def test_op8_cuts_parts_as_before(spark):
    import random

    rng = random.Random(8)
    texts = ["".join(rng.choices(" \t\n:=#(<['\"ab-@\u00e9", k=60)) for _ in range(300)]
    old = r"(?<=\s)(?=\S)|(?<=[:=#(<\['\x22])(?=[^\s:=#(<\['\x22])"
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(F.split("text", pii.PIECE, -1).alias("new"), F.split("text", old, -1).alias("old"))
    assert df.filter("new != old").count() == 0
    last = spark.createDataFrame([(t[:n],) for t in texts for n in (3, 9)], "text string").select(pii._last(F.col("text")).alias("new"), F.rtrim(F.lower("text"), F.lit(pii.WHITE)).alias("old"))
    assert last.filter("new != old").count() == 0


def test_op8_counts_places_in_contexts_that_are_no_patterns(spark):
    texts = [f"go of the u{i}@x{i}.org now" for i in range(6)] + ["text " + "and of the sea " * 40 for _ in range(10)]
    texts += [f"please write to u{i}@x{i}.org today" for i in range(12)] + ["please write to jdoe today", "see of the jdoe there", "see of the jdoe here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(texts[r["id"]][s["start"] : s["stop"]], r["id"]) for r in pii.extract(df).collect() for s in r["found"]}
    assert found == {("jdoe", len(texts) - i) for i in (1, 2, 3)}  # two thirds of its places are behind `of the`, where emails stand too
