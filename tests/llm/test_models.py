"""Quality classifier and language identification: held-out accuracy and odd inputs."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from linework.llm import langid, quality, queries


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    moves, chains = rng.normal(size=(2, 2)), [rng.normal(size=n) for n in (1, 4, 6)]
    for nodes, (good, expected) in zip(chains, quality.forward_backward(chains, moves), strict=True):
        weights, states = [], list(product((0, 1), repeat=len(nodes)))
        for s in states:
            weights.append(np.exp(sum(n * y for n, y in zip(nodes, s, strict=True)) + sum(moves[a, b] for a, b in zip(s, s[1:], strict=False))))
        p = np.array(weights) / sum(weights)
        assert np.allclose(good, p @ np.array(states))
        pairs = np.zeros((2, 2))
        for s, q in zip(states, p, strict=True):
            for a, b in zip(s, s[1:], strict=False):
                pairs[a, b] += q
        assert np.allclose(expected, pairs)


def test_long_chains_are_the_same():
    rng = np.random.default_rng(4)
    moves = rng.normal(size=(2, 2))
    for n in (1, 2, 3, 10, 5000):
        nodes = rng.normal(size=n) * 3
        assert np.allclose(quality.long_marginals(nodes, moves), quality.forward_backward([nodes], moves, False)[0][0])


def plain_score(model, text):
    """The score of one text, line by line."""
    x, weights = quality.line_features(text)
    x, width, node = x.astype(float).tolist(), len(x[0]), []
    for n in range(len(x)):
        row = x[n] + (x[n - 1] if n else [0.0] * width) + (x[n + 1] if n + 1 < len(x) else [0.0] * width)
        node.append(sum((v - m) / s * w for v, m, s, w in zip(row, model.mean, model.scale, model.weights, strict=True)))
    ahead, back = [(0.0, node[0])], [(0.0, 0.0)]
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    for v in node[1:]:
        ahead.append(tuple(add(*(ahead[-1][i] + model.moves[i, j] for i in (0, 1))) + v * j for j in (0, 1)))
    for v in reversed(node[1:]):
        back.append(tuple(add(*(model.moves[i, j] + v * j + back[-1][j] for j in (0, 1))) for i in (0, 1)))
    good = [1 / (1 + math.exp(min(700, a[0] + b[0] - a[1] - b[1]))) for a, b in zip(ahead, reversed(back), strict=True)]
    raw = min(1 - 1e-6, max(1e-6, sum(g * w for g, w in zip(good, weights, strict=True)) / sum(weights)))
    return 1 / (1 + math.exp(-min(30, max(-30, model.slope * math.log(raw / (1 - raw)) + model.shift))))


def test_quality_is_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = quality.learn(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    got = {r["doc_id"]: r["score"] for r in queries.op1_quality(spark, data).collect()}
    some = docs.orderBy(F.xxhash64("doc_id")).limit(60).collect()
    assert np.allclose([got[r["doc_id"]] for r in some], [plain_score(model, r["text"]) for r in some], atol=1e-5)


def test_quality_sample_is_bounded(spark, monkeypatch):
    """An id of many texts, and a text of many rows, don't exceed the bound on rows."""
    monkeypatch.setattr(quality, "SAMPLE_DOCS", 5)
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, w, y: seen.append((len(x), sorted(len(c) for c in x))))
    docs = spark.createDataFrame([(1, f"text {n}\nmore") for n in range(30)] + [(2, "same\n" * 100)] * 40, "doc_id long, text string")
    quality.learn(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int"))
    assert seen[0][0] == 5
    quality.learn(docs.where("doc_id = 2"), spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int"))
    assert seen[1] == (1, [101])


def test_quality_holds_out(spark, data):
    found = queries.op1_quality(spark, data)
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.9
    assert found.where("score is null or score < 0 or score > 1").count() == 0
    assert found.count() == spark.read.parquet(f"{data}/documents.parquet").count()


@pytest.fixture(scope="module")
def odd(spark):
    long = "The quick brown fox. " * 20_000
    rows = [(1, None, "en", 9.0), (2, "", None, 1.0), (2, "", None, 1.0), (None, "Some words.\nAnd more of them.", "en", 0.0), (4, long, "fr", 2.0), (5, "12 !!", "en", 3.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")


def test_quality_odd_rows(spark, odd):
    model = quality.learn(odd, spark.createDataFrame([], "doc_id long, quality int"))
    rows = quality.classify(odd, model, [F.col("doc_id")]).collect()
    assert len(rows) == 6 and all(r["score"] == 0.5 for r in rows)
    assert quality.classify(odd.limit(0), model, [F.col("doc_id")]).count() == 0
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (1, None), (None, 1)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in quality.classify(odd, quality.learn(odd, labels), [F.col("doc_id")]).collect()}
    assert rows[4]["predicted"] == 1 and rows[5]["predicted"] == 0


def test_language_holds_out(spark, data):
    found = queries.op4_language_id(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang", "text")
    rows = found.join(docs, "doc_id").where("held_out and lang_pred <> 'und' and length(text) > 40").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows if r["lang"]]) >= 0.95
    assert found.where("(lang_pred = 'und') <> (score = 0)").count() == 0


def test_phrases_are_longest_matches():
    text, other = "abracadabra banana", "cabana bandana abra"
    model = langid.Automaton((("a", text), ("b", "xyz")))
    learned, codes = model.encode(text), model.encode(other)
    whole, at, n = bytes(learned), 0, 0
    while at < len(codes):
        size = 1
        while at + size < len(codes) and bytes(codes[at : at + size + 1]) in whole:
            size += 1
        at, n = at + size, n + 1
    assert model.phrases([codes])[0][0] == n


def test_every_letter_counts():
    rng = np.random.default_rng(3)
    # Two languages of the same 400 letters, whose words differ, beside one that takes the frequent codes.
    vocabulary = {lang: ["".join(map(chr, rng.integers(0x4E00, 0x4E00 + 400, 3))) for _ in range(150)] for lang in ("x", "y")}
    say = lambda lang: " ".join(rng.choice(vocabulary[lang], 40))
    latin = "".join(map(chr, [*range(97, 123), *range(0xDF, 0xF7), *range(0x3B1, 0x3C9)])) * 100
    samples = {"l": latin, **{lang: "\0".join(say(lang) for _ in range(60)) for lang in ("x", "y")}}
    model = langid.Automaton(tuple(samples.items()))
    letters = {c for text in samples.values() for c in text if c.isalpha()}
    codes = [int(model.encode(c)[0]) for c in sorted(letters)]
    assert len(letters) > 400 and len(set(codes)) == len(letters) and min(codes) > 0
    assert model.encode("İ").tolist() == [0] and model.encode("Ψ").tolist() == model.encode("ψ").tolist() != [0]
    texts = [say(lang) for lang in "xy" * 20]
    assert [lang for lang, _ in model.predict(texts)] == list("xy" * 20)
    for n, sample in enumerate(samples.values()):
        text = "".join(sample[at : at + 1 + at % 7] for at in rng.integers(0, len(sample), 80)).replace("\0", "")
        whole, codes = f",{','.join(map(str, model.encode(sample, keep_marks=True)))},", model.encode(text).tolist()
        at, phrases = 0, 0
        while at < len(codes):
            size = 1
            while at + size < len(codes) and f",{','.join(map(str, codes[at : at + size + 1]))}," in whole:
                size += 1
            at, phrases = at + size, phrases + 1
        assert model.phrases([model.encode(text)])[0][n] == phrases


def plain_phrases(sample, text):
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, n = at + size, n + 1
    return n


def test_language_is_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    samples = langid.learn(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    assert all(len(x) > 5_000 and len(x.split("\0")) <= langid.SAMPLES for x in samples.values())
    model = langid.Automaton(tuple(samples.items()))
    plain = lambda t, marks=False: "".join(map(chr, (model.encode(t, marks) + 40).tolist()))
    coded = [plain(s, True) for s in samples.values()]
    got = {r["doc_id"]: r for r in queries.op4_language_id(spark, data).collect()}
    for r in docs.where("text is not null").orderBy(F.length("text").desc()).limit(3).collect() + docs.orderBy(F.xxhash64("doc_id")).limit(50).collect():
        if not any(c.isalpha() for c in r["text"] or ""):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        text = plain(r["text"])
        rates = [plain_phrases(s, text) * math.log2(len(s)) / len(text) for s in coded]
        best, second = sorted(rates)[:2]
        assert got[r["doc_id"]]["lang_pred"] == list(samples)[rates.index(best)] and abs(got[r["doc_id"]]["score"] - second / (second + best)) < 1e-9


def test_parse_carries_on(monkeypatch):
    """Blocks parse as one run over the text does."""
    rng = np.random.default_rng(6)
    model = langid.Automaton((("a", "".join(rng.choice(list("abc d"), 400))), ("b", "".join(rng.choice(list("cdéž"), 300)))))
    coded = [model.encode("".join(rng.choice(list("abcdé ž?"), n))) for n in (1, 3, 50, 700, 701, 9)]
    want = model.phrases(coded)
    for block in (1, 2, 7, 64):
        monkeypatch.setattr(langid, "BLOCK", block)
        assert (model.phrases(coded) == want).all()
    same = langid.Automaton((("a", "ab" * 300), ("b", "c" * 50)))  # parses that meet late or never
    long = [same.encode("ab" * 100), same.encode("a" * 100), same.encode("c" * 130)]
    monkeypatch.setattr(langid, "BLOCK", 10**6)
    want = same.phrases(long)
    monkeypatch.setattr(langid, "BLOCK", 9)
    assert (same.phrases(long) == want).all()


def test_samples_are_whole_texts(spark, monkeypatch):
    rows = [(f"{n} " + "abc " * (n * 37 % 5000), "en") for n in range(60)] + [("x" * (langid.LONGEST + n), "xx") for n in range(1, 40)] + [("copied text", "cc")] * 50 + [("lone", "rare"), (None, "rare"), ("  ", "rare")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    found = langid.learn(docs)
    texts = {t for t, _ in rows}
    assert all(s in texts for x in found.values() for s in x.split("\0")) and found["cc"] == "copied text" and found["rare"] == "lone"
    assert len(found["en"].split("\0")) == langid.SAMPLES and all(len(s) <= langid.LONGEST for s in found["en"].split("\0"))
    assert min(map(len, found["xx"].split("\0"))) == langid.LONGEST + 1 and len(found["xx"].split("\0")) <= langid.SAMPLES
    monkeypatch.setattr(langid, "MOST_LANGS", 2)
    assert set(langid.learn(docs)) == {"en", "cc"}


def test_quality_learns_from_so_many_lines(spark, monkeypatch):
    rows = [(n, "\n".join(f"line {n} {k}" for k in range(1 + n % 4))) for n in range(40)] + [(99, "\n".join("one more" for _ in range(500)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality")
    held = []
    monkeypatch.setattr(quality, "SAMPLE_LINES", 50)
    monkeypatch.setattr(quality, "fit", lambda chains, weights, labels: held.append([len(c) for c in chains]))
    quality.learn(docs, labels)
    assert 10 < sum(held[0]) <= 50 and max(held[0]) <= 5

def test_language_odd_rows(spark, odd):
    samples = langid.learn(odd)
    assert set(samples) == {"en", "fr"}
    rows = langid.identify(odd, samples, [F.col("doc_id")]).collect()
    assert {(r["doc_id"], r["lang_pred"]) for r in rows} == {(1, "und"), (2, "und"), (None, "en"), (4, "fr"), (5, "und")} and len(rows) == 6
    assert {r["lang_pred"] for r in langid.identify(odd, {}, [F.col("doc_id")]).collect()} == {"und"}
    assert langid.learn(odd.limit(0)) == {}
    clash = odd.withColumns({"lang_pred": F.lit(1), "predicted": F.lit(1), "text_": F.lit(2)})
    rows = langid.identify(clash, samples, [F.col(c) for c in ("doc_id", "score", "lang_pred", "text")])
    assert rows.columns == ["doc_id", "text", "lang_pred", "score"] and rows.count() == 6
    model = quality.learn(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.classify(clash, model, [F.col(c) for c in ("text", "score", "text_", "predicted")]).columns == ["text", "text_", "score", "predicted"]
