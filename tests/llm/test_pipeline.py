"""The pipeline's stages: each drops what it should from all that its predecessor kept."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from linework.llm import quality, queries
from pyspark.sql import functions as F
from test_copies import components, plain_contamination, plain_fingerprint
from test_models import plain_score


def test_stages_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, held = docs.columns, docs.count()
    good = corpus_pipeline.keep_good(spark, docs, data)
    assert good.columns == columns
    scores = queries.op1_quality(spark, data)
    assert {r[0] for r in good.select("doc_id").collect()} == {r[0] for r in scores.where("predicted = 1").select("doc_id").collect()}
    known = corpus_pipeline.keep_known_language(spark, docs, data)
    assert known.count() == queries.op4_language_id(spark, data).where("lang_pred <> 'und'").count()
    one = corpus_pipeline.keep_one_of_each(spark, docs, data)
    groups = queries.op10_simhash(spark, data)
    assert {r[0] for r in one.select("doc_id").collect()} == {r[0] for r in groups.select("component_id").distinct().collect()} and one.columns == columns
    clean = corpus_pipeline.drop_contaminated(spark, docs, data)
    bad = queries.op2_decontamination(spark, data).where("contaminated").count()
    assert bad > 0 and clean.count() == held - bad and clean.columns == columns


def test_stages_with_odd_rows(spark, data):
    rows = [(1, None, "en"), (2, "", None), (None, "Ein Text mit Worten.", "de"), (3, "Some words and so on.", "en"), (3, "Some words and so on.", "en"), (4, "long words " * 100_000, "en")]
    clash = {"score": 1, "lang_pred": 2, "bad_id": 1, "kept": 2, "predicted": 3, "start": 4, "length": 5, "fingerprint": 6, "__row": 7, "text_": 8}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({n: F.lit(v) for n, v in clash.items()})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, data)
        assert kept.columns == docs.columns and kept.count() <= 6, name
        assert all(tuple(r)[3:] == tuple(clash.values()) for r in kept.collect()), name
        assert stage(spark, docs.limit(0), data).count() == 0, name
    assert sorted(r["doc_id"] or 0 for r in corpus_pipeline.keep_one_of_each(spark, docs, data).collect()) == [0, 1, 3, 4]
    packed = corpus_pipeline.pack(spark, docs, data).collect()
    assert Counter(r["doc_id"] for r in packed if not r["start"]) == {1: 1, 2: 1, None: 1, 3: 2, 4: 1} and sum(r["length"] for r in packed if r["doc_id"] == 4) == packed[[r["doc_id"] for r in packed].index(4)]["doc_tokens"]
    assert corpus_pipeline.pack(spark, docs.limit(0), data).count() == 0


def test_quality_stage_learns_nothing_from_nothing(spark, tmp_path):
    """Without labels all documents score 0.5 and stay."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    assert corpus_pipeline.keep_good(spark, docs, str(tmp_path)).count() == 2


def one_of_each(spark, data, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return sorted((tuple(r) for r in corpus_pipeline.keep_one_of_each(spark, docs, data).collect()), key=str)


def test_survivors_are_rows(spark, data):
    a, b, c = "Eggs and butter make a plain sauce for fish.", "A tram left the square at noon with nobody in it.", "Granite weathers slowly where the frost is rare."
    # (a) a row without an id goes with its own group only
    rows = [(3, a, "en"), (None, a, "en"), (None, b, "en"), (None, c, "en"), (4, c, "en")]
    assert one_of_each(spark, data, rows) == [(3, a, "en"), (4, c, "en"), (None, b, "en")]
    # (b) ids with several texts: each group keeps a row, and unrelated texts of one id both stay
    assert one_of_each(spark, data, [(5, a, "en"), (5, b, "en"), (3, b, "en")]) == [(3, b, "en"), (5, a, "en")]
    assert one_of_each(spark, data, [(5, a, "en"), (5, b, "en")]) == [(5, b, "en"), (5, a, "en")]
    # (c) groups without any id keep one row, and rows equal in id and text become one, always the same
    rows = [(None, a, "en"), (None, a, "en"), (None, b, "en"), (7, c, "fr"), (7, c, "en")]
    assert one_of_each(spark, data, rows) == [(7, c, "en"), (None, b, "en"), (None, a, "en")]


def test_pipeline_is_brute_force(spark):
    """Every stage in plain Python, one after the other, on 200 documents and some odd rows."""
    import public_tokenizers
    from tokenizers import Tokenizer

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = quality.learn(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {i: t for i, t in rows.items() if plain_score(model, t) >= 0.5}
    rows = {i: t for i, t in rows.items() if any(c.isalpha() for c in t or "")}
    ids, fps = sorted(rows), {i: plain_fingerprint(t) for i, t in rows.items()}
    root = components(ids, [(a, b) for n, a in enumerate(ids) for b in ids[:n] if (fps[a] ^ fps[b]).bit_count() <= 2])
    rows = {i: rows[i] for i in ids if root[i] == i}
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    bad = plain_contamination(rows.items(), items)
    rows = {i: t for i, t in rows.items() if not bad[i][-1]}
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*known.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows.items()}
    got = corpus_pipeline.run(spark, data).collect()
    assert {r["doc_id"] for r in got} == set(want) and 0 < len(want) < len(ids)
    for r in got:
        piece = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"]
    assert sum(r["length"] for r in got) == sum(map(len, want.values()))
