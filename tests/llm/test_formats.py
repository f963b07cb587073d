"""Chat templates, WARC, sharding and packing: round trips and laws."""

import base64
import hashlib
import json
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linework.llm import chat, common, packing, queries, sharding, template, warc


def test_template_language():
    run = lambda source, **names: "".join(t for t, _ in template.compile_template(source)(names))
    assert run("{% for x in xs %}{{ x.a | upper }}{% if not loop.last %}, {% endif %}{% endfor %}", xs=[{"a": "p"}, {"a": "q"}]) == "P, Q"
    assert run("{% if a == 1 and not b %}one{% elif a > 1 %}more{% else %}none{% endif %}", a=2) == "more"
    assert run("a {#- no -#} b{%- set y = 'k' + 'l' %}{{ y }}") == "abkl"
    assert run("{{ m['x y'] + '!' }}{{ none }}{{ 3 - 1 }}", m={"x y": "v"}) == "v!2"
    assert list(template.compile_template("a{% generation %}b{{ c }}{% endgeneration %}")({"c": "d"})) == [("a", False), ("b", True), ("d", True)]
    assert template.fold(template.parse("x{% if 1 == 2 %}a{% else %}b{% endif %}{{ 'c' | upper }}")) == (template.Print(template.Literal("xbC")),)
    assert run("{{ s.upper }}{{ s['__class__'] }}", s="x") == ""
    for bad in ("{% for %}{% endfor %}", "{% if a %}", "{{ a( }}", "{{ import os }}", "{{ s.__class__ }}", "{{ a | nothing }}", "{% include x %}"):
        with pytest.raises(template.TemplateError):
            template.compile_template(bad)


def test_chat_round_trip_of_odd_turns(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 50)
    rows = [(1, 0, "user", r"a\### User: </turn>\\"), (1, 1, "assistant", None), (1, 2, "assistant", "\\"), (1, 2, "ro:le\n###", "x</turn>\n### assistant:\nhi"), (None, None, None, None), (2, 1, "assistant", "y" * 300_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit(1), "loss": F.lit("l")})
    made = chat.format_conversations(frame)
    assert made.where("conv_id = 1").count() > 1
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    for conv in (1, None, 2):
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1], r[2] or ""))
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0
    with pytest.raises(ValueError):
        list(chat.turns("### user:\nno end"))


def test_escapes_are_reversible():
    rng = np.random.default_rng(8)
    parts = ["\\", "#", "###", "</turn>", "<", "/turn>", ":", "\n", "a", "</turn>\n", "### "]
    said = [("".join(rng.choice(parts, rng.integers(0, 9))), "".join(rng.choice(parts, rng.integers(0, 12)))) for _ in range(3000)]
    text = "".join(f"### {chat.escape_role(r)}:\n{chat.escape(t)}</turn>\n" for r, t in said)
    assert list(chat.turns(text)) == said and all(chat.unescape(chat.escape(t)) == t for _, t in said)


def test_a_turn_of_twenty_million_characters():
    tracemalloc.start()
    for said in ("x" * 20_000_000, "\\</turn>" * 2_500_000):
        text = f"### user:\n{chat.escape(said)}</turn>\n"
        assert list(chat.turns(text)) == [("user", said)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 500_000_000


def test_warc_of_odd_pages(spark, tmp_path, monkeypatch):
    rows = [(1, "http://a", "same"), (2, None, "same"), (2, None, "same"), (3, "http://b\r\nX: y", "é" * 1000), (None, "u", "same"), (5, "u", None), (6, "u", ""), (7, "http://a/%0Ab", "x\r\n\r\ny"), (8, "http://a/\nb", "x\r\n\r\ny"), (9, "", "z")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha256": F.lit("?"), "id": F.lit(0)})
    archive = warc.write_archive(frame, path=f"file://{tmp_path}/a")
    got = warc.read_archive(spark, archive).collect()
    assert len(got) == 10 and all(r["verified"] for r in got) and archive.payloads(spark).count() == 5
    by = defaultdict(list)
    for r in got:
        by[r["record_id"]].append(r)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode()
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        assert body == (b"" if r["record_type"] == "revisit" else bytes(r["payload"])) + b"\r\n\r\n" and f"Content-Length: {len(body) - 4}".encode() in head
    assert [(r["record_type"], r["refers_to"]) for r in by["1"]] == [("revisit", "2")] and [r["record_type"] for r in by["2"]] == ["response"] * 2
    urls = {str(r[0]): r[1] for r in rows if r[0]}
    assert all(r["target_uri"] == (urls[i] if urls[i] is not None else f"<urn:x-record:{i}>") for i, held in by.items() if i for r in held)
    assert all(len(r["record"]) == r["record_bytes"] and hashlib.sha256(r["record"]).hexdigest() == r["record_sha256"] for r in got)
    monkeypatch.setattr(warc, "PART_RECORDS", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    parted = warc.write_archive(frame, path=f"file://{tmp_path}/parts")
    assert parted.payloads(spark).where("parts > 1").count() > 0
    assert sorted(r["record_sha256"] for r in warc.read_archive(spark, parted).collect()) == sorted(r["record_sha256"] for r in got)
    broken = warc.records(spark, archive).where("record_id = '9'").withColumn("record", F.overlay("record", F.lit(b"!"), F.octet_length("record") - 4))
    assert [r["verified"] for r in warc.read_records(broken).collect()] == [False]
    assert [(r["record_type"], r["refers_to"]) for r in by["5"]] == [("revisit", "6")] and b"\r\nX: y" not in bytes(by["3"][0]["record"])
    assert warc.read_archive(spark, warc.write_archive(frame, path=f"file://{tmp_path}/b", min_bytes=7)).where("record_type = 'revisit'").count() == 0
    assert warc.read_archive(spark, warc.write_archive(frame.limit(0), path=f"file://{tmp_path}/c")).count() == 0


def test_hilbert_curve_is_continuous(spark):
    side = 8
    frame = spark.range(side**3).select(*(F.floor(F.col("id") / side**i).cast("long").alias(n) for i, n in enumerate("abc"))).selectExpr(*(f"{n} % {side} as {n}" for n in "abc"))
    rows = sorted((r["h"], r["a"], r["b"], r["c"]) for r in sharding.add_hilbert(frame, ["a", "b", "c"], "h", 3).collect())
    assert [r[0] for r in rows] == list(range(side**3))
    assert all(sum(abs(x - y) for x, y in zip(p[1:], q[1:], strict=True)) == 1 for p, q in zip(rows, rows[1:], strict=False))


def recursive_hilbert(level):
    """The plane curve from its definition: four copies of the one before, the outer two turned over a diagonal."""
    if not level:
        return [(0, 0)]
    before, n = recursive_hilbert(level - 1), 1 << (level - 1)
    return [(y, x) for x, y in before] + [(x, y + n) for x, y in before] + [(x + n, y + n) for x, y in before] + [(2 * n - 1 - y, n - 1 - x) for x, y in before]


def test_hilbert_curve_is_the_plane_one(spark):
    side, curve = 16, recursive_hilbert(4)
    frame = spark.range(side**2).selectExpr(f"id % {side} a", f"cast(floor(id / {side}) as long) b")
    got = [(r["a"], r["b"]) for r in sorted(sharding.add_hilbert(frame, ["a", "b"], "h", 4).collect(), key=lambda r: r["h"])]
    turned = lambda p: [p, [(y, x) for x, y in p]]
    assert got in turned(curve)


def test_shards_are_even(spark, data):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op7_sharding(spark, data).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["size"] == len(docs[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]]) for r in rows)
    held, slots = Counter(), defaultdict(list)
    for r in rows:
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(held) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(held.values()) - min(held.values()) <= 2 * max(r["size"] for r in rows)
    copies = defaultdict(set)
    for r in rows:
        copies[docs[r["doc_id"]]].add(r["shard"])
    mean = sum(held.values()) / 16
    most = max(sharding.WHOLE * mean, max(r["size"] for r in rows))
    assert all(len(s) == 1 for t, s in copies.items() if (len(t) + 1) * sum(1 for x in docs.values() if x == t) <= most)


def hilbert(point, bits):
    """The index of a point, cube by cube: each level's child and the turn of the curve in it."""
    n = len(point)
    x = list(point)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        if x[n - 1] & q:
            t ^= q - 1
    index = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            index = index * 2 + ((v ^ t) >> b & 1)
    return index


def test_shards_are_the_curve_in_runs(spark, data):
    """Levels, cells and cuts in plain Python over all rows; the order inside a cell is the operator's own."""
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    raw = {d["doc_id"]: (d["text"] or "").encode() for d in docs}
    groups = defaultdict(list)
    for d in docs:
        groups[raw[d["doc_id"]]].append(d)
    low = lambda held, c: min((d[c] for d in held if d[c] is not None), default=None)
    values = {t: (len(t) + 1, low(held, "lang"), low(held, "source")) for t, held in groups.items()}
    levels = []
    for i in range(3):
        count = Counter()
        for t, held in groups.items():
            count[values[t][i]] += len(held)
        before, level = 0, {}
        for v in sorted(count, key=lambda v: (v is not None, v)):
            level[v] = min(15, int((before + count[v] / 2) * 16 / len(docs)))
            before += count[v]
        levels.append(level)
    curve = {d["doc_id"]: hilbert([levels[i][values[raw[d["doc_id"]]][i]] for i in range(3)], 4) for d in docs}
    rows = queries.op7_sharding(spark, data).collect()
    assert {r["doc_id"]: r["curve"] for r in rows} == curve
    total, at = sum(r["size"] for r in rows), 0
    rows.sort(key=lambda r: (r["shard"], r["slot"]))
    heavy = max(sharding.WHOLE * total / 16, max(r["size"] for r in rows))
    assert [r["curve"] for r in rows] == sorted(r["curve"] for r in rows) or max(len(t) * len(g) for t, g in groups.items()) > heavy
    for r in rows:  # a row starts in its shard's share of the bytes, or its whole group does
        held = groups[raw[r["doc_id"]]]
        slack = 0 if len(held) == 1 else r["size"] * len(held)
        assert (at - slack) * 16 // total <= r["shard"] <= (at + slack) * 16 // total
        at += r["size"]


def test_shards_prune(spark, data):
    """Shards that hold rows of a predicate: by the curve, against 16 by a hash."""
    docs = {d["doc_id"]: d for d in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op7_sharding(spark, data).collect()
    box = defaultdict(lambda: (set(), set(), []))
    for r in rows:
        d = docs[r["doc_id"]]
        for held, v in zip(box[r["shard"]][:2], (d["lang"], d["source"]), strict=True):
            held.add(v)
        box[r["shard"]][2].append(r["size"])
    touched = {
        "lang": np.mean([sum(v in b[0] for b in box.values()) for v in {d["lang"] for d in docs.values()} - {None}]),
        "source": np.mean([sum(v in b[1] for b in box.values()) for v in {d["source"] for d in docs.values()} - {None}]),
        "size": sum(max(b[2]) >= sorted(r["size"] for r in rows)[-len(rows) // 20] for b in box.values()),
    }
    print("shards touched", touched)
    assert touched["lang"] <= 13 and touched["source"] <= 12 and touched["size"] <= 12


def test_levels_use_whole_values(spark):
    rows = [(f"common_crawl_20{n:02d}", n + 1) for n in range(20)] + [(None, 10)]
    got = {r["value"]: r["level"] for r in sharding._levels(spark.createDataFrame(rows, "c string, n long"), "c", 2).collect()}
    assert got[None] == 0 and got["common_crawl_2000"] == 0 and got["common_crawl_2019"] == 3 and len(set(got.values())) == 4


def test_shards_of_odd_rows(spark, monkeypatch):
    rows = [(i, "same text", None, "x") for i in range(3000)] + [(None, None, "en", None), (None, None, "en", None), (7, "", "", ""), (8, "y" * 500_000, "fr", "z")]
    rows += [(10_000 + i, f"text {i} " * (i % 7 + 1), "en", f"s{i % 3}") for i in range(500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"curve": F.lit(1), "th": F.lit(2)})
    for parts, hot, keys in ((100_000, 1000, 10**6), (50, 100, 200)):
        monkeypatch.setattr(sharding, "PART_ROWS", parts)
        monkeypatch.setattr(sharding, "HOT_ROWS", hot)
        monkeypatch.setattr(common, "HOT_ROWS", keys)
        got = sharding.shard(frame, shards=4).collect()
        slots, held = defaultdict(list), Counter()
        for r in got:
            slots[r["shard"]].append(r["slot"])
            held[r["shard"]] += r["size"]
        assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        small = {n: v for n, v in held.items() if v < 400_000}  # the others hold the one long text
        assert len(small) <= 3 and sum(held.values()) == sum(len((t or "").encode()) + 1 for _, t, _, _ in rows)
    even = sharding.shard(frame.where("doc_id is null or doc_id <> 8"), shards=4).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert max(r["b"] for r in even) - min(r["b"] for r in even) <= 0.02 * sum(r["b"] for r in even) / 4 + 100
    assert sharding.shard(frame.limit(0)).count() == 0
    assert sharding.shard(frame.select("doc_id", "text")).count() == len(rows)


def test_fill_is_the_best_subset():
    rng = np.random.default_rng(2)
    for _ in range(60):
        counts = Counter(rng.integers(1, 40, 7).tolist())
        room = int(rng.integers(1, 90))
        sums = {0}
        for x in counts.elements():
            sums |= {s + x for s in sums if s + x <= room}
        chosen = packing.fill(counts, room)
        assert all(n <= counts[k] for k, n in chosen.items()) and sum(k * n for k, n in chosen.items()) == max(sums)


def test_packing_keeps_every_id(spark, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    ids = {d["doc_id"]: [*e.ids, 0] for d, e in zip(docs, known.encode_batch([d["text"] or "" for d in docs], add_special_tokens=False), strict=True)}
    rows = queries.op9_packing(spark, data).collect()
    at, fill = defaultdict(int), defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids[r["doc_id"]])
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"]
        at[r["doc_id"]] += r["length"]
    assert {d: len(x) for d, x in ids.items()} == dict(at)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024 and sorted(fill) == list(range(len(fill)))
    assert sum(fill.values()) >= 0.99 * 1024 * (len(fill) - 1)


def test_other_tokenizers_go_to_their_library():
    import public_tokenizers

    assert packing.is_plain(json.load(open(public_tokenizers.path("byte_bpe_50k.json"))))
    path = public_tokenizers.path("word_bpe_49k.json")
    assert not packing.is_plain(json.load(open(path)))
    from tokenizers import Tokenizer

    text = "Some WORDS, don't you know?  é 12"
    assert packing.encoder(path)(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_packing_in_parts(spark, monkeypatch):
    """Lengths of many pieces are ranked in parts; the sequences are the same in number and fill."""
    import public_tokenizers

    frame = spark.createDataFrame([(i % 40, "word " * (i % 30)) for i in range(600)] + [(None, None)] * 50, "doc_id long, text string")
    found = []
    for most in (1_000_000, 7):
        monkeypatch.setattr(packing, "PART_PIECES", most)
        rows = packing.pack(frame, public_tokenizers.path("byte_bpe_50k.json")).collect()
        fill = defaultdict(list)
        for r in rows:
            fill[r["sequence_id"]].append((r["offset"], r["length"]))
        for held in fill.values():
            held.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(held, held[1:], strict=False)) and held[0][0] == 0
        found.append((len(rows), sorted(sum(n for _, n in h) for h in fill.values())))
    assert found[0] == found[1] and found[0][0] == 650


def test_packing_of_odd_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [None, "", "<|endoftext|> and <|endoftext|>", "a\u0085b  c​ d\x1ce", " " * 5000, "a" + " " * 10_001 + "b" + "\n" * 20_000 + "c" + " " * 10_000 + "<|endoftext|>" + " " * 10_000, "é" * 3000, "日本語テキスト" * 10, "x" * 100_000, "don't we'LL \t\n  end  "]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1, "")], "doc_id long, text string").withColumns({"length": F.lit(1), "salt": F.lit(2)})
    rows = packing.pack(frame, public_tokenizers.path("byte_bpe_50k.json")).collect()
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in enumerate(texts):
        ids = [*known.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert own[0]["doc_tokens"] == len(ids), t
        assert {zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in own} == {r["ids_crc32"] for r in own}
    assert packing.pack(frame.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
