"""Alignment, substring deduplication and the divergence audit against brute force, and their odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import public_tokenizers
from pyspark.sql import functions as F

from linework.llm import align, common, divergence, queries, substrings
from linework.llm.packing import byte_of

DATA = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOC = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def plain_sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)

    def sides(text):
        left = [(t, bytes(map(byte_of().__getitem__, a.id_to_token(t)))) for t in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(t, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p := b.id_to_piece(t)) and b.is_byte(t) else p.replace("▁", " ").encode()) for t in b.encode(text)]
        return left, right

    return sides


def plain_groups(text, sides):
    if not text:
        return None
    left, right = sides(text)
    if not b"".join(x for _, x in left) == b"".join(x for _, x in right) == (" " + text).encode():
        return None
    place, ends = 0, defaultdict(lambda: ([], []))
    for n, tokens in enumerate((left, right)):
        place = 0
        for t, x in tokens:
            place += len(x)
            ends[place][n].append(t)
    groups, now = [], ([], [])
    for place in sorted(ends):
        now[0].extend(ends[place][0])
        now[1].extend(ends[place][1])
        if ends[place][0] and ends[place][1]:
            groups.append((now[0], now[1], [(x, y) for x in ends[place][0] for y in ends[place][1]]))
            now = ([], [])
    return groups


def plain_alignment(texts, sides):
    found = [plain_groups(t, sides) for t in texts]
    counts = Counter(p for g in found for x in g or () for p in x[2])
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    rows = []
    for g in found:
        links = [p for x in g or () for p in x[2]]
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _ in g or ())
        rows.append((sum(len(x[0]) for x in g or ()), sum(len(x[1]) for x in g or ()), len(g or ()), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), "" if g is None else hashlib.sha256(shown.encode()).hexdigest()))
    return rows


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [None, "", " ", "  a  b ", "\n\t x\n", "a b 　c", "ｆｕｌｌ ﬁ é", "<s> <0x41> </s> <unk>", "x ▁ z", "▁", "<|endoftext|> a<|endoftext|>", "\0a\x1c b\x85 c", "日本語のテキスト です", "I'll we've  'S", "a" * 3000, "ab " * 3000, "🙂🙃 1234567 x", "é ​"]


def test_alignment_is_brute_force(spark, plain_sides):
    rows = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_align(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert rows == dict(zip((r["doc_id"] for r in docs), plain_alignment([r["text"] for r in docs], plain_sides), strict=True))


def test_alignment_of_odd_rows(spark, plain_sides, monkeypatch):
    docs = spark.createDataFrame([(n, t, "N", 7) for n, t in enumerate(ODD)] + [(None, "ab ab", "x", 1), (3, ODD[3], "y", 2)], "doc_id long, text string, N_A string, pair int")
    texts = [*ODD, "ab ab", ODD[3]]
    want = sorted(zip([*range(len(ODD)), -1, 3], plain_alignment(texts, plain_sides), strict=True))
    got = lambda: sorted((-1 if r["doc_id"] is None else r["doc_id"], tuple(r[c] for c in COLUMNS)) for r in align.align(docs, A, B).collect())
    assert got() == want and sum(w[1][0] > 0 for w in want) > 10 and dict(want)[9][0] == 0
    for name in ("BROADCAST_BYTES", "HOT_ROWS"):
        monkeypatch.setattr(common, name, 1)
    assert got() == want
    assert align.align(docs.where("false"), A, B).count() == 0
    shown = align.groups(docs.where("doc_id = 3").limit(1), A, B).orderBy("nth").collect()
    assert [list(x[:2]) for x in plain_groups(ODD[3], plain_sides)] == [[r["a_ids"], r["b_ids"]] for r in shown] and shown[-1]["stop"] == len(ODD[3]) + 1


def test_merge_of_ends():
    assert align.merge([1, 3, 3, 5], [3, 3, 4, 5, 6]) == [(0, 3, 0, 2), (3, 4, 2, 4)] and align.merge([], [1]) == []


def plain_removal(rows, window=50):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for s in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def removal(df, **more):
    return [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.deduplicate(df, **more).collect()]


def test_substrings_are_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    want = plain_removal([tuple(r) for r in docs.collect()])
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op12_substrings(spark, data).collect()]
    assert sorted(got) == sorted(want) and sum(w[2] > 0 for w in want) > 50


def _passages(rng):
    """Texts of a small vocabulary that share passages of 45 to 130 words at any place, some of them within a text."""
    word = lambda: f"w{rng.randrange(900)}"
    shared = [[word() for _ in range(n)] for n in (45, 49, 50, 51, 60, 74, 75, 130)]
    rows = []
    for i in range(150):
        text = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(shared)
            a = rng.choice((0, 0, rng.randrange(20)))
            text += [word() for _ in range(rng.randrange(60))] + p[a : len(p) - rng.choice((0, 0, rng.randrange(15)))]
        rows.append((i * 7 % 151, rng.choice(" \n\t").join(text)))
    return rows


def test_substrings_of_shared_passages(spark, monkeypatch):
    rng = random.Random(4)
    rows = _passages(rng)
    rows += [(200, None), (201, ""), (202, " \v\f "), (203, "a " * 400), (204, "a " * 170), (205, "x " + "a " * 60), (None, rows[5][1]), (None, None), (rows[9][0], rows[9][1]), (rows[9][0], rows[5][1]), (206, "é " * 49), (207, "é " * 50 + "A b c"), (208, "É " + "é " * 50)]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, TH string, spans int").repartition(3)
    want = sorted(map(str, plain_removal(rows)))
    assert sorted(map(str, removal(docs))) == want and sum("0" != w.split(", ")[2] for w in want) > 60
    for name in ("BROADCAST_BYTES", "HOT_ROWS"):
        monkeypatch.setattr(common, name, 2)
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(substrings, "MOST", 3)
    assert sorted(map(str, removal(docs))) == want
    assert substrings.deduplicate(docs.where("false")).count() == 0
    kept = substrings.deduplicate(docs, keep_text=True).where("n_removed > 0").collect()
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] and sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in kept)


def test_substrings_of_other_windows_and_ids(spark):
    rng = random.Random(9)
    rows = [(f"id{i:03}", " ".join(rng.choice("ab") for _ in range(rng.randrange(90)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(removal(docs, window=22)) == sorted(plain_removal(rows, 22))


def plain_audit(rows, least):
    terms = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate({c: c + 32 for c in range(65, 91)}))) for r in rows]
    docs, counts, groups = Counter(), Counter(), set()
    for lang, source, found in terms:
        groups.add((lang, source))
        docs.update({(lang, t) for t in found})
        counts.update((lang, source, t) for t in found)
        counts.update((lang, None, t) for t in found)
    kept = defaultdict(list)
    for (lang, t), n in docs.items():
        if n >= least:
            kept[lang].append(t)

    def share(lang, source):
        n = sum(counts[lang, source, t] for t in kept[lang])
        return {t: 1 + 10**9 * (counts[lang, source, t] + 5) // (n + 5 * len(kept[lang])) for t in kept[lang]}

    out = []
    for lang, source in groups:
        p, q = share(lang, source), share(lang, None)
        pairs = [(-sum(abs(p[t] - o[t]) for t in p), other.encode(), other) for at, other in groups if at == lang and other != source for o in [share(lang, other)]]
        own = [(q[t] - p[t], t.encode(), t) for t in p if counts[lang, source, t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(own)[:50])):
            out += [(lang, source, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def test_audit_of_odd_rows(spark, monkeypatch):
    rng = random.Random(2)
    vocab = ["The", "the", "é", "É", "ß", "日本", "😀x", "a-b", "x1y", " ", *(f"t{chr(97 + i)}" for i in range(20))]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(30))), rng.choice(("en", "de", None, "")), rng.choice((*"abcdef", None, ""))) for i in range(400)]
    rows += [(1, None, "en", "none"), (2, "", "fr", "lone"), (3, "rare words only", "it", "p"), (4, "12 !", "it", "q"), (None, "the the", "en", "a")]
    rows += [rows[0]] * 3
    docs = spark.createDataFrame([(*r, 1, "v") for r in rows], f"{DOC}, RANK int, value string")
    found = lambda df: sorted(tuple(r) for r in divergence.audit(df, least_docs=9).select("lang", "source", "part", "item", "value", "rank").collect())
    want = plain_audit(rows, 9)
    assert found(docs) == want and {r[2] for r in want} == {"pair", "term"} and ("it", "p", "pair", "q", 0, 1) in want
    monkeypatch.setattr(divergence, "PART_SOURCES", 2)
    monkeypatch.setattr(divergence, "HELD", 10)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1)
    assert found(docs) == want
    assert divergence.audit(docs.where("false")).count() == 0
    big = spark.range(1).select(divergence._share(F.lit(10**13), F.lit(10**15), F.lit(10**9)).alias("p")).first()["p"]
    assert big == 1 + 10**9 * (10**13 + 5) // (10**15 + 5 * 10**9)


def test_very_long_texts(spark, plain_sides):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(10**6)}é" for _ in range(60_000))
    rows = [(1, long), (2, "a few words before " + long.replace(" ", "\n") + " and after"), (3, "x" * 300_000), (4, "y " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: r[1:3] for r in removal(docs)}
    assert got == {1: (60_000, 0), 2: (60_006, 60_000), 3: (1, 0), 4: (100_000, 0)}
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in align.align(docs, A, B).collect()}
    assert found == dict(zip((1, 2, 3, 4), plain_alignment([t for _, t in rows], plain_sides), strict=True))
    groups, postings = divergence.shares(divergence.term_counts(docs.selectExpr("doc_id", "text", "'en' lang", "cast(doc_id as string) source")), 1)
    assert sorted((r["source"], r["support"]) for r in groups.collect()) == [("1", 2), ("2", 8), ("3", 1), ("4", 1)] and postings.count() == 12
