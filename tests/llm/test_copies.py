"""SimHash, embeddings, decontamination and licence scans against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from linework.llm import common, decontam, embeddings, licences, queries, simhash
from linework.llm.components import connected_components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def components(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_is_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    ids = sorted(fps)
    f = np.array([fps[i] for i in ids], np.uint64)
    near = np.argwhere(np.bitwise_count(f[:, None] ^ f[None]) <= 2)
    want = components(ids, [(ids[a], ids[b]) for a, b in near if a < b])
    got = queries.op10_simhash(spark, data).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in ids}
    assert len(got) == len(ids)


def test_simhash_hot_bucket(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 60, (300, 2))} | {int(x) for x in rng.integers(1 << 62, size=50)})
    f = np.array(fps, np.uint64)
    want = components(fps, [(fps[a], fps[b]) for a, b in np.argwhere(np.bitwise_count(f[:, None] ^ f[None]) <= 2) if a < b])
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    for most, hot in ((256, 10**6), (8, 3)):
        monkeypatch.setattr(simhash, "HOT_BUCKET", most)
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        pairs = [(r["u"], r["v"]) for r in simhash.links(frame).collect()]
        assert all(bin(a ^ b).count("1") <= 2 or most == 8 for a, b in pairs)
        assert components(fps, pairs) == want


def test_simhash_odd_rows(spark):
    rows = [(3, None, "x"), (1, "", "x"), (7, "A b c d", "x"), (7, "A b c d", "x"), (None, "a B c d", "y"), (9, "word " * 100_000, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == [("1", 1), ("3", 1), ("7", 7), ("7", 7), ("9", 9), ("None", 7)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def planted(rng, n, cosines, dims=64):
    """n random unit vectors, and for each cosine a copy of the next one at exactly that angle, about."""
    v = rng.normal(size=(n, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    aside = rng.normal(size=(len(cosines), dims))
    aside -= np.einsum("ij,ij->i", aside, v[: len(cosines)])[:, None] * v[: len(cosines)]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    c = np.array(cosines)[:, None]
    return np.vstack([v, c * v[: len(cosines)] + np.sqrt(1 - c**2) * aside])


def test_embeddings_find_planted_links(spark, monkeypatch):
    """Keys of eight bits, pairs from the threshold itself up, and pairs just below it."""
    monkeypatch.setattr(embeddings, "BUCKET", 48)
    cosines = [0.9 + 1e-7] * 400 + [0.92] * 200 + [0.95] * 200 + [1.0] * 20 + [0.9 - 1e-7] * 300 + [0.85] * 200
    v = planted(np.random.default_rng(11), 6000, cosines)
    assert embeddings.tables(len(v))[0] == 8
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert near.sum() == 2 * 820
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(frame).collect()}
    found = np.array([got[i]["n_links"] for i in range(len(v))])
    assert (found <= near.sum(axis=1)).all()  # nothing below the threshold
    linked = np.array([got[i]["component_id"] for i in range(len(v))])
    by_cosine = {c: np.mean([found[6000 + n] == 1 and linked[6000 + n] == n for n, x in enumerate(cosines) if x == c]) for c in (0.9 + 1e-7, 0.92, 0.95, 1.0)}
    print("recall by cosine", by_cosine, "of all", found.sum() / near.sum())
    assert found.sum() >= 0.99 * near.sum() and by_cosine[0.95] == by_cosine[1.0] == 1


def test_embeddings_of_the_table(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    v = np.array([r["embedding"] for r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.9
    np.fill_diagonal(near, False)
    assert near.sum() == 0  # so this says only that nothing links wrongly
    got = queries.op8_embeddings(spark, data).collect()
    assert len(got) == len(rows) and all(r["n_links"] == 0 and r["kept"] and r["component_id"] == r["vec_id"] for r in got)


def test_bounds_hold(monkeypatch):
    """No pair at the threshold lies above its bound; random pairs mostly lie below."""
    rng = np.random.default_rng(12)
    for dims in (64, 100):
        v = planted(rng, 4000, [0.9] * 2000, dims)
        a, b = embeddings.encode(v[:2000]), embeddings.encode(v[4000:])
        near = embeddings.maybe_near(a, b, dims, 0.9)
        assert near.diagonal().all() and near.mean() < 0.1


@pytest.mark.parametrize(("block", "dense", "hot"), [(40, 0, 50), (2048, 8, 10**6), (40, 10**6, 10**6)])
def test_embeddings_dense_blocks(spark, monkeypatch, block, dense, hot):
    """Blocks of a hot bucket, copies, near copies and vectors that link with nothing."""
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "DENSE_PAIRS", dense)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rng = np.random.default_rng(5)
    a = rng.normal(size=64)
    v = [*(a + rng.normal(size=(150, 64)) * 0.25), *rng.normal(size=(60, 64)), a, a, a * 2]
    v = [np.float32(x).tolist() for x in v]
    bad = [None, [0.0] * 64, [float("nan")] * 64, [None] + [1.0] * 63, [], [float("inf")] + [1.0] * 63, [1.0, 2.0]]
    frame = spark.createDataFrame([(i, x, i) for i, x in enumerate(v + bad)], "vec_id long, embedding array<float>, n_links int")
    u = np.array(v, np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(frame).collect()}
    assert [got[i]["n_links"] for i in range(len(v))] == near.sum(axis=1).tolist()
    want = components(range(len(v)), np.argwhere(near).tolist())
    assert {i: got[i]["component_id"] for i in range(len(v))} == want
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(len(v), len(v) + len(bad)))
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_codes_are_unbiased():
    rng = np.random.default_rng(7)
    x, q = rng.normal(size=64), rng.normal(size=64)
    x, q = x / np.linalg.norm(x), q / np.linalg.norm(q)
    found = []
    for n in range(400):
        r = embeddings.rotation(64, n)
        code = np.sign(r @ x) / 8
        found.append(code @ (r @ q) / (code @ (r @ x)))
    assert abs(np.mean(found) - x @ q) < 0.02


def plain_contamination(docs, items):
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    wins = [(i, w[s : s + min(13, len(w))]) for i, t in items if (w := words(t)) for s in range(len(w) - min(13, len(w)) + 1)]
    out = {}
    for d, t in docs:
        w, hit, who = words(t), set(), set()
        for i, win in wins:
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit.update(range(s, s + len(win)))
                    who.update({str(i)} - {"None"})
        out[d] = (len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_contamination_of_odd_texts(spark, monkeypatch):
    long = [f"w{n}" for n in range(40)]
    items = [(1, " ".join(long[:30])), (2, "Short item"), (2, "w39"), (10, " ".join(long[5:20])), (3, None), (4, "--"), (None, "w1 w2")]
    docs = [(1, " ".join(long)), (2, "a SHORT, item! short item"), (3, None), (4, ""), (5, "x " * 500 + " ".join(long[2:15])), (6, " ".join(long[2:14])), (7, "w39 " + "y " * 30)]
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("n_hit", F.lit(1))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"words": F.lit(1), "fp": F.lit("z")})
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.contamination(d, b).collect()}
    assert got == plain_contamination(docs, items) and got[7][1] == 1 and got[1][2] == 3
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.contamination(d, b).collect()} == got
    assert {r["n_hit"] for r in decontam.contamination(d, b.limit(0)).collect()} == {0}
    assert decontam.contamination(d.limit(0), b).count() == 0


@pytest.mark.parametrize("span", range(1, 17))
def test_winnowing_shares_every_span(spark, span):
    k, w = decontam.parameters(span)
    assert k + w - 1 == span
    text = [f"t{n}" for n in range(span)]
    rows = [(0, text), (1, ["a", "b", *text, "c"]), (2, [*text, *"defghijklmn"])]
    got = {}
    for r in decontam.fingerprints(spark.createDataFrame(rows, "id int, words array<string>"), [span], ["id"]).collect():
        got.setdefault(r["id"], set()).add(r["fp"])
        assert dict(rows)[r["id"]][r["from"] : r["from"] + len(r["around"])] == r["around"]
    assert got[0] & got[1] and got[0] & got[2]


def plain_scan(text):
    """The whole rule, place by place."""
    w = WORD.findall((text or "").translate(LOWER))
    at = [(s, label) for p, label in licences.PHRASES for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
    starts, base = [s for s, _ in at], {x for _, x in at}
    labels, best, grams = set(base), 0.0, {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    for notice, label in licences.NOTICES:
        t = WORD.findall(notice.translate(LOWER))
        held = {}
        for p in range(len(t) - 2):
            for i in grams.get(tuple(t[p : p + 3]), ()):
                held.setdefault(i - p, set()).update(q for q in range(max(0, p - 4), min(len(t), p + 7)) if 0 <= i - p + q < len(w) and w[i - p + q] == t[q])
        strong, runs = sorted(d for d, h in held.items() if len(h) >= max(3, len(t) // 16)), []
        for d in strong:
            if not runs or d - runs[-1][-1] > min(8, len(t) // 10):
                runs.append([])
            runs[-1].append(d)
        half = max(len(t) // 8, 16)
        for run in runs:
            for first in range(run[0] - half, run[-1] + 1, half):
                got = set().union(*(held[d] for d in run if first <= d < first + 2 * half))
                if got and {q for q, x in enumerate(t) if x.isdigit()} <= got:
                    best = max(best, len(got) / len(t))
                    labels |= {label} if len(got) >= 0.8 * len(t) else set()
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if at else best


def scanned(r):
    return tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"))


def test_licences_are_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op6_licences(spark, data).collect()
    assert {r["doc_id"]: scanned(r) for r in got} == {r["doc_id"]: plain_scan(r["text"]) for r in docs}
    assert len(got) == len(docs) and len({r["labels"] for r in got}) >= 5


def test_licences_of_odd_texts(spark):
    isc = "Permission to use, copy, modify, and/or distribute this software for ANY purpose with or without fee is hereby granted"
    rows = [
        (1, isc), (2, isc.replace("distribute", "really distribute")), (3, isc[:60]), (4, None), (5, ""), (6, "MIT License mit license " * 3), (6, "MIT License mit license " * 3), (None, "the Apache license"), (8, "x " * 200_000 + "mit license"),
        (10, "licensed under an apache license version 2 0"), (11, "it is licensed under CC BY NC 4.0 now"), (12, "licensed under the GNU General Public License version 3"), (13, "this software"),
    ]
    rng = np.random.default_rng(13)
    for n, (text, _) in enumerate(x for x in licences.NOTICES if len(x[0]) > 400):  # whole licences with a copyright line, words changed, put in and left out
        w = text.split()
        for i in rng.integers(0, len(w), len(w) // 25):
            w[i] = rng.choice(["", "changed", f"{w[i]} and more"])
        rows += [(100 + n, "Some program\nCopyright someone\n" + text), (200 + n, " ".join(w))]
        w = text.split()
        parts = [" ".join(w[i : i + 12]) for i in range(0, len(w), 12)]
        rows.append((300 + n, " ".join(f"{p} " + "filler words " * int(k) for p, k in zip(rng.permutation(parts), rng.integers(0, 4, len(parts)), strict=True))))
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"label": F.lit(1), "pos": F.lit(2)})).collect()
    assert sorted(((r["doc_id"], scanned(r)) for r in got), key=str) == sorted(((i, plain_scan(t)) for i, t in rows), key=str)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["labels"] == "isc" and by[1]["score"] == 1 and by[2]["labels"] == "isc" and by[3]["labels"] == "" and 0 < by[3]["score"] < 0.8
    assert (by[6]["n_base"], by[6]["first_word"], by[6]["last_word"]) == (6, 0, 10) and by[None]["labels"] == "apache" and by[8]["first_word"] == 200_000
    assert by[10]["labels"] == "apache,apache-2.0" and by[11]["labels"] == "cc-by-nc-4.0" and "gpl-2.0" not in by[12]["labels"] and by[13]["score"] == 0
    # A licence's sentences in another order all over a long text are all there, but they don't stand as the licence has them (short headers hold
    # a whole notice in one of their sentences).
    assert all(label not in by[300 + n]["labels"].split(",") for n, (x, label) in enumerate(x for x in licences.NOTICES if len(x[0]) > 400) if len(x.split()) > 100)
    whole = [x for x in licences.NOTICES if len(x[0]) > 400]
    assert all(label in by[100 + n]["labels"].split(",") and label in by[200 + n]["labels"].split(",") for n, (_, label) in enumerate(whole))
    assert "bsd-2-clause" not in by[100 + [x for _, x in whole].index("bsd-3-clause")]["labels"]
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("hot", [10**6, 2])
def test_components_are_brute_force(spark, monkeypatch, hot):
    """Chains, stars and random links, also where every centre counts as hot; loops, repeats, null ends and no links at all."""
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rng = np.random.default_rng(8)
    edges = [(n, n + 1) for n in range(1000, 1060)] + [(2000, n) for n in range(2001, 2040)] + [(int(a), int(b)) for a, b in rng.integers(0, 150, (90, 2))] + [(7, 7), (1001, 1000), (1000, 1001)]
    frame = spark.createDataFrame([*edges, (None, 5), (5, None)], "a long, b long")
    ids = {n for e in edges if e[0] != e[1] for n in e}
    got = {r["node"]: r["component"] for r in connected_components(frame).collect()}
    assert got == components(ids, [e for e in edges if e[0] != e[1]])
    assert connected_components(frame.where("false")).count() == 0
