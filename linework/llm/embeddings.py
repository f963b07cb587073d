"""Embedding near-duplicates by randomised-rotation binary codes with correction factors."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linework.llm.common import checked_broadcast, join_hot
from linework.llm.components import connected_components
from linework.sources.scratch import save

THRESHOLD = 0.9
#: The chance that a pair at the threshold itself meets in a bucket; nearer pairs meet oftener.
RECALL = 0.995
#: Vectors that a bucket holds on average, and the most that one task compares with as many others.
BUCKET, BLOCK = 512, 2048
#: The confidence bound of an estimate, in its standard deviations.
BOUND = 6.0
#: Bits a dimension of a stored query code.
LEVELS = 4
#: Blocks with more pairs inside the bound than this a vector are dense: their vectors go to the pairs.
DENSE_PAIRS = 8
#: Places by hash that order the vectors of a bucket; blocks are runs of them.
SPOTS = 1 << 31
SEED = 20


def rotation(dims: int, n: int) -> np.ndarray:
    """The n-th random rotation of dims dimensions; the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dims, n]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a key, number of tables) for n vectors: a sign bit of two vectors is the same with
    the chance 1 - angle / pi."""
    bits = max(1, ceil(log2(max(2, n / BUCKET))))
    met = (1 - acos(threshold) / pi) ** bits
    return bits, max(1, ceil(log(1 - recall) / log(1 - met)))


def keys(unit: np.ndarray, bits: int, count: int) -> np.ndarray:
    """A key a table for each unit vector: bits signs of its rotations, as many as that takes."""
    dims = unit.shape[1]
    need = bits * count
    signs = np.hstack([unit @ rotation(dims, 1 + i).T > 0 for i in range(ceil(need / dims))])[:, :need] if len(unit) else np.zeros((0, need), bool)
    return signs.reshape(len(unit), count, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits (rows, dims) as 64-bit words, zeros behind."""
    gap = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, gap))), axis=1, bitorder="little").view("<u8")


def _stored(dims: int) -> np.dtype:
    words = ceil(dims / 64)
    return np.dtype([("code", "<u8", (words,)), ("planes", "<u8", (LEVELS, words)), ("factor", "<f4"), ("low", "<f4"), ("step", "<f4"), ("total", "<i4")])


def encode(unit: np.ndarray) -> np.ndarray:
    """What is stored of unit vectors: their binary codes with correction factors, and their query codes.

    The code has the signs of the rotated vector, the factor is <signs / sqrt(dims), vector>.  The
    query code has the rotated vector itself, LEVELS bits a dimension from low in steps, as bit
    planes, and the total of its levels; rounding up or down is random in proportion, so that it adds no bias.
    """
    dims = unit.shape[1]
    turned = unit @ rotation(dims, 0).T
    out = np.zeros(len(unit), _stored(dims))
    out["code"] = _packed(turned > 0)
    out["factor"] = np.abs(turned).sum(axis=1) / np.sqrt(dims)
    out["low"] = turned.min(axis=1)
    out["step"] = np.maximum((turned.max(axis=1) - out["low"]) / (2**LEVELS - 1), 1e-12)
    dither = np.random.default_rng([SEED, dims]).random(dims)
    level = np.clip(np.floor((turned - out["low"][:, None]) / out["step"][:, None] + dither), 0, 2**LEVELS - 1).astype(np.uint8)
    out["planes"] = np.stack([_packed((level >> b & 1).astype(bool)) for b in range(LEVELS)], axis=1)
    out["total"] = level.sum(axis=1)
    return out


def maybe_near(a: np.ndarray, b: np.ndarray, dims: int, threshold: float) -> np.ndarray:
    """Pairs (row of a, row of b) whose inner product may reach threshold, by a's codes and b's query codes.

    <code, q> / <code, x> estimates <x, q> without bias.  <code, q> is a sum of bit counts: each
    plane of q under the code.  The deviation is at most sqrt(1 - f * f) / f / sqrt(dims - 1), f the
    factor, and half a step over f for the rounding of q.  Pairs whose upper bound lies below are settled.
    """
    ones = np.bitwise_count(a["code"]).sum(axis=1, dtype=np.int64)
    under = np.zeros((len(a), len(b)), np.int64)
    for word in range(a["code"].shape[1]):
        for plane in range(LEVELS):
            under += np.bitwise_count(a["code"][:, word, None] & b["planes"][None, :, plane, word]).astype(np.int64) << plane
    inner = b["low"] * (2 * ones[:, None] - dims) + b["step"] * (2 * under - b["total"])
    factor = a["factor"][:, None].astype(np.float64)
    spread = BOUND / factor * np.sqrt(np.maximum(0, 1 - factor**2) / max(1, dims - 1) + (b["step"] / 2) ** 2)
    return inner / np.sqrt(dims) / factor + spread >= threshold


def _to_bytes(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Each vector's components as bytes; null for those that link with nothing."""
    for batch in batches:
        lists = batch.column(1)
        ends = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False).astype(kind) + 0  # + 0: no -0; nulls are nan
        good = np.isfinite(flat)
        out = []
        for n, known in enumerate(lists.is_valid().to_pylist()):
            part = slice(ends[n], ends[n + 1])
            out.append(flat[part].tobytes() if known and good[part].all() and flat[part].any() else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "raw"])


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision; the largest component scales first, so nothing overflows."""
    a = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    a = a / np.abs(a).max(axis=1, keepdims=True)
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def _by_width(raws: list[bytes], most: int = 512) -> Iterator[tuple[int, np.ndarray]]:
    """(width, rows) of up to most vectors of one width each."""
    widths = np.array([len(r) for r in raws], np.int32)
    for width in np.unique(widths):
        some = np.flatnonzero(widths == width)
        for at in range(0, len(some), most):
            yield int(width), some[at : at + most]


def _coder(kind: str):
    """Rows (sha, n, raw, least) with what is stored of their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            for _, take in _by_width(raws):
                code = pa.array([x.tobytes() for x in encode(_units([raws[i] for i in take], kind))], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(take)) for c in batch.columns), code], [*batch.schema.names, "code"])

    return run


def _dealer(bits: int, count: int, kind: str):
    """Rows (raw, ...) to a row (width, tab, key, ...) for each table that a vector enters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(0).to_pylist()
            for width, take in _by_width(raws):
                found = keys(_units([raws[i] for i in take], kind), bits, count)
                again = pa.array(np.repeat(take, count))
                place = [pa.array(np.full(found.size, width, np.int32)), pa.array(np.tile(np.arange(count, dtype=np.int32), len(take))), pa.array(found.ravel())]
                yield pa.RecordBatch.from_arrays([*place, *(c.take(again) for c in batch.columns[1:])], ["width", "tab", "key", *batch.schema.names[1:]])

    return run


_PLACE = ["width", "tab", "key", "p", "q"]


def _place_of(key: tuple) -> list:
    return [k.as_py() for k in key[: len(_PLACE)]]


def _sides(block: np.ndarray, p: int, q: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the blocks p and q, in order."""
    block = block[order]
    return order[block == p], order[block == q]


def _filter(kind: str, threshold: float):
    """Codes of a pair of blocks to the pairs inside the bound, or one row that says that these are many."""

    def run(key: tuple, batch: pa.Table) -> pa.Table:
        width, tab, bucket, p, q = _place_of(key)
        dims = width // np.dtype(kind).itemsize
        cid, block = batch.column("cid").to_numpy(), batch.column("block").to_numpy()
        stored = np.frombuffer(b"".join(batch.column("code").to_pylist()), _stored(dims))
        left, right = _sides(block, p, q, np.lexsort((cid, batch.column("spot").to_numpy())))
        near = maybe_near(stored[left], stored[right], dims, threshold)
        if p == q:
            near = np.triu(near, 1)  # of two vectors the one with the lesser spot gives the code, in every table
        many = int(near.sum()) > DENSE_PAIRS * len(cid)
        i, j = (np.zeros(1, np.int64),) * 2 if many else np.nonzero(near)
        place = {n: pa.array(np.full(len(i), v), t) for n, v, t in zip(_PLACE, (width, tab, bucket, p, q), (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)}
        null = pa.nulls(1, pa.int64())
        return pa.table(place | {"a": null if many else pa.array(cid[left[i]]), "b": null if many else pa.array(cid[right[j]])})

    return run


def _linked(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, tab: np.ndarray, bits: int, count: int, threshold: float) -> np.ndarray:
    """Which of the pairs (row i of a, row j of b) link, in double precision, and meet first in the table tab."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 65536):
        part = slice(at, at + 65536)
        out[part] = np.einsum("ij,ij->i", a[i[part]], b[j[part]]) >= threshold
    if out.any():
        some = np.flatnonzero(out)
        ai, aj = np.unique(i[some], return_inverse=True)
        bi, bj = np.unique(j[some], return_inverse=True)
        ka, kb = keys(a[ai], bits, count), keys(b[bi], bits, count)
        for at in range(0, len(some), 65536):
            part = slice(at, at + 65536)
            met = ka[aj[part]] == kb[bj[part]]
            out[some[part]] = met.argmax(axis=1) == tab[some[part]]
    return out


def _exact_pairs(bits: int, count: int, kind: str, threshold: float):
    """Pairs with their vectors to those that link, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, tab = batch.column("raw_a").to_pylist(), batch.column("tab").to_numpy()
            others = batch.column("raw_b").to_pylist()
            for _, take in _by_width(raws, 4096):
                a, b = (_units([r[i] for i in take], kind) for r in (raws, others))
                at = np.arange(len(take))
                good = pa.array(take[_linked(a, b, at, at, tab[take], bits, count, threshold)])
                yield pa.RecordBatch.from_pydict({n: batch.column(n).take(good) for n in ("a", "b", "na", "nb")})

    return run


def _exact_blocks(bits: int, count: int, kind: str, threshold: float):
    """Vectors of a dense pair of blocks: links a vector has here, and edges that connect the block."""

    def run(key: tuple, batch: pa.Table) -> pa.Table:
        _, tab, _, p, q = _place_of(key)
        cid, block, weight = (batch.column(n).to_numpy() for n in ("cid", "block", "n"))
        unit = _units(batch.column("raw").to_pylist(), kind)
        left, right = _sides(block, p, q, np.arange(len(cid)))
        i, j = np.triu_indices(len(left), 1) if p == q else (x.ravel() for x in np.indices((len(left), len(right))))
        near = np.flatnonzero((unit[left] @ unit[right].T)[i, j] >= threshold - 1e-9)  # those in question
        i, j = i[near], j[near]
        met = _linked(unit[left], unit[right], i, j, np.full(len(i), tab), bits, count, threshold)
        i, j = left[i[met]], right[j[met]]
        links = np.bincount(i, weight[j], len(cid)) + np.bincount(j, weight[i], len(cid))
        root = np.arange(len(cid))
        while len(i):  # the least row reachable inside these blocks
            least = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, i, least)
            np.minimum.at(root, j, least)
            root = root[root]
            if (root == before).all():
                break
        some = links > 0
        return pa.table({"cid": cid[some], "links": links[some].astype(np.int64), "root": cid[root[some]]})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, n_links, component_id, kept) per row of vectors.

    Equal vectors become one class with a count first, told apart by SHA-256.  Each class's binary
    code, correction factor and query code are computed and stored once (56 bytes for 64 dimensions).  Classes meet in buckets of
    sign bits of random rotations; the bits grow with the number of classes, so buckets don't, and
    the number of tables gives RECALL at the threshold.  Buckets get ids and codes, no vectors: codes
    estimate each inner product, and only pairs whose confidence bound reaches the threshold are
    computed, in double precision, and those decide.  A pair counts in the first table where it meets.

    A bucket of more than BLOCK classes is compared as pairs of blocks, in tasks of their own.  Pairs
    inside the bound are joined with their vectors; where a pair of blocks has more than
    DENSE_PAIRS a vector of them, its vectors are sent to one task instead, which gives counts and a
    component's least member for each class, never pairs.  In a group of n distinct vectors that are
    all near each other the links are n * n, and so is that work.

    Null vectors, zero ones and those with a null or non-finite component link with nothing, as do
    vectors of different lengths with each other.  Rows with a repeated id and equal vectors count
    as vectors of their own; an empty table gives none; other columns are ignored, so their names
    can't clash.  component_id is the least id reachable.
    """
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    values = F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>")
    slim = vectors.select(F.col(id_col).alias("id"), values.alias("v"))
    schema = T.StructType([T.StructField("id", slim.schema["id"].dataType), T.StructField("raw", T.BinaryType())])
    rows = slim.mapInArrow(lambda batches: _to_bytes(batches, kind), schema)
    rows = save(rows.withColumn("sha", F.unhex(F.sha2("raw", 256))), "vectors")
    grouped = rows.where("sha is not null").groupBy("sha").agg(F.count("*").alias("n"), F.first("raw").alias("raw"), F.min("id").alias("least"))
    coded = grouped.select("sha", "n", "raw", "least").mapInArrow(_coder(kind), T.StructType([*grouped.select("sha", "n", "raw", "least").schema.fields, T.StructField("code", T.BinaryType())]))
    classes = save(coded.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    size = classes.agg(F.count("*"), F.sum("n")).first()
    bits, count = tables(size[0], threshold)
    deal = lambda *more: classes.select("raw", "cid", *more).mapInArrow(_dealer(bits, count, kind), ", ".join(["width int, tab int, key long, cid long", *(f"{c} binary" for c in more)]))
    sizes = deal().groupBy("width", "tab", "key").agg(F.count("*").alias("held")).where("held > 1")
    shared = save(sizes.withColumn("blocks", F.ceil(F.col("held") / BLOCK).cast("int")).drop("held"), "vector-buckets")
    shared = checked_broadcast(shared, 32)

    def spread(*more: str) -> DataFrame:
        """Classes in buckets of two or more, once for each pair of blocks that theirs is in."""
        placed = deal(*more).join(shared, ["width", "tab", "key"]).withColumn("spot", F.pmod(F.xxhash64("cid"), F.lit(SPOTS)))
        placed = placed.withColumn("block", F.floor(F.col("spot") * F.col("blocks") / SPOTS).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return placed.select("width", "tab", "key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "spot", "cid", *more)

    place = "width int, tab int, key long, p int, q int"
    found = save(spread("code").groupBy(*_PLACE).applyInArrow(_filter(kind, threshold), f"{place}, a long, b long"), "vector-candidates")
    held = classes.select("cid", "n", "raw")
    side = lambda s: held.select(F.col("cid").alias(s), F.col("n").alias(f"n{s}"), F.col("raw").alias(f"raw_{s}"))
    pairs = found.where("a is not null").groupBy("a", "b").agg(F.min("tab").alias("tab"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    pairs = save(pairs.mapInArrow(_exact_pairs(bits, count, kind, threshold), "a long, b long, na long, nb long"), "vector-pairs")
    dense = spread().join(found.where("a is null").select(*_PLACE), _PLACE).join(held, "cid")
    dense = save(dense.groupBy(*_PLACE).applyInArrow(_exact_blocks(bits, count, kind, threshold), "cid long, links long, root long"), "vector-links")
    both = F.explode(F.array(F.struct(F.col("a").alias("cid"), F.col("nb").alias("links")), F.struct(F.col("b").alias("cid"), F.col("na").alias("links")))).alias("x")
    links = dense.select("cid", "links").union(pairs.select(both).select("x.*")).groupBy("cid").agg(F.sum("links").alias("links"))
    roots = connected_components(dense.select("cid", "root").union(pairs.select("a", "b")))
    placed = classes.select("cid", "sha", "n", "least").join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    placed = save(placed.select("sha", "n", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("root")), "vector-placed")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = save(join_hot(placed.withColumnRenamed("n", "rows"), named, "root", size[0]).select("sha", F.col("rows").alias("n"), "n_links", "component_id"), "vector-named")
    plain = rows.where("sha is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = join_hot(rows.where("sha is not null").select("id", "sha"), named, "sha", size[1] or 0, 96).select("id", "n_links", "component_id").union(plain)
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))).withColumnRenamed("id", id_col)
