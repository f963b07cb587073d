"""SimHash near-duplicates: pigeonhole blocks find the candidates, Hamming distance decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linework.llm.common import join_hot, runs_of, small_batches
from linework.sources.scratch import save
from linework.llm.components import connected_components

SEED = 42
SHINGLE = 3
DISTANCE = 2
#: Four blocks of 16 bits; two of them survive any two flipped bits.
BLOCKS = 4
#: Buckets of more distinct fingerprints than this take the neighbourhood way, which is linear.
HOT_BUCKET = 256
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash: a bit is set if it is set in over half of the shingle hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    counts, total, digest = np.zeros(64, np.int64), 0, xxhash.xxh64_intdigest
    hashes = [digest(g, SEED) for g in grams]
    for at in range(0, len(hashes), CHUNK):
        part = np.array(hashes[at : at + CHUNK], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(part)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, stop in runs_of(batch.column(1)):
            part = batch.slice(at, stop - at)
            fps = pa.array([fingerprint(t.as_py()) for t in part.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), fps], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per row of docs.  A null or wordless text has fingerprint 0."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", slim.schema["id"].dataType), T.StructField("fp", T.LongType())])
    return small_batches(slim).mapInArrow(_fingerprints, schema)


def _block(fp, i: int):
    return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long"))


def links(fps: DataFrame) -> DataFrame:
    """(u, v) edges between distinct fingerprints whose closure is that of all pairs at 2 or fewer bits.

    Each fingerprint enters six buckets, one for each two of its four blocks.  In buckets of up to
    HOT_BUCKET members all pairs are compared.  Members of larger buckets also group by each value
    at one bit or less from them: two fingerprints are at two bits or less exactly if they share
    such a value, at most 65 share one, and so this way is exact and linear.
    """
    fp = F.col("fp")
    pairs = [(a, b) for a in range(BLOCKS) for b in range(a + 1, BLOCKS)]
    keys = F.explode(F.array(*(F.struct(F.lit(n).alias("combo"), (_block(fp, a) * 65536 + _block(fp, b)).alias("key")) for n, (a, b) in enumerate(pairs))))
    rows = fps.select("fp", keys.alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = save(join_hot(rows, sizes, "bucket", len(pairs) * fps.count()).select("fp", "bucket.*", "n"), "simhash-buckets")
    small = shared.where(F.col("n") <= HOT_BUCKET)
    other = small.select("combo", "key", F.col("fp").alias("v"))
    near = small.withColumnRenamed("fp", "u").join(other, ["combo", "key"]).where("u > v").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE).select("u", "v")
    hot = shared.where(F.col("n") > HOT_BUCKET).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(64)))
    around = hot.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("value"))
    met = around.groupBy("value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    star = met.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).where("u <> v").select("u", "v")
    return near.union(star)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id, kept) per row of docs.

    component_id is the smallest id reachable over links of two or fewer differing bits; kept marks
    the rows with that id.  Copies share a fingerprint and cost one link at most.  Null and empty
    texts have fingerprint 0 and link like any other; null ids never become a component's id, and
    a component of null ids alone has a null one.  Repeated rows each appear.  Other columns of
    docs are ignored, so their names can't clash.
    """
    hashed = save(fingerprints(docs, id_col, text_col), "simhash")
    distinct = save(hashed.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    total, held = distinct.agg(F.sum("n"), F.count("*")).first()
    roots = connected_components(links(distinct.select("fp")))
    placed = save(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.col("n").alias("rows"), F.coalesce("component", "fp").alias("root")), "simhash-roots")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    classes = save(join_hot(placed, named, "root", held).select("fp", "component_id", F.col("rows").alias("n")), "simhash-classes")
    out = join_hot(hashed, classes, "fp", total or 0).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
