"""Sheets as they arrive: the document plan over a stream of page files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from linework.plans.extract import extract_document
from linework.sources.scratch import remove, save, temporary
from linework.sources.sheets import PAGE_JSON, flatten_pages

SCHEMA = f"doc_id string, page int, version long, width double, height double, {PAGE_JSON}, drawings array<array<double>>"
#: Parts of the target that are written again by themselves.
BUCKETS = 64


def extract_batch(pages: DataFrame) -> DataFrame:
    """Exported dimensions of whole pages (SCHEMA)."""
    d = pages.select("doc_id", "page", F.posexplode("drawings").alias("seq", "b"))
    drawings = d.select("doc_id", "page", F.col("seq").cast("long").alias("seq"), *(F.get("b", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))
    return extract_document(flatten_pages(pages), drawings, pages.select("doc_id", "page", "width", "height"))


def _newest(pages: DataFrame) -> DataFrame:
    """One row for each page: that of the highest version, of equal ones the first by content."""
    best = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc_nulls_last("version"), F.xxhash64("width", "height", F.to_json(F.struct("blocks", "drawings")))))
    return pages.withColumn("nth", best).where("nth = 1").drop("nth")


def _in(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table under path, or an empty one of that schema where nothing stands yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def merge_batch(batch: DataFrame, target: str) -> None:
    """Bring pages (SCHEMA) into the dimensions under target/records, where each page stands once.

    What has been seen of each page, its version, stands under target/pages.  A page with a version
    that is not higher than that is late and dropped; a newer one takes the place of the page's dimensions.
    Both tables are dealt into BUCKETS by page, and only the buckets of the batch's pages are written
    again, records first: a batch that is run again after a failure finds its versions unwritten, or
    everything in place.
    """
    spark = batch.sparkSession
    with temporary(spark):
        bucket = F.pmod(F.xxhash64("doc_id", "page"), F.lit(BUCKETS)).cast("int")
        seen_schema = batch.select("doc_id", "page", "version").withColumn("bucket", bucket).schema
        seen = _in(spark, f"{target}/pages", seen_schema)
        fresh = _newest(batch).withColumn("bucket", bucket)
        old = seen.select("doc_id", "page", F.col("version").alias("had"), F.lit(True).alias("known"))
        fresh = fresh.join(old, ["doc_id", "page"], "left").where("known is null or (version is not null and (had is null or version > had))").drop("had", "known")
        fresh = save(fresh, "fresh-pages")
        touched = fresh.select("bucket").distinct()
        if touched.isEmpty():
            return
        found = extract_batch(fresh.drop("version", "bucket")).withColumn("bucket", bucket)
        records = _in(spark, f"{target}/records", found.schema)

        def merged(rows: DataFrame, new: DataFrame, name: str) -> DataFrame:
            kept = rows.join(F.broadcast(touched), "bucket", "left_semi").join(fresh.select("doc_id", "page"), ["doc_id", "page"], "left_anti")  # BUCKETS rows at most
            return save(kept.select(*new.columns).union(new), name)

        empty = touched.select("bucket").collect()  # BUCKETS numbers at most
        for name, rows, new in (("records", records, found), ("pages", seen, fresh.select("doc_id", "page", "version", "bucket"))):
            out = merged(rows, new, name)
            out.write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{target}/{name}")
            held = {r["bucket"] for r in out.select("bucket").distinct().collect()}
            remove(spark, *(f"{target}/{name}/bucket={r['bucket']}" for r in empty if r["bucket"] not in held))


def stream_pages(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the dimensions of all page files under source in Parquet under target/records, the newest version of each page.

    A page stands in one row, so a micro-batch is complete in itself.  A page without a version has the time its file
    was written.  The tables between a batch's steps are removed with it.
    """
    written = (F.unix_micros("_metadata.file_modification_time")).cast("long")
    stream = spark.readStream.schema(SCHEMA).json(source).withColumn("version", F.coalesce("version", written))
    return stream.writeStream.foreachBatch(lambda batch, _: merge_batch(batch, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_per_client(requests: DataFrame, gap: str = "60 milliseconds") -> DataFrame:
    """The last pointer position of each burst of a client: session windows of gap, newest request_id wins.

    requests: client, ts, request_id, x, y; batch or stream (with a watermark on ts).
    """
    return requests.groupBy("client", F.session_window("ts", gap).alias("burst")).agg(F.max_by(F.struct("request_id", "x", "y"), "request_id").alias("last")).select("client", "last.*")
