"""Reading sheets and writing results."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHAR = "struct<c:string,bbox:array<double>>"
#: A page as text extractors give it: blocks of lines of spans of characters.
PAGE_JSON = f"blocks array<struct<type:int,lines:array<struct<spans:array<struct<font:string,size:double,chars:array<{CHAR}>>>>>>>"
LEAST_BYTES = 64
#: Units about a point that are looked at (fixed values).
LEAST_RADIUS, MOST_RADIUS, DEFAULT_RADIUS = 2.0, 80.0, 24.0


def flatten_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page, seq, char, x0..y1, font, size) of pages(doc_id, page, blocks).

    Blocks of other types than text and characters of white space alone are left out; seq numbers
    a page's remaining characters from 1 in the order of the file.
    """
    at = []
    rows = pages.select("doc_id", "page", "blocks")
    for name, array in (("block", "blocks"), ("line", "block.lines"), ("span", "line.spans"), ("ch", "span.chars")):
        at.append(f"{name}_at")
        held = [c for c in rows.columns if c in ("doc_id", "page", "span", *at)]
        rows = rows.select(*held, F.posexplode(array).alias(f"{name}_at", name))
        if name == "block":
            rows = rows.where("block.type = 0")
    rows = rows.where(~F.col("ch.c").rlike(r"^[\s\p{Z}]*$"))
    order = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(*at)).cast("long")
    box = [F.get("ch.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return rows.select("doc_id", "page", order.alias("seq"), F.col("ch.c").alias("char"), *box, F.coalesce("span.font", F.lit("")).alias("font"), F.coalesce("span.size", F.lit(0.0)).alias("size"))


def read_page_json(spark: SparkSession, path: str) -> DataFrame:
    """Glyphs of JSON lines with doc_id, page and blocks."""
    return flatten_pages(spark.read.schema(f"doc_id string, page int, {PAGE_JSON}").json(path))


def read_uploads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) files under path: accepted are .pdf files of 64 bytes or more, with their content."""
    files = spark.read.format("binaryFile").load(path)
    named = F.lower("path").endswith(".pdf")
    reason = F.when(~named, "not a pdf").when(F.col("length") < LEAST_BYTES, "too small")
    files = files.withColumn("reason", reason)
    return files.where("reason is null").select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("doc_id"), "path", "length", "content"), files.where("reason is not null").select("path", "length", "reason")


def page_info(sheets: DataFrame, doc_id, page: int) -> DataFrame:
    """A page's width and height; a ValueError if the document has no such page."""
    found = sheets.where((F.col("doc_id") == doc_id) & (F.col("page") == page)).select("width", "height")
    if found.isEmpty():
        raise ValueError(f"no page {page} in document {doc_id}")
    return found


def write_json(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines in export order; an infinite distance is null, as JSON has no infinity."""
    keys = [c for c in ("doc_id", "page", "region_id", "seq") if c in records.columns]
    finite = records.withColumn("distance", F.when(F.col("distance") < float("inf"), F.col("distance")))
    finite.sortWithinPartitions(*keys).write.mode(mode).json(path)


def check_points(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) snap points: a radius is over LEAST_RADIUS and at most MOST_RADIUS units, a null one is the usual
    DEFAULT_RADIUS; refused ones have a reason."""
    radius = F.coalesce("radius", F.lit(DEFAULT_RADIUS))
    reason = F.when(F.col("x").isNull() | F.col("y").isNull(), "no place").when(F.isnan(radius) | (radius <= LEAST_RADIUS) | (radius > MOST_RADIUS), "radius out of range")
    p = points.withColumns({"radius": radius, "reason": reason})
    return p.where("reason is null").drop("reason"), p.where("reason is not null")


def _claim(spark: SparkSession, path: str) -> bool:
    """Create a file that nobody else has created: true for exactly one of all who try.

    Stores with an exclusive create (HDFS and its like) decide it themselves; for local files it is the
    operating system's.
    """
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    fs.mkdirs(p.getParent())
    try:
        if fs.getUri().getScheme() == "file":
            folder = jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.String, 0))
            jvm.java.nio.file.Files.createFile(folder, spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
        else:
            fs.create(p, False).close()
    except Py4JJavaError as e:
        if fs.exists(p):
            return False
        raise e from None
    return True


def write_versioned(records: DataFrame, path: str) -> str:
    """Write to the first version of path/v=1, path/v=2, ... that nobody has claimed, and return it.

    A version is claimed by a file under path/_claims that only one writer can create; its rows are written under
    path/_parts and appear under their version by one rename.  So two writers at once get two versions, one that
    is killed leaves none half visible (its number stays unused), and earlier versions stay as they are.
    """
    spark = records.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    fs, n = at("v=1").getFileSystem(conf), 1
    while fs.exists(at(f"v={n}")) or not _claim(spark, f"{path}/_claims/v={n}"):
        n += 1
    part = f"_parts/{uuid.uuid4().hex}"
    try:
        write_json(records, f"{path}/{part}", mode="errorifexists")
        if not fs.rename(at(part), at(f"v={n}")):
            raise OSError(f"could not publish {path}/v={n}")
    finally:
        fs.delete(at(part), True)
    return f"{path}/v={n}"
