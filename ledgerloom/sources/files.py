"""Documents from a folder of files of several kinds: each file's rows, or a row that says why it has none.

Files are read by Spark's reader and told apart by their suffix; a broken, unknown or missing one costs its own rows only. JSON files
hold document sets, text files pages of lines (a form feed ends a page). Both lists come from one pass that keeps a file's
outcome beside it, so nothing is opened twice and nothing is looped over on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.spans import DOCUMENT_SET

# The geometry of laid out text (A4 at 200 dpi): margin, line and character.
MARGIN, LINE, CHAR, WIDTH, HEIGHT = 150.0, 44.0, 15.0, 1654.0, 2339.0


@dataclass(frozen=True)
class Loaded:
    """``sets``: (path, packet_id, documents) of the files that could be read; ``errors``: (path, reason, detail) of the others."""

    sets: DataFrame
    errors: DataFrame


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+\z", 0))


def text_pages(text: Column) -> Column:
    """Pages of a text file as those of a document set: lines below one another, their order kept, blank lines left out."""
    page_type = "array<struct<number:int,width:double,height:double,extraction_method:string,ocr_reason:string,duration_s:double,spans:array<struct<text:string,bbox:struct<x1:double,y1:double,x2:double,y2:double>,confidence:double,source:string,order:int,table:struct<table_index:int,row:int,col:int>,synthetic_bbox:boolean>>>>"

    def span(line: Column, i: Column) -> Column:
        top = F.lit(MARGIN) + i * F.lit(LINE)
        box = F.struct(F.lit(MARGIN).alias("x1"), top.alias("y1"), (F.lit(MARGIN) + CHAR * F.length(line)).alias("x2"), (top + LINE).alias("y2"))
        none = F.lit(None).cast("struct<table_index:int,row:int,col:int>")
        return F.struct(line.alias("text"), box.alias("bbox"), F.lit(1.0).alias("confidence"), F.lit("text").alias("source"), i.alias("order"), none.alias("table"), F.lit(True).alias("synthetic_bbox"))

    def page(own: Column, i: Column) -> Column:
        lines = F.filter(F.transform(F.split(own, r"\r\n|\r|\n"), span), lambda s: F.btrim(s["text"]) != "")
        return F.struct((i + 1).alias("number"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit("text").alias("extraction_method"), F.lit(None).cast("string").alias("ocr_reason"), F.lit(None).cast("double").alias("duration_s"), lines.alias("spans"))

    return F.transform(F.split(text, "\f"), page).cast(page_type)


def load(spark: SparkSession, folder: str, wanted: DataFrame | None = None, *, recursive: bool = False, skip_unsupported: bool = True) -> Loaded:
    """The files of ``folder`` (of this level only unless ``recursive``), or those that ``wanted`` (name, the path below the folder) names.

    Reasons: missing (wanted, but not there), unsupported (its suffix), broken (no UTF-8, or no document set). With ``skip_unsupported``
    off an unsupported file is an error of the whole. Files of several documents keep their order. Spark's reader passes over files of
    no bytes: they have no rows, and a wanted one counts as missing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    files = files.select(F.substring_index(F.col("path"), root, -1).alias("name"), "path", F.col("content").cast("string").alias("text"))
    if wanted is not None:
        files = wanted.select(F.col("name")).distinct().join(files, "name", "left")
    files = files.withColumn("path", F.coalesce("path", "name")).withColumn("suffix", suffix(F.col("path")))
    sets = F.from_json("text", DOCUMENT_SET + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    files = files.withColumn("valid", F.is_valid_utf8("text")).withColumn("json", F.when(F.col("valid") & (F.col("suffix") == ".json"), sets))
    reason = (
        F.when(F.col("text").isNull(), "missing").when(~F.col("suffix").isin(".json", ".txt"), "unsupported").when(~F.col("valid"), "broken")
        .when((F.col("suffix") == ".json") & (F.col("json._corrupt_record").isNotNull() | F.col("json.documents").isNull()), "broken")
    )
    told = files.withColumn("reason", reason)
    detail = F.when(F.col("reason") == "unsupported", F.concat(F.lit("no reader for "), F.when(F.col("suffix") == "", "a file without suffix").otherwise(F.col("suffix")))).when(
        F.col("reason") == "broken", F.when(~F.col("valid"), "not UTF-8").otherwise("not a document set")
    )
    errors = told.where("reason is not null").select("path", "reason", detail.alias("detail"))
    if not skip_unsupported and (bad := errors.where("reason = 'unsupported'").select("path").limit(3).collect()):
        raise ValueError(f"unsupported files: {[r['path'] for r in bad]}")
    read = told.where("reason is null")
    kind = read.schema["json"].dataType["documents"].dataType
    document = F.array(F.struct(F.col("path"), F.lit(None).cast("string").alias("doc_type"), F.lit(None).cast("map<string,string>").alias("metadata"), text_pages(F.col("text")).alias("pages"))).cast(kind)
    is_text = F.col("suffix") == ".txt"
    own = read.select("path", F.when(is_text, F.col("name")).otherwise(F.col("json.packet_id")).alias("packet_id"), F.when(is_text, document).otherwise(F.col("json.documents")).alias("documents"))
    return Loaded(own, errors)
