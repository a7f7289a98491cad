"""Document sets as JSON (the output of an OCR or text-layer producer) to flat span and page tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
SPAN = f"struct<text:string,bbox:{BOX},confidence:double,source:string,order:int,table:struct<table_index:int,row:int,col:int>,synthetic_bbox:boolean>"
PAGE = f"struct<number:int,width:double,height:double,extraction_method:string,ocr_reason:string,duration_s:double,spans:array<{SPAN}>>"
DOCUMENT_SET = f"packet_id string, documents array<struct<path:string,doc_type:string,metadata:map<string,string>,pages:array<{PAGE}>>>"
SUFFIXES = (".pdf", ".docx", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")


def read_document_sets(spark: SparkSession, path: str) -> DataFrame:
    """One row per packet; missing keys are null, broken files end up in _corrupt_record."""
    return spark.read.schema(DOCUMENT_SET + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def spans(sets: DataFrame) -> DataFrame:
    """One row per span; the geometry is flat, so column pruning and pushdown work on it. Documents are numbered inside
    their packet, and ``span_id`` is unique inside it (up to two million pages and spans a page)."""
    pages = sets.select("packet_id", F.posexplode("documents").alias("doc_id", "d")).select("packet_id", "doc_id", "d.path", "d.doc_type", F.explode("d.pages").alias("p"))
    rows = pages.select("packet_id", "doc_id", "path", "doc_type", F.col("p.number").alias("page"), F.posexplode("p.spans").alias("at", "s"))
    span_id = F.col("doc_id").cast("long") * (1 << 42) + F.col("page").cast("long") * (1 << 21) + F.col("at")
    return rows.select(
        "packet_id", "doc_id", "path", "doc_type", "page", span_id.alias("span_id"), F.coalesce("s.order", "at").alias("order"), "s.text", "s.bbox.x1", "s.bbox.y1", "s.bbox.x2", "s.bbox.y2",
        F.coalesce("s.confidence", F.lit(1.0)).alias("confidence"), F.coalesce("s.source", F.lit("ocr")).alias("source"), "s.table", F.coalesce("s.synthetic_bbox", F.lit(False)).alias("synthetic_bbox"),
    )


def drop_unsure(found: DataFrame, least: float = 0.30) -> DataFrame:
    """Blank texts and spans below the confidence go."""
    return found.where((F.btrim("text") != "") & (F.col("confidence") >= least))


def pages(sets: DataFrame) -> DataFrame:
    """One row per page: its size, how it was read, why by OCR and how long that took."""
    docs = sets.select("packet_id", F.posexplode("documents").alias("doc_id", "d")).select("packet_id", "doc_id", F.explode("d.pages").alias("p"))
    return docs.select("packet_id", "doc_id", F.col("p.number").alias("page"), "p.width", "p.height", "p.extraction_method", "p.ocr_reason", "p.duration_s")


def documents(sets: DataFrame) -> DataFrame:
    """One row per document, also without pages: path, type and metadata."""
    return sets.select("packet_id", F.posexplode("documents").alias("doc_id", "d")).select("packet_id", "doc_id", "d.path", "d.doc_type", "d.metadata")


def to_document_sets(flat: DataFrame, of_pages: DataFrame | None = None, of_documents: DataFrame | None = None) -> DataFrame:
    """Back to one row per packet, coordinates rounded to 2 and confidences to 4 places. With the tables of ``pages`` and
    ``documents`` nothing is lost, also pages and documents without spans; without them they are those that have spans."""
    box = F.struct(*[F.bround(c, 2).alias(c) for c in ("x1", "y1", "x2", "y2")]).alias("bbox")
    span = F.struct("order", "text", box, F.bround("confidence", 4).alias("confidence"), "source", "table", "synthetic_bbox")
    own = flat.groupBy("packet_id", "doc_id", "path", "page").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    more = ["width", "height", "extraction_method", "ocr_reason", "duration_s"]
    if of_pages is not None:
        paths = flat.groupBy("packet_id", "doc_id").agg(F.min("path").alias("path"))
        own = of_pages.join(own.drop("path"), ["packet_id", "doc_id", "page"], "left").join(paths, ["packet_id", "doc_id"], "left")
        own = own.withColumn("spans", F.coalesce("spans", F.array().cast(own.schema["spans"].dataType)))
    page = F.struct(F.col("page").alias("number"), "spans", *(more if of_pages is not None else []))
    docs = own.groupBy("packet_id", "doc_id", "path").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    names = ["doc_id", "path", "pages"]
    if of_documents is not None:
        docs = of_documents.join(docs.drop("path"), ["packet_id", "doc_id"], "left")
        docs = docs.withColumn("pages", F.coalesce("pages", F.array().cast(docs.schema["pages"].dataType)))
        names += ["doc_type", "metadata"]
    # Maps have no order, so documents are sorted by their number alone.
    by_number = lambda a, b: F.when(a["doc_id"] < b["doc_id"], -1).when(a["doc_id"] > b["doc_id"], 1).otherwise(0)
    return docs.groupBy("packet_id").agg(F.array_sort(F.collect_list(F.struct(*names)), by_number).alias("documents"))


def document_set_json(sets: DataFrame) -> DataFrame:
    """(packet_id, body): each set as JSON with counts and times of set, documents and pages, and boxes as lists. Coordinates
    and sizes have 2 places, times 3, confidences 4; a missing table, reason or invented box is left out."""
    def span(s: Column, d: Column, p: Column) -> Column:
        box = F.array(*[F.bround(s["bbox"][c], 2) for c in ("x1", "y1", "x2", "y2")])
        return F.struct(
            s["text"].alias("text"), p["number"].alias("page"), box.alias("bbox"), name_of(d).alias("source_document"), F.bround(F.coalesce(s["confidence"], F.lit(1.0)), 4).alias("confidence"),
            F.coalesce(s["source"], F.lit("ocr")).alias("source"), F.coalesce(s["order"], F.lit(0)).alias("order"), s["table"].alias("table"), F.when(s["synthetic_bbox"], True).alias("synthetic_bbox"),
        )

    name_of = lambda d: F.element_at(F.split(d["path"], "/"), -1)
    seconds = lambda ps: F.aggregate(ps, F.lit(0.0), lambda t, p: t + F.coalesce(p["duration_s"], F.lit(0.0)))
    held = lambda ps: F.aggregate(ps, F.lit(0), lambda t, p: t + F.size(F.coalesce(p["spans"], F.array())))
    whole = lambda d: F.coalesce(d["pages"], F.array())

    def page(p: Column, d: Column) -> Column:
        return F.struct(
            p["number"].alias("page"), F.bround(p["width"], 2).alias("width"), F.bround(p["height"], 2).alias("height"), F.coalesce(p["extraction_method"], F.lit("ocr")).alias("extraction_method"),
            F.bround(F.coalesce(p["duration_s"], F.lit(0.0)), 3).alias("duration_s"), F.size(F.coalesce(p["spans"], F.array())).alias("span_count"), F.nullif(p["ocr_reason"], F.lit("")).alias("ocr_reason"),
            F.transform(F.coalesce(p["spans"], F.array()), lambda s: span(s, d, p)).alias("spans"),
        )

    def document(d: Column) -> Column:
        return F.struct(
            name_of(d).alias("document"), d["path"].alias("path"), F.coalesce(d["doc_type"], F.lit("pdf")).alias("doc_type"), F.size(whole(d)).alias("page_count"), held(whole(d)).alias("span_count"),
            F.bround(seconds(whole(d)), 3).alias("duration_s"), F.coalesce(d["metadata"], F.create_map().cast("map<string,string>")).alias("metadata"),
            F.transform(whole(d), lambda p: page(p, d)).alias("pages"),
        )

    docs = F.coalesce("documents", F.array())
    sums = F.aggregate(docs, F.lit(0.0), lambda t, d: t + seconds(whole(d)))
    count = F.aggregate(docs, F.lit(0), lambda t, d: t + held(whole(d)))
    body = F.struct(F.size(docs).alias("document_count"), count.alias("span_count"), F.bround(sums, 3).alias("duration_s"), F.transform(docs, document).alias("documents"))
    return sets.select("packet_id", F.to_json(body).alias("body"))


SPAN_JSON = "struct<text:string,page:int,bbox:array<double>,source_document:string,confidence:double,source:string,order:int,table:struct<table_index:int,row:int,col:int>,synthetic_bbox:boolean>"
PAGE_JSON = f"struct<page:int,width:double,height:double,extraction_method:string,ocr_reason:string,duration_s:double,spans:array<{SPAN_JSON}>>"


def from_document_set_json(bodies: DataFrame) -> DataFrame:
    """Document sets from (packet_id, body) as ``document_set_json`` writes them; a body that is no JSON gives null documents."""
    read = F.from_json("body", f"documents array<struct<document:string,path:string,doc_type:string,metadata:map<string,string>,pages:array<{PAGE_JSON}>>>")

    def span(s: Column) -> Column:
        box = F.struct(*[F.get(s["bbox"], F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])
        return F.struct(
            s["text"].alias("text"), box.alias("bbox"), F.coalesce(s["confidence"], F.lit(1.0)).alias("confidence"), F.coalesce(s["source"], F.lit("ocr")).alias("source"),
            F.coalesce(s["order"], F.lit(0)).alias("order"), s["table"].alias("table"), F.coalesce(s["synthetic_bbox"], F.lit(False)).alias("synthetic_bbox"),
        )

    page = lambda p: F.struct(p["page"].alias("number"), *[p[c].alias(c) for c in ("width", "height", "extraction_method", "ocr_reason", "duration_s")], F.transform(p["spans"], span).alias("spans"))
    document = lambda d: F.struct(F.coalesce(d["path"], d["document"]).alias("path"), *[d[c].alias(c) for c in ("doc_type", "metadata")], F.transform(d["pages"], page).alias("pages"))
    return bodies.select("packet_id", F.transform(read["documents"], document).alias("documents"))


def list_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Supported files below a folder, by path; others are left out, and none at all is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    files = files.where(F.regexp_extract(F.lower("path"), r"\.[a-z]+\z", 0).isin(*SUFFIXES))
    if files.isEmpty():
        raise ValueError(f"no supported documents in {path}")
    return files.orderBy("path")


def document_stats(flat: DataFrame) -> DataFrame:
    """Pages, spans and the sorted distinct producers of every document."""
    return flat.groupBy("packet_id", "doc_id").agg(F.count_distinct("page").alias("pages"), F.count("*").alias("spans"), F.array_sort(F.collect_set("source")).alias("sources"))


def text_layer_share(sets: DataFrame) -> DataFrame:
    """One row: pages, those read from a text layer, and their share (null without pages)."""
    pages = sets.select(F.explode("documents").alias("d")).select(F.explode("d.pages").alias("p"))
    hit = F.count_if(F.coalesce("p.extraction_method", F.lit("ocr")) == "pdf_text")
    return pages.agg(F.count("*").alias("pages"), hit.alias("text_layer"), (hit / F.nullif(F.count("*"), F.lit(0))).alias("share"))
