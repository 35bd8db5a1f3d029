"""Loading documents: files, raw text, tables over JDBC or Parquet, and the registry."""

from __future__ import annotations

import io
import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspine.functions.text import extension, is_text, jtrim, route, truncate

MOST_CHARS = 10 * 1024 * 1024
LEAST_IMAGE = 100
#: Metadata keys of parsers and what they are called here; image types.
PICKED = {"title": "title", "Author": "author", "creator": "creator", "Creation-Date": "creation-date", "Last-Modified": "last-modified", "xmpTPg:NPages": "page-count", "Word-Count": "word-count", "Application-Name": "application"}
IMAGE_TYPES = ("image/jpeg", "image/png", "image/gif", "image/bmp", "image/webp")
#: Parsers by route, each bytes -> text; none for PDF and Office files comes with this library.
PARSERS: dict[str, Callable[[bytes], str]] = {}


#: How files of a type begin, in hexadecimal, and types of Office files by extension.
MAGIC = {"25504446": "application/pdf", "89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "47494638": "image/gif", "424D": "image/bmp", "1F8B": "application/gzip"}
OFFICE = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "doc": "application/msword",
    "xls": "application/vnd.ms-excel",
    "ppt": "application/vnd.ms-powerpoint",
}


def sniff(content: Column, name: Column) -> Column:
    """The MIME type of a file by how it begins; the name decides only between types that begin alike."""
    start, head = F.hex(F.substring(content, 1, 16)), F.lower(F.ltrim(F.substring(content, 1, 512).cast("string")))
    ext = extension(name)
    out = F.when(content.isNull() | (F.length(content) == 0), F.lit(None).cast("string"))
    for magic, kind in MAGIC.items():
        out = out.when(start.startswith(magic), kind)
    out = out.when(start.startswith("52494646") & (F.substring(start, 17, 8) == "57454250"), "image/webp")
    office = F.element_at(F.create_map(*[F.lit(x) for kv in OFFICE.items() for x in kv]), ext)
    out = out.when(start.startswith("504B0304"), F.coalesce(office, F.lit("application/zip"))).when(start.startswith("D0CF11E0"), F.coalesce(office, F.lit("application/x-ole-storage")))
    out = out.when(head.rlike("^<(!doctype html|html)"), "text/html").when(head.startswith("<?xml"), "application/xml")
    out = out.when(head.rlike(r"^[\[{]") & (ext == "json"), "application/json").when(ext.isin("md", "markdown") & ~head.contains("\0"), "text/markdown")
    return out.when(~head.contains("\0"), "text/plain").otherwise("application/octet-stream")


def files(spark: SparkSession, path: str) -> DataFrame:
    """filename, content (binary), file_size, load_time of all files that aren't empty, at any depth."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.where("length > 0").select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content", F.col("length").alias("file_size"), F.current_timestamp().alias("load_time"))


def parse(loaded: DataFrame, parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """filename, route, mime, text, error: text files are decoded in the JVM (bytes that aren't UTF-8 become U+FFFD), others by the
    parser of their route; a failure is a row with an error, not a failed job."""
    known = dict(PARSERS if parsers is None else parsers)

    @F.arrow_udf("struct<text:string,error:string>")
    def run(kind: pa.Array, content: pa.Array) -> pa.Array:
        out = []
        for k, c in zip(kind.to_pylist(), content.to_pylist()):
            try:
                out.append({"text": known[k](c)[:MOST_CHARS], "error": None} if k in known else {"text": None, "error": f"no parser for {k}"})
            except Exception as e:  # the parser's error is this file's result
                out.append({"text": None, "error": f"{type(e).__name__}: {e}"})
        return pa.array(out, pa.struct([("text", pa.string()), ("error", pa.string())]))

    name = F.col("filename")
    mime = sniff(F.col("content"), name)
    plain = is_text(F.when(mime != "application/octet-stream", mime), name) & (route(name) != "pdf") & (route(name) != "office")
    rows = loaded.withColumn("route", route(name)).withColumn("mime", mime).withColumn("plain", F.coalesce(plain, F.lit(False)))
    decoded = rows.where("plain").select("filename", "route", "mime", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.lit(None).cast("string").alias("error"))
    other = rows.where("not plain").select("filename", "route", "mime", run("route", "content").alias("p")).select("filename", "route", "mime", "p.text", "p.error")
    return decoded.unionByName(other)


def from_text(rows: DataFrame, content: str = "text", name: str = "name") -> DataFrame:
    """content, filename, file_size (UTF-8 bytes) of the rows that aren't blank."""
    return rows.where(jtrim(F.col(content)) != "").select(F.col(content).alias("content"), F.col(name).alias("filename"), F.octet_length(content).cast("long").alias("file_size"))


def picked_metadata(m: Column) -> Column:
    """Known keys of a parser's metadata under their names here; empty values go."""
    some = F.map_filter(m, lambda k, v: k.isin(*PICKED) & v.isNotNull() & (v != ""))
    names = F.create_map(*[F.lit(x) for kv in PICKED.items() for x in kv])
    return F.transform_keys(some, lambda k, v: F.element_at(names, k))


def preview(c: Column, n: int = 1000) -> Column:
    return truncate(c, n)


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def jdbc_ranges(spark: SparkSession, url: str, table: str, column: str, tasks: int, steps: int = 64, **options: str) -> list[str]:
    """Conditions that cut a table into about ``tasks`` parts of like size by an integer column, and one for its nulls.

    The database counts rows in ``tasks * steps`` steps of equal width between the smallest and the largest value, and in turn within a step that
    holds more than a part, so that values that lie close together are told apart; neighbouring steps are put together.  Every row meets one
    condition.  A single value with more rows than a part stays one part.
    """
    ask = lambda sql: spark.read.format("jdbc").options(url=url, query=sql, **options).load().collect()
    low, high, n, known = ask(f"SELECT MIN({column}) AS lo, MAX({column}) AS hi, COUNT(*) AS n_all, COUNT({column}) AS n_known FROM {table}")[0]
    nulls = [f"{column} IS NULL"] if n > known else []
    if not known:
        return nulls or ["1 = 1"]
    low, high, most = int(low), int(high), max(1, known // max(1, tasks))

    def counted(low: int, high: int) -> list[tuple[int, int, int]]:
        """(first value, last value, rows) of the steps of a range, finer ones where they hold many."""
        width = max(1, -(-(high - low + 1) // (tasks * steps)))
        step = f"CAST(({column} - ({low})) / {width} AS BIGINT)"
        found = ask(f"SELECT s, COUNT(*) AS n FROM (SELECT {step} AS s FROM {table} WHERE {column} BETWEEN {low} AND {high}) t GROUP BY s")
        out = []
        for s, rows in sorted((int(s), int(rows)) for s, rows in found):
            a, z = low + s * width, min(high, low + (s + 1) * width - 1)
            out += counted(a, z) if rows > most and z > a and width > 1 else [(a, z, rows)]
        return out

    cuts, held = [], 0
    for a, _, rows in counted(low, high):
        if held and held + rows > most:
            cuts.append(a)
            held = 0
        held += rows
    if not cuts:
        return [f"{column} IS NOT NULL", *nulls]
    between = [f"{column} >= {a} AND {column} < {z}" for a, z in zip(cuts, cuts[1:])]
    return [f"{column} < {cuts[0]}", *between, f"{column} >= {cuts[-1]}", *nulls]


def jdbc_by(spark: SparkSession, url: str, table: str, column: str, tasks: int, **options: str) -> DataFrame:
    """A database's table, read in about ``tasks`` tasks of like size by an integer column."""
    ranges = jdbc_ranges(spark, url, table, column, tasks, **options)
    return spark.read.jdbc(url, table, predicates=ranges, properties=options)


def tables(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Parquet tables of a folder as views for SQL."""
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)


def registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A registry's JSON array without its deleted rows."""
    return spark.read.schema(schema).json(path, multiLine=True).where("status <> 'DELETED'")


def image_info(data: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) from a PNG, GIF, BMP or JPEG header."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return ("png", *struct.unpack(">II", data[16:24]))
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return ("gif", *struct.unpack("<HH", data[6:10]))
    if data[:2] == b"BM":
        return ("bmp", *struct.unpack("<ii", data[18:26]))
    if data[:2] == b"\xff\xd8":
        s = io.BytesIO(data[2:])
        while (head := s.read(4)) and len(head) == 4:
            marker, size = struct.unpack(">HH", head)
            if 0xFFC0 <= marker <= 0xFFCF and marker not in (0xFFC4, 0xFFC8, 0xFFCC):
                h, w = struct.unpack(">HH", s.read(5)[1:])
                return "jpeg", w, h
            s.seek(size - 2, 1)
    return None


def images(loaded: DataFrame, least: int = LEAST_IMAGE) -> DataFrame:
    """filename, format, width, height, base64, size of images of at least ``least`` pixels each way."""

    @F.arrow_udf("struct<format:string,width:int,height:int>")
    def probe(content: pa.Array) -> pa.Array:
        got = [image_info(c) for c in content.to_pylist()]
        return pa.array([g and dict(zip(("format", "width", "height"), g)) for g in got], pa.struct([("format", pa.string()), ("width", pa.int32()), ("height", pa.int32())]))

    rows = loaded.withColumn("i", probe("content")).where((F.col("i.width") >= least) & (F.col("i.height") >= least))
    return rows.select("filename", "i.format", "i.width", "i.height", F.base64("content").alias("base64"), F.length("content").alias("size"))


def is_image(mime: Column) -> Column:
    return F.coalesce(mime.isin(*IMAGE_TYPES), F.lit(False))


def block_texts(blocks: Column) -> Column:
    """Texts of blocks in order; an image is a numbered placeholder."""
    return F.transform(blocks, lambda b, i: F.when(b["type"] == "IMAGE", F.format_string("[IMAGE %d]", i + 1)).otherwise(b["content"]))


def html_text(html: Column) -> Column:
    """Visible text of a page: without scripts, styles and tags, spaces folded."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), r"\s+", " "))


