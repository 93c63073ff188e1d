"""Photo listings and file-header checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import extension, natural_key, stem

# Extensions read without a plug-in, and with one.
BASE_EXTENSIONS = (".jpg", ".jpeg", ".jpe", ".jfif", ".png", ".bmp", ".tif", ".tiff", ".webp", ".gif")
HEIF_EXTENSIONS = (".heic", ".heif")
# Header brands of the HEIF family.
HEIF_BRANDS = ("heic", "heix", "hevc", "hevx", "mif1", "msf1")


def list_files(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """Files of a folder; without ``content`` the bytes are never read."""
    raw = spark.read.format("binaryFile").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    cols = ["path", name.alias("name"), "length"]
    return raw.select(*cols, "content") if content else raw.select(*cols)


def magic(content="content") -> Column:
    """True format of a file from its first 32 bytes, null when unknown."""
    c = F.col(content) if isinstance(content, str) else content

    def ascii_hex(s: str) -> str:
        return s.encode().hex().upper()

    def sniff(head: Column) -> Column:
        def starts(text: str, at: int = 0) -> Column:
            return F.substring(head, 2 * at + 1, len(text)) == text

        brand = F.substring(head, 17, 8).isin(*[ascii_hex(b) for b in HEIF_BRANDS])
        return (
            F.when(F.length(head) < 8, None)
            .when(starts("FFD8FF"), "JPEG")
            .when(starts("89504E470D0A1A0A"), "PNG")
            .when(starts(ascii_hex("GIF87a")) | starts(ascii_hex("GIF89a")), "GIF")
            .when(starts("49492A00") | starts("4D4D002A"), "TIFF")
            .when(starts("424D"), "BMP")
            .when(starts(ascii_hex("RIFF")) & starts(ascii_hex("WEBP"), 8), "WEBP")
            .when(starts(ascii_hex("ftyp"), 4) & brand, "HEIF")
        )

    # the lambda variable holds the header once, however often it is tested
    return F.transform(F.array(F.hex(F.substring(c, 1, 32))), sniff)[0]


def with_magic(files: DataFrame) -> DataFrame:
    """Add ``ext``, ``stem`` and ``magic`` to rows with ``name, content``."""
    return files.withColumns({"ext": extension("name"), "stem": stem("name"), "magic": magic()})


def is_photo(heif: bool = False) -> Column:
    exts = BASE_EXTENSIONS + (HEIF_EXTENSIONS if heif else ())
    known = ["JPEG", "PNG", "GIF", "TIFF", "BMP", "WEBP"] + (["HEIF"] if heif else [])
    return F.col("ext").isin(*exts) | F.coalesce(F.col("magic").isin(*known), F.lit(False))


def with_heads(files: DataFrame) -> DataFrame:
    """Add the first 32 bytes of each file as ``content``; only these files are read, by Spark, and a failed read fails.

    Their paths go through the driver, which lists the files of a folder in any case.
    """
    paths = sorted({re.sub(r"([\\\[\]{}*?])", r"\\\1", r.path) for r in files.select("path").toLocalIterator()})
    if not paths:
        return files.withColumn("content", F.lit(None).cast("binary"))
    raw = files.sparkSession.read.format("binaryFile").load(paths)
    heads = raw.select("path", F.substring("content", 1, 32).alias("content"))
    return files.drop("content").join(heads, "path")


def read_photos(spark: SparkSession, folder: str, sniff: bool = True, heif: bool = False) -> DataFrame:
    """Photos of a folder, by extension or, when sniffing, by header.

    Only files without a known extension are opened; 32 bytes of them are kept.
    """
    exts = BASE_EXTENSIONS + (HEIF_EXTENSIONS if heif else ())
    listed = list_files(spark, folder).withColumns({"ext": extension("name"), "stem": stem("name")})
    known = listed.where(F.col("ext").isin(*exts)).withColumn("magic", F.lit(None).cast("string"))
    if sniff:
        rest = with_heads(listed.where(~F.col("ext").isin(*exts))).withColumn("magic", magic()).drop("content")
        known = known.unionByName(rest.where(is_photo(heif)))
    return known.select(
        F.col("name").alias("photo_id"), "stem", "ext", "path", "length", "magic", natural_key("name").alias("sort_key")
    )


def format_issues(files: DataFrame, heif: bool = False) -> DataFrame:
    """Files that cannot be opened as their name promises, with the reason."""
    exts = BASE_EXTENSIONS + (HEIF_EXTENSIONS if heif else ())
    known_ext = F.col("ext").isin(*exts)
    reason = (
        F.when((F.col("magic") == "HEIF") & F.lit(not heif), "HEIF content needs a HEIF reader")
        .when(F.col("magic").isNotNull() & ~known_ext,
              F.concat(F.lit("content is "), F.col("magic"), F.lit(", extension is "),
                       F.when(F.col("ext") == "", "(none)").otherwise(F.col("ext"))))
        .when(F.col("magic").isNull(), "unsupported or corrupt image")
    )
    return files.withColumn("reason", reason).where("reason is not null")
