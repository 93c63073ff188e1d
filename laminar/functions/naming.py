"""File-name rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted photo extensions, in order of preference.
PREFERRED_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp", ".gif", ".jpe", ".jfif", ".heic", ".heif",
)
# Extensions a scale key may carry, in lookup order.
SCALE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".JPG", ".JPEG", ".PNG", ".TIF", ".TIFF")
# Marks of generated files, copy suffixes and folder prefixes.
GENERATED_MARKS = ("_art_", "_clean_mask", "_preview")
GEOMETRY_SUFFIXES = ("_r90", "_r180", "_r270", "_fh", "_fv")
FOLDER_PREFIXES = ("big_", "small_")

_NESTED = r"(?i)^(.+)_white_bg_leaf_\d+_white_bg$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def stem(name) -> Column:
    """File name without its last extension (a leading dot is no extension)."""
    return F.regexp_replace(_c(name), r"(?<=.)\.[^.]*$", "")


def extension(name) -> Column:
    """Lower-case last extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(_c(name), r".(\.[^.]*)$", 1))


def canonical_leaf_id(s) -> Column:
    """Leaf identity of a stem, without background and nested suffixes."""
    s = _c(s)
    return F.when(s.rlike(_NESTED), F.regexp_extract(s, _NESTED, 1)).otherwise(
        F.regexp_replace(s, r"(?i)_white_bg$", "")
    )


def is_nested_dup(s) -> Column:
    return _c(s).rlike(r"(?i)_white_bg_leaf_\d+_white_bg$")


def is_preextracted(s) -> Column:
    """The stem already names an isolated leaf."""
    return F.lower(_c(s)).contains("_white_bg")


def is_original(name) -> Column:
    """A source photo: accepted format and no mark of a generated file."""
    low = F.lower(_c(name))
    ok = extension(name).isin(".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp")
    for mark in GENERATED_MARKS:
        ok = ok & ~low.contains(mark)
    return ok


def photo_number(name) -> Column:
    """Leading digits of a name as a number, null without any."""
    return F.nullif(F.regexp_extract(_c(name), r"^(\d+)", 1), F.lit("")).try_cast("bigint")


def leaf_stem(photo, index) -> Column:
    return F.concat(_c(photo), F.lit("_leaf_"), _c(index).cast("string"))


def parent_photo(s) -> Column:
    """Photo of a ``{photo}_leaf_{n}`` stem, null for other stems."""
    return F.nullif(F.regexp_extract(_c(s), r"(?i)^(.+)_leaf_\d+$", 1), F.lit(""))


def scale_base(s) -> Column:
    """Stem without its background suffix, whatever follows inside it."""
    return F.regexp_replace(_c(s), r"(?i)_white_bg(?:_leaf_\d+(?:_white_bg)?)?$", "")


def natural_key(name) -> Column:
    """Orderable key in which embedded numbers compare as numbers.

    A number is its length and digits without leading zeros, so any number
    of digits compares rightly.
    """
    parts = F.split(F.lower(_c(name)), r"(?<=\d)(?=\D)|(?<=\D)(?=\d)")
    return F.transform(
        parts,
        lambda p: F.struct(
            (~p.rlike(r"^\d")).cast("int").alias("is_text"),
            F.when(p.rlike(r"^\d"), F.length(F.regexp_replace(p, "^0+", ""))).alias("digits"),
            F.when(p.rlike(r"^\d"), F.regexp_replace(p, "^0+", "")).otherwise(p).alias("text"),
        ),
    )


def clean_stem(s) -> Column:
    """Training stem without its variant suffix ``_v00`` .. ``_v39``."""
    return F.regexp_replace(_c(s), r"_v[0-3]\d$", "")


def training_leaf_id(s) -> Column:
    """Leaf behind a training copy: variant, geometry and folder removed."""
    geo = F.regexp_replace(clean_stem(s), "(" + "|".join(GEOMETRY_SUFFIXES) + ")$", "")
    return F.regexp_replace(geo, "^(" + "|".join(FOLDER_PREFIXES) + ")", "")
