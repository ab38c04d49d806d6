"""Paths, names and tags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of image files.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff")
#: Where old storage locations lie in the portable layout.
PORTABLE = (
    ("/data/raw/sid_set/", "data/train/images/sid_set/"),
    ("/data/raw/wildfake/", "data/train/images/wildfake/"),
    ("/data/raw/wildfake_meta/", "data/train/images/wildfake_meta/"),
    ("/data/eval_only/", "data/evaluation/images/benchmark/"),
)
#: The folder of each lifecycle split.
LIFECYCLE = {"train": "data/train/images", "val": "data/evaluation/images/validation", "held": "data/evaluation/images/held", "test_unseen": "data/test/images"}
#: Quality tiers in archive paths, and roots whose second folder names the generator.
TIERS = ("Advanced", "Typical")
SUBGENERATOR_ROOTS = ("personalizedSD", "SDwithAdaptor")
#: Members that belong to evaluation material.
QUARANTINED = ("coco/coco2017/val2017/", "DALLE/Advanced/DALLE3/")
#: Spellings of the two classes.
AUTHENTIC = ("real", "authentic", "human", "0", "0.0")
GENERATED = ("fake", "ai", "generated", "synthetic", "aigc", "1", "1.0")


def forward(path: Column) -> Column:
    """With forward slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*IMAGE_SUFFIXES)


def basename(path: Column) -> Column:
    return F.substring_index(forward(path), "/", -1)


def portable(path: Column, strict: bool = False) -> Column:
    """The path in the portable layout; where an absolute path fits none of the known places it is null, or an error if ``strict``."""
    p = forward(path)
    out = F.when(~p.startswith("/"), p)
    for marker, place in reversed(PORTABLE):
        rest = F.substr(p, F.locate(marker, p) + len(marker))
        out = F.when(F.contains(p, F.lit(marker)), F.concat(F.lit(place), rest)).otherwise(out)
    return F.when(p.isNotNull() & out.isNull(), F.raise_error(F.concat(F.lit("no portable place for "), p))).otherwise(out) if strict else out


def lifecycle(path: Column, split: Column, source: Column) -> Column:
    """The path in its split's folder: what follows the source's name in the path; other splits keep their path."""
    parts = F.split(forward(path), "/")
    at = F.array_position(parts, source)
    rest = F.array_join(F.slice(parts, at + 1, F.size(parts)), "/")
    root = F.lit(None).cast("string")
    for s, folder in LIFECYCLE.items():
        root = F.when(split == s, folder).otherwise(root)
    return F.when(root.isNotNull() & (at > 0), F.concat_ws("/", root, source, rest)).otherwise(forward(path))


def archive_generator(archive: Column) -> Column:
    """A generator's name from its archive: the file's stem, but of part files the family and its tier."""
    parts = F.split(archive, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    family, tier = F.try_element_at(parts, F.lit(-3)), F.try_element_at(parts, F.lit(-2))
    part = F.when(tier.isin(*TIERS), F.concat_ws("_", family, tier)).otherwise(family)
    return F.when(stem.startswith("part_") & (F.size(parts) >= 3), part).otherwise(stem)


def member_generator(name: Column, archive: Column | None = None) -> tuple[Column, Column]:
    """(generator, whether of the advanced tier) from an archive member's path, else from the archive's."""
    parts = F.split(name, "/")
    n, a, b, c = F.size(parts), F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    tiered, sub = (n >= 3) & b.isin(*TIERS), (n >= 2) & a.isin(*SUBGENERATOR_ROOTS)
    other = archive_generator(archive) if archive is not None else a
    if archive is not None:
        other = F.when(archive != "", other).otherwise(a)
    generator = F.when(tiered, c).when(sub, F.concat_ws("_", a, b)).otherwise(other)
    from_archive = F.lit(False) if archive is None else (archive != "") & generator.endswith("_Advanced")
    return generator, F.when(tiered, b == "Advanced").when(sub, False).otherwise(from_archive)


def quarantined(name: Column) -> Column:
    out = F.lit(False)
    for prefix in QUARANTINED:
        out = out | name.startswith(prefix)
    return out


def variant_of(tag: Column) -> tuple[Column, Column]:
    """(family, value) of 'jpeg50' or 'jpeg=50'; 'clean' has no value."""
    bare = F.replace(tag, F.lit("="), F.lit(""))
    value = F.regexp_extract(bare, r"^([a-z_]+)([\d.]+)$", 2)
    family = F.regexp_extract(bare, r"^([a-z_]+)([\d.]+)$", 1)
    return F.when(bare == "clean", "clean").when(family != "", family), F.when(value != "", value.try_cast("double"))


def parse_label(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin(*AUTHENTIC), 0).when(t.isin(*GENERATED), 1)


def extract_label(name: Column) -> Column:
    found = F.regexp_extract(name, r"label(\d)", 1)
    return F.when(found != "", found.cast("int"))


def flat_name(path: Column) -> Column:
    return F.right(F.replace(path, F.lit("/"), F.lit("__")), F.lit(180))


def shorten(text: Column, width: int) -> Column:
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.lit("..."), F.right(text, F.lit(width - 3))))


def unescape(text: Column) -> Column:
    """A path as typed in a shell: without its quotes, or without backslashes before characters."""
    t = F.trim(text)
    quoted = (F.length(t) >= 2) & (F.left(t, F.lit(1)) == F.right(t, F.lit(1))) & F.left(t, F.lit(1)).isin('"', "'")
    return F.when(quoted, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(F.regexp_replace(t, r"\\(.)", "$1"))


def duration(seconds: Column) -> Column:
    """Seconds, minutes from 90 s, hours with tenths from 90 m. Exact halves go to the even digit; of hours the quotient as the double it is counts."""
    h = seconds / 3600
    k = F.floor(h * 10)
    above = (16 * h - (2 * k + 1)) + 4 * h  # 20 h - (2 k + 1): every step is exact in doubles
    tenths = k + F.when((above > 0) | (above == 0) & (k % 2 == 1), 1).otherwise(0)
    hours = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("h"))
    return (
        F.when(seconds < 90, F.concat(F.bround(seconds, 0).cast("bigint").cast("string"), F.lit("s")))
        .when(seconds < 5400, F.concat(F.bround(seconds / 60, 0).cast("bigint").cast("string"), F.lit("m")))
        .when(h < 1e14, hours)
        .otherwise(F.format_string("%.1fh", h))
    )


def cell_label(family: Column, value: Column) -> Column:
    """'jpeg=50': a whole value without decimals, others as they are."""
    text = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(F.round(value, 6).cast("string"))
    return F.when(value.isNull(), family).otherwise(F.concat_ws("=", family, text))


def nearest_label(path: Column) -> Column:
    """0 or 1 by the nearest folder named real or fake; null if there is none."""
    folders = F.split(F.lower(forward(path)), "/")
    above = F.slice(folders, 1, F.size(folders) - 1)
    found = F.get(F.filter(F.reverse(above), lambda x: x.isin("real", "fake")), F.lit(0))
    return F.when(found == "real", 0).when(found == "fake", 1)


def group_key(source: Column, generator: Column) -> Column:
    return F.concat_ws(" / ", F.coalesce(source, F.lit("unknown")), F.coalesce(generator, F.lit("unknown")))


def condition_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)
