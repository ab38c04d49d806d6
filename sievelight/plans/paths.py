"""Queries on paths, names and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions import paths as P
from sievelight.plans import normal_sql as N

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rows(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/manifest.parquet")


def of_path(spark, d, column, name: str) -> DataFrame:
    return rows(spark, d).select("row_id", column.alias(name))


FWD = "replace(path, '\\', '/')"


def path():
    return F.col("path")


@query("SELECT row_id, lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('jpg', 'jpeg', 'png', 'webp', 'bmp', 'tif', 'tiff') AS is_image FROM manifest")
def src_image_suffix(spark, d):
    return of_path(spark, d, P.is_image(path()), "is_image")


@query(f"SELECT row_id, regexp_extract({FWD}, '([^/]*)$', 1) AS name FROM manifest WHERE path IS NOT NULL")
def fn_basename(spark, d):
    return of_path(spark, d, P.basename(path()), "name").where("name IS NOT NULL")


#: Absolute paths of the old storage are made of the table's own names, for the table has portable ones.
OLD = "CASE row_id % 5 WHEN 0 THEN '/srv/data/raw/sid_set/' || path WHEN 1 THEN '/srv/data/raw/wildfake_meta/' || path WHEN 2 THEN '/srv/data/eval_only/' || path WHEN 3 THEN '/elsewhere/' || path ELSE path END"


def old(spark, d):
    k = F.col("row_id") % 5
    place = F.when(k == 0, "/srv/data/raw/sid_set/").when(k == 1, "/srv/data/raw/wildfake_meta/").when(k == 2, "/srv/data/eval_only/").when(k == 3, "/elsewhere/").otherwise("")
    return rows(spark, d).select("row_id", F.concat(place, "path").alias("path"))


@query(f"""WITH o AS (SELECT row_id, replace({OLD}, '\\', '/') AS p FROM manifest)
SELECT row_id, CASE WHEN contains(p, '/data/raw/sid_set/') THEN 'data/train/images/sid_set/' || substr(p, instr(p, '/data/raw/sid_set/') + 18) WHEN contains(p, '/data/raw/wildfake/') THEN 'data/train/images/wildfake/' || substr(p, instr(p, '/data/raw/wildfake/') + 19)
 WHEN contains(p, '/data/raw/wildfake_meta/') THEN 'data/train/images/wildfake_meta/' || substr(p, instr(p, '/data/raw/wildfake_meta/') + 24) WHEN contains(p, '/data/eval_only/') THEN 'data/evaluation/images/benchmark/' || substr(p, instr(p, '/data/eval_only/') + 16)
 WHEN NOT starts_with(p, '/') THEN p END AS portable FROM o""")
def prj_portable_path(spark, d):
    return old(spark, d).select("row_id", P.portable(path()).alias("portable"))


@query(f"""WITH s AS (SELECT row_id, {FWD} AS p, {N.split()} AS split, lower(trim(source)) AS source FROM manifest), r AS (SELECT *, CASE split WHEN 'train' THEN 'data/train/images' WHEN 'val' THEN 'data/evaluation/images/validation' WHEN 'held' THEN 'data/evaluation/images/held' WHEN 'test_unseen' THEN 'data/test/images' END AS root, list_position(string_split(p, '/'), source) AS pos FROM s)
SELECT row_id, CASE WHEN root IS NOT NULL AND pos > 0 THEN root || '/' || source || '/' || array_to_string(string_split(p, '/')[pos + 1:], '/') ELSE p END AS new_path FROM r""")
def prj_lifecycle_path(spark, d):
    from sievelight.functions.normal import split_of

    return rows(spark, d).select("row_id", P.lifecycle(path(), split_of(F.col("split")), F.lower(F.trim("source"))).alias("new_path"))


@query("SELECT row_id, coalesce(source, 'unknown') || ' / ' || coalesce(generator, 'unknown') AS key FROM manifest")
def prj_group_key(spark, d):
    return of_path(spark, d, P.group_key(F.col("source"), F.col("generator")), "key")


@query("SELECT label, left(sha256(family || '|' || label), 12) AS key FROM degradation_cells")
def prj_condition_key(spark, d):
    return spark.read.parquet(f"{d}/degradation_cells.parquet").select("label", P.condition_key(F.col("family"), F.col("label")).alias("key"))


@query("""WITH r AS (SELECT DISTINCT condition, CAST(row_id AS VARCHAR) || '|' || CAST(pred_id AS VARCHAR) AS r FROM predictions),
p AS (SELECT condition, left(sha256(r), 2) AS part, sha256(string_agg(r, chr(10) ORDER BY r)) AS digest FROM r GROUP BY 1, 2)
SELECT condition, left(sha256(string_agg(part || digest, chr(10) ORDER BY part || digest)), 16) AS signature FROM p GROUP BY 1""")
def prj_signature(spark, d):
    """A short hash of the set of inputs of each condition: of the digests of 256 parts of it, so no task gathers a whole condition."""
    r = spark.read.parquet(f"{d}/predictions.parquet").select("condition", F.concat_ws("|", "row_id", "pred_id").alias("r")).distinct()
    drawn = r.withColumn("part", F.substring(F.sha2("r", 256), 1, 2))
    digest = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    parts = drawn.groupBy("condition", "part").agg(digest("r").alias("digest"))
    return parts.groupBy("condition").agg(F.substring(digest(F.concat("part", "digest")), 1, 16).alias("signature"))


#: Archive members are made of the table's names: tiered, of a sub-generator root, of part archives, and plain.
MEMBER = """CASE row_id % 4 WHEN 0 THEN 'DALLE/Advanced/' || g || '/x.png' WHEN 1 THEN 'SDwithAdaptor/' || g || '/x.png' WHEN 2 THEN 'x' || row_id || '.png' ELSE g || '/x.png' END"""
ARCHIVE = """CASE row_id % 4 WHEN 2 THEN 'Images/' || g || '/' || CASE WHEN row_id % 8 = 2 THEN 'Advanced' ELSE 'other' END || '/part_1.zip' WHEN 3 THEN 'Images/' || g || '.zip' ELSE '' END"""


def members(spark, d):
    k, g = F.col("row_id") % 4, F.coalesce("generator", F.lit("none"))
    name = F.when(k == 0, F.concat(F.lit("DALLE/Advanced/"), g, F.lit("/x.png"))).when(k == 1, F.concat(F.lit("SDwithAdaptor/"), g, F.lit("/x.png"))).when(k == 2, F.concat(F.lit("x"), "row_id", F.lit(".png"))).otherwise(F.concat(g, F.lit("/x.png")))
    tier = F.when(F.col("row_id") % 8 == 2, "Advanced").otherwise("other")
    archive = F.when(k == 2, F.concat(F.lit("Images/"), g, F.lit("/"), tier, F.lit("/part_1.zip"))).when(k == 3, F.concat(F.lit("Images/"), g, F.lit(".zip"))).otherwise("")
    return rows(spark, d).select("row_id", name.alias("name"), archive.alias("archive"))


@query(f"""WITH s AS (SELECT row_id, coalesce(generator, 'none') AS g FROM manifest), m AS (SELECT row_id, {MEMBER} AS name, {ARCHIVE} AS archive FROM s),
p AS (SELECT *, string_split(name, '/') AS n, string_split(archive, '/') AS a FROM m),
x AS (SELECT *, CASE WHEN regexp_replace(a[-1], '\\.[^.]*$', '') LIKE 'part\\_%' ESCAPE '\\' AND len(a) >= 3 THEN CASE WHEN a[-2] IN ('Advanced', 'Typical') THEN a[-3] || '_' || a[-2] ELSE a[-3] END ELSE regexp_replace(a[-1], '\\.[^.]*$', '') END AS ag FROM p),
y AS (SELECT *, CASE WHEN len(n) >= 3 AND n[2] IN ('Advanced', 'Typical') THEN n[3] WHEN len(n) >= 2 AND n[1] IN ('personalizedSD', 'SDwithAdaptor') THEN n[1] || '_' || n[2] WHEN archive <> '' THEN ag ELSE n[1] END AS generator FROM x)
SELECT row_id, generator, CASE WHEN len(n) >= 3 AND n[2] IN ('Advanced', 'Typical') THEN n[2] = 'Advanced' WHEN len(n) >= 2 AND n[1] IN ('personalizedSD', 'SDwithAdaptor') THEN false ELSE archive <> '' AND generator LIKE '%\\_Advanced' ESCAPE '\\' END AS advanced FROM y""")
def fn_generator_of(spark, d):
    generator, advanced = P.member_generator(F.col("name"), F.col("archive"))
    return members(spark, d).select("row_id", generator.alias("generator"), advanced.alias("advanced"))


@query(f"""WITH s AS (SELECT row_id, coalesce(generator, 'none') AS g FROM manifest), m AS (SELECT row_id, {MEMBER} AS name FROM s)
SELECT row_id, starts_with(name, 'coco/coco2017/val2017/') OR starts_with(name, 'DALLE/Advanced/DALLE3/') AS quarantined FROM m""")
def fn_is_quarantined(spark, d):
    return members(spark, d).select("row_id", P.quarantined(F.col("name")).alias("quarantined"))


@query(f"""WITH s AS (SELECT row_id, coalesce(generator, 'none') AS g FROM manifest), m AS (SELECT row_id, {MEMBER} AS name FROM s) SELECT row_id, name FROM m WHERE name NOT LIKE '%/' AND starts_with(name, 'SDwithAdaptor/') AND name LIKE '%.png'""")
def src_zip_members(spark, d):
    n = F.col("name")
    return members(spark, d).where(~n.endswith("/") & n.startswith("SDwithAdaptor/") & P.is_image(n)).select("row_id", "name")


@query("""WITH v AS (SELECT DISTINCT variant, replace(variant, '=', '') AS b FROM score_cache WHERE variant IS NOT NULL)
SELECT variant, CASE WHEN b = 'clean' THEN 'clean' ELSE nullif(regexp_extract(b, '^([a-z_]+)([0-9.]+)$', 1), '') END AS family, TRY_CAST(nullif(regexp_extract(b, '^([a-z_]+)([0-9.]+)$', 2), '') AS DOUBLE) AS value FROM v""")
def fn_parse_variant(spark, d):
    family, value = P.variant_of(F.col("variant"))
    return spark.read.parquet(f"{d}/score_cache.parquet").where("variant IS NOT NULL").select("variant").distinct().select("variant", family.alias("family"), value.alias("value"))


@query("SELECT label AS expected, CASE WHEN value IS NULL THEN family ELSE label END AS label FROM degradation_cells")
def fn_cell_label(spark, d):
    return spark.read.parquet(f"{d}/degradation_cells.parquet").select(F.col("label").alias("expected"), P.cell_label(F.col("family"), F.col("value")).alias("label"))


@query("""SELECT row_id, CASE WHEN lower(trim(generator)) IN ('real', 'authentic', 'human', '0', '0.0') THEN 0 WHEN lower(trim(generator)) IN ('fake', 'ai', 'generated', 'synthetic', 'aigc', '1', '1.0') THEN 1 END AS parsed FROM manifest""")
def fn_parse_label(spark, d):
    return of_path(spark, d, P.parse_label(F.col("generator")), "parsed")


@query("SELECT row_id, TRY_CAST(nullif(regexp_extract('im_label' || CAST(label AS VARCHAR) || '.png', 'label([0-9])', 1), '') AS INT) AS parsed FROM manifest")
def fn_extract_label(spark, d):
    return of_path(spark, d, P.extract_label(F.concat(F.lit("im_label"), F.col("label").cast("string"), F.lit(".png"))), "parsed")


@query("SELECT row_id, right(replace(path, '/', '__'), 180) AS flat FROM manifest")
def fn_flatten_name(spark, d):
    return of_path(spark, d, P.flat_name(path()), "flat")


@query("SELECT row_id, CASE WHEN length(path) <= 40 THEN path ELSE '...' || right(path, 37) END AS short FROM manifest")
def fn_shorten(spark, d):
    return of_path(spark, d, P.shorten(path(), 40), "short")


@query("""WITH t AS (SELECT row_id, CASE row_id % 3 WHEN 0 THEN ' "' || path || '" ' WHEN 1 THEN replace(path, '_', '\\_') ELSE path END AS typed FROM manifest), u AS (SELECT row_id, trim(typed) AS t FROM t)
SELECT row_id, CASE WHEN length(t) >= 2 AND left(t, 1) = right(t, 1) AND left(t, 1) IN ('"', '''') THEN substr(t, 2, length(t) - 2) ELSE regexp_replace(t, '\\\\(.)', '\\1', 'g') END AS path FROM u""")
def fn_unescape(spark, d):
    k = F.col("row_id") % 3
    typed = F.when(k == 0, F.concat(F.lit(' "'), path(), F.lit('" '))).when(k == 1, F.replace(path(), F.lit("_"), F.lit("\\_"))).otherwise(path())
    return of_path(spark, d, P.unescape(typed), "path")


@query("""SELECT row_id, CASE WHEN row_id * 1.0 < 90 THEN CAST(row_id AS VARCHAR) || 's' WHEN row_id < 5400 THEN CAST(CAST(round_even(CAST(row_id AS DOUBLE) / 60, 0) AS BIGINT) AS VARCHAR) || 'm' ELSE printf('%.1fh', CAST(row_id AS DOUBLE) / 3600) END AS duration FROM manifest""")
def fn_duration(spark, d):
    """Row ids stand for seconds."""
    return rows(spark, d).select("row_id", P.duration(F.col("row_id").cast("double")).alias("duration"))


@query(f"""WITH s AS (SELECT row_id, string_split(lower({FWD}), '/') AS p FROM manifest), f AS (SELECT row_id, list_filter(list_reverse(p[:-2]), lambda x: x IN ('real', 'fake'))[1] AS x FROM s)
SELECT row_id, CASE x WHEN 'real' THEN 0 WHEN 'fake' THEN 1 END AS label FROM f""")
def win_nearest_ancestor_label(spark, d):
    return of_path(spark, d, P.nearest_label(path()), "label")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def fn_sha256(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("digest"))


@query()
def fn_crc32(spark, d):
    """Checksums as archives keep them; tested against zlib."""
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.crc32("text").alias("crc"))


@query(f"""WITH h AS (SELECT row_id, {N.phash()} AS p FROM manifest) SELECT a.row_id, CAST(bit_count(xor(a.p, b.p)) AS INT) AS distance FROM h a JOIN h b ON b.row_id = a.row_id + 1""")
def fn_hamming(spark, d):
    """Bits in which each image's hash differs from the next id's."""
    from sievelight.functions.normal import phash_of

    h = rows(spark, d).select("row_id", phash_of(F.col("phash")).alias("p"))
    nxt = h.select((F.col("row_id") - 1).alias("row_id"), F.col("p").alias("q"))
    return h.join(nxt, "row_id").select("row_id", F.bit_count(F.col("p").bitwiseXOR(F.col("q"))).alias("distance"))
