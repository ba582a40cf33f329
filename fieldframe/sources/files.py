"""File catalogues: discovery, categories, name metadata, choice of sources, fingerprints.

Listing uses the ``binaryFile`` source without its content column, so only directories
are read; content is read where a fingerprint asks for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldframe.operators.scalars import with_row
from fieldframe.functions.names import map_province_name
from fieldframe.functions.text import contains_any, first_rule
from fieldframe.operators.picks import pick_one, pick_top
from fieldframe.sources import sha256

# Suffixes per raw category and path words per external category.
CLIMATE_SUFFIXES = (".nc", ".nc4", ".cdf")
RASTER_SUFFIXES = (".tif", ".tiff")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]+)$", 1))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder: path, length, modification time."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(
        "path", "length", "modificationTime")


def file_catalog(files: DataFrame, suffixes: Sequence[str], ignored: Sequence[str] = ()) -> DataFrame:
    """Files with a supported suffix, outside ignored folders, with the suffix rank for sorting."""
    s = suffix(F.col("path"))
    rank = first_rule([(s == x, F.lit(i)) for i, x in enumerate(suffixes)], F.lit(None).cast("int"))
    out = files.withColumns({"suffix": s, "suffix_rank": rank}).where("suffix_rank is not null")
    if ignored:
        folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
        out = out.where(~F.arrays_overlap(folders, F.array(*[F.lit(i) for i in ignored])))
    return out


def local_first(local: DataFrame, external: DataFrame) -> DataFrame:
    """Local files, or the external index when there is no local file (one row decides)."""
    some = local.limit(1).agg((F.count(F.lit(1)) > 0).alias("_local"))
    rest = with_row(external, some).where("not _local").drop("_local")
    return local.unionByName(rest)


def inventory(files: DataFrame, categories: Sequence[str], root_depth: int) -> DataFrame:
    """Files, bytes and readable files per category and suffix; the category is the first folder."""
    folder = F.get(F.split("path", "/"), F.lit(root_depth))
    category = F.when(folder.isin(*categories), folder).otherwise("unknown")
    return files.groupBy(category.alias("category"), suffix(F.col("path")).alias("suffix")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.count_if(F.col("length") > 0).alias("readable"))


# Category, words of its paths and suffixes; the first row that fits applies.
CATEGORIES = (
    ("phenology", ("chinaricecalendar",), RASTER_SUFFIXES),
    ("crop_mask", ("china_single_season_rice", "single_season_rice", "/clcd/"), RASTER_SUFFIXES),
    ("climate", ("era5_land", "cmfd", "chirps", "terraclimate"), CLIMATE_SUFFIXES),
    ("remote_sensing", ("nasa", "mod13q1", "myd13q1", "mod11a2", "mod16a2", "smap", "spl3smp", "grace", "gleam"), (*CLIMATE_SUFFIXES, *RASTER_SUFFIXES, ".hdf", ".h5")),
)


def path_category(path: Column) -> Column:
    """Category of an external file from path words and suffix; null when none applies."""
    p, s = F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), suffix(path)
    return first_rule([(contains_any(p, words) & s.isin(*suffixes), F.lit(name)) for name, words, suffixes in CATEGORIES], F.lit(None).cast("string"))


def name_years(path: Column) -> Column:
    """All plausible years of a file name."""
    found = F.regexp_extract_all(file_name(path), F.lit(r"((?:19|20)\d{2})"), 1)
    return F.transform(found, lambda y: y.cast("int"))


# Words of proxy paths, and of the names of phenology rasters, with what they say; the first that fits applies.
PROXY_SOURCES = ((("ggcp10",), "ggcp10"), (("asiariceyield", "asia_rice_yield"), "asia_rice_yield_4km"))
NAMED_PROXY = ("gdhy", "gdhy")
STAGE_WORDS = (("transplant", "transplanting"), ("maturity", "maturity"), ("heading", "heading"))
SEASON_WORDS = (("early_rice", "early"), ("middle_rice", "middle"), ("late_rice", "late"), ("rice", "rice"))


def filename_metadata(path: Column) -> dict[str, Column]:
    """Source, year, crop, variable and factor of a proxy raster; stage, season and province of others."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    n = file_name(p)
    source = first_rule(
        [*[(contains_any(p, words), F.lit(name)) for words, name in PROXY_SOURCES], (n.contains(NAMED_PROXY[0]), F.lit(NAMED_PROXY[1]))],
        F.lit("unknown_yield_proxy"),
    )
    variable = first_rule(
        [(n.contains("prod"), F.lit("production")),
         (n.contains("yield") | source.isin("asia_rice_yield_4km", "gdhy"), F.lit("yield"))],
        F.lit("value"),
    )
    region = F.regexp_extract(file_name(path), r"(?i)classified-(.+?)-(?:(?:19|20)\d{2})", 1)
    return {
        "source": source,
        "year": F.get(name_years(p), F.lit(0)),
        "crop": F.when(p.contains("rice"), "rice").otherwise("unknown"),
        "variable": variable,
        "value_to_ton_factor": F.when((source == "ggcp10") & (variable == "production"), 1000.0),
        "stage": first_rule([(n.contains(word), F.lit(name)) for word, name in STAGE_WORDS], F.lit(None).cast("string")),
        "season": first_rule([(n.contains(word), F.lit(name)) for word, name in SEASON_WORDS], F.lit(None).cast("string")),
        "province": map_province_name(F.replace(region, F.lit("_"), F.lit(" "))),
    }


# Words of mask files, best first.
MASK_WORDS = (
    ("rice", "single_season_rice", "middle_rice", "early_rice", "late_rice", "稻"),
    ("clcd", "cropland", "worldcover", "landcover", "crop_land"),
)


def source_rank(path: Column) -> Column:
    """Rice masks before generic cropland masks before the rest."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return first_rule([(contains_any(p, words), F.lit(rank)) for rank, words in enumerate(MASK_WORDS)], F.lit(len(MASK_WORDS)))


def nearest_year(files: DataFrame, group: Sequence[str], target: int, ties: bool = False) -> DataFrame:
    """File of best rank whose name year is nearest the target, per group; optionally all that tie on both.

    Dated files come before undated ones; a group without any dated file gives its first by path.
    """
    dated = files.withColumn("_y", F.explode_outer(name_years(F.col("path")))).withColumns({
        "_rank": source_rank(F.col("path")), "_dist": F.abs(F.col("_y") - target)})
    undated = F.col("_y").isNull()
    best = [undated, F.when(~undated, F.col("_rank")), F.col("_dist")]
    if ties:
        return pick_top(dated, group, [*best, F.when(undated, F.col("path"))]).select(*files.columns).distinct()
    return pick_one(dated, group, [*best, F.col("_y"), F.col("path")]).select(*files.columns)


def covering_interval(files: DataFrame, group: Sequence[str], target: int) -> DataFrame:
    """Per group the file whose year span covers the target: county level first, then the shortest span."""
    years = name_years(F.col("path"))
    start = F.coalesce(F.array_min(years), F.lit(target))
    end = F.coalesce(F.array_max(years), F.lit(target))
    level = F.when(F.lower(file_name(F.col("path"))).contains("county_level"), 0).otherwise(1)
    spans = files.withColumns({"_a": start, "_b": end, "_level": level}).where((F.col("_a") <= target) & (F.col("_b") >= target))
    return pick_one(spans, group, [F.col("_level"), F.col("_b") - F.col("_a"), F.col("path")]).select(*files.columns)


def prefer_variant(files: DataFrame, providers: Sequence[str], marker: str = "/clipped/") -> DataFrame:
    """Drop the full files of a provider that has a compact variant."""
    p = F.lower(F.replace("path", F.lit("\\"), F.lit("/")))
    provider = first_rule([(p.contains(x), F.lit(x)) for x in providers], F.lit(None).cast("string"))
    tagged = files.withColumns({"_provider": provider, "_compact": p.contains(marker)})
    have = tagged.where("_provider is not null").groupBy("_provider").agg(F.bool_or("_compact").alias("_some"))
    joined = tagged.join(have, "_provider", "left")
    return joined.where(F.col("_compact") | ~F.coalesce("_some", F.lit(False))).select(*files.columns)


#: Spark reads a file of at most so many bytes as one value.
WHOLE_FILE = (1 << 31) - 1
#: Larger files are hashed in blocks of so many bytes.
BLOCK = 1 << 27


def fingerprints(spark: SparkSession, root: str, pattern: str = "*", largest: int | None = None, block: int = BLOCK) -> DataFrame:
    """Content hash and length per file; the hash is null for files of more than ``largest`` bytes, which are not read.

    A file of more than ``block`` bytes is hashed block by block, so no task reads or holds it whole.
    Packed files, which Spark cannot split, are read as one value up to WHOLE_FILE and have no hash above.
    ``row_digests`` fingerprints the rows of files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    # conditions on the listing leave out files before they are read; those on the columns read them first
    size = F.col("_metadata.file_size")
    packed = F.lower("_metadata.file_name").rlike("(" + "|".join(x.replace(".", "[.]") for x in sha256.PACKED) + ")$")
    over = packed & (size > WHOLE_FILE)
    if largest is not None:
        over |= size > largest
    blocks = ~over & ~packed & (size > block)
    columns = ["path", "sha256", "length", "modificationTime"]
    hashed = files.where(~over & ~blocks).select("path", F.sha2("content", 256).alias("sha256"), "length", "modificationTime")
    out = hashed.unionByName(files.where(over).select("path", F.lit(None).cast("string").alias("sha256"), "length", "modificationTime"))
    large = files.where(blocks).select("path", sha256.file_key(F.col("_metadata.file_path")).alias("file"), "length", "modificationTime")
    lengths = {r["file"]: r["length"] for r in large.select("file", "length").collect()}  # files of more than a block each
    if not lengths:
        return out
    return out.unionByName(large.join(sha256.large_files(spark, root, pattern, lengths, block, block), "file").select(*columns))


def row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of a whole row, by different seeds and column orders; nulls count, wherever they are.

    A hash function of Spark passes over nulls, so every column is preceded by whether it is null.
    Nested values are hashed as JSON, in which nulls inside them are written.
    """
    def parts(name: str, kind: str) -> list[Column]:
        c = F.col(f"`{name}`")
        nested = kind.startswith(("array", "map", "struct", "variant"))
        return [c.isNull(), F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}) if nested else c]

    columns = [parts(name, kind) for name, kind in df.dtypes]
    forward = [F.lit("first"), *(c for pair in columns for c in pair)]
    backward = [F.lit("second"), *(c for pair in reversed(columns) for c in pair)]
    return F.xxhash64(*forward), F.xxhash64(*backward)


def _digest() -> Column:
    """Aggregate of the hashes _one and _two of a group's rows."""
    whole = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).cast("string")
    xor = lambda c: F.bit_xor(c).cast("string")
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), whole("_one"), whole("_two"), xor("_one"), xor("_two")), 256)


def row_digests(df: DataFrame, by: Column | None = None, out: str = "path") -> DataFrame:
    """One fingerprint per source file of a scan, or per value of ``by``: ``(out, rows, row_digest)``.

    The digest is SHA-256 over the number of rows, and sums and exclusive ors of both row hashes. It
    is an aggregate with map-side sums, so files are split as Spark likes; it does not depend on
    the order of rows, and differs when a cell changes or a row is added, lost or repeated.
    """
    one, two = row_hashes(df)
    hashed = df.select((F.col("_metadata.file_path") if by is None else by).alias(out), one.alias("_one"), two.alias("_two"))
    return hashed.groupBy(out).agg(F.count(F.lit(1)).alias("rows"), _digest().alias("row_digest"))


def rows_per_file(df: DataFrame, columns: int | None = None) -> DataFrame:
    """Rows and column count per source file of a scan."""
    return df.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(columns if columns is not None else len(df.columns)).alias("columns"))


def measures(tables: dict[str, DataFrame], keys: dict[str, Sequence[str]]) -> DataFrame:
    """Rows, columns, year range, filled share of key columns and row digest per source file of the tables.

    The range is that of a year column, or of the years of the first date or time column; null without.
    """
    def years(df: DataFrame) -> tuple[Column, Column]:
        whole = next((F.col(c) for c, kind in df.dtypes if c.lower() == "year" and kind in ("int", "bigint", "smallint")), None)
        dated = next((F.year(c) for c, kind in df.dtypes if kind in ("date", "timestamp", "timestamp_ntz")), None)
        year = next((y for y in (whole, dated) if y is not None), F.lit(None))
        return F.min(year).cast("int").alias("year_min"), F.max(year).cast("int").alias("year_max")

    out = None
    for name, df in tables.items():
        filled = [F.concat(F.lit(f"{c}="), F.round(F.count(c) / F.count(F.lit(1)), 6).cast("string")) for c in keys.get(name, ())]
        one, two = row_hashes(df)
        hashed = df.withColumns({"_path": F.col("_metadata.file_path"), "_one": one, "_two": two})
        part = hashed.groupBy(F.col("_path").alias("path")).agg(
            F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"), *years(df), F.concat_ws(";", *filled).alias("key_coverage"),
            _digest().alias("row_digest"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))


def freeze(spark: SparkSession, root: str, tables: dict[str, DataFrame], keys: dict[str, Sequence[str]]) -> DataFrame:
    """Version freeze per file: content hash and size, and the measures of its rows."""
    hashes = fingerprints(spark, root, "*.parquet").withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    return hashes.join(measures(tables, keys), "path", "left")
