"""Reading files and catalogues into tables. Everything is line- or row-wise, so files of any number and size split."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators import quality, timegrid
from rivulet.plans.fixpoint import cut, shared_root
from rivulet.sources.sinks import write_partitioned


def shared_scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------ reading files
def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Text lines with the file they come from."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select("value", F.input_file_name().alias("path"))


def station_of_path(path: Column, pattern: str = r"([^/_]+)\.[^./]+$") -> Column:
    """Station reference: last name part of the file name."""
    return F.regexp_extract(path, pattern, 1)


def parse_readings(lines: DataFrame, kind: str, station: Column | None = None) -> DataFrame:
    """`timestamp;value;quality` lines -> readings.

    Header lines start with #. Rows with a bad timestamp are dropped, a value that
    is no number becomes null, a missing quality 0; further columns (rain) are ignored.
    """
    data = lines.where(~F.col("value").startswith("#") & F.col("value").contains(";"))
    f = F.split("value", ";")
    part = lambda i: F.trim(F.get(f, F.lit(i)))
    out = data.select(
        (station if station is not None else station_of_path(F.col("path"))).alias("series_id"), F.lit(kind).alias("kind"),
        F.regexp_replace(part(0), r"Z$", "").try_cast("timestamp_ntz").alias("ts"),
        part(1).try_cast("double").alias("value"), F.coalesce(part(2).try_cast("int"), F.lit(0)).alias("quality_code"))
    return out.where(F.col("ts").isNotNull())


def parse_header(lines: DataFrame, station: Column | None = None) -> DataFrame:
    """`#key;value` lines -> one row per station and key."""
    f = F.split(F.substring_index("value", "#", -1), ";")
    head = lines.where(F.col("value").startswith("#") & F.col("value").contains(";"))
    return head.select((station if station is not None else station_of_path(F.col("path"))).alias("series_id"), F.trim(F.get(f, F.lit(0))).alias("key"), F.trim(F.get(f, F.lit(1))).alias("val"))


def load_series(readings: DataFrame, kind: str, how: str = "mean", freq: str = "15 minutes", bad: Sequence[int] = quality.BAD_CODES, order: str = "seq") -> DataFrame:
    """Mask bad codes, keep the first of equal timestamps, drop negative levels, resample."""
    clean = quality.mask_bad_codes(readings, bad=bad)
    clean = quality.first_per_timestamp(clean.select("series_id", "ts", "value", order), order)
    if kind == "level":
        clean = quality.drop_negative(clean)
    return timegrid.resample(clean, freq, how)


def skip_existing(stations: DataFrame, loaded: DataFrame, key: str = "ref") -> DataFrame:
    """Stations without any ingested reading yet."""
    return stations.join(loaded.select(F.col("series_id").alias(key)).distinct(), key, "left_anti")


def station_subset(stations: DataFrame, wanted: DataFrame | None = None, excluded: DataFrame | None = None, key: str = "ref", skip_tidal: bool = False) -> DataFrame:
    """Named subset of stations, minus an excluded list, optionally without tidal ones."""
    missing = {key, *({"is_tidal"} if skip_tidal else set())} - set(stations.columns)
    if missing:
        raise ValueError(f"station table lacks {sorted(missing)}")
    out = stations if wanted is None else stations.join(wanted.select(key), key, "left_semi")
    out = out if excluded is None else out.join(excluded.select(key), key, "left_anti")
    return out.where(~F.col("is_tidal")) if skip_tidal else out


# ------------------------------------------------------------- result trees
# folders model/seed/horizon, each with or without its name before an equals sign
TREE = r"/(?:[^/=]+=)?([^/=]+)/(?:[^/=]+=)?([^/=]+)/(?:[^/=]+=)?([^/=]+)/[^/]+$"


def _run_keys(df: DataFrame) -> DataFrame:
    p = F.col("_path")
    return df.select(
        "*", F.regexp_extract(p, TREE, 1).alias("model"), F.regexp_extract(p, TREE, 2).try_cast("long").alias("seed"), F.regexp_extract(p, TREE, 3).try_cast("int").alias("horizon")).drop("_path")


def scan_json(spark: SparkSession, root: str, file_name: str, schema: str) -> DataFrame:
    """One JSON object per file in a model/seed/horizon tree."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", file_name).option("multiLine", "true").json(root)
    return _run_keys(df.withColumn("_path", F.input_file_name()))


def scan_csv(spark: SparkSession, root: str, file_name: str, schema: str) -> DataFrame:
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", file_name).option("header", "true").csv(root)
    return _run_keys(df.withColumn("_path", F.input_file_name()))


def load_tree(spark: SparkSession, root: str, metrics: tuple[str, str], nodes: tuple[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs of a result tree that have both of their files: metrics, rows per node, and the keys of runs that lack a file.

    `metrics` and `nodes` are (file name pattern, schema) of the JSON record and of the CSV table of a run.
    """
    keys = ["model", "seed", "horizon"]
    record, table = scan_json(spark, root, *metrics), scan_csv(spark, root, *nodes)
    has_record, has_table = record.select(*keys).distinct().withColumn("has_metrics", F.lit(True)), table.select(*keys).distinct().withColumn("has_nodes", F.lit(True))
    runs = has_record.join(has_table, keys, "full").fillna(False, ["has_metrics", "has_nodes"])
    whole = runs.where("has_metrics and has_nodes").select(*keys)
    return record.join(whole, keys, "left_semi"), table.join(whole, keys, "left_semi"), runs.where("not (has_metrics and has_nodes)")


def load_results(metrics: DataFrame, extended: DataFrame | None = None, keys: Sequence[str] = ("model", "seed", "horizon")) -> DataFrame:
    """Required metrics with optional extended ones; runs without the latter keep nulls."""
    return metrics if extended is None else metrics.join(extended, list(keys), "left")


def merge_tables(parts: Sequence[DataFrame]) -> DataFrame:
    """Periodic files as one table; columns missing in some are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def stack_node_files(rows: DataFrame, nodes: DataFrame, required: Sequence[str], key: str = "ref") -> tuple[DataFrame, DataFrame]:
    """Rows of per-node files joined to their node; rows of unknown nodes or without required values are rejects."""
    joined = rows.join(nodes, key, "left")
    good = F.col("node").isNotNull()
    for c in required:
        good = good & F.col(c).isNotNull()
    return joined.where(good), joined.where(~good).select(key, *required)


def latest_datum(history: DataFrame, key: str = "ref", order: str = "position", value: str = "datum") -> DataFrame:
    """Last non-null value per station."""
    return history.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))


# ------------------------------------------------------------- block files
def read_blocks(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Records between separator lines; the reader splits large files, so no file is one task's work."""
    return spark.read.option("recursiveFileLookup", "true").option("lineSep", separator).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("block"))


def split_blocks(texts: DataFrame, pattern: str, text: str = "text", block: str = "block") -> DataFrame:
    """The same for texts already in a column: one row per block, numbered from 0."""
    rest = [c for c in texts.columns if c != text]
    return texts.select(*rest, F.posexplode(F.split(F.regexp_replace(text, "\r", ""), pattern)).alias("block_no", block))


def parse_station_blocks(blocks: DataFrame, keys: dict[str, str], block: str = "block") -> DataFrame:
    """`Key<TAB>Value` lines of a block -> one row; `keys` maps line keys to columns. Blocks with none of them are left out."""
    rest = [c for c in blocks.columns if c != block]
    pairs = F.map_from_entries(F.transform(
        F.filter(F.split(block, "\n"), lambda x: x.contains("\t")),
        lambda x: F.struct(F.trim(F.substring_index(x, "\t", 1)), F.trim(F.substring_index(x, "\t", -1)))))
    out = blocks.withColumn("_m", pairs).select(*rest, *[F.try_element_at("_m", F.lit(k)).alias(c) for k, c in keys.items()])
    return out.where(F.coalesce(*[F.col(c) for c in keys.values()]).isNotNull())


def parse_sections(blocks: DataFrame, block: str = "block") -> DataFrame:
    """Blocks after a SECTION line -> valid profile points with their section.

    A block is name, chainage, point count and that many point lines; blocks whose header does
    not parse and points with fewer than 6 fields are left out. Each block is parsed on its own.
    """
    rest = [c for c in blocks.columns if c != block]
    lines = F.split(F.regexp_replace(block, "\r", ""), "\n")
    at = lambda i: F.trim(F.get("_l", F.lit(i)))
    head = blocks.withColumn("_l", lines).select(
        *rest, at(0).alias("section"), at(1).try_cast("double").alias("chainage"), at(2).try_cast("int").alias("n_points"), F.slice("_l", 4, F.greatest(F.size("_l"), F.lit(1))).alias("_pts"))
    head = head.where(F.col("chainage").isNotNull() & F.col("n_points").isNotNull())
    pts = head.select(*rest, "section", "chainage", "n_points", F.posexplode("_pts").alias("i", "_line")).where(F.col("i") < F.col("n_points"))
    f = F.split(F.trim("_line"), r"\s+")
    num = lambda i: F.get("_f", F.lit(i)).try_cast("double")
    pts = pts.withColumn("_f", f).where(F.size("_f") >= 6).select(
        *rest, "section", "chainage", "n_points", "i", num(0).alias("dist_m"), num(1).alias("level"), F.rtrim(F.get("_f", F.lit(2)), F.lit("*")).try_cast("double").alias("manning"),
        F.contains(F.get("_f", F.lit(2)), F.lit("*")).alias("panel_boundary"), num(4).alias("coord_e"), num(5).alias("coord_n"))
    return pts.dropna(subset=["dist_m", "level", "manning", "coord_e", "coord_n"])


# ------------------------------------------------------------------- names
def scene_parts(names: DataFrame, name: str = "name") -> DataFrame:
    """Satellite, start time and orbit from a scene name; `valid` is false for names with fewer than 8 parts."""
    stem = F.regexp_replace(name, r"\.[^._]*$", "")
    p = F.split(stem, "_")
    ok = F.size(p) >= 8
    start = F.try_to_timestamp(F.get(p, F.lit(4)), F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz")
    return names.select(
        "*", ok.alias("valid"), F.when(ok, stem).alias("scene_id"), F.when(ok, F.get(p, F.lit(0))).alias("satellite"), F.when(ok, F.get(p, F.lit(6))).alias("orbit"), F.when(ok, start).alias("start_time"))


def file_class(name: Column) -> Column:
    n = F.upper(name)
    return F.when(n.contains("_COG"), "COG").when(n.contains("SLC_"), "SLC").otherwise("GRD")


def event_id(acq_date: Column, scene_id: Column) -> Column:
    """event_<date>_<last four of the first six-digit hex part>, 0000 where there is none."""
    hexa = F.regexp_extract(F.upper(scene_id), r"_([0-9A-F]{6})_", 1)
    return F.concat_ws("_", F.lit("event"), F.date_format(acq_date, "yyyyMMdd"), F.when(hexa == "", "0000").otherwise(F.substring(hexa, -4, 4)))


def registry_rows(scenes: DataFrame, days: int = 3) -> DataFrame:
    """Event rows of scenes; the event window is the acquisition day -3 .. +3 days 23:45."""
    day = F.to_date("start_time")
    return scenes.select(
        event_id(day, F.col("scene_id")).alias("event_id"), day.alias("acquisition_date"), F.date_sub(day, days).cast("timestamp_ntz").alias("event_start"),
        (F.date_add(day, days).cast("timestamp_ntz") + F.expr("interval 1425 minutes")).alias("event_end"), "scene_id", "satellite", "orbit")


def upsert(registry: DataFrame, fresh: DataFrame, key: str = "event_id", order: str = "scene_id") -> DataFrame:
    """Fresh rows replace registered ones of the same key; among fresh ones the last in order stays."""
    cols = registry.columns
    both = registry.withColumn("_age", F.lit(0)).unionByName(fresh.withColumn("_age", F.lit(1)))
    best = both.groupBy(key).agg(F.max_by(F.struct(*[c for c in cols if c != key]), F.struct("_age", order)).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols if c != key])


def upsert_partitions(spark: SparkSession, path: str, fresh: DataFrame, by: Sequence[str], key: str = "event_id", order: str = "scene_id") -> None:
    """`upsert` into a table stored in partitions `by`, rewriting only the partitions that hold a fresh row.

    A key stays in its partition; one that is registered in another one is an error, found before anything is written. The
    merged rows are checkpointed first, so the write reads nothing that it replaces.
    """
    stored = spark.read.parquet(path)
    fresh = cut(fresh.select(*stored.columns))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by]
    met = stored.alias("s").join(fresh.select(key, *by).distinct().alias("f"), F.col(f"s.{key}") == F.col(f"f.{key}"))
    moved = met.where(~reduce(and_, same)).select(f"s.{key}").first()
    if moved is not None:
        raise ValueError(f"{key} {moved[0]} is registered in another partition")
    touched = stored.alias("s").join(fresh.select(*by).distinct().alias("f"), reduce(and_, same), "left_semi").select("s.*")
    write_partitioned(cut(upsert(touched, fresh, key, order)), path, by, mode="overwrite")


def clean_sheet(df: DataFrame) -> DataFrame:
    """Every text column: white space collapsed and trimmed, 'nan' and empty text as null."""
    out = {}
    for f in df.schema:
        if f.dataType.simpleString() == "string":
            c = F.trim(F.regexp_replace(f.name, r"\s+", " "))
            out[f.name] = F.when((c != "") & (F.lower(c) != "nan"), c)
    return df.withColumns(out)


def threshold_map(raw: DataFrame, text: str = "json") -> DataFrame:
    """JSON threshold map -> rows: the map nested under `thresholds`, or the flat object itself."""
    nested = F.from_json(F.get_json_object(text, "$.thresholds"), "map<string,double>")
    flat = F.from_json(text, "map<string,double>")
    return raw.select(F.explode(F.coalesce(nested, flat)).alias("series_id", "bankfull"))

