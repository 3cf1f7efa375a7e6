"""GTFS feeds: import, validation, merging of datasets, dense ids, and table sinks."""

from __future__ import annotations

import shutil
import tempfile
import uuid
import zipfile
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from perron.functions.transit import DAYS, gtfs_time_ms, service_date
from perron.operators.prefix import prefix_sums
from perron.sources.config import Config, Dataset
from perron.sources.events_timetable import Timetable
from perron.staging import delete, run_dir, stage

REQUIRED = ("calendar", "stops", "trips", "stop_times")


class MissingFile(Exception):
    """A feed lacks a required table."""


class InvalidFeed(Exception):
    """A feed has values that cannot be read."""


class UnsupportedFormat(Exception):
    """A dataset has a format that isn't imported."""


def fetch(location: str, folder: str, headers: dict[str, str] | None = None) -> str:
    """A feed's local path: a URL is downloaded to ``folder`` (with the given headers), a path is passed through."""
    if "://" not in location:
        return location
    import urllib.request

    target = str(Path(folder) / f"{uuid.uuid4().hex}.zip")
    request = urllib.request.Request(location, headers=headers or {})
    with urllib.request.urlopen(request) as response, open(target, "wb") as out:
        shutil.copyfileobj(response, out)
    return target


def extract(spark: SparkSession, path: str) -> dict[str, str]:
    """The feed's tables as files in the shared folder, which executors can read."""
    target = f"{run_dir(spark)}/gtfs-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    with zipfile.ZipFile(path) as z, tempfile.TemporaryDirectory() as local:
        names = {Path(n).stem: n for n in z.namelist() if n.endswith(".txt")}
        if missing := [t for t in REQUIRED if t not in names]:
            raise MissingFile(", ".join(missing))
        for table in REQUIRED:
            member = z.extract(names[table], local)
            fs.copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(member), jvm.org.apache.hadoop.fs.Path(f"{target}/{table}.txt"))
    return {t: f"{target}/{t}.txt" for t in REQUIRED}


def import_gtfs(spark: SparkSession, path: str, dataset_id: str) -> dict[str, DataFrame]:
    """The four tables of a feed with typed columns, tagged with the dataset."""
    return import_tables(spark, extract(spark, path), dataset_id)


def import_tables(spark: SparkSession, files: dict[str, str], dataset_id: str) -> dict[str, DataFrame]:
    """The same from extracted files. All columns are read as strings by the header and cast by name;
    other columns fall away."""
    raw = {t: spark.read.csv(f, header=True, encoding="UTF-8", mode="PERMISSIVE") for t, f in files.items()}
    tag = F.lit(dataset_id).alias("dataset_id")
    return {
        "services": raw["calendar"].select(
            tag, F.col("service_id").alias("service_id_in_dataset"), *[(F.col(d).try_cast("int") == 1).alias(d) for d in DAYS], service_date(F.col("start_date")).alias("start_date"), service_date(F.col("end_date")).alias("end_date")
        ),
        "stops": raw["stops"].select(tag, F.col("stop_id").alias("stop_id_in_dataset"), F.col("stop_lat").try_cast("double").alias("lat"), F.col("stop_lon").try_cast("double").alias("lon")),
        "trips": raw["trips"].select(tag, F.col("trip_id").alias("trip_id_in_dataset"), F.col("route_id").alias("route_id_in_dataset"), F.col("service_id").alias("service_id_in_dataset")),
        "stop_times": raw["stop_times"].select(
            tag, F.col("trip_id").alias("trip_id_in_dataset"), F.col("stop_id").alias("stop_id_in_dataset"), gtfs_time_ms(F.col("arrival_time")).alias("arrival_time"), gtfs_time_ms(F.col("departure_time")).alias("departure_time"), F.col("stop_sequence").try_cast("int").alias("stop_sequence")
        ),
    }


def validation_report(feed: dict[str, DataFrame]) -> DataFrame:
    """(rule, rows): how many rows break each rule; a feed is valid if all are 0."""
    st, stops, trips = feed["stop_times"], feed["stops"], feed["trips"]
    count = lambda df, rule: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(rule).alias("rule"), "rows")
    parts = [
        count(st.where("arrival_time IS NULL OR departure_time IS NULL"), "unreadable time"),
        count(st.where("departure_time < arrival_time"), "departure before arrival"),
        count(st.where("stop_sequence IS NULL"), "unreadable stop sequence"),
        count(st.join(stops, ["dataset_id", "stop_id_in_dataset"], "left_anti"), "unknown stop"),
        count(st.join(trips, ["dataset_id", "trip_id_in_dataset"], "left_anti"), "unknown trip"),
        count(trips.join(feed["services"], ["dataset_id", "service_id_in_dataset"], "left_anti"), "unknown service"),
        count(stops.where("lat IS NULL OR lon IS NULL OR abs(lat) > 90 OR abs(lon) > 180"), "bad coordinate"),
        count(feed["services"].where("start_date IS NULL OR end_date IS NULL OR end_date < start_date"), "bad service dates"),
        count(st.groupBy("dataset_id", "trip_id_in_dataset", "stop_sequence").count().where("count > 1"), "repeated stop sequence"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge(feeds: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Datasets under each other; rows keep their dataset's tag."""
    if not feeds:
        raise InvalidFeed("no valid dataset")
    out = dict(feeds[0])
    for f in feeds[1:]:
        out = {t: out[t].unionByName(f[t]) for t in out}
    return out


def dense_ids(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with a dense id from 0 in the order of ``keys``, without a single-partition window."""
    return prefix_sums(df, keys, [], name).withColumn(name, F.col(name).cast("int"))


def simplify(feed: dict[str, DataFrame]) -> Timetable:
    """Dense ids for source ids; stops that no stop time uses go."""
    stop_key, trip_key, service_key = (["dataset_id", f"{k}_id_in_dataset"] for k in ("stop", "trip", "service"))
    used = feed["stops"].join(feed["stop_times"], stop_key, "left_semi")
    stops, trips, services = dense_ids(used, stop_key, "stop_id"), dense_ids(feed["trips"], trip_key, "trip_id"), dense_ids(feed["services"], service_key, "service_id")
    stop_times = (
        feed["stop_times"].join(stops.select(*stop_key, "stop_id"), stop_key).join(trips.select(*trip_key, "trip_id"), trip_key).select("trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time")
    )
    trips = trips.join(services.select(*service_key, "service_id"), service_key).select("route_id_in_dataset", "trip_id", "service_id")
    return Timetable(stops.select("stop_id", "lat", "lon"), trips, services.drop(*service_key), stop_times)


def preprocess(spark: SparkSession, locations: dict[str, str]) -> Timetable:
    """Fetch, import, validate, merge, simplify; invalid datasets are skipped."""
    return preprocess_config(spark, Config(tuple(Dataset(i, x) for i, x in locations.items()), {}))


def preprocess_config(spark: SparkSession, config: Config, folder: str | None = None) -> Timetable:
    """The timetable of a configuration's datasets.

    A dataset is fetched with its headers, imported, validated unless the configuration turns that
    off, and skipped if it lacks a table or breaks a rule; no valid dataset at all is an error, as is
    a format other than gtfs. With ``folder`` the four tables are written there as Parquet, else to
    the shared folder. Downloads and extracted files are removed whether it succeeds or not.
    """
    if odd := [d.id for d in config.datasets if d.format != "gtfs"]:
        raise UnsupportedFormat(", ".join(odd))
    extracted: list[str] = []
    try:
        feeds = []
        with tempfile.TemporaryDirectory() as local:
            for d in config.datasets:
                try:
                    files = extract(spark, fetch(d.location, local, d.headers))
                except MissingFile:
                    continue
                extracted.append(files["stops"].rpartition("/")[0])
                feeds.append(import_tables(spark, files, d.id))
        valid = [f for f in feeds if not config.validate or not validation_report(f).where("rows > 0").limit(1).count()]
        found = simplify(merge(valid))
        tables = {n: getattr(found, n) for n in ("stops", "trips", "services", "stop_times")}
        if folder is None:
            return Timetable(**{n: stage(df, n) for n, df in tables.items()})
        for n, df in tables.items():
            write_table(df, f"{folder}/{n}.parquet")
        return Timetable(**{n: spark.read.parquet(f"{folder}/{n}.parquet") for n in tables})
    finally:
        for path in extracted:
            delete(spark, path)


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, its types inferred."""
    return spark.read.csv(path, header=True, inferSchema=True)


IPC_ROWS = 10_000


def _write_ipc(df: DataFrame, path: str, schema: pa.Schema) -> None:
    """Rows come to the driver a partition at a time and are written in batches, so its memory is bounded
    by a partition, not by the table."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    rows = df.toLocalIterator()
    with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, schema) as w:
        while part := [r.asDict(recursive=True) for r in islice(rows, IPC_ROWS)]:
            w.write_batch(pa.RecordBatch.from_pylist(part, schema=schema))


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Parquet or CSV (with header), in folders by the columns of ``partition_by``, or one Arrow IPC file."""
    if kind == "ipc":
        return _write_ipc(df, path, to_arrow_schema(df.schema))
    writer = df.write.mode("overwrite").partitionBy(*(partition_by or []))
    writer.parquet(path) if kind == "parquet" else writer.option("header", True).csv(path)


def write_lines(df: DataFrame, path: str, points: str = "points") -> None:
    """An Arrow IPC file of line strings: ``points(lon, lat)`` becomes the column ``geometry`` of x and y,
    marked as the GeoArrow extension type; other columns stay."""
    shaped = df.select(*[F.col(f"`{c}`") for c in df.columns if c != points], F.transform(points, lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))).alias("geometry"))
    plain = to_arrow_schema(shaped.schema)
    line = pa.field("geometry", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])), metadata={"ARROW:extension:name": "geoarrow.linestring", "ARROW:extension:metadata": "{}"})
    _write_ipc(shaped, path, plain.set(plain.get_field_index("geometry"), line))
