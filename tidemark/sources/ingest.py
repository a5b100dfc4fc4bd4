"""Incremental CSV ingest: find files, detect changes, check and type rows, append to the raw tables.

Raw rows carry the file they came from and the run that wrote them. Readers keep only rows whose
(file, run) is the latest in the registry, so a changed file replaces its old rows and rows of a run that
died before registering are never seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions.scalars import date_text
from tidemark.operators.panel import latest
from tidemark.session import stage
from tidemark.sources.schemas import DATASETS, FILE_PER_SYMBOL, NULL_TEXT, SINGLE, SPARK_TYPES, Dataset

REGISTRY_SCHEMA = (
    "dataset string, source_path string, filename string, md5 string, modified_time timestamp, file_size bigint, "
    "row_count bigint, trade_date_min string, trade_date_max string, raw_path string, status string, "
    "last_ingest_time timestamp, run_id string"
)
FILE_COLUMN, RUN_COLUMN = "_source_path", "_run_id"
VERSION_SCHEMA = (
    "data_version string, created_at timestamp, agent string, new_trade_dates bigint, new_files bigint, modified_files bigint"
)


# --- discovery --------------------------------------------------------------------------------------


def _read_or_none(spark: SparkSession, build) -> DataFrame | None:
    try:
        return build()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def file_entries(files: DataFrame, dataset: Dataset) -> DataFrame:
    """Whole-file rows as (dataset, source_path, filename, md5, modified_time, file_size, header)."""
    first_line = F.regexp_extract(F.decode("content", "UTF-8"), r"^\x{FEFF}?([^\r\n]*)", 1)
    return files.select(
        F.lit(dataset.name).alias("dataset"),
        F.col("path").alias("source_path"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        F.md5("content").alias("md5"),
        F.col("modificationTime").alias("modified_time"),
        F.col("length").alias("file_size"),
        first_line.alias("header"),
    )


#: A file changed so shortly before it was registered may have been changed again within the clock's grain.
_GRAIN = "INTERVAL 2 SECONDS"


def _unlike_registered(files: DataFrame, registry: DataFrame) -> list[str]:
    """Paths of listed files whose size or full modification time differ from their latest registered version, or whose
    registration followed their change within the clock's grain.

    Only the listing is looked at (the scan reads no content); the driver's file index holds the same paths.
    """
    settled = F.col("last_ingest_time") - F.col("modified_time") > F.expr(_GRAIN)
    known = current_files(registry).where(settled).select("source_path", "modified_time", "file_size")
    listed = files.select(F.col("path").alias("source_path"), F.col("modificationTime").alias("modified_time"), F.col("length").alias("file_size"))
    return [r[0] for r in listed.join(known, ["source_path", "modified_time", "file_size"], "left_anti").select("source_path").collect()]


def discover(spark: SparkSession, root: str, datasets: Sequence[Dataset] | None = None, registry: DataFrame | None = None) -> DataFrame:
    """The source files with name, md5, time, size and header line; missing datasets are skipped.

    With a ``registry``, files that have the size and time of their latest registered version are left out unread.
    Daily files are small; each is read whole by one task for its checksum.
    """
    found = spark.createDataFrame(
        [], "dataset string, source_path string, filename string, md5 string, modified_time timestamp, file_size bigint, header string"
    )
    for d in datasets if datasets is not None else DATASETS.values():
        reader = spark.read.format("binaryFile")
        if d.layout != SINGLE:
            reader = reader.option("pathGlobFilter", "*.csv")
        files = _read_or_none(spark, lambda: reader.load(f"{root}/{d.path}"))
        if files is None:
            continue
        if registry is not None:
            paths = _unlike_registered(files, registry.where((F.col("dataset") == d.name) & (F.col("status") == "ingested")))
            if not paths:
                continue
            files = spark.read.format("binaryFile").load(paths)
        found = found.unionByName(file_entries(files, d))
    return found


def date_from_filename(filename: Column) -> Column:
    """The eight digits of YYYYMMDD.csv, else null."""
    return F.nullif(F.regexp_extract(filename, r"^(\d{8})\.csv$", 1), F.lit(""))


def current_files(registry: DataFrame) -> DataFrame:
    """The latest registry row of every file."""
    return latest(registry, ["source_path"], ["last_ingest_time", "md5"])


def changes(found: DataFrame, registry: DataFrame) -> DataFrame:
    """Found files that are new or whose content differs from the latest registered one."""
    known = latest(
        registry.select("source_path", "md5", "last_ingest_time"), ["source_path"], ["last_ingest_time", "md5"]
    ).select("source_path", F.col("md5").alias("known_md5"))
    change = F.when(F.col("known_md5").isNull(), "new").when(F.col("known_md5") != F.col("md5"), "modified")
    return (
        found.join(known, "source_path", "left")
        .withColumn("change", change)
        .where(F.col("change").isNotNull())
        .drop("known_md5")
    )


# --- reading, checking, typing ----------------------------------------------------------------------


def plain_path(encoded: Column) -> Column:
    """A metadata path without its percent encoding, as the file listing shows it."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def read_csv(spark: SparkSession, files: Sequence[tuple[str, str]], dataset: Dataset) -> DataFrame:
    """Rows of CSV files as text, plus their file path; ``files`` are (path, header line) pairs.

    Files are read together per header line, so columns are matched by name whatever their order.
    """
    by_header: dict[str, list[str]] = {}
    for path, header in files:
        by_header.setdefault(header, []).append(path)
    out = None
    for header, paths in by_header.items():
        names = [c.strip().strip('"') for c in header.split(",")]
        check_columns(names, dataset.columns, paths[0], dataset)
        schema = ", ".join(f"`{c}` string" for c in names)
        rows = spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(paths)
        rows = rows.select(
            *[F.when(~F.col(f"`{c}`").isin(NULL_TEXT), F.col(f"`{c}`")).alias(c) for c in names],
            plain_path(F.col("_metadata.file_path")).alias(FILE_COLUMN),
            F.col("_metadata.file_name").alias("_file_name"),
        )
        if dataset.date_from == "filename" and "trade_date" not in names:
            rows = rows.withColumn("trade_date", date_from_filename(F.col("_file_name")))
        rows = rows.drop("_file_name")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def check_columns(names: Sequence[str], expected: dict[str, str], path: str, dataset: Dataset | None = None, strict: bool = False) -> None:
    """Missing columns are an error, unexpected ones only with ``strict``."""
    given = set(names)
    if dataset is not None and dataset.date_from == "filename":
        given.add("trade_date")
    missing, extra = sorted(set(expected) - given), sorted(given - set(expected))
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    if strict and extra:
        raise ValueError(f"{path}: unexpected columns {extra}")


def _misfits(rows: DataFrame, schema: dict[str, str], file_column: str) -> DataFrame:
    """(file, column_name, value, expected_type) of every text value that does not fit its column's type."""
    unknown = sorted(set(schema.values()) - set(SPARK_TYPES))
    if unknown:
        raise ValueError(f"unsupported types {unknown}")
    checked = [c for c, t in schema.items() if t != "string" and c in rows.columns]
    long = rows.select(file_column, *[F.col(c).cast("string").alias(c) for c in checked]).unpivot(
        [file_column], checked, "column_name", "value"
    )
    typed = F.create_map(*[F.lit(x) for c in checked for x in (c, schema[c])])
    number = F.col("value").try_cast("double")
    kind = F.col("expected_type")
    bad = (
        F.when(kind == "numeric", number.isNull())
        .when(kind == "integer", number.isNull() | (number % 1 != 0))
        .otherwise(~F.regexp_replace("value", r"\.0$", "").rlike(r"^\d{8}$"))
    )
    return long.where(F.col("value").isNotNull()).withColumn("expected_type", typed[F.col("column_name")]).where(bad)


def violation_counts(rows: DataFrame, schema: dict[str, str], file_column: str = "source_path") -> DataFrame:
    """How many values of each file and column do not fit."""
    return _misfits(rows, schema, file_column).groupBy(file_column, "column_name", "expected_type").agg(F.count(F.lit(1)).alias("bad_values"))


def violations(rows: DataFrame, schema: dict[str, str], per_column: int = 5, file_column: str = "source_path") -> DataFrame:
    """Values that do not fit, for a message: the least ``per_column`` of each file and column."""
    # the rank filter becomes a group limit, so each task passes on at most per_column rows of a group
    least = Window.partitionBy(file_column, "column_name").orderBy("value")
    return (
        _misfits(rows, schema, file_column)
        .withColumn("place", F.row_number().over(least))
        .where(F.col("place") <= per_column)
        .select(file_column, "column_name", "expected_type", "value", "place")
    )


def enforce_types(rows: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Cast text columns to their types, null where a value does not fit."""
    casts = {}
    for c, kind in schema.items():
        if c not in rows.columns:
            continue
        if kind == "date_yyyymmdd":
            casts[c] = date_text(c)
        elif kind == "integer":
            number = F.col(c).try_cast("double")
            casts[c] = F.coalesce(F.col(c).try_cast("bigint"), F.when(number % 1 == 0, number.try_cast("bigint")))
        else:
            casts[c] = F.col(c).try_cast(SPARK_TYPES[kind])
    return rows.withColumns(casts)


def file_bounds(rows: DataFrame, date_column: str, file_column: str = "source_path") -> DataFrame:
    """Row count and date range per file."""
    return rows.groupBy(file_column).agg(
        F.count(F.lit(1)).alias("row_count"), F.min(date_column).alias("trade_date_min"), F.max(date_column).alias("trade_date_max")
    )


def latest_version(bounds: DataFrame) -> DataFrame:
    """'v' + the greatest well-formed date of the files."""
    valid = bounds.where(F.col("trade_date_max").rlike(r"^\d{8}$"))
    return valid.agg(F.concat(F.lit("v"), F.max("trade_date_max")).alias("data_version"))


# --- registry and raw tables ------------------------------------------------------------------------


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry; columns an older file lacks come as null, a missing registry is empty."""
    empty = spark.createDataFrame([], REGISTRY_SCHEMA)
    table = _read_or_none(spark, lambda: spark.read.option("mergeSchema", True).parquet(path))
    return empty if table is None else empty.unionByName(table, allowMissingColumns=True).select(*empty.columns)


def read_raw(spark: SparkSession, raw_root: str, registry: DataFrame, dataset: str) -> DataFrame:
    """The raw rows of a dataset, each file in its latest registered version only."""
    current = current_files(registry.where((F.col("dataset") == dataset) & (F.col("status") == "ingested")))
    rows = _read_or_none(spark, lambda: spark.read.option("mergeSchema", True).parquet(f"{raw_root}/{dataset}"))
    if rows is None:
        raise ValueError(f"no raw rows of {dataset}")
    partition = DATASETS[dataset].partition
    if partition:  # partition values come back inferred; they are text
        rows = rows.withColumn(partition, F.col(partition).cast("string"))
    keep = current.select(F.col("source_path").alias(FILE_COLUMN), F.col("run_id").alias(RUN_COLUMN))
    return rows.join(keep, [FILE_COLUMN, RUN_COLUMN], "left_semi")


def raw_files(spark: SparkSession, raw_root: str, dataset: str) -> DataFrame:
    """(trade_date, dataset, modified_time) of a dated raw table's files."""
    rows = spark.read.parquet(f"{raw_root}/{dataset}")
    return (
        rows.select(F.col("trade_date").cast("string").alias("trade_date"), F.col("_metadata.file_modification_time").alias("t"))
        .groupBy("trade_date")
        .agg(F.max("t").alias("modified_time"))
        .withColumn("dataset", F.lit(dataset))
    )


def ingest_dataset(
    spark: SparkSession,
    dataset: Dataset,
    found: DataFrame,
    raw_root: str,
    registry_path: str,
    run_id: str | None = None,
    dry_run: bool = False,
) -> DataFrame:
    """Append the changed files of one dataset and register them; returns their registry rows.

    The file list is metadata. Any value that does not fit its type stops the run before data is written;
    the registry is appended last, so an interrupted run leaves nothing visible.
    """
    run_id = run_id or uuid.uuid4().hex
    registry = read_registry(spark, registry_path)
    # the listing is read once: the same files are then parsed and registered
    changed = stage(changes(found.where(F.col("dataset") == dataset.name), registry), f"changed-{dataset.name}")
    files = [(r["source_path"], r["header"]) for r in changed.select("source_path", "header").collect()]
    empty = spark.createDataFrame([], REGISTRY_SCHEMA)
    if not files:
        return empty
    entry = changed.select(
        "dataset", "source_path", "filename", "md5", "modified_time", "file_size", F.lit(f"{raw_root}/{dataset.name}").alias("raw_path"),
        F.lit("dry_run" if dry_run else "ingested").alias("status"), F.current_timestamp().alias("last_ingest_time"),
        F.lit(run_id).alias("run_id"),
    )
    named = date_from_filename(F.col("filename"))
    if dry_run:
        bound = named if dataset.date_from == "filename" else F.lit(None).cast("string")
        planned = entry.withColumns({"row_count": F.lit(None).cast("bigint"), "trade_date_min": bound, "trade_date_max": bound})
        return planned.select(*empty.columns)
    # parsed once: checks, typed rows and bounds read the stored table
    text = stage(read_csv(spark, files, dataset), f"text-{dataset.name}")
    bad = violations(text, dataset.columns, file_column=FILE_COLUMN).limit(5).collect()
    if bad:
        shown = [(r[FILE_COLUMN], r["column_name"], r["expected_type"], r["value"]) for r in bad]
        raise ValueError(f"values of {dataset.name} do not fit: {shown}")
    rows = enforce_types(text, dataset.columns).withColumn(RUN_COLUMN, F.lit(run_id))
    if dataset.layout == FILE_PER_SYMBOL:
        rows = rows.withColumn("ts_code", F.coalesce("ts_code", F.regexp_extract(FILE_COLUMN, r"([^/]+)\.csv$", 1)))
    writer = rows.write.mode("append")
    if dataset.partition:
        writer = writer.partitionBy(dataset.partition)
    writer.parquet(f"{raw_root}/{dataset.name}")
    if dataset.date_column in rows.columns:
        bounds = file_bounds(rows, dataset.date_column, FILE_COLUMN)
    else:
        bounds = file_bounds(rows.withColumn("_none", F.lit(None).cast("string")), "_none", FILE_COLUMN)
    done = entry.join(bounds.withColumnRenamed(FILE_COLUMN, "source_path"), "source_path", "left").withColumn(
        "row_count", F.coalesce("row_count", F.lit(0).cast("bigint"))
    )
    if dataset.date_from == "filename":
        done = done.withColumns({"trade_date_min": named, "trade_date_max": named})
    done = stage(done.select(*empty.columns), f"registry-{dataset.name}")
    done.write.mode("append").parquet(registry_path)
    return done


def ingest_all(
    spark: SparkSession,
    source_root: str,
    raw_root: str,
    registry_path: str,
    datasets: Sequence[Dataset] | None = None,
    dry_run: bool = False,
    check_content: bool = True,
) -> DataFrame:
    """Ingest every changed file of the datasets; returns the registry rows written (or planned).

    Every file is read and compared by checksum. With ``check_content=False`` only the listing is read at first: files with the size and
    full modification time of their registered version count as unchanged, which misses a revision of equal length that was given the old
    time back.
    """
    chosen = list(datasets if datasets is not None else DATASETS.values())
    registry = None if check_content else read_registry(spark, registry_path)
    found = stage(discover(spark, source_root, chosen, registry), "found")
    run_id = uuid.uuid4().hex
    out = spark.createDataFrame([], REGISTRY_SCHEMA)
    for d in chosen:
        out = out.unionByName(ingest_dataset(spark, d, found, raw_root, registry_path, run_id, dry_run))
    return out


def run_summary(written: DataFrame, earlier: DataFrame) -> DataFrame:
    """Files new and modified, rows, and distinct dates of one run."""
    seen = earlier.select("source_path").distinct().withColumn("_seen", F.lit(True))
    return written.join(seen, "source_path", "left").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("_seen").isNull()).alias("new_files"),
        F.count_if(F.col("_seen").isNotNull()).alias("modified_files"),
        F.count_distinct("trade_date_max").alias("new_trade_dates"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("ingested_rows"),
    )


def append_version(summary: DataFrame, version: str, path: str) -> None:
    summary.select(
        F.lit(version).alias("data_version"), F.current_timestamp().alias("created_at"), F.lit("ingestion").alias("agent"),
        "new_trade_dates", "new_files", "modified_files",
    ).write.mode("append").parquet(path)


def sample_files(found: DataFrame, per_dataset: int) -> DataFrame:
    """The first ``per_dataset`` files of each dataset by path; all with a negative number."""
    if per_dataset < 0:
        return found
    order = Window.partitionBy("dataset").orderBy("source_path")
    return found.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_dataset).drop("_k")
