"""Scans of the file forms that evaluation data comes in, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import require_columns


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_pages(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """Landed JSON pages ``{"activities": [...], "page_meta": {"total_count": n}}``, one row per record with its file and the announced total."""
    meta = T.StructType([T.StructField("total_count", T.LongType())])
    page = T.StructType([T.StructField("activities", T.ArrayType(record)), T.StructField("page_meta", meta)])
    pages = spark.read.schema(page).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    return pages.select("file", F.col("page_meta.total_count").alias("total_count"), F.explode("activities").alias("a")).select("file", "total_count", "a.*")


def read_keyed_json(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """(key, value) of one JSON object; a value is a plain string or an object of which ``field`` counts."""
    whole = spark.read.text(path, wholetext=True)
    pairs = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "raw"))
    return pairs.select("key", F.coalesce(F.get_json_object("raw", f"$.{field}"), F.when(~F.col("raw").startswith("{"), F.col("raw"))).alias("value"))


def read_metrics(spark: SparkSession, paths: list[str], metrics: list[str], split: str = "test_clean") -> DataFrame:
    """One row per run and model of nested metrics documents that have the split; seed and split mode from the run directory's name."""
    values = T.StructType([T.StructField(m, T.DoubleType()) for m in metrics])
    model = T.StructType([T.StructField(split, values), T.StructField("selected_model", T.StringType())])
    document = T.StructType([T.StructField("dataset", T.StringType()), T.StructField("split_mode", T.StringType()), T.StructField("models", T.MapType(T.StringType(), model))])
    found = spark.read.schema(document).option("multiLine", True).json(list(dict.fromkeys(paths))).withColumn("run_dir", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    rows = found.select("run_dir", "dataset", "split_mode", F.explode("models").alias("model", "m")).where(F.col(f"m.{split}").isNotNull())
    seed = F.nullif(F.regexp_extract("run_dir", r"_s(\d+)(?:_|$)", 1), F.lit("")).cast("int")
    return rows.select("run_dir", seed.alias("seed"), "dataset", "split_mode", "model", F.col("m.selected_model").alias("selected_model"), *[F.col(f"m.{split}.{n}").alias(n) for n in metrics])


def read_predictions(spark: SparkSession, files: dict[str, str], schema: T.StructType | str, header: DataFrame | None = None) -> DataFrame:
    """Prediction files by metric split (name -> glob), with metric_split and run_dir; a header of one row per run_dir is joined if given."""
    out = None
    for split, path in files.items():
        part = read_csv(spark, path, schema).withColumns({"metric_split": F.lit(split), "run_dir": F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)})
        out = part if out is None else out.unionByName(part)
    return out if header is None else out.join(header, "run_dir", "left")


def read_benchmark(spark: SparkSession, path: str, schema: T.StructType | str, row_id: str = "sample_id") -> DataFrame:
    """A benchmark table; raises if it lacks the row id."""
    return require_columns(read_csv(spark, path, schema), row_id)


def read_flat_metrics(spark: SparkSession, path: str, schema: T.StructType, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with every required field, and the (file, raw) of the others, malformed documents included."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    parsed = whole.withColumn("d", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    good = F.lit(True)
    for r in required:
        good = good & F.coalesce(F.col(f"d.{r}").isNotNull(), F.lit(False))
    return parsed.where(good).select("file", "d.*"), parsed.where(~good).select("file", F.col("value").alias("raw"))


def list_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """path, length, modificationTime and, if asked for, the SHA-256 of files under a glob; contents are read only for the digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "modificationTime", *([F.sha2("content", 256).alias("sha256")] if digest else []))


def row_counts(spark: SparkSession, path: str) -> DataFrame:
    """path and rows (lines) of text files under a glob; files without lines are absent."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"))


def complete_runs(files: DataFrame, required: list[str]) -> DataFrame:
    """Run directories that hold all required file names, with total size and the seconds between first and last write."""
    named = files.withColumn("run_dir", F.regexp_extract("path", r"^(.*)/[^/]+$", 1)).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    span = F.max(F.unix_micros("modificationTime")) - F.min(F.unix_micros("modificationTime"))
    per = named.groupBy("run_dir").agg(F.collect_set("name").alias("names"), F.sum("length").alias("bytes"), (span / 1e6).alias("write_seconds"))
    return per.where(F.size(F.array_except(F.array(*[F.lit(r) for r in required]), "names")) == 0)


def read_splits(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """All ``{mode}_{part}.csv`` files of modes that have train, val and test, with columns mode and split."""
    rows = read_csv(spark, f"{folder}/*_*.csv", schema).withColumn("__f", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1))
    rows = rows.withColumn("mode", F.regexp_extract("__f", r"^(.*)_(train|val|test)$", 1)).withColumn("split", F.regexp_extract("__f", r"_(train|val|test)$", 1)).where("split <> ''").drop("__f")
    whole = rows.select("mode", "split").distinct().groupBy("mode").count().where("count = 3").select("mode")
    return rows.join(whole, "mode", "left_semi")


def renamed(df: DataFrame, names: dict[str, str], required: list[str]) -> DataFrame:
    """Columns under canonical names; raises if one is missing."""
    return require_columns(df.withColumnsRenamed(names), *required)


def union_tables(frames: list[DataFrame], columns: list[str]) -> DataFrame:
    """Distinct rows of several summary tables; absent columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*columns).dropDuplicates()


def write_splits(df: DataFrame, path: str, mode: str = "split_mode") -> None:
    """One folder per split mode and part."""
    df.write.mode("overwrite").partitionBy(mode, "split").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def missing_work(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What of an expected grid is not done yet."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")
