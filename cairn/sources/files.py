"""Reading, writing and merging of exported rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import fresh_path


STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_jsonl(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).option("timestampNTZFormat", STAMP).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType, source: str | None = "source_file") -> DataFrame:
    """Rows of JSON lines; lines that don't parse are left out, and each row names its file."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("timestampNTZFormat", STAMP).json(path)
    return rows.withColumn(source, F.input_file_name()) if source else rows


def through_jsonl(df: DataFrame) -> DataFrame:
    """df written as JSON lines and read again with its schema."""
    path = fresh_path(df.sparkSession)
    write_jsonl(df, path)
    return read_jsonl(df.sparkSession, path, df.schema, None)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each data file, of at most 2 GB each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def export_table(df: DataFrame, path: str, columns: Sequence[str], task: str, private: Column) -> tuple[DataFrame, DataFrame]:
    """Writes columns of df as JSON lines. → (counts: task, n, n_private for each task, as a dry run would count them; files: path, bytes, sha256)."""
    counts = df.groupBy(F.col(task).alias("task")).agg(F.count("*").alias("n"), F.count_if(private).alias("n_private"))
    write_jsonl(df.select(*columns), path)
    return counts, file_hashes(df.sparkSession, path)


def export_with_manifest(df: DataFrame, path: str, columns: Sequence[str], task: str, private: Column) -> DataFrame:
    """export_table in two phases: data below path/data by Spark's committer, which shows a task's files only when the job has ended; then path/manifest with their hashes. An export without a manifest did not end and counts as none."""
    _, hashes = export_table(df, f"{path}/data", columns, task, private)
    hashes.write.mode("error").parquet(f"{path}/manifest")
    return df.sparkSession.read.parquet(f"{path}/manifest")


def rescrubbed(spark: SparkSession, path: str, out: str, schema: StructType, scrub: dict[str, object]) -> DataFrame:
    """An export's JSON lines scrubbed again → (file, n_rows, violations, column, row): a row for each file, with a violating row's column and text.

    scrub: column → function of a column that a clean text passes unchanged. Files with hits are written anew, scrubbed, below
    `out`, named by their file; clean ones are not touched, and of all rows only those of files with hits are read twice.
    """
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("timestampNTZFormat", STAMP).option("recursiveFileLookup", "true").json(path).withColumn("_file", F.input_file_name())
    hits = {c: F.coalesce(f(F.col(c)) != F.col(c), F.lit(False)) for c, f in scrub.items()}
    n = sum((h.cast("int") for h in hits.values()), F.lit(0))
    where = F.coalesce(*(F.when(h, F.lit(c)) for c, h in hits.items()))
    line = F.to_json(F.struct(*(F.col(f"`{c}`") for c in schema.fieldNames())))
    first = F.min(F.when(n > 0, F.struct(line.alias("line"), where.alias("column"))))
    report = rows.groupBy(F.col("_file").alias("file")).agg(F.count("*").alias("n_rows"), F.sum(n).alias("violations"), first.alias("f"))
    stored_report = f"{out}/report"
    report.select("file", "n_rows", "violations", "f.column", F.col("f.line").alias("row")).write.parquet(stored_report)
    done = spark.read.parquet(stored_report)
    dirty = rows.join(done.where("violations > 0").select(F.col("file").alias("_file")), "_file", "left_semi")
    clean = dirty.select(F.element_at(F.split("_file", "/"), -1).alias("name"), *(scrub[c](F.col(c)).alias(c) if c in scrub else F.col(c) for c in schema.fieldNames()))
    clean.write.partitionBy("name").option("timestampNTZFormat", STAMP).json(f"{out}/data")
    return done


def verified(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """manifest(path, sha256) → (path, ok): whether the file is still there with that hash."""
    now = file_hashes(spark, path).select("path", F.col("sha256").alias("_now"))
    return manifest.join(now, "path", "left").select("path", F.coalesce(F.col("sha256") == F.col("_now"), F.lit(False)).alias("ok"))


def write_batch(df: DataFrame, path: str, time: str = "time") -> None:
    """Appends rows to a table partitioned by day."""
    df.withColumn("day", F.to_date(time)).write.mode("append").partitionBy("day").parquet(path)


def imported(new: DataFrame, old: DataFrame, keys: Sequence[str], mode: str) -> DataFrame:
    """skip: new rows whose key is not in old; overwrite: old with new in place of rows of the same key; error: fails if a key is in both."""
    if mode == "skip":
        return new.join(old.select(*keys), list(keys), "left_anti")
    if mode == "error":
        hit = new.join(old.select(*keys), list(keys), "left_semi").limit(1).count()
        if hit:
            raise ValueError("a key exists already")
        return old.unionByName(new)
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def retained(df: DataFrame, order: Sequence[Column], size: str, most: int, most_size: float, fresh: Column | None = None, pinned: Column | None = None) -> DataFrame:
    """The newest `most` rows that are fresh, as far as their sizes together fit; pinned rows stay besides."""
    stays = df.where(pinned) if pinned is not None else None
    rest = df.where(~pinned) if pinned is not None else df
    newest = rest.where(fresh) if fresh is not None else rest
    newest = newest.orderBy(*order).limit(most).withColumn("_s", F.sum(size).over(Window.orderBy(*order))).where(F.col("_s") <= most_size).drop("_s")  # `most` rows
    return newest.unionByName(stays) if stays is not None else newest


def resolved(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs(name, file, package[, import_path]) with target and confidence, the first that fits: the least id of that name in the same file 1.0, in the same package 0.9, the only one of its name 0.5; of a file whose path ends with the import 0.7; else null. symbols(id, name, file, package)."""
    low = lambda *keys: symbols.groupBy(*keys).agg(F.min("id").alias("_" + keys[-1]))
    only = symbols.groupBy("name").agg(F.min("id").alias("_only"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    out = refs.join(low("name", "file"), ["name", "file"], "left").join(low("name", "package"), ["name", "package"], "left").join(only, "name", "left")
    target, score = ["_file", "_package", "_only"], F.when(F.col("_file").isNotNull(), 1.0).when(F.col("_package").isNotNull(), 0.9).when(F.col("_only").isNotNull(), 0.5)
    if "import_path" in refs.columns:
        # both meet by their last segment, so that only files of that name are held against the whole path
        last = lambda c: F.element_at(F.split(c, "/"), -1)
        wanted = refs.select("import_path").distinct().withColumn("_clean", F.regexp_replace("import_path", r"^['\"]|['\"]$|^\.\.?/", ""))
        files = symbols.groupBy("file").agg(F.min("id").alias("_id"))
        met = wanted.join(files, last(F.col("_clean")) == last(F.col("file"))).where((F.col("file") == F.col("_clean")) | F.col("file").endswith(F.concat(F.lit("/"), F.col("_clean"))))
        out = out.join(met.groupBy("import_path").agg(F.min("_id").alias("_import")), "import_path", "left")
        target, score = [*target, "_import"], score.when(F.col("_import").isNotNull(), 0.7)
    return out.withColumns({"target": F.coalesce(*target), "confidence": score}).drop(*target)
