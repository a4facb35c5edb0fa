"""Table scans, file scans and file sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """Parquet scan; the projection and the filter both reach the reader."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower: str, upper: str, partitions: int, **options: str) -> DataFrame:
    """Database scan split into ranges of ``partition_column``, read in parallel by the executors."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=options)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, optional: bool = False) -> DataFrame:
    """CSV scan with a declared schema; NaN text becomes null. An absent optional file is an empty table."""
    if optional and not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX").csv(path, header=True)
    doubles = [f.name for f in schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in doubles}) if doubles else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path, header=True)


def read_json_report(spark: SparkSession, path: str, field: str = "summary", schema: str | None = None) -> DataFrame:
    """Rows of one list field of a JSON report (a report is one small document)."""
    reader = spark.read.option("multiLine", True)
    if schema:
        reader = reader.schema(f"{field} array<struct<{schema}>>")
    return reader.json(path).select(F.inline(field))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_raw_pages(pages: DataFrame, path: str) -> None:
    """Append raw pages for lineage, one folder per source."""
    pages.write.mode("append").partitionBy("source_name").parquet(path)


def file_manifest(spark: SparkSession, root: str, expected: Sequence[str]) -> DataFrame:
    """(path, exists, size_bytes) of the expected files or table folders under a folder; contents are not read.

    Only the expected paths are looked up, in the file system that holds them; a folder counts with all it holds.
    """
    jvm, rows = spark._jvm, []
    for name in dict.fromkeys(expected):
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        there = system.exists(path)
        rows.append((name, there, system.getContentSummary(path).getLength() if there else 0))
    return spark.createDataFrame(rows, "path string, exists boolean, size_bytes long")


def require_files(manifest: DataFrame) -> DataFrame:
    """Fail when an expected file is missing."""
    missing = [r.path for r in manifest.filter(~F.col("exists")).select("path").collect()]
    if missing:
        raise FileNotFoundError(f"missing source files: {sorted(missing)}")
    return manifest


def load_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    return reduce(
        DataFrame.unionByName,
        [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()],
    )


def nan_to_null_record(df: DataFrame) -> DataFrame:
    """One struct per row with NaN replaced by null."""
    fields = []
    for f in df.schema.fields:
        column = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            column = F.when(~F.isnan(column), column)
        fields.append(column.alias(f.name))
    return df.select(F.struct(*fields).alias("record"))


def to_stored_text(df: DataFrame) -> DataFrame:
    """Decimals as text, everything else unchanged."""
    return df.select(
        *[F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema.fields]
    )
