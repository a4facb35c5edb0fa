"""Fitted models on a shared file system: numbered versions, one of them current.

A version is a folder of Parquet files that is complete before the manifest names it; the manifest is replaced by a
rename, so readers see the old version or the new one and never half of one. Versions beyond the kept number of older
ones are removed after that, so a failed run leaves the current models as they were.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "manifest.json"


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root, jvm


def manifest(spark: SparkSession, path: str) -> dict:
    """The manifest: the current version and all kept ones, newest first. Nothing published: none."""
    files, root, jvm = _file_system(spark, path)
    at = jvm.org.apache.hadoop.fs.Path(root, MANIFEST)
    if not files.exists(at):
        return {"current": None, "versions": []}
    stream = files.open(at)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish_models(models: DataFrame, path: str, keep_older: int = 1) -> int | None:
    """Store a table of models as the current version and return its number; a table without models changes nothing."""
    spark = models.sparkSession
    files, root, jvm = _file_system(spark, path)
    known = manifest(spark, path)
    number = 1 + max(known["versions"], default=0)
    # A run that failed before it published may have left a folder of this number; names differ by run.
    folder = f"v{number}-{uuid.uuid4().hex}"
    models.write.parquet(f"{path}/{folder}")
    if spark.read.parquet(f"{path}/{folder}").isEmpty():
        files.delete(jvm.org.apache.hadoop.fs.Path(root, folder), True)
        return None
    kept = [number, *known["versions"]][: 1 + keep_older]
    folders = known.get("folders", {}) | {str(number): folder}
    content = {"current": number, "versions": kept, "folders": {str(v): folders[str(v)] for v in kept}}
    draft = jvm.org.apache.hadoop.fs.Path(root, f".{MANIFEST}-{uuid.uuid4().hex}")
    stream = files.create(draft)
    try:
        stream.write(bytearray(json.dumps(content).encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), spark._jsc.hadoopConfiguration()) if root.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, jvm.org.apache.hadoop.fs.Path(root, MANIFEST), options)
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if status.isDirectory() and name not in content["folders"].values():
            files.delete(status.getPath(), True)
    return number


def read_models(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The current models, or those of a kept version."""
    known = manifest(spark, path)
    wanted = known["current"] if version is None else version
    if wanted not in known["versions"]:
        raise ValueError(f"no models of version {wanted} in {path}")
    return spark.read.parquet(f"{path}/{known['folders'][str(wanted)]}")
