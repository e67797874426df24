"""Writes of the raw and derived layers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_source(df: DataFrame, path: str) -> None:
    """Rows by ``source_code``; loading a source again replaces its partition and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_code").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("source_code").parquet(path)


def rebuild(df: DataFrame, path: str) -> None:
    """A derived table, wholly written anew."""
    df.write.mode("overwrite").parquet(path)


def insert_absent(df: DataFrame, path: str, key: list[str]) -> None:
    """Appends the rows whose key isn't there yet; makes the table if it isn't."""
    have = read_path(df.sparkSession, path)
    new = df.dropDuplicates(key)
    if have is None:
        new.write.parquet(path)
    else:
        new.join(have.select(*key), key, "left_anti").write.mode("append").parquet(path)


def read_path(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None if there is none at ``path``."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_if_there(spark: SparkSession, table: str, schema: str | None = None) -> DataFrame | None:
    """A catalog table; without it, no rows of ``schema``, or None if there is no schema either."""
    if spark.catalog.tableExists(table):
        return spark.read.table(table)
    return spark.createDataFrame([], schema) if schema else None


def _files(spark: SparkSession, path: str) -> tuple[object, object]:
    """The file system of a path, and the path in its terms."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def changed(spark: SparkSession, path: str) -> int:
    """When a file or folder was last changed, in milliseconds."""
    files, own = _files(spark, path)
    return files.getFileStatus(own).getModificationTime()


def drop_sources(spark: SparkSession, path: str, sources: tuple[str, ...]) -> None:
    """Removes the partitions of some sources from a table that ``append`` or ``replace_source`` wrote."""
    for source in sources:
        files, own = _files(spark, f"{path.rstrip('/')}/source_code={source}")
        files.delete(own, True)


def reset(spark: SparkSession, raw_path: str, derived_path: str, sources: tuple[str, ...]) -> None:
    """Clears the derived layer, and what some sources have landed, so that they can be loaded anew."""
    files, own = _files(spark, derived_path)
    files.delete(own, True)
    drop_sources(spark, raw_path, sources)


CURRENT = "CURRENT"


def publish(tables: dict[str, DataFrame], path: str, build_id: str) -> None:
    """Writes all tables of a build, then makes them the current one at one stroke.

    They are written to a folder of their own; a file that names it is put in the place of
    the one before as the last step. If anything fails before that, readers still see the
    whole former build, and the new folder is removed. Builds before the former one go.
    """
    spark = next(iter(tables.values())).sparkSession
    root = path.rstrip("/")
    try:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{root}/{build_id}/{name}")
    except Exception:
        files, own = _files(spark, f"{root}/{build_id}")
        files.delete(own, True)
        raise
    former = current_build(spark, root)
    jvm, fs = spark._jvm, spark._jvm.org.apache.hadoop.fs
    files, new = _files(spark, f"{root}/{CURRENT}.{build_id}")
    out = files.create(new, True)
    out.write(bytearray(build_id.encode()))
    out.close()
    options = spark._sc._gateway.new_array(fs.Options.Rename, 1)
    options[0] = jvm.java.lang.Enum.valueOf(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), "OVERWRITE")
    fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration()).rename(new, fs.Path(f"{root}/{CURRENT}"), options)
    for status in files.listStatus(fs.Path(root)):
        name = status.getPath().getName()
        if status.isDirectory() and name not in (build_id, former):
            files.delete(status.getPath(), True)


def current_build(spark: SparkSession, path: str) -> str | None:
    """The id of the build that readers see, or None before the first."""
    files, own = _files(spark, f"{path.rstrip('/')}/{CURRENT}")
    if not files.exists(own):
        return None
    stream = files.open(own)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def read_build(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the current build."""
    build_id = current_build(spark, path)
    if build_id is None:
        raise FileNotFoundError(f"no build at {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{build_id}/{name}")


def update(df: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``df`` with the columns of ``changes`` where the key is in it."""
    own = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_there"))
    joined = df.join(own, key, "left")
    for c in columns:
        joined = joined.withColumn(c, F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c)))
    return joined.select(*df.columns)


def delete(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key), key, "left_anti")
