"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.session import shared_folder

#: The white space of the text contracts: space, tab, LF, VT, FF and CR.
SPACE = " \t-\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    return shared_folder(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back.

    The rows come back from storage that every executor sees, so a lost executor costs no recomputation of what is above.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/folium/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folium_path = path
    return out


def erase(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._folium_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number that is the same whenever the rows are read again: of the file and the row in it.

    Numbers by partition would shift when a cluster grows between two jobs. Rows that don't come straight from files are
    written first.
    """
    number = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    try:
        return df.select("*", number.alias(name))
    except AnalysisException:
        return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key is hot if more rows have it than this, and more than one in SHARES of all rows: so there are fewer hot keys than SHARES.
HOT_ROWS, SHARES = 10_000, 1000


def join_by_key(rows: DataFrame, found: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined with found, which has a row for each key and, as size, how many rows have it; found is written already.

    Hot keys are broadcast, fewer than SHARES of them, so their rows stay where they are; the others meet by key.
    """
    total = found.agg(F.sum(size)).first()[0] or 0
    most = max(HOT_ROWS, total // SHARES)
    hot = found.where(F.col(size) > most)
    if not hot.take(1):
        return rows.join(found, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(found.where(F.col(size) <= most), key)
    return rest.unionByName(rows.join(F.broadcast(hot), key))
