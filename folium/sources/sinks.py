"""Writers: versioned records, JSON lines, CSV and Markdown reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.sources import versions


def write_versions(rows: DataFrame, path: str, overwrite: bool = True) -> int:
    """Records with written_at as a commit of a versions table, whose number comes back. Without overwrite earlier versions stay beside the new one."""
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")
    return versions.commit(rows.withColumn("written_at", stamp), path, replaces=overwrite)


def first_versions(rows: DataFrame, keys: list[str], order: str = "written_at") -> DataFrame:
    """The current version of each record: the first that was written, as later ones go beside it.

    order: the column that tells versions apart; of versions.read() it is version, which has no ties. One row of a key moves.
    """
    others = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(order)).alias("_row"))
    return first.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in rows.columns])


def write_run(rows: DataFrame, path: str) -> None:
    """By run; the flat table is all of it."""
    rows.write.mode("append").partitionBy("run_id").parquet(path)


def write_jsonl(rows: DataFrame, line: str, path: str, by: str | None = "split") -> None:
    """A text file of lines, in a folder for each value of by."""
    out = rows.select(F.col(line).alias("value"), *([by] if by else []))
    (out.write.mode("overwrite").partitionBy(by) if by else out.write.mode("append")).text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """A report with its columns in order of their names."""
    rows.select(*sorted(rows.columns)).coalesce(1).write.mode("overwrite").csv(path, header=True)


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A report as a left-aligned table, in the order of rows; a report is for people, so beyond limit a last line says how many rows it leaves out."""
    found = rows.limit(limit + 1).collect()
    cells = [rows.columns, *[["" if v is None else str(v) for v in r] for r in found[:limit]]]
    widths = [max(len(r[k]) for r in cells) for k in range(len(rows.columns))]
    lines = ["| " + " | ".join(v.ljust(w) for v, w in zip(r, widths)) + " |" for r in cells]
    more = [f"\n{rows.count() - limit} more rows"] if len(found) > limit else []
    return "\n".join([lines[0], "| " + " | ".join("-" * w for w in widths) + " |", *lines[1:], *more])


#: File of a manifest that names its current version.
POINTER = "current"


def write_manifest(rows: DataFrame, path: str) -> None:
    """Pages as JSON lines in files of ranges of (document_id, page), an index of the files' ranges, and a pointer to this version.

    Readers that come before the pointer is swapped see the version before, whole. No task holds more than its range.
    """
    spark, name = rows.sparkSession, uuid.uuid4().hex
    fields = ["document_id", "page", *[c for c in rows.columns if c not in ("document_id", "page")]]
    lines = rows.select("document_id", "page", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))
    lines.orderBy("document_id", "page").select("value").write.text(f"{path}/{name}/pages")
    written = spark.read.text(f"{path}/{name}/pages").select(F.col("_metadata.file_name").alias("file"), F.from_json("value", "document_id string, page int").alias("p"))
    key = F.struct("p.document_id", "p.page")
    index = written.groupBy("file").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("pages"))
    index.write.json(f"{path}/{name}/index")
    swapped(spark, f"{path}/{POINTER}", name)


def swapped(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in place of another in one step."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    new, old = hadoop.Path(f"{path}.{uuid.uuid4().hex}"), hadoop.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    out = new.getFileSystem(conf).create(new)
    out.write(bytearray(text.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(old.toUri(), conf).rename(new, old, over)


def write_text(texts: DataFrame, path: str, by: list[str], overwrite: bool = True) -> None:
    """Texts (key columns, stem and text) as Parquet by folder. Without overwrite what is there stays, and only new stems are added."""
    if overwrite:
        texts.write.mode("overwrite").partitionBy(*by).parquet(path)
        return
    from pyspark.errors import AnalysisException

    try:
        done = texts.sparkSession.read.parquet(path).select(*by, "stem")
    except AnalysisException:
        done = None
    new = texts if done is None else texts.join(done, [*by, "stem"], "left_anti")
    new.write.mode("append").partitionBy(*by).parquet(path)


def transcript(document_id: Column, page: Column, model: Column, text: Column) -> Column:
    """A transcript with its three lines of origin."""
    head = [F.concat(F.lit(f"<!-- {n}: "), c.cast("string"), F.lit(" -->")) for n, c in (("document_id", document_id), ("page", page), ("model", model))]
    return F.concat_ws("\n", *head, F.lit(""), text)


def write_report(text: str, path: str, spark: SparkSession) -> None:
    """A report's text as one file below path, by Spark's writer, wherever path is."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
