"""File sources and sinks: append tables, JSON and CSV exports."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAILY_PRICE_SCHEMA = "date string, price double, currency string"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    A temporary folder is used only where that is unset and Spark runs in this one process, as in
    tests; on a cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "sitegauge")
    return folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder of the cluster."""
    base = shared_folder(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def append_table(rows: DataFrame, path: str, partition_by: str) -> None:
    """Append rows to a Parquet table, partitioned for later pruning.

    The rebalance hint lets adaptive execution merge small partitions and split large ones, so
    neither thousands of small files nor one huge file per partition value results.
    """
    rows.hint("rebalance", partition_by).write.mode("append").partitionBy(partition_by).parquet(path)


def append_points(points: DataFrame, path: str) -> None:
    append_table(points.withColumn("capture_month", F.date_format("captured_at", "yyyy-MM")), path, "capture_month")


def append_history(rows: DataFrame, path: str) -> None:
    append_table(rows.withColumn("created_month", F.date_format("created_at", "yyyy-MM")), path, "created_month")


def flat_columns(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, so that every column fits a CSV cell."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[
        F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def export(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write rows as JSON lines or as CSV with a header taken from the columns."""
    if fmt == "csv":
        flat_columns(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    else:
        raise ValueError("format must be json or csv")


def document_rows(documents: DataFrame) -> DataFrame:
    """Rows of JSON documents of any form: doc_id, pos (from 0), fields, header.

    ``documents`` has doc_id and body. A list gives its objects; an object with ``results`` gives those;
    of any other object the items of all its lists are taken that are objects, in document order.
    ``fields`` maps names to values, nested values as JSON text; ``header`` has the names of the
    document's first row in their order. Unreadable and empty documents give no rows.
    """
    def items(body: Column) -> Column:
        return F.filter(F.from_json(body, "array<string>"), lambda x: x.startswith("{"))

    lists = F.filter(F.map_values("parts"), lambda v: v.startswith("["))
    rows = (
        F.when(F.ltrim("body").startswith("["), items(F.col("body")))
        .when(F.map_contains_key("parts", F.lit("results")), items(F.try_element_at("parts", F.lit("results"))))
        .otherwise(F.flatten(F.transform(lists, items)))
    )
    read = documents.withColumn("parts", F.when(F.ltrim("body").startswith("{"), F.from_json("body", "map<string,string>"))).withColumn("rows", rows)
    header = F.json_object_keys(F.get("rows", F.lit(0)))
    return read.select("doc_id", header.alias("header"), F.posexplode("rows").alias("pos", "row")).select(
        "doc_id", "pos", F.from_json("row", "map<string,string>").alias("fields"), "header")


def csv_cell(value: Column) -> Column:
    """A CSV cell: quoted only where it holds a quote, comma or line end; null is empty."""
    return F.when(value.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(value, F.lit("")))


def documents_csv(documents: DataFrame) -> DataFrame:
    """One CSV text a JSON document: doc_id, n_rows, csv (lines end with CR LF).

    The header is the first row's names. A name that only later rows have is no column of the
    export, as it has no place in the header; :func:`document_rows` has all of them.
    """
    def line(cells: Column) -> Column:
        return F.array_join(F.transform(cells, csv_cell), ",")

    row = line(F.transform("header", lambda name: F.try_element_at("fields", name)))
    grouped = document_rows(documents).select("doc_id", "pos", "header", row.alias("row")).groupBy("doc_id").agg(
        F.count("*").alias("n_rows"), F.min_by("header", "pos").alias("header"), F.sort_array(F.collect_list(F.struct("pos", "row"))).alias("rows"))
    text = F.concat(F.array(line(F.col("header"))), F.transform("rows", lambda r: r["row"]))
    return grouped.select("doc_id", "n_rows", F.concat(F.array_join(text, "\r\n"), F.lit("\r\n")).alias("csv"))


def export_documents(documents: DataFrame, path: str) -> list[str]:
    """Write the rows of JSON documents as CSV files of one header, that of the first row; returns its names."""
    rows = document_rows(documents)
    first = rows.orderBy("doc_id", "pos").limit(1).select("header").first()
    names = list(first["header"]) if first else []
    if names:
        columns = [F.try_element_at("fields", F.lit(n)).alias(n) for n in names]
        rows.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return names


def read_daily_prices(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Daily price series, a JSON list per file or JSON lines."""
    return spark.read.schema(DAILY_PRICE_SCHEMA).option("multiLine", multi_line).json(path).withColumn("date", F.to_date("date"))
