"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import fresh

#: Salts over which the rows of one text are dealt before their winners meet.
SALTS = 16


def _content(text_column: str) -> Column:
    return F.coalesce(F.col(f"`{text_column}`"), F.lit(""))


def _merge(df: DataFrame, *keys: str) -> DataFrame:
    """Winner and size of each text; the whole text is part of the key beside its digest."""
    return df.groupBy(*keys, "digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def winners(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = SALTS) -> DataFrame:
    """One row a text: ``member`` (a key that ``member_of`` gives to its rows), keep_id and group_size.

    The rows of a task are combined first (the map side of the first aggregate), then the rows of
    a salted digest, then the winners of all salts. Every stage groups by the digest and the whole
    content, so texts that share a digest stay apart. A text that fills a third of the table sends
    one row from each task to each salt, and at most ``salts`` rows to the last stage.

    ``member`` joins two digests of different kinds. Two contents with one ``member`` are found in
    the last stage, where all contents of a digest meet, and end the job with an error.
    """
    rows = docs.select(
        F.sha2(_content(text_column), 256).alias("digest"), _content(text_column).alias("content"),
        F.pmod(F.xxhash64(F.col(f"`{id_column}`")), F.lit(salts)).cast("int").alias("salt"),
        F.col(f"`{id_column}`").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
    )
    salted = _merge(rows, "salt")
    whole = _merge(salted.repartition("digest"))
    return (
        whole.groupBy("digest", F.xxhash64("content").alias("second"))
        .agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("contents"))
        .select(
            _member(F.col("digest"), F.col("second")).alias("member"), "keep_id",
            F.when(F.col("contents") == 1, F.col("group_size"))
            .otherwise(F.raise_error(F.concat(F.lit("different texts share the digests "), "digest")).cast("long")).alias("group_size"),
        )
    )


def _member(digest: Column, second: Column) -> Column:
    return F.concat(digest, F.hex(second))


def member_of(text_column: str = "text") -> Column:
    return _member(F.sha2(_content(text_column), 256), F.xxhash64(_content(text_column)))


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = SALTS) -> DataFrame:
    """Every row with its group of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. The row with the largest id stays.
    Exactly one row of a group is kept: of rows that repeat the largest id, one; of a group
    whose ids are all null, one (keep_id is null). Null ids never win against others. Other
    columns, whatever their names, are not read; an empty table gives no rows.

    The rows that look up their group carry no text, and the table of groups has one row a text.
    The join key is derived, so both sides are dealt anew for the join and adaptive execution can
    split the rows of a hot text.
    """
    keys = docs.select(F.col(f"`{id_column}`").alias("doc_id"), member_of(text_column).alias("member"))
    counted = keys.groupBy("doc_id", "member").agg(F.count("*").alias("copies"))
    joined = counted.join(winners(docs, id_column, text_column, salts), "member")
    return joined.select(
        "doc_id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
        F.substring("member", 1, 64).alias("text_sha256"),
    ).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256",
    )


def kept_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The winner of every group is found as above; whole rows are then taken by text and id, in
    one shuffle of them. Of rows that repeat id and text, one stays.
    """
    def key(member: Column, id_: Column) -> Column:
        return F.concat_ws(":", member, F.coalesce(id_.cast("string"), F.lit("null")))

    name = fresh(docs, "__key")
    stay = winners(docs, id_column, text_column, salts).select(key(F.col("member"), F.col("keep_id")).alias(name))
    marked = docs.withColumn(name, key(member_of(text_column), F.col(f"`{id_column}`")))
    return marked.join(stay, name, "left_semi").dropDuplicates([name]).drop(name)
