"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelab.session import checkpoint_folder, cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of the documents that no model may learn from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def text_of(c: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def written(df: DataFrame) -> DataFrame:
    """Writes `df` once as Parquet into the shared folder and reads it back: later stages prune its
    columns, and a lost executor costs a reread instead of a recomputation."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/shapelab-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


#: Rows of a batch that a Python worker gets at once.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, for a session whose Arrow batches are no larger than BATCH_ROWS: Spark's own bound suits numbers, not texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key, "10000")) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def free(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small(df: DataFrame, most: int) -> DataFrame:
    """`df`, computed once; broadcast if it has no more than `most` rows, else left to a join by key."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8. It needs `crc_table` of CRC_SQL among the tables of its select."""
    data = f"list_transform(range(0, octet_length(encode({text}))), lambda k: cast('0x' || hex(encode({text}))[2 * k + 1:2 * k + 2] as bigint))"
    return f"xor(4294967295, list_reduce(list_concat([cast(4294967295 as bigint)], {data}), lambda c, b: xor(crc_table.entries[(xor(c, b) & 255) + 1], c >> 8)))"


#: A common table expression with the remainders of the 256 bytes.
CRC_SQL = "crc_table as (select list_transform(range(256), lambda v: list_reduce(list_concat([cast(v as bigint)], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as entries)"
