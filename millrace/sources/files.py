"""Compressed files as sources and sinks.

Files are read with Spark's ``binaryFile`` source, so listing, partition pruning and any file system that Spark knows come with
it; a file is one row and one stream. Their codec is told by their first bytes or given. The sinks are Parquet tables with an
encoded or a decoded payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.bytes import detect
from millrace.functions.codecs import CAN_ENCODE, decode, encode
from millrace.plans.registry import NAMES


def read_files(spark: SparkSession, path: str, codec: str | None = None, glob: str | None = None, max_output: int | None = None) -> DataFrame:
    """``(path, codec, data, error)`` for each file under ``path``. Without a codec the first bytes decide; a file that they do
    not name has the error ``Unsupported``. Content is only read for the columns that ask for it. ``max_output`` caps what one
    file may decode to."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select("path", "content")
    named = files.withColumn("codec", F.lit(codec) if codec else detect("content"))
    back = named.withColumn("back", decode("content", F.coalesce("codec", F.lit("")), max_output))
    return back.select("path", "codec", "back.data", "back.error")


def encode_files(spark: SparkSession, path: str, codec: str, glob: str | None = None, level: int | None = None) -> DataFrame:
    """``(path, out_path, data)`` for each file under ``path``: its content as one stream of ``codec``, and the path with the
    codec's extension."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select("path", "content")
    return files.select("path", encoded_name("path", codec).alias("out_path"), encode("content", codec, level).alias("data"))


def _extension(codec: str) -> str:
    """The codec's extension, which ends a path; none where there is no usual one."""
    known = dict(NAMES)
    if codec not in known:
        raise ValueError(f"Unsupported: {codec} is no codec")
    return f".{known[codec]}" if known[codec] else ""


def encoded_name(path: Column | str, codec: str) -> Column:
    """The path with the codec's extension appended; the path itself for a codec without one."""
    return F.concat(F.col(path) if isinstance(path, str) else path, F.lit(_extension(codec)))


def decoded_name(path: Column | str, codec: str) -> Column:
    """The path without the codec's extension, or null where it does not end in it."""
    c, end = F.col(path) if isinstance(path, str) else path, _extension(codec)
    return F.when(c.endswith(end), F.substr(c, F.lit(1), F.length(c) - len(end)))


def _new_columns(df: DataFrame, *names: str) -> None:
    taken = {c.lower() for c in df.columns} & set(names)
    if taken:
        raise ValueError(f"the table has columns named {sorted(taken)} already; rename them first")


def write_encoded(df: DataFrame, payload_col: str, codec: str, path: str, level: int | None = None, mode: str = "error") -> None:
    """Writes ``df`` as a Parquet table with its payload encoded, and the columns ``codec`` and ``raw_bytes`` beside it. The
    default mode never overwrites; Parquet's own compression is off, as the payload is compressed already. A codec that cannot
    encode, or a table that has such columns already, raises before anything is written."""
    if codec not in CAN_ENCODE:
        raise ValueError(f"Unsupported: {codec} cannot encode")
    _new_columns(df, "codec", "raw_bytes")
    out = df.withColumn("codec", F.lit(codec)).withColumn("raw_bytes", F.octet_length(payload_col).cast("long")).withColumn(payload_col, encode(payload_col, codec, level))
    out.write.mode(mode).option("compression", "none").parquet(path)


def read_encoded(spark: SparkSession, path: str, payload_col: str, max_output: int | None = None) -> DataFrame:
    """The rows of ``write_encoded`` with their payload decoded and ``error`` beside it. Filters on other columns reach the
    scan before anything is decoded. A table with a column ``error`` of its own raises."""
    df = spark.read.parquet(path)
    _new_columns(df, "error")
    back = [decode(payload_col, F.col("codec"), max_output).alias("back") if c == payload_col else F.col(c) for c in df.columns]
    names = [F.col("back.data").alias(c) if c == payload_col else F.col(c) for c in df.columns]
    return df.select(*back).select(*names, F.col("back.error").alias("error"))


def write_decoded(df: DataFrame, payload_col: str, codec: Column | str, path: str, max_output: int | None = None, mode: str = "error") -> None:
    """Writes ``df`` as a Parquet table with its payload decoded. A stream that is cut short, damaged or over the cap stops the
    job with its error; rows written by then stay uncommitted."""
    back = df.withColumn(payload_col, decode(payload_col, codec, max_output))
    whole = F.when(F.col(f"{payload_col}.error").isNotNull(), F.raise_error(F.col(f"{payload_col}.error"))).otherwise(F.col(f"{payload_col}.data"))
    back.withColumn(payload_col, whole).write.mode(mode).parquet(path)
