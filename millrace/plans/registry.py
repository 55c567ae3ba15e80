"""The codec registry as a small table, and lookups by join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.codecs import CAN_DECODE, CAN_ENCODE

#: Codec names in their stable order, with the file extension of each (none where there is no usual one).
NAMES = (
    ("rle", "rle"), ("rle90", "rle90"), ("deflate", "deflate"), ("deflate64", "deflate64"), ("zlib", "zz"),
    ("gzip", "gz"), ("lzma", "lzma"), ("xz", "xz"), ("lzma2", "lzma2"), ("zstd", "zst"),
    ("brotli", "br"), ("lz4", "lz4"), ("lz4-frame", "lz4"), ("lz5", "liz"), ("snappy", "sz"),
    ("lzw", "lzw"), ("lzss", "lzss"), ("lzo", "lzo"), ("lzx", "lzx"), ("amiga_lzx", None),
    ("quantum", "q"), ("lzfse", "lzfse"), ("adc", "adc"), ("ppmd", "ppmd"), ("lznt1", "lznt1"),
    ("bzip2", "bz2"), ("xpress-huffman", "xph"), ("xpress", "xpress"), ("packbits", "packbits"), ("zip-implode", "implode"),
    ("lzs", "lzs"), ("lzham", "lzham"), ("sit13", "sit13"), ("lzah", "lzah"), ("arsenic", "arsenic"),
    ("rar1", "rar"), ("rar2", "rar"), ("rar3", "rar"), ("rar5", "rar"), ("zip-shrink", "shrunk"),
    ("zip-reduce", "reduce"), ("lh1", "lzh"), ("lh2", "lzh"), ("lh4", "lzh"), ("lh5", "lzh"),
    ("lh6", "lzh"), ("lh7", "lzh"), ("h2-huffman", None), ("huffman", "huff"), ("range", "range"),
    ("mtf", "mtf"), ("bwt", "bwt"), ("bcj-x86", "bcj-x86"), ("bcj-arm", "bcj-arm"), ("bcj-armt", "bcj-armt"),
    ("bcj-arm64", "bcj-arm64"), ("bcj-ppc", "bcj-ppc"), ("bcj-sparc", "bcj-sparc"), ("bcj-ia64", "bcj-ia64"), ("bcj-riscv", "bcj-riscv"),
    ("delta", "delta"), ("crunch", "arc"), ("squeeze", "sqz"), ("squashed", "arc"),
)
#: The codecs whose format has a mark at which a stream can be flushed.
FLUSHES = ("deflate", "zlib", "gzip")


def registry(spark: SparkSession) -> DataFrame:
    """``(position, name, extension, can_encode, can_decode, can_flush)``; a handful of rows, so joins with it are broadcast."""
    rows = [(k, n, e, n in CAN_ENCODE, n in CAN_DECODE, n in FLUSHES) for k, (n, e) in enumerate(NAMES)]
    return spark.createDataFrame(rows, "position int, name string, extension string, can_encode boolean, can_decode boolean, can_flush boolean")


def with_extension(df: DataFrame, codec_col: str = "codec") -> DataFrame:
    """``df`` with the ``extension`` of its codec; null for unknown codecs."""
    known = registry(df.sparkSession).select(F.col("name").alias(codec_col), "extension")
    return df.join(F.broadcast(known), codec_col, "left")
