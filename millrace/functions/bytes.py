"""Column functions over BINARY payloads. Null in, null out.

``detect`` is an expression of Spark's own functions; what has to look at every byte works on whole Arrow buffers.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import buffers

#: Leading bytes (hexadecimal) of each format, in the order they are tried.
MAGIC = (
    ("xz", "FD377A585A00"),
    ("rar5", "526172211A070100"),
    ("rar3", "526172211A0700"),
    ("arsenic", "53747566664974"),
    ("zstd", "28B52FFD"),
    ("lz4-frame", "04224D18"),
    ("bzip2", "425A68"),
    ("gzip", "1F8B"),
)

#: The code lengths in bits of RFC 7541's string Huffman code, for the bytes 0 to 255 in order.
H2_LENGTHS = (
    13, 23, 28, 28, 28, 28, 28, 28, 28, 24, 30, 28, 28, 30, 28, 28,
    28, 28, 28, 28, 28, 28, 30, 28, 28, 28, 28, 28, 28, 28, 28, 28,
     6, 10, 10, 12, 13, 6, 8, 11, 10, 10, 8, 11, 8, 6, 6, 6,
     5, 5, 5, 6, 6, 6, 6, 6, 6, 6, 7, 8, 15, 6, 12, 10,
    13, 6, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7,
     7, 7, 7, 7, 7, 7, 7, 7, 8, 7, 8, 13, 19, 13, 14, 6,
    15, 5, 6, 5, 6, 5, 6, 6, 6, 5, 7, 7, 6, 6, 6, 5,
     6, 7, 6, 5, 5, 6, 7, 7, 7, 7, 7, 15, 11, 14, 13, 28,
    20, 22, 20, 20, 22, 22, 22, 23, 22, 23, 23, 23, 23, 23, 24, 23,
    24, 24, 22, 23, 24, 23, 23, 23, 23, 21, 22, 23, 22, 23, 23, 24,
    22, 21, 20, 22, 22, 23, 23, 21, 23, 22, 22, 24, 21, 22, 23, 23,
    21, 21, 22, 21, 23, 22, 23, 23, 20, 22, 22, 22, 23, 22, 22, 23,
    26, 26, 20, 19, 22, 23, 22, 25, 26, 26, 26, 27, 27, 26, 24, 25,
    19, 21, 26, 27, 27, 26, 27, 24, 21, 21, 26, 26, 28, 27, 27, 27,
    20, 24, 20, 21, 22, 21, 21, 23, 22, 22, 25, 25, 24, 24, 26, 23,
    26, 27, 26, 26, 27, 27, 27, 27, 27, 28, 27, 27, 27, 27, 27, 26,
)


@cache
def h2_code() -> buffers.HuffmanCode:
    """RFC 7541's string Huffman code: canonical over the code lengths."""
    return buffers.HuffmanCode(list(H2_LENGTHS))


def h2_codes() -> list[str]:
    """The bits of each byte's code."""
    code = h2_code()
    return [f"{c:0{n}b}" for c, n in zip(code.codes.tolist(), H2_LENGTHS, strict=True)]


def _name(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def detect(payload: Column | str) -> Column:
    """The codec that the leading bytes name, or null. Raw formats without a signature are never named."""
    p = _name(payload)
    head = F.hex(F.substring(p, 1, 16))
    out = None
    for name, magic in MAGIC:
        hit = head.startswith(magic)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    sit = head.startswith("53495421") & (F.substring(head, 21, 8) == "724C6175")
    first = F.conv(F.substring(head, 1, 4), 16, 10).cast("int")
    zlib = (F.length(p) >= 2) & head.startswith("78") & (first % 31 == 0)
    return out.when(sit, "arsenic").when(zlib, "zlib")


def _distance(distance: int) -> int:
    if not 1 <= distance <= 256:
        raise ValueError("Unsupported: the distance is from 1 to 256")
    return distance


def adler32(payload: Column | str) -> Column:
    """Adler-32, as an unsigned number."""
    return buffers.measure(buffers.adler32, pa.int64(), "long")(payload)


def delta(payload: Column | str, distance: int = 1) -> Column:
    """Each byte less the byte ``distance`` before it, modulo 256; the bytes before the first count as zero."""
    back = _distance(distance)
    return buffers.encoder(lambda data, offsets: buffers.delta(data, offsets, back))(payload)


def undelta(payload: Column | str, distance: int = 1, max_output: int | None = None) -> Column:
    """``STRUCT<data, error>``: the inverse of ``delta`` with this distance."""
    back = _distance(distance)
    return buffers.decoder(lambda data, offsets, most: buffers.undelta(data, offsets, most, back), max_output)(payload)


def rle(payload: Column | str) -> Column:
    """``[count][byte]`` pairs, counts from 1 to 255; longer runs take several pairs."""
    return buffers.encoder(buffers.rle)(payload)


def unrle(payload: Column | str, max_output: int | None = None) -> Column:
    """``STRUCT<data, error>``: the runs expanded, or ``UnexpectedEnd`` (half a pair) or ``Corrupt`` (a count of zero)."""
    return buffers.decoder(buffers.unrle, max_output)(payload)


def rle90(payload: Column | str) -> Column:
    """``byte 90 n`` for runs of three and more (``n`` copies in all), the byte itself else; ``90 00`` is the byte 0x90."""
    return buffers.encoder(buffers.rle90)(payload)


def unrle90(payload: Column | str, max_output: int | None = None) -> Column:
    """``STRUCT<data, error>``: ``Corrupt`` for a repeat without a byte before it, ``UnexpectedEnd`` for a 0x90 at the end."""
    return buffers.decoder(buffers.unrle90, max_output)(payload)


def packbits(payload: Column | str) -> Column:
    """Runs of 3 to 128 bytes as ``257 - n, byte``; stretches of up to 128 other bytes as ``n - 1, bytes``."""
    return buffers.encoder(buffers.packbits)(payload)


def unpackbits(payload: Column | str, max_output: int | None = None) -> Column:
    """``STRUCT<data, error>``; a control of 128 is skipped, a stretch cut short is ``UnexpectedEnd``."""
    return buffers.decoder(buffers.unpackbits, max_output)(payload)


def h2_huffman(payload: Column | str) -> Column:
    """A payload in RFC 7541's string Huffman code, filled up with ones."""
    return buffers.encoder(lambda data, offsets: h2_code().encode(data, offsets))(payload)


def unh2_huffman(payload: Column | str, max_output: int | None = None) -> Column:
    """``STRUCT<data, error>``: ``Corrupt`` for the end mark inside, filling of eight bits or more, or filling that is not ones."""
    return buffers.decoder(lambda data, offsets, most: h2_code().decode(data, offsets, most), max_output)(payload)


def h2_huffman_length(payload: Column | str) -> Column:
    """The number of bytes that RFC 7541's Huffman code takes for a payload."""
    return buffers.measure(lambda data, offsets: -(-h2_code().bits(data, offsets) // 8), pa.int64(), "long")(payload)
