"""Encoding and decoding of BINARY columns by codec name.

Byte codecs are the column functions of ``bytes`` and ``transforms``; the others go through the libraries that Python and Arrow
bring along. Rows are independent streams: they are handled in Arrow batches where they lie, and nothing is shuffled. What was made
is passed on every few MB, so that a worker's memory does not grow with a batch's payloads or with what they expand to. Decoders stop
at the end of the first stream (gzip: of the last member) and leave what follows; they never produce more than ``max_output``
bytes, and report failures as text in ``error`` instead of raising.
"""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import buffers
from millrace.functions import bytes as fb
from millrace.operators import transforms

_LZMA2 = [{"id": lzma.FILTER_LZMA2, "dict_size": 4 << 20}]
_PIECE = 1 << 20
#: How zlib words what the error kinds name.
_DEFLATE_ERRORS = (
    ("incorrect data check", "ChecksumMismatch"), ("incorrect length check", "TrailerMismatch"), ("header", "BadHeader"),
    ("window size", "BadHeader"), ("unknown compression method", "BadHeader"), ("invalid block type", "InvalidBlockType"), ("distance too far", "InvalidDistance"),
    ("invalid distance code", "InvalidDistance"), ("code lengths", "InvalidHuffmanTree"), ("bit length", "InvalidHuffmanTree"),
    ("literal/lengths", "InvalidHuffmanTree"), ("distances set", "InvalidHuffmanTree"), ("symbols", "InvalidHuffmanTree"), ("end-of-block", "InvalidHuffmanTree"),
)


class Failed(Exception):
    """A typed decoding failure: Corrupt, UnexpectedEnd, BadHeader, ChecksumMismatch, TrailerMismatch, InvalidBlockType,
    InvalidHuffmanTree, InvalidDistance, OutputLimitExceeded or Unsupported."""


def _deflate(window: int):
    def run(data: bytes, level: int | None) -> bytes:
        c = zlib.compressobj(6 if level is None else min(9, max(1, level)), zlib.DEFLATED, window)
        return c.compress(data) + c.flush()

    return run


def _check_zlib_header(data: bytes) -> None:
    if len(data) >= 2:
        if (data[0] * 256 + data[1]) % 31:
            raise Failed("BadHeader")
        if data[0] & 15 != 8 or data[1] & 32:
            raise Failed("Unsupported")


def _check_gzip_header(data: bytes) -> None:
    if data[:2] != b"\x1f\x8b"[: len(data)] or (len(data) > 2 and data[2] != 8):
        raise Failed("BadHeader")
    if len(data) > 3 and data[3] & 0xE0:
        raise Failed("Unsupported")


def _inflate(window: int):
    check = {15: _check_zlib_header, 31: _check_gzip_header}.get(window, lambda data: None)

    def run(data: bytes, most: int) -> bytes:
        out, size, rest = [], 0, data
        while True:
            check(rest)
            d = zlib.decompressobj(window)
            try:
                out.append(d.decompress(rest, min(most - size, 2**62) + 1))
            except zlib.error as e:
                raise Failed(next((kind for words, kind in _DEFLATE_ERRORS if words in str(e)), "Corrupt")) from e
            size += len(out[-1])
            if size > most:
                raise Failed("OutputLimitExceeded")
            if not d.eof:
                raise Failed("UnexpectedEnd")
            rest = d.unused_data
            # Another gzip member follows only if its first byte says so; anything else after the end is ignored.
            if window != 31 or not rest.startswith(b"\x1f"):
                return b"".join(out)

    return run


def _until_end(make: Callable, errors: tuple):
    def run(data: bytes, most: int) -> bytes:
        d = make()
        try:
            out = d.decompress(data, min(most, 2**62) + 1)
        except errors as e:
            raise Failed("BadHeader" if "format not supported" in str(e) else "Unsupported" if "nsupported" in str(e) else "Corrupt") from e
        if len(out) > most:
            raise Failed("OutputLimitExceeded")
        if not d.eof:
            raise Failed("UnexpectedEnd")
        return out

    return run


def _bunzip2(data: bytes, most: int) -> bytes:
    if data[:3] != b"BZh"[: len(data)] or (len(data) > 3 and not 0x31 <= data[3] <= 0x39):
        raise Failed("BadHeader")
    return _until_end(bz2.BZ2Decompressor, (OSError, ValueError))(data, most)


def _zstd_end(data: bytes) -> int:
    """Where the first frame ends: its blocks name their sizes."""
    try:
        at, checked = zstandard.frame_header_size(data), zstandard.get_frame_parameters(data).has_checksum
    except zstandard.ZstdError as e:
        raise Failed("UnexpectedEnd" if len(data) < 18 else "BadHeader") from e
    last = False
    while not last:
        if len(data) < at + 3:
            raise Failed("UnexpectedEnd")
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        if kind == 3:
            raise Failed("Corrupt")
        at += 3 + (1 if kind == 1 else size)
    at += 4 * checked
    if len(data) < at:
        raise Failed("UnexpectedEnd")
    return at


def _unzstd(data: bytes, most: int) -> bytes:
    if data[:4] != b"\x28\xb5\x2f\xfd":
        skippable = len(data) >= 4 and data[1:4] == b"\x2a\x4d\x18" and data[0] >> 4 == 5
        raise Failed("Unsupported" if skippable else "BadHeader" if len(data) >= 4 else "UnexpectedEnd")
    frame, out, size = memoryview(data)[: _zstd_end(data)], [], 0
    try:
        with zstandard.ZstdDecompressor(max_window_size=128 << 20).stream_reader(frame, read_across_frames=False) as r:
            while piece := r.read(min(_PIECE, most + 1 - size)):
                out.append(piece)
                size += len(piece)
                if size > most:
                    raise Failed("OutputLimitExceeded")
    except zstandard.ZstdError as e:
        raise Failed("ChecksumMismatch" if "checksum" in str(e) else "Corrupt") from e
    stated = zstandard.get_frame_parameters(data).content_size
    if stated not in (zstandard.CONTENTSIZE_UNKNOWN, size):
        raise Failed("Corrupt")
    return b"".join(out)


def _lz4_end(data: bytes) -> int:
    """Where the first frame ends: magic, descriptor, blocks with their sizes, an empty one, a checksum."""
    if data[:4] != b"\x04\x22\x4d\x18"[: len(data)]:
        raise Failed("BadHeader")
    if len(data) < 7:
        raise Failed("UnexpectedEnd")
    flags = data[4]
    if flags >> 6 != 1:
        raise Failed("BadHeader")
    at = 7 + 8 * (flags >> 3 & 1) + 4 * (flags & 1)
    while True:
        if len(data) < at + 4:
            raise Failed("UnexpectedEnd")
        size = int.from_bytes(data[at : at + 4], "little") & 0x7FFFFFFF
        at += 4
        if not size:
            break
        at += size + 4 * (flags >> 4 & 1)
    at += 4 * (flags >> 2 & 1)
    if len(data) < at:
        raise Failed("UnexpectedEnd")
    return at


def _read(name: str, data: bytes, most: int) -> bytes:
    out, size = [], 0
    with pa.CompressedInputStream(pa.BufferReader(data), name) as s:
        while piece := s.read(min(_PIECE, most + 1 - size)):
            out.append(piece)
            size += len(piece)
            if size > most:
                raise Failed("OutputLimitExceeded")
    return b"".join(out)


def _unlz4(data: bytes, most: int) -> bytes:
    try:
        return _read("lz4", data[: _lz4_end(data)], most)
    except (pa.ArrowInvalid, OSError) as e:
        raise Failed("ChecksumMismatch" if "checksum" in str(e).lower() else "Corrupt") from e


def _unbrotli(data: bytes, most: int) -> bytes:
    if not data:
        raise Failed("UnexpectedEnd")
    try:
        return _read("brotli", data, most)
    except (pa.ArrowInvalid, OSError) as e:
        raise Failed("UnexpectedEnd" if "truncated" in str(e).lower() or "end of" in str(e).lower() else "Corrupt") from e


def _unsnappy(data: bytes, most: int) -> bytes:
    size = shift = 0
    for k, b in enumerate(data[:5]):
        size |= (b & 127) << shift
        shift += 7
        if b < 128:
            break
    else:
        raise Failed("UnexpectedEnd" if len(data) < 5 else "Corrupt")
    if size > most:
        raise Failed("OutputLimitExceeded")
    if size > 256 * (len(data) - k) or (not size and len(data) > k + 1):
        raise Failed("Corrupt")
    try:
        return pa.Codec("snappy").decompress(data, size).to_pybytes() if size else b""
    except (pa.ArrowInvalid, OSError) as e:
        raise Failed("Corrupt") from e


def _same_size(back: Callable[[bytes], bytes]):
    def run(data: bytes, most: int) -> bytes:
        if len(data) > most:
            raise Failed("OutputLimitExceeded")
        return back(data)

    return run


def _unbwt(data: bytes, most: int) -> bytes:
    at = size = 0
    while at < len(data):
        if len(data) < at + 8:
            raise Failed("UnexpectedEnd")
        n, primary = (int(x) for x in np.frombuffer(data[at : at + 8], "<u4"))
        if primary >= n:
            raise Failed("Corrupt")
        at, size = at + 8 + n, size + n
        if at > len(data):
            raise Failed("UnexpectedEnd")
        if size > most:
            raise Failed("OutputLimitExceeded")
    return transforms._unbwt(data)


def _arrow_stream_out(name: str):
    def run(data: bytes, level: int | None) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, name) as s:
            s.write(data)
        return sink.getvalue().to_pybytes()

    return run


def _brotli(data: bytes, level: int | None) -> bytes:
    return pa.Codec("brotli", compression_level=6 if level is None else min(11, max(0, level))).compress(data).to_pybytes()


def _lzma_filter(kind: int, data: bytes, level: int | None) -> dict:
    """A preset with a dictionary no larger than the payload needs: setting up a large one costs more than a short payload."""
    size = min(4 << 20, max(4096, 1 << max(0, len(data) - 1).bit_length()))
    return {"id": kind, "preset": _clamp(level, 0, 9, 6), "dict_size": size}


_clamp = lambda level, low, high, default: default if level is None else min(high, max(low, level))
ENCODERS: dict[str, Callable[[bytes, int | None], bytes]] = {
    "deflate": _deflate(-15),
    "zlib": _deflate(15),
    "gzip": _deflate(31),
    "bzip2": lambda d, n: bz2.compress(d, _clamp(n, 1, 9, 6)),
    "lzma": lambda d, n: lzma.compress(d, lzma.FORMAT_ALONE, filters=[_lzma_filter(lzma.FILTER_LZMA1, d, n)]),
    "xz": lambda d, n: lzma.compress(d, lzma.FORMAT_XZ, lzma.CHECK_CRC32, filters=[_lzma_filter(lzma.FILTER_LZMA2, d, n)]),
    "lzma2": lambda d, n: lzma.compress(d, lzma.FORMAT_RAW, filters=[_lzma_filter(lzma.FILTER_LZMA2, d, n)]),
    "zstd": lambda d, n: zstandard.ZstdCompressor(level=_clamp(n, 1, 22, 3), write_checksum=True).compress(d),
    "brotli": _brotli,
    "snappy": lambda d, n: pa.Codec("snappy").compress(d).to_pybytes(),
    "lz4-frame": _arrow_stream_out("lz4"),
}
DECODERS: dict[str, Callable[[bytes, int], bytes]] = {
    "deflate": _inflate(-15),
    "zlib": _inflate(15),
    "gzip": _inflate(31),
    "bzip2": _bunzip2,
    "lzma": _until_end(lambda: lzma.LZMADecompressor(lzma.FORMAT_ALONE), (lzma.LZMAError,)),
    "xz": _until_end(lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ), (lzma.LZMAError,)),
    "lzma2": _until_end(lambda: lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=_LZMA2), (lzma.LZMAError,)),
    "zstd": _unzstd,
    "brotli": _unbrotli,
    "snappy": _unsnappy,
    "lz4-frame": _unlz4,
    "mtf": _same_size(transforms._unmtf),
    "bwt": _unbwt,
}
#: Codecs that are column functions; they have no levels. ``delta`` has a distance of 1.
COLUMN_ENCODERS: dict[str, Callable[[Column], Column]] = {
    "rle": fb.rle,
    "rle90": fb.rle90,
    "packbits": fb.packbits,
    "delta": fb.delta,
    "mtf": transforms.mtf,
    "bwt": transforms.bwt,
    "h2-huffman": fb.h2_huffman,
}
COLUMN_DECODERS: dict[str, Callable[[Column, int | None], Column]] = {
    "rle": fb.unrle,
    "rle90": fb.unrle90,
    "packbits": fb.unpackbits,
    "delta": lambda payload, most: fb.undelta(payload, 1, most),
    "h2-huffman": fb.unh2_huffman,
}
CAN_ENCODE = frozenset([*ENCODERS, *COLUMN_ENCODERS])
CAN_DECODE = frozenset([*DECODERS, *COLUMN_DECODERS])


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _encoded(payload: Column, name: Column, among: Iterable[str], level: int | None) -> Column:
    """Null for codecs that cannot encode. ``among`` holds what the names may be."""
    among = frozenset(among)
    if len(among) == 1 and among <= COLUMN_ENCODERS.keys():
        return COLUMN_ENCODERS[min(among)](payload)

    here = among & ENCODERS.keys()

    def one(data: bytes | None, codec: str | None) -> bytes | None:
        return ENCODERS[codec](data, level) if data is not None and codec in here else None

    @F.arrow_udf("binary")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for data, names in batches:
            rows = (one(d.as_py(), c.as_py()) for d, c in zip(data, names, strict=True))
            for some in buffers.lists(rows, lambda d: len(d or b"")):
                yield pa.array(some, pa.binary())
        buffers.give_back()

    out = run(payload, name)
    for known, column in COLUMN_ENCODERS.items():
        # Functions in Python read only the rows that are theirs; all rows pass by each of them.
        if known in among:
            out = F.when(name == known, column(F.when(name == known, payload))).otherwise(out)
    return out


def encode(payload: Column | str, codec: Column | str, level: int | None = None, among: Iterable[str] = CAN_ENCODE) -> Column:
    """The payload as one stream of ``codec`` (a name, or a column of names). Levels out of range are clamped. Null payloads
    stay null. A name that cannot encode raises: at once where it is given, in the job where a column holds it (see
    ``try_encode``). Where it is known what a column of names may hold, ``among`` spares the steps of the other codecs."""
    if isinstance(codec, str):
        if codec not in CAN_ENCODE:
            raise ValueError(f"Unsupported: {codec} cannot encode")
        return _encoded(_column(payload), F.lit(codec), [codec], level)
    tried = try_encode(payload, codec, level, among)
    return F.when(tried["error"].isNotNull(), F.raise_error(F.concat(tried["error"], F.lit(": "), F.coalesce(codec, F.lit("no codec"))))).otherwise(tried["data"])


def try_encode(payload: Column | str, codec: Column, level: int | None = None, among: Iterable[str] = CAN_ENCODE) -> Column:
    """``STRUCT<data, error>``: as ``encode`` with a column of names, with the error ``Unsupported`` for those that cannot encode
    or are not ``among`` the names given."""
    payload, among = _column(payload), CAN_ENCODE.intersection(among)
    known = F.coalesce(codec.isin(*among), F.lit(False))
    error = F.when(payload.isNotNull() & ~known, "Unsupported")
    return F.struct(_encoded(payload, codec, among, level).alias("data"), error.alias("error"))


def decode(payload: Column | str, codec: Column | str, max_output: int | None = None) -> Column:
    """``STRUCT<data, error>``. Exactly ``max_output`` bytes succeed, one more is ``OutputLimitExceeded``; set it for payloads
    that are not trusted, as without it there is no cap. Null payloads give two nulls; an unknown codec is ``Unsupported``."""
    payload, most = _column(payload), 2**62 if max_output is None else max_output
    if isinstance(codec, str) and codec in COLUMN_DECODERS:
        return COLUMN_DECODERS[codec](payload, max_output)
    name = F.lit(codec) if isinstance(codec, str) else codec

    def one(data: bytes | None, codec: str | None) -> tuple:
        if data is None:
            return None, None
        if codec not in DECODERS:
            return None, "Unsupported"
        try:
            return DECODERS[codec](data, most), None
        except Failed as e:
            return None, str(e)

    @F.arrow_udf("data binary, error string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for data, names in batches:
            rows = (one(d.as_py(), c.as_py()) for d, c in zip(data, names, strict=True))
            for some in buffers.lists(rows, lambda row: len(row[0] or b"")):
                yield pa.StructArray.from_arrays([pa.array([d for d, _ in some], pa.binary()), pa.array([e for _, e in some], pa.string())], ["data", "error"])
        buffers.give_back()

    out = run(payload, name)
    for known, column in COLUMN_DECODERS.items() if not isinstance(codec, str) else ():
        out = F.when(name == known, column(F.when(name == known, payload), max_output)).otherwise(out)
    return out


def skip_output(payload: Column | str, codec: Column | str, n: int, max_output: int | None = None) -> Column:
    """``STRUCT<data, error>`` as ``decode``, without the first ``n`` decoded bytes; they never leave the worker's column. Fewer
    decoded bytes than that give none."""
    if n < 0:
        raise ValueError("n is 0 or more")
    back = decode(payload, codec, max_output)
    return F.when(_column(payload).isNotNull(), F.struct(F.substring(back["data"], F.lit(n + 1), F.lit(2**31 - 1)).alias("data"), back["error"].alias("error")))
