"""Streams of chunks as gzip members and flushed or buffered codec streams, and sizes by event time, on Structured Streaming."""

from __future__ import annotations

import pickle
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.codecs import ENCODERS, encode

_WINDOW = 32 << 10
#: Chunks of a stream that may wait for one before them.
MAX_WAITING = 10_000


def gzip_members(chunks: DataFrame, stream_col: str = "stream_id", seq_col: str = "seq", chunk_col: str = "chunk") -> DataFrame:
    """One gzip member for each chunk: members of a stream, in order of their number, are one gzip file. Members need no
    state and no shuffle, so a stream may be encoded by many tasks and decoded by one reader."""
    return chunks.select(stream_col, seq_col, encode(chunk_col, "gzip").alias("member"))


def _piece(history: bytes, data: bytes, flush: str, last: bool) -> tuple[bytes, bytes]:
    """The raw deflate piece for ``data``, and the text that the next piece may refer to."""
    if history:
        c = zlib.compressobj(6, zlib.DEFLATED, -15, zdict=history)
    else:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
    mode = zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH if flush == "full" else zlib.Z_SYNC_FLUSH
    return c.compress(data) + c.flush(mode), b"" if flush == "full" else (history + data)[-_WINDOW:]


#: What stands before and after raw deflate, by container: the head, the checksum and its first value, and the
#: trailer's layout of checksum and length.
_CONTAINERS = {
    "deflate": (b"", None, 0, ""),
    "zlib": (b"\x78\x9c", zlib.adler32, 1, ">I"),
    "gzip": (b"\x1f\x8b\x08\0\0\0\0\0\0\xff", zlib.crc32, 0, "<II"),
}
_KEPT = struct.Struct("<IQ")


def _contained(kept: bytes, data: bytes, flush: str, last: bool, codec: str) -> tuple[bytes, bytes]:
    """A piece with its container's head before the first and its trailer after the last; kept are the checksum and the length
    so far, and the text that the next piece may refer to."""
    head, checksum, begin, layout = _CONTAINERS[codec]
    check, size = _KEPT.unpack(kept[: _KEPT.size]) if kept else (begin, 0)
    piece, history = _piece(kept[_KEPT.size :], data, flush, last)
    check, size = checksum(data, check) if checksum else 0, size + len(data)
    trailer = struct.pack(layout, *(check, size % 2**32)[: len(layout) - 1]) if last and layout else b""
    return (b"" if kept else head) + piece + trailer, _KEPT.pack(check, size) + history


def _in_order(chunks: DataFrame, one, stream_col: str, seq_col: str, chunk_col: str, end_col: str | None) -> DataFrame:
    """Runs ``one(kept, data, last) -> (piece or None, kept)`` over the chunks of each stream in the order of their numbers,
    which count up from 0. A chunk that comes before its turn waits in the state; one whose turn is over has the status ``late``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, kept, waiting = (state.get[0], bytes(state.get[1]), pickle.loads(bytes(state.get[2]))) if state.exists else (0, b"", {})
        # One Arrow batch at a time: a stream's chunks of a micro-batch are never gathered.
        for rows in batches:
            out = []
            ends = rows[end_col].fillna(False) if end_col else [False] * len(rows)
            for seq, data, last in zip(rows[seq_col], rows[chunk_col], ends, strict=True):
                if seq < turn or seq in waiting:
                    out.append((key[0], int(seq), None, "late"))
                else:
                    waiting[int(seq)] = (bytes(data) if data is not None else b"", bool(last))
            while turn in waiting:
                piece, kept = one(kept, *waiting.pop(turn))
                if piece is not None:
                    out.append((key[0], turn, piece, "ok"))
                turn += 1
            if len(waiting) > MAX_WAITING:
                raise ValueError(f"stream {key[0]}: {len(waiting)} chunks wait for number {turn}")
            yield pd.DataFrame(out, columns=[stream_col, seq_col, "piece", "status"])
        state.update((turn, kept, pickle.dumps(waiting)))

    kind = chunks.schema[stream_col].dataType.simpleString()
    return chunks.groupBy(stream_col).applyInPandasWithState(
        run, f"{stream_col} {kind}, {seq_col} long, piece binary, status string", "turn long, kept binary, waiting binary", "append", GroupStateTimeout.NoTimeout
    )


def deflate_stream(chunks: DataFrame, stream_col: str = "stream_id", seq_col: str = "seq", chunk_col: str = "chunk", flush: str = "sync", end_col: str | None = None, codec: str = "deflate") -> DataFrame:
    """Flushed pieces of caller-chunked streams, as raw deflate, zlib or gzip: ``(stream, seq, piece, status)``.

    Each chunk's piece ends with a flush, so what was sent so far can be decoded; a flush never writes the trailer. The pieces of a
    stream, in order, are one stream of ``codec``; the piece of a chunk with ``end_col`` true ends it. The numbers of a stream's
    chunks count up from 0: chunks that come early wait until those before them are there, and a number that was compressed
    already gets no piece and the status ``late``. The state of a stream is its last 32 KiB of text under a sync flush, none
    under a full flush, its checksum and length, and the chunks that wait.
    """
    if flush not in ("sync", "full"):
        raise ValueError("flush is sync or full")
    if codec not in _CONTAINERS:
        raise ValueError(f"Unsupported: {codec} has no mark to flush at; see buffered_stream")
    return _in_order(chunks, lambda kept, data, last: _contained(kept, data, flush, last, codec), stream_col, seq_col, chunk_col, end_col)


def buffered_stream(chunks: DataFrame, codec: str, end_col: str, stream_col: str = "stream_id", seq_col: str = "seq", chunk_col: str = "chunk") -> DataFrame:
    """For codecs without a mark to flush at, for which a flush does nothing: ``(stream, seq, piece, status)`` with the whole
    encoded stream at the chunk with ``end_col`` true, and no piece before. The state of a stream is its text so far."""
    if codec not in ENCODERS:
        raise ValueError(f"Unsupported: {codec} cannot encode streams")

    def one(kept: bytes, data: bytes, last: bool) -> tuple[bytes | None, bytes]:
        return (ENCODERS[codec](kept + data, None), b"") if last else (None, kept + data)

    return _in_order(chunks, one, stream_col, seq_col, chunk_col, end_col)


def sizes_by_window(events: DataFrame, payload_col: str, time_col: str = "ts", codec: str = "gzip", width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """``(start, end, n_rows, raw_bytes, encoded_bytes)`` for each event-time window; rows later than ``late`` are left out once
    their window has closed. Works on streams and on tables."""
    window = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    sized = events.withWatermark(time_col, late).select(
        window.alias("w"), F.octet_length(payload_col).cast("long").alias("raw"), F.octet_length(encode(payload_col, codec)).cast("long").alias("enc")
    )
    out = sized.groupBy("w").agg(F.count("*").alias("n_rows"), F.sum("raw").alias("raw_bytes"), F.sum("enc").alias("encoded_bytes"))
    return out.select("w.start", "w.end", "n_rows", "raw_bytes", "encoded_bytes")
