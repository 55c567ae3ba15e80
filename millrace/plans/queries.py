"""The registered queries of the byte operators, each over whole tables, and the SQL that says the same."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import bytes as fb
from millrace.functions.codecs import ENCODERS, decode, encode, skip_output
from millrace.operators import report, stats, transforms
from millrace.plans import registry
from millrace.sources.tables import read_table, spread
from millrace.streaming import members


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return spread(docs).select("doc_id", "lang", "source", F.encode("text", "UTF-8").alias("raw"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    return spread(events).select("event_id", "event_type", F.encode("props", "UTF-8").alias("raw"))


def flagship_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and run-length encoded sizes by language and source."""
    docs = _documents(spark, sf_dir)
    return report.compression_report(docs, F.col("raw"), fb.rle90("raw"), "lang", "source").drop("ratio")


def gzip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and gzip sizes by language and source."""
    docs = _documents(spark, sf_dir)
    return report.compression_report(docs, F.col("raw"), encode("raw", "gzip"), "lang", "source")


def rle_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return report.compression_report(docs, F.col("raw"), fb.rle("raw"), "lang", "source", sets="rollup").drop("ratio")


def _round_trip(codec: str, level: int | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        back = _documents(spark, sf_dir).select("doc_id", decode(encode("raw", codec, level), codec).alias("back"))
        return back.select("doc_id", F.md5("back.data").alias("digest"), F.coalesce("back.error", F.lit("")).alias("error"))

    return run


def detect_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document in each of six codecs, and what its first bytes are taken for."""
    kinds = ("gzip", "zlib", "xz", "zstd", "bzip2", "lz4-frame", "snappy")
    docs = _documents(spark, sf_dir).select("doc_id", "raw", F.explode(F.array(*map(F.lit, kinds))).alias("codec"))
    named = docs.select("codec", fb.detect(encode("raw", F.col("codec"), among=kinds)).alias("detected"))
    return named.groupBy("codec", "detected").agg(F.count("*").alias("n_docs"))


def detect_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", fb.detect("raw").alias("detected"))


def registry_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.registry(spark).select("position", "name", "extension")


def crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.crc32("raw").alias("crc"))


def adler32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", fb.adler32("raw").alias("adler"))


def gzip_isize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length that a gzip trailer states, read back from the encoded bytes."""
    tail = F.hex(F.substring(encode("raw", "gzip"), -4, 4))
    size = F.conv(F.concat(*(F.substring(tail, k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("long")
    return _documents(spark, sf_dir).select("doc_id", size.alias("isize"))


def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.byte_histogram(_documents(spark, sf_dir), "raw", "lang")


def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.entropy(_documents(spark, sf_dir), "doc_id", "raw")
    return out.withColumn("entropy_bits", F.round(F.col("entropy_bits") * 1000).cast("long"))


def h2_huffman_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", fb.h2_huffman_length("raw").alias("h2_bytes"))


def rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fb.rle("raw")
    return _documents(spark, sf_dir).select("doc_id", F.md5(F.hex(out)).alias("rle_md5"), F.length(out).cast("long").alias("rle_bytes"))


def unrle(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = fb.unrle(fb.rle("raw"))
    return _documents(spark, sf_dir).select("doc_id", F.md5(back["data"]).alias("digest"), F.coalesce(back["error"], F.lit("")).alias("error"))


def roundtrip_rle90(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = fb.unrle90(fb.rle90("raw"))
    return _documents(spark, sf_dir).select("doc_id", F.md5(back["data"]).alias("digest"), F.coalesce(back["error"], F.lit("")).alias("error"))


def roundtrip_packbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _documents(spark, sf_dir).select("doc_id", decode(fb.packbits("raw"), "packbits").alias("back"))
    return back.select("doc_id", F.md5("back.data").alias("digest"), F.coalesce("back.error", F.lit("")).alias("error"))


def rle90_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.length(fb.rle90("raw")).cast("long").alias("rle90_bytes"))


def h2_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", F.hex(fb.h2_huffman("raw")).alias("h2"))


def _delta(distance: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _documents(spark, sf_dir).select("doc_id", F.md5(F.hex(fb.delta("raw", distance))).alias("delta_md5"))

    return run


def undelta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas of four distances, inverted."""
    back = [fb.undelta(fb.delta("raw", d), d)["data"] for d in (1, 2, 7, 256)]
    return _events(spark, sf_dir).select("event_id", *(F.md5(b).alias(f"digest_{k}") for k, b in enumerate(back)))


def unh2_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = fb.unh2_huffman(fb.h2_huffman("raw"))
    return _documents(spark, sf_dir).select("doc_id", F.md5(back["data"]).alias("digest"), F.coalesce(back["error"], F.lit("")).alias("error"))


def mtf_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", F.hex(transforms.mtf("raw")).alias("mtf"))


def bwt_last_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of the transform: length, primary index, last column."""
    return _events(spark, sf_dir).select("event_id", F.hex(transforms.bwt("raw")).alias("bwt"))


def skip_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows the first 100 decoded bytes."""
    rest = skip_output(encode("raw", "zstd"), "zstd", 100)
    return _documents(spark, sf_dir).select("doc_id", F.md5(rest["data"]).alias("digest"), F.octet_length(rest["data"]).cast("long").alias("n_bytes"))


def gzip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document in three chunks, a gzip member for each; the members in order are one file."""
    cut = F.ceil(F.octet_length("raw") / 3).cast("int")
    chunks = _documents(spark, sf_dir).select(F.col("doc_id").alias("stream_id"), F.posexplode(F.array(*(F.substring("raw", k * cut + 1, cut) for k in range(3)))).alias("seq", "chunk"))
    whole = members.gzip_members(chunks).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "member"))).alias("m"))
    back = decode(F.concat(*(F.col("m")[k]["member"] for k in range(3))), "gzip")
    return whole.select(F.col("stream_id").alias("doc_id"), F.md5(back["data"]).alias("digest"), F.coalesce(back["error"], F.lit("")).alias("error"))


def _streamed(spark: SparkSession, sf_dir: str, run, back: str) -> DataFrame:
    """The events of each user as a stream of chunks, run through Structured Streaming over a written table, decoded again."""
    top = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")
    folder = f"{top}/millrace/{uuid.uuid4().hex}"
    events = read_table(spark, sf_dir, "events").select("user_id", "event_id", F.encode("props", "UTF-8").alias("chunk"))
    order = Window.partitionBy("user_id").orderBy("event_id")
    chunks = events.select(
        F.col("user_id").alias("stream_id"), (F.row_number().over(order) - 1).cast("long").alias("seq"), "chunk",
        F.lead("event_id").over(order).isNull().alias("last"),
    )
    chunks.write.parquet(f"{folder}/in")
    source = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    query = run(source).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    pieces = spark.read.parquet(f"{folder}/out").groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("p"))
    joined = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["piece"])), ""))
    out = decode(joined, back)
    return pieces.select(F.col("stream_id").alias("user_id"), F.md5(out["data"]).alias("digest"), F.coalesce(out["error"], F.lit("")).alias("error"))


def stream_sync_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda s: members.deflate_stream(s, end_col="last"), "deflate")


def stream_full_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda s: members.deflate_stream(s, flush="full", end_col="last"), "deflate")


def stream_gzip_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda s: members.deflate_stream(s, end_col="last", codec="gzip"), "gzip")


def stream_buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda s: members.buffered_stream(s, "bzip2", "last"), "bzip2")


def window_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.encode("props", "UTF-8").alias("raw"))
    out = members.sizes_by_window(events, "raw", codec="rle")
    return out.select(F.unix_timestamp("start").alias("start_s"), "n_rows", "raw_bytes", "encoded_bytes")


def mtf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.md5(transforms.unmtf(transforms.mtf("raw"))).alias("digest"))


def bwt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.md5(transforms.unbwt(transforms.bwt("raw"))).alias("digest"))


def output_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoding under a cap of 1000 bytes: which documents fit."""
    back = decode(encode("raw", "gzip"), "gzip", max_output=1000)
    named = _documents(spark, sf_dir).select("doc_id", back.alias("back"))
    return named.select("doc_id", F.coalesce("back.error", F.lit("ok")).alias("status"), F.coalesce(F.octet_length("back.data"), F.lit(-1)).cast("long").alias("n_bytes"))


def truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams cut one byte short are typed errors, never rows that stop a job."""
    docs = _documents(spark, sf_dir).select("doc_id", encode("raw", "xz").alias("whole"))
    cut = docs.select("doc_id", decode(F.substring("whole", F.lit(1), F.length("whole") - 1), "xz").alias("back"))
    return cut.select("doc_id", F.col("back.error").alias("error"))


_DIGEST = "SELECT doc_id, md5(text) AS digest, '' AS error FROM documents"
_BYTES = """bytes AS (SELECT doc_id, n, i, CAST('0x' || x AS INT) AS b FROM (SELECT doc_id, n, unnest(l) AS x, generate_subscripts(l, 1) AS i
    FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS l, strlen(text) AS n FROM documents)))"""
_RUNS = _BYTES + """, starts AS (SELECT *, CASE WHEN lag(b) OVER w IS DISTINCT FROM b THEN 1 ELSE 0 END AS s FROM bytes WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    runs AS (SELECT doc_id, g, b, count(*) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM starts) GROUP BY ALL),
    pairs AS (SELECT doc_id, g, repeat('FF' || printf('%02X', b), CAST(n // 255 AS INT)) || CASE WHEN n % 255 > 0 THEN printf('%02X', n % 255) || printf('%02X', b) ELSE '' END AS p FROM runs)"""


def _delta_sql(d: int) -> str:
    return f"""WITH {_BYTES}, moved AS (SELECT *, (b - lag(b, {d}, 0) OVER (PARTITION BY doc_id ORDER BY i) + 256) % 256 AS x FROM bytes)
        SELECT d.doc_id, md5(coalesce(string_agg(printf('%02X', x), '' ORDER BY i), '')) AS delta_md5
        FROM documents d LEFT JOIN moved m ON d.doc_id = m.doc_id GROUP BY d.doc_id"""


def _crc_table() -> list[int]:
    """What the checksum of one byte comes to, for all 256."""
    return [zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)]


_EVENT_BYTES = """bytes AS (SELECT event_id, n, i, CAST('0x' || x AS INT) AS b FROM (SELECT event_id, n, unnest(l) AS x, generate_subscripts(l, 1) AS i
    FROM (SELECT event_id, regexp_extract_all(hex(encode(props)), '..') AS l, strlen(props) AS n FROM events)))"""
_STREAMS = "SELECT user_id, md5(string_agg(props, '' ORDER BY event_id)) AS digest, '' AS error FROM events GROUP BY user_id"


QUERIES = {
    "flagship_report": flagship_report,
    "gzip_report": gzip_report,
    **{f"roundtrip_{c.replace('-', '_')}": _round_trip(c) for c in ENCODERS},
    "roundtrip_gzip_level1": _round_trip("gzip", 1),
    "roundtrip_zstd_level19": _round_trip("zstd", 19),
    "detect_encoded": detect_encoded,
    "detect_raw": detect_raw,
    "registry_names": registry_names,
    "crc32": crc32,
    "adler32": adler32,
    "gzip_isize": gzip_isize,
    "byte_histogram": byte_histogram,
    "entropy": entropy,
    "h2_huffman_length": h2_huffman_length,
    "rle": rle,
    "unrle": unrle,
    "rle_rollup": rle_rollup,
    "roundtrip_rle90": roundtrip_rle90,
    "roundtrip_packbits": roundtrip_packbits,
    "rle90_size": rle90_size,
    "h2_huffman": h2_huffman,
    "delta_1": _delta(1),
    "delta_4": _delta(4),
    "undelta": undelta,
    "unh2_huffman": unh2_huffman,
    "mtf_hex": mtf_hex,
    "bwt_last_column": bwt_last_column,
    "skip_bytes": skip_bytes,
    "gzip_members": gzip_members,
    "stream_sync_flush": stream_sync_flush,
    "stream_full_flush": stream_full_flush,
    "stream_gzip_flush": stream_gzip_flush,
    "stream_buffered": stream_buffered,
    "window_sizes": window_sizes,
    "mtf_round_trip": mtf_round_trip,
    "bwt_round_trip": bwt_round_trip,
    "output_limit": output_limit,
    "truncated": truncated,
}

ORACLES = {
    **{k: _DIGEST for k in QUERIES if k.startswith("roundtrip_") or k == "unrle"},
    "detect_encoded": "SELECT codec, CASE WHEN codec <> 'snappy' THEN codec END AS detected, count(*) AS n_docs FROM documents, (SELECT unnest(['gzip', 'zlib', 'xz', 'zstd', 'bzip2', 'lz4-frame', 'snappy']) AS codec) GROUP BY codec",
    "detect_raw": """SELECT doc_id, CASE WHEN text LIKE 'BZh%' THEN 'bzip2' WHEN text LIKE 'StuffIt%' THEN 'arsenic'
        WHEN text LIKE 'x%' AND strlen(text) >= 2 AND (120 * 256 + CAST('0x' || substr(hex(encode(text)), 3, 2) AS INT)) % 31 = 0 THEN 'zlib' END AS detected FROM documents""",
    "registry_names": "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}', {repr(e) if e else 'NULL'})" for k, (n, e) in enumerate(registry.NAMES)) + ") AS t(position, name, extension)",
    "adler32": f"""WITH {_BYTES} SELECT doc_id, CAST(sum((n - i + 1) * b) + max(n) AS BIGINT) % 65521 * 65536 + (1 + CAST(sum(b) AS BIGINT)) % 65521 AS adler
        FROM bytes GROUP BY doc_id UNION ALL SELECT doc_id, 1 FROM documents WHERE text = ''""",
    "gzip_isize": "SELECT doc_id, strlen(text) AS isize FROM documents",
    "byte_histogram": f"WITH {_BYTES} SELECT lang, b AS byte, count(*) AS n FROM bytes JOIN documents USING (doc_id) GROUP BY lang, b",
    "entropy": f"""WITH {_BYTES}, c AS (SELECT doc_id, b, count(*) AS k FROM bytes GROUP BY doc_id, b)
        SELECT doc_id, CAST(sum(k) AS BIGINT) AS n_bytes, count(*) AS distinct_bytes, CAST(round((log2(sum(k)) - sum(k * log2(k)) / sum(k)) * 1000) AS BIGINT) AS entropy_bits FROM c GROUP BY doc_id""",
    "h2_huffman_length": """WITH codes(b, bits) AS (VALUES """ + ", ".join(f"({b}, {n})" for b, n in enumerate(fb.H2_LENGTHS)) + """),
        bytes AS (SELECT event_id, CAST('0x' || substr(h, 2 * i - 1, 2) AS INT) AS b FROM (SELECT event_id, h, unnest(range(1, len(h) // 2 + 1)) AS i FROM (SELECT event_id, hex(encode(props)) AS h FROM events)))
        SELECT event_id, CAST(ceil(sum(bits) / 8) AS BIGINT) AS h2_bytes FROM bytes JOIN codes USING (b) GROUP BY event_id""",
    "rle": f"WITH {_RUNS} SELECT doc_id, md5(string_agg(p, '' ORDER BY g)) AS rle_md5, CAST(sum(len(p)) // 2 AS BIGINT) AS rle_bytes FROM pairs GROUP BY doc_id",
    "rle_rollup": f"""WITH {_RUNS}, sizes AS (SELECT doc_id, sum(len(p)) // 2 AS enc FROM pairs GROUP BY doc_id)
        SELECT lang, source, count(*) AS n_rows, CAST(sum(strlen(text)) AS BIGINT) AS raw_bytes, CAST(sum(coalesce(enc, 0)) AS BIGINT) AS encoded_bytes
        FROM documents LEFT JOIN sizes USING (doc_id) GROUP BY ROLLUP (lang, source)""",
    "flagship_report": f"""WITH {_RUNS}, pieces AS (SELECT doc_id, b, unnest(list_concat([255 for x in range(n // 255)], CASE WHEN n % 255 > 0 THEN [n % 255] ELSE [] END)) AS m FROM runs),
        sizes AS (SELECT doc_id, sum((CASE WHEN b = 144 THEN 2 ELSE 1 END) * (CASE WHEN m >= 3 THEN 1 ELSE m END) + CASE WHEN m >= 3 THEN 2 ELSE 0 END) AS enc FROM pieces GROUP BY doc_id)
        SELECT lang, source, count(*) AS n_rows, CAST(sum(strlen(text)) AS BIGINT) AS raw_bytes, CAST(sum(coalesce(enc, 0)) AS BIGINT) AS encoded_bytes
        FROM documents LEFT JOIN sizes USING (doc_id) GROUP BY lang, source""",
    "rle90_size": f"""WITH {_RUNS}, pieces AS (SELECT doc_id, b, unnest(list_concat([255 for x in range(n // 255)], CASE WHEN n % 255 > 0 THEN [n % 255] ELSE [] END)) AS m FROM runs)
        SELECT doc_id, CAST(sum((CASE WHEN b = 144 THEN 2 ELSE 1 END) * (CASE WHEN m >= 3 THEN 1 ELSE m END) + CASE WHEN m >= 3 THEN 2 ELSE 0 END) AS BIGINT) AS rle90_bytes FROM pieces GROUP BY doc_id""",
    "h2_huffman": """WITH codes(b, bits) AS (VALUES """ + ", ".join(f"({b}, '{c}')" for b, c in enumerate(fb.h2_codes())) + """),
        bytes AS (SELECT event_id, i, CAST('0x' || x AS INT) AS b FROM (SELECT event_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT event_id, regexp_extract_all(hex(encode(props)), '..') AS l FROM events))),
        joined AS (SELECT event_id, string_agg(bits, '' ORDER BY i) AS bits FROM bytes JOIN codes USING (b) GROUP BY event_id),
        full_ AS (SELECT event_id, bits || repeat('1', CAST((8 - len(bits) % 8) % 8 AS INT)) AS bits FROM joined)
        SELECT event_id, string_agg(printf('%02X', v), '' ORDER BY k) AS h2 FROM (
            SELECT event_id, k, CAST(list_sum([CAST(substr(bits, 8 * k + j, 1) AS INT) * CAST(pow(2, 8 - j) AS INT) for j in range(1, 9)]) AS INT) AS v
            FROM (SELECT event_id, bits, unnest(range(len(bits) // 8)) AS k FROM full_)) GROUP BY event_id""",
    "delta_1": _delta_sql(1),
    "delta_4": _delta_sql(4),
    "undelta": "SELECT event_id, " + ", ".join(f"md5(props) AS digest_{k}" for k in range(4)) + " FROM events",
    "unh2_huffman": _DIGEST,
    "mtf_hex": f"""WITH {_EVENT_BYTES}, prev AS (SELECT *, lag(i) OVER (PARTITION BY event_id, b ORDER BY i) AS p FROM bytes),
        ranks AS (SELECT x.event_id, x.i, CASE WHEN any_value(x.p) IS NULL THEN any_value(x.b) + count(DISTINCT y.b) FILTER (WHERE y.b > x.b)
            ELSE count(DISTINCT y.b) FILTER (WHERE y.i > x.p) END AS r
            FROM prev x LEFT JOIN bytes y ON x.event_id = y.event_id AND y.i < x.i GROUP BY x.event_id, x.i)
        SELECT event_id, string_agg(printf('%02X', r), '' ORDER BY i) AS mtf FROM ranks GROUP BY event_id""",
    "bwt_last_column": """WITH turned AS (SELECT event_id, n, k, substr(h || h, 2 * k + 1, 2 * n) AS t, substr(h || h, 2 * ((k + n - 1) % n) + 1, 2) AS last
            FROM (SELECT event_id, hex(encode(props)) AS h, strlen(props) AS n, unnest(range(strlen(props))) AS k FROM events)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY t, k) - 1 AS r FROM turned)
        SELECT event_id, printf('%02X000000', any_value(n)) || printf('%02X000000', max(r) FILTER (WHERE k = 0)) || string_agg(last, '' ORDER BY r) AS bwt
        FROM ranked GROUP BY event_id""",
    "skip_bytes": """SELECT doc_id, md5(unhex(substr(hex(encode(text)), 201))) AS digest, greatest(strlen(text) - 100, 0) AS n_bytes FROM documents""",
    "gzip_members": _DIGEST,
    "stream_sync_flush": _STREAMS,
    "stream_full_flush": _STREAMS,
    "stream_gzip_flush": _STREAMS,
    "stream_buffered": _STREAMS,
    "window_sizes": f"""WITH {_EVENT_BYTES}, starts AS (SELECT *, CASE WHEN lag(b) OVER w IS DISTINCT FROM b THEN 1 ELSE 0 END AS s FROM bytes WINDOW w AS (PARTITION BY event_id ORDER BY i)),
        enc AS (SELECT event_id, 2 * CAST(sum(s) AS BIGINT) AS e FROM starts GROUP BY event_id)
        SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start_s, count(*) AS n_rows, CAST(sum(strlen(props)) AS BIGINT) AS raw_bytes, CAST(sum(e) AS BIGINT) AS encoded_bytes
        FROM events JOIN enc USING (event_id) GROUP BY ALL""",
    "crc32": f"""WITH t AS (SELECT [{", ".join(map(str, _crc_table()))}] AS tbl),
        b AS (SELECT doc_id, list_concat([4294967295::BIGINT], [CAST('0x' || x AS BIGINT) for x in regexp_extract_all(hex(encode(text)), '..')]) AS l FROM documents)
        SELECT doc_id, xor(list_reduce(l, lambda a, x: xor(a >> 8, tbl[CAST(xor(a, x) & 255 AS INT) + 1])), 4294967295::BIGINT) AS crc FROM b, t""",
    "mtf_round_trip": "SELECT doc_id, md5(text) AS digest FROM documents",
    "bwt_round_trip": "SELECT doc_id, md5(text) AS digest FROM documents",
    "output_limit": "SELECT doc_id, CASE WHEN strlen(text) <= 1000 THEN 'ok' ELSE 'OutputLimitExceeded' END AS status, CASE WHEN strlen(text) <= 1000 THEN strlen(text) ELSE -1 END AS n_bytes FROM documents",
    "truncated": "SELECT doc_id, 'UnexpectedEnd' AS error FROM documents",
}
