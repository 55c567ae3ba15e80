import bz2
import gzip
import lzma
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.functions import buffers
from millrace.functions import bytes as fb
from millrace.functions.codecs import ENCODERS, decode, encode, skip_output, try_encode
from millrace.operators import report, stats, transforms
from millrace.plans.registry import NAMES, registry, with_extension
from millrace.sources import files
from millrace.streaming import members

PAYLOADS = [None, b"", b"a", b"aaaa" * 200, bytes(range(256)) * 3, "é漢字".encode(), b"\x00" * 255 + b"\x01", b"abcabcabc" * 50]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, p) for i, p in enumerate(PAYLOADS)], "id long, raw binary")


def _one(df, column):
    return {r.id: r.x for r in df.select("id", column.alias("x")).collect()}


def test_rle_and_back(rows):
    def want(b):
        out, at = bytearray(), 0
        while at < len(b):
            n = 1
            while n < 255 and at + n < len(b) and b[at + n] == b[at]:
                n += 1
            out += bytes([n, b[at]])
            at += n
        return bytes(out)

    got = _one(rows, fb.rle("raw"))
    assert all(got[i] == (None if p is None else want(p)) for i, p in enumerate(PAYLOADS))
    back = _one(rows, fb.unrle(fb.rle("raw")))
    assert all(back[i].data is None if p is None else (bytes(back[i].data), back[i].error) == (p, None) for i, p in enumerate(PAYLOADS))


def test_rle90_and_packbits_and_back(spark, rows):
    more = [b"\x90" * 7, b"a\x90b", b"\x00\x90\x90", b"ab" * 200 + b"c" * 300, b"aab" * 5, b"xx"]
    df = rows.union(spark.createDataFrame([(100 + i, p) for i, p in enumerate(more)], rows.schema))
    want = dict(enumerate(PAYLOADS)) | {100 + i: p for i, p in enumerate(more)}
    for back in (fb.unrle90(fb.rle90("raw")), decode(fb.packbits("raw"), "packbits")):
        got = _one(df, back)
        assert all((got[i] is None or got[i].data is None) if p is None else (bytes(got[i].data), got[i].error) == (p, None) for i, p in want.items())
    assert _one(df, fb.rle90("raw"))[100] == b"\x90\x00\x90\x07" and _one(df, fb.packbits("raw"))[105] == b"\x01xx"
    bad = spark.createDataFrame([(0, b"\x90\x05"), (1, b"a\x90"), (2, b"a\x90\x03\x90\x02b")], "id long, raw binary")
    got = _one(bad, fb.unrle90("raw"))
    assert [got[0].error, got[1].error, bytes(got[2].data)] == ["Corrupt", "UnexpectedEnd", b"aaaab"]


def test_h2_huffman_vectors(spark):
    df = spark.createDataFrame([(0, b"www.example.com"), (1, b"no-cache"), (2, b"")], "id long, raw binary")
    got = {k: bytes(v).hex() for k, v in _one(df, fb.h2_huffman("raw")).items()}
    assert got == {0: "f1e3c2e5f23a6ba0ab90f4ff", 1: "a8eb10649cbf", 2: ""}


def test_h2_huffman_decodes_and_rejects(spark, rows):
    back = _one(rows, fb.unh2_huffman(fb.h2_huffman("raw")))
    assert all((back[i] is None or back[i].data is None) if p is None else (bytes(back[i].data), back[i].error) == (p, None) for i, p in enumerate(PAYLOADS))
    # The end mark, filling of eight ones, filling with a zero; and a whole string.
    bad = [b"\xff\xff\xff\xff", b"\xff", b"\x1f\xff", b"\xfe", b"\x00\x00\x00\x00\x00\x01"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate([*bad, bytes.fromhex("f1e3c2e5f23a6ba0ab90f4ff")])], "id long, raw binary")
    got = _one(df, fb.unh2_huffman("raw"))
    assert [got[i].error for i in range(6)] == ["Corrupt", "Corrupt", "Corrupt", "Corrupt", "Corrupt", None] and got[5].data == b"www.example.com"


def test_h2_huffman_follows_long_and_damaged_rows():
    import time

    import numpy as np

    code, bits = fb.h2_code(), fb.h2_codes()
    symbols = {b: k for k, b in enumerate(bits)}

    def plain(row, most):
        out, held = bytearray(), ""
        for bit in "".join(f"{b:08b}" for b in row):
            held += bit
            if held in symbols:
                out.append(symbols[held])
                held = ""
                if len(out) > most:
                    return b"", buffers.OVER_LIMIT
            elif held == "1" * 30:
                return b"", buffers.CORRUPT
        return (b"", buffers.CORRUPT) if len(held) > 7 or "0" in held else (bytes(out), 0)

    def decoded(rows, most):
        ends = np.cumsum([0, *map(len, rows)])
        data, offsets, error = code.decode(np.frombuffer(b"".join(rows), np.uint8), ends, most)
        return [(data[a:b].tobytes(), e) for a, b, e in zip(offsets[:-1], offsets[1:], error, strict=True)]

    draw = np.random.default_rng(3)
    texts = [draw.choice(kind, n).astype(np.uint8).tobytes() for kind in ([97, 101, 32, 48, 200], [0], [255, 249], range(256)) for n in (0, 1, 90, 700, 3000)]
    rows = [bytearray(code.encode(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tobytes()) for t in texts]
    assert decoded(rows, 2**62) == [(t, 0) for t in texts]
    for row in rows:
        if row:
            row[draw.integers(len(row))] ^= 1 << int(draw.integers(8))
    rows += [row[: len(row) // 2] for row in rows] + [draw.integers(0, 256, n).astype(np.uint8).tobytes() for n in (1, 2, 5, 600)]
    for most in (2**62, 50):
        assert decoded(rows, most) == [plain(row, most) for row in rows]
    # One long row takes a step for each byte of a piece, not for each of its symbols.
    began = time.perf_counter()
    long = np.resize(np.frombuffer(b"some text, ", np.uint8), 3_000_000)
    assert decoded([code.encode(long, np.array([0, len(long)]))[0].tobytes()], 2**62) == [(long.tobytes(), 0)]
    assert time.perf_counter() - began < 20


def test_buffers_over_slices_and_nulls():
    import numpy as np
    import pyarrow as pa

    values = pa.array([b"zz", None, b"aaab", b"", b"\x90\x90", None, b"q" * 700], pa.binary()).slice(1)
    data, offsets = buffers.rows_of(values)
    assert offsets.tolist() == [0, 0, 4, 4, 6, 6, 706]
    for there, back in ((buffers.rle, buffers.unrle), (buffers.rle90, buffers.unrle90), (buffers.packbits, buffers.unpackbits)):
        whole = buffers._encoded(values, there)
        cut = [there(d, o) for _, _, d, o in buffers.in_turn(data, offsets, 3)]
        assert b"".join(d.tobytes() for d, _ in cut) == b"".join(x or b"" for x in whole.to_pylist()) and whole.null_count == 2
        assert buffers._decoded(whole, back, 2**62).field(0).to_pylist() == values.to_pylist()
    assert buffers.counts(np.frombuffer(b"aab", np.uint8), np.array([0, 1, 1]), 2)[1, 97] == 1


def test_unrle_errors(spark):
    df = spark.createDataFrame([(0, b"\x00a"), (1, b"\x01"), (2, b"\x02ab")], "id long, raw binary")
    assert [_one(df, fb.unrle("raw"))[i].error for i in range(3)] == ["Corrupt", "UnexpectedEnd", "UnexpectedEnd"]


@pytest.mark.parametrize("d", [1, 4, 256])
def test_delta(rows, d):
    got = _one(rows, fb.delta("raw", d))
    for i, p in enumerate(PAYLOADS):
        assert got[i] == (None if p is None else bytes((x - (p[k - d] if k >= d else 0)) % 256 for k, x in enumerate(p)))


def test_delta_distance_is_checked():
    for d in (0, 257):
        for one in (fb.delta, fb.undelta):
            with pytest.raises(ValueError, match="Unsupported"):
                one("raw", d)


@pytest.mark.parametrize("d", [1, 2, 3, 16, 255, 256])
def test_undelta(rows, d):
    got = _one(rows, fb.undelta(fb.delta("raw", d), d))
    assert all(got[i].data == p for i, p in enumerate(PAYLOADS) if p is not None) and got[0].data is None
    assert _one(rows, fb.undelta("raw", d, max_output=100))[3].error == "OutputLimitExceeded"


def test_checksums(rows):
    assert all(v == (None if p is None else zlib.adler32(p)) for (_, v), p in zip(sorted(_one(rows, fb.adler32("raw")).items()), PAYLOADS, strict=True))
    assert all(v == (None if p is None else zlib.crc32(p)) for (_, v), p in zip(sorted(_one(rows, F.crc32("raw")).items()), PAYLOADS, strict=True))


def test_detect(spark):
    heads = {
        "xz": lzma.compress(b"x"), "gzip": gzip.compress(b"x"), "bzip2": bz2.compress(b"x"), "zlib": zlib.compress(b"x"), "zstd": b"\x28\xb5\x2f\xfd\0",
        "lz4-frame": b"\x04\x22\x4d\x18", "rar5": bytes.fromhex("526172211a070100"), "rar3": bytes.fromhex("526172211a0700"), "arsenic": b"StuffIt (c)",
    }
    sit = b"SIT!" + b"\0" * 6 + b"rLau"
    cases = [*heads.items(), ("arsenic", sit), (None, b"\x78\x02"), (None, b"x"), (None, b""), (None, None), (None, b"plain text")]
    df = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(cases)], "id long, raw binary")
    assert [v for _, v in sorted(_one(df, fb.detect("raw")).items())] == [n for n, _ in cases]


@pytest.mark.parametrize("codec", list(ENCODERS))
def test_round_trip(rows, codec):
    got = _one(rows, decode(encode("raw", codec), codec))
    assert all((got[i].data, got[i].error) == (p, None) for i, p in enumerate(PAYLOADS))


@pytest.mark.parametrize("codec", list(ENCODERS))
def test_limits_and_damage(spark, codec):
    data = bytes(range(256)) * 8
    df = spark.createDataFrame([(0, data)], "id long, raw binary")
    exact = _one(df, decode(encode("raw", codec), codec, max_output=len(data)))[0]
    over = _one(df, decode(encode("raw", codec), codec, max_output=len(data) - 1))[0]
    assert (exact.error, over.error, over.data) == (None, "OutputLimitExceeded", None)
    cut = F.substring(encode("raw", codec), 1, 20)
    assert _one(df, decode(cut, codec))[0].error in ("UnexpectedEnd", "Corrupt")
    shorter = spark.range(1).select(*(decode(F.substring(encode(F.lit(data), codec), F.lit(1), F.length(encode(F.lit(data), codec)) - k), codec).alias(str(k)) for k in (1, 2, 3, 5, 10))).first()
    assert all(x.data is None and x.error is not None for x in shorter)
    junk = _one(df, decode(F.lit(b"\xff" * 300), codec))[0]
    assert junk.error is not None


def test_trailing_bytes(spark):
    data = b"payload"
    cases = [(0, "gzip", gzip.compress(data) * 2), (1, "gzip", gzip.compress(data) + b"junk"), (2, "bzip2", bz2.compress(data) * 2), (3, "xz", lzma.compress(data) * 2), (4, "none", data), (5, "zstd", b"\x50\x2a\x4d\x18\0\0\0\0")]
    df = spark.createDataFrame(cases, "id long, codec string, raw binary")
    got = _one(df, decode("raw", F.col("codec")))
    assert [got[k].data for k in range(4)] == [data * 2, data, data, data]
    assert [got[k].error for k in (4, 5)] == ["Unsupported", "Unsupported"]


def test_error_kinds(spark):
    import zstandard

    whole = bytearray(gzip.compress(b"payload" * 9))
    changed = lambda at: bytes(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
    plain = zstandard.ZstdCompressor(write_content_size=False, write_checksum=True).compress(b"x" * 5000)
    wrong = plain[:-1] + bytes([plain[-1] ^ 1])
    cases = [
        ("gzip", changed(len(whole) - 1), "TrailerMismatch"), ("gzip", changed(len(whole) - 8), "ChecksumMismatch"), ("gzip", changed(0), "BadHeader"), ("gzip", changed(2), "BadHeader"),
        ("gzip", b"\x1f\x8b\x08\xe0" + bytes(whole[4:]), "Unsupported"), ("zlib", b"\x78\x9d\x00", "BadHeader"), ("zlib", b"\x79\x9c\x00", "BadHeader"), ("zlib", b"\x78\xbb\x00", "Unsupported"),
        ("deflate", b"\x07", "InvalidBlockType"), ("bzip2", b"BZx9aaaa", "BadHeader"), ("xz", b"nothing like it", "BadHeader"), ("zstd", b"abcdefgh", "BadHeader"),
        ("zstd", b"\x28\xb5\x2f\xfd\x00", "UnexpectedEnd"), ("zstd", wrong, "ChecksumMismatch"), ("lz4-frame", b"nothing like it", "BadHeader"), ("brotli", b"", "UnexpectedEnd"),
        *(("zstd", plain[:-k], "UnexpectedEnd") for k in (1, 2, 3, 10)), ("zstd", plain * 2, None), ("zstd", plain + b"junk", None),
    ]
    df = spark.createDataFrame([(k, c, bytes(b)) for k, (c, b, _) in enumerate(cases)], "id long, codec string, raw binary")
    got = _one(df, decode("raw", F.col("codec")))
    assert [got[k].error for k in range(len(cases))] == [e for *_, e in cases] and got[len(cases) - 1].data == b"x" * 5000


def test_known_names_spare_the_other_codecs(spark):
    named = spark.createDataFrame([(1, "xz", b"x" * 50), (2, "rle", b"aab"), (3, "bzip2", b"y"), (4, "gzip", None)], "id long, codec string, raw binary")
    some = named.where("id <> 3").select("id", encode("raw", F.col("codec"), among=("gzip", "xz", "rle")).alias("x"))
    got = {r.id: r.x for r in some.collect()}
    assert lzma.decompress(got[1]) == b"x" * 50 and got[2] == b"\x02a\x01b" and got[4] is None
    assert some._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2
    tried = _one(named, try_encode("raw", F.col("codec"), among=("gzip", "xz", "nope")))
    assert [tried[k].error for k in (1, 2, 3, 4)] == [None, "Unsupported", "Unsupported", None]


def test_unknown_codecs_never_lose_a_payload(spark, rows, tmp_path):
    for name in ("nope", "lzw", ""):
        with pytest.raises(ValueError, match="Unsupported"):
            encode("raw", name)
    named = spark.createDataFrame([(1, "nope", b"x"), (2, "gzip", b"x"), (3, None, b"x"), (4, "nope", None)], "id long, codec string, raw binary")
    with pytest.raises(Exception, match="Unsupported"):
        named.select(encode("raw", F.col("codec"))).collect()
    tried = _one(named, try_encode("raw", F.col("codec")))
    assert [tried[k].error for k in (1, 2, 3, 4)] == ["Unsupported", None, "Unsupported", None] and gzip.decompress(tried[2].data) == b"x"
    for column in ("codec", "RAW_BYTES"):
        with pytest.raises(ValueError, match="columns named"):
            files.write_encoded(rows.withColumn(column, F.lit(1)), "raw", "gzip", str(tmp_path / "t"))
    files.write_encoded(rows.withColumnRenamed("id", "error"), "raw", "gzip", str(tmp_path / "t"))
    with pytest.raises(ValueError, match="columns named"):
        files.read_encoded(spark, str(tmp_path / "t"), "raw")


def test_one_batch_may_decode_to_more_than_an_array_holds(spark):
    rest = skip_output(F.lit(ENCODERS["zstd"](bytes(1 << 24), None)), "zstd", 100)
    got = spark.range(0, 140, 1, 1).select(F.octet_length(rest["data"]).alias("n")).groupBy("n").count().collect()
    assert got == [((1 << 24) - 100, 140)]


def test_xz_of_one_batch_may_decode_to_more_than_an_array_holds(spark):
    back = decode(F.lit(ENCODERS["xz"](bytes(1 << 24), None)), "xz")
    got = spark.range(0, 140, 1, 1).select(F.octet_length(back["data"]).alias("n")).groupBy("n").count().collect()
    assert got == [(1 << 24, 140)]


@pytest.mark.parametrize("block", [1, 7, 16, transforms.BLOCK])
def test_bwt_of_all_rows_together(block):
    import time

    import numpy as np
    import pyarrow as pa

    def plain(row):
        out = b""
        for t in (row[k : k + block] for k in range(0, len(row), block)):
            order = sorted(range(len(t)), key=lambda k: (t[k:] + t[:k], k))
            out += len(t).to_bytes(4, "little") + order.index(0).to_bytes(4, "little") + bytes(t[k - 1] for k in order)
        return out

    bwt = lambda rows: buffers._encoded(pa.array(rows, pa.binary()), lambda data, offsets: transforms._bwt(data, offsets, block)).to_pylist()
    draw = np.random.default_rng(5)
    rows = [None, b"", b"a", b"banana", b"ab" * 40, b"a" * 100, b"abcabcabc" * 5, *(draw.choice([0, 98, 255], n).astype(np.uint8).tobytes() for n in (8, 9, 16, 17, 200))]
    assert bwt(rows) == [None if r is None else plain(r) for r in rows]
    # Short rows cost no call of their own.
    began = time.perf_counter()
    assert len(bwt([b'{"k": 76}'] * 200_000)) == 200_000
    assert time.perf_counter() - began < 10


def test_mtf_passes_a_batch_on_in_pieces():
    import pyarrow as pa

    for one in (transforms._mtf, transforms._unmtf):
        batch = pa.array([bytes([k]) * (1 << 20) for k in range(4)] + [None, b""], pa.binary())
        pieces = list(buffers.mapped(iter([batch, batch.slice(4)]), one))
        assert [len(x) for x in pieces] == [2, 2, 2, 2]
        assert pa.concat_arrays(pieces).to_pylist() == [one(d) if d is not None else None for d in batch.to_pylist() + [None, b""]]


def test_skip_output(rows):
    got = _one(rows, skip_output(encode("raw", "gzip"), "gzip", 700))
    assert all(got[i].data == p[700:] for i, p in enumerate(PAYLOADS) if p is not None) and got[0] is None


def test_write_decoded(spark, rows, tmp_path):
    coded = rows.where("raw is not null").withColumn("raw", encode("raw", "xz"))
    files.write_decoded(coded, "raw", "xz", str(tmp_path / "t"))
    assert {r.id: r.raw for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {i: p for i, p in enumerate(PAYLOADS) if p is not None}
    with pytest.raises(Exception, match="UnexpectedEnd"):
        files.write_decoded(coded.withColumn("raw", F.expr("substring(raw, 1, length(raw) - 1)")), "raw", "xz", str(tmp_path / "u"))


def test_transforms(rows):
    for there, back in ((transforms.mtf, transforms.unmtf), (lambda c: transforms.bwt(c, 100), transforms.unbwt)):
        got = _one(rows, back(there("raw")))
        assert all(got[i] == p for i, p in enumerate(PAYLOADS))
    assert _one(rows.where("id = 7"), transforms.mtf("raw"))[7][:6] == bytes([97, 98, 99, 2, 2, 2])


def test_h2_length(spark):
    assert sum(2.0**-n for n in fb.H2_LENGTHS) < 1 and len(fb.H2_LENGTHS) == 256 and min(fb.H2_LENGTHS) == 5
    df = spark.createDataFrame([(0, b"www.example.com"), (1, b""), (2, b"no-cache")], "id long, raw binary")
    assert _one(df, fb.h2_huffman_length("raw")) == {0: 12, 1: 0, 2: 6}


def test_registry(spark):
    assert registry(spark).count() == len(NAMES) == 64
    df = spark.createDataFrame([("gzip",), ("h2-huffman",), ("nope",)], "codec string")
    assert {r.codec: r.extension for r in with_extension(df).collect()} == {"gzip": "gz", "h2-huffman": None, "nope": None}


def test_report(rows):
    got = report.compression_report(rows.withColumn("k", F.col("id") % 2), F.col("raw"), encode("raw", "gzip"), "k", sets="cube").collect()
    assert {(r.k, r.n_rows) for r in got} == {(0, 4), (1, 4), (None, 8)}


def test_registry_names_what_encodes_and_decodes(spark, rows, tmp_path):
    known, more = registry(spark).collect(), [b"\x90" * 7, b"a\x90b", bytes(range(255, -1, -1))]
    df = rows.union(spark.createDataFrame([(100 + i, p) for i, p in enumerate(more)], rows.schema)).where("raw is not null")
    want = {i: p for i, p in enumerate(PAYLOADS) if p is not None} | {100 + i: p for i, p in enumerate(more)}
    both = [r.name for r in known if r.can_encode and r.can_decode]
    assert {"rle", "rle90", "packbits", "delta", "mtf", "bwt", "h2-huffman"} <= set(both)
    named = df.withColumn("name", F.explode(F.array(*(F.lit(r.name) for r in known))))
    named.withColumn("x", try_encode("raw", F.col("name"))["data"]).write.parquet(str(tmp_path / "coded"))
    coded = spark.read.parquet(str(tmp_path / "coded"))
    assert {r.name for r in coded.where("x is not null").select("name").distinct().collect()} == {r.name for r in known if r.can_encode}
    got = coded.withColumn("b", decode("x", F.col("name"))).where(F.col("name").isin(both)).collect()
    assert len(got) == len(both) * len(want) and all((r.b.data, r.b.error) == (want[r.id], None) for r in got)
    tried = [decode(F.lit(b"\x01a"), r.name)["error"].alias(str(k)) for k, r in enumerate(known)]
    errors = spark.range(1).select(*tried).first()
    assert all((e == "Unsupported") != r.can_decode for e, r in zip(errors, known, strict=True))
    files.write_encoded(df, "raw", "rle", str(tmp_path / "t"))
    assert {r.id: r.raw for r in files.read_encoded(spark, str(tmp_path / "t"), "raw").collect()} == want
    with pytest.raises(ValueError, match="Unsupported"):
        files.write_encoded(df, "raw", "lzw", str(tmp_path / "u"))


@pytest.mark.parametrize("codec", ["rle", "rle90", "packbits", "delta", "mtf", "bwt"])
def test_limits_of_byte_codecs(spark, codec):
    data = b"a" * 300 + b"\x90" * 5 + b"xyz\x90"
    df = spark.createDataFrame([(data,)], "raw binary").select(encode("raw", codec).alias("x"))
    exact, over = df.select(decode("x", codec, len(data)), decode("x", codec, len(data) - 1)).first()
    assert (exact.data, exact.error, over.data, over.error) == (data, None, None, "OutputLimitExceeded")


def test_files(spark, tmp_path):
    for name, body in (("a.gz", gzip.compress(b"one")), ("b.xz", lzma.compress(b"two")), ("c.bin", b"plain")):
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[1]: (r.codec, r.data, r.error) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.gz": ("gzip", b"one", None), "b.xz": ("xz", b"two", None), "c.bin": (None, None, "Unsupported")}
    out = files.encode_files(spark, str(tmp_path), "xz", glob="c.bin").first()
    assert out.out_path == out.path + ".xz" and lzma.decompress(out.data) == b"plain"
    df = spark.createDataFrame([(1, b"x" * 99)], "id long, raw binary")
    files.write_encoded(df, "raw", "zstd", str(tmp_path / "t"))
    back = files.read_encoded(spark, str(tmp_path / "t"), "raw").first()
    assert (back.raw, back.error, back.raw_bytes) == (b"x" * 99, None, 99)
    with pytest.raises(Exception, match="exist"):
        files.write_encoded(df, "raw", "zstd", str(tmp_path / "t"))
    named = spark.createDataFrame([("d/f",)], "p string").select(files.encoded_name("p", "zstd").alias("z"), files.encoded_name("p", "h2-huffman").alias("h"))
    assert tuple(named.select("z", "h", files.decoded_name("z", "zstd"), files.decoded_name("h", "zstd")).first()) == ("d/f.zst", "d/f", "d/f", None)
    with pytest.raises(ValueError, match="Unsupported"):
        files.encoded_name("p", "nope")


def test_read_files_has_the_callers_cap(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"x" * 1000))
    large = (64 << 20) + 1
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"\0" * large))
    sized = lambda most, glob: files.read_files(spark, str(tmp_path), glob=glob, max_output=most).select(F.length("data"), "error").first()
    assert tuple(sized(1000, "a.gz")) == (1000, None) and tuple(sized(999, "a.gz")) == (None, "OutputLimitExceeded")
    assert tuple(sized(large, "b.gz")) == (large, None) and tuple(sized(large - 1, "b.gz")) == (None, "OutputLimitExceeded") and tuple(sized(None, "b.gz")) == (large, None)


def test_gzip_members_join(spark):
    df = spark.createDataFrame([("s", k, b"part%d" % k) for k in range(5)], "stream_id string, seq long, chunk binary")
    parts = [bytes(r.member) for r in members.gzip_members(df).orderBy("seq").collect()]
    assert gzip.decompress(b"".join(parts)) == b"".join(b"part%d" % k for k in range(5))


def _streamed(spark, tmp_path, run, chunks):
    """Runs chunks ``(stream, seq, chunk, last)``, one list for each micro-batch, and returns the rows that came out."""
    schema, source, sink = "stream_id string, seq long, chunk binary, last boolean", str(tmp_path / "in"), str(tmp_path / "out")
    for k, batch in enumerate(chunks):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = run(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(sink)
    query.awaitTermination(120)
    return spark.read.parquet(sink).orderBy("stream_id", "seq", "status").collect()


@pytest.mark.parametrize("flush", ["sync", "full"])
def test_deflate_stream(spark, tmp_path, flush):
    part = lambda k: b"the same text again %d" % k
    # Numbers 4 and 5 come early, 0 comes twice.
    order = [[0, 1], [4, 5], [3, 2, 0]]
    rows = _streamed(spark, tmp_path, lambda s: members.deflate_stream(s, flush=flush, end_col="last"), [[("s", k, part(k), k == 5) for k in batch] for batch in order])
    assert [(r.seq, r.status) for r in rows if r.status == "late"] == [(0, "late")]
    pieces = [bytes(r.piece) for r in rows if r.status == "ok"]
    whole = zlib.decompressobj(-15)
    assert len(pieces) == 6 and whole.decompress(b"".join(pieces)) == b"".join(map(part, range(6))) and whole.eof
    # At each boundary everything so far can be decoded.
    for k in range(6):
        assert zlib.decompressobj(-15).decompress(b"".join(pieces[: k + 1])) == b"".join(map(part, range(k + 1)))
    if flush == "full":
        assert [zlib.decompressobj(-15).decompress(p) for p in pieces] == [part(k) for k in range(6)]
    else:
        assert len(pieces[1]) < len(pieces[0])


@pytest.mark.parametrize("codec", ["zlib", "gzip"])
def test_flushed_containers(codec):
    parts, kept, pieces = [b"one ", b"", b"two two two", b"three"], b"", []
    for k, part in enumerate(parts):
        piece, kept = members._contained(kept, part, "sync", k == 3, codec)
        pieces.append(piece)
        so_far = zlib.decompressobj(31 if codec == "gzip" else 15)
        assert so_far.decompress(b"".join(pieces)) == b"".join(parts[: k + 1]) and so_far.eof == (k == 3)
    with pytest.raises(ValueError, match="Unsupported"):
        members.deflate_stream(None, codec="bzip2")


def test_buffered_stream(spark, tmp_path):
    chunks = [[("a", 0, b"one ", False), ("b", 1, b"y", True)], [("b", 0, b"x", False), ("a", 1, None, False)], [("a", 2, b"two", True)]]
    rows = _streamed(spark, tmp_path, lambda s: members.buffered_stream(s, "bzip2", "last"), chunks)
    assert [(r.stream_id, r.seq, bz2.decompress(r.piece)) for r in rows] == [("a", 2, b"one two"), ("b", 1, b"xy")]
    with pytest.raises(ValueError, match="Unsupported"):
        members.buffered_stream(None, "nope", "last")


def test_sizes_by_window(spark):
    rows = [(f"2024-01-01 0{h}:1{m}:00", b"x" * 10) for h in range(3) for m in range(2)]
    df = spark.createDataFrame(rows, "t string, raw binary").select(F.col("t").cast("timestamp").alias("ts"), "raw")
    got = sorted((str(r.start), r.n_rows, r.raw_bytes) for r in members.sizes_by_window(df, "raw").collect())
    assert got == [(f"2024-01-01 0{h}:00:00", 2, 20) for h in range(3)]


def test_entropy(rows):
    got = {r.id: (r.n_bytes, r.distinct_bytes, round(r.entropy_bits, 6)) for r in stats.entropy(rows, "id", "raw").collect()}
    assert got[4] == (768, 256, 8.0) and got[3] == (800, 1, 0.0) and 1 not in got
