import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.sources import container as K
from cadenza.sources import wav as W


def wav(values, bits=16, channels=2, tag=1, extra=b"", rate=44100):
    width = bits // 8
    if tag == 3:
        raw = np.array(values, "<f4").tobytes()
    elif width == 1:
        raw = bytes(v + 128 for v in values)
    else:
        raw = b"".join(int(v).to_bytes(width, "little", signed=True) for v in values)
    fmt = struct.pack("<HHIIHH", tag, channels, rate, rate * channels * width, channels * width, bits)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + extra + b"data" + struct.pack("<I", len(raw)) + raw
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read(spark, tmp_path, **files):
    for name, content in files.items():
        (tmp_path / f"{name}.wav").write_bytes(content)
    rows = W.read(spark, f"file://{tmp_path}").orderBy("path", "sample_no", "channel").collect()
    out = {}
    for r in rows:
        out.setdefault(r["path"].rsplit("/", 1)[1][:-4], []).append(r["value"])
    return out


def test_all_widths(spark, tmp_path):
    odd = b"junk" + struct.pack("<I", 3) + b"abc\0"
    got = read(
        spark, tmp_path, a=wav([-3, 100, 7, -32768], extra=odd), b=wav([-128, 127], 8), c=wav([-8388608, 256], 24), d=wav([-65536, 1 << 30], 32), e=wav([0.5, -1.0], 32, tag=3), f=wav([1, 2, 3], channels=2), g=wav([], channels=1)
    )
    assert got["a"] == [-3, 100, 7, -32768] and got["b"] == [-128 * 256, 127 * 256] and got["c"] == [-32768, 1]
    assert got["d"] == [-1, 16384] and got["e"] == [16384, -32768] and got["f"] == [1, 2] and "g" not in got


def test_raw_files_and_remap(spark, tmp_path):
    (tmp_path / "x.pcm").write_bytes(np.array([1, -2, 3, -4, 5, -6], ">i2").tobytes())
    fmt = W.Format(8000, 3, 16, big_endian=True)
    got = W.read(spark, f"file://{tmp_path}", raw=fmt, remap=[2, 0, 1]).orderBy("sample_no", "channel").collect()
    assert [r["value"] for r in got] == [3, 1, -2, -6, -4, 5] and got[0]["rate"] == 8000
    ints = W.read(spark, f"file://{tmp_path}", raw=fmt, as_int24=True).orderBy("sample_no", "channel").collect()
    assert [r["value"] for r in ints] == [v * 256 for v in (1, -2, 3, -4, 5, -6)]


def test_extensible_and_bad_files():
    fmt = struct.pack("<HHIIHHHHI", W.EXTENSIBLE, 1, 8000, 16000, 2, 16, 22, 16, 0) + struct.pack("<H", 1) + W.GUID_TAIL
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", 2) + struct.pack("<h", -5)
    got, raw = W.parse(b"RIFF" + struct.pack("<I", len(body)) + body)
    assert W.integers(raw, got).tolist() == [-5]
    for bad in (b"", b"RIFFxxxxWAVE", wav([1], 16, 1, tag=7), wav([1], 16, 1)[:30]):
        with pytest.raises(ValueError):
            W.parse(bad)


def test_image_kinds():
    assert [W.image_kind(x) for x in (b"\x89PNG\r\n\x1a\nq", b"\xff\xd8\xff\xe0", b"GIF89a", b"BM")] == ["png", "jpeg", "gif", None]


def test_headers():
    assert K.decoder_info(44100, 2).hex() == "1210"
    head = K.adts_header(44100, 2, 300)
    assert head[:3].hex() == "fff150" and head[3] >> 2 == 0x80 >> 2 and len(head) == 7
    assert ((head[3] & 3) << 11 | head[4] << 3 | head[5] >> 5) == 300
    assert [K.fill_bits(n) for n in (0, 6, 7, 14, 15, 23)] == [0, 0, 7, 14, 15, 23]


def test_header_columns_equal_the_packer(spark):
    df = spark.createDataFrame([(4, 2, 300), (11, 1, 8191), (0, 6, 7)], "i int, c int, n int")
    got = [bytes.fromhex(r[0]) for r in df.select(K.stream_header(F.col("i"), F.col("c"), F.col("n"))).collect()]
    from cadenza.plans.tables import RATES

    assert got == [K.adts_header(RATES[i], c, n) for i, c, n in ((4, 2, 300), (11, 1, 8191), (0, 6, 7))]


def test_bits(spark):
    words = [(1, 0, 5, 3), (1, 1, 0, 0), (1, 2, 255, 9), (2, 0, 1, 1), (3, 0, 0, 0)]
    got = {r["k"]: (r["n_bits"], bytes(r["bytes"])) for r in K.pack_bits(spark.createDataFrame(words, "k int, o int, data long, len int"), ["k"], "o").collect()}
    b = K.Bits().put(5, 3).put(255, 9)
    assert got[1] == (12, b.tobytes()) and got[2] == (1, b"\x80") and got[3] == (0, b"")
    assert b.align() == 4 and b.n == 16


def atoms(data, at=0, end=None):
    end = len(data) if end is None else end
    out = {}
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        assert 8 <= size <= end - at
        out[kind] = (at + 8, at + size)
        at += size
    assert at == end
    return out


def test_movie_structure(spark):
    frames = [b"abc", b"defgh", b"i"]
    tags = {"title": "T", "artist": "A", "track": (1, 9), "disc": (1, 2), "compilation": True, "genre": 3, "cover": b"\xff\xd8\xff", "own": {"k": "v"}}
    data = K.movie(frames, 44100, 2, 3072, tags=tags, now=0.0)
    top = atoms(data)
    assert list(top) == [b"ftyp", b"free", b"mdat", b"moov"]
    assert data[slice(*top[b"mdat"])] == b"abcdefghi"
    moov = atoms(data, *top[b"moov"])
    stbl = atoms(data, *atoms(data, *atoms(data, *atoms(data, *moov[b"trak"])[b"mdia"])[b"minf"])[b"stbl"])
    a, b = stbl[b"stsz"]
    assert struct.unpack(">III3I", data[a:b]) == (0, 0, 3, 3, 5, 1)
    a, b = stbl[b"stco"]
    assert struct.unpack(">III", data[a:b])[2] == top[b"mdat"][0]
    meta = atoms(data, *moov[b"udta"])[b"meta"]
    items = atoms(data, *atoms(data, meta[0] + 4, meta[1])[b"ilst"])
    assert list(items) == [b"\xa9ART", b"\xa9nam", b"gnre", b"trkn", b"disk", b"cpil", b"covr", b"----"]
    with pytest.raises(ValueError):
        K.item_list({"own": {str(i): "" for i in range(101)}})


def test_stream_files(spark):
    rows = [(s, i, bytes([s]) * (i + 1)) for s in (1, 2) for i in (2, 0, 1)]
    df = spark.createDataFrame(rows, "s int, frame_no long, bytes binary")
    raw = {r["s"]: bytes(r["content"]) for r in K.streams(df, "s", 44100, 2, "raw").collect()}
    assert raw == {s: bytes([s]) * 6 for s in (1, 2)}
    adts = {r["s"]: bytes(r["content"]) for r in K.streams(df, "s", 44100, 2, "adts").collect()}
    assert len(adts[1]) == 6 + 21
    mp4 = {r["s"]: bytes(r["content"]) for r in K.streams(df, "s", 44100, 2).collect()}
    assert b"mdat" in mp4[1]
