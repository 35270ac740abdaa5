"""Bit packing, frame headers and files of coded frames.

Frames are packed where they are; a file is put together from its frames in order by one task a stream. Container headers need
only aggregates (sizes, counts, rates).
"""

from __future__ import annotations

import struct
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.payload import packed as octets_of
from cadenza.operators.payload import size_of, word
from cadenza.plans.tables import RATES

EPOCH = 2082844800


class Bits:
    """Most significant bit first writer."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, data: int, length: int) -> Bits:
        self.value = (self.value << length) | (data & ((1 << length) - 1))
        self.n += length
        return self

    def align(self) -> int:
        """Fill the last byte with zeros; the number of bits added."""
        more = -self.n % 8
        self.put(0, more)
        return more

    def tobytes(self) -> bytes:
        more = -self.n % 8
        return (self.value << more).to_bytes((self.n + more) // 8, "big")


def pack_bits(words: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, n_bits, bytes of rows (order, data, len) put one after the other.

    The words of a key are gathered in one place; a key is one frame of at most a few thousand words.
    """
    packed = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "data", "len"))).alias("w"))
    rows = packed.withColumn("w", F.transform("w", lambda x: word(x["data"], x["len"])))
    return rows.select(*keys, size_of(F.col("w")).alias("n_bits"), octets_of(F.col("w")).alias("bytes"))


def stream_header(rate_index: Column, channels: Column, length: Column, mpeg2: bool = False, profile: int = 2) -> Column:
    """The seven bytes in front of a raw frame; length includes them. Channels beyond six have no number here."""
    field = lambda c, n: F.lpad(F.bin(c.cast("long")), n, "0")
    bits = F.concat(F.lit("1" * 12 + ("1" if mpeg2 else "0") + "00" + "1" + f"{profile - 1:02b}"), field(rate_index, 4), F.lit("0"), field(channels, 3), F.lit("0000"), field(length, 13), F.lit("1" * 11 + "00"))
    return F.concat(*(F.lpad(F.conv(F.substring(bits, 8 * i + 1, 8), 2, 16), 2, "0") for i in range(7)))


def decoder_info(rate: int, channels: int, profile: int = 2) -> bytes:
    """The two bytes that tell a decoder profile, rate and channels."""
    return Bits().put(profile, 5).put(RATES.index(rate), 4).put(channels, 4).put(0, 3).tobytes()


def fill_bits(wanted: int) -> int:
    """Bits that filler elements really take when `wanted` should be filled; each has seven of its own and whole bytes."""
    used = 0
    while wanted - used >= 7:
        spare = (wanted - used - 7) // 8
        if spare < 15:
            used += 7 + 8 * spare
            continue
        used += 7 + 8 + 8 * min(spare - 1, 269)
    return used


def atom(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind.encode("latin-1") + body


def _full(kind: str, *parts: bytes) -> bytes:
    return atom(kind, b"\0\0\0\0", *parts)


def _descriptor(tag: int, body: bytes) -> bytes:
    return bytes([tag]) + b"\x80\x80\x80" + bytes([len(body)]) + body


def text_tag(kind: str, value: str) -> bytes:
    return atom(kind, atom("data", struct.pack(">II", 1, 0), value.encode()))


def number_tag(kind: str, *numbers: int) -> bytes:
    return atom(kind, atom("data", struct.pack(">II", 0, 0), struct.pack(f">{len(numbers)}H", *numbers)))


def byte_tag(kind: str, value: int) -> bytes:
    return atom(kind, atom("data", struct.pack(">II", 21, 0), bytes([value])))


def image_tag(data: bytes, kind: str) -> bytes:
    return atom("covr", atom("data", struct.pack(">II", {"gif": 12, "jpeg": 13, "png": 14}[kind], 0), data))


def own_tag(name: str, value: str) -> bytes:
    return atom("----", _full("mean", b"com.apple.iTunes"), _full("name", name.encode()), atom("data", struct.pack(">II", 1, 0), value.encode()))


#: The atoms of text tags, in the order in which they are written.
TEXT_TAGS = {"encoder": "\xa9too", "artist": "\xa9ART", "writer": "\xa9wrt", "title": "\xa9nam", "album": "\xa9alb", "year": "\xa9day", "comment": "\xa9cmt"}


def item_list(tags: dict) -> bytes:
    """The tags that are set: texts, track and disc (number, total), compilation, genre, cover (bytes), others by name."""
    from cadenza.sources.wav import image_kind

    out = [text_tag(kind, tags[k]) for k, kind in TEXT_TAGS.items() if tags.get(k)]
    if tags.get("genre"):
        out.append(number_tag("gnre", tags["genre"]))
    for k, kind in (("track", "trkn"), ("disc", "disk")):
        if tags.get(k):
            number, total = tags[k]
            out.append(number_tag(kind, 0, number, total, *([0] if k == "track" else [])))
    if tags.get("compilation"):
        out.append(byte_tag("cpil", 1))
    if tags.get("cover") and (kind := image_kind(tags["cover"])):
        out.append(image_tag(tags["cover"], kind))
    own = list(tags.get("own", {}).items())
    if len(own) > 100:
        raise ValueError("at most 100 tags of one's own")
    return atom("ilst", *out, *(own_tag(k, v) for k, v in own))


def movie(frame_bytes: list[bytes], rate: int, channels: int, samples: int, frame: int = 1024, average: int = 0, largest: int = 0, tags: dict | None = None, now: float | None = None) -> bytes:
    """An MP4 file of coded frames: brand, data, then the movie header with the sizes of all frames."""
    when = struct.pack(">II", *[int((time.time() if now is None else now) + EPOCH)] * 2)
    sizes = [len(b) for b in frame_bytes]
    brand = atom("ftyp", b"M4A ", struct.pack(">I", 0), b"M4A mp42isom", b"\0\0\0\0")
    free = atom("free")
    begin = len(brand) + len(free) + 8
    unit = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    config = _descriptor(4, bytes([0x40, 0x15]) + (8 * 192).to_bytes(3, "big") + struct.pack(">II", largest, average) + _descriptor(5, decoder_info(rate, channels)))
    esds = _full("esds", _descriptor(3, struct.pack(">HB", 0, 0) + config + _descriptor(6, b"\x02")))
    entry = atom("mp4a", b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", channels, 16, 0, 0, (rate & 0xFFFF) << 16), esds)
    table = atom(
        "stbl", _full("stsd", struct.pack(">I", 1), entry), _full("stts", struct.pack(">III", 1, len(sizes), frame)), _full("stsz", struct.pack(">II", 0, len(sizes)), struct.pack(f">{len(sizes)}I", *sizes)),
        _full("stsc", struct.pack(">IIII", 1, 1, len(sizes), 1)), _full("stco", struct.pack(">II", 1, begin)),
    )
    media = atom(
        "mdia", _full("mdhd", when, struct.pack(">II", rate, samples), struct.pack(">HH", 0x55C4, 0)), _full("hdlr", struct.pack(">I", 0), b"soun", b"\0" * 12, b"\0"),
        atom("minf", _full("smhd", struct.pack(">HH", 0, 0)), atom("dinf", _full("dref", struct.pack(">I", 1), atom("url ", struct.pack(">I", 1)))), table),
    )
    track = atom("trak", atom("tkhd", struct.pack(">I", 1), when, struct.pack(">III", 1, 0, samples), b"\0" * 8, struct.pack(">HHHH", 0, 0, 0x100, 0), unit, struct.pack(">II", 0, 0)), media)
    header = _full("mvhd", when, struct.pack(">II", rate, samples), struct.pack(">IH", 0x10000, 0x100), b"\0" * 10, unit, b"\0" * 24, struct.pack(">I", 2))
    meta = atom("udta", _full("meta", _full("hdlr", struct.pack(">I", 0), b"mdirappl", b"\0" * 9), item_list(tags or {})))
    return brand + free + atom("mdat", *frame_bytes) + atom("moov", header, track, meta)


def streams(frames: DataFrame, stream: str, rate: int, channels: int, kind: str = "mp4", now: float = 0.0) -> DataFrame:
    """stream, content: one file of each stream from its coded frames (stream, frame_no, bytes).

    The frames of a stream meet in one task in order; its file must fit there.
    """
    key = frames.select(stream).schema[0].simpleString().replace(":", " ")

    def build(part: pd.DataFrame) -> pd.DataFrame:
        coded = [bytes(b) for b in part.sort_values("frame_no")["bytes"]]
        if kind == "mp4":
            total = sum(map(len, coded))
            average = total * 8 * rate // (1024 * len(coded))
            content = movie(coded, rate, channels, 1024 * len(coded), average=average, largest=max(average, max(map(len, coded)) * 8 * rate // 1024), now=now)
        elif kind == "adts":
            content = b"".join(adts_header(rate, channels, len(c) + 7) + c for c in coded)
        else:
            content = b"".join(coded)
        return pd.DataFrame({stream: [part[stream].iloc[0]], "content": [content]})

    return frames.groupBy(stream).applyInPandas(build, f"{key}, content binary")


def adts_header(rate: int, channels: int, length: int, mpeg2: bool = False, profile: int = 2) -> bytes:
    """As stream_header, for one frame on the driver or in a task."""
    b = Bits().put(0xFFF, 12).put(int(mpeg2), 1).put(0, 2).put(1, 1).put(profile - 1, 2).put(RATES.index(rate), 4).put(0, 1)
    return b.put(channels, 3).put(0, 4).put(length, 13).put(0x7FF, 11).put(0, 2).tobytes()


def write_files(files: DataFrame, write) -> None:
    """Hand each file (name, content) to `write` where it is; the callable does the store's own writing."""

    def each(rows: Iterator) -> None:
        for r in rows:
            write(r[0], bytes(r[1]))

    files.foreachPartition(each)

