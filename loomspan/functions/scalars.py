"""Scalar functions as Column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import prepare

#: AC-3 bit rates in kbit/s, by half the frame size code.
AC3_RATES = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640)


def byte_at(data: Column, i: int | Column) -> Column:
    """The byte at a place (from 0) of a binary column; null beyond its end."""
    at = (F.lit(i) if isinstance(i, int) else i).cast("int") + 1
    return F.when(F.octet_length(data) >= at, F.conv(F.hex(F.substring(data, at, F.lit(1))), 16, 10).cast("int"))


def ac3_frame_size(fscod: Column, frmsizecod: Column) -> Column:
    """Bytes of a frame: 1536 samples at the coded rate; 0 for invalid codes."""
    rate = F.element_at(F.array(*[F.lit(x) for x in AC3_RATES]), (F.least(frmsizecod, F.lit(37)) / 2).cast("int") + 1)
    words = F.when(fscod == 0, rate * 2).when(fscod == 2, rate * 3).otherwise(F.floor(rate * 320 / 147) + frmsizecod % 2)
    return F.when((frmsizecod >= 38) | (fscod >= 3), 0).otherwise(words * 2).cast("int")


def dts_core_size(data: Column) -> Column:
    """Bytes of a DTS core frame by its header; 0 if it isn't one or is under 96."""
    size = F.shiftleft(byte_at(data, 5).bitwiseAND(F.lit(0x7F)), 7).bitwiseOR(F.shiftright(byte_at(data, 6), 1)) + 1
    fits = (F.octet_length(data) >= 7) & (F.hex(F.substring(data, 1, 4)) == "7FFE8001") & (size >= 96)
    return F.when(fits, size).otherwise(0).cast("int")


def truehd_unit_size(data: Column) -> Column:
    """Bytes of an access unit: twelve bits of 16-bit words."""
    size = F.shiftleft(byte_at(data, 0).bitwiseAND(F.lit(0x0F)), 8).bitwiseOR(byte_at(data, 1)) * 2
    return F.when(F.octet_length(data) >= 2, size).otherwise(0).cast("int")


def swap16(data: Column) -> Column:
    """16-bit samples in the other byte order; an odd last byte stays."""
    return F.unhex(F.regexp_replace(F.hex(data), "(..)(..)", "$2$1"))


def nal_length_size(codec_id: Column, private: Column) -> Column:
    """Bytes of a length prefix by the codec's private data; 0 for start codes."""
    n, first = F.coalesce(F.octet_length(private), F.lit(0)), byte_at(private, 0)
    avc = F.when((n >= 7) & (first == 1), byte_at(private, 4).bitwiseAND(F.lit(3)) + 1).otherwise(4)
    b = byte_at(private, 21)
    size = b.bitwiseAND(F.lit(3)) + 1
    hevc = F.when((n >= 23) & (first == 1) & (b.bitwiseAND(F.lit(0xFC)) == 0xFC) & (size != 3), size).otherwise(4)
    return F.when(codec_id == "V_MPEG4/ISO/AVC", avc).when(codec_id == "V_MPEGH/ISO/HEVC", hevc).otherwise(0).cast("int")


def size_bucket(size: Column) -> Column:
    return F.when(size < 64, 0).when(size < 128, 1).when(size < 1024, 2).when(size < 32768, 3).otherwise(4)


def clamp_window(size: Column) -> Column:
    """A window between 32 and 4096, 64 where none is set."""
    return F.when(F.coalesce(size, F.lit(0)) <= 0, 64).otherwise(F.greatest(F.lit(32), F.least(F.lit(4096), size)))


def savings(size: Column, stored: Column) -> Column:
    return F.when(size > 0, 100.0 * (size - stored) / size).otherwise(0.0)


def format_int(n: Column) -> Column:
    return F.format_number(n, 0)


def format_size(n: Column) -> Column:
    scaled = lambda unit, name: F.format_string(f"%.1f {name}", F.bround(n.cast("double") / unit, 1))
    return F.when(n >= 1 << 30, scaled(1 << 30, "GB")).when(n >= 1 << 20, scaled(1 << 20, "MB")).when(n >= 1 << 10, scaled(1 << 10, "KB")).otherwise(F.format_string("%d B", n))


def format_duration(seconds: Column) -> Column:
    s = F.round(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)


def clean_path(path: Column) -> Column:
    """Parts of a path without empty ones and dots; '..' takes the part before it, or stays at the front of a relative path."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    rooted = path.startswith("/")
    step = lambda acc, p: F.when(
        p == "..", F.when((F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(rooted, acc).otherwise(F.concat(acc, F.array(p)))
    ).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def valid_path(path: Column) -> Column:
    """Whether a cleaned path names a file and stays inside its root."""
    cleaned = clean_path(path)
    return (cleaned != "") & ~F.array_contains(F.split(cleaned, "/"), "..")


def escape_mountpoint(path: Column) -> Column:
    """A path as one file name: slashes are dashes, other bytes than [A-Za-z0-9_.] and a first dot are \\xNN."""
    cleaned = clean_path(path)
    code = F.regexp_extract_all(F.hex(F.encode(cleaned, "UTF-8")), F.lit("(..)"), 1)
    one = lambda h, i: (
        F.when(h == "2F", "-")
        .when(h.isin("5F") | ((h == "2E") & (i > 0)), F.char(F.conv(h, 16, 10)))
        .when(h.between("30", "39") | h.between("41", "5A") | h.between("61", "7A"), F.char(F.conv(h, 16, 10)))
        .otherwise(F.concat(F.lit("\\x"), F.lower(h)))
    )
    return F.when(cleaned == "", "-").otherwise(F.array_join(F.transform(code, one), ""))


def relative_to(path: Column, base: Column) -> Column:
    """A relative path against the folder `base`; absolute ones stay."""
    return F.when(path.startswith("/") | (path == ""), path).otherwise(F.concat(F.lit("/"), clean_path(F.concat_ws("/", base, path))))


def octal(text: Column) -> Column:
    return F.conv(text, 8, 10).cast("int")


def to_octal(n: Column) -> Column:
    return F.lpad(F.conv(n.cast("string"), 10, 8), 4, "0")


def shell_quote(text: Column) -> Column:
    """Text as one word of a shell: quoted unless it is of harmless characters."""
    quoted = F.concat(F.lit("'"), F.regexp_replace(text, "'", "'\"'\"'"), F.lit("'"))
    return F.when(text == "", "''").when(text.rlike(r"[^\w@%+=:,./-]"), quoted).otherwise(text)


def strided(data: Column, start: Column, size: Column, stride: Column, count: Column) -> Column:
    """count pieces of `size` characters, `stride` apart, joined."""
    at = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(data, (start + i * stride + 1).cast("int"), size.cast("int")))
    return F.when(count > 0, F.array_join(at, "")).otherwise("")


def pack_flags(is_video: Column, is_lpcm: Column) -> Column:
    return (is_video.cast("int") + is_lpcm.cast("int") * 2).cast("int")


#: The 28 bytes of a written entry, little-endian.
ENTRY = np.dtype([("offset", "<u8"), ("length", "<u8"), ("source", "<u2"), ("source_offset", "<u8"), ("flags", "u1"), ("sub_id", "u1")])


def pack_entries(rows: DataFrame, key: str) -> DataFrame:
    """rows (key and the fields of ENTRY) -> key, raw."""

    def each(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows, ENTRY)
            for c in ENTRY.names:
                out[c] = batch[c].to_numpy(zero_copy_only=False)
            raw = out.tobytes()
            yield pa.RecordBatch.from_arrays([batch[key], pa.array([raw[i : i + 28] for i in range(0, len(raw), 28)], pa.binary())], names=[key, "raw"])

    prepare(rows.sparkSession)
    return rows.select(key, *ENTRY.names).mapInArrow(each, f"`{key}` {rows.schema[key].dataType.simpleString()}, raw binary")


def unpack_entries(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, raw) -> key and the fields, flags as is_video and is_lpcm."""

    def each(batches):
        for batch in batches:
            own = np.frombuffer(b"".join(batch["raw"].to_pylist()), ENTRY)
            longs = [pa.array(own[c].astype(np.int64)) for c in ("offset", "length", "source", "source_offset")]
            flags = [pa.array(own["flags"] & 1 > 0), pa.array(own["flags"] & 2 > 0)]
            names = [key, "offset", "length", "source", "source_offset", "is_video", "is_lpcm", "sub_id"]
            yield pa.RecordBatch.from_arrays([batch[key], *longs, *flags, pa.array(own["sub_id"].astype(np.int32))], names=names)

    kinds = "offset long, length long, source long, source_offset long, is_video boolean, is_lpcm boolean, sub_id int"
    prepare(rows.sparkSession)
    return rows.select(key, "raw").mapInArrow(each, f"`{key}` {rows.schema[key].dataType.simpleString()}, {kinds}")


def lpcm_header(data: Column) -> Column:
    """Fields of a three-byte header of DVD LPCM audio."""
    a, b = byte_at(data, 0), byte_at(data, 1)
    bits = lambda v, shift, mask: F.shiftright(v, shift).bitwiseAND(F.lit(mask))
    return F.struct(
        (bits(a, 7, 1) == 1).alias("emphasis"), (bits(a, 6, 1) == 1).alias("mute"), bits(a, 0, 31).alias("frame_number"),
        bits(b, 6, 3).alias("quantization"), bits(b, 4, 3).alias("sample_rate"), bits(b, 0, 7).alias("channels"),
    )


def lpcm_aligned(src: Column, length: Column) -> Column:
    """A match of 16-bit samples on even source offsets and of even length: (skip, length)."""
    skip = F.pmod(src, F.lit(2))
    left = F.greatest(length - skip, F.lit(0))
    return F.struct(skip.alias("skip"), (left - F.pmod(left, F.lit(2))).alias("length"))
