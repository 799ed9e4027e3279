"""Codec names and families as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Codec, class, family (codecs of one family go together).
CODECS = (
    ("MPEG-1", "video", 1), ("MPEG-2", "video", 1), ("H.264", "video", 2), ("H.265", "video", 3), ("VC-1", "video", 4),
    ("AC3", "audio", 10), ("E-AC3", "audio", 10), ("DTS", "audio", 11), ("DTS-HD", "audio", 11), ("TrueHD", "audio", 12),
    ("LPCM", "audio", 13), ("MPEG Audio", "audio", 14), ("AAC", "audio", 15), ("FLAC", "audio", 16), ("Opus", "audio", 17),
    ("PGS", "subtitle", 20),
)

#: Matroska codec ids, and beginnings of ids.
MKV_IDS = {
    "V_MPEG1": "MPEG-1", "V_MPEG2": "MPEG-2", "V_MPEG4/ISO/AVC": "H.264", "V_MPEGH/ISO/HEVC": "H.265", "A_AC3": "AC3", "A_EAC3": "E-AC3",
    "A_DTS": "DTS", "A_TRUEHD": "TrueHD", "A_FLAC": "FLAC", "A_OPUS": "Opus", "S_HDMV/PGS": "PGS",
}
MKV_PREFIXES = {"A_DTS/": "DTS-HD", "A_PCM/": "LPCM", "A_MPEG/": "MPEG Audio", "A_AAC": "AAC"}

#: Stream types of a transport stream's program map.
TS_TYPES = {
    0x01: "MPEG-1", 0x02: "MPEG-2", 0x1B: "H.264", 0x24: "H.265", 0xEA: "VC-1", 0x03: "MPEG Audio", 0x04: "MPEG Audio", 0x0F: "AAC",
    0x80: "LPCM", 0x81: "AC3", 0x82: "DTS", 0x83: "TrueHD", 0x84: "E-AC3", 0x85: "DTS-HD", 0x86: "DTS-HD", 0x90: "PGS",
}


def families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CODECS), "codec string, class string, family int")


def mkv_codec(codec_id: Column) -> Column:
    """The codec of a Matroska id, null if unknown."""
    exact = F.create_map(*[F.lit(x) for kv in MKV_IDS.items() for x in kv])
    found = F.element_at(exact, codec_id)
    for prefix, codec in MKV_PREFIXES.items():
        found = F.coalesce(found, F.when(codec_id.startswith(prefix), codec))
    return found


def ts_codec(stream_type: Column) -> Column:
    exact = F.create_map(*[F.lit(x) for kv in TS_TYPES.items() for x in kv])
    return F.element_at(exact, stream_type)


def mismatches(tracks: DataFrame, sources: DataFrame, families: DataFrame) -> DataFrame:
    """tracks (key, track, codec) without a codec of their family among sources (key, codec).

    Unknown codecs are passed over, and so are tracks whose key has no source codec of their
    class.  `families` is a fixed table of a few rows.
    """
    f = F.broadcast(families)
    t = tracks.join(f, "codec")
    s = sources.join(f, "codec").select("key", "class", "family").distinct()
    return t.join(s.select("key", "class").distinct(), ["key", "class"], "left_semi").join(s, ["key", "class", "family"], "left_anti")
