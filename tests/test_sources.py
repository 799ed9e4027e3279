"""Container readers over synthetic bytes."""

import os

import numpy as np
import pytest
from loomspan.functions.scalars import ENTRY
from loomspan.operators.offsets import running_offsets
from loomspan.sources import bytestore, config, isofs, matroska, mpeg, spanfile


def element(name, body, unknown=False):
    raw = name.to_bytes((name.bit_length() + 7) // 8, "big")
    return raw + (b"\x01" + b"\xff" * 7 if unknown else (len(body) | 1 << 56).to_bytes(8, "big")) + body


def film(unknown=False):
    m = matroska
    tracks = element(m.TRACKS, b"".join(element(m.TRACK, element(m.NUMBER, bytes([n])) + element(m.UID, b"\xff" * 8) + element(m.KIND, bytes([n])) + element(m.CODEC, c) + element(m.PRIVATE, b"pp")) for n, c in ((1, b"V_MPEG2"), (2, b"A_AC3\0"))))
    simple = element(m.SIMPLE, b"\x81" + (5).to_bytes(2, "big") + b"\x80" + b"abcd")
    group = element(m.GROUP, element(m.BLOCK, b"\x82" + (-3).to_bytes(2, "big", signed=True) + b"\x80" + b"xyz"))
    clusters = b"".join(element(m.CLUSTER, element(m.TIMESTAMP, (t).to_bytes(2, "big")) + simple + group, unknown) for t in (0, 1000))
    return element(m.EBML, b"\x42\x86\x81\x01") + element(m.SEGMENT, tracks + clusters, unknown)


@pytest.mark.parametrize("unknown", [False, True])
def test_matroska(spark, tmp_path, unknown):
    data = film(unknown)
    (tmp_path / "a.mkv").write_bytes(data)
    spark.dataSource.register(matroska.Matroska)
    read = lambda t: spark.read.format("matroska").option("path", f"{tmp_path}/*.mkv").option("table", t).load()
    assert [(r.number, int(r.uid), r.codec_id) for r in read("tracks").orderBy("number").collect()] == [(1, 2**64 - 1, "V_MPEG2"), (2, 2**64 - 1, "A_AC3")]
    packets = read("packets").orderBy("seq").collect()
    assert [(r.track, r.timestamp, r["size"], r.keyframe) for r in packets] == [(1, 5, 4, True), (2, -3, 3, False), (1, 1005, 4, True), (2, 997, 3, False)]
    assert [data[r.offset : r.offset + r["size"]] for r in packets] == [b"abcd", b"xyz"] * 2


def test_numbers_of_variable_length():
    assert matroska.vint(b"\x81", 0, False) == (1, 1) and matroska.vint(b"\x40\x02", 0, False) == (2, 2)
    assert matroska.vint(b"\xff", 0, False) == (matroska.UNKNOWN, 1) and matroska.vint(b"\x1a\x45\xdf\xa3", 0, True) == (0x1A45DFA3, 4)
    for bad in (b"", b"\0", b"\x40"):
        with pytest.raises(ValueError):
            matroska.vint(bad, 0, False)


def pes(kind, payload):
    return b"\0\0\1" + bytes([kind]) + (len(payload) + 5).to_bytes(2, "big") + b"\x80\0\x02\xff\xff" + payload


def test_program_stream(spark):
    pack = b"\0\0\1\xba" + b"\x44" + b"\0" * 8 + b"\xf8"
    data = pack + pes(0xE0, b"video one") + b"\0\0\1\xbe\0\x03\0\0\1" + pes(0xBD, b"private") + b"\0\0\1\xb9" + pes(0xE0, b"two") + b"\0" * 12
    blobs = spark.createDataFrame([(7, bytearray(data))], "file int, bytes binary")
    r = running_offsets(mpeg.ranges(blobs, "program"), ["file", "stream"], ["seq"]).orderBy("seq").collect()
    assert [(x.stream, data[x.file_offset : x.file_offset + x["size"]], x.es_offset) for x in r] == [(0xE0, b"video one", 0), (0xBD, b"private", 0), (0xE0, b"two", 9)]


def ts(pid, payload, start):
    stuff = 183 - len(payload)
    field = b"" if stuff < 0 else bytes([stuff]) + b"\0" * stuff
    head = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, 0x30 if field else 0x10])
    return b"\0\0\0\0" + head + field + payload


def section(table, body):
    return b"\0" + bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + b"\0\1\xc1\0\0" + body + b"\0\0\0\0"


def test_transport_stream():
    pat = section(0, b"\0\0\xe0\x10" + b"\0\1\xe0\x20")
    pmt = section(2, b"\xe1\0\xf0\0" + b"\x1b\xe1\x11\xf0\0" + b"\x81\xe1\x12\xf0\x02ab")
    long = b"\0\0\1\xe0\0\0\x80\0" + bytes([184]) + b"\xee" * 175  # a packet header that goes into the next packet
    data = ts(0, pat, True) + ts(0x20, pmt, True) + ts(0x111, long, True) + ts(0x112, b"\0\0\1\xbd\0\0\x80\0\0" + b"au", True) + ts(0x111, b"\xee" * 9 + b"VV", False) + ts(0x111, b"W" * 184, False)
    assert mpeg.packet_size(data) == (192, 4)
    assert mpeg.programs(data) == [(0x111, 0x1B), (0x112, 0x81)]
    assert [(p, data[a : a + n]) for p, a, n in mpeg.transport_stream(data, {0x111, 0x112})] == [(0x112, b"au"), (0x111, b"VV"), (0x111, b"W" * 184)]


def test_span_file():
    e = np.zeros(2, ENTRY)
    e["length"], e["source"], e["offset"] = [10, 5], [2, 0], [0, 10]
    for creator in ("", "a version"):
        raw = spanfile.write(spanfile.SpanFile(15, 99, [("a/b.vob", 100, 1), ("é.vob", 200, 2)], e, b"delta", creator))
        x = spanfile.read(raw)
        assert (x.size, x.checksum, x.creator, x.remainder, x.entries.tobytes()) == (15, 99, creator, b"delta", e.tobytes())
        assert x.used == ([False, True] if creator else [True, True]) and all(spanfile.verify(raw).values())
        assert len(spanfile.read(raw, header_only=True).entries) == 0
        broken = bytearray(raw)
        broken[-25] ^= 1
        assert not spanfile.verify(bytes(broken))["remainder"]
    for bad in (b"", b"x" * 80, raw[:8] + b"\2\0\0\0" + raw[12:]):
        with pytest.raises(ValueError):
            spanfile.read(bad)


def test_byte_store(spark, tmp_path):
    os.mkdir(f"{tmp_path}/d")
    data = {n: bytes(range(256)) * k for n, k in (("a", 20), ("b", 3), ("c", 0))}
    for n, x in data.items():
        (tmp_path / "d" / n).write_bytes(x)
    spark.dataSource.register(bytestore.ByteChunks)
    chunks = spark.read.format("byte_chunks").option("path", f"{tmp_path}/d").option("chunk", 1000).option("partition", 2000).load()
    held = {}
    for r in sorted(chunks.collect(), key=lambda r: (r.path, r.base)):
        held[r.path[-1]] = held.get(r.path[-1], b"") + bytes(r.bytes)
    assert held == {k: v for k, v in data.items() if v}
    pieces = [(1, 0, "a", 990, 1500), (1, 1500, "b", 5, 7), (2, 0, "a", 4000, 1120)]
    asked = spark.createDataFrame([(q, at, f"{tmp_path}/d/{p}", o, n) for q, at, p, o, n in pieces], "request int, at long, path string, offset long, length long")
    got = {r.request: bytes(r.bytes) for r in bytestore.read_pieces(asked, chunks, 1000).collect()}
    assert got == {1: data["a"][990:2490] + data["b"][5:12], 2: data["a"][4000:5120]}


def test_config(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("name: a\ndedup_file: a.x\nsource_dir: src\nincludes: ['sub/*.yaml']\nvirtual_files:\n- {name: v, dedup_file: v.x, source_dir: /s}\n")
    os.mkdir(tmp_path / "sub")
    (tmp_path / "sub" / "b.yaml").write_text("name: b\ndedup_file: b.x\nsource_dir: src\nincludes: ['../a.yaml']\n")
    got = config.configs(spark, [f"{tmp_path}/a.yaml"]).orderBy("ordinal").collect()
    assert [(r.name, r.dedup_file) for r in got] == [("a", f"{tmp_path}/a.x"), ("b", f"{tmp_path}/sub/b.x"), ("v", f"{tmp_path}/v.x")]
    (tmp_path / "m.yaml").write_text("source_dir: s\nfiles:\n- {mkv: x.mkv, output: x.out}\n")
    assert config.manifest(spark, f"{tmp_path}/m.yaml").first().source_dir == f"{tmp_path}/s"
    (tmp_path / "bad.yaml").write_text("name: a\n")
    with pytest.raises(ValueError):
        config.configs(spark, [f"{tmp_path}/bad.yaml"])
    assert config.write_config(f"{tmp_path}/w.yaml", "n", "d", "s") and not config.write_config(f"{tmp_path}/w.yaml", "n", "d", "s")


def test_iso(tmp_path):
    def record(name, flags, block, size):
        n = 33 + len(name) + (len(name) + 1) % 2
        return bytes([n, 0]) + block.to_bytes(4, "little") + b"\0" * 4 + size.to_bytes(4, "little") + b"\0" * 11 + bytes([flags]) + b"\0" * 6 + bytes([len(name)]) + name + b"\0" * ((len(name) + 1) % 2)

    blocks = [b"\0" * 2048] * 24
    blocks[16] = (b"\1CD001" + b"\0" * 150 + record(b"\0", 2, 18, 2048)).ljust(2048, b"\0")
    blocks[18] = (record(b"\0", 2, 18, 2048) + record(b"\1", 2, 18, 2048) + record(b"BDMV", 2, 19, 2048)).ljust(2048, b"\0")
    blocks[19] = record(b"A.M2TS;1", 0, 20, 5).ljust(2048, b"\0")
    blocks[20] = b"hello".ljust(2048, b"\0")
    data = b"".join(blocks)
    assert list(isofs.files(data, "BDMV")) == [("BDMV/A.M2TS", 20 * 2048, 5)]
    (tmp_path / "x.iso").write_bytes(data)
    assert isofs.kind_of_folder(str(tmp_path)) == "bluray" and isofs.kind_of_image(b"\0" * 40000) == "dvd"
    assert list(isofs.files(data, "bdmv/a")) == [("BDMV/A.M2TS", 20 * 2048, 5)]
    # A directory of more than 256 KiB, and a name that ends in a full stop.
    many = [record(f"F{k:06}.;1".encode(), 0, 20, 5) for k in range(8000)]
    each = 2048 // len(many[0])
    listing = [b"".join(many[a : a + each]).ljust(2048, b"\0") for a in range(0, len(many), each)]
    large = [*blocks[:19], *listing]
    large[18] = record(b"BIG", 2, 19, 2048 * len(listing)).ljust(2048, b"\0")
    assert [x[0] for x in isofs.files(b"".join(large))] == [f"BIG/F{k:06}" for k in range(8000)] and len(listing) * 2048 > 256 << 10
    for broken in (bytes([40, 0]) + b"\0" * 30 + b"\0" * 8, bytes([60]) + record(b"A", 0, 20, 5)[1:32] + bytes([50]) + b"A" * 27):
        with pytest.raises(ValueError):
            list(isofs.files(b"".join([*blocks[:18], broken.ljust(2048, b"\0"), *blocks[19:]])))
    with pytest.raises(ValueError):
        isofs.kind_of_folder(str(tmp_path / "none"))


def test_filters_of_program_streams():
    data = b"AB\0\0\1\xb2user\0\0\1\xb3CD" + b"\0\0\1\xb2to the end"
    assert [data[a : a + n] for a, n in mpeg.without_user_data(data, [(0, len(data))])] == [b"AB", b"\0\0\1\xb3CD"]
    assert mpeg.without_user_data(b"plain", [(0, 5), (3, 9)]) == [(0, 5)]
    audio = b"\x80\1\0\4ac3!" + b"\xa0\1\0\1\0\0\0pcm" + b"\x20sub" + b"mp2"
    assert mpeg.sub_streams(audio, [(0xBD, 0, 8), (0xBD, 8, 10), (0xBD, 18, 4), (0xC0, 22, 3)]) == [(0x80, 4, 4), (0xA0, 15, 3), (0xC0, 22, 3)]


def test_disc_metadata():
    from loomspan.sources import discinfo

    ifo = bytearray(0x300)
    ifo[:12] = b"DVDVIDEO-VTS"
    ifo[0x200], ifo[0x203] = 0x40, 3
    ifo[0x204:0x206], ifo[0x20C:0x20E], ifo[0x214:0x216] = b"\0\1", b"\xc0\1", b"\0\2"
    assert discinfo.title_set(bytes(ifo)) == ["MPEG-2", "AC3", "DTS"]
    stream = lambda pid, kind: pid.to_bytes(2, "big") + b"\2" + bytes([kind, 0])
    body = b"\0\1" + b"\0" * 6 + b"\3\0" + stream(0x1011, 0x1B) + stream(0x1100, 0x83) + stream(0x1101, 0x83)
    clpi = b"HDMV0200" + b"\0" * 4 + (16).to_bytes(4, "big") + len(body).to_bytes(4, "big") + body
    assert discinfo.clip(clpi) == ["H.264", "TrueHD"]
    for bad in (b"", b"HDMV" + b"\0" * 20):
        with pytest.raises(ValueError):
            discinfo.clip(bad)


def udf_image(metadata):
    """A folder BDMV with a file of two extents; folders lie in a metadata partition if asked for."""
    import struct

    disc = bytearray(400 * 2048)
    def put(sector, raw):
        disc[sector * 2048 : sector * 2048 + len(raw)] = raw
    tag = lambda n: struct.pack("<H", n).ljust(16, b"\0")
    long = lambda n, block, part: struct.pack("<IIH6x", n, block, part)
    def entry(folder, ads, size, kind=1):
        head = bytearray(176)
        head[:2], head[27], head[34] = (261).to_bytes(2, "little"), 4 if folder else 5, kind
        head[56:64], head[172:176] = size.to_bytes(8, "little"), len(ads).to_bytes(4, "little")
        return bytes(head) + ads
    def name(text, folder, block, part):
        raw = b"\x08" + text.encode()
        own = bytearray(38) + raw
        own[:2], own[18], own[19] = (257).to_bytes(2, "little"), 2 if folder else 0, len(raw)
        own[20:36] = long(2048, block, part)
        return bytes(own).ljust((len(own) + 3) & ~3, b"\0")
    put(256, tag(2) + struct.pack("<II", 3 * 2048, 32))
    part = bytearray(512)
    part[:2], part[188:192] = (5).to_bytes(2, "little"), (260).to_bytes(4, "little")
    put(32, part)
    maps = struct.pack("<BBHH", 1, 6, 1, 0)
    where = 1 if metadata else 0
    if metadata:
        second = bytearray(64)
        second[0], second[1], second[5:28] = 2, 64, b"*UDF Metadata Partition"
        second[40:44] = (50).to_bytes(4, "little")
        maps += bytes(second)
        put(260 + 50, entry(False, struct.pack("<II", 4 * 2048, 60) + struct.pack("<II", 8 * 2048, 80), 12 * 2048, 0))
    logical = bytearray(440) + maps
    logical[:2], logical[248:264], logical[268:272] = (6).to_bytes(2, "little"), long(2048, 0, where), (2 if metadata else 1).to_bytes(4, "little")
    put(33, logical)
    put(34, tag(8))
    base = (lambda b: 260 + (60 + b if b < 4 else 80 + b - 4)) if metadata else (lambda b: 260 + b)
    put(base(0), tag(256).ljust(400, b"\0") + long(2048, 1, where))
    listing = name("BDMV", True, 2, where)
    put(base(1), entry(True, listing, len(listing), 3))
    listing = name("A.M2TS", False, 5, where)
    put(base(2), entry(True, long(len(listing), 4, where), len(listing)))
    put(base(4), listing)
    put(base(5), entry(False, long(2048, 100, 0) + long(10, 110, 0), 2058))
    put(360, b"x" * 2048)
    put(370, b"0123456789")
    return bytes(disc)


@pytest.mark.parametrize("metadata", [False, True])
def test_udf(metadata):
    from loomspan.sources import udffs

    data = udf_image(metadata)
    got = list(udffs.Volume(data).files("BDMV"))
    assert got == [("BDMV/A.M2TS", 0, 360 * 2048, 2048), ("BDMV/A.M2TS", 1, 370 * 2048, 10)]
    assert udffs.text(b"\x10\0a\x01\x00") == "aĀ" and not udffs.is_udf(b"")
