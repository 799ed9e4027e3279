"""Golden cases, and windows against literal folds."""

import random

import pytest
from loomspan.functions import scalars, syncpoints
from loomspan.operators import catalog, earlier, events, intervals, matching, offsets, rle
from loomspan.plans import matching as plans_matching
from pyspark.sql import functions as F

REGION = "target int, s long, e long, file long, src long"
MERGES = [
    ([(0, 100, 0, 0), (100, 200, 0, 100)], [(0, 100, 0, 0), (100, 200, 0, 100)]),
    ([(0, 300, 0, 0), (50, 150, 0, 50)], [(0, 300, 0, 0)]),
    ([(0, 300, 0, 0), (50, 150, 1, 500)], [(0, 300, 0, 0)]),
    ([(0, 100, 0, 0), (50, 250, 1, 500)], [(0, 100, 0, 0), (100, 250, 1, 550)]),
    ([(0, 200, 0, 1000), (100, 300, 0, 1100)], [(0, 300, 0, 1000)]),
    ([(0, 200, 0, 0), (100, 250, 1, 500)], [(0, 200, 0, 0), (200, 250, 1, 600)]),
    ([(200, 300, 0, 200), (0, 150, 0, 0), (100, 250, 0, 100)], [(0, 300, 0, 0)]),
]
GAPS = [
    (100, [], [(0, 100, 0, 0)]),
    (100, [(0, 100, 2, 500)], [(0, 100, 3, 500)]),
    (300, [(100, 200, 0, 1000)], [(0, 100, 0, 0), (100, 100, 1, 1000), (200, 100, 0, 100)]),
    (200, [(0, 100, 1, 0)], [(0, 100, 2, 0), (100, 100, 0, 0)]),
    (500, [(50, 150, 0, 0), (250, 350, 0, 0)], [(0, 50, 0, 0), (50, 100, 1, 0), (150, 100, 0, 50), (250, 100, 1, 0), (350, 150, 0, 150)]),
    (0, [], []),
]


def test_merge_goldens(spark):
    rows = [(i, *r) for i, (given, _) in enumerate(MERGES) for r in given]
    got = intervals.merge_regions(spark.createDataFrame(rows, REGION), "target", ["file"], ["src"]).collect()
    want = {(i, *r) for i, (_, out) in enumerate(MERGES) for r in out}
    assert {(r.target, r.s, r.e, r.file, r.src) for r in got} == want


def test_merge_is_the_fold(spark):
    rng, rows, want = random.Random(0), [], set()
    for t in range(200):
        own = sorted({(s := rng.randint(0, 60), s + rng.randint(1, 30), rng.randint(0, 1), s + rng.choice([0, 100])) for _ in range(rng.randint(1, 8))}, key=lambda r: (r[0], r[3], r[1], r[2]))
        rows += [(t, *r) for r in own]
        out = []
        for s, e, f, src in own:
            if out and s < out[-1][1]:
                last = out[-1]
                if e <= last[1]:
                    continue
                if last[2] == f and last[3] - last[0] == src - s:
                    last[1] = e
                    continue
                src, s = src + last[1] - s, last[1]
            out.append([s, e, f, src])
        want |= {(t, *r) for r in out}
    got = intervals.merge_regions(spark.createDataFrame(rows, REGION), "target", ["file"], ["src", "e", "file"])
    assert {(r.target, r.s, r.e, r.file, r.src) for r in got.collect()} == want


def test_complement_goldens(spark):
    regions = spark.createDataFrame([(i, *r) for i, (_, g, _) in enumerate(GAPS) for r in g], REGION)
    sizes = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(GAPS)], "target int, size long")
    got = intervals.complement(regions, sizes, "target").collect()
    assert {(r.target, r.mkv_offset, r.length, r.source, r.source_offset) for r in got} == {(i, *r) for i, (_, _, out) in enumerate(GAPS) for r in out}


def test_coalesce_goldens(spark):
    cases = [
        ([(100, 50, 0), (150, 30, 50)], [(100, 80, 0)]),
        ([(100, 50, 0), (200, 30, 50)], [(100, 50, 0), (200, 30, 50)]),
        ([(100, 50, 0), (150, 30, 100)], [(100, 50, 0), (150, 30, 100)]),
        ([(100, 50, 0), (150, 30, 50), (300, 20, 80)], [(100, 80, 0), (300, 20, 80)]),
        ([(100, 50, 0), (150, 30, 50), (180, 20, 80)], [(100, 100, 0)]),
    ]
    rows = spark.createDataFrame([(i, *r) for i, (g, _) in enumerate(cases) for r in g], "k int, file_offset long, size long, es_offset long")
    got = {(r.k, r.file_offset, r["size"], r.es_offset) for r in intervals.coalesce_adjacent(rows, "k").collect()}
    assert got == {(i, *r) for i, (_, out) in enumerate(cases) for r in out}


def test_coverage_goldens(spark):
    marks = spark.createDataFrame([(1, 8192, 16384), (2, 5000, 7000), (3, 0, 40960)], "k int, s long, e long")
    got = {(r.k, r.chunk) for r in intervals.covered_chunks(marks, "k").collect()}
    assert got == {(1, 2), (1, 3)} | {(3, i) for i in range(10)}


def test_compose_golden(spark):
    ranges = spark.createDataFrame([(1, 1000, 100, 0), (1, 2000, 100, 100), (1, 3000, 100, 200)], "k int, file_offset long, size long, es_offset long")
    asked = spark.createDataFrame([(1, 1, 0, 300), (1, 2, 250, 400)], "k int, region_id int, es_s long, es_e long")
    got = sorted(tuple(r) for r in offsets.compose(asked, ranges, "k", 64).collect())
    assert got == [(1, 1, 0, 1000, 100, True), (1, 1, 1, 2000, 100, True), (1, 1, 2, 3000, 100, True), (1, 2, 0, 3050, 50, False)]


def test_rle_goldens(spark):
    given = [(100, 184), (292, 184), (484, 184), (676, 184), (900, 200), (1108, 184), (1300, 184), (1500, 150), (1658, 184), (1850, 184)]
    rows = [(1, *r) for r in given] + [(2, o, 184) for o in (4, 196, 388, 580)] + [(3, 0, 100), (3, 110, 200), (3, 320, 100), (3, 430, 100)] + [(4, 9, 184)]
    r = spark.createDataFrame(rows, "k int, file_offset long, size long")
    usual = rle.usual_gap_and_size(r, "k")
    assert {tuple(x) for x in usual.collect()} == {(1, 8, 184), (2, 8, 184), (3, 10, 100), (4, 0, 184)}
    runs = rle.encode_runs(r, "k", usual)
    assert runs.filter("k = 2").collect()[0].follow == 3
    assert {tuple(x) for x in rle.decode_runs(runs, "k").collect()} == set(rows)


def test_zigzag(spark):
    v = spark.createDataFrame([(x,) for x in (0, -1, 1, -2, 2, 2**40, -(2**40))], "v long")
    got = v.select(rle.zigzag(F.col("v")).alias("z"), rle.unzigzag(rle.zigzag(F.col("v"))).alias("b"), "v").collect()
    assert [r.z for r in got][:5] == [0, 1, 2, 3, 4] and all(r.b == r.v for r in got)


def test_sync_points():
    b = bytes.fromhex
    assert syncpoints.nal_starts(b("000001B3FF")) == [3]
    assert syncpoints.nal_starts(b("FFFF00000167FF")) == [5]
    assert syncpoints.nal_starts(b("000001B300000100FF")) == [3, 7]
    assert syncpoints.nal_starts(b("000001")) == [] and syncpoints.start_codes(b("FF000001")) == [1]
    assert syncpoints.prefixed_nals(b("000000056701020304")) == [4]
    assert syncpoints.prefixed_nals(b("00000002670100000003680102")) == [4, 10]
    assert syncpoints.prefixed_nals(b("00056701020304"), 2) == [2]
    assert syncpoints.pgs_segments(b("16000500000000008000 00".replace(" ", ""))) == [0, 8]
    assert syncpoints.audio_frames(b"\xff" * 256) == []
    assert syncpoints.audio_frames(b("0B77FFFB107FFE8001F8726FBA")) == [0, 2, 5, 9]


def test_sync_points_as_udf(spark):
    rows = spark.createDataFrame([(1, bytearray(bytes.fromhex("000001B3FF"))), (2, None)], "id int, data binary")
    find = syncpoints.as_udf(syncpoints.nal_starts)
    assert {r.id: r.p for r in rows.select("id", find("data").alias("p")).collect()} == {1: [3], 2: None}


def test_scalars(spark):
    b = bytes.fromhex
    rows = spark.createDataFrame([(bytearray(b("7FFE800100FFFE")), bytearray(b("0102030405")), bytearray(b("01640028FFE1000000")))], "dts binary, pcm binary, avc binary")
    r = rows.select(
        scalars.dts_core_size(F.col("dts")).alias("dts"), F.hex(scalars.swap16(F.col("pcm"))).alias("pcm"),
        scalars.nal_length_size(F.lit("V_MPEG4/ISO/AVC"), F.col("avc")).alias("avc"), scalars.nal_length_size(F.lit("V_MPEG2"), F.col("avc")).alias("none"),
        scalars.ac3_frame_size(F.lit(1), F.lit(1)).alias("ac3"), scalars.escape_mountpoint(F.lit("/mnt/a-b/.x é")).alias("escaped"),
        scalars.clean_path(F.lit("/a/./b/../c//d")).alias("clean"), scalars.valid_path(F.lit("../x")).alias("valid"), scalars.shell_quote(F.lit("a'b c")).alias("quoted"),
        scalars.lpcm_header(F.lit(bytearray(b("8B0001"))))["frame_number"].alias("frame"), scalars.format_size(F.lit(1536)).alias("sized"),
    ).first()
    assert r.dts == ((0x7F << 7) | (0xFE >> 1)) + 1 and r.pcm == "0201040305" and r.avc == 4 - 4 + (0xFF & 3) + 1 and r.none == 0
    assert r.ac3 == 140 and r.escaped == r"mnt-a\x2db-.x\x20\xc3\xa9" and r.clean == "a/c/d" and not r.valid
    assert r.quoted == "'a'\"'\"'b c'" and r.frame == 11 and r.sized == "1.5 KB"


def test_matching_finds_every_run(spark):
    rng = random.Random(4)
    base = "".join(rng.choices("abcdé ", k=900))
    target = "x" * 37 + base[100:420] + "y" * 11 + base[500:640] + "z"
    docs = spark.createDataFrame([(1, base), (2, None), (3, "short")], "doc_id long, text string")
    items = spark.createDataFrame([(9, target), (8, None)], "item_id long, text string")
    hits = matching.seeds(items, "item_id", docs, "doc_id")
    got = sorted(tuple(r) for r in matching.extend(hits, items, "item_id", docs, "doc_id").collect())
    assert [g[:2] for g in got] == [(9, 1), (9, 1)]
    for _, _, s, e, src in got:
        assert target[s:e] == base[src : src + e - s] and e - s >= matching.RUN
    assert (37, 357) in {(s, e) for _, _, s, e, _ in got} or any(s <= 37 and e >= 357 for _, _, s, e, _ in got)


def test_short_runs_are_found_wherever_they_begin(spark):
    """A run of RUN characters, at every place of its target and of its source; one shorter is no result."""
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    passage = letters(matching.RUN)
    docs = [(k, letters(k) + "<" + passage + ">" + letters(200)) for k in range(70)]
    items = [(k, letters(3 * k) + "[" + passage + "]" + letters(90)) for k in range(0, 70, 7)] + [(1000, passage), (1001, passage[:-1])]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = matching.extend(matching.seeds(items, "item_id", docs, "doc_id"), items, "item_id", docs, "doc_id").collect()
    assert {(r.target, r.source) for r in found} == {(t, s) for t in [*range(0, 70, 7), 1000] for s in range(70)}
    assert all(r.e - r.s == matching.RUN for r in found)


def test_rolling_hashes():
    import numpy as np

    p = np.array([1, 2, 3, 1, 2, 3, 4] * 20, np.uint32)
    h = matching.rolling_hashes(p, 5)
    assert len(h) == len(p) - 4
    seen = {}
    for i, x in enumerate(h):
        assert seen.setdefault(bytes(p[i : i + 5]), x) == x
    assert len(set(h.tolist())) == len(seen)


def test_catalogue(spark):
    files = spark.createDataFrame([(1, "a/b/c"), (2, "a/b/c"), (3, "a/b"), (4, "d")], "i int, path string")
    got = {r.i: r.status for r in catalog.tree_conflicts(files, "i", "path").collect()}
    assert got == {1: "ok", 2: "duplicate", 3: "folder", 4: "ok"}
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 0)], "parent long, child long")
    assert {(r.node, r.level) for r in catalog.include_closure(spark, edges, 0).collect()} == {(0, 0), (1, 1), (2, 2)}
    # A chain deeper than any fixed depth, where each node is included twice.
    chain = spark.createDataFrame([(k, k + 1) for k in range(20)] * 2 + [(20, 3), (5, None)], "parent long, child long")
    assert sorted((r.node, r.level) for r in catalog.include_closure(spark, chain, 0).collect()) == [(k, k) for k in range(21)]


def test_bounded_batches(spark):
    rows = [(1, x) for x in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0, 1.2, 1.4, 1.6, 1.8, 1.95, 2.1, 5.0)]
    e = spark.createDataFrame(rows, "k long, t double").withColumn("ts", F.timestamp_seconds("t"))
    got = sorted((r.first, round(r.flush, 3), r.n) for r in events.bounded_batches(e, "k", "ts", 0.25, 2.0).collect())
    assert got == [(0.0, 2.0, 11), (2.1, 2.35, 1), (5.0, 5.25, 1)]


@pytest.mark.parametrize("gap,want", [("5 seconds", 2), ("4 seconds", 3)])
def test_session_edges(spark, gap, want):
    e = spark.sql("SELECT 1 AS k, timestamp_seconds(t) AS ts FROM VALUES (0.0), (5.0), (10.001) AS v(t)")
    assert events.sessions(e, "k", "ts", gap).count() == want


def test_gap_fill_goldens():
    from loomspan.operators.gapfill import fill

    source = bytes(range(100, 132))
    assert fill(source[:16] + b"\1\2" + source[16:], source, [(0, 34)]) == [(0, 16, 0), (18, 34, 16)]
    assert fill(source[:15], source[:15], [(0, 15)]) == []
    data = bytes(range(24)) + b"\xff" * 8 + bytes(range(24, 48))
    assert fill(data, bytes(range(48)), [(0, 24), (32, 56)]) == [(0, 24, 0), (32, 56, 24)]


def test_range_map_codec():
    import numpy as np
    from loomspan.sources import rangemap

    o = np.array([1000 + 192 * i for i in range(5)])
    raw = rangemap.encode(o, np.full(5, 184), 8, 184)
    assert raw == rangemap.put(1000) + rangemap.put(184) + b"\0" + rangemap.put(4)
    given = [(100, 184), (292, 184), (484, 184), (676, 184), (900, 200), (1108, 184), (1300, 184), (1500, 150), (1658, 184), (1850, 184)]
    o, s = (np.array(x) for x in zip(*given, strict=True))
    assert list(rangemap.decode(rangemap.encode(o, s, 8, 184), 8, 184)) == given
    assert list(rangemap.decode(rangemap.encode(o[:0], s[:0], 8, 184), 8, 184)) == []


def test_checksums(spark):
    import xxhash
    from loomspan.functions import checksums

    rows = [(f"f{i % 3}", i, bytearray(b"chunk %d" % i)) for i in range(30)]
    df = spark.createDataFrame(rows, "f string, i int, b binary").repartition(4)
    got = {r.f: r.checksum for r in checksums.file_checksums(df, "f", "i", "b").collect()}
    assert got == {f"f{k}": f"{xxhash.xxh64_intdigest(b''.join(bytes(b) for f, _, b in rows if f == f'f{k}')):016x}" for k in range(3)}
    signed = spark.createDataFrame([("abc",)], "s string").select(checksums.xxh64("s").alias("x")).first().x
    assert signed == 4952883123889572249


def test_earlier_runs_without_all_pairs(spark):
    """Entries are those of all pairs of texts, from runs in proportion to the texts that have a common line."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choices("abcdefgh 日𝒳\n", k=n))
    line, passage = letters(120), letters(900)
    texts = [letters(rng.randint(0, 30)) + line + letters(rng.randint(0, 60)) for _ in range(300)]
    texts += [letters(rng.choice([0, 3, 50])) + passage[rng.randint(0, 300) : rng.randint(500, 900)] + letters(40) for _ in range(60)]
    long = letters(7000)
    near = [long[:k] + "#" + long[k + 1 :] for k in (0, 39, 40, 3000, 6999)]
    texts += [long, long, *near, near[3], long[:200], long[1000:], line, line * 3, line + line[:-1], line[:79], line[:78], passage + line + long]
    texts += [None, "", "x" * 500, "x" * 90 + "\0\0", "y" + "x" * 300, "ab" * 200, "b" + "ab" * 100, "\0" * 100, "z" + "\0" * 120]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = earlier.earlier_runs(spark, docs, "doc_id").withColumnRenamed("source", "file").persist()
    pairs = matching.extend(matching.seeds(docs, "doc_id", docs, "doc_id", earlier=True), docs, "doc_id", docs, "doc_id")
    want, got = ([tuple(r) for r in plans_matching.entries(f, docs, "doc_id").collect()] for f in (pairs.withColumnRenamed("source", "file"), found))
    assert sorted(got) == sorted(want)
    common = {k for k, t in enumerate(texts) if t and line in t and len(t) < 220}
    assert len(common) > 300 and found.filter(F.col("target").isin(common)).count() < 20 * len(common)
    for r in found.collect():
        assert r.file < r.target and r.e - r.s >= matching.RUN and texts[r.target][r.s : r.e] == texts[r.file][r.src : r.src + r.e - r.s]
    found.unpersist()
