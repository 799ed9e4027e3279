"""Every registered query against its SQL on DuckDB, over the smallest tables."""

import datetime
import decimal
import os

import __spark_entry__ as entry
import duckdb
import pytest
from loomspan.plans import register

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(register.queries()))
def test_query(spark, duck, name):
    got = register.queries()[name](spark, DATA)
    rows, columns = got.collect(), sorted(got.columns)
    if name not in register.oracle_sql():
        assert rows
        return
    r = duck.sql(register.oracle_sql()[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert sorted(tuple(plain(x[c]) for c in columns) for x in rows) == sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 40
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_results_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = set()
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        rows = register.queries()["gap_complement"](spark, DATA).collect()
        seen.add(str(sorted(map(str, rows))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_gap_fill_takes_short_texts(spark, tmp_path):
    """Texts of every size against a version that goes byte by byte."""
    texts = [None, "", *["abcdefghijklmnopqrstuvw xyz0123456789-é\n"[i % 7 :] * 4 for i in range(7)]]
    texts += ["The quick brown fox jumps over a lazy dog, twice or more; and so on and on it goes for long."[:n] for n in (1, 15, 16, 39, 40, 41, 55, 56, 79, 80, 92)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, text in enumerate(texts):
        wide = "".join(c + "~~" * (i % 40 == 39) for i, c in enumerate(text or "")).encode()
        source, at, start = (text or "").encode(), 0, 0
        for i in range(len(wide) + 1):
            if i == len(wide) or at == len(source) or wide[i] != source[at]:
                if i - start >= 16:
                    want.append((d, start, i, at - (i - start)))
                start = i + 1
                if at == len(source):
                    break
            else:
                at += 1
    got = [tuple(r) for r in register.queries()["gap_fill"](spark, str(tmp_path)).select("doc_id", "s", "e", "src").collect()]
    assert sorted(got) == sorted(want)
    assert any(len(texts[d].encode()) < 80 for d, *_ in want)
