"""Pages as a data source: batch and stream, files of all kinds, ranges, filters and columns."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from siftwork.sources import files, pages, pagesource

HTML = '<html><head><title>T {i} &amp; more</title></head><body><a href="/x{i}">go {i}</a><p data-truth-pii="NAME" data-truth-value-id="v{i}" data-truth-tier="2">Ann {i}</p></body></html>'


def html(i):
    return HTML.replace("{i}", str(i))


@pytest.fixture
def folder(tmp_path):
    top = tmp_path / "in"
    (top / "deep").mkdir(parents=True)
    for i in range(5):
        (top / f"{i}.html").write_text(html(i))
    (top / "6.htm.gz").write_bytes(gzip.compress(html(6).encode()))
    lines = [json.dumps({"page_id": i, "url": f"http://h/{i % 3}/{i}", "html": html(i) + "x" * (i * 37 % 200)}) for i in range(100, 400)]
    (top / "deep" / "a.jsonl").write_text("\n".join(lines[:200]) + "\n")
    (top / "deep" / "b.json.gz").write_bytes(gzip.compress("\n".join(lines[200:]).encode()))

    def record(i, kind="response", mime="text/html; charset=latin-1"):
        body = html(i).encode() + "é".encode("latin-1")
        block = f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\n\r\n".encode() + body
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://w/{i}\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    records = [record(500), record(501, "request"), record(502, mime="image/png"), record(503)]
    (top / "w.warc").write_bytes(b"".join(records))
    (top / "w.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (top / "_hidden.html").write_text("no")
    (top / "other.txt").write_text("no")
    return str(top)


def load(spark, folder, schema, **options):
    pagesource.register(spark)
    return spark.read.format("pages").schema(schema).options(**options).load(folder)


def test_equals_the_walk_and_the_truth_of_the_same_rows(spark, folder):
    pagesource.register(spark)
    found = spark.read.format("pages").option("splitBytes", 9000).load(folder)
    assert found.rdd.getNumPartitions() > 10
    rows = found.collect()
    assert len(rows) == 5 + 1 + 300 + 2 + 2 and len({(r.file, r["at"]) for r in rows}) == len(rows)
    one = found.select(F.concat_ws("|", "file", "at").alias("page_id"), "html", "elements", "texts", "pii")
    walked = {r.page_id: r for r in pages.walk(one).collect()}
    told = {r.page_id: r for r in files.truth(one).collect()}
    for r in one.collect():
        assert (r.elements, r.texts, r.pii) == (walked[r.page_id].elements, walked[r.page_id].texts, told[r.page_id].pii) and r.pii
    by_id = {r.page_id: r for r in rows}
    assert by_id["100"].title == "T 100 & more" and by_id["100"].bytes == len(by_id["100"].html.encode())
    assert by_id["urn:503"].html.endswith("é") and by_id["urn:503"].url == "http://w/503" and "urn:501" not in by_id and "urn:502" not in by_id


def test_ranges_lose_and_repeat_no_line(spark, folder):
    for split in (1, 3000, 1 << 30):
        got = load(spark, folder + "/deep", "page_id string", splitBytes=split) if split > 1 else load(spark, folder + "/deep/a.jsonl", "page_id string", splitBytes=9000)
        ids = sorted(int(r.page_id) for r in got.collect())
        assert ids == list(range(100, 400 if split > 1 else 300))


def test_filters_and_columns_come_before_parsing(spark, folder, monkeypatch):
    df = load(spark, folder, "page_id string, url string, title string")
    kept = df.where(F.col("url").startswith("http://h/1/") & F.col("page_id").isin("100", "103", "104") & (F.length("title") > 0))
    want = {str(i) for i in (100, 103, 104) if i % 3 == 1}
    assert {r.page_id for r in kept.collect()} == want
    calls = []
    monkeypatch.setattr(pagesource, "_walked", lambda *a: calls.append(a) or {})
    options = {"path": folder}
    reader = pagesource.PageReader(pagesource.only("page_id", "url"), options)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 310 and not calls
    reader = pagesource.PageReader(pagesource.only("page_id", "title"), options)
    rest = list(reader.pushFilters([pagesource.EqualTo(("page_id",), "104"), pagesource.EqualTo(("title",), "T")]))
    assert len(rest) == 1
    monkeypatch.setattr(pagesource, "_walked", lambda *a: calls.append(a) or {"title": None})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1 and len(calls) == 1


def test_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"page_id": 1, "html": "<p>a</p>"}\nnonsense\n[1]\n' + "[" * 100_000 + "\n{}\n")
    (tmp_path / "b.warc").write_bytes(b"WARC/1.0\r\nContent-Length: x\r\n\r\n")
    (tmp_path / "c.html").write_bytes(b"")
    got = load(spark, str(tmp_path), pagesource.only("file", "page_id", "html", "elements")).collect()
    assert sum(r.html is None for r in got) == 5 and sum(r.page_id == "1" for r in got) == 1 and len(got) == 7
    with pytest.raises(Exception, match="at byte"):
        load(spark, str(tmp_path), "page_id string", mode="failfast").collect()
    with pytest.raises(Exception, match="no column"):
        load(spark, str(tmp_path), "nonsense string").collect()
    (tmp_path / "none").mkdir()
    assert load(spark, str(tmp_path / "none"), "page_id string").count() == 0


def test_stream_gives_each_page_once(spark, folder, tmp_path):
    pagesource.register(spark)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        rows = spark.readStream.format("pages").schema("file string, at bigint, title string").option("settleMillis", 0).load(folder)
        rows.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
        return spark.read.schema("file string, at bigint, title string").parquet(out).collect()

    assert len(run()) == 310
    assert len(run()) == 310
    with open(os.path.join(folder, "new.html"), "w") as f:
        f.write(html(9))
    again = run()
    assert len(again) == 311 and len({(r.file, r["at"]) for r in again}) == 311


def test_references_may_be_kept(spark, tmp_path):
    page = '<html><head><title>a &amp; b &quot;c &amp</title></head><body><p data-truth-pii="NAME">d &lt; &#65;&amp</p></body></html>'
    (tmp_path / "a.jsonl").write_text(json.dumps({"page_id": 1, "url": "u", "html": page}) + "\n" + json.dumps({"page_id": 2, "url": "u", "html": None}))
    read = load(spark, str(tmp_path), pagesource.only("page_id", "html", "title", "pii")).where("page_id = 1").collect()[0]
    kept = load(spark, str(tmp_path), pagesource.only("page_id", "html", "title", "pii"), references="kept").where("page_id = 1").collect()[0]
    assert (read.title, read.pii[0].value) == ('a & b "c &', "d < A&") and (kept.title, kept.pii[0].value) == ("a &amp; b &quot;c &amp", "d &lt; &#65;&amp")
    assert read.html == kept.html == page


def test_titles_equal_the_sql(spark, tmp_path):
    """Titles with references other than &amp;, whole and cut off."""
    import duckdb

    from siftwork.plans import inputs

    titles = ["x &amp; y", "x &quot;y", "x&amp", "&lt; &nbsp;&#65; &amp;amp;", ""]
    rows = [(i, f"http://h/{i}", f"<html><head><title>{t}</title></head><body><h1>{t}</h1></body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame([*rows, (9, "http://h/9", None)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("src_page", "src_instrument"):
        got = inputs.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({inputs.ORACLES[name]})").fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
