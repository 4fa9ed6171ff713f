import json

import pytest
from pyspark.sql import functions as F

from attestra.operators import notes as N
from attestra.sources import readers as R
from attestra.sources import sinks
from attestra.streaming import vault as SV


def test_readers(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.md").write_text("## Q\n### Özet\nx")
    (tmp_path / "n" / "DISLANAN.md").write_text("x")
    assert [r["dosya"] for r in R.notes(spark, str(tmp_path / "n")).collect()] == ["a.md"]
    assert N.section_lines(R.notes(spark, str(tmp_path / "n"), "r"), ["run_id", "slug", "dosya"]).count() == 1
    (tmp_path / "p.json").write_text(json.dumps([{"slug": "s", "sorular": ["q"], "olgular": [{"ad": "a", "ara": "b"}]}, 5]))
    assert [r["slug"] for r in R.plan(spark, str(tmp_path / "p.json")).collect()] == ["s"]
    (tmp_path / "c").mkdir()
    for name, text in (("1.json", json.dumps({"istenen_url": "https://a.example/", "ok": True, "markdown": "x", "fetched_at": 1.0})), ("2.json", "{broken"), ("3.json", json.dumps({"url": "https://b.example/", "ok": True, "markdown": "y"})), ("4.json", json.dumps({"istenen_url": "https://c.example/", "ok": True, "markdown": " "}))):
        (tmp_path / "c" / name).write_text(text)
    assert sorted((r["istenen_url"], r["fetched_at"]) for r in R.page_cache(spark, str(tmp_path / "c")).collect()) == [("https://a.example/", 1.0), ("https://b.example/", 0.0)]
    (tmp_path / "l.jsonl").write_text("{}\nx")
    assert R.log_lines(spark, str(tmp_path / "l.jsonl")).count() == 2


def test_vault_merge_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "vault")
    with pytest.raises(FileNotFoundError):
        R.vault(spark, path)
    rows = spark.createDataFrame([(1, "https://a.example/", True, "x", 1.0), (2, "https://a.example/", True, "x", 2.0)], "kayit_no long, istenen_url string, ok boolean, markdown string, fetched_at double")
    for _ in range(2):
        assert [tuple(r) for r in R.vault_merge(spark, path, rows).collect()] == [("https://a.example/", 2.0, 2, "x")]


def test_charset():
    assert R.charset("text/html; charset=iso-8859-9", "ş".encode("iso-8859-9")) == "ş" and R.charset(None, b"<meta charset='windows-1254'>" + "ğ".encode("cp1254")).endswith("ğ") and R.charset("x; charset=nope", "é".encode()) == "é"


def test_report(spark, tmp_path):
    v = spark.createDataFrame([("VERIFIED", "d", 0, 1, 1, None), ("PARTIAL", "d", 1, 1, 2, "why")], "karar string, dosya string, sira int, bulunan int, toplam int, neden string")
    text = sinks.verdict_report(v)
    assert sinks.BANNER in text and "- VERIFIED: 1" in text and "(why)" in text
    sinks.write_json(v, str(tmp_path / "v"))
    assert spark.read.json(str(tmp_path / "v")).count() == 2


ROWS = [(1, "https://a.example/", "a.example", True, 0.0), (2, "http://www.a.example/", "a.example", True, 10.0), (3, "https://b.example/", "b.example", None, 5.0), (4, None, None, True, 1.0)]


@pytest.fixture
def stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame(ROWS, "kayit_no long, istenen_url string, host string, ok boolean, fetched_at double").coalesce(1).write.parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_streams(stream, tmp_path):
    assert {(r["url"], r["kayit_no"]) for r in run(SV.fresh_pages(stream), "fresh", "update", tmp_path)} == {("https://a.example/", 2)}
    assert {r["url"] for r in run(SV.once_within_ttl(stream), "once", "append", tmp_path)} == {"https://a.example/", "https://b.example/"}
    assert {(r["host"], r["n"], r["hata"]) for r in run(SV.hourly_hosts(stream), "hosts", "update", tmp_path)} == {("a.example", 2, 0), ("b.example", 1, 1), (None, 1, 0)}


def test_throttle(stream, tmp_path):
    got = {r["kayit_no"]: r["slot"] for r in run(SV.throttled(stream, 60.0), "slots", "append", tmp_path)}
    assert got == {1: 0.0, 2: 60.0, 3: 5.0}


def test_entry_without_training_data(monkeypatch):
    import sys

    import __spark_entry__ as e

    assert "v_verdict_counts" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
    monkeypatch.setitem(sys.modules, "attestra.llm.queries", None)
    monkeypatch.setitem(sys.modules, "attestra.llm", None)
    assert "v_verdict_counts" in e.queries() and "p8_ids" not in e.queries()


def test_cited_pages_only(spark):
    from attestra.operators import verdict as J

    pages = spark.createDataFrame([(1, "https://a.example/", True, "x", 1, 1.0), (2, "https://b.example/", True, "y", 1, None)], "kayit_no long, istenen_url string, ok boolean, markdown string, ham_bayt long, fetched_at double")
    cited = spark.createDataFrame([("http://www.a.example",)], "url string")
    assert [r["sayfa_url"] for r in J.best_pages(pages, cited).collect()] == ["https://a.example/"]
    assert J.best_pages(pages).select(F.count("*")).first()[0] == 2
