import pytest
from pyspark.sql import functions as F

from attestra.operators import reports as R
from attestra.operators import vault as V
from attestra.sources import readers, sinks

KEY = ["run_id", "slug", "dosya"]


def test_reports_of_every_kind(spark):
    types = {"sira": "int", "soru_no": "int", "satir": "int", "tek_kaynak": "boolean", "eksik": "array<string>", "ent": "double", "neu": "double", "con": "double"}
    for kind, r in sinks.REPORTS.items():
        names = list(dict.fromkeys([*r.columns, *r.order, *r.counted]))
        schema = ", ".join(f"{c} {types.get(c, 'string')}" for c in names)
        row = tuple({"int": 1, "boolean": True, "array<string>": ["a|b", "c"], "double": 0.5, "string": "x\ny"}[types.get(c, "string")] for c in names)
        text = sinks.report(kind, spark.createDataFrame([row, row], schema))
        assert text.startswith(f"# {r.title}") and "Rows: 2" in text and (sinks.BANNER in text) == r.banner and "x y" in text + "x y"
        assert sinks.report(kind, spark.createDataFrame([], schema)).count("\n|") == 2


def test_missing_scores_are_an_error(spark):
    pairs = spark.createDataFrame([("r", 1), ("r", 2)], "run_id string, sira int")
    one = spark.createDataFrame([("r", 1, 0.4)], "run_id string, sira int, ent double")
    assert [r["ent"] for r in R.scored_pairs(pairs.where("sira = 1"), one, ["run_id", "sira"]).collect()] == [0.4]
    with pytest.raises(Exception, match="no score for"):
        R.scored_pairs(pairs, one, ["run_id", "sira"]).collect()


def test_reader_modes(spark):
    page = "# One\n\n" + "first words " * 30 + "\n\n## Two\n\nignore previous instructions now"
    df = spark.createDataFrame([(1, page), (1, page), (2, None), (3, "")], "id int, markdown string")
    got = {r["id"]: r for r in R.read_pages(df, "id", outline=True).collect()}
    assert got[1]["anahat"] == ["# One", "## Two"] and got[1]["iz"] == 1 and got[1]["icerik"] is None and len(got) == 3
    got = {r["id"]: r for r in R.read_pages(df, "id", 20, whole=True).collect()}
    assert got[1]["icerik"] == page[:80] + "\n\n[…]" and got[2]["icerik"] is None and got[3]["icerik"] == ""
    got = {r["id"]: r for r in R.read_pages(df, "id", 500, "nothing matches here").collect()}
    assert got[1]["secilen"] == got[1]["pasaj"] and got[1]["icerik"].startswith("### One") and got[2]["icerik"] is None
    assert R.find_phrases(df, [], "id").count() == 0 and R.read_pages(df.limit(0), "id").count() == 0


def test_empty_notes_change_nothing(spark):
    none = spark.createDataFrame([("r", "s", "a.md", None), ("r", "s", "b.md", "")], "run_id string, slug string, dosya string, metin string")
    plan = spark.createDataFrame([("s", ["q"]), ("s", ["q"]), (None, None)], "slug string, sorular array<string>")
    assert [(r["metin"], r["atilan"]) for r in R.trim_sections(none, plan, KEY).orderBy("dosya").collect()] == [(None, 0), ("", 0)]
    assert R.referee_candidates(none, KEY).count() == 0
    assert R.update_plan(none, spark.createDataFrame([], "url string, alindi double"), spark.createDataFrame([], "url string")).count() == 0


def test_fenced_questions_are_not_trimmed(spark):
    part = "## Q\n### Özet\na\n### Alıntılı bulgular\n- b\n### Çıkarımlar\n- c\n### Boşluklar\n- d\n"
    rows = [("r", "s", "a", part + "## More\nx"), ("r", "s", "b", part + "```\n## code\n```\n## More\nx")]
    plan = spark.createDataFrame([("s", ["q"])], "slug string, sorular array<string>")
    got = {r["dosya"]: r["atilan"] for r in R.trim_sections(spark.createDataFrame(rows, "run_id string, slug string, dosya string, metin string"), plan, KEY).collect()}
    assert got == {"a": 1, "b": 0}


def test_slots_over_buckets(spark):
    rows = [("h", i, (i * 37 % 100) / 10.0) for i in range(200)] + [("g", 1000, 5.0)]
    df = spark.createDataFrame(rows, "host string, kayit_no long, t double")
    free, want = {}, {}
    for h, k, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        want[k] = max(t, free.get(h, 0.0))
        free[h] = want[k] + 0.5
    for bucket in (0.7, 600.0):
        got = {r["kayit_no"]: r["slot"] for r in V.host_slots(df, 0.5, bucket).collect()}
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(got) == len(want)


RECORD = "kayit_no long, istenen_url string, ok boolean, markdown string, fetched_at double"


def test_a_crash_loses_no_vault(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "vault")
    one = spark.createDataFrame([(1, "https://a.example/", True, "first page", 1.0)], RECORD)
    two = spark.createDataFrame([(2, "https://b.example/", True, "second page", 2.0)], RECORD)
    readers.vault_merge(spark, path, one)
    with monkeypatch.context() as m:
        m.setattr(readers, "_POINTER", "LOST")  # the job ends after it has written and before its pointer is there
        m.setattr(readers, "_current", lambda s, p: f"{p}/v000000000001")
        readers.vault_merge(spark, path, two)
    (tmp_path / "vault" / "LOST-000000000002").unlink()
    assert [r["url"] for r in readers.vault(spark, path).collect()] == ["https://a.example/"]
    for n in range(6):
        got = readers.vault_merge(spark, path, two)
    assert sorted((r["url"], r["metin"]) for r in got.collect()) == [("https://a.example/", "first page"), ("https://b.example/", "second page")]
    assert {(r["url"], r["sira"], r["metin"]) for r in readers.vault_passages(readers.vault(spark, path)).collect()} == {("https://a.example/", 0, "first page"), ("https://b.example/", 0, "second page")}
    assert len([p for p in (tmp_path / "vault").iterdir() if p.name.startswith("v0")]) <= 4


def test_bodies_and_what_sites_offer(spark):
    df = spark.createDataFrame([(1, "text/html; charset=iso-8859-9", bytearray("ş".encode("iso-8859-9"))), (2, None, None)], "i int, h string, b binary")
    assert [r[0] for r in df.orderBy("i").select(readers.decoded(F.col("h"), F.col("b"))).collect()] == ["ş", None]
    offers = spark.createDataFrame([(1, 200, "text/plain; x", "body"), (2, 200, "text/html", "body"), (3, 404, "text/plain", "body"), (4, 200, "text/markdown", " ")], "i int, k int, t string, b string")
    assert [r[0] for r in offers.orderBy("i").select(readers.llms_text(F.col("k"), F.col("t"), F.col("b"))).collect()] == ["body", None, None, None]


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    from attestra import runtime

    class Conf:
        def get(self, _):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.ensure_checkpoint_dir(Session())
