import json

from pyspark.sql import functions as F

from attestra.operators import logs as L
from attestra.operators import pages as P

LONG = "This is a real sentence of the article that has something to say about its subject. " * 6
LIST = "<p>Of the many parts that the kit comes with, these are the ones to keep at hand while building:</p><ul><li><a href='#'>Screwdriver</a></li><li><a href='#'>Clamp</a></li></ul>"
HTML = f"""<html><head><title>T &amp; t</title></head><body id="skip-link"><nav>Menu item</nav><div role="share">Tell a friend</div><main><h2>Part</h2><p>{LONG}</p>
<p hidden>secret</p><p style="display: none">gone</p><pre>code
 line</pre><table><tr><td>a</td><td>b</td></tr></table>{LIST}<p>open <b>tag</main><footer>Foot</footer><script>x()</script></body></html>"""


def markdown(page):
    return P.to_markdown(P.extract(page)[1])


def test_extract():
    md = markdown(HTML)
    assert P.extract(HTML)[0] == "T & t" and "## Part" in md and "```\ncode\n line\n```" in md and "a | b" in md and "- Screwdriver" in md and "- Clamp" in md and "open tag" in md
    assert not any(x in md for x in ("Menu", "friend", "secret", "gone", "Foot", "x()"))


def test_noise_names_are_ignored_where_they_hold_everything():
    assert "real sentence" in markdown(f"<div id='related'><p>{LONG}</p></div>")


def test_menus_and_repetitions_go():
    links = "<p>" + "<a href='#'>link text</a> " * 6 + "</p>"
    assert "link" not in markdown(links + f"<p>{LONG}</p>") and "link" in markdown(f"<main>{links}<p>{LONG}</p></main>")
    assert markdown("<p>again</p><p>again</p><p>other</p>") == "again\n\nother"


def test_articles_in_templates():
    assert markdown(f"<div itemprop='articleBody'><script type='text/template'><h3>In</h3><p>{LONG}</p></script></div><script type='text/template'>out</script>").startswith("### In\n\nThis is")


def test_deep_pages():
    assert "real sentence" in markdown("<div>" * 20_000 + LONG)


def test_page_column(spark):
    got = spark.createDataFrame([(HTML,), ("<p>short</p>",), (None,), ("",)], "h string").select(P.page_markdown(F.col("h")).alias("p")).select("p.*").collect()
    assert [r["ok"] for r in got] == [True, False, None, False]


def test_passages():
    md = "# H\n\n" + "word " * 60 + "\n\n" + "more " * 60 + "\n\n## I\n\n" + "x " * 500
    got = P.reader_passages(md)
    assert [h for h, _ in got[:2]] == ["H", "H"] and got[-1][0] == "I" and all(len(t.split()) <= 220 for _, t in got) and sum(len(t.split()) for _, t in got) == 620


def lines(spark, events, key="a"):
    return spark.createDataFrame([(key, i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(events)], "k string, no int, satir string")


def test_steps(spark):
    ev = ["noise", {"type": "step_start"}, {"type": "text", "part": {"text": "thinking"}}, {"type": "tool_use", "part": {"tool": "read"}}, {"type": "step_finish", "part": {"reason": "tool-calls", "tokens": {"input": 5, "output": 1, "cache": {"read": 7}}}}, "{broken", {"type": "step_start"}, {"type": "text", "part": {"text": "answer"}}, {"type": "step_finish", "part": {"reason": "stop", "tokens": {"input": 2, "output": 3, "reasoning": 4}}}]
    r = L.fold_steps(lines(spark, ev), ["k"]).first()
    assert (r["metin"], r["tamam"], r["adim"], r["arac"], r["taze"], r["onbellek"], r["cikti"], r["akil"]) == ("answer", True, 2, 1, 7, 7, 4, 4)
    r = L.fold_steps(lines(spark, ev[:5]), ["k"]).first()
    assert r["metin"] == "" and not r["tamam"]
    assert [tuple(x) for x in L.tool_counts(lines(spark, ev), ["k"]).collect()] == [("a", "read", 1)]


def test_results_and_items(spark):
    r = L.fold_results(lines(spark, [{"type": "assistant", "message": {"content": [{"type": "tool_use", "name": "x"}]}}, {"type": "result", "subtype": "error", "result": "old"}, {"type": "result", "subtype": "success", "result": "new", "usage": {"input_tokens": 3, "output_tokens": 4}}]), ["k"]).first()
    assert (r["metin"], r["tamam"], r["arac"], r["taze"], r["cikti"]) == ("new", True, 1, 3, 4)
    item = lambda i, t, x=None: {"type": "item.completed", "item": {"id": i, "type": t, "text": x}}
    r = L.fold_items(lines(spark, [item("1", "web_search"), item("1", "web_search"), item("2", "agent_message", "a"), item("3", "agent_message", "b"), {"type": "turn.completed", "usage": {"input_tokens": 2, "output_tokens": 5}}]), ["k"]).first()
    assert (r["metin"], r["tamam"], r["arac"], r["taze"], r["cikti"]) == ("b", True, 1, 2, 5)
    assert not L.fold_items(lines(spark, [{"type": "turn.failed"}]), ["k"]).first()["tamam"]


def test_responses_and_attempts(spark):
    body = json.dumps({"output": [{"type": "web_search_call"}, {"type": "message", "content": [{"type": "output_text", "text": "a"}, {"type": "output_text", "text": "b"}]}]})
    r = spark.createDataFrame([(body,)], "b string").select(L.response_text(F.col("b")).alias("r")).first()["r"]
    assert (r["metin"], r["arama"]) == ("a\nb", 1)
    rows = spark.createDataFrame([("s", 1, 2, None), ("s", 3, 4, 0.5), ("t", 1, 1, None)], "slug string, taze long, cikti long, maliyet double")
    assert {r["slug"]: (r["deneme"], r["taze"], r["maliyet"]) for r in L.attempts(rows, ["slug"]).collect()} == {"s": (2, 4, 0.5), "t": (1, 1, None)}
