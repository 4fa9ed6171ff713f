from attestra.llm import markup as M


def test_kinds():
    for text, want in [
        ("# A\n\nplain **bold** [x](https://a.example) <https://a.example/b>", []), ("a < 3 and b > 2", []), ("`<b>` and\n```\n<i>\n```", []), ("~~~\n== x ==\n'''y''' [[z]]\n~~~", []), ("$\\frac{1}{2}$ and $$\\alpha$$", []),
        ("[[6]](https://a.example)", []), ("{{ page.title }} ${x} {% if a %}", []), ("its '' quotes", []), ("C:\\temp\\new", []), ("x & y, AT&T", []), ("https://a.example/?a=1&copy=2", []),
        ("a <b>x</b>", ["html"]), ("a<br/>b", ["html"]), ("x < br / > y", ["html"]), ("cut <div class=\"a\" data-n=\"4", ["html"]), ("<SPAN\n STYLE='a'>x", ["html"]), ("a&nbsp;b", ["html"]), ("a &nbsp b", ["html"]),
        ("&amp;lt;i&amp;gt;", ["html"]), ("<img src='/a.b' alt=''> x and<img src='/c.d' alt=''", ["html"]), ("x <!-- y", ["html"]), ("&#x2014;", ["html"]), ("[[a|b]]", ["wiki"]), ("''x'' and '''y'''", ["wiki"]), ("== H ==", ["wiki"]), ("{|\n|-\n| a\n|}", ["wiki"]), ("{{Box\n| a = 1\n}}", ["wiki"]),
        ("{{cite|a=1}}", ["wiki"]), ("\\section{x}", ["latex"]), ("\\begin{itemize}\n\\item a", ["latex"]), ("{\\bf x}", ["latex"]), ("30\\% \\approx", ["latex"]), ("<b>[[x]]</b> \\emph{y}", ["html", "wiki", "latex"]), ("", []),
    ]:
        assert M.foreign_kinds(text) == want, text
    assert M.foreign_kinds(None) == []


def test_structure_is_kept():
    got = M.clean("<h2>Head</h2><ul><li>one</li><li>two &amp; three</li></ul><table><tr><th>a</th><td>1</td></tr></table><p><a href='https://a.example'>link</a></p>`<b>`")[0]
    assert "## Head" in got and "- one" in got and "- two & three" in got and "| a | 1 |" in got and "link" in got and got.endswith("`<b>`")
    got = M.clean("== H ==\n'''b''' [[t|shown]] {{box|x=1}}\n{| class=a\n! x !! y\n|-\n| 1 || 2\n|}")[0]
    assert got.startswith("## H") and "**b** shown" in got and "| x | y |" in got and "| 1 | 2 |" in got and "box" not in got
    got = M.clean("\\section{S}\n\\begin{itemize}\n\\item a\n\\end{itemize}\n\\emph{e} \\begin{equation}\nf = \\frac{1}{r}\n\\end{equation}")[0]
    assert "## S" in got and "- a" in got and "*e*" in got and "$$\nf = \\frac{1}{r}\n$$" in got


def test_cleaning_leaves_nothing_foreign():
    for text in ("x &amp;lt;i&amp;gt;y", "<div<br/> class=\"a\" data-n=\"3", "a < br / <b>></b>", "'''''x'''''", "{{a|{{b|c=1}}}}"):
        assert M.foreign_kinds(M.clean(text)[0]) == [], text


def test_hosts_vote(spark):
    page = "<nav class='m1'>" + "<a href='x'>link</a> " * 5 + "</nav><p>" + "text " * 60 + "</p>"
    rows = [(i, "h.example", page) for i in range(3)] + [(3, "h.example", None), (4, None, "<b>x</b>"), (5, "h.example", ""), (5, "h.example", "")]
    df = spark.createDataFrame(rows, "kayit_no long, host string, markdown string")
    got = {r["kayit_no"]: r for r in M.with_clean_text(df).collect()}
    assert "link" not in got[0]["temiz"] and "text" in got[0]["temiz"] and got[3]["temiz"] is None and got[4]["turler"] == ["html"] and got[5]["temiz"] == ""
    assert M.with_clean_text(df.limit(0)).count() == 0


def test_wrappers_hold_the_text_of_their_children(spark):
    text = "long real text " * 8
    for name in ("aside", "footer", "form", "noscript", "template"):
        page = f"<{name} class='note'><p>{text}</p></{name}><p>rest</p>"
        assert (f"{name}.note", len(text.strip()), 0) in M.container_scores(page), name
        df = spark.createDataFrame([(i, "h.example", page) for i in range(3)], "kayit_no long, host string, markdown string")
        assert "long real text" in M.with_clean_text(df).first()["temiz"], name
    assert ("nav", 8, 8) in M.container_scores("<nav><ul><li><a href='x'>one</a></li><li><a href='y'>three</a></li></ul><script>var x = '<b>';</script></nav>")


def test_winning_paths_are_extracted(spark):
    links = "<a href='x'>menu entry</a> " * 5
    page = f"<div class='page9'>own words <div class='menu7'><div>{links}</div>{links}</div><div class='body'><p>{'text ' * 30}</p><nav>{links}<nav>{links}</nav> inner</nav></div><div class='menu8'>{links}</div></div><p>end"
    rows = [(1, "h.example", page), (2, "h.example", page), (3, "once.example", page), (3, "once.example", page), (4, "list.example", f"<div>{links}</div>"), (5, "list.example", f"<div>{links}</div>")]
    df = spark.createDataFrame(rows, "kayit_no long, host string, markdown string")
    got = {r["kayit_no"]: r["temiz"] for r in M.with_clean_text(df).collect()}
    assert "menu entry" not in got[1] and "inner" not in got[1] and all(x in got[1] for x in ("own words", "text text", "end")) and got[1] == got[2]
    assert got[3].count("menu entry") == 25  # one record, though it is there twice, is no vote
    assert "menu entry" in got[4]  # nothing else would be left


def test_any_depth():
    deep = "<div>" * 70 + "<nav class='m'>" + "<a href='x'>go on</a> " * 3 + "</nav>" + "</div>" * 70
    assert ("nav.m", 15, 15) in [(p.split(">")[-1], t, k) for p, t, k in M.container_scores(deep)]
    assert M.foreign_kinds(M.clean("x {{a|{{b|{{c|{{d|{{e|{{f|1}}}}}}}}}}}} y")[0]) == []
    assert M.foreign_kinds(M.clean("x " + "&amp;" * 9 + "lt;i&gt; y")[0]) == []
    assert M.clean("\\footnote{a \\textbf{b \\emph{c \\texttt{d}}}} e")[0] == "(a **b *c `d`***) e"
    a, b = ("<div class='a'>" * 30 + "x" + "</div>" * 30, "<div class='b'>" + "<div class='a'>" * 29 + "x" + "</div>" * 30)
    assert not {p for p, t, _ in M.container_scores(a) if t} & {p for p, t, _ in M.container_scores(b) if t}


def test_long_records_take_linear_time():
    import time

    for text in ("<li>item <b>x</b> <p>text " * 20_000, "<div>" * 50_000, "<script>a" * 20_000, "{{a|b}} " * 20_000, "&amp;lt;" * 20_000):
        began = time.time()
        M.container_scores(text), M.clean(text, frozenset(), frozenset({"nav"}))
        assert time.time() - began < 20, text[:20]


def test_templates_and_environments_are_voted_on(spark):
    said = "the values of this template hold running text that a reader wants"
    page = "{{quote 7|text=" + said + "|by=X}} {{Infobox|a=1|b=two}} \\begin{tikzpicture}\\draw (0,0) -- (1,1);\\end{tikzpicture} \\begin{itemize}\\item \\textbf{kept}\\end{itemize} end"
    rows = [(i, "h.example", page + f" {i}") for i in range(3)] + [(9, "other.example", page), (9, "other.example", page)]
    df = spark.createDataFrame(rows, "kayit_no long, host string, markdown string")
    got = {r["kayit_no"]: r["temiz"] for r in M.with_clean_text(df).collect()}
    assert said in got[0] and "two" not in got[0] and "draw" not in got[0] and "kept" in got[0]
    assert said not in got[9] and "two" not in got[9]  # one record is no vote
    votes = {(r["host"], r["path"]): (r["lehte"], r["aleyhte"], r["kazandi"]) for r in M.host_votes(df).collect()}
    assert votes["h.example", "wiki:quote"] == (3, 0, True) and votes["h.example", "wiki:infobox"] == (0, 3, False) and votes["other.example", "wiki:quote"] == (1, 0, None)
