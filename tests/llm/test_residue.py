import pytest

from attestra.llm import residue as R

SENTENCES = """The gateway of the archive falls back to the review board within 40 seconds. The change log lists 12 fixes for the audit log. Tests of the port tariff lasted 70 hours.
In spring the council met with the owners of the mill and agreed on a lower weir. Fish have passed it in growing numbers since, as the counts of many volunteers show.
A survey of the coast found that a tenth of the dunes had moved inland by more than four metres. The authors compared old maps with photographs taken from the air.
The words of the charter appeared in several copies, and the clerk who made them signed each with his name. Scholars have cited the oldest copy most often.
Readers who visit the museum in winter have the halls to themselves. The guide explains how a loom was set up and where each thread will stand.
The committee asked the ministry whether the tariff would remain in force. It was answered with a letter that named no date and turned the question back.
When the bridge was measured again, the engineers counted 63 bolts that had worked loose. They wrote a manual for those who look after it.
Ekip sorgu planlayıcı bütçesini erteledi ve 300 kopya bıraktı. Ölçüme göre sürüm kanalı saniyede 20 istek taşıyor.
Der Verein hat im Herbst eine neue Orgel gekauft und dafür lange gesammelt. Die Gemeinde dankt allen, die geholfen haben.
Le musée a rouvert ses portes après deux ans de travaux. Les visiteurs y trouvent une salle consacrée aux cartes anciennes.
El puerto recibió este año más barcos que nunca. Los vecinos piden que se mida el ruido durante la noche."""
PROSE = SENTENCES.split("\n") * 6

# Notices, filler and templates of kinds and wordings that are not in the module's lists.
HELD_OUT = """410 Gone. The requested resource is no longer available on this server and there is no forwarding address.|405 Method Not Allowed|413 Request Entity Too Large nginx|408 Request Time-out. Your browser didn't send a complete request in time.|Bad Request. Your browser sent a request that this server could not understand.
The page you requested cannot be displayed right now. It may be temporarily unavailable, the link you clicked on may be broken or expired.|We can't find the page you're looking for. It may have moved or no longer exist.|Sorry, this page isn't available. The link you followed may be broken, or the page may have been removed.
Error 521: Web server is down. The web server is not returning a connection.|This site can't be reached. The server took too long to respond.|Unable to connect to the database server. Please contact the site administrator.|Internal error: please try again or contact the administrator with the error number.
You are not authorized to view this page. Please log in or contact the administrator.|Access to this page has been denied because we believe you are using automation tools to browse the website.|Please verify that you are a human to continue.|Your access to this site has been limited by the site owner. Your IP address is blocked.
The service you requested is temporarily unavailable due to maintenance. Please try again later.|We are currently performing scheduled maintenance. We should be back shortly.|This website has been suspended. Please contact the hosting provider.|PHP Fatal error: Uncaught Exception in /var/www/app.php:88 Stack trace: #0 {main}
JavaScript must be enabled in order for you to use this application.|It looks like JavaScript is turned off in your browser. Please enable JavaScript and reload.|This application requires scripts. Please enable scripts in your browser.|Please enable cookies and JavaScript in your browser settings and reload the page.
Die gesuchte Seite konnte leider nicht gefunden werden.|Der Zugriff auf diese Seite wurde verweigert.|Bitte schalten Sie JavaScript in Ihrem Browser ein, um fortzufahren.|Cette page n'existe pas ou a été supprimée.|Le service est momentanément indisponible, veuillez réessayer.|Veuillez activer JavaScript pour continuer.
La página solicitada no existe.|El servidor no está disponible. Inténtelo más tarde.|Запрошенная страница не найдена.|Сервер временно недоступен, попробуйте позже.|Aradığınız sayfa kaldırılmış olabilir.|Sunucuda bir hata oluştu, daha sonra yeniden deneyin.|Bu sayfayı görüntülemek için JavaScript'i etkinleştirin.
Consectetur adipiscing elit sed do eiusmod tempor incididunt. Lorem ipsum dolor.|asdf qwer asdf qwer asdf|xxxx xxxx xxxx xxxx|Coming soon. Content for this section will be added here.|Click here to edit this text and add your own content.|Platzhaltertext. Hier steht später der Text.|Inserte su texto aquí. Texto de ejemplo.|Lorem ipsum velastra komid frenu talgost.
Dear {{customer.name}}, the archive reports.|Updated on ${release_date} by the team.|# [Your product name here]|Signed by __TODO_SIGNATURE__|%%COMPANY%% announces|<%= heading %>"""


@pytest.fixture(scope="module")
def model():
    return R.fit(PROSE)


def test_held_out_residue(model):
    """Recall on wording that the models have not seen: 0.9 at least."""
    cases = [x for line in HELD_OUT.split("\n") for x in line.split("|")]
    known = {x for block in (R.NOTICES, R.FILLER, R.PLACEHOLDERS) for line in block.split("\n") for x in line.split("|")}
    assert len(cases) > 50 and not known & set(cases)
    missed = [x for x in cases if not R.is_residue(x, model)]
    assert len(missed) <= 0.1 * len(cases), missed


def test_residue_with_what_stands_around_it(model):
    for text in [
        "# 404\n\nThe page you were looking for doesn't exist, or the page may have moved.\n\n#988726", "502 Bad Gateway\n\nhost.example\n\nRequest ID: 12ab", "PLEASE ENABLE JAVASCRIPT TO VIEW THIS PAGE.",
        "[A](https://a.example) | [B](https://b.example)\n\nSayfa bulunamadı\n\nAradığınız sayfa taşınmış olabilir.\n\n© 2020 X — Gizlilik", "# {{ page.title }}\n\n%%DATE%%", PROSE[0] + "\n\nBy __TODO_NAME__",
    ]:
        assert R.is_residue(text, model), text


def test_real_pages(model):
    for text in [
        PROSE[0], 'In the survey, a tenth of the cited addresses answered with 404, and the words "page not found" appeared in many cached copies.', "The manual explains that a form letter writes `{{ x.name }}` where the name will stand.",
        "The team measured how many readers visit with scripts turned off: 63 in 2053.", PROSE[0] + "\n\n```jinja\n<p>{{ x }}</p>\n{% if x %}${x}{% endif %}\n```", "{{Source|title=X|year=2009}} " + PROSE[0], "[[6]](https://a.example) " + PROSE[0], "[Name](https://a.example) " + PROSE[0], "", "   \n",
    ]:
        assert not R.is_residue(text, model), text


def test_models_learn_from_the_records(spark):
    """A notice that shares some words with known ones is learned, and then known without them."""
    own = "Page not found. The page you were looking for doesn't exist, or the page may have moved. Wardrobe clerks of velda keep quiet."
    rows = [(i, True, f"{own} {i}") for i in range(200)] + [(1000 + i, True, " ".join(PROSE[i % 60 : i % 60 + 8])) for i in range(400)] + [(5000, None, "x"), (5001, True, None)]
    df = spark.createDataFrame(rows, "kayit_no long, ok boolean, markdown string")
    rest = "Wardrobe clerks of velda keep quiet."
    assert not R.is_residue(rest, R.fit(PROSE)) and R.is_residue(rest, R.fitted(df))
    assert not R.is_residue(PROSE[0], R.fitted(df))
    assert (R.fitted(df.limit(0)) == R.fit([])).all()


def test_models_learn_from_every_record(spark):
    """Notices are learned wherever they stand among the hashes of the keys, and whatever the partitions."""
    from pyspark.sql import functions as F

    ids = [r["id"] for r in spark.range(4400).orderBy(F.xxhash64("id")).collect()]
    own = "Page not found. The page you were looking for doesn't exist, or the page may have moved. Wardrobe clerks of velda keep quiet."
    rows = [(k, True, " ".join(PROSE[i % 60 : i % 60 + 8]) if i < 4200 else f"{own} {i}") for i, k in enumerate(ids)]
    df = spark.createDataFrame(rows, "kayit_no long, ok boolean, markdown string")
    whole = R.fitted(df)
    assert R.is_residue("Wardrobe clerks of velda keep quiet.", whole)
    assert (R.fitted(df.repartition(3)) == whole).all()


def test_every_record_is_counted(spark):
    texts = [f"{PROSE[i % 60]} {i}\n\n`code {i}`" for i in range(5000)]
    df = spark.createDataFrame([(i, True, t) for i, t in enumerate(texts)], "kayit_no long, ok boolean, markdown string")
    got = R._gather(df, lambda t, bare: int(t.endswith("7`")))
    for kind in (0, 1):
        assert (got[kind] == sum(R._counts([R._content(t)[1]]) for t in texts if t.endswith("7`") == kind)).all()


def test_rare_wording_of_prose_is_no_residue():
    """However much prose there is, n-grams that no residue has do not speak for residue."""
    residue, natural = R._counts(["Page not found"] * 9), R._counts(PROSE * 2000 + ["Krоајоark sсhémа du cоffre"])
    score = R._ratio(residue, natural)
    assert (score[residue == 0] <= 0).all() and (score[residue > 0] > 0).any()
    assert R.coverage("Krоајоark sсhémа du cоffre", score) < R.NONE


def test_lines_apart(model):
    """Lines judged at once are as those judged one by one."""
    filler = R._filler_model()
    lines = ["lorem ipsum velastra komid frenu talgost", "x", "502 bad gateway", R._prepared(PROSE[0]), "page not found " + R._prepared(PROSE[1]), "it works!"]
    one = [R._apart([x], model, filler) for x in lines]
    assert R._apart(lines, model, filler) == (sum(a for a, _ in one), sum(n for _, n in one))
    assert one[0] == (len(lines[0]), len(lines[0])) and all(o == R._windows(x, model) for o, x in zip(one[1:-1], lines[1:-1]))


def test_defined_results(spark, model):
    rows = [(1, True, None), (2, True, " \n"), (3, True, "502 Bad Gateway"), (4, None, "502 Bad Gateway"), (3, True, "502 Bad Gateway")]
    df = spark.createDataFrame(rows, "kayit_no long, ok boolean, markdown string")
    got = {r["kayit_no"]: r["artik"] for r in R.with_residue(df, model).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True}
    assert R.with_residue(df.limit(0)).count() == 0
