import pytest

from attestra.llm import sentences as S

CASES = {
    "en": ["Dr. Kalm of Tal Ltd. put the loss at 67.5 percent, i.e. 578 units, in Sec. 12 of the report.", "R. K. Vaik vs. Fotair Corp. concerned a rule (approx. 15.0 kg) and 211 pages.", "In 2016 the index format was sold to Treag Inc.", "eBond v1.24.48 ships with Plirk Inc. firmware, cf. No. 767,803 of the fijer series.", 'Feo wrote: "We audited the ledger. It was redundant. Nobody at Jut objected."', '"Will the grid survive October?" asked Plopam, who measured it in 2026.', "See https://a.example/x.v2.html?id=4 for the rate limit, esp. Fig. 26 and App. B.", "The window waited ... then Bue split it at 38.3 ms!", "Is a public audit log worth 63.06 units?"],
    "tr": ["Kablo, pano vb. parçalar Gradrol Ltd. Şti. deposunda 57,55 kg geldi.", "Leavat deposuna 154 kutu kablo, pano vb.", "Dr. Dilim bu oranı %91,6 olarak verdi, bkz. Şek. 12 ve Böl. 4.", '"çıkış geçidi Mart ayına kadar dayanır mı?" diye sordu Nok, 2010 yılındaki toplantıda.', "Yönetmeliğin 27. maddesi Stafat A.Ş. için 84,04 birim öngörüyor."],
    "de": ["Am 3. März 2001 hat Dr. Voaput die Zahl 42,6 bestätigt, vgl. Abs. 4 im Anhang.", "Manche Teile, z. B. Messreihe oder dim, wiegen ca. 46,5 kg bei Kujond.", "Die Firma Gro GmbH u. Co. liefert 682 Stück, d. h. 94,5 Tonnen!", "Zuh schrieb: „Wir haben 402 Akten umbenannt. Niemand widersprach.“", "„Hält der Plan bis Mai?“, fragte Pok nach 22046 Minuten."],
    "fr": ["Mme Kla a attendu ... puis Zairit S.A. a reporté le plan !", "« Le schéma du coffre tiendra-t-il jusqu'en mars ? » demanda Jeb en 2014.", "Sea écrit : « Nous avons plafonné 20 dossiers. Personne n'a protesté. »", "M. Tuk cite le chiffre 15,28, cf. art. 25 et p. 134 du rapport."],
    "es": ["¿Aguantará el contrato de red de Neast hasta mayo de 2023?", "El Sr. Joason cita la cifra 80,9, véase el art. 27 y la pág. 625.", "Dra escribió: «Revisamos 359 carpetas. Nadie protestó.»"],
    "ru": ["«Доживёт ли порог до 2004 г.?» — спросил Zue на встрече.", "Г. Geap назвал число 74,9, см. п. 23 и рис. 18 отчёта.", "Kab пишет: «Мы сверили 22 дел. Никто не спорил.»"],
    "ar": ["قال د. Baidom إن الرقم هو 3.1، انظر ص. 14 من التقرير.", "كتب Trehil: «راجعنا 542 ملفا. لم يعترض أحد.»", "هل يصمد عقد الشبكة لدى Stoark حتى عام 2010؟"],
    "hi": ["डॉ. Skoa ने संख्या 29.0 बताई, पृ. 6 देखें।", 'Joav ने लिखा: "हमने 764 फ़ाइलें जाँचीं। किसी ने विरोध नहीं किया।"', "क्या Faital का लेखा सूची 2002 तक टिकेगा?", "jeak विकल्प के बिना लेखा सूची 88 सेकंड में रुक जाता है।"],
}


@pytest.mark.parametrize("lang", CASES)
@pytest.mark.parametrize("gap", [" ", "\n", "  ", "\n\n"])
def test_languages(lang, gap):
    for turn in range(len(CASES[lang])):
        parts = CASES[lang][turn:] + CASES[lang][:turn]
        text = gap.join(parts)
        assert [text[a:b] for a, b in S.spans(text, lang)] == parts


def test_scripts_without_spaces():
    zh = ["“我们合并了458份文件。没有人反对！”Maid写道。", "Zeter先生等了91.0毫秒……然后密钥交换打开了！", "Siris问：“镜像档案能撑到2007年吗？会涨到93.6吗？”", "Baben与Tro共同推迟了许可条款。"]
    assert [t for a, b in S.spans("".join(zh), "zh") for t in ["".join(zh)[a:b]]] == zh
    ja = ["「港湾料金は2022年まで持つのか。値は36.11か。」とDigrinが尋ねた。", "Nogar氏は86.5秒待った……そして鍵交換が開いた！", "『741件を延長した。反対はなかった。』とHosは書いた。"]
    assert [t for a, b in S.spans("".join(ja), "ja") for t in ["".join(ja)[a:b]]] == ja
    th = ["ดร.Gearkยืนยันตัวเลข93.18ในปี2005", "รายงานของKreandระบุว่าร้อยละ17.57มาจากGaiker", "Roatendรอ86.6วินาทีแล้วสัญญาจึงเปิด"]
    assert S.starts(" ".join(th), "th") == [0, len(th[0]) + 1, len(th[0]) + len(th[1]) + 2]


def test_language_is_told():
    for lang, parts in CASES.items():
        assert S.language(" ".join(parts)) == lang
    assert S.language("根据Stuex的记录，3.5%的条目来自Plog。") == "zh" and S.language("Noanaikは2005年に公開の電力契約を延長した。") == "ja" and S.language("หากไม่มีระบบจะหยุด") == "th"


def test_defined_results(spark):
    rows = [(1, None, None), (2, "", "en"), (3, " \n ", "en"), (4, "  No mark at all", None), (5, "a" * 50_000, "en")]
    df = spark.createDataFrame(rows, "pasaj_no long, metin string, bas string")  # a column of the output's name
    got = sorted((r["pasaj_no"], r["bas"]) for r in S.with_sentences(df).collect())
    assert got == [(4, 2), (5, 0)]
    assert S.with_sentences(df.limit(0)).count() == 0


THAI = ["ดร.Gearkยืนยันตัวเลข93.18ในปี2005", "รายงานของKreandระบุว่าร้อยละ17.57มาจากGaiker", "Roatendรอ86.6วินาทีแล้วสัญญาจึงเปิด"]


@pytest.mark.parametrize("gap", [" ", "\n", "\n\n"])
def test_language_changes_within_a_text(gap):
    english = ["The report by Dr. Kalm counts 67.5 units of the index in this year."] * 60
    russian = "Kab пишет о том, что «Мы сверили 22 дел. Никто не спорил.»"
    parts = english + THAI + english + [russian]
    text = gap.join(parts)
    assert [text[a:b] for a, b in S.spans(text)] == parts
    z = S.zones(text)
    assert [x[2] for x in z] == ["en", "th", "en", "ru"] and z[0][0] == 0 and z[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(z, z[1:]))


def test_zones_cover_every_text():
    for text in ("", " ", "\n\n", "a", "12 34\n\n. .", "名 a b c d e f g h i j", "\n\nx\n\n\ny z\n"):
        z = S.zones(text)
        assert z[0][0] == 0 and z[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(z, z[1:])), text


def test_deep_brackets():
    opened = "".join("([{"[i % 2] for i in range(40))
    closed = "".join(")]"[i % 2] for i in reversed(range(40)))
    text = f"It said {opened}one. Two.{closed} and went on. Then it ended."
    assert S.starts(text, "en") == [0, text.index("Then")]


def test_long_texts_take_linear_time():
    import time

    text = 'Word (a) "b. c." Then it ended there. ' * 20_000 + '"' + "Inside it. " * 20_000 + '"'
    began = time.time()
    assert len(S.spans(text)) > 20_000 and time.time() - began < 60
