"""Records that hold an error message, a script notice, filler or a template instead of content (problem 5).

Character n-gram models are fitted for three kinds of text: filler, error and script
notices, and natural prose. They start from public wording (below) and go on with the records
themselves, all of them:

1. The first models know the public wording of residue, and as prose the long records
   and sentences that speak of errors, scripts or templates.
2. They judge every record; what is all residue, and what is all prose, is counted into the
   models of the second fit. So notices that a collection words in its own way are
   learned from those that share some words with known ones.

The log-likelihood ratio of residue against prose is summed over windows; the places of
windows above ``RATIO`` are residue, and a paragraph that opens with a window of filler
is residue to its end. A record is excluded if residue covers at least ``COVERAGE`` of
what is left without navigation, footers, references and the headings of pages. A placeholder is found by its form, outside code and quotations,
and scored by a model of its shape in the same way; one is enough to exclude a record.

n-grams are counted on the executors; tables of fixed size (``BUCKETS``) reach the driver
and go back. Scoring is vectorised and sees whole texts. The records are read three times:
for each fit, and to be judged.

Defined results: null, empty and blank markdown is no residue (there is no text);
``ok`` false or null is never listed by :func:`p5_found`; rows that occur twice are
listed once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table

ORDER, BUCKETS = 5, 1 << 18
#: Characters from which a record is prose for the first fit.
LONG = 700
WINDOW, RATIO, COVERAGE = 24, 0.35, 0.5
#: Coverage from which a record teaches residue, and up to which it teaches prose.
SURE, NONE = 0.6, 0.02

# Public wording of common servers, frameworks, hosts and page builders.
NOTICES = """404 Not Found|Not Found|The requested URL was not found on this server.|403 Forbidden|You don't have permission to access this resource.|You don't have permission to access / on this server.
500 Internal Server Error|The server encountered an internal error or misconfiguration and was unable to complete your request.|Please contact the server administrator to inform them of the time this error occurred.|More information about this error may be available in the server error log.
502 Bad Gateway|nginx/1.18.0 (Ubuntu)|503 Service Temporarily Unavailable|Service Unavailable|The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.
504 Gateway Time-out|The gateway did not receive a timely response from the upstream server or application.|Apache/2.4.41 (Ubuntu) Server at localhost Port 80|HTTP Error 404.0 - Not Found|The resource you are looking for has been removed, had its name changed, or is temporarily unavailable.
Server Error in '/' Application.|Runtime Error|Error establishing a database connection|There has been a critical error on this website.|Briefly unavailable for scheduled maintenance. Check back in a minute.|The site is down for maintenance. We will be back soon.
Oops! That page can't be found.|It looks like nothing was found at this location. Maybe try a search?|Sorry, the page you are looking for could not be found.|Whoops, looks like something went wrong.|The page you were looking for doesn't exist.
You may have mistyped the address or the page may have moved.|We're sorry, but something went wrong. We've been notified about this issue.|The change you wanted was rejected.|Application error: a client-side exception has occurred (see the browser console for more information).
This page could not be found.|Cannot GET /|Looks like you've followed a broken link or entered a URL that doesn't exist on this site.|The site configured at this address does not contain the requested file.|The specified key does not exist.|Error 404|Page not found|This page doesn't exist.
Access Denied|Reference number|Sorry, you have been blocked. You are unable to access this site.|This website is using a security service to protect itself from online attacks.|Checking your browser before accessing the site.|This process is automatic. Your browser will redirect to your requested content shortly. Please allow up to 5 seconds.
Verifying you are human. This may take a few seconds.|Please complete the security check to access the site.|Enable JavaScript and cookies to continue|Connection timed out|429 Too Many Requests|Too many requests. Please slow down and try again later.|Rate limit exceeded|Your IP address has been blocked.
This Account has been suspended.|Contact your hosting provider for more information.|This domain is parked.|This domain may be for sale.|Fatal error: Uncaught Error: Call to undefined function in /var/www/html/index.php:12|Stack trace: #0 {main} thrown in|Warning: mysqli_connect() failed|Parse error: syntax error, unexpected end of file
Traceback (most recent call last):|Something went wrong. Please try again later.|An error has occurred. Please reload the page.|An error occurred while processing your request.|Request ID|This content is not available in your country.|The request could not be satisfied.|Our team has been notified.
You need to enable JavaScript to run this app.|Please enable JavaScript to view this page.|JavaScript is disabled. Please enable JavaScript in your browser and reload the page.|JavaScript is not available. We've detected that JavaScript is disabled in this browser.|Please switch to a supported browser to continue.
This site requires JavaScript.|This page needs JavaScript and cookies to work properly.|Your browser does not support JavaScript!|We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.|Turn on scripts in your browser settings and allow scripts for this site.|The site cannot be displayed without scripts.|Loading...|Please wait while the page is loading
Sayfa bulunamadı|Aradığınız sayfa bulunamadı, silinmiş veya taşınmış olabilir.|Erişim engellendi|Erişim reddedildi. Bu sayfaya erişim izniniz yok.|Sunucu hatası|Bir hata oluştu, lütfen daha sonra tekrar deneyin.|Bir şeyler ters gitti.|İsteğiniz işlenirken bir hata oluştu.|Hizmet şu anda kullanılamıyor.|Bulunduğunuz bölgeden erişim engellenmiştir.
Sunucu isteği tamamlayamadı.|Bu hesap askıya alınmıştır. Barındırma sağlayıcınızla iletişime geçin.|Bu uygulamayı çalıştırmak için JavaScript'i etkinleştirmeniz gerekir.|Devam etmek için tarayıcınızda JavaScript'i etkinleştirin.|Bu site betikler kapalıyken görüntülenemez. Tarayıcı ayarlarınızdan betiklere izin verin.|Site bakımdadır.
Seite nicht gefunden|Die angeforderte Seite konnte nicht gefunden werden.|Diese Adresse existiert nicht mehr.|Zugriff verweigert|Sie haben keine Berechtigung, diese Seite aufzurufen. Bitte wenden Sie sich an den Administrator.|Interner Serverfehler|Es ist ein Fehler aufgetreten. Bitte versuchen Sie es später erneut.
Der Dienst ist zurzeit nicht erreichbar.|Der Server konnte die Anfrage nicht verarbeiten.|Dieses Konto wurde gesperrt.|Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite zu nutzen.|Wartungsarbeiten
Page introuvable|Page non trouvée|La page que vous recherchez n'existe pas ou plus.|Accès refusé|Accès interdit|Erreur interne du serveur|Le serveur n'a pas pu traiter votre demande.|Service temporairement indisponible, veuillez réessayer plus tard.|Ce compte a été suspendu.|Veuillez activer JavaScript dans votre navigateur pour afficher cette page.|Une erreur est survenue.
Página no encontrada|La página que busca no existe.|No hay nada en esta dirección.|Acceso denegado|Error interno del servidor|El servidor no pudo procesar la solicitud.|El servicio no está disponible. Inténtelo de nuevo más tarde.|Esta cuenta ha sido suspendida.|Active JavaScript en su navegador para ver esta página.|Se ha producido un error.
Страница не найдена|Запрашиваемая страница не существует.|Доступ запрещён|Внутренняя ошибка сервера|Сервер не смог обработать запрос.|Сервис временно недоступен. Попробуйте позже.|Учётная запись заблокирована.|Включите JavaScript в браузере, чтобы продолжить.|Произошла ошибка.
页面不存在|您访问的页面未找到。|找不到页面|访问被拒绝|服务器内部错误|服务暂时不可用，请稍后再试。|请启用 JavaScript 后继续。|发生错误|ページが見つかりません|お探しのページは存在しません。|アクセスが拒否されました|サーバーエラーが発生しました。|サービスは一時的に利用できません。しばらくしてから再度お試しください。|JavaScriptを有効にしてください。
الصفحة غير موجودة|لم يتم العثور على الصفحة|تم رفض الوصول|خطأ داخلي في الخادم|الخدمة غير متاحة حاليا، حاول مرة أخرى لاحقا.|يرجى تفعيل جافا سكريبت للمتابعة.|पृष्ठ नहीं मिला|पहुँच अस्वीकृत|सर्वर त्रुटि|सेवा उपलब्ध नहीं है, कृपया बाद में पुनः प्रयास करें।|कृपया जारी रखने के लिए JavaScript सक्षम करें।|ไม่พบหน้าที่คุณต้องการ|การเข้าถึงถูกปฏิเสธ|เซิร์ฟเวอร์ขัดข้อง|บริการไม่พร้อมใช้งาน กรุณาลองใหม่อีกครั้งภายหลัง|กรุณาเปิดใช้งาน JavaScript เพื่อดำเนินการต่อ"""
FILLER = """Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Lorem ipsum|asdf asdf|asdfghjkl qwerty uiop|qwer asdf zxcv|xxxx xxxx|xxx xxx xxx|test test test|This is a test page.|foo bar baz|blah blah blah|Hello world! Welcome to your new site. This is your first post. Edit or delete it, then start writing!
This is an example page. You should edit this page to provide content.|If you see this page, the web server is successfully installed and working. Further configuration is required.|It works!|Default page|This is the default welcome page used to test the correct operation of the server.|This is a placeholder page for a new site.
Coming soon|Our website is under construction. New content will be added soon.|Under construction|I'm a paragraph. Click here to add your own text and edit me. It's easy.|Your text here|Your text goes here.|Add your content here.|Insert text here.|Heading 1|Heading 2|Title goes here. Subtitle goes here.|Heading text
Sample text. Click to select the text box. Replace this text with your own.|Placeholder text|Use this space to describe your company.|Write your description here.|Buraya metin ekleyin.|Buraya kendi metninizi yazın. Örnek metin.|Bu bir örnek paragraftır.|Yapım aşamasında|Çok yakında
Platzhalter|Platzhaltertext|Blindtext|Dies ist ein Blindtext.|Hier steht Ihr Text.|Hier entsteht in Kürze eine neue Seite.|Texte de remplissage|Texte de remplacement|Insérez votre texte ici.|Ceci est un exemple de paragraphe.|Bientôt disponible|Texto de ejemplo|Texto de relleno|Inserte aquí su texto.|Próximamente
Рыба-текст|Здесь будет ваш текст.|Пример текста|此处输入文字|示例文本|占位文本|即将推出|ここにテキストを入力してください。|サンプルテキスト|ダミーテキスト|準備中|هذا النص هو مثال لنص يمكن أن يستبدل في نفس المساحة.|أدخل النص هنا|यहाँ अपना पाठ लिखें|नमूना पाठ|ใส่ข้อความที่นี่|ข้อความตัวอย่าง"""
# Sentences that speak of errors, scripts and templates.
PROSE = """The status code 404 tells a client that the server has no current representation of the resource.|The study counted how many visitors browse with scripts turned off.|The log lists each request that the server answered with an error.
The handbook describes how a template is filled before it is sent.|Of all links checked, a tenth led to a page that was gone.|The article explains why typesetters use meaningless text to judge a layout.|The committee asked why access was denied to the archive.
Belgede, sunucunun hangi durumda hata döndürdüğü anlatılıyor.|Kılavuz, şablondaki alanların nasıl doldurulacağını açıklıyor.|Die Tabelle nennt, wie oft der Server mit einem Fehler antwortete.|L'article explique pourquoi la page a été retirée.|El informe cuenta cuántos enlaces ya no existen.|В отчёте сказано, сколько ссылок вело на удалённые страницы."""
# Placeholders of public template languages and form letters.
PLACEHOLDERS = """{{ name }}|{{user.first_name}}|{{ page.title | upper }}|{% block content %}|{% if user %}|{%- endfor -%}|${name}|${user.name}|#{title}|#{order.id}|%%FIRSTNAME%%|%%unsubscribe%%|@@TITLE@@|__TODO__|__TODO_NAME__|<%= title %>|<% name %>
[Your Name]|[Your company name here]|[Insert date]|[Enter text here]|[Add description]|[Company name]|[Customer name]|[TITLE HERE]|[Buraya metin]|TBD: description|TBD: owner"""

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*\n(?:.*?\n)??(?: {0,3}\1[`~]*[ \t]*$|\Z)", re.M | re.S)
_TICKS = re.compile(r"(`+)[^`]+?\1(?!`)", re.S)
_QUOTED = re.compile(r"\"[^\"\n]{1,300}\"|“[^”\n]{1,300}”|«[^»\n]{1,300}»|„[^“”\n]{1,300}[“”]|「[^」\n]{1,300}」|『[^』\n]{1,300}』")
# Lines around content: navigation, footers, references.
_AROUND = re.compile(r"^\s*(?:(?:[-*•]\s*)?(?:\[[^\]\n]*\]\([^)\n]*\)\s*(?:[|·•>/»,—-]\s*)?)+|#\d+|(?:ref|request id|ray id|id)\b[ :#].{0,60}|©.*|\(c\) .*|copyright .*|[\w.-]+\.[a-z]{2,8}\s*/\s*\d+|[-=_*]{3,})\s*$", re.I | re.M)
_HEAD = re.compile(r"^#{1,6}[ \t]+(.*)$", re.M)

# A value's place that was never filled. Fixed forms of common template languages.
_PLACEHOLDER = re.compile(
    r"(?=[{$#%@_<\[Tt])(?:\{\{\s*[\w.$-]+(?:\s*\|\s*\w+)*\s*\}\}|\{%-?\s*\w+[^%{}\n]*-?%\}|[$#]\{\s*[\w.$-]+\s*\}|%%[\w.-]+%%|@@[\w.-]+@@|__TODO_?\w*__|<%=?\s*[\w.]+\s*%>"
    r"|\[(?:your|insert|enter|company|buraya|add|type|put|site|customer|client|product)\b[^\]\n]{0,60}\](?![(\[])|\[[A-ZÇĞİÖŞÜ ]{3,} (?:HERE|GELECEK)\](?![(\[])|\bTBD: ?\w+(?: \w+){0,5})",
    re.I,
)
def _hashes(codes: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram that ends at each place from ``ORDER`` - 1 on."""
    h = np.zeros(len(codes) - ORDER + 1, np.uint64)
    for k in range(ORDER):
        h = (h ^ codes[k : len(codes) - ORDER + 1 + k]) * np.uint64(0x100000001B3)
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 18)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


_HOST = re.compile(r"(?<![\w-])(?:https?://)?(?:[\w-]++\.)+[a-z]{2,12}(?:/\S*)?", re.I)
_DOT = re.compile(r"\.[a-z]{2}", re.I)  # no host is without
_WIDE = re.compile("[！-～]")
_DIGIT, _ZEROS = re.compile(r"\d"), re.compile("000+")


def _prepared(text: str) -> str:
    if _DOT.search(text):
        text = _HOST.sub(" ", text)
    if _WIDE.search(text):
        text = unicodedata.normalize("NFKC", text)
    return " ".join(_ZEROS.sub("00", _DIGIT.sub("0", text.casefold())).split())


def _counts(texts: Iterable[str]) -> np.ndarray:
    out, held, n = np.zeros(BUCKETS, np.float64), [], 0
    for t in texts:
        c = _codes("   " + _prepared(t) + "  ")
        if len(c) >= ORDER:
            held.append(_hashes(c))
            n += len(held[-1])
        if n >= BUCKETS:  # many texts at once: each count goes through the whole table
            out += np.bincount(np.concatenate(held), minlength=BUCKETS)
            held, n = [], 0
    return out + np.bincount(np.concatenate(held), minlength=BUCKETS) if held else out


def _split(block: str) -> list[str]:
    return re.split(r"[|\n]", block)


def _ratio(residue: np.ndarray, natural: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio for each bucket of n-grams; those of neither model say nothing.

    Those that no residue has never speak for it: there is far more prose, so that what is
    rare in it would otherwise be less likely than what the smoothing gives residue.
    """
    a = 0.05
    r = np.log((residue + a) / (residue.sum() + a * BUCKETS))
    n = np.log((natural + a) / (natural.sum() + a * BUCKETS))
    score = np.clip(r - n, -4, 4)
    score = np.where(residue == 0, np.minimum(score, 0), score)
    return np.where((residue == 0) & (natural == 0), 0.0, score).astype(np.float32)


@lru_cache(1)
def _public() -> tuple[np.ndarray, np.ndarray]:
    """Counts of n-grams of residue and of prose in the public wording."""
    return _counts(_split(NOTICES + "\n" + FILLER)) * 4, _counts(_split(PROSE)) * 4


def fit(prose: list[str] | np.ndarray, residue: np.ndarray | None = None) -> np.ndarray:
    """The log-likelihood ratio of residue against prose: public wording, texts of prose (or their counts), and counts of residue."""
    known, natural = _public()
    own = prose if isinstance(prose, np.ndarray) else _counts(prose)
    return _ratio(known if residue is None else known + residue, natural + own)


@lru_cache(1)
def _filler_model() -> np.ndarray:
    """As :func:`fit` for public filler alone, against notices and prose."""
    return _ratio(_counts(_split(FILLER)) * 4, _counts(_split(NOTICES + "\n" + PROSE)))


def _shape(text: str) -> str:
    return re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+", "a", text))


@lru_cache(1)
def _placeholder_model() -> np.ndarray:
    """As :func:`fit` on the shapes of placeholders against those of Markdown and prose."""
    prose = _split(PROSE) + ["[text](https://a.example/b) and [1], [note] (see x)", "50% of 3, a_b_c, $5, #3, @name, <b>, **bold** {x}", "| a | b |", "a: b, c"]
    return _ratio(_counts(map(_shape, _split(PLACEHOLDERS.replace(" | upper", "")))) * 4, _counts(map(_shape, prose)))


def _content(text: str) -> tuple[str, str]:
    """What is left of ``text`` without code, quotations, navigation and footers, and the same with quotations."""
    bare = text
    if "`" in bare or "~~~" in bare:
        bare = _TICKS.sub(" ", _FENCE.sub(" ", bare))
    bare = _AROUND.sub("", bare)
    return _QUOTED.sub(" ", bare), bare


def _sums(score: np.ndarray) -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(score, dtype=np.float64)))


def _windows(plain: str, model: np.ndarray) -> tuple[int, int]:
    """How many places of ``plain`` lie in residue windows, and of how many."""
    c = _codes("  " + plain + "  ")
    if len(c) < ORDER:
        return 0, 0
    sums = _sums(model[_hashes(c)])
    n = len(sums) - 1
    w = min(WINDOW, n)
    at = np.flatnonzero((sums[w:] - sums[:-w]) / w > RATIO)
    if not len(at):
        return 0, n
    hit = np.zeros(n + 1, np.int64)
    hit[at] += 1
    hit[at + w] -= 1
    return int((np.cumsum(hit[:-1]) > 0).sum()), n


def _apart(lines: list[str], model: np.ndarray, filler: np.ndarray) -> tuple[int, int]:
    """As :func:`_windows` summed over ``lines``, where those that open with a window of filler count whole."""
    size = np.array([len(x) + 4 for x in lines])
    start, n = np.cumsum(size) - size, size - (ORDER - 1)
    w = np.minimum(WINDOW, n)
    h = _hashes(_codes("".join(f"  {x}  " for x in lines)))
    sums, known = _sums(model[h]), _sums(filler[h])
    line = np.repeat(np.arange(len(lines)), size)[: len(h)]
    at = np.arange(len(h))
    at = at[at - start[line] <= (n - w)[line]]  # windows that end in their line
    wide = w[line[at]]
    yes = (sums[at + wide] - sums[at]) / wide > RATIO
    hit = np.zeros(len(h) + 1, np.int64)
    hit[at[yes]] += 1
    hit[(at + wide)[yes]] -= 1
    inside = np.add.reduceat(np.cumsum(hit[:-1]) > 0, start, dtype=np.int64)
    return int(np.where((known[start + w] - known[start]) / w > RATIO, n, inside).sum()), int(n.sum())


def coverage(text: str, model: np.ndarray) -> float:
    """The part of the content of ``text`` that lies in residue windows.

    Where that is some but not enough, paragraphs are judged apart: one that opens with
    a window of filler is filler to its end, whatever made-up words follow.
    """
    return _covered(_content(text)[1], model)


def _covered(bare: str, model: np.ndarray) -> float:
    heads = _HEAD.findall(bare)
    body = _HEAD.sub("", bare)
    use = body if body.strip() else "\n".join(heads)
    r, n = _windows(_prepared(use).strip(), model)
    if not r or r >= COVERAGE * n:
        return r / n if r else 0.0
    lines = [x for x in map(_prepared, use.split("\n")) if x]
    inside, whole = _apart(lines, model, _filler_model()) if lines else (0, 1)
    return max(r / n, inside / whole)


def has_placeholder(text: str) -> bool:
    """Whether a placeholder stands unfilled outside code and quotations: found by its form, judged by the model of shapes."""
    return _unfilled(_content(text)[0])


def _unfilled(plain: str) -> bool:
    model = _placeholder_model()
    for m in _PLACEHOLDER.finditer(plain):
        c = _codes("   " + _prepared(_shape(m.group())) + "  ")
        if len(c) >= ORDER and model[_hashes(c)].mean() > 0:
            return True
    return False


def is_residue(text: str, model: np.ndarray) -> bool:
    plain, bare = _content(text)
    return _covered(bare, model) >= COVERAGE or _unfilled(plain)


def _gather(pages: DataFrame, learn) -> np.ndarray:
    """Counts of n-grams in the texts of ``pages`` that ``learn`` puts into kind 0 and into kind 1, counted where these are.

    ``learn`` takes a text and what :func:`_content` leaves of it with quotations.
    """

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, BUCKETS))
        for pdf in parts:
            found = [[], []]
            for t in pdf["markdown"]:
                bare = _content(t)[1]
                kind = learn(t, bare)
                if kind is not None:
                    found[kind].append(bare)
            for kind in (0, 1):
                total[kind] += _counts(found[kind])
        for kind in (0, 1):
            at = np.flatnonzero(total[kind])
            yield pd.DataFrame({"kind": kind, "at": at, "n": total[kind][at].astype(np.int64)})

    out = np.zeros((2, BUCKETS))
    got = pages.select("markdown").mapInPandas(count, "kind int, at int, n bigint").groupBy("kind", "at").agg(F.sum("n").alias("n")).toArrow()  # at most 2 * BUCKETS rows
    out[got["kind"].to_numpy(), got["at"].to_numpy()] = got["n"].to_numpy()
    return out


def fitted(pages: DataFrame) -> np.ndarray:
    """The models fitted on all records of ``pages``, the same for the same records in any order and partitions."""
    real = pages.where("ok and trim(markdown) <> ''")
    long = _gather(real, lambda t, _: 1 if len(t) > LONG else None)[1]
    shared = pages.sparkSession.sparkContext.broadcast(fit(long))

    def learn(t: str, bare: str) -> int | None:
        c = _covered(bare, shared.value)
        return 0 if c >= SURE else 1 if c <= NONE and len(t) > LONG else None

    residue, prose = _gather(real, learn)
    return fit(prose, residue)


def with_residue(pages: DataFrame, model: np.ndarray | None = None, out: str = "artik") -> DataFrame:
    """``pages`` (with ``kayit_no``, ``ok``, ``markdown``) with ``out`` true where there is residue in place of content.

    The model is fitted on ``pages`` if none is given.
    """
    if model is None:
        model = fitted(pages)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for s in parts:
            yield s.map(lambda t: None if t is None else bool(t.strip()) and is_residue(t, m)).astype("boolean")

    return pages.withColumn(out, F.coalesce(judged("markdown"), F.lit(False)))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "onbellek", "kayit_no", "ok", "markdown").where("ok")
    return with_residue(pages).where("artik").select("kayit_no").distinct()


def p5_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that are left: marked ok, with content and without residue."""
    pages = table(spark, sf_dir, "onbellek", "kayit_no", "ok", "host", "markdown").where("ok and trim(markdown) <> ''")
    return with_residue(pages).where("not artik").select("kayit_no", "host", F.length("markdown").alias("uzunluk")).distinct()
