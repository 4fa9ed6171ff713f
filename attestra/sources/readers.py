"""Notes, plans, page caches and logs as DataFrames (S01 to S04, S14), and a page source to plug in."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vault import passages, upsert
from ..runtime import lazy_udf

PLAN = "slug string, konu string, amac string, sorular array<string>, kaynaklar string, kisitlar string, single_publisher_host string, min_url int, min_url_required int, olgular array<struct<ad:string,ara:string>>"
CACHE = "istenen_url string, url string, ok boolean, baslik string, markdown string, yontem string, durum int, hata string, ham_bayt bigint, fetched_at double, _corrupt_record string"
EXCLUDED = "DISLANAN.md"


class PageSource(Protocol):
    """Where pages come from; the engine itself never fetches."""

    def pages(self, spark: SparkSession, urls: DataFrame) -> DataFrame: ...


class TablePages:
    """Pages from a table of earlier fetches."""

    def __init__(self, table: DataFrame):
        self.table = table

    def pages(self, spark: SparkSession, urls: DataFrame) -> DataFrame:
        return self.table.join(urls.select(F.col("url").alias("istenen_url")).distinct(), "istenen_url", "left_semi")


def notes(spark: SparkSession, folder: str, run_id: str = "", files: list[str] | None = None) -> DataFrame:
    """Markdown notes of a folder (S01): ``run_id``, ``slug``, ``dosya``, ``metin``, ``mtime``; the list of excluded findings is no note."""
    name = F.col("_metadata.file_name")
    rows = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(F.lit(run_id).alias("run_id"), F.regexp_replace(name, r"\.md$", "").alias("slug"), name.alias("dosya"), F.col("value").alias("metin"), F.col("_metadata.file_modification_time").alias("mtime"))
    rows = rows.where(F.col("dosya") != EXCLUDED)
    return rows.where(F.col("dosya").isin(files)) if files is not None else rows


def plan(spark: SparkSession, path: str) -> DataFrame:
    """A plan's topics (S02); what is no object is dropped."""
    items = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("t"))
    return items.select(F.from_json("t", PLAN).alias("p")).select("p.*").where("slug is not null")


def page_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Cached pages (S03): readable records with an address; corrupt files are skipped, bad times count as 0."""
    rows = spark.read.schema(CACHE).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    rows = rows.where("_corrupt_record is null and ok and trim(coalesce(markdown, '')) <> ''").withColumn("istenen_url", F.coalesce("istenen_url", "url"))
    return rows.where("trim(coalesce(istenen_url, '')) <> ''").withColumn("fetched_at", F.coalesce("fetched_at", F.lit(0.0))).withColumn("kayit_no", F.md5(F.concat_ws("|", "istenen_url", F.col("fetched_at").cast("string")))).drop("_corrupt_record", "url")


def log_lines(spark: SparkSession, path: str, key: str = "dosya") -> DataFrame:
    """Lines of agent logs with their order in each file."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias(key), F.posexplode(F.split("value", "\n")).alias("no", "satir"))
    return rows


_POINTER = "CURRENT"


def _files(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made


def _current(spark: SparkSession, path: str) -> str | None:
    """The folder that the vault's pointer names; None if there is no vault. Old pointers of the same commit are ignored."""
    fs, root = _files(spark, path)
    if not fs.exists(root):
        return None
    named = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith(_POINTER))
    return f"{path}/v{named[-1].split('-')[1]}" if named else None


def vault(spark: SparkSession, path: str, create: bool = False) -> DataFrame | None:
    """The vault's page table (S11): the version that its pointer names; an error if it is absent and not to be created."""
    at = _current(spark, path)
    if at:
        return spark.read.parquet(at)
    if create:
        return None
    raise FileNotFoundError(path)


def vault_passages(pages: DataFrame) -> DataFrame:
    """The passages of the vault's pages (P12): ``url``, ``sira``, ``metin``."""
    return pages.select("url", F.posexplode(passages(F.col("metin"))).alias("sira", "metin"))


def vault_merge(spark: SparkSession, path: str, records: DataFrame, keep: int = 2) -> DataFrame:
    """New records merged into the vault at ``path``.

    A new version is written beside those that exist and counts from the moment its
    pointer, an empty file, is created, which happens in one step and last. A job that
    ends anywhere before leaves the earlier version in force, and what it wrote is
    overwritten by the next one. ``keep`` versions stay for readers that are at work.
    """
    old = _current(spark, path)
    number = int(old.rsplit("/v", 1)[1]) + 1 if old else 1
    upsert(records, vault(spark, path, create=True), "markdown").write.mode("overwrite").parquet(f"{path}/v{number:012d}")
    fs, pointer = _files(spark, f"{path}/{_POINTER}-{number:012d}")
    if not fs.createNewFile(pointer):
        raise RuntimeError(f"another job has made version {number} of {path}")
    for gone in range(max(1, number - keep - 3), number - keep + 1):
        for name in (f"{_POINTER}-{gone:012d}", f"v{gone:012d}"):
            fs, at = _files(spark, f"{path}/{name}")
            fs.delete(at, True)
    return spark.read.parquet(f"{path}/v{number:012d}")


def charset(header: str | None, body: bytes) -> str:
    """A page's text by the header's charset, the page's own in its first 4,096 bytes, or UTF-8."""
    named = re.search(r"charset=[\"']?([\w.:-]+)", header or "", re.I)
    meta = re.search(rb"<meta[^>]+charset=[\"']?([\w.:-]+)", body[:4096], re.I)
    for name in (named.group(1) if named else None, meta.group(1).decode("ascii", "ignore") if meta else None, "utf-8"):
        if name:
            try:
                return body.decode(name, "replace")
            except LookupError:
                continue
    return body.decode("utf-8", "replace")


@lazy_udf("string")
def decoded(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Bodies decoded by their headers, as columns (S10): null bodies give null."""
    for headers, bodies in parts:
        yield pd.Series([None if b is None else charset(h, bytes(b)) for h, b in zip(headers, bodies)], dtype=object)


def llms_text(status: Column, kind: Column, body: Column) -> Column:
    """The text a site offers to readers of this kind, or null (S09): answered with 200, as plain text or Markdown, and not empty."""
    return F.when((status == 200) & F.lower(kind).rlike(r"^text/(?:plain|markdown|x-markdown)\b") & (F.trim(body) != ""), body)


# Owners of a code host's pages that are no users.
RESERVED_OWNERS = "about apps blog collections contact customer-stories enterprise explore features issues join login marketplace new notifications orgs pricing pulls search security settings signup site sponsors stars topics trending".split()


def repository(url: Column) -> Column:
    """``owner/name`` of a repository's address (S13); null for other pages."""
    owner = F.regexp_extract(url, r"(?i)^https?://(?:www\.)?github\.com/([A-Za-z0-9-]+)/([A-Za-z0-9._-]+)", 1)
    name = F.regexp_replace(F.regexp_extract(url, r"(?i)^https?://(?:www\.)?github\.com/([A-Za-z0-9-]+)/([A-Za-z0-9._-]+)", 2), r"\.git$", "")
    return F.when((owner != "") & (name != "") & ~F.lower(owner).isin(*RESERVED_OWNERS), F.concat(owner, F.lit("/"), name))


def repository_status(status: Column, archived: Column, pushed_at: Column, today: Column) -> Column:
    """What a repository's answer says (S13): missing, archived, stale after a year without a push, error, or ok."""
    return F.when(status == 404, "missing").when(~F.coalesce(status == 200, F.lit(False)), "error").when(archived, "archived").when(F.datediff(today, pushed_at) > 365, "stale").otherwise("ok")
