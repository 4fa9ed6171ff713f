"""Logs of agents in three dialects, folded into answers, tools and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SCHEMA = (
    "type string, subtype string, result string, error string, item struct<id:string,type:string,text:string>, message struct<content:array<struct<type:string,text:string,name:string>>>, "
    "part struct<text:string,tool:string,reason:string,tokens:struct<input:bigint,output:bigint,reasoning:bigint,cache:struct<read:bigint>>>, "
    "usage struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cached_input_tokens:bigint,reasoning_output_tokens:bigint>"
)


def events(lines: DataFrame, text: str = "satir") -> DataFrame:
    """Lines parsed as events; anything that is no JSON object is dropped."""
    return lines.withColumn("e", F.from_json(text, _SCHEMA)).where(F.ltrim(text).startswith("{") & F.col("e.type").isNotNull())


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def fold_steps(lines: DataFrame, key: list[str], order: str = "no") -> DataFrame:
    """The step dialect (A12): steps are counted by their starts; the answer is the text of the last step that ended with ``stop``."""
    w = Window.partitionBy(*key).orderBy(order)
    ev = events(lines).withColumn("adim", F.sum((F.col("e.type") == "step_start").cast("int")).over(w))
    t = F.col("e.part.tokens")
    kind = F.col("e.type")
    steps = ev.groupBy(*key, "adim").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when((kind == "text") & (F.col("e.part.text") != ""), F.struct(F.col(order).alias("o"), F.col("e.part.text").alias("t"))))), lambda x: x["t"]), "\n").alias("metin"),
        F.max_by("e.part.reason", F.when(kind == "step_finish", F.col(order))).alias("neden"), F.count_if(kind == "tool_use").alias("arac"), F.count_if(kind == "error").alias("hata"),
        _sum(F.when(kind == "step_finish", t["input"])).alias("taze"), _sum(F.when(kind == "step_finish", t["cache"]["read"])).alias("onbellek"), _sum(F.when(kind == "step_finish", t["output"])).alias("cikti"), _sum(F.when(kind == "step_finish", t["reasoning"])).alias("akil"),
    )
    ended = (F.col("neden") == "stop") & (F.col("metin") != "")
    return steps.groupBy(*key).agg(
        F.coalesce(F.trim(F.max_by(F.when(ended, F.col("metin")), F.when(ended, F.col("adim")))), F.lit("")).alias("metin"), F.bool_or(ended).alias("tamam"), F.max("adim").alias("adim"),
        *(F.sum(c).alias(c) for c in ("arac", "hata", "taze", "onbellek", "cikti", "akil")),
    )


def tool_counts(lines: DataFrame, key: list[str]) -> DataFrame:
    """How often each tool was called."""
    return events(lines).where("e.type = 'tool_use'").groupBy(*key, F.coalesce("e.part.tool", F.lit("?")).alias("arac")).agg(F.count("*").alias("n"))


def fold_results(lines: DataFrame, key: list[str], order: str = "no") -> DataFrame:
    """The result dialect (A12): the last ``result`` line wins."""
    ev = events(lines)
    last = F.when(F.col("e.type") == "result", F.col(order))
    u = F.max_by("e.usage", last)
    calls = F.sum(F.size(F.filter("e.message.content", lambda c: c["type"] == "tool_use")))
    return ev.groupBy(*key).agg(F.coalesce(F.max_by("e.result", last), F.lit("")).alias("metin"), F.coalesce(F.max_by("e.subtype", last) == "success", F.lit(False)).alias("tamam"), F.coalesce(calls, F.lit(0)).alias("arac"), F.coalesce(u["input_tokens"], F.lit(0)).alias("taze"), F.coalesce(u["cache_read_input_tokens"], F.lit(0)).alias("onbellek"), F.coalesce(u["output_tokens"], F.lit(0)).alias("cikti"))


def fold_items(lines: DataFrame, key: list[str], order: str = "no") -> DataFrame:
    """The item dialect (A12): the last message is the answer, items repeated by id count once, turns add up their tokens."""
    ev = events(lines)
    items = ev.where("e.type = 'item.completed'")
    once = items.groupBy(*key, F.coalesce("e.item.id", F.col(order).cast("string")).alias("id")).agg(F.max_by("e.item", order).alias("item"), F.max(order).alias("o"))
    message = F.col("item.type").isin("agent_message", "message")
    answer = once.groupBy(*key).agg(F.max_by(F.when(message, F.col("item.text")), F.when(message, F.col("o"))).alias("metin"), F.count_if(~message).alias("arac"))
    turns = ev.groupBy(*key).agg(F.count_if(F.col("e.type") == "turn.failed").alias("hata"), _sum(F.when(F.col("e.type") == "turn.completed", F.col("e.usage.input_tokens"))).alias("taze"), _sum(F.when(F.col("e.type") == "turn.completed", F.col("e.usage.output_tokens"))).alias("cikti"))
    return turns.join(answer, key, "left").select(*key, F.coalesce("metin", F.lit("")).alias("metin"), (F.col("hata") == 0).alias("tamam"), F.coalesce("arac", F.lit(0)).alias("arac"), "taze", "cikti")


def attempts(rows: DataFrame, key: list[str]) -> DataFrame:
    """Attempts added up (A13); the cost is null until one reports it."""
    return rows.groupBy(*key).agg(F.count("*").alias("deneme"), F.sum("taze").alias("taze"), F.sum("cikti").alias("cikti"), F.sum("maliyet").alias("maliyet"))


def response_text(body: Column) -> Column:
    """Message texts and number of searches of one response document."""
    doc = F.from_json(body, "output array<struct<type:string,content:array<struct<type:string,text:string>>>>")
    texts = F.flatten(F.transform(F.filter(doc["output"], lambda o: o["type"] == "message"), lambda o: F.transform(o["content"], lambda c: c["text"])))
    return F.struct(F.array_join(texts, "\n").alias("metin"), F.size(F.filter(doc["output"], lambda o: o["type"] == "web_search_call")).alias("arama"))


def step_metrics(ev: DataFrame, key: str, order: list[str], start: Column) -> DataFrame:
    """Steps by explicit start marks in any event table: events and value of each step."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = ev.withColumn("adim", F.sum(start.cast("int")).over(w))
    return rows.groupBy(key, "adim").agg(F.count("*").alias("olay"), F.round(F.sum("value"), 2).alias("deger"))
