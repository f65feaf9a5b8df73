"""Streamed model replies, put together from their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.text import cleaned, let, without_think

# Finish reasons by which a reply was cut off or held back, by service.
LENGTH = {"openai": ("length", "max_tokens", "max_output_tokens"), "anthropic": ("max_tokens", "model_context_window_exceeded"), "gemini": ("MAX_TOKENS", "MODEL_LENGTH")}
FILTER = {"openai": ("content_filter",), "anthropic": ("refusal",), "gemini": ("SAFETY", "BLOCKLIST", "PROHIBITED_CONTENT", "SPII")}
# Where services put reasoning, text and whole messages; whole ones count only while no text has come.
REASONING = tuple(f"$.choices[0].delta.{n}" for n in ("reasoning_content", "reasoning", "thought", "thinking", "thinking_content", "reasoning_text"))
WHOLE_REASONING = ("$.choices[0].message.reasoning_content", "$.choices[0].message.reasoning", "$.choices[0].message.thought", "$.reasoning_content", "$.reasoning", "$.thought")
DELTA = ("$.choices[0].delta.content", "$.choices[0].delta.text")
WHOLE = ("$.choices[0].message.content", "$.choices[0].text", "$.content", "$.text")
MOST_OPEN = 64 * 1024  # characters of a JSON value that hasn't ended


def payloads(lines: DataFrame) -> DataFrame:
    """request_id, provider, seq, at, event (a JSON text): lines without their prefix, put together until they are JSON."""
    return replies_apart(lines).where("event is not null").drop("ended")


def replies_apart(lines: DataFrame) -> DataFrame:
    """request_id, provider, ended (an end mark came), seq, at, event for each event of each reply, and one row without an event for
    a reply that has none. A reply's lines are brought together once, and what follows finds them there.

    Blank lines, comments and control lines go; a value over several lines must begin with a brace or bracket; one that has
    not ended within MOST_OPEN characters is dropped; the values of an array are events of their own.
    """
    line = F.trim("line")
    data = F.trim(F.regexp_replace(line, r"^data:", ""))
    told = (line != "") & ~line.rlike(r"^(?::|event:|retry:|(?:data:\s*)?\[DONE\]$)")
    mark = F.coalesce(line.rlike(r"^(?:(?:data:\s*)?\[DONE\]$|event: message_stop)"), F.lit(False))
    ordered = lines.groupBy("request_id").agg(F.max("provider").alias("provider"), F.bool_or(mark).alias("ended"), F.array_sort(F.collect_list(F.when(told, F.struct("seq", data.alias("data"))))).alias("rows"))  # one reply's lines

    def step(state: Column, row: Column) -> Column:
        joined = F.when(state["open"] != "", F.concat(state["open"], F.lit("\n"), row["data"])).when(row["data"].rlike(r"^[{\[]"), row["data"]).otherwise("")
        whole = lambda text: F.try_parse_json(text).isNotNull() & (text != "")
        return let(joined, lambda text: F.struct(
            F.when(whole(text) | (F.length(text) > MOST_OPEN), "").otherwise(text).alias("open"),
            F.when(whole(text), F.concat(state["out"], F.array(F.struct(row["seq"].alias("seq"), text.alias("json"))))).otherwise(state["out"]).alias("out"),
        ))

    begin = F.struct(F.lit("").alias("open"), F.array().cast("array<struct<seq:bigint,json:string>>").alias("out"))
    values = ordered.select("request_id", "provider", "ended", F.explode_outer(F.aggregate("rows", begin, step)["out"]).alias("v"))
    return split_arrays(values.select("request_id", "provider", "ended", "v.seq", "v.json"))


def split_arrays(values: DataFrame) -> DataFrame:
    """values(request_id, provider, ended, seq, json) -> the events in them: the values of an array are events of their own."""
    parsed = values.withColumn("v", F.try_parse_json("json"))
    kind = F.schema_of_variant("v")
    each = F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    return parsed.select("request_id", "provider", "ended", "seq", F.posexplode_outer(each).alias("at", "event"))


def told(event: Column, path: str) -> Column:
    """The text at a place: a string, the strings and text or content fields of an array, or such a field of an object; null
    if there is none."""
    def text(v: Column) -> Column:
        field = lambda n: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")) == "STRING", F.try_variant_get(v, f"$.{n}", "string"))
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.coalesce(field("text"), field("content")))

    v = F.try_variant_get(event, path, "variant")
    items = F.transform(F.try_variant_get(event, path, "array<variant>"), lambda x: F.coalesce(text(x), F.lit("")))
    out = F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.array_join(items, "")).otherwise(text(v))
    return F.when(out != "", out)


def deltas(lines: DataFrame) -> DataFrame:
    return told_by(payloads(lines))


def told_by(events: DataFrame) -> DataFrame:
    """A row for each event: what text it adds, and what it says about usage, end and failure."""
    e = F.col("event")
    string = lambda path: F.try_variant_get(e, path, "string")
    number = lambda *paths: F.coalesce(*[F.try_variant_get(e, p, "bigint") for p in paths])
    openai, anthropic, gemini = (F.col("provider") == p for p in ("openai", "anthropic", "gemini"))
    parts = F.array_join(F.transform(F.try_variant_get(e, "$.candidates[0].content.parts", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), "")
    reason = F.when(openai, string("$.choices[0].finish_reason")).when(anthropic, F.coalesce(string("$.delta.stop_reason"), string("$.stop_reason"))).otherwise(string("$.candidates[0].finishReason"))
    no_choices = F.try_variant_get(e, "$.choices", "variant").isNull()
    plain = lambda path: F.when(F.schema_of_variant(F.try_variant_get(e, path, "variant")) == "STRING", string(path))
    failure = F.coalesce(plain("$.error.message"), plain("$.error_msg"), plain("$.err_msg"), F.when(no_choices & F.try_variant_get(e, "$.code", "variant").isNotNull(), plain("$.message")), F.when(no_choices, plain("$.error")))
    rows = events.select(
        "request_id", "provider", "seq", "at", F.when(openai, F.coalesce(*[told(e, p) for p in DELTA])).when(anthropic, string("$.delta.text")).otherwise(F.when(parts != "", parts)).alias("delta"),
        F.when(openai, F.coalesce(*[told(e, p) for p in WHOLE])).alias("whole"), F.when(openai, string("$.choices[0].delta.refusal")).alias("declined"),
        F.when(openai, F.coalesce(*[told(e, p) for p in REASONING])).when(anthropic, plain("$.delta.thinking")).alias("thought"), F.when(openai, F.coalesce(*[told(e, p) for p in WHOLE_REASONING])).alias("whole_thought"), reason.alias("reason"),
        F.contains(F.coalesce(F.when(anthropic, string("$.delta.type")), F.lit("")), F.lit("refusal")).alias("refusing"), F.when(F.trim(failure) != "", failure).alias("failure"),
        number("$.usage.prompt_tokens", "$.message.usage.input_tokens", "$.usageMetadata.promptTokenCount").alias("input"),
        number("$.usage.completion_tokens", "$.usage.output_tokens", "$.usageMetadata.candidatesTokenCount").alias("output"), number("$.usage.total_tokens", "$.usageMetadata.totalTokenCount").alias("total"), *[c for c in ("ended",) if c in events.columns],
    )
    before = Window.partitionBy("request_id").orderBy("seq", "at").rowsBetween(Window.unboundedPreceding, -1)
    # a whole message counts while nothing has come: no delta and no whole message before it
    came = F.coalesce(F.max(F.coalesce("delta", "whole", "declined").isNotNull()).over(before), F.lit(False))
    piece = F.concat(F.coalesce(F.col("delta"), F.when(~came, F.col("whole")), F.lit("")), F.coalesce("declined", F.lit("")))
    return rows.withColumn("piece", piece).withColumn("order", F.struct("seq", "at"))


def usage(lines: DataFrame) -> DataFrame:
    """request_id, input_tokens, output_tokens, total_tokens: the last that were told; the total is their sum where none is."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("order")))
    sums = deltas(lines).groupBy("request_id").agg(last("input").alias("input_tokens"), last("output").alias("output_tokens"), last("total").alias("total"))
    return sums.select("request_id", "input_tokens", "output_tokens", F.coalesce("total", F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))


def by_provider(values: dict[str, tuple]) -> Column:
    out = F.lit(False)
    for name, reasons in values.items():
        out = out | ((F.col("provider") == name) & F.col("reason").isin(*reasons))
    return out


def reassembled(lines: DataFrame) -> DataFrame:
    """request_id, text, caption, structured, outcome: pieces in order, and how the reply ended.

    The first that holds: failed (the service reports an error), reasoning_only, length, cut (no end mark after some text),
    refused (by the service), empty, ok.
    """
    return put_together(replies_apart(lines))


def put_together(events: DataFrame) -> DataFrame:
    """The same from events(request_id, provider, ended, seq, at, event)."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("order", "piece"))), lambda x: x["piece"])  # one reply's pieces
    held = F.when(by_provider(FILTER), F.col("reason")).when(F.col("refusing"), "refusal_delta").otherwise(F.col("declined"))
    sums = told_by(events).withColumn("held", held).groupBy("request_id").agg(
        F.max("provider").alias("provider"), F.bool_or("ended").alias("ended"), F.array_join(texts, "").alias("text"), F.max_by("held", F.when(F.col("held").isNotNull(), F.col("order"))).alias("structured"), F.max(F.coalesce("thought", "whole_thought")).alias("thought"),
        F.bool_or(by_provider(LENGTH)).alias("length"), F.min_by("failure", F.when(F.col("failure").isNotNull(), F.col("order"))).alias("failure"),
    )
    whole = sums.withColumn("text", F.coalesce("text", F.lit("")))
    no_answer = (without_think(F.col("text")) == "") & (F.col("thought").isNotNull() | F.col("text").contains("<think>") | F.col("text").contains("<thought>"))
    outcome = (
        F.when(F.col("failure").isNotNull(), "failed").when(no_answer, "reasoning_only").when(F.col("length"), "length")
        .when(~F.col("ended") & (F.col("text") != "") & (F.col("provider") != "gemini"), "cut").when(F.col("structured").isNotNull(), "refused").when(F.col("text") == "", "empty").otherwise("ok")
    )
    return whole.select("request_id", "text", cleaned(F.col("text")).alias("caption"), "structured", outcome.alias("outcome"))


def first_tokens(chunks: DataFrame) -> DataFrame:
    """chunks(request_id, ts, adds, tokens): ttft_s from the first chunk to the first that adds text, and tokens a second from
    there to the last chunk (null without any, or in no time)."""
    first = F.min(F.when(F.col("adds"), F.col("ts")))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    sums = chunks.groupBy("request_id").agg(F.min("ts").alias("start"), first.alias("first_token"), F.max("ts").alias("end"), F.max("tokens").alias("tokens"))
    took = seconds(F.col("end")) - seconds(F.col("first_token"))
    return sums.select("request_id", "first_token", F.round(seconds(F.col("first_token")) - seconds(F.col("start")), 3).alias("ttft_s"), F.round(F.when(took > 0, F.col("tokens") / took), 4).alias("tokens_per_second"))


def able_models(models: DataFrame, gemini: bool = True) -> DataFrame:
    """models(at, raw_id, raw_name, display_name, displayName, methods): id, name of those that can generate; of equal ids the first.

    An entry without a list of methods can; ids lose their prefix; the name is the first one given, else the id.
    """
    able = F.col("methods").isNull() | F.exists("methods", lambda m: F.lower(m) == "generatecontent")
    id_ = F.regexp_replace(F.coalesce("raw_id", "raw_name"), "^models/", "")
    rows = (models.where(able) if gemini else models).select("at", id_.alias("id"), F.coalesce("display_name", "displayName", id_).alias("name")).where("id is not null")
    return rows.groupBy("id").agg(F.min_by("name", "at").alias("name"))
