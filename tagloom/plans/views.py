"""The same derivations twice: as DataFrames and as SQL common table expressions for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATUSES = ("pending", "queued", "running", "succeeded", "revised", "skipped", "refused", "failed", "cancelled")
OUTCOMES = {"purchase": "succeeded", "signup": "revised", "view": "skipped", "click": "refused", "error": "failed"}


# Replies that are refusals and some that only look like them.
DECLINED = (
    "I am unable to help with this.", "Hi I can go on", "I must decline this request.", "I must go on", "我必须拒绝。", "我必须说明。", "不便提供更多。", "不便多说。", "Ｉ　ｃａｎｎｏｔ　ｈｅｌｐ you.",
    "I'm sorry, that is beyond what I'm able to do: unable.", "I'm sorry, here it is.", "很遗憾，这不可以。", "NO WAY (really).", "No way, really.", "Before all else, and after some more words: i can't comply.",
)


class Views:
    """Lazy frames over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def captions(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("item_id"), F.concat(F.lit("d/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("caption_path"), F.col("text").alias("caption"))

    def jobs(self) -> DataFrame:
        labels = self.table("labels").select(F.col("doc_id").alias("item_id"), "quality", "toxic")
        status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("item_id") % 9 + 1).cast("int"))
        return self.captions().join(labels, "item_id", "left").select(
            "item_id", "caption_path", "caption", status.alias("status"),
            F.coalesce(F.col("quality") == 1, F.lit(False)).alias("reviewed"),
            (F.coalesce("quality", F.lit(0)) + F.coalesce("toxic", F.lit(0))).cast("long").alias("revision_count"),
            F.concat(F.lit("img"), (F.col("item_id") % 50).cast("string"), F.lit("_"), F.col("item_id").cast("string"), F.lit(".png")).alias("file_name"),
            F.when(F.col("item_id") % 9 == 7, F.concat(F.lit("error "), (F.col("item_id") % 4).cast("string"))).alias("error"),
        )

    def requests(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        status = F.lit(None).cast("string")
        for kind, outcome in OUTCOMES.items():
            status = F.when(F.col("event_type") == kind, outcome).otherwise(status)
        return self.table("events").select(
            F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.date_format("ts", "yyyy-MM-dd").alias("batch_id"), F.col("event_type").alias("kind"), status.alias("status"),
            F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("k"), (F.col("user_id") % 10).cast("string"))).alias("key_id"),
            F.concat(F.lit("m"), (k % 5).cast("string")).alias("model_id"), F.when(k % 7 != 6, F.concat(F.lit("p"), (k % 7).cast("string"))).alias("preset_id"),
            F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("connection_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("item"),
            k.alias("input_tokens"), F.floor(F.abs("value")).cast("long").alias("output_tokens"), F.when(k % 7 != 0, F.col("value") * 10).alias("ttft_ms"), (F.col("value") + 1).alias("tokens_per_second"),
        )

    def attempts(self) -> DataFrame:
        """Requests of one user and day are the attempts for one item."""
        order = Window.partitionBy("item", "batch_id").orderBy("created_at", "id")
        event, number, user = F.col("kind"), F.col("id"), F.substring("item", 2, 20).cast("long")
        pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
        dressed = self.requests().select(
            "*", pick(user % 3, "caption", "revision", "ai_sample").alias("job_kind"),
            F.when(event == "error", pick(number % 9, "transient", "rate_limit", "auth", "length", "cut", "cancelled", "fatal", "quota", "prompt_rejected")).alias("error"),
            (event == "click").alias("refused"), ((event == "click") & (number % 2 == 0)).alias("structured"),
            F.when((event == "view") & (number % 5 == 0), "  ").when(user % 3 == 2, pick(number % 3, "DECISION: KEEP", "reject", "MAYBE")).when(event == "signup", "short").otherwise("a caption that is long enough").alias("text"),
            F.when(number % 2 == 0, "the original caption, rather long").otherwise("").alias("original"), (number % 4 == 0).alias("review_ok"),
            F.when((event == "purchase") & (number % 6 == 0), "write_conflict").when((event == "purchase") & (number % 6 == 3), "write_error").alias("write_error"),
        )
        return dressed.withColumn("attempt", F.row_number().over(order).cast("long") - 1)

    def versions(self) -> DataFrame:
        order = Window.partitionBy("conv_id").orderBy("turn")
        return self.table("conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("c/"), F.col("conv_id").cast("string")).alias("caption_path"), F.coalesce(F.lag("text").over(order), F.lit("")).alias("old_content"),
            F.col("text").alias("new_content"), F.when(F.col("role") == "user", "manual").otherwise("model").alias("source"), F.concat(F.lit("b"), (F.col("turn") % 3).cast("string")).alias("batch_id"),
        )

    def responses(self) -> DataFrame:
        """Model output with reasoning, fences and refusals put in by number."""
        v = self.versions()
        text = F.col("new_content")
        dressed = (
            F.when(F.col("id") % 5 == 0, F.concat(F.lit("<think>plan, it</think>"), text)).when(F.col("id") % 5 == 1, F.concat(F.lit("```text\n"), text, F.lit("\n```")))
            .when(F.col("id") % 5 == 2, F.concat(F.lit('"'), text, F.lit('"'))).when(F.col("id") % 5 == 3, F.concat(F.element_at(F.array(*map(F.lit, DECLINED)), (F.floor(F.col("id") / 5) % len(DECLINED) + 1).cast("int")), F.lit(" "), F.substring(text, 1, 20))).otherwise(text)
        )
        return v.select("id", F.col("old_content").alias("original"), dressed.alias("reply"), F.when(F.col("id") % 17 == 0, "content_filter").alias("structured"))

    def decisions(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").alias("item_id"), (F.col("doc_id") % 3).alias("round"), (F.col("n_chars") % 2 == 0).alias("keep"),
            F.when(F.col("doc_id") % 11 != 0, F.col("n_chars") % 101).alias("score"), F.col("source").alias("reason"), F.concat(F.lit("img"), (F.col("doc_id") % 50).cast("string"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".png")).alias("file_name"),
        )


_LIST = ", ".join(f"'{s}'" for s in STATUSES)
_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OUTCOMES.items())
CTE = {
    "captions": "captions AS (SELECT doc_id AS item_id, 'd/' || source || '/' || doc_id || '.txt' AS caption_path, text AS caption FROM documents)",
    "jobs": f"""captions AS (SELECT doc_id AS item_id, 'd/' || source || '/' || doc_id || '.txt' AS caption_path, text AS caption FROM documents),
        jobs AS (SELECT c.item_id, caption_path, caption, ([{_LIST}])[(c.item_id % 9 + 1)::INT] AS status, coalesce(quality = 1, false) AS reviewed, (coalesce(quality, 0) + coalesce(toxic, 0))::BIGINT AS revision_count,
            'img' || (c.item_id % 50) || '_' || c.item_id || '.png' AS file_name, CASE WHEN c.item_id % 9 = 7 THEN 'error ' || (c.item_id % 4) END AS error FROM captions c LEFT JOIN labels l ON l.doc_id = c.item_id)""",
    "requests": f"""requests AS (SELECT event_id AS id, ts AS created_at, strftime(ts, '%Y-%m-%d') AS batch_id, event_type AS kind, CASE event_type {_CASE} END AS status,
        CASE WHEN user_id % 10 <> 0 THEN 'k' || (user_id % 10) END AS key_id, 'm' || (k % 5) AS model_id, CASE WHEN k % 7 <> 6 THEN 'p' || (k % 7) END AS preset_id, 'c' || (user_id % 4) AS connection_id, 'u' || user_id AS item,
        k AS input_tokens, floor(abs(value))::BIGINT AS output_tokens, CASE WHEN k % 7 <> 0 THEN value * 10 END AS ttft_ms, value + 1 AS tokens_per_second
        FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events))""",
    "versions": """versions AS (SELECT conv_id * 1000 + turn AS id, 'c/' || conv_id AS caption_path, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS old_content, text AS new_content,
        CASE WHEN role = 'user' THEN 'manual' ELSE 'model' END AS source, 'b' || (turn % 3) AS batch_id FROM conversations)""",
    "decisions": """decisions AS (SELECT doc_id AS item_id, doc_id % 3 AS round, n_chars % 2 = 0 AS keep, CASE WHEN doc_id % 11 <> 0 THEN n_chars % 101 END AS score, source AS reason,
        'img' || (doc_id % 50) || '_' || doc_id || '.png' AS file_name FROM documents)""",
}
CTE["attempts"] = CTE["requests"] + """, attempts AS (SELECT *, ['caption', 'revision', 'ai_sample'][(item[2:]::BIGINT % 3 + 1)::INT] AS job_kind,
    CASE WHEN kind = 'error' THEN ['transient', 'rate_limit', 'auth', 'length', 'cut', 'cancelled', 'fatal', 'quota', 'prompt_rejected'][(id % 9 + 1)::INT] END AS error,
    kind = 'click' AS refused, kind = 'click' AND id % 2 = 0 AS structured,
    CASE WHEN kind = 'view' AND id % 5 = 0 THEN '  ' WHEN item[2:]::BIGINT % 3 = 2 THEN ['DECISION: KEEP', 'reject', 'MAYBE'][(id % 3 + 1)::INT] WHEN kind = 'signup' THEN 'short' ELSE 'a caption that is long enough' END AS text,
    CASE WHEN id % 2 = 0 THEN 'the original caption, rather long' ELSE '' END AS original, id % 4 = 0 AS review_ok,
    CASE WHEN kind = 'purchase' AND id % 6 = 0 THEN 'write_conflict' WHEN kind = 'purchase' AND id % 6 = 3 THEN 'write_error' END AS write_error,
    row_number() OVER (PARTITION BY item, batch_id ORDER BY created_at, id) - 1 AS attempt FROM requests)"""
CTE["responses"] = CTE["versions"] + """, responses AS (SELECT id, old_content AS original, CASE id % 5 WHEN 0 THEN '<think>plan, it</think>' || new_content WHEN 1 THEN '```text' || chr(10) || new_content || chr(10) || '```'
        WHEN 2 THEN '"' || new_content || '"' WHEN 3 THEN (['I am unable to help with this.', 'Hi I can go on', 'I must decline this request.', 'I must go on', '我必须拒绝。', '我必须说明。', '不便提供更多。', '不便多说。', 'Ｉ　ｃａｎｎｏｔ　ｈｅｌｐ you.',
            'I''m sorry, that is beyond what I''m able to do: unable.', 'I''m sorry, here it is.', '很遗憾，这不可以。', 'NO WAY (really).', 'No way, really.', 'Before all else, and after some more words: i can''t comply.'])[((id // 5) % 15 + 1)::INT] || ' ' || new_content[1:20] ELSE new_content END AS reply, CASE WHEN id % 17 = 0 THEN 'content_filter' END AS structured FROM versions)"""


def with_views(name: str, body: str) -> str:
    return f"WITH {CTE[name]} {body}"
