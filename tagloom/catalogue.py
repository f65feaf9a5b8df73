"""All registered queries of the library, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.functions import text as t
from tagloom.operators import jobs, metrics, responses, rules, sampling, scores, versions
from tagloom.operators.rules import EditRule
from tagloom.plans.views import Views, with_views
from tagloom.sources import files
from tagloom.streaming import jobs as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str | None = None) -> Callable:
    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLE[name] = with_views(views, sql) if views else sql
        return f

    return register


UTRIM = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
TAGS = "list_filter(list_transform(string_split({0}, ','), lambda p: " + UTRIM.format("p") + "), lambda p: p <> '')"
TAGLIST = TAGS.format("caption")

# --- tags -----------------------------------------------------------------------------------------------------------


@query("tag_frequency", f"""
    , t AS (SELECT item_id, unnest({TAGLIST}) AS tag, unnest(range(0, len({TAGLIST}))) AS pos FROM captions)
    SELECT lower(tag) AS tag, arg_min(tag, (item_id, pos)) AS label, count(DISTINCT item_id) AS images, count(*) AS occurrences,
           round(count(DISTINCT item_id) / (SELECT count(*) FROM captions) * 100, 6) AS percent FROM t GROUP BY lower(tag)""", "captions")
def _(v: Views) -> DataFrame:
    return metrics.tag_frequency(v.captions())


@query("tag_totals", f"""
    , t AS (SELECT item_id, {TAGLIST} AS tags FROM captions), u AS (SELECT DISTINCT lower(unnest(tags)) AS tag FROM t)
    SELECT (SELECT count(*) FROM u) AS distinct_tags, count(*) FILTER (len(tags) > 0) AS captioned, sum(len(tags))::BIGINT AS assignments FROM t""", "captions")
def _(v: Views) -> DataFrame:
    return metrics.tag_totals(v.captions())


@query("tag_split", f"SELECT item_id, unnest(range(0, len({TAGLIST}))) AS pos, unnest({TAGLIST}) AS tag FROM captions", "captions")
def _(v: Views) -> DataFrame:
    return v.captions().select("item_id", F.posexplode(t.tags(F.col("caption"))).alias("pos", "tag")).withColumn("pos", F.col("pos").cast("long"))


NORMALIZED = "CASE WHEN contains({0}, ',') AND len(" + TAGS + ") > 0 THEN array_to_string(" + TAGS + ", ', ') ELSE {0} END"


@query("normalize_tags", f"SELECT item_id, {NORMALIZED.format('caption')} AS caption FROM captions", "captions")
def _(v: Views) -> DataFrame:
    return v.captions().select("item_id", t.normalized(F.col("caption")).alias("caption"))


@query("tag_dedupe", f"""
    , t AS (SELECT item_id, {TAGLIST} AS tags FROM captions)
    SELECT item_id, array_to_string(list_filter(tags, lambda x, i: list_position(list_transform(tags, lambda y: lower(y)), lower(x)) = i), ', ') AS caption FROM t""", "captions")
def _(v: Views) -> DataFrame:
    return v.captions().select("item_id", F.array_join(t.deduplicated(t.tags(F.col("caption"))), ", ").alias("caption"))


# --- edit rules -----------------------------------------------------------------------------------------------------


def edit(name: str, rule: EditRule, sql: str) -> None:
    """A preview over all captions; ``sql`` gives the edited caption from ``caption`` and the list ``tags``."""
    body = f", t AS (SELECT *, {TAGLIST} AS tags FROM captions), e AS (SELECT caption_path, caption AS before, {sql} AS after FROM t) SELECT caption_path, before, after, before <> after AS changed, NULL::VARCHAR AS error FROM e"
    query(name, body, "captions")(lambda v: rules.preview(v.captions(), rule))


JOIN = "array_to_string({}, ', ')"
HIT = "regexp_matches(x, '(?i)token')"
FIRST = "list_position(list_transform(tags, lambda y: regexp_matches(y, '(?i)token')), true)"
edit("tag_delete", EditRule(action="delete", content="token"), JOIN.format(f"list_filter(tags, lambda x: NOT {HIT})"))
edit("tag_delete_first", EditRule(action="delete", content="token", all_matches=False), JOIN.format(f"list_filter(tags, lambda x, i: i <> coalesce({FIRST}, 0))"))
edit("tag_replace", EditRule(action="replace", content="token", replacement="secret, removed"), JOIN.format(f"flatten(list_transform(tags, lambda x: CASE WHEN {HIT} THEN ['secret', 'removed'] ELSE [x] END))"))
edit("tag_insert_start", EditRule(position="start", content="new, tag"), JOIN.format("list_concat(['new', 'tag'], tags)"))
edit("tag_insert_end", EditRule(position="end", content="new, tag"), JOIN.format("list_concat(tags, ['new', 'tag'])"))
edit("tag_insert_index", EditRule(position="index", index=3, content="new"), JOIN.format("list_concat(list_concat(tags[1:2], ['new']), tags[3:])"))
edit("tag_insert_before", EditRule(position="before", anchor="token", content="new"), JOIN.format(f"flatten(list_transform(tags, lambda x: CASE WHEN {HIT} THEN ['new', x] ELSE [x] END))"))
edit("tag_insert_after_first", EditRule(position="after", anchor="token", content="new", all_matches=False), JOIN.format(f"flatten(list_transform(tags, lambda x, i: CASE WHEN i = coalesce({FIRST}, 0) THEN [x, 'new'] ELSE [x] END))"))
edit("tag_insert_missing", EditRule(position="end", content="new", only_if_missing=True), "CASE WHEN list_contains(list_transform(tags, lambda x: lower(x)), 'new') THEN caption ELSE " + JOIN.format("list_concat(tags, ['new'])") + " END")
edit("tag_insert_dedupe", EditRule(position="end", content="new", deduplicate=True), JOIN.format("list_filter(list_concat(tags, ['new']), lambda x, i: list_position(list_transform(list_concat(tags, ['new']), lambda y: lower(y)), lower(x)) = i)"))
edit("text_delete", EditRule(mode="text", action="delete", content="license"), "regexp_replace(caption, '(?i)license', '', 'g')")
edit("text_replace", EditRule(mode="text", action="replace", content="license", replacement="licence"), "regexp_replace(caption, '(?i)license', 'licence', 'g')")
edit("text_replace_first", EditRule(mode="text", action="replace", content="the", replacement="$The", all_matches=False), "regexp_replace(caption, '(?i)the', '$The')")
edit("text_replace_regex", EditRule(mode="text", action="replace", content=r"([0-9]+)", replacement="<$1>", regex=True), r"regexp_replace(caption, '([0-9]+)', '<\1>', 'g')")
edit("text_insert_start", EditRule(mode="text", position="start", content="Note. "), "'Note. ' || caption")
edit("text_insert_end", EditRule(mode="text", position="end", content=" End."), "caption || ' End.'")
edit("text_insert_index", EditRule(mode="text", position="index", index=5, content="|"), "caption[1:5] || '|' || caption[6:]")
edit("text_insert_line", EditRule(mode="text", position="line", index=2, content="second"), r"array_to_string(list_concat(list_concat(string_split(regexp_replace(caption, '\n$', ''), chr(10))[1:1], ['second']), string_split(regexp_replace(caption, '\n$', ''), chr(10))[2:]), chr(10))")
edit("text_insert_anchor", EditRule(mode="text", position="before", anchor="token", content="my "), r"regexp_replace(caption, '(?i)token', 'my \0', 'g')")
edit("text_insert_missing", EditRule(mode="text", position="end", content="license", only_if_missing=True), "CASE WHEN contains(lower(caption), 'license') THEN caption ELSE caption || 'license' END")

DELETE = EditRule(action="delete", content="token")
DELETED = JOIN.format(f"list_filter(tags, lambda x: NOT {HIT})")


@query("edit_preview_counts", f"""
    , t AS (SELECT *, {TAGLIST} AS tags FROM captions), e AS (SELECT caption <> {DELETED} AS changed FROM t)
    SELECT count(*) AS total, count(*) FILTER (changed) AS affected, count(*) FILTER (NOT changed) AS skipped, 0::BIGINT AS errors FROM e""", "captions")
def _(v: Views) -> DataFrame:
    return rules.preview_counts(rules.preview(v.captions(), DELETE))


def changed_meanwhile(captions: DataFrame) -> DataFrame:
    return captions.withColumn("caption", F.when(F.col("item_id") % 5 == 0, F.concat("caption", F.lit("!"))).otherwise(F.col("caption")))


APPLY = f""", t AS (SELECT *, {TAGLIST} AS tags FROM captions), e AS (SELECT caption_path, caption AS before, {DELETED} AS after, CASE WHEN item_id % 5 = 0 THEN caption || '!' ELSE caption END AS current FROM t),
    a AS (SELECT caption_path, CASE WHEN before = after THEN 'skipped' WHEN current <> before THEN 'conflict' ELSE 'applied' END AS status, after, current FROM e)"""


@query("edit_apply_status", APPLY + " SELECT caption_path, status, CASE WHEN status = 'applied' THEN after ELSE current END AS content FROM a", "captions")
def _(v: Views) -> DataFrame:
    return versions.apply_status(rules.preview(v.captions(), DELETE), changed_meanwhile(v.captions()))


@query("edit_apply_counts", APPLY + " SELECT count(*) FILTER (status = 'applied') AS applied, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'conflict') AS conflict FROM a", "captions")
def _(v: Views) -> DataFrame:
    return versions.apply_counts(versions.apply_status(rules.preview(v.captions(), DELETE), changed_meanwhile(v.captions())))


query("edit_apply_result", APPLY + " SELECT caption_path, e.before AS old_content, a.after AS new_content, 'batch_edit' AS source, 'e1' AS batch_id FROM a JOIN e USING (caption_path) WHERE status = 'applied'", "captions")(
    lambda v: versions.apply_edit(rules.preview(v.captions(), DELETE), changed_meanwhile(v.captions()), "e1", v.versions().select("batch_id"))[1])
query("edit_applied_once", "SELECT batch_id, CASE WHEN batch_id = 'e9' THEN (SELECT count(*) FROM (SELECT caption_path FROM captions)) ELSE 0 END AS rows FROM (SELECT unnest(['b1', 'e9']) AS batch_id)", "captions")(
    lambda v: (lambda one: one("b1").unionByName(one("e9")))(lambda batch: versions.apply_edit(rules.preview(v.captions(), DELETE), v.captions(), batch, v.versions().select("batch_id"))[0].agg(F.lit(batch).alias("batch_id"), F.count("*").alias("rows"))))
query("apply_to_jobs", APPLY + ", c AS (SELECT caption_path, status, after, current FROM a) SELECT item_id, CASE WHEN status = 'applied' THEN after ELSE caption END AS caption FROM captions JOIN c USING (caption_path)", "captions")(
    lambda v: jobs.merged_edits(v.captions(), versions.apply_status(rules.preview(v.captions(), DELETE), changed_meanwhile(v.captions()))).select("item_id", "caption"))


# --- versions -------------------------------------------------------------------------------------------------------

CURRENT = ", current AS (SELECT caption_path, arg_max(new_content, id) AS caption FROM versions GROUP BY caption_path)"


def current(v: Views) -> DataFrame:
    return v.versions().groupBy("caption_path").agg(F.max_by("new_content", "id").alias("caption"))


@query("guarded_write", CURRENT + """ SELECT c.caption_path, CASE WHEN caption IS DISTINCT FROM v.new_content THEN 'rejected' WHEN v.id % 2 = 0 THEN 'no_op' ELSE 'written' END AS status,
    CASE WHEN caption IS NOT DISTINCT FROM v.new_content AND v.id % 2 = 1 THEN v.new_content || '!' ELSE caption END AS content FROM versions v JOIN current c USING (caption_path) WHERE v.batch_id = 'b1'""", "versions")
def _(v: Views) -> DataFrame:
    return versions.guarded_write(current(v), v.versions().where("batch_id = 'b1'").select("caption_path", F.col("new_content").alias("before"), F.when(F.col("id") % 2 == 0, F.col("new_content")).otherwise(F.concat("new_content", F.lit("!"))).alias("after")))


@query("manual_save", CURRENT + """ SELECT caption_path, v.new_content AS old_content, v.new_content || '!' AS new_content, CASE WHEN v.id % 2 = 0 THEN 'local' ELSE 'manual' END AS source, NULL::VARCHAR AS batch_id
    FROM versions v JOIN current c USING (caption_path) WHERE v.id % 1000 = 1 AND caption = v.new_content""", "versions")
def _(v: Views) -> DataFrame:
    saves = v.versions().where("id % 1000 = 1").select("caption_path", F.col("new_content").alias("before"), F.concat("new_content", F.lit("!")).alias("after"), F.when(F.col("id") % 2 == 0, "local").otherwise(" ").alias("source"))
    return versions.manual_save(current(v), saves)[1]


UNDO = CURRENT + """, b AS (SELECT caption_path, arg_min(old_content, id) AS first_old, arg_max(new_content, id) AS last_new FROM versions WHERE batch_id = 'b0' AND source <> 'undo' GROUP BY caption_path),
    u AS (SELECT caption_path, caption, first_old, CASE WHEN caption = last_new AND caption <> first_old THEN 'restored' WHEN caption = first_old THEN 'skipped' ELSE 'conflict' END AS status FROM b JOIN current USING (caption_path))"""


@query("undo_batch", UNDO + " SELECT caption_path, status, CASE WHEN status = 'restored' THEN first_old ELSE caption END AS content FROM u", "versions")
def _(v: Views) -> DataFrame:
    return versions.undo_batch(v.versions(), current(v), "b0")


@query("restore_version", CURRENT + ", p AS (SELECT caption_path, max(id) AS version_id, arg_max(old_content, id) AS content FROM versions WHERE id % 2 = 0 GROUP BY caption_path) SELECT caption_path, version_id, content, caption <> content AS changed FROM p JOIN current USING (caption_path)", "versions")
def _(v: Views) -> DataFrame:
    return versions.restore_version(v.versions(), current(v), F.col("id") % 2 == 0)


query("undo_rows", UNDO + " SELECT caption_path, caption AS old_content, first_old AS new_content, 'undo' AS source, 'b0' AS batch_id FROM u WHERE status = 'restored'", "versions")(lambda v: versions.undo_rows(v.versions(), current(v), "b0"))
query("restore_rows", CURRENT + ", p AS (SELECT caption_path, arg_max(old_content, id) AS content FROM versions WHERE id % 2 = 0 GROUP BY caption_path) SELECT caption_path, caption AS old_content, content AS new_content, 'undo' AS source, NULL::VARCHAR AS batch_id FROM p JOIN current USING (caption_path) WHERE caption <> content", "versions")(
    lambda v: versions.restore_rows(v.versions(), current(v), F.col("id") % 2 == 0))


@query("restore_targets", "SELECT caption_path, max(id) AS id FROM versions WHERE id % 3 > 0 GROUP BY caption_path", "versions")
def _(v: Views) -> DataFrame:
    return versions.latest(v.versions().where("id % 3 > 0"), "caption_path", F.col("id").desc()).select("caption_path", "id")


@query("version_history", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY caption_path ORDER BY id DESC) AS rank FROM versions) WHERE rank <= 200", "versions")
def _(v: Views) -> DataFrame:
    return versions.version_history(v.versions())


@query("versions_per_batch", "SELECT batch_id, count(*) AS versions, count(DISTINCT caption_path) AS paths FROM versions GROUP BY batch_id", "versions")
def _(v: Views) -> DataFrame:
    return v.versions().groupBy("batch_id").agg(F.count("*").alias("versions"), F.countDistinct("caption_path").alias("paths"))


@query("journal_reconcile", CURRENT + """, j AS (SELECT v.id, v.caption_path, old_content, new_content, caption, v.id % 2 = 0 AS recorded FROM versions v JOIN current USING (caption_path))
    SELECT id, caption_path, CASE WHEN caption = CASE WHEN recorded THEN new_content ELSE old_content END THEN 'none' WHEN recorded THEN 'reapply' ELSE 'roll_back' END AS action, CASE WHEN recorded THEN 'applied' ELSE 'rolled_back' END AS state FROM j""", "versions")
def _(v: Views) -> DataFrame:
    journal = v.versions().select("id", "caption_path", F.col("old_content").alias("before_content"), F.col("new_content").alias("after_content"), F.col("id").alias("version_id"))
    return versions.journal_reconcile(journal, current(v), v.versions().where("id % 2 = 0"))


@query("unreferenced_dims", "SELECT s_suppkey AS supplier FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49.5 AND l_suppkey % 3 > 0)")
def _(v: Views) -> DataFrame:
    return versions.unreferenced(v.table("supplier").select(F.col("s_suppkey").alias("supplier")), v.table("lineitem").where("l_quantity > 49.5 AND l_suppkey % 3 > 0").select(F.col("l_suppkey").alias("supplier")), "supplier")


query("unreferenced_customers", "SELECT c_custkey AS customer FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")(
    lambda v: versions.unreferenced(v.table("customer").select(F.col("c_custkey").alias("customer")), v.table("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("customer")), "customer"))


@query("upsert_latest", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def _(v: Views) -> DataFrame:
    stamped = v.table("events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    return versions.upsert_latest(stamped.where("user_id % 2 = 0"), stamped.where("user_id % 2 = 1"), key="user_id", stamp="at").select("user_id", "event_type")


@query("task_batches_only", "SELECT DISTINCT batch_id FROM versions WHERE batch_id NOT IN (SELECT batch_id FROM versions WHERE source = 'manual' AND id % 1000 < 2)", "versions")
def _(v: Views) -> DataFrame:
    edits = v.versions().where("source = 'manual' AND id % 1000 < 2").select("batch_id")
    return v.versions().select("batch_id").distinct().join(edits, "batch_id", "left_anti")


# --- jobs -----------------------------------------------------------------------------------------------------------


@query("search_jobs", "SELECT item_id FROM jobs WHERE contains(lower(file_name), 'img7') OR contains(lower(caption), 'license') OR contains(lower(caption_path), 'src3') OR contains(lower(coalesce(error, '')), 'error 2')", "jobs")
def _(v: Views) -> DataFrame:
    found = lambda c, needle: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(needle)
    return v.jobs().where(found("file_name", "img7") | found("caption", "license") | found("caption_path", "src3") | found("error", "error 2")).select("item_id")


@query("dashboard", """SELECT count(*) AS total, count(*) FILTER (status IN ('succeeded', 'revised')) AS succeeded, count(*) FILTER (revision_count > 0) AS revised, count(*) FILTER (status = 'refused') AS refused, count(*) FILTER (status = 'failed') AS failed,
    count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'cancelled') AS cancelled FROM jobs""", "jobs")
def _(v: Views) -> DataFrame:
    return metrics.job_counts(v.jobs())


NATURAL = "array_to_string(list_transform(regexp_extract_all(lower(file_name), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END), '')"
for _by, _order in (("name", ""), ("revision", "revision_count DESC, "), ("length", "length(caption) DESC, ")):
    query(f"sort_jobs_{_by}", f"SELECT row_number() OVER (ORDER BY {_order}{NATURAL}, item_id) AS rank, item_id, file_name FROM jobs", "jobs")(lambda v, by=_by: metrics.ranked_jobs(v.jobs(), by, scratch(v)))
query("sort_jobs_name_last", f"SELECT row_number() OVER (ORDER BY {NATURAL} DESC, item_id) AS rank, item_id, file_name FROM jobs", "jobs")(lambda v: metrics.ranked_jobs(v.jobs(), "name", scratch(v), ascending=False))
query("sort_jobs_revision_first", f"SELECT row_number() OVER (ORDER BY revision_count, {NATURAL}, item_id) AS rank, item_id, file_name FROM jobs", "jobs")(lambda v: metrics.ranked_jobs(v.jobs(), "revision", scratch(v), ascending=True))


@query("reviewed_union", "SELECT lower(caption_path) AS caption_path FROM jobs WHERE status = 'revised' UNION SELECT lower(caption_path) FROM jobs WHERE reviewed", "jobs")
def _(v: Views) -> DataFrame:
    jobs = v.jobs()
    return jobs.where("status = 'revised'").select(F.lower("caption_path").alias("caption_path")).union(jobs.where("reviewed").select(F.lower("caption_path"))).distinct()


@query("revision_counts", "SELECT lower(caption_path) AS caption_path, count(*) AS revisions FROM versions WHERE source = 'model' GROUP BY 1", "versions")
def _(v: Views) -> DataFrame:
    return v.versions().where("source = 'model'").groupBy(F.lower("caption_path").alias("caption_path")).agg(F.count("*").alias("revisions"))


@query("revision_count_join", ", n AS (SELECT caption_path, count(*) AS n FROM versions WHERE id % 1000 > 3 GROUP BY 1) SELECT DISTINCT v.caption_path, coalesce(n, 0) AS revisions FROM versions v LEFT JOIN n USING (caption_path)", "versions")
def _(v: Views) -> DataFrame:
    counts = v.versions().where("id % 1000 > 3").groupBy("caption_path").agg(F.count("*").alias("n"))
    return v.versions().select("caption_path").distinct().join(counts, "caption_path", "left").select("caption_path", F.coalesce("n", F.lit(0)).cast("long").alias("revisions"))


@query("import_new_only", "SELECT item_id FROM captions WHERE lower(caption_path) NOT IN (SELECT lower(caption_path) FROM captions WHERE item_id % 3 = 0)", "captions")
def _(v: Views) -> DataFrame:
    known = v.captions().where("item_id % 3 = 0").select(F.lower("caption_path").alias("p"))
    new = v.captions()
    return new.join(known, F.lower("caption_path") == known.p, "left_anti").select("item_id")


@query("job_gate", "SELECT item_id, CASE WHEN item_id % 2 = 0 AND item_id % 3 > 0 AND item_id % 5 > 0 THEN 'skipped' WHEN item_id % 2 = 1 AND (item_id % 7 = 0 OR trim(caption) = '') THEN 'failed' ELSE 'ready' END AS gate FROM jobs", "jobs")
def _(v: Views) -> DataFrame:
    n = F.col("item_id")
    rows = v.jobs().withColumn("caption", F.when(n % 7 == 0, "").otherwise(F.col("caption"))).withColumn("has_caption", n % 5 > 0)
    return rows.select("item_id", jobs.gate(rows, n % 2 == 1, n % 3 == 0).alias("gate"))


query("filter_review", "SELECT item_id FROM jobs WHERE NOT reviewed", "jobs")(lambda v: jobs.by_review(v.jobs(), "unreviewed").select("item_id"))
query("scope_choice", "SELECT item_id FROM jobs WHERE status = 'failed'", "jobs")(lambda v: jobs.chosen(v.jobs(), F.col("status") == "failed").select("item_id"))
query("scope_choice_all", "SELECT item_id FROM jobs", "jobs")(lambda v: jobs.chosen(v.jobs(), F.col("status") == "unknown").select("item_id"))
query("retryable_jobs", "SELECT item_id FROM jobs WHERE status IN ('failed', 'refused', 'cancelled')", "jobs")(lambda v: v.jobs().where(F.col("status").isin(*jobs.RETRYABLE)).select("item_id"))
query("candidate_mark", "SELECT item_id, CASE WHEN item_id % 9 = 7 THEN 'pending' ELSE status END AS status, CASE WHEN item_id % 9 <> 7 THEN error END AS error FROM jobs", "jobs")(lambda v: jobs.marked(v.jobs(), v.jobs().where("status = 'failed'")).select("item_id", "status", "error"))
query("reviewed_flag", "SELECT item_id, reviewed OR status = 'revised' AS reviewed FROM jobs", "jobs")(
    lambda v: files.with_reviewed(v.jobs().drop("reviewed"), v.jobs().where("reviewed OR status = 'revised'").select(F.upper("caption_path").alias("caption_path"))).select("item_id", "reviewed"))
query("sample_search", "SELECT c.item_id FROM captions c JOIN decisions d USING (item_id) WHERE contains(lower(caption_path), 'license') OR contains(lower(caption), 'license') OR contains(lower(CASE WHEN d.item_id % 2 = 0 THEN reason END), 'src1')".replace("captions c JOIN decisions d", "(SELECT doc_id AS item_id, 'd/' || source || '/' || doc_id || '.txt' AS caption_path, text AS caption FROM documents) c JOIN decisions d").replace("'license') OR contains(lower(CASE", "'license') OR contains(lower(CASE"), "decisions")(
    lambda v: v.captions().join(v.decisions().where("item_id % 2 = 0").select("item_id", "reason"), "item_id", "left").where(jobs.has("License", "caption_path", "caption") | F.coalesce(F.lower("reason").contains("src1"), F.lit(False))).select("item_id"))
query("filter_logs", "SELECT event_id FROM events WHERE event_type = 'error' AND user_id % 3 = 1")(lambda v: v.table("events").where("event_type = 'error'").where("user_id % 3 = 1").select("event_id"))
query("event_scope", "SELECT event_id FROM events WHERE user_id % 3 <> 2")(lambda v: v.table("events").withColumn("scope", F.when(F.col("user_id") % 3 == 2, "ai_sample").otherwise("main")).where("scope <> 'ai_sample'").select("event_id"))
query("log_tail", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")(lambda v: v.table("events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).select("event_id"))
query("recent_batches", "SELECT row_number() OVER (ORDER BY last_id DESC, batch_id) AS rank, batch_id, versions FROM (SELECT 'c' || conv_id || '-' || turn // 2 AS batch_id, max(conv_id * 1000 + turn) AS last_id, count(*) AS versions FROM conversations GROUP BY 1) QUALIFY rank <= 100")(
    lambda v: (lambda b: b.orderBy(F.desc("at"), "batch_id").limit(100).select(F.row_number().over(Window.orderBy(F.desc("at"), "batch_id")).cast("long").alias("rank"), "batch_id", "versions"))(
        v.versions().groupBy(F.concat(F.lit("c"), F.floor(F.col("id") / 1000).cast("string"), F.lit("-"), F.floor(F.col("id") % 1000 / 2).cast("string")).alias("batch_id")).agg(F.max("id").alias("at"), F.count("*").alias("versions"))))
query("set_append", "SELECT DISTINCT caption_path AS path FROM captions WHERE item_id % 3 = 0 OR item_id % 2 = 0", "captions")(lambda v: jobs.moved_into(v.captions().where("item_id % 3 = 0").select(F.col("caption_path").alias("path")), v.captions().where("item_id % 2 = 0").select(F.col("caption_path").alias("path"))))
query("known_removal", "SELECT caption_path AS path FROM captions WHERE item_id % 2 = 0 AND item_id % 3 <> 0 UNION ALL SELECT 'new/' || caption_path FROM captions WHERE item_id % 10 = 0", "captions")(
    lambda v: jobs.replaced(*[v.captions().where(w).select(p.alias("path")) for w, p in (("item_id % 2 = 0", F.col("caption_path")), ("item_id % 3 = 0", F.col("caption_path")), ("item_id % 10 = 0", F.concat(F.lit("new/"), "caption_path")))]))


@query("channel_resolve", """SELECT s_suppkey AS preset, 0 AS at, 'x' || s_suppkey AS connection_id, 'm1' AS model_id FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 1, 'c2', s_name FROM supplier WHERE s_suppkey % 3 = 1
    UNION ALL SELECT s_suppkey, 0, 'own', s_name FROM supplier WHERE s_suppkey % 3 = 2 AND s_suppkey % 2 = 0""")
def _(v: Views) -> DataFrame:
    k, own = F.col("s_suppkey"), F.lit("array<struct<connection_id:string,model_id:string>>")
    given = F.when(k % 3 == 0, F.array(F.struct(F.concat(F.lit("x"), k.cast("string")).alias("connection_id"), F.lit("m1").alias("model_id"))))
    several = F.when(k % 3 == 1, F.array(F.lit(" "), F.lit("c2"))).otherwise(F.array().cast("array<string>"))
    return jobs.channels(v.table("supplier").select(k.alias("preset"), given.alias("channels"), several.alias("connection_ids"), F.when(k % 2 == 0, "own").otherwise("").alias("connection_id"), F.col("s_name").alias("model_id")))


@query("run_completion", "SELECT strftime(ts, '%Y-%m-%d') AS batch_id, bool_or(event_id % 997 = 0) AS completed, CASE WHEN bool_or(event_id % 997 = 0) THEN CASE WHEN bool_or(event_id % 997 = 0 AND event_id % 2 = 0) THEN 'warn' ELSE 'success' END END AS level FROM events GROUP BY 1")
def _(v: Views) -> DataFrame:
    n = F.col("event_id")
    return jobs.completions(v.table("events").select(F.date_format("ts", "yyyy-MM-dd").alias("batch_id"), F.when(n % 997 == 0, "completed").otherwise("progress").alias("type"), F.when(n % 2 == 0, "任务已停止").otherwise("done").alias("message")))


query("refusal_plan", "SELECT 'd/' || file_name AS path, 'd/.refusal/' || file_name AS target, CASE WHEN item_id % 10 = 0 THEN 'skip' ELSE 'move' END AS action FROM jobs WHERE item_id % 3 > 0", "jobs")(
    lambda v: jobs.refusal_plan(*[v.jobs().where(w).select(F.concat(F.lit(p), f("file_name")).alias("path")) for w, p, f in (("true", "d/", F.col), ("item_id % 3 = 0", "D/", F.upper), ("item_id % 10 = 0", "d/.refusal/", F.col))], "d"))


@query("code_labels", "SELECT status, CASE status WHEN 'succeeded' THEN 'Done' WHEN 'failed' THEN 'Failed' ELSE status END AS label, count(*) AS n FROM jobs GROUP BY 1, 2", "jobs")
def _(v: Views) -> DataFrame:
    """Labels of a caller's own choice."""
    return v.jobs().groupBy("status").agg(F.count("*").alias("n")).withColumn("label", jobs.label_of(F.col("status"), {"succeeded": "Done", "failed": "Failed"}))


query("status_labels", """SELECT item_id, CASE status WHEN 'pending' THEN '等待' WHEN 'running' THEN '处理中' WHEN 'succeeded' THEN '已完成' WHEN 'revised' THEN '已修订' WHEN 'no_response' THEN '无响应' WHEN 'refused' THEN '疑似拒绝' WHEN 'failed' THEN '失败' WHEN 'skipped' THEN '已跳过'
    WHEN 'cancelled' THEN '已取消' ELSE status END AS label FROM jobs""", "jobs")(lambda v: v.jobs().select("item_id", jobs.label_of(F.col("status"), jobs.STATUS_LABELS).alias("label")))
query("error_labels", """SELECT item, batch_id, attempt, CASE error WHEN 'rate_limit' THEN '限流' WHEN 'auth' THEN '认证失败' WHEN 'quota' THEN '额度用尽' WHEN 'transient' THEN '网络错误' WHEN 'prompt_rejected' THEN '提示词被拒' WHEN 'fatal' THEN '请求失败' WHEN 'cancelled' THEN '已取消' ELSE error END AS label
    FROM attempts WHERE error IS NOT NULL""", "attempts")(lambda v: v.attempts().where("error is not null").select("item", "batch_id", "attempt", jobs.label_of(F.col("error"), jobs.ERROR_LABELS).alias("label")))
query("source_labels", "SELECT id, CASE source WHEN 'manual' THEN '手动编辑' ELSE source END AS label FROM versions", "versions")(lambda v: v.versions().select("id", jobs.label_of(F.col("source"), jobs.SOURCE_LABELS).alias("label")))


_LIVE = """, e AS (SELECT user_id AS item_id, arg_max(s, event_id) AS last, count(*) FILTER (s = 'revised') AS n, bool_or(s <> 'running') AS ended
        FROM (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'signup' THEN 'revised' WHEN 'error' THEN 'no_response' ELSE 'running' END AS s FROM events) GROUP BY 1)
    SELECT j.item_id, coalesce(last, status) AS status, j.item_id % 2 = 0 AND NOT coalesce(ended, false) AS selected, reviewed OR coalesce(n, 0) > 0 AS reviewed, revision_count + coalesce(n, 0) AS revision_count FROM jobs j LEFT JOIN e ON e.item_id = j.item_id"""


@query("live_jobs", _LIVE, "jobs")
def _(v: Views) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "signup", "revised").when(F.col("event_type") == "error", "no_response").otherwise("running")
    ends = streams.job_ends(v.table("events").select(F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"), status.alias("status")))
    return jobs.live(v.jobs().withColumn("selected", F.col("item_id") % 2 == 0), ends).select("item_id", "status", "selected", "reviewed", "revision_count")


query("newest_versions", "SELECT id, caption_path, old_content, new_content, source, batch_id FROM versions ORDER BY id DESC LIMIT 500", "versions")(lambda v: versions.newest_versions(v.versions()))


# --- files ----------------------------------------------------------------------------------------------------------

_PATH = "'d/' || source || ['/', '/.hidden/', '/sub.v2/'][(doc_id % 3 + 1)::INT] || CASE WHEN doc_id % 2 = 0 THEN 'Img' ELSE 'img' END || doc_id % 200 || ['.png', '.JPG', '.jpeg', '.webp', '.bmp', '.tif', '.TIFF', '.gif', '.txt'][(doc_id % 9 + 1)::INT]"


def paths(v: Views) -> DataFrame:
    n = F.col("doc_id")
    pick = lambda at, *values: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    return v.table("documents").select(F.concat(F.lit("d/"), "source", pick(n % 3, "/", "/.hidden/", "/sub.v2/"), pick(n % 2, "Img", "img"), (n % 200).cast("string"), pick(n % 9, ".png", ".JPG", ".jpeg", ".webp", ".bmp", ".tif", ".TIFF", ".gif", ".txt")).alias("path"))


query("scan_dataset", f"SELECT min(path) AS path FROM (SELECT {_PATH} AS path FROM documents) WHERE NOT regexp_matches(substr(path, 3), '(^|/)\\.') AND lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('png', 'jpg', 'jpeg', 'webp', 'bmp', 'tif', 'tiff') GROUP BY lower(path)")(lambda v: files.scanned(paths(v), "d"))
query("scan_texts", f"SELECT min(path) AS path FROM (SELECT {_PATH} AS path FROM documents) WHERE NOT regexp_matches(substr(path, 3), '(^|/)\\.') AND path LIKE '%.txt' GROUP BY lower(path)")(lambda v: files.scanned(paths(v), "d", ("txt",)))


@query("pair_captions", "SELECT replace(caption_path, '.txt', '.png') AS path, caption_path, CASE WHEN item_id % 4 > 0 THEN caption ELSE '' END AS caption, CASE WHEN item_id % 4 > 0 THEN 'succeeded' ELSE 'pending' END AS status, reviewed, CASE WHEN item_id % 5 = 0 THEN 3 ELSE 0 END::BIGINT AS revision_count FROM jobs", "jobs")
def _(v: Views) -> DataFrame:
    images = v.captions().select(F.regexp_replace("caption_path", r"\.txt$", ".png").alias("path"))
    some = v.captions().where("item_id % 5 = 0")
    revisions = some.select("caption_path", F.lit(1).alias("revisions")).unionByName(some.select(F.upper("caption_path").alias("caption_path"), F.lit(2).alias("revisions")))
    return files.paired(images, v.captions().where("item_id % 4 > 0"), v.jobs().where("reviewed").select(F.upper("caption_path").alias("caption_path")), revisions)


@query("decode_text", """SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN '你好' WHEN 3 THEN 'a' || chr(0) || 'b' WHEN 4 THEN '' ELSE text END AS text, CASE WHEN doc_id % 5 = 4 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'not a .txt file' WHEN doc_id % 5 = 3 THEN 'binary content' END AS error FROM documents""")
def _(v: Views) -> DataFrame:
    n = F.col("doc_id")
    content = F.when(n % 5 == 0, F.encode("text", "UTF-8")).when(n % 5 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).when(n % 5 == 2, F.unhex(F.lit("C4E3BAC3"))).when(n % 5 == 3, F.unhex(F.lit("610062")))
    named = v.table("documents").select("doc_id", F.when(n % 7 == 0, "a/b.md").otherwise("a/b.TXT").alias("path"), content.alias("content"))
    return named.select("doc_id", files.decoded(F.col("content")).alias("text"), files.text_error(F.col("path"), F.col("content")).alias("error"))


@query("export_captions", "SELECT caption_path, caption || '!' AS caption FROM captions WHERE item_id % 4 = 1 UNION ALL SELECT 'new/' || caption_path, caption FROM captions WHERE item_id % 10 = 0", "captions")
def _(v: Views) -> DataFrame:
    """A quarter of the captions was edited and some are new; these alone are written, and read back here."""
    c = v.captions().select("item_id", "caption_path", "caption")
    edited = c.withColumn("caption", F.when(F.col("item_id") % 4 == 1, F.concat("caption", F.lit("!"))).otherwise(F.col("caption")))
    new = c.where("item_id % 10 = 0").withColumn("caption_path", F.concat(F.lit("new/"), "caption_path"))
    target = f"{scratch(v)}/captions"
    files.export_captions(files.changed_captions(c, edited.unionByName(new)).select("caption_path", "caption"), target)
    return v.spark.read.parquet(target)


@query("edit_preview", f"""
    , t AS (SELECT *, {TAGLIST} AS tags FROM captions), d AS (SELECT min(item_id) AS item_id FROM captions GROUP BY caption_path),
    e AS (SELECT caption_path, item_id % 7 = 0 AS bad, CASE WHEN item_id % 7 = 0 THEN '' ELSE caption END AS before, CASE WHEN item_id % 7 = 0 THEN '' ELSE {DELETED} END AS after FROM t JOIN d USING (item_id))
    SELECT caption_path, before, after, before <> after AS changed, CASE WHEN bad THEN 'binary content' END AS error FROM e""", "captions")
def _(v: Views) -> DataFrame:
    """Every path once, however often it is picked; a file that isn't text is an error with an empty text."""
    n = F.col("item_id")
    picked = v.captions().withColumn("content", F.when(n % 7 == 0, F.unhex(F.lit("6100"))).otherwise(F.encode("caption", "UTF-8")))
    again = picked.where(n % 3 == 0).withColumn("caption_path", F.upper("caption_path"))
    once = sampling.dedupe_paths(picked.unionByName(again.withColumn("item_id", n + (1 << 40))))
    return rules.preview(files.read_texts(once), DELETE)


# --- request statistics ---------------------------------------------------------------------------------------------

SUMS = """count(*) AS requests, count(*) FILTER (status IN ('succeeded', 'revised')) AS succeeded, count(*) FILTER (status = 'refused') AS refused, count(*) FILTER (status = 'failed') AS failed,
    coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, round(avg(ttft_ms), 4) AS avg_ttft_ms, round(avg(tokens_per_second), 4) AS avg_speed"""
DIMENSIONS = {"kind": "kind", "batch": "batch_id", "model": "model_id", "preset": "preset_id", "key": "key_id", "connection": "connection_id"}

query("stats_global", f"SELECT {SUMS} FROM requests", "requests")(lambda v: metrics.stats(v.requests()))
query("stats_filtered", f"SELECT {SUMS} FROM requests WHERE model_id = 'm1' AND key_id = 'k3'", "requests")(lambda v: metrics.stats(v.requests(), model_id="m1", key_id="k3"))
for _name, _column in DIMENSIONS.items():
    query(f"stats_by_{_name}", f"SELECT coalesce({_column}, '') AS grp, {SUMS} FROM requests GROUP BY 1", "requests")(lambda v, c=_column: metrics.stats(v.requests(), c))


@query("stats_grouping_sets", f"SELECT kind, model_id, preset_id, key_id, {SUMS} FROM (SELECT * REPLACE (coalesce(preset_id, '') AS preset_id, coalesce(key_id, '') AS key_id) FROM requests) GROUP BY GROUPING SETS ((kind), (model_id), (preset_id), (key_id), ())", "requests")
def _(v: Views) -> DataFrame:
    return metrics.stats_all_dimensions(v.requests(), ("kind", "model_id", "preset_id", "key_id"))


@query("stats_labels", f", s AS (SELECT connection_id AS grp, {SUMS} FROM requests GROUP BY 1) SELECT s.*, coalesce(n_name, grp) AS label FROM s LEFT JOIN nation ON grp = 'c' || n_nationkey", "requests")
def _(v: Views) -> DataFrame:
    return metrics.labelled(metrics.stats(v.requests(), "connection_id"), v.table("nation").select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name")))


_NAMES_SQL = """SELECT s.*, coalesce(name, grp) AS label FROM s LEFT JOIN n ON grp = id"""
query("stats_preset_names", f", s AS (SELECT coalesce(preset_id, '') AS grp, {SUMS} FROM requests GROUP BY 1), n AS (SELECT 'p' || n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 3 = 0) {_NAMES_SQL}", "requests")(
    lambda v: metrics.labelled(metrics.stats(v.requests(), "preset_id"), metrics.preset_names(v.table("nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("id"), F.when(F.col("n_nationkey") % 3 == 0, F.to_json(F.struct(F.col("n_name").alias("name")))).when(F.col("n_nationkey") % 3 == 1, '{"name":5}').otherwise("{broken").alias("json")))))
query("stats_key_names", f", s AS (SELECT coalesce(key_id, '') AS grp, {SUMS} FROM requests GROUP BY 1), n AS (SELECT 'k' || n_nationkey % 12 AS id, arg_max(n_name, n_nationkey) AS name FROM nation WHERE n_nationkey % 4 <> 3 GROUP BY 1) {_NAMES_SQL}", "requests")(
    lambda v: metrics.labelled(metrics.stats(v.requests(), "key_id"), metrics.key_names(v.table("nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 4 == 3, "{broken").otherwise(
        F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("k"), (F.col("n_nationkey") % 12).cast("string")).alias("id"), F.col("n_name").alias("label")), F.struct(F.lit(None).cast("string").alias("id"), F.lit("none").alias("label"))).alias("keyRefs")))).alias("json")))))


FOLLOWED = """, r AS (SELECT *, structured OR (refused AND job_kind <> 'ai_sample') AS refusal FROM attempts),
    s AS (SELECT *, CASE WHEN error = 'cancelled' THEN 'cancelled' WHEN error = 'transient' THEN 'no_response' WHEN error IS NOT NULL THEN 'failed' WHEN refusal THEN 'refused' WHEN trim(text) = '' THEN 'failed'
            WHEN job_kind = 'ai_sample' THEN CASE text WHEN 'DECISION: KEEP' THEN 'succeeded' WHEN 'reject' THEN 'skipped' ELSE 'failed' END
            WHEN job_kind = 'revision' AND original <> '' AND length(text) * 2 < length(original) AND NOT review_ok THEN 'failed' WHEN write_error IS NOT NULL THEN 'failed' WHEN job_kind = 'revision' THEN 'revised' ELSE 'succeeded' END AS result,
        CASE WHEN error = 'cancelled' THEN NULL WHEN error = 'transient' THEN 'no_response' WHEN error IN ('cut', 'length') THEN 'truncated' WHEN error IS NOT NULL THEN error WHEN refusal THEN NULL WHEN trim(text) = '' THEN 'empty_reply'
            WHEN job_kind = 'ai_sample' THEN CASE WHEN text = 'MAYBE' OR text LIKE 'a caption%' THEN 'invalid_decision' END
            WHEN job_kind = 'revision' AND original <> '' AND length(text) * 2 < length(original) AND NOT review_ok THEN 'length_reduced' ELSE write_error END AS why,
        attempt < 5 AND CASE WHEN error IS NULL THEN refusal AND job_kind <> 'ai_sample' AND attempt < 2 WHEN error IN ('transient', 'cut') THEN true ELSE error IN ('rate_limit', 'auth', 'quota', 'prompt_rejected') AND attempt < 2 END AS goes_on FROM r),
    f AS (SELECT * FROM (SELECT *, coalesce(min(attempt) FILTER (NOT goes_on) OVER w, max(attempt) OVER w) AS last FROM s WINDOW w AS (PARTITION BY item, batch_id)) WHERE attempt <= last)"""


@query("attempt_outcome", FOLLOWED + """ SELECT item, batch_id, max(result) FILTER (attempt = last) AS outcome, max(why) FILTER (attempt = last) AS error_kind, coalesce(max(attempt) FILTER (attempt = last AND error IS NULL), 0) AS retries,
    coalesce(sum(input_tokens) FILTER (error IS NULL), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens) FILTER (error IS NULL), 0)::BIGINT AS output_tokens FROM f GROUP BY item, batch_id""", "attempts")
def _(v: Views) -> DataFrame:
    return metrics.attempt_outcome(v.attempts())


@query("attempt_metrics", FOLLOWED + """ SELECT item, batch_id, attempt AS retries, CASE WHEN goes_on THEN 'refused' ELSE result END AS status, key_id, input_tokens, output_tokens FROM f WHERE error IS NULL
    UNION ALL SELECT item, batch_id, 0, 'failed', NULL, 0, 0 FROM f WHERE attempt = last AND error IS NOT NULL AND result = 'failed'""".replace(" FROM f WHERE", " FROM f WHERE item[2:]::BIGINT % 10 > 0 AND"), "attempts")
def _(v: Views) -> DataFrame:
    """A tenth of the items ran on local models, whose attempts are no requests."""
    return metrics.attempt_metrics(v.attempts().withColumn("local", F.substring("item", 2, 20).cast("long") % 10 == 0))


query("run_closed", """, r AS (SELECT 'r' || item_id % 20 AS run, status, length(caption) AS input_tokens, CASE WHEN item_id % 3 = 0 THEN item_id END AS output_tokens FROM jobs), n AS (SELECT DISTINCT 'r' || item_id % 25 AS run FROM jobs),
    s AS (SELECT run, count(*) AS total, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, count(*) FILTER (status IN ('succeeded', 'revised')) AS succeeded, count(*) FILTER (status = 'revised') AS revised, count(*) FILTER (status = 'refused') AS refused,
        count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'cancelled') AS cancelled FROM r GROUP BY run)
    SELECT run, coalesce(total, 0) AS total, coalesce(succeeded, 0) AS succeeded, coalesce(revised, 0) AS revised, coalesce(refused, 0) AS refused, coalesce(failed, 0) AS failed, coalesce(skipped, 0) AS skipped, coalesce(cancelled, 0) AS cancelled,
        coalesce(input_tokens, 0)::BIGINT AS input_tokens, coalesce(output_tokens, 0)::BIGINT AS output_tokens, 'completed' AS run_status FROM n LEFT JOIN s USING (run)""", "jobs")(
    lambda v: (lambda run, j: metrics.run_closed(j.select(run(25)), j.select(run(20), "status", F.char_length("caption").cast("long").alias("input_tokens"), F.when(F.col("item_id") % 3 == 0, F.col("item_id")).alias("output_tokens")), "run"))(
        lambda n: F.concat(F.lit("r"), (F.col("item_id") % n).cast("string")).alias("run"), v.jobs()))
query("job_measures", """SELECT count(*) AS total, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, round(avg(ttft_ms) FILTER (key_id IS DISTINCT FROM 'k3'), 4) AS average_ttft_ms,
    round(avg(tokens_per_second) FILTER (key_id IS DISTINCT FROM 'k3'), 4) AS average_tokens_per_second FROM requests""", "requests")(
    lambda v: metrics.job_measures(v.requests().withColumn("key_label", F.when(F.col("key_id") == "k3", "本地模型 wd").otherwise(F.col("key_id")))))
query("merged_usage", """, u AS (SELECT *, CASE WHEN item[2:]::BIGINT % 4 > 0 THEN input_tokens + output_tokens END AS total_tokens, CASE WHEN attempt % 2 = 0 THEN output_tokens * 3 END AS generation_ms FROM attempts)
    SELECT item, batch_id, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(total_tokens)::DOUBLE AS total_tokens, sum(generation_ms)::DOUBLE AS generation_ms, round(arg_max(ttft_ms, attempt) FILTER (ttft_ms IS NOT NULL), 4) AS ttft_ms,
    round(arg_max(tokens_per_second, attempt) FILTER (tokens_per_second IS NOT NULL), 4) AS tokens_per_second FROM u GROUP BY item, batch_id""", "attempts")(
    lambda v: metrics.merged_usage(v.attempts().withColumn("total_tokens", F.when(F.substring("item", 2, 20).cast("long") % 4 > 0, (F.col("input_tokens") + F.col("output_tokens")).cast("double"))).withColumn("generation_ms", F.when(F.col("attempt") % 2 == 0, F.col("output_tokens") * 3.0))))


query("key_counters", FOLLOWED + """ SELECT key_id, count(*) FILTER (NOT goes_on AND result IN ('succeeded', 'revised', 'skipped')) AS succeeded, count(*) FILTER (goes_on OR result NOT IN ('succeeded', 'revised', 'skipped')) AS failed,
    coalesce(sum(input_tokens + output_tokens), 0)::BIGINT AS tokens FROM f WHERE error IS NULL AND key_id IS NOT NULL GROUP BY key_id""", "attempts")(lambda v: metrics.key_counters(v.attempts()))


@query("key_rests", """, e AS (SELECT key_id, id, created_at, attempt, CASE WHEN id % 3 = 0 THEN id % 50 + 0.5 END AS asked, CASE kind WHEN 'click' THEN 'rate_limit' WHEN 'error' THEN CASE id % 4 WHEN 0 THEN 'auth' WHEN 1 THEN 'quota' ELSE 'transient' END END AS error FROM attempts WHERE key_id IS NOT NULL),
    g AS (SELECT key_id, arg_max(created_at + to_milliseconds((1000 * coalesce(asked, CASE WHEN attempt = 0 THEN 5 ELSE 10 END))::BIGINT), id) FILTER (error = 'rate_limit') AS cooldown_until, arg_max(error, id) FILTER (error IN ('auth', 'quota')) AS why FROM e GROUP BY key_id)
    SELECT key_id, cooldown_until, why IS NOT NULL AS disabled, CASE why WHEN 'auth' THEN '认证失败（401/403），Key 已停用' WHEN 'quota' THEN '额度用尽（quota/billing），Key 已停用' END AS disable_reason FROM g""", "attempts")
def _(v: Views) -> DataFrame:
    n = F.col("id")
    error = F.when(F.col("kind") == "click", "rate_limit").when(F.col("kind") == "error", F.when(n % 4 == 0, "auth").when(n % 4 == 1, "quota").otherwise("transient"))
    return streams.key_rests(v.attempts().where("key_id is not null").select("key_id", n.alias("seq"), F.col("created_at").alias("ts"), error.alias("error"), "attempt", F.when(n % 3 == 0, n % 50 + 0.5).alias("retry_after")))


@query("peak_concurrency", """, s AS (SELECT key_id, created_at AS moment, 1 AS step FROM requests WHERE key_id IS NOT NULL UNION ALL SELECT key_id, created_at + INTERVAL 10 MINUTE, -1 FROM requests WHERE key_id IS NOT NULL),
    n AS (SELECT key_id, moment, sum(step) AS net FROM s GROUP BY 1, 2), r AS (SELECT key_id, sum(net) OVER (PARTITION BY key_id ORDER BY moment) AS open FROM n) SELECT key_id, max(open)::BIGINT AS peak FROM r GROUP BY key_id""", "requests")
def _(v: Views) -> DataFrame:
    spans = v.requests().where("key_id is not null").select("key_id", F.col("created_at").alias("start"), (F.col("created_at") + F.expr("INTERVAL 10 MINUTES")).alias("end"))
    return metrics.peak_concurrency(spans, "key_id")


@query("recent_runs", "SELECT rank, batch_id, started_at FROM (SELECT *, row_number() OVER (ORDER BY started_at DESC, batch_id) AS rank FROM (SELECT batch_id, min(created_at) AS started_at FROM requests GROUP BY batch_id)) WHERE rank <= 100", "requests")
def _(v: Views) -> DataFrame:
    runs = v.requests().groupBy("batch_id").agg(F.min("created_at").alias("started_at"))
    order = [F.desc("started_at"), F.asc("batch_id")]
    return runs.orderBy(*order).limit(100).select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), "batch_id", "started_at")


# --- quality of replies ---------------------------------------------------------------------------------------------

_sql = "reply"
for _tag in ("think", "thought", "Thought", "THINK"):
    _sql = f"regexp_replace(regexp_replace({_sql}, '(?s)<{_tag}>.*?</{_tag}>', '', 'g'), '(?s)<{_tag}>.*$', '')"
STRIPPED = UTRIM.format(_sql)
query("strip_think", f"SELECT id, {STRIPPED} AS text FROM responses", "responses")(lambda v: v.responses().select("id", t.without_think(F.col("reply")).alias("text")))


@query("clean_caption", f""", a AS (SELECT id, {STRIPPED} AS x FROM responses),
    b AS (SELECT id, CASE WHEN regexp_matches(x, '(?s)^```.*```$') THEN {UTRIM.format("regexp_replace(regexp_replace(x, '(?s)^```(.*)```$', '\\1'), '^(?:text)+', '')")} ELSE x END AS x FROM a),
    c AS (SELECT id, {UTRIM.format('''regexp_replace(regexp_replace(x, '^"+', ''), '"+$', '')''')} AS x FROM b) SELECT id, {NORMALIZED.format("x")} AS caption FROM c""", "responses")
def _(v: Views) -> DataFrame:
    return v.responses().select("id", t.cleaned(F.col("reply")).alias("caption"))


_quote = lambda p: p.replace("'", "''")
WHITE = r"[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_DECLINES = {
    r"(?i)\bi (?:can(?:not|''t)|am unable to) (?:help|assist|comply|provide|fulfill)": "r1", r"(?i)\bi must (?:decline|refuse)": "r2", r"(?:无法|不能|不便)(?:为你|向你|对此)?(?:协助|帮助|完成|提供|执行|生成|回答)": "r3", r"(?:我必须|需要)(?:拒绝|婉拒)": "r4",
}
_RULE = " ".join(f"WHEN regexp_matches(flat, '{p}') THEN '{p}'" for p in _DECLINES)
_EXCERPT = " ".join(f"WHEN regexp_matches(flat, '{p}') THEN substr(flat, greatest(length(string_split_regex(flat, '{p}')[1]) + 1 - 24, 1), 120)" for p in _DECLINES)
_HINTS = "regexp_matches(flat[1:180], '(?i)(?:抱歉|对不起|很遗憾|i(?:''m| am) sorry|apologies)') AND regexp_matches(flat[1:180], '(?i)(?:无法|不能|不便|拒绝|不可以|can''t|cannot|unable|decline|refuse)')"
_OWN = "contains(lower(flat), 'no way (really)')"


@query("detect_refusal", f""", f AS (SELECT id, structured, trim(regexp_replace(translate(reply, 'Ｉ　ｃａｎｏｔｈｅｌｐ', 'I canothelp'), '{WHITE}+', ' ', 'g')) AS flat FROM responses)
    SELECT id, CASE WHEN structured IS NOT NULL THEN structured {_RULE} WHEN {_HINTS} THEN 'apology+inability' WHEN {_OWN} THEN 'no way (really)' END AS rule,
        CASE WHEN structured IS NOT NULL THEN structured {_EXCERPT} WHEN {_HINTS} THEN flat[1:180] WHEN {_OWN} THEN substr(flat, greatest(strpos(lower(flat), 'no way (really)') - 24, 1), 120) END AS excerpt, structured IS NOT NULL AS structured FROM f""", "responses")
def _(v: Views) -> DataFrame:
    own = (t.RefusalRule("(", regex=True), t.RefusalRule("no way (really)"))
    told = v.responses().select("id", t.refusal(F.col("reply"), F.col("structured"), own).alias("r"))
    return told.select("id", "r.rule", "r.excerpt", F.coalesce("r.structured", F.lit(False)).alias("structured"))


_SHOWN = {
    r"(?i)\bi (?:can(?:not|''t)|am unable to) (?:help|assist|comply|provide|fulfill)": "r1", r"(?i)\bi must (?:decline|refuse)": "r2", r"(?i)\bthis request (?:is not something i can|cannot be)\b": "r3",
    r"(?:无法|不能|不便)(?:为你|向你|对此)?(?:协助|帮助|完成|提供|执行|生成|回答)": "r4", r"(?:我必须|需要)(?:拒绝|婉拒)": "r5", r"(?:该请求|这个请求).{0,16}(?:无法|不能)(?:处理|完成|满足)": "r6",
}
_AT = "length(string_split_regex(flat, '{0}')[1])"
_SHOWN_RULE = " ".join(f"WHEN regexp_matches(flat, '{p}') THEN '{p}'" for p in _SHOWN)
_SHOWN_TEXT = " ".join(f"WHEN regexp_matches(flat, '{p}') THEN substr(flat, greatest({_AT} - 24, 0) + 1, {_AT} + length(regexp_extract(flat, '{p}')) + 48 - greatest({_AT} - 24, 0))".replace("{0}", p) for p in _SHOWN)
_MORE = "CASE id % 7 WHEN 0 THEN 'Sadly this request cannot be ' || reply WHEN 1 THEN '所以该请求暂时无法处理。' || reply WHEN 2 THEN 'this request cannot bear ' || reply ELSE reply END"


@query("shown_refusal", f""", f AS (SELECT id, structured, trim(regexp_replace(translate({_MORE}, 'Ｉ　ｃａｎｏｔｈｅｌｐ', 'I canothelp'), '{WHITE}+', ' ', 'g')) AS flat FROM responses)
    SELECT id, CASE WHEN structured IS NOT NULL THEN structured {_SHOWN_RULE} WHEN {_HINTS} THEN 'apology+inability' END AS rule, CASE WHEN structured IS NOT NULL THEN structured {_SHOWN_TEXT} WHEN {_HINTS} THEN flat[1:180] END AS excerpt, structured IS NOT NULL AS structured FROM f""", "responses")
def _(v: Views) -> DataFrame:
    told = v.responses().select("id", t.shown_refusal(F.expr(_MORE), F.col("structured")).alias("r"))
    return told.select("id", "r.rule", "r.excerpt", F.coalesce("r.structured", F.lit(False)).alias("structured"))


query("length_drop", "SELECT id, length(reply) * 2 < length(original) AND original <> '' AS dropped FROM responses", "responses")(lambda v: v.responses().select("id", t.length_drop(F.col("original"), F.col("reply")).alias("dropped")))


_SAYS = """CASE item_id % 8 WHEN 0 THEN '**DECISION：KEEP**' || chr(10) || chr(10) || '**REASON：' || reason || '**' || chr(10) || 'SCORE: 85.5' WHEN 1 THEN 'decision: reject' || chr(13) || chr(10) || 'sharp ' || reason WHEN 2 THEN 'KEEP'
    WHEN 3 THEN 'REJECT' || chr(10) || 'score: 101' || chr(10) || 'n: 1e1' WHEN 4 THEN 'MAYBE' || chr(10) || reason || chr(10) || '5' WHEN 5 THEN ' Keep ' || chr(10) || 'Reason:' || chr(10) || 'Score: ' || coalesce(score::VARCHAR, 'none') WHEN 6 THEN '' ELSE 'x：y: keep' || chr(10) || 'a' || chr(10) || '-1' END"""
_VALUE = "CASE WHEN contains({0}, ':') THEN " + UTRIM.format("substr({0}, strpos({0}, ':') + 1)") + " WHEN contains({0}, '：') THEN " + UTRIM.format("substr({0}, strpos({0}, '：') + 1)") + " ELSE {0} END"


@query("parse_decision", f""", l AS (SELECT item_id, list_filter(list_transform(string_split(replace({_SAYS}, '**', ''), chr(10)), lambda x: {UTRIM.format("x")}), lambda x: x <> '') AS l FROM decisions),
    p AS (SELECT item_id, upper({_VALUE.format("l[1]")}) AS verdict, {_VALUE.format("l[2]")} AS said, {_VALUE.format("l[3]")} AS number FROM l), q AS (SELECT *, verdict IS NOT DISTINCT FROM 'KEEP' AS yes, coalesce(verdict IN ('KEEP', 'REJECT'), false) AS good, TRY_CAST(number AS DOUBLE) AS n FROM p)
    SELECT item_id, CASE WHEN good THEN yes END AS keep, CASE WHEN good THEN CASE WHEN coalesce(said, '') <> '' THEN said WHEN yes THEN '符合筛选要求' ELSE '不符合筛选要求' END END AS reason, CASE WHEN good AND n BETWEEN 0 AND 100 THEN n END AS score, NOT good AS error FROM q""", "decisions")
def _(v: Views) -> DataFrame:
    says = F.expr(_SAYS.replace("::VARCHAR", "::STRING"))  # the same words in both dialects
    return v.decisions().select("item_id", t.decision(says).alias("d")).select("item_id", "d.*")


# --- security -------------------------------------------------------------------------------------------------------

# Rows that each pattern of redaction and scan takes or leaves.
_SAMPLES = ("Authorization: Bearer abcdefgh12345678 end", "bearer short", "key: abcd1234, next", "monkey business", "X-Goog-Api-Key=AbCdEf;x", "http://h/p?apikey=s3cret&x=1", "http://h/p?sig=s3cret", "use sk-abcdefghijkl_-1 now", "use sk-short now", "AIzaSyA0123456789_abcdefghij", "AIza123",
            "eyJhbGciOiJIUzI1NiIsInR5cCI6.eyJzdWIiOiIx.SflKxwRJSMeK", "eyJhbGci.eyJ.Sfl", "API-KEY = 'abcdefghijklmnop1'", "token: ••••abcdefghijklmnop", "token=PLACEHOLDER_abcdefghij")
_sampled = "(SELECT doc_id, list_value(" + ", ".join(f"'{_quote(x)}'" for x in _SAMPLES) + f")[(doc_id % {len(_SAMPLES)} + 1)::INT] || chr(10) || text AS text, source || '/' || doc_id AS path FROM documents)"


def sampled(v: Views) -> DataFrame:
    some = F.element_at(F.array(*map(F.lit, _SAMPLES)), (F.col("doc_id") % len(_SAMPLES) + 1).cast("int"))
    return v.table("documents").select("doc_id", F.concat(some, F.lit("\n"), "text").alias("text"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))


_INNER = WHITE[1:-1]
_red = f"""regexp_replace(regexp_replace(regexp_replace({{}}, '(?i)(bearer{WHITE}+)[A-Za-z0-9._~+/=-]{{8,}}', '\\1••••', 'g'), '(?i)((?:api[_-]?key|x-api-key|authorization|x-goog-api-key|token|key)[{_INNER}:=]+)[^{_INNER},;]+', '\\1••••', 'g'),
    '(?i)([?&](?:key|api_key|apikey|x-api-key|token|access_token|signature)=)[^&{_INNER}]+', '\\1••••', 'g')""".replace("{{8,}}", "{8,}")
query("redact_text", f"SELECT doc_id, {_red.replace('{}', 'text')} AS text FROM {_sampled}")(lambda v: sampled(v).select("doc_id", t.redacted(F.col("text")).alias("text")))
_URL = "url || '&access_token=t' || page_id || '&signature=x'"
query("redact_urls", f"SELECT page_id, {_red.replace('{}', _URL)} AS url FROM pages")(
    lambda v: v.table("pages").select("page_id", t.redacted(F.concat("url", F.lit("&access_token=t"), F.col("page_id").cast("string"), F.lit("&signature=x"))).alias("url")))

# The oracle's own copy of the scan's patterns.
_SCAN = (r"\bsk-[A-Za-z0-9_\-]{12,}\b", r"\bAIza[0-9A-Za-z_\-]{20,}\b", r"\beyJ[A-Za-z0-9_\-]{20,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\b", r"""(?i)\b(?:api[_-]?key|token)\s*[:=]\s*['\"]?[A-Za-z0-9_\-]{16,}""")
_hits = "SELECT path, pattern, hit FROM (" + " UNION ALL ".join(f"SELECT path, '{_quote(p)}' AS pattern, unnest(regexp_extract_all(text, '{_quote(p)}')) AS hit FROM {_sampled} WHERE path <> 'src0/0'" for p in _SCAN) + ") WHERE NOT contains(hit, '••••') AND NOT contains(hit, 'masked') AND NOT contains(hit, 'PLACEHOLDER')"
query("secret_scan", _hits)(lambda v: t.secret_hits(sampled(v), ("src0/0",)))
query("secret_scan_summary", f"SELECT count(*) AS hits, count(DISTINCT path) AS failing, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ({_hits})")(lambda v: t.scan_verdict(t.secret_hits(sampled(v), ("src0/0",))))


_NAMES = ("Authorization", "Proxy-Authorization", "X-Api-Key", "api-key", "apikey", "X-Goog-Api-Key", "x-auth-token", "My-Token-Id", "client-SECRET", "Accept", "Cookie", "Key")


@query("mask_headers", "SELECT s_suppkey, name, CASE WHEN lower(name) IN ('authorization', 'proxy-authorization', 'x-api-key', 'api-key', 'apikey', 'x-goog-api-key', 'x-auth-token') OR contains(lower(name), 'token') OR contains(lower(name), 'secret') THEN '••••' || right(s_name, 4) ELSE s_name END AS value FROM (SELECT s_suppkey, s_name, unnest(['Authorization', 'Proxy-Authorization', 'X-Api-Key', 'api-key', 'apikey', 'X-Goog-Api-Key', 'x-auth-token', 'My-Token-Id', 'client-SECRET', 'Accept', 'Cookie', 'Key']) AS name FROM supplier)")
def _(v: Views) -> DataFrame:
    headers = F.create_map(*[x for n in _NAMES for x in (F.lit(n), F.col("s_name"))])
    return v.table("supplier").select("s_suppkey", F.explode(files.masked_headers(headers)).alias("name", "value"))


_TENSORS = """'"w":{"dtype":"F32","shape":[1, ' || event_id || '],"data_offsets":[0,8]},"k \\"q\\" é":{"shape":[],"dtype":"F16","data_offsets":[8,10],"note":1.50}}'"""
_HEADER = f"""CASE event_id % 6 WHEN 0 THEN '{{"__metadata__":{{"b":"1","A":"2","a":"3"}},' || {_TENSORS} WHEN 1 THEN '{{' || {_TENSORS} WHEN 2 THEN 'broken' WHEN 3 THEN '{{"w":1}}'
    WHEN 4 THEN '{{"__metadata__":{{}},"w":{{"dtype":"F32","shape":[1],"data_offsets":[4]}}}}' ELSE props END"""
HEADERS = f"WITH h AS (SELECT event_id AS path, {_HEADER} AS header, {_TENSORS} AS tensors, props FROM events)"


def headers(v: Views) -> DataFrame:
    return v.table("events").select(F.col("event_id").alias("path"), F.expr(_HEADER.replace("\\", "\\\\")).alias("header"), F.encode("props", "UTF-8").alias("payload"))  # the same words in both dialects


query("metadata_report", HEADERS + """ SELECT path, path % 6 = 0 AS metadata_present, CASE WHEN path % 6 = 0 THEN 'A,a,b' ELSE '' END AS keys, CASE WHEN path % 6 = 0 THEN 3 ELSE 0 END::BIGINT AS metadata_count,
    CASE WHEN path % 6 < 2 THEN 2 ELSE 0 END::BIGINT AS tensors, CASE WHEN path % 6 = 2 THEN 'malformed header' WHEN path % 6 > 2 THEN 'not a tensor' END AS error FROM h""")(lambda v: files.metadata_report(headers(v)))
# descriptors keep their values and order; blanks between them go, and 1.50 is written 1.5
query("metadata_strip", HEADERS + """ SELECT path, CASE WHEN path % 6 = 0 THEN '{' || replace(replace(tensors, '[1, ', '[1,'), '1.50', '1.5') ELSE header END AS header, CASE path % 6 WHEN 0 THEN 'sanitized' WHEN 1 THEN 'already_clean' ELSE 'error' END AS status,
    CASE WHEN path % 6 = 0 THEN 3 ELSE 0 END::BIGINT AS removed, path % 6 < 2 AS verified, sha256(props) AS payload_sha256 FROM h""")(lambda v: files.stripped(headers(v)))
query("strip_candidates", "SELECT event_id AS path FROM events WHERE event_id % 6 = 0")(lambda v: files.metadata_report(headers(v)).where("metadata_present AND error IS NULL").select("path"))


@query("log_format", f"SELECT event_id, '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] [' || upper(event_type) || '] [run] ' || {_red.replace('{}', 'message')} AS line FROM (SELECT *, 'token=abcdefgh' || event_id || ' done' AS message FROM events)")
def _(v: Views) -> DataFrame:
    entries = v.table("events").select("event_id", F.col("ts").alias("timestamp"), F.col("event_type").alias("level"), F.lit("run").alias("scope"), F.concat(F.lit("token=abcdefgh"), F.col("event_id").cast("string"), F.lit(" done")).alias("message"))
    return entries.select("event_id", files.log_lines(entries).alias("line"))


# --- sampling and selection -----------------------------------------------------------------------------------------


@query("random_sample", "SELECT item_id FROM captions ORDER BY md5(item_id::VARCHAR || 's1'), item_id LIMIT 100", "captions")
def _(v: Views) -> DataFrame:
    return sampling.random_sample(v.captions(), 100, "s1").select("item_id")


query("sample_rest", "SELECT item_id, row_number() OVER (ORDER BY md5(item_id::VARCHAR || 's1'), item_id) <= 100 AS sampled FROM captions", "captions")(lambda v: sampling.sampled_and_rest(v.captions(), 100, "s1").select("item_id", "sampled"))


@query("sample_split", "SELECT item_id, CASE WHEN item_id % 4 = 1 THEN 'kept' ELSE 'rest' END AS bucket FROM captions", "captions")
def _(v: Views) -> DataFrame:
    return sampling.split(v.captions(), v.captions().where("item_id % 4 = 1").select(F.upper("caption_path").alias("caption_path")))


@query("dedupe_paths", "SELECT min(doc_id) AS item_id FROM documents GROUP BY lower(CASE WHEN doc_id % 2 = 0 THEN source ELSE upper(source) END || '/' || (doc_id % 100))")
def _(v: Views) -> DataFrame:
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.upper("source")), F.lit("/"), (F.col("doc_id") % 100).cast("string"))
    return sampling.dedupe_paths(v.table("documents").select(F.col("doc_id").alias("item_id"), name.alias("caption_path"))).select("item_id")


SCORE = "coalesce(score, CASE WHEN keep THEN 50 ELSE 0 END)::DOUBLE"
RANKED = f", t AS (SELECT * REPLACE (score + item_id % 10 / 10.0::DOUBLE AS score) FROM decisions) SELECT round, rank, item_id, s AS score, keep FROM (SELECT *, {SCORE} AS s, row_number() OVER (PARTITION BY round ORDER BY {SCORE} DESC, keep DESC, {NATURAL}, item_id) AS rank FROM t) WHERE rank <= 50"
query("ai_final_rank", RANKED, "decisions")(lambda v: sampling.final_ranking(v.decisions().withColumn("score", F.col("score") + F.col("item_id") % 10 / 10.0), 50))
query("ai_next_round", "SELECT item_id, round + 1 AS round FROM decisions WHERE round = 0 AND keep AND (SELECT count(*) FROM decisions WHERE round = 0 AND keep) > 20", "decisions")(lambda v: sampling.next_round(v.decisions(), 0, 20))


_BOXES = "['d/', 'd/.selected/', 'd/.rejected/', 'e/'][(doc_id % 4 + 1)::INT] || CASE WHEN doc_id % 12 = 0 THEN 'alone' || doc_id ELSE 'of/' || doc_id // 4 END || '.png'"
_ACTION = "['keep', 'reject', 'return', 'reset'][(doc_id // 4 % 4 + 1)::INT]"


@query("relocations", f"""WITH i AS (SELECT doc_id, {_BOXES} AS path, {_ACTION} AS action FROM documents),
    o AS (SELECT path, arg_min(action, doc_id) AS action, min(doc_id) AS n FROM i GROUP BY path),
    x AS (SELECT path, action, n, CASE WHEN path LIKE 'd/%' AND (action IN ('keep', 'reject') OR path LIKE 'd/.%') THEN 'd/' || CASE action WHEN 'keep' THEN '.selected/' WHEN 'reject' THEN '.rejected/' ELSE '' END || regexp_replace(path, '^d/([.]selected/|[.]rejected/)?', '') END AS target FROM o),
    f AS (SELECT path FROM o UNION SELECT replace(path, '.png', '.txt') FROM o WHERE n % 3 = 0),
    y AS (SELECT *, EXISTS (SELECT 1 FROM f WHERE f.path = x.target) AS there, EXISTS (SELECT 1 FROM f WHERE f.path = replace(x.path, '.png', '.txt')) AS own, EXISTS (SELECT 1 FROM f WHERE f.path = replace(x.target, '.png', '.txt')) AS taken FROM x),
    s AS (SELECT *, CASE WHEN target IS NULL THEN 'outside' WHEN target = path THEN 'same' WHEN there OR (taken AND (own OR action = 'reset')) THEN 'blocked' ELSE 'moved' END AS status FROM y),
    r AS (SELECT *, row_number() OVER (PARTITION BY target, status ORDER BY NOT contains(path, '/.selected/'), path) AS turn FROM s)
    SELECT path, action, target, CASE WHEN own THEN replace(target, '.png', '.txt') END AS caption_target, CASE WHEN status = 'moved' AND turn > 1 THEN 'blocked' ELSE status END AS status FROM r""")
def _(v: Views) -> DataFrame:
    n = F.col("doc_id")
    pick = lambda at, *values: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    path = F.concat(pick(n % 4, "d/", "d/.selected/", "d/.rejected/", "e/"), F.when(n % 12 == 0, F.concat(F.lit("alone"), n.cast("string"))).otherwise(F.concat(F.lit("of/"), F.floor(n / 4).cast("string"))), F.lit(".png"))
    images = v.table("documents").groupBy(path.alias("path")).agg(F.min_by(pick(F.floor(n / 4) % 4, "keep", "reject", "return", "reset"), "doc_id").alias("action"), F.min("doc_id").alias("n"))
    texts = images.where("n % 3 = 0").select(sampling.caption_of(F.col("path")).alias("path"))
    return sampling.relocations(images.select("path", "action"), images.select("path").unionByName(texts), "d")


query("retention_deletions", "SELECT name, grp FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY name DESC) AS rank FROM (SELECT caption_path AS name, item_id % 5 AS grp FROM captions)) WHERE rank > 20", "captions")(
    lambda v: sampling.retention_deletions(v.captions().select(F.col("caption_path").alias("name"), (F.col("item_id") % 5).alias("grp")), 20, "grp"))


@query("retention_plan", "SELECT name, grp, rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY name DESC) AS rank FROM (SELECT caption_path AS name, item_id % 5 AS grp FROM captions)) WHERE rank > 20", "captions")
def _(v: Views) -> DataFrame:
    return sampling.retention_plan(v.captions().select(F.col("caption_path").alias("name"), (F.col("item_id") % 5).alias("grp")), 20, "grp")


# --- scores, grids, replies -----------------------------------------------------------------------------------------


@query("score_tags", """
    WITH l AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS index, CASE WHEN p_partkey > 3 THEN replace(p_name, ' ', '_') || '_' || p_partkey END AS name FROM part WHERE p_partkey < 64),
    s AS (SELECT vec_id AS item_id, unnest(list_transform(embedding, lambda x: 1 / (1 + exp(-x::DOUBLE)))) AS p, unnest(range(0, 64)) AS index FROM embeddings),
    r AS (SELECT item_id, name, row_number() OVER (PARTITION BY item_id ORDER BY p DESC, index) AS n FROM s JOIN l USING (index) WHERE p >= 0.53 AND name IS NOT NULL)
    SELECT item_id, string_agg(replace(name, '_', ' '), ', ' ORDER BY n) AS tags, count(*) AS n_tags FROM r WHERE n <= 5 GROUP BY item_id""")
def _(v: Views) -> DataFrame:
    part = v.table("part").where("p_partkey < 64")
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"))
    labels = part.select(F.col("p_partkey").cast("int").alias("index"), F.when(F.col("p_partkey") > 3, name).alias("name"))
    return scores.score_tags(v.table("embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("scores")), labels, 0.53, 5)


@query("label_table", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS index, CASE WHEN p_partkey > 4 AND p_partkey % 5 > 0 THEN replace(p_name, ' ', '_') || ',' || p_partkey END AS name, CASE WHEN p_partkey <= 4 THEN '9' WHEN p_partkey % 5 = 0 THEN '1' WHEN p_partkey % 2 = 0 THEN '0' ELSE '4' END AS category FROM part WHERE p_partkey < 64")
def _(v: Views) -> DataFrame:
    """One model's label file: a row for each of the slots of an embedding."""
    target = f"{scratch(v)}/labels"
    label_rows(v).coalesce(1).sortWithinPartitions("tag_id").select(F.col("tag_id").cast("string"), "name", "category", "count").write.csv(target, header=True, quote='"', escape='"')
    return files.label_table(v.spark, target)


def label_rows(v: Views) -> DataFrame:
    k = F.col("p_partkey")
    category = F.when(k <= 4, "9").when(k % 5 == 0, "1").when(k % 2 == 0, "0").otherwise("4")
    return v.table("part").where(k < 64).select(k.alias("tag_id"), F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit(","), k.cast("string")).alias("name"), category.alias("category"), F.lit("5").alias("count"))


@query("score_tags_shifted", """
    WITH l AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS index, CASE WHEN p_partkey > 3 THEN replace(p_name, ' ', '_') || '_' || p_partkey END AS name FROM part WHERE p_partkey < 64),
    s AS (SELECT vec_id AS item_id, unnest(list_transform(embedding[1:CASE WHEN vec_id % 2 = 0 THEN 60 ELSE 64 END], lambda x: 1 / (1 + exp(-x::DOUBLE)))) AS p, unnest(range(0, CASE WHEN vec_id % 2 = 0 THEN 60 ELSE 64 END)) + CASE WHEN vec_id % 2 = 0 THEN 4 ELSE 0 END AS index FROM embeddings),
    r AS (SELECT item_id, name, row_number() OVER (PARTITION BY item_id ORDER BY p DESC, index) AS n FROM s JOIN l USING (index) WHERE p >= 0.53 AND name IS NOT NULL)
    SELECT item_id, string_agg(name, ', ' ORDER BY n) AS tags, count(*) AS n_tags FROM r WHERE n <= 5 GROUP BY item_id""")
def _(v: Views) -> DataFrame:
    """64 labels with four ratings at the head: every second vector has no slots for them."""
    k = F.col("p_partkey")
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), k.cast("string"))
    labels = v.table("part").where(k < 64).select(k.cast("int").alias("index"), F.when(k > 3, name).alias("name"), F.when(k <= 3, "9").otherwise("0").alias("category"))
    vectors = v.table("embeddings").select(F.col("vec_id").alias("item_id"), F.slice("embedding", F.lit(1), F.when(F.col("vec_id") % 2 == 0, 60).otherwise(64)).alias("scores"))
    return scores.score_tags(scores.shifted(vectors, labels), labels.select("index", "name"), 0.53, 5, underscores=True)


_STEPS = """CASE kind WHEN 'character' THEN CASE WHEN images < 15 THEN 800 WHEN images <= 30 THEN 1000 WHEN images <= 60 THEN 1200 WHEN images <= 120 THEN 1400 ELSE 1600 END WHEN 'style' THEN CASE WHEN images < 30 THEN 1200 WHEN images <= 80 THEN 1500 WHEN images <= 200 THEN 1800 ELSE 2000 END
    WHEN 'concept' THEN CASE WHEN images < 15 THEN 700 WHEN images <= 40 THEN 900 WHEN images <= 100 THEN 1200 ELSE 1500 END ELSE CASE WHEN images < 20 THEN 650 WHEN images <= 60 THEN 850 WHEN images <= 150 THEN 1100 ELSE 1300 END END"""


@query("training_grid", f""", g AS (SELECT source || '-' || doc_id % 24 AS grp, greatest(1, least(100000, count(*))) AS images, ['character', 'style', 'concept', 'pose'][(min(doc_id) % 24 % 4 + 1)::INT] AS kind, [1, 2, 4][(min(doc_id) % 24 % 3 + 1)::INT] AS batch, ['conservative', 'balanced', 'strong'][(min(doc_id) % 24 // 4 % 3 + 1)::INT] AS strength FROM documents GROUP BY source || '-' || doc_id % 24),
    w AS (SELECT *, greatest(400, least(2200, floor({_STEPS} * CASE strength WHEN 'conservative' THEN 0.8::DOUBLE WHEN 'strong' THEN 1.15::DOUBLE ELSE 1::DOUBLE END / 25 + 0.5) * 25))::BIGINT AS target_steps, CASE kind WHEN 'style' THEN 25 WHEN 'concept' THEN 12 ELSE 10 END AS usual,
        CASE WHEN images < 15 THEN 20 WHEN images < 30 THEN 12 WHEN images < 60 THEN 8 WHEN images < 120 THEN 4 ELSE 2 END AS free FROM g),
    x AS (SELECT w.*, r.r AS repeats, e.e AS epochs, greatest(1, ceil(images * r.r / batch::DOUBLE))::BIGINT AS steps_per_epoch FROM w, range(1, 21) r(r), range(4, 31) e(e)),
    y AS (SELECT *, steps_per_epoch * epochs AS steps, abs(steps_per_epoch * epochs - target_steps) / target_steps::DOUBLE + abs(epochs - usual) * 0.0025::DOUBLE + repeats * CASE kind WHEN 'style' THEN 0.0035::DOUBLE ELSE 0.0018::DOUBLE END + CASE WHEN repeats > free THEN (repeats - free) * 0.04::DOUBLE ELSE 0::DOUBLE END AS score FROM x)
    SELECT grp, images, target_steps, repeats, epochs, steps_per_epoch, steps FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score, repeats, epochs) AS n FROM y) WHERE n = 1""", "decisions")
def _(v: Views) -> DataFrame:
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    turn = F.min("doc_id") % 24
    groups = v.table("documents").groupBy(F.concat("source", F.lit("-"), (F.col("doc_id") % 24).cast("string")).alias("grp")).agg(
        F.count("*").alias("images"), pick(turn % 4, "character", "style", "concept", "pose").alias("kind"), pick(turn % 3, 1, 2, 4).alias("batch"), pick(F.floor(turn / 4) % 3, "conservative", "balanced", "strong").alias("strength"))
    return scores.training_grid(groups)


def reply_lines(v: Views) -> DataFrame:
    """Each conversation as the lines of a streamed reply, from three services and in several shapes: pieces as strings, arrays
    and objects, values over several lines, a whole message at the end, usage, failures and, mostly, an end mark."""
    n = F.col("conv_id")
    provider = F.element_at(F.array(*map(F.lit, ("openai", "anthropic", "gemini"))), (n % 3 + 1).cast("int"))
    c = v.table("conversations").select(F.concat(F.lit("r"), n.cast("string")).alias("request_id"), provider.alias("provider"), "conv_id", (F.col("turn") * 2).alias("seq"), "text")
    quoted = F.regexp_extract(F.to_json(F.array("text")), r"(?s)^\[(.*)\]$", 1)
    content = F.when(F.col("seq") % 3 == 0, quoted).when(F.col("seq") % 3 == 1, F.concat(F.lit('["", {"text":'), quoted, F.lit("}]"))).otherwise(F.concat(F.lit('{"content":'), quoted, F.lit("}")))
    openai = F.concat(F.lit('data: {"choices":[{"delta":{"content":'), content, F.lit("}}]}"))
    anthropic = F.concat(F.lit('data: {"type":"content_block_delta","delta":{"text":'), quoted, F.lit("}}"))
    gemini = F.concat(F.lit('[{"candidates":[{"content":{"parts":[{"text":'), quoted, F.lit("}]}}]}]"))
    piece = c.select("request_id", "provider", "seq", F.when(n % 3 == 0, openai).when(n % 3 == 1, anthropic).otherwise(gemini).alias("line"))
    noise = c.select("request_id", "provider", (F.col("seq") + 1).alias("seq"), F.lit(": keep-alive").alias("line"))

    def end(at: int, line: Column, where: str = "true") -> DataFrame:
        return c.where("seq = 0").where(where).select("request_id", "provider", F.lit(100_000 + at).cast("long").alias("seq"), line.alias("line"))

    reason = F.when(n % 21 == 0, "length").when(n % 6 == 3, "content_filter").otherwise("stop")
    used = F.concat(F.lit('data: {"usage":{"prompt_tokens":'), n.cast("string"), F.lit(',"completion_tokens":2},"choices":[{"finish_reason":"'), reason, F.lit('"}]}'))
    whole = F.lit('data: {"choices":[{"message":{"content":"never taken twice"}}]}')
    stop = F.concat(F.lit('data: {"delta":{"stop_reason":"'), F.when(n % 7 == 0, "max_tokens").when(n % 7 == 1, "refusal").otherwise("end_turn"), F.lit('"},"usage":{"output_tokens":3},"message":{"usage":{"input_tokens":'), n.cast("string"), F.lit("}}}"))
    first, second = F.lit('{"usageMetadata":{"promptTokenCount":5,'), F.concat(F.lit('"candidatesTokenCount":6,"totalTokenCount":'), n.cast("string"), F.lit('},"candidates":[{"finishReason":"'), F.when(n % 5 == 0, "SPII").when(n % 5 == 1, "MODEL_LENGTH").otherwise("STOP"), F.lit('"}]}'))
    ends = [end(0, used, "conv_id % 3 = 0"), end(1, whole, "conv_id % 3 = 0"), end(2, F.lit("data: [DONE]"), "conv_id % 3 = 0 AND conv_id % 4 > 0"), end(0, stop, "conv_id % 3 = 1"), end(1, F.lit("event: message_stop"), "conv_id % 3 = 1 AND conv_id % 4 > 0"), end(0, first, "conv_id % 3 = 2"), end(1, second, "conv_id % 3 = 2"), end(3, F.lit('data: {"error":{"message":"overloaded"}}'), "conv_id % 11 = 5")]
    out = piece.unionByName(noise)
    for more in ends:
        out = out.unionByName(more)
    return out


_REPLIES = "WITH r AS (SELECT conv_id AS n, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"
_HELD = "CASE WHEN n % 3 = 0 AND n % 21 <> 0 AND n % 6 = 3 THEN 'content_filter' WHEN n % 3 = 1 AND n % 7 = 1 THEN 'refusal' WHEN n % 3 = 2 AND n % 5 = 0 THEN 'SPII' END"


@query("response_reassembly", _REPLIES + f""" SELECT 'r' || n AS request_id, text, {_HELD} AS structured, CASE WHEN n % 11 = 5 THEN 'failed' WHEN n % 21 = 0 OR (n % 3 = 1 AND n % 7 = 0) OR (n % 3 = 2 AND n % 5 = 1) THEN 'length'
    WHEN n % 3 < 2 AND n % 4 = 0 AND text <> '' THEN 'cut' WHEN {_HELD} IS NOT NULL THEN 'refused' WHEN text = '' THEN 'empty' ELSE 'ok' END AS outcome FROM r""")
def _(v: Views) -> DataFrame:
    return responses.reassembled(reply_lines(v)).drop("caption")


query("response_outcome", _REPLIES + f""", o AS (SELECT CASE WHEN n % 11 = 5 THEN 'failed' WHEN n % 21 = 0 OR (n % 3 = 1 AND n % 7 = 0) OR (n % 3 = 2 AND n % 5 = 1) THEN 'length' WHEN n % 3 < 2 AND n % 4 = 0 AND text <> '' THEN 'cut' WHEN {_HELD} IS NOT NULL THEN 'refused' WHEN text = '' THEN 'empty' ELSE 'ok' END AS outcome FROM r)
    SELECT outcome, count(*) AS replies FROM o GROUP BY outcome""")(lambda v: responses.reassembled(reply_lines(v)).groupBy("outcome").agg(F.count("*").alias("replies")))
query("response_usage", """SELECT DISTINCT 'r' || conv_id AS request_id, CASE WHEN conv_id % 3 = 2 THEN 5 ELSE conv_id END AS input_tokens, CASE conv_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 6 END::BIGINT AS output_tokens,
    CASE conv_id % 3 WHEN 0 THEN conv_id + 2 WHEN 1 THEN conv_id + 3 ELSE conv_id END AS total_tokens FROM conversations""")(lambda v: responses.usage(reply_lines(v)))


query("catalogue_search", "SELECT p_partkey FROM part WHERE contains(lower(p_brand), 'brand#1') OR contains(lower(p_name), 'brand#1')")(lambda v: v.table("part").where(jobs.has(" BRAND#1 ", "p_brand", "p_name")).select("p_partkey"))


@query("ttft_metrics", """SELECT 'u' || user_id AS request_id, min(ts) FILTER (event_type <> 'view') AS first_token, round(epoch(min(ts) FILTER (event_type <> 'view')) - epoch(min(ts)), 3) AS ttft_s,
    round(CASE WHEN max(ts) > min(ts) FILTER (event_type <> 'view') THEN max(event_id) / (epoch(max(ts)) - epoch(min(ts) FILTER (event_type <> 'view'))) END, 4) AS tokens_per_second FROM events GROUP BY user_id""")
def _(v: Views) -> DataFrame:
    return responses.first_tokens(v.table("events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("request_id"), "ts", (F.col("event_type") != "view").alias("adds"), F.col("event_id").alias("tokens")))


_FOCUS = "['按用户条件建立稳定、不过度苛刻的基础门槛', '额外淘汰轻微模糊、轻微遮挡、边缘裁切或主体不够突出的图片', '进一步要求构图、光照、主体完整度和细节表现明显优于普通候选', '进一步淘汰细小结构错误、轻度压缩痕迹、背景干扰和相似度过高的候选', '只保留审美、清晰度、结构正确性和训练价值均较强的候选', '只保留没有明显短板、可作为数据集核心样本的候选', '要求候选在当前批次中达到优秀水平，而不仅是合格', '要求候选达到高质量精选水平', '只保留极少数最符合要求且训练价值最高的候选', '采用最高门槛，只保留当前候选中的顶级样本']"


@query("round_prompt", f""", x AS (SELECT item_id, item_id % 13 AS round, item_id % 40 AS target, coalesce(score, 0) AS candidates FROM decisions)
    SELECT item_id, CASE WHEN target > 0 AND candidates > 0 THEN '本轮为第 ' || round || ' 轮，当前候选 ' || candidates || ' 张，最终目标保留 ' || target || ' 张。' || CASE WHEN round = 1 THEN '本轮建立基础门槛' ELSE '相较上一轮严格程度提高 ' || (round - 1) || ' 级' END
        || '；本轮重点：' || ({_FOCUS})[least(10, greatest(1, round))::INT] || '。本轮应优先拉开评分差距，保留约 ' || least(100, greatest(1, floor(target / candidates * 100 + 0.5)))::INT || '% 的最佳候选。' END AS prompt FROM x""", "decisions")
def _(v: Views) -> DataFrame:
    return v.decisions().select("item_id", scores.round_prompt(F.col("item_id") % 13, F.col("item_id") % 40, F.coalesce("score", F.lit(0))).alias("prompt"))


# --- streams and their batch twins ----------------------------------------------------------------------------------


def job_events(events: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "signup", "revised").when(F.col("event_type") == "error", "failed").otherwise("running")
    return events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("item"), F.col("event_id").alias("seq"), status.alias("status"), F.date_format("ts", "yyyy-MM-dd").alias("batch_id"))


_STATUS = "CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'signup' THEN 'revised' WHEN 'error' THEN 'failed' ELSE 'running' END"
_JOBS = f"SELECT 'u' || user_id AS item, arg_max({_STATUS}, event_id) AS status, count(*) FILTER (event_type = 'signup') AS revisions, count(*) AS events FROM events GROUP BY 1"
query("job_state_batch", _JOBS)(lambda v: streams.job_states_batch(job_events(v.table("events"))))


def scratch(v: Views) -> str:
    import tempfile
    import uuid

    named = v.spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not v.spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tagloom-')}"
    return f"{named.rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("job_state_stream", _JOBS)
def _(v: Views) -> DataFrame:
    out = streams.drained(streams.job_states(job_events(streams.event_stream(v.spark, f"{v.sf_dir}/event[s].parquet"))), "jobs", "update", scratch(v))
    return versions.latest(out, "item", F.col("__batch").desc()).select("item", "status", "revisions", "events")


@query("run_progress", f"SELECT strftime(ts, '%Y-%m-%d') AS batch_id, count(*) AS total, count(*) FILTER ({_STATUS} <> 'running') AS finished FROM events GROUP BY 1")
def _(v: Views) -> DataFrame:
    out = streams.drained(streams.run_progress(job_events(streams.event_stream(v.spark, f"{v.sf_dir}/event[s].parquet"))), "progress", "update", scratch(v))
    return versions.latest(out, "batch_id", F.col("__batch").desc()).select("batch_id", "total", "finished")


@query("log_stream", "SELECT strftime(ts, '%Y-%m-%d') AS batch_id, 'info' AS level, props AS message FROM events WHERE event_type = 'error'")
def _(v: Views) -> DataFrame:
    events = streams.event_stream(v.spark, f"{v.sf_dir}/event[s].parquet").select(F.date_format("ts", "yyyy-MM-dd").alias("batch_id"), F.when(F.col("event_type") == "error", "log").alias("type"), F.lit(None).cast("string").alias("level"), F.col("props").alias("message"))
    return streams.drained(streams.log_stream(events), "logs", "append", scratch(v)).drop("__batch")


@query("log_stream_redacted", f"SELECT strftime(ts, '%Y-%m-%d') AS batch_id, CASE WHEN event_id % 2 = 0 THEN 'warn' ELSE 'info' END AS level, {_red.replace('{}', 'said')} AS message FROM (SELECT *, 'key: abcd' || event_id || ', Bearer 0123456789 ' || props AS said FROM events) WHERE event_type = 'error'")
def _(v: Views) -> DataFrame:
    n = F.col("event_id")
    said = F.concat(F.lit("key: abcd"), n.cast("string"), F.lit(", Bearer 0123456789 "), F.col("props"))
    events = streams.event_stream(v.spark, f"{v.sf_dir}/event[s].parquet").select(F.date_format("ts", "yyyy-MM-dd").alias("batch_id"), F.when(F.col("event_type") == "error", "log").alias("type"), F.when(n % 2 == 0, "warn").alias("level"), said.alias("message"))
    return streams.drained(streams.log_stream(events), "logs", "append", scratch(v)).drop("__batch")


_HOURS = "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM (SELECT DISTINCT ON (event_id) * FROM events) WHERE ts IS NOT NULL GROUP BY 1, 2"
query("hourly_batch", _HOURS)(lambda v: streams.hourly_batch(v.table("events")))


@query("hourly_stream", _HOURS)
def _(v: Views) -> DataFrame:
    out = streams.drained(streams.hourly(streams.event_stream(v.spark, f"{v.sf_dir}/event[s].parquet"), late=None), "hourly", "update", scratch(v))
    return out.groupBy("hour", "event_type").agg(F.max_by("n", "__batch").alias("n"))


from tagloom import catalogue_live, catalogue_more  # noqa: E402, F401  these register themselves with what stands above
