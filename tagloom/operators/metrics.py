"""Tag frequencies, request statistics and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.text import decision, length_drop, natural_key, tags, utrim
from tagloom.operators.order import ranked


def tag_frequency(captions: DataFrame) -> DataFrame:
    """Per tag without regard to case: images that hold it, occurrences, percentage of all images, first spelling.

    Partial aggregation runs before the shuffle, so a tag on every image moves one row for each task.
    """
    total = captions.agg(F.count("*").alias("total"))
    placed = captions.select("item_id", F.posexplode(tags(F.col("caption"))).alias("pos", "tag"))
    each = placed.groupBy(F.lower("tag").alias("tag"), "item_id").agg(F.count("*").alias("n"), F.min(F.struct("pos", F.col("tag").alias("label"))).alias("first"))
    sums = each.groupBy("tag").agg(F.count("*").alias("images"), F.sum("n").alias("occurrences"), F.min(F.struct("item_id", "first"))["first"]["label"].alias("label"))
    return sums.crossJoin(F.broadcast(total)).select("tag", "label", "images", "occurrences", F.round(F.col("images") / F.col("total") * 100, 6).alias("percent"))  # one row is broadcast


def tag_totals(captions: DataFrame) -> DataFrame:
    """Distinct tags, captions that aren't blank, assignments."""
    each = captions.select(tags(F.col("caption")).alias("t"))
    blank = each.agg(F.count_if(F.size("t") > 0).alias("captioned"), F.coalesce(F.sum(F.size("t")), F.lit(0)).cast("long").alias("assignments"))
    distinct = each.select(F.explode("t").alias("tag")).select(F.lower("tag").alias("tag")).distinct().agg(F.count("*").alias("distinct_tags"))
    return distinct.crossJoin(F.broadcast(blank))  # one row each


def request_sums() -> list[Column]:
    status = F.col("status")
    return [
        F.count("*").alias("requests"), F.count_if(status.isin("succeeded", "revised")).alias("succeeded"), F.count_if(status == "refused").alias("refused"), F.count_if(status == "failed").alias("failed"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.round(F.avg("ttft_ms"), 4).alias("avg_ttft_ms"), F.round(F.avg("tokens_per_second"), 4).alias("avg_speed"),
    ]


def stats(requests: DataFrame, by: str | None = None, none: str = "", **equal: str) -> DataFrame:
    """Counts, token sums and averages over non-null values; by one dimension, or over all, under equality filters."""
    for column, value in equal.items():
        if value is not None:
            requests = requests.where(F.col(column) == value)
    if by is None:
        return requests.agg(*request_sums())
    return requests.groupBy(F.coalesce(F.col(by), F.lit(none)).alias("grp")).agg(*request_sums())


def stats_all_dimensions(requests: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Every breakdown and the total in one pass over the facts."""
    sets = [[d] for d in dimensions] + [[]]
    named = requests.select(*[F.coalesce(d, F.lit("")).alias(d) for d in dimensions], "status", "input_tokens", "output_tokens", "ttft_ms", "tokens_per_second")
    return named.groupingSets([[F.col(x) for x in s] for s in sets], *map(F.col, dimensions)).agg(*request_sums())


def labelled(breakdown: DataFrame, names: DataFrame) -> DataFrame:
    """names(id, name) put beside the groups; a group without a name keeps its id."""
    return breakdown.join(names, breakdown.grp == names.id, "left").drop("id").withColumn("label", F.coalesce("name", "grp")).drop("name")


def preset_names(presets: DataFrame) -> DataFrame:
    """presets(id, json) -> id, name of those whose JSON has a text for its name."""
    name = F.try_variant_get(F.try_parse_json("json"), "$.name", "variant")
    return presets.where(F.schema_of_variant(name) == "STRING").select("id", F.get_json_object("json", "$.name").alias("name"))


def key_names(connections: DataFrame) -> DataFrame:
    """connections(id, json) -> id, name: the labels of their keys; of several for one key that of the last connection."""
    refs = F.from_json(F.get_json_object("json", "$.keyRefs"), "array<struct<id:string,label:string>>")
    each = connections.select(F.col("id").alias("at"), F.posexplode(refs).alias("n", "k")).where("k.id is not null")
    return each.groupBy(F.col("k.id").alias("id")).agg(F.max_by("k.label", F.struct("at", "n")).alias("name"))


def run_closed(runs: DataFrame, items: DataFrame, run: str) -> DataFrame:
    """A row for each run, also for one without items: counts by status (revised items have succeeded too) and token sums. It is completed even where it was
    cancelled, and items without any response are in no counter but the total."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    sums = items.groupBy(run).agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("succeeded", "revised")).alias("succeeded"), *map(count, ("revised", "refused", "failed", "skipped", "cancelled")), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return runs.select(run).distinct().join(sums, run, "left").na.fill(0).withColumn("run_status", F.lit("completed"))


def job_measures(jobs: DataFrame, local: str = "本地模型") -> DataFrame:
    """Token sums of all jobs, and averages of first-token time and speed without the jobs of local models (by key label)."""
    remote = ~F.startswith(F.coalesce("key_label", F.lit("")), F.lit(local))
    mean = lambda c, name: F.round(F.avg(F.when(remote, F.col(c))), 4).alias(name)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return jobs.agg(F.count("*").alias("total"), total("input_tokens"), total("output_tokens"), mean("ttft_ms", "average_ttft_ms"), mean("tokens_per_second", "average_tokens_per_second"))


def merged_usage(attempts: DataFrame) -> DataFrame:
    """What an item's attempts used together: sums that are null where no attempt has a value, and the last time and speed."""
    last = lambda c: F.round(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("attempt"))), 4).alias(c)
    sums = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens", "generation_ms")]
    return attempts.groupBy("item", "batch_id").agg(*sums, last("ttft_ms"), last("tokens_per_second"))


# How many attempts an item has, and how many of them an error of a lasting kind or a refusal may use.
MOST_ATTEMPTS, MOST_LASTING = 6, 3
LASTING = ("rate_limit", "auth", "quota", "prompt_rejected")


def followed(attempts: DataFrame, advanced: bool = False) -> DataFrame:
    """The attempts up to the one that ends an item's loop, with ``result``, ``kind_of_error``, ``goes_on`` and ``last``.

    attempts(item, batch_id, attempt, job_kind, error, refused, structured, text, original, review_ok, write_error, ...). A
    reply ends the loop, but for a refusal before the third attempt (samples are refused by the service alone, and at once).
    Errors: transient and cut go on to the sixth attempt, LASTING ones to the third, all others end it.
    """
    n, error, sample = F.col("attempt"), F.col("error"), F.col("job_kind") == "ai_sample"
    refusal = F.col("structured") | (F.col("refused") & ~sample)
    verdict = decision(F.col("text"))
    shrunk = length_drop(F.col("original"), F.col("text")) & ((F.col("job_kind") == "revision") | F.lit(advanced))
    pair = lambda status, why=None: F.struct(F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"), (why if isinstance(why, Column) else F.lit(why)).cast("string").alias("error_kind"))
    reply = (
        F.when(refusal, pair("refused")).when(utrim(F.col("text")) == "", pair("failed", "empty_reply"))
        .when(sample, F.when(verdict["error"], pair("failed", "invalid_decision")).when(verdict["keep"], pair("succeeded")).otherwise(pair("skipped")))
        .when(shrunk & ~F.col("review_ok"), pair("failed", "length_reduced")).when(F.col("write_error").isNotNull(), pair("failed", F.col("write_error")))
        .otherwise(pair(F.when(F.col("job_kind") == "revision", "revised").otherwise("succeeded")))
    )
    lost = F.when(error == "cancelled", pair("cancelled")).when(error == "transient", pair("no_response", "no_response")).otherwise(pair("failed", F.when(error.isin("cut", "length"), "truncated").otherwise(error)))
    retried = F.when(error.isNull(), refusal & ~sample & (n < MOST_LASTING - 1)).otherwise(error.isin("transient", "cut") | (error.isin(*LASTING) & (n < MOST_LASTING - 1)))
    rows = attempts.withColumn("goes_on", retried & (n < MOST_ATTEMPTS - 1)).withColumn("result", F.when(error.isNull(), reply).otherwise(lost))
    own = Window.partitionBy("item", "batch_id")
    last = F.coalesce(F.min(F.when(~F.col("goes_on"), n)).over(own), F.max(n).over(own))
    return rows.withColumn("last", last).where(n <= F.col("last"))


def attempt_outcome(attempts: DataFrame, advanced: bool = False) -> DataFrame:
    """What an item's attempts come to: status, error kind, retries (of a reply's attempt) and what all replies used (0 if none came)."""
    used = lambda c: F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col(c))), F.lit(0)).alias(c)
    final = F.max_by(F.struct("result", "error", "attempt"), "attempt")
    sums = followed(attempts, advanced).groupBy("item", "batch_id").agg(final.alias("f"), used("input_tokens"), used("output_tokens"))
    return sums.select("item", "batch_id", F.col("f.result.status").alias("outcome"), F.col("f.result.error_kind").alias("error_kind"), F.when(F.col("f.error").isNull(), F.col("f.attempt")).otherwise(0).alias("retries"), "input_tokens", "output_tokens")


def attempt_metrics(attempts: DataFrame, advanced: bool = False) -> DataFrame:
    """The request rows of an item: one for each reply, with its own usage, and one without key and usage where errors ended it
    for good. Cancelled items, those without any response and those of local models (attempts(local)) have none."""
    rows, status = followed(attempts.where(~F.coalesce("local", F.lit(False))) if "local" in attempts.columns else attempts, advanced), F.col("result.status")
    replies = rows.where("error is null").select("item", "batch_id", F.col("attempt").alias("retries"), F.when(F.col("goes_on"), "refused").otherwise(status).alias("status"), "key_id", "input_tokens", "output_tokens")
    none = lambda name: F.lit(0).cast("long").alias(name)
    ends = rows.where((F.col("attempt") == F.col("last")) & F.col("error").isNotNull() & (status == "failed"))
    return replies.unionByName(ends.select("item", "batch_id", F.lit(0).cast("long").alias("retries"), F.lit("failed").alias("status"), F.lit(None).cast("string").alias("key_id"), none("input_tokens"), none("output_tokens")))


def key_counters(attempts: DataFrame, advanced: bool = False) -> DataFrame:
    """Per key, over the attempts that were made: replies that came to something, replies that did not, and their tokens. Requests
    that failed without a reply count for none of them."""
    good = ~F.col("goes_on") & F.col("result.status").isin("succeeded", "revised", "skipped")
    replies = followed(attempts, advanced).where("error is null and key_id is not null")
    return replies.groupBy("key_id").agg(F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"), F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0)).alias("tokens"))


def job_counts(jobs: DataFrame) -> DataFrame:
    """Jobs by state; revised ones have succeeded too, and ``revised`` counts those with any revision."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return jobs.agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("succeeded", "revised")).alias("succeeded"), F.count_if(F.col("revision_count") > 0).alias("revised"), *map(count, ("refused", "failed", "skipped", "cancelled")))


def ranked_jobs(jobs: DataFrame, by: str, folder: str, ascending: bool | None = None) -> DataFrame:
    """The whole job list with its ranks: by name from the first, by revisions or length from the most, if not asked for otherwise.

    Ties fall by natural name, then id, in ascending order.
    """
    first = {"name": natural_key(F.col("file_name")), "revision": F.coalesce("revision_count", F.lit(0)), "length": F.char_length("caption")}[by]
    keyed = jobs.select("item_id", "file_name", first.alias("__first"), natural_key(F.col("file_name")).alias("__name"))
    up = by == "name" if ascending is None else ascending
    return ranked(keyed, [F.col("__first").asc() if up else F.col("__first").desc(), F.col("__name"), F.col("item_id")], folder).select("rank", "item_id", "file_name")


def ranked_groups(breakdown: DataFrame, folder: str) -> DataFrame:
    """A breakdown's groups in the order in which they are listed: by name."""
    return ranked(breakdown, [F.col("grp")], folder)


def peak_concurrency(spans: DataFrame, key: str, unit: str = "hour") -> DataFrame:
    """spans(key, start, end): most intervals open at once for each key; an end frees its place before a start at that instant.

    Running sums are taken within one unit of time, on top of what the units before left open, so that a key which holds many
    spans is many tasks' work.
    """
    steps = spans.select(key, F.col("start").alias("at"), F.lit(1).alias("step")).unionAll(spans.select(key, F.col("end").alias("at"), F.lit(-1).alias("step")))
    moments = steps.groupBy(key, F.date_trunc(unit, "at").alias("__unit"), "at").agg(F.sum("step").alias("net"))
    units = steps.groupBy(key, F.date_trunc(unit, "at").alias("__unit")).agg(F.sum("step").alias("net"))  # a row for each key and unit
    before = F.sum("net").over(Window.partitionBy(key).orderBy("__unit").rowsBetween(Window.unboundedPreceding, -1))
    carried = units.select(key, "__unit", F.coalesce(before, F.lit(0)).alias("__before"))
    running = F.sum("net").over(Window.partitionBy(key, "__unit").orderBy("at"))
    return moments.join(carried, [key, "__unit"]).withColumn("open", F.col("__before") + running).groupBy(key).agg(F.max("open").cast("long").alias("peak"))


# How a review by a second model is counted, and how often it is tried.
REVIEW, MOST_REVIEWS = "advanced_review", 3


def review_metrics(reviews: DataFrame) -> DataFrame:
    """reviews(item, batch_id, attempt, key_id, error, refused, text, original, input_tokens, output_tokens) -> a request row of kind
    advanced_review for each reply up to the first that is good: one that isn't refused, says something, and has half the original's
    length at least. Requests without a reply have no row."""
    good = F.col("error").isNull() & ~F.col("refused") & (utrim(F.col("text")) != "") & (F.char_length("text") * 2 >= F.char_length("original"))
    first = F.min(F.when(good, F.col("attempt"))).over(Window.partitionBy("item", "batch_id"))
    tried = reviews.where(F.col("attempt") < MOST_REVIEWS).withColumn("__first", first).where("error is null and (__first is null or attempt <= __first)")
    status = F.when(good, "succeeded").when(F.col("refused"), "refused").otherwise("failed")
    return tried.select("item", "batch_id", F.lit(REVIEW).alias("kind"), F.col("attempt").alias("retries"), status.alias("status"), "key_id", "input_tokens", "output_tokens")


def migrated_keys(attempts: DataFrame) -> DataFrame:
    """attempts(item, batch_id, attempt, key_id, free_keys) -> retries, moved, stayed, forced: whether a retry took another key than
    the attempt before it, stayed although another one was free, or had no other (free_keys: those that could be taken then)."""
    before = F.lag("key_id").over(Window.partitionBy("item", "batch_id").orderBy("attempt"))
    rows = attempts.withColumn("__before", before).where("attempt > 0")
    same = F.col("__before").eqNullSafe(F.col("key_id"))
    other = F.exists("free_keys", lambda k: ~k.eqNullSafe(F.col("__before")))
    return rows.agg(F.count("*").alias("retries"), F.count_if(~same).alias("moved"), F.count_if(same & F.coalesce(other, F.lit(False))).alias("stayed"), F.count_if(same & ~F.coalesce(other, F.lit(False))).alias("forced"))
