"""Edit rules as data, compiled to Column expressions: one projection previews a rule over any number of captions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import deduplicated, let, literal, tags, valid_pattern


@dataclass(frozen=True)
class EditRule:
    mode: str = "tag"  # tag, text
    action: str = "insert"  # insert, delete, replace
    position: str = "end"  # start, end, index, before, after, line
    content: str = ""
    replacement: str = ""
    anchor: str = ""
    index: int = 0
    regex: bool = False
    case_sensitive: bool = False
    all_matches: bool = True
    deduplicate: bool = False
    only_if_missing: bool = False


def pattern(rule: EditRule, of: str, multiline: bool = False) -> str:
    flags = ("" if rule.case_sensitive else "iu") + ("m" if multiline and rule.regex else "")
    return (f"(?{flags})" if flags else "") + (of if rule.regex else literal(of))


def replacement(rule: EditRule, text: str) -> str:
    """A regex rule may refer to groups; any other text stands for itself."""
    return text if rule.regex else text.replace("\\", "\\\\").replace("$", "\\$")


def invalid(rule: EditRule) -> str | None:
    """Why a rule can't be applied; the engine that would run a pattern decides whether it is one."""
    known = ("start", "end", "index", "before", "after", *(("line",) if rule.mode == "text" else ()))
    if rule.action == "insert" and rule.position not in known:
        return "unsupported position"
    if rule.regex:
        of = (rule.anchor if rule.action == "insert" else rule.content) if rule.mode == "text" else rule.anchor or rule.content
        if not valid_pattern(pattern(rule, of, rule.mode == "text")):
            return "invalid pattern"
    return None


def literals(text: str) -> Column:
    parts = [t.strip() for t in text.split(",") if t.strip()]
    return F.array(*map(F.lit, parts)).cast("array<string>")


def tag_edit(caption: Column, rule: EditRule) -> Column:
    """Tags are matched by search, not by equality: deleting ``hair`` takes ``long hair`` along."""
    wanted = pattern(rule, rule.anchor or rule.content)
    first = lambda parts: F.array_position(F.transform(parts, lambda t: t.rlike(wanted)), True) - 1
    return let(tags(caption), lambda parts: let(first(parts), lambda at: edited(caption, rule, wanted, parts, at)))


def edited(caption: Column, rule: EditRule, wanted: str, parts: Column, first: Column) -> Column:
    hit = lambda t: t.rlike(wanted)
    chosen = (lambda t, i: hit(t)) if rule.all_matches else (lambda t, i: i == first)
    if rule.action == "delete":
        out = F.filter(parts, lambda t, i: ~chosen(t, i))
    elif rule.action == "replace":
        out = F.flatten(F.transform(parts, lambda t, i: F.when(chosen(t, i), literals(rule.replacement)).otherwise(F.array(t))))
    else:
        new = literals(rule.content)
        if rule.only_if_missing:
            new = F.filter(new, lambda n: ~F.exists(parts, lambda t: F.lower(t) == F.lower(n)))
        if rule.position == "start":
            out = F.concat(new, parts)
        elif rule.position == "index":
            at = F.least(F.lit(max(rule.index - 1, 0)), F.size(parts))
            out = F.concat(F.slice(parts, F.lit(1), at), new, F.slice(parts, at + 1, F.size(parts)))
        elif rule.position in ("before", "after"):
            pair = lambda t: F.concat(new, F.array(t)) if rule.position == "before" else F.concat(F.array(t), new)
            out = F.flatten(F.transform(parts, lambda t, i: F.when(chosen(t, i), pair(t)).otherwise(F.array(t))))
        else:
            out = F.concat(parts, new)
        if rule.only_if_missing:
            kept = F.array_join(deduplicated(out, rule.case_sensitive) if rule.deduplicate else out, ", ")
            return F.when(F.size(new) == 0, caption).otherwise(kept)  # nothing to add: not even separators change
    return F.array_join(deduplicated(out, rule.case_sensitive) if rule.deduplicate else out, ", ")


def replace_in(text: Column, wanted: str, to: str, every: bool) -> Column:
    if every:
        return F.regexp_replace(text, wanted, to)
    flags = re.match(r"\(\?[a-z]+\)", wanted)
    start, inner = (flags[0], wanted[flags.end() :]) if flags else ("", wanted)
    at = F.regexp_instr(text, F.lit(wanted))
    changed = F.concat(F.substr(text, F.lit(1), at - 1), F.regexp_replace(F.substr(text, at, F.length(text)), rf"{start}\A(?:{inner})", to))
    return F.when(at > 0, changed).otherwise(text)


def text_edit(text: Column, rule: EditRule) -> Column:
    wanted = pattern(rule, rule.content, multiline=True)  # an anchor only says where to insert
    if rule.action == "delete":
        return replace_in(text, wanted, "", rule.all_matches)
    if rule.action == "replace":
        return replace_in(text, wanted, replacement(rule, rule.replacement), rule.all_matches)
    new = F.lit(rule.content)
    if rule.position == "start":
        out = F.concat(new, text)
    elif rule.position == "index":
        at = F.least(F.lit(max(rule.index, 0)), F.char_length(text))
        out = F.concat(F.substr(text, F.lit(1), at), new, F.substr(text, at + 1, F.char_length(text)))
    elif rule.position == "line":
        lines = F.split(F.regexp_replace(F.regexp_replace(text, r"\r\n", "\n"), r"\n$", ""), "\n")
        at = F.least(F.lit(max(rule.index - 1, 0)), F.size(lines))
        out = F.array_join(F.concat(F.slice(lines, F.lit(1), at), F.array(new), F.slice(lines, at + 1, F.size(lines))), "\n")
    elif rule.position in ("before", "after"):
        safe = rule.content.replace("\\", "\\\\") if rule.regex else replacement(rule, rule.content)
        out = replace_in(text, pattern(rule, rule.anchor, multiline=True), f"{safe}$0" if rule.position == "before" else f"$0{safe}", rule.all_matches)
    else:
        out = F.concat(text, new)
    if rule.only_if_missing:
        there = text.contains(rule.content) if rule.case_sensitive else F.lower(text).contains(rule.content.lower())
        return F.when(there, text).otherwise(out)
    return out


def preview(captions: DataFrame, rule: EditRule) -> DataFrame:
    """caption_path, before, after, changed, error for every caption; a rule that can't be applied is an error on each row.

    Captions that couldn't be read say why in a column ``unreadable`` and stay as they are."""
    wrong = invalid(rule)
    after = F.col("caption") if wrong else (tag_edit if rule.mode == "tag" else text_edit)(F.col("caption"), rule)
    own = F.col("unreadable") if "unreadable" in captions.columns else F.lit(None).cast("string")
    rows = captions.select("caption_path", F.col("caption").alias("before"), F.when(own.isNull(), after).otherwise(F.col("caption")).alias("after"), own.alias("own"))
    return rows.withColumn("changed", F.col("before") != F.col("after")).withColumn("error", F.coalesce("own", F.lit(wrong).cast("string"))).drop("own")


def preview_counts(previewed: DataFrame) -> DataFrame:
    return previewed.agg(
        F.count("*").alias("total"), F.count_if(F.col("changed") & F.col("error").isNull()).alias("affected"),
        F.count_if(~F.col("changed") & F.col("error").isNull()).alias("skipped"), F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
