"""Connected components of a table of links, by joining each id to its smallest neighbour and contracting the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import durable


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """links(a, b) -> (id, component) for every linked id: the smallest id that can be reached.

    Each round an id points to the smallest of itself and its neighbours, pointers are followed to their ends, and a link becomes
    one between the ends of its two ids; links of an end with itself and repeated ones go. So a link passes through the joins of
    one round, and only what is not connected yet through those of the next. Tables of a round are written, so that lineage stays
    short and a hub's many links are read from files, which lets Spark split them.
    """
    edges, out = durable(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"), None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = followed(durable(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")), "labels"))
        out = ends if out is None else out.join(ends.toDF("__end", "__next"), F.col("component") == F.col("__end"), "left").select("id", F.coalesce("__next", "component").alias("component"))
        first, second = (ends.toDF(k, f"end_{k}") for k in ("a", "b"))
        edges = durable(edges.join(first, "a").join(second, "b").where("end_a <> end_b").select(F.least("end_a", "end_b").alias("a"), F.greatest("end_a", "end_b").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return out
    raise RuntimeError("components did not settle")


def followed(labels: DataFrame, most_rounds: int = 100) -> DataFrame:
    """labels(id, component), each component an id too and not above its own -> where each id's pointers end."""
    for _ in range(most_rounds):
        beyond = labels.toDF("__via", "__beyond")
        step = durable(labels.join(beyond, F.col("component") == F.col("__via")).select("id", "component", "__beyond"), "labels")
        labels = step.select("id", F.col("__beyond").alias("component"))
        if step.where("component <> __beyond").isEmpty():
            return labels
    raise RuntimeError("pointers did not end")
