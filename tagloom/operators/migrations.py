"""Tables of several schema versions read as one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """From one version to the next: columns that get new names, columns that come with a default, and a change of the rows."""

    version: int
    renamed: dict[str, str] = field(default_factory=dict)
    added: dict[str, tuple[str, object]] = field(default_factory=dict)  # name: type, default
    change: Callable[[DataFrame], DataFrame] | None = None

    def apply(self, rows: DataFrame) -> DataFrame:
        for old, new in self.renamed.items():
            if old in rows.columns and new not in rows.columns:
                rows = rows.withColumnRenamed(old, new)
        for name, (kind, value) in self.added.items():
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(value).cast(kind))
            else:  # a row written by a newer program, or a step that is applied again
                rows = rows.withColumn(name, F.coalesce(F.col(name).cast(kind), F.lit(value).cast(kind)))
        return self.change(rows) if self.change else rows


@dataclass(frozen=True)
class Chain:
    """Numbered steps; version n is what step n leads to."""

    steps: tuple[Step, ...]

    def __post_init__(self) -> None:
        numbers = [s.version for s in self.steps]
        if numbers != list(range(numbers[0], numbers[0] + len(numbers))):
            raise ValueError("steps must be numbered one after the other")

    @property
    def version(self) -> int:
        return self.steps[-1].version

    def migrate(self, rows: DataFrame, version: int) -> DataFrame:
        """Rows of any version as rows of the last. Each step is a projection, so all of them are one pass."""
        if not self.steps[0].version - 1 <= version <= self.version:
            raise ValueError(f"version {version} is none that these steps lead from")
        for step in self.steps:
            rows = step.apply(rows) if step.version > version else rows
        return rows

    def union(self, tables: dict[int, DataFrame], columns: list[str]) -> DataFrame:
        """The tables, by version, as one with these columns."""
        out = None
        for version, rows in sorted(tables.items()):
            now = self.migrate(rows, version).select(*columns)
            out = now if out is None else out.unionByName(now)
        return out
