"""A runner of stages that are contracts: each writes a table, which is checked before the next one starts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class StageError(RuntimeError):
    """A stage that failed or whose table breaks its contract."""


@dataclass(frozen=True)
class Stage:
    """``make``: from the session and the tables so far to the stage's table; ``needs``: columns that it must have."""

    name: str
    make: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    least_rows: int = 0


@dataclass
class Report:
    rows: dict[str, int] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)
    planned: list[str] = field(default_factory=list)

    def text(self) -> str:
        lines = [f"{name}: {n} rows" for name, n in self.rows.items()] + [f"{name}: kept from before" for name in self.skipped] + [f"{name}: planned" for name in self.planned]
        return "\n".join(lines)


def check(stage: Stage, table: DataFrame) -> int:
    """The rows of a stage's table; StageError if a column or rows are missing."""
    if missing := [c for c in stage.needs if c not in table.columns]:
        raise StageError(f"{stage.name}: columns {missing} are missing")
    n = table.count()
    if n < stage.least_rows:
        raise StageError(f"{stage.name}: {n} rows, {stage.least_rows} expected at least")
    return n


def run(spark: SparkSession, stages: Sequence[Stage], folder: str, resume_from: str | None = None, dry_run: bool = False) -> Report:
    """Runs the stages in order, each table a Parquet folder below ``folder``; those before ``resume_from`` are read again
    instead. A dry run only says what would run. An unknown stage is an error."""
    names = [s.name for s in stages]
    if resume_from is not None and resume_from not in names:
        raise StageError(f"unknown stage {resume_from!r}")
    first, report, tables = names.index(resume_from) if resume_from else 0, Report(), {}
    for i, stage in enumerate(stages):
        path = f"{folder}/{stage.name}"
        if dry_run:
            (report.skipped if i < first else report.planned).append(stage.name)
            continue
        if i >= first:
            try:
                stage.make(spark, dict(tables)).write.mode("overwrite").option("compression", "zstd").parquet(path)
            except StageError:
                raise
            except Exception as e:
                raise StageError(f"{stage.name} failed: {e}") from e
        tables[stage.name] = spark.read.parquet(path)
        n = check(stage, tables[stage.name])
        if i < first:
            report.skipped.append(stage.name)
        else:
            report.rows[stage.name] = n
    return report
