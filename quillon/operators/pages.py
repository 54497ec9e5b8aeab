"""Page policies as a named list of stages, switched by a profile."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Profile:
    """Which stages run; those named in ``off`` don't."""

    name: str = "default"
    off: frozenset[str] = field(default_factory=frozenset)


def run_stages(df: DataFrame, stages: list[tuple[str, Stage]], profile: Profile = Profile()) -> DataFrame:
    """df through the stages in order."""
    for name, stage in stages:
        if name not in profile.off:
            df = df.transform(stage)
    return df


def skip_stage(label: str, when) -> Stage:
    """A stage that labels the rows for which a rule holds, unless they have a label."""
    return lambda df: df.withColumn("label", F.when((F.col("label") == "") & F.coalesce(when, F.lit(False)), label).otherwise(F.col("label")))
