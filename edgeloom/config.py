"""Settings that all analyses share, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Outcome:
    """An outcome, the type of its edge correlations and the rows that have it."""

    name: str
    correlation: str = "Spearman"
    first_row: int = 1
    last_row: int = 67


@dataclass(frozen=True)
class Settings:
    """Counts are the main analyses'; `rows` that a short outcome leaves out come first."""

    folds: int = 10
    iterations: int = 10_000
    threshold: float = 0.01
    whole_rows: int = 67
    short_rows: int = 48
    # fixed values: outcomes that are measured on an interval scale
    interval: tuple[str, ...] = ("LSD_OBN", "LSD_MEQ30", "LSD_VRS")
    presentation: tuple[str, ...] = ("title", "colour", "note")
    forbidden: tuple[str, ...] = ("subject_name", "email", "birth_date")
    outcomes: tuple[Outcome, ...] = field(default_factory=tuple)

    def correlation_of(self, behavior: str, override: str | None = None) -> str:
        """The override, else Pearson for interval scales and Spearman for the others."""
        return override or ("Pearson" if any(name in behavior for name in self.interval) else "Spearman")

    def correlation_type(self, behavior: Column, override: Column | None = None) -> Column:
        """The same of a column of names; a NULL override gives the default, a NULL name Spearman."""
        interval = F.coalesce(F.greatest(F.lit(False), *(behavior.contains(name) for name in self.interval)), F.lit(False))
        default = F.when(interval, "Pearson").otherwise("Spearman")
        return default if override is None else F.coalesce(override, default)
