"""Saved state: presence, age, overlay of saved fields, timestamp forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STALE_DAYS = 7


def age(rows: DataFrame, as_of: str, modified: str = "modified_at") -> DataFrame:
    """authenticated (there is a state file), its age in hours, and a status that only warns."""
    seconds = F.timestamp_diff("SECOND", modified, F.lit(as_of).cast("timestamp_ntz"))
    status = F.when(F.col(modified).isNull(), "missing").when(seconds > STALE_DAYS * 86400, "stale").otherwise("ok")
    return rows.withColumns({"authenticated": F.col(modified).isNotNull(), "state_age_hours": F.floor(seconds / 3600).cast("long"), "status": status})


def overlay(rows: DataFrame, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Per field (computed, saved): the saved value wins where there is one."""
    return rows.withColumns({name: F.coalesce(saved, computed) for name, (computed, saved) in fields.items()})


def overlay_maps(computed: Column, saved: Column) -> Column:
    """The same for maps: saved keys win, also with a null value, and new keys are added."""
    kept = F.map_filter(computed, lambda k, _: ~F.array_contains(F.map_keys(saved), k))
    return F.when(saved.isNull(), computed).otherwise(F.map_concat(kept, saved))


def stamps(rows: DataFrame, at: str) -> DataFrame:
    """One instant in two forms: epoch seconds (double) and formatted."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at)
    return rows.withColumns({"authenticated_at": micros.cast("double") / 1e6, "authenticated_at_iso": F.date_format(at, "yyyy-MM-dd HH:mm:ss")})
