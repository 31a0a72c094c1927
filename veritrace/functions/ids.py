"""Keys, tags and small projections of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_int(value: Column) -> Column:
    """An integer written as text, signs and blanks around it allowed; anything else is null."""
    trimmed = F.trim(value.cast("string"))
    return F.when(trimmed.rlike(r"^[+-]?\p{Nd}+$"), trimmed.try_cast("int"))


def channel_offset(operator: Column, client: Column) -> Column:
    """The least declared channel number, else 0."""
    return F.coalesce(F.least(as_int(operator), as_int(client)), F.lit(0))


def resolve_channel(channel: Column, operator: Column, client: Column, n_channels: Column) -> Column:
    """Index of a segment's channel: null for mono, for a number out of range and for a name."""
    index = as_int(channel) - channel_offset(operator, client)
    return F.when((n_channels > 1) & (index >= 0) & (index < n_channels), index)


def pick_text(*candidates: Column) -> Column:
    """The first that is not blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in candidates))


def pick_session(*candidates: Column) -> Column:
    """The first that is not blank, as it stands."""
    return F.coalesce(*(F.when(F.trim(c.cast("string")) != "", c.cast("string")) for c in candidates))


def text_group(reference_norm: Column) -> Column:
    """A group for readings of one text."""
    return F.concat(F.lit("txt"), F.substring(F.sha1(reference_norm.cast("binary")), 1, 12))


def stable_seed(*parts: Column) -> Column:
    """A seed that depends on the parts alone: the first 32 bits of their SHA-1."""
    return F.conv(F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def tag_of(corpus: Column, lang: Column, condition: Column) -> Column:
    return F.concat_ws("__", corpus, lang, condition)


def short_lang(lang: Column) -> Column:
    """es-PE and es_PE are es; '' is null."""
    return F.nullif(F.lower(F.split(lang, "[-_]")[0]), F.lit(""))


def call_dir(path: Column) -> Column:
    """The folder that a recording is in, without a last folder named audios."""
    parent = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/[^/]*$", "")
    return F.regexp_replace(parent, "(?i)/audios$", "")


def prefix_ids(rows: DataFrame, dataset: str) -> DataFrame:
    """Make the keys unique over datasets, and keep the old ones."""
    kept = {f"dataset_{k}": F.col(k) for k in ("sample_id", "segment_id")}
    named = {k: F.concat_ws("::", F.lit(dataset), F.col(k)) for k in ("sample_id", "segment_id")}
    return rows.withColumns(kept).withColumns(named | {"dataset": F.lit(dataset)})


def missing_roles(*roles: str) -> Column:
    """Names of the systems without a hypothesis."""
    return F.filter(F.array(*(F.when(F.col(f"hyp_{r}").isNull(), F.lit(r)) for r in roles)), lambda x: x.isNotNull())


def complete(*roles: str) -> Column:
    return F.size(missing_roles(*roles)) == 0


def spoken(*roles: str) -> Column:
    """Some system heard something."""
    return F.greatest(*(F.length(F.coalesce(F.col(f"hyp_{r}_norm"), F.lit(""))) for r in roles)) > 0
