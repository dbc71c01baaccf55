"""Business dates of generated rows, and codes derived from new keys."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import date_for

# The columns that the date rules are about.
INCLUDED, ALTERED, ISSUED, MATURES = "DAT_INCLUSAO", "DAT_ALTERACAO", "DT_EMISSAO", "DT_VENCIMENTO"
DEFAULT_DAYS = 30


def run_time(value: str | dt.datetime | dt.date | None) -> dt.datetime:
    if value is None:
        return dt.datetime.now().replace(microsecond=0)
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    return value if isinstance(value, dt.datetime) else dt.datetime.combine(value, dt.time())


def rewrite_dates(df: DataFrame, at: str | dt.datetime, *, days: int | None = None, default_days: int = DEFAULT_DAYS) -> DataFrame:
    """Inclusion and alteration at the run's time, issue on its day, maturity a term later: days if given, else the
    row's own term from issue to maturity, or default_days where that is unknown or under a day."""
    when = run_time(at)
    moment = F.lit(when.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    day = F.lit(when.date())
    out = {}
    for c in (INCLUDED, ALTERED):
        if c in df.columns:
            out[c] = date_for(moment, df.schema[c].dataType, with_time=True)
    if MATURES in df.columns:
        term = F.lit(days)
        if days is None:
            own = F.datediff(F.to_date(MATURES), F.to_date(ISSUED)) if ISSUED in df.columns else F.lit(None).cast("int")
            term = F.coalesce(F.when(own >= 1, own), F.lit(default_days))
        out[MATURES] = date_for(F.date_add(day, term), df.schema[MATURES].dataType)
    if ISSUED in df.columns:
        out[ISSUED] = date_for(day, df.schema[ISSUED].dataType)
    return df.withColumns(out) if out else df


def derived_codes(df: DataFrame, kinds: DataFrame, *, key: str, kind: str, code: str, out: str, isin: str | None = None, unknown: str = "UNK") -> DataFrame:
    """A code of the kind's code (from a small lookup table) and the padded key; an ISIN-like code beside it."""
    found = df.join(kinds.select(F.col(kind), F.col(code).alias("__code")), kind, "left")
    made = {out: F.concat(F.coalesce("__code", F.lit(unknown)), F.lpad(F.col(key).cast("string"), 6, "0"))}
    if isin:
        made[isin] = F.concat(F.lit("BR"), F.lpad(F.col(key).cast("string"), 10, "0"))
    columns = [c for c in df.columns if c not in made]
    return found.withColumns(made).select(*columns, *made)
