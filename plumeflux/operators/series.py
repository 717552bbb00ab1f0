"""Ordered-series features that stay parallel when one series holds most rows.

A plain window over ``keys`` sorts a whole series in one task. Here the series is
cut into segments by a monotone expression; windows run per ``(keys, segment)`` and a
small per-segment summary carries row counts, sums and edge values across the cuts.
Pass ``segment=None`` only where the series length is bounded by construction.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEG, RN, CNT = "__seg", "__rn", "__cnt"


def step_segment(col: str = "step_id", width: int = 4096) -> Column:
    return F.floor(F.col(col) / F.lit(width)).cast("bigint")


def halo_segments(df: DataFrame, step: str = "step_id", width: int = 4096, halo: int = 1) -> DataFrame:
    """Cut a series with dense steps into segments that also hold ``halo`` neighbours on each side.

    Windows over ``(keys, __seg)`` then see every neighbour up to ``halo`` steps away with one
    shuffle and no join; keep the rows with ``__core`` afterwards.
    """
    at, pos = F.floor(F.col(step) / F.lit(width)).cast("bigint"), F.pmod(F.col(step), F.lit(width))
    homes = F.array(at, F.when((pos < halo) & (at > 0), at - 1), F.when(pos >= width - halo, at + 1))
    return df.select("*", F.explode(F.filter(homes, lambda h: h.isNotNull())).alias(SEG)).withColumn(
        "__core", F.col(SEG) == at
    )


def with_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    segment: Column | None = None,
    row_number: str | None = None,
    lag: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    running: Mapping[str, str] | None = None,
    first: Mapping[str, str] | None = None,
    last: Mapping[str, str] | None = None,
    ffill: Mapping[str, str] | None = None,
    bfill: Mapping[str, str] | None = None,
    overall: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add ordered features; each mapping is ``output name -> input column``.

    ``row_number`` is 1-based, ``running`` an inclusive sum, ``ffill``/``bfill`` the nearest
    non-null value at or before/after the row, ``overall`` the maximum over the series.
    ``order`` must be unique within ``keys``.
    """
    keys, order = list(keys), list(order)
    lag, lead, running = dict(lag or {}), dict(lead or {}), dict(running or {})
    first, last = dict(first or {}), dict(last or {})
    ffill, bfill, overall = dict(ffill or {}), dict(bfill or {}), dict(overall or {})
    if segment is None:
        return _plain(df, keys, order, row_number, lag, lead, running, first, last, ffill, bfill, overall)

    by = keys + [SEG]
    cut = df.withColumn(SEG, segment)
    window = Window.partitionBy(*by).orderBy(*order)
    whole = Window.partitionBy(*by)
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    onward = window.rowsBetween(0, Window.unboundedFollowing)
    at = F.struct(*order)

    local: dict[str, Column] = {RN: F.row_number().over(window)}
    if lead:
        local[CNT] = F.count(F.lit(1)).over(whole)
    summary: dict[str, Column] = {"__n": F.count(F.lit(1))}
    across = Window.partitionBy(*keys).orderBy(SEG)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    after = across.rowsBetween(1, Window.unboundedFollowing)
    full = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry: dict[str, Column] = {}
    final: dict[str, Column] = {}

    if row_number:
        carry["__base_n"] = F.sum("__n").over(before)
        final[row_number] = (F.col(RN) + F.coalesce(F.col("__base_n"), F.lit(0))).cast("bigint")
    for out, src in lag.items():
        summary[f"__l_{out}"] = F.max_by(src, at)
        carry[f"__c_{out}"] = F.lag(f"__l_{out}").over(across)
        local[f"__w_{out}"] = F.lag(src).over(window)
        final[out] = F.when(F.col(RN) == 1, F.col(f"__c_{out}")).otherwise(F.col(f"__w_{out}"))
    for out, src in lead.items():
        summary[f"__f_{out}"] = F.min_by(src, at)
        carry[f"__c_{out}"] = F.lead(f"__f_{out}").over(across)
        local[f"__w_{out}"] = F.lead(src).over(window)
        final[out] = F.when(F.col(RN) == F.col(CNT), F.col(f"__c_{out}")).otherwise(F.col(f"__w_{out}"))
    for out, src in running.items():
        summary[f"__s_{out}"] = F.sum(src)
        carry[f"__c_{out}"] = F.sum(f"__s_{out}").over(before)
        local[f"__w_{out}"] = F.sum(src).over(upto)
        final[out] = F.coalesce(F.col(f"__c_{out}") + F.col(f"__w_{out}"), F.col(f"__w_{out}"), F.col(f"__c_{out}"))
    for out, src in first.items():
        summary[f"__f_{out}"] = F.min_by(src, at)
        carry[f"__c_{out}"] = F.first(f"__f_{out}").over(full)
        final[out] = F.col(f"__c_{out}")
    for out, src in last.items():
        summary[f"__l_{out}"] = F.max_by(src, at)
        carry[f"__c_{out}"] = F.last(f"__l_{out}").over(full)
        final[out] = F.col(f"__c_{out}")
    for out, src in ffill.items():
        summary[f"__l_{out}"] = F.max_by(src, F.when(F.col(src).isNotNull(), at))
        carry[f"__c_{out}"] = F.last(f"__l_{out}", ignorenulls=True).over(before)
        local[f"__w_{out}"] = F.last(src, ignorenulls=True).over(upto)
        final[out] = F.coalesce(F.col(f"__w_{out}"), F.col(f"__c_{out}"))
    for out, src in bfill.items():
        summary[f"__f_{out}"] = F.min_by(src, F.when(F.col(src).isNotNull(), at))
        carry[f"__c_{out}"] = F.first(f"__f_{out}", ignorenulls=True).over(after)
        local[f"__w_{out}"] = F.first(src, ignorenulls=True).over(onward)
        final[out] = F.coalesce(F.col(f"__w_{out}"), F.col(f"__c_{out}"))

    for out, src in overall.items():
        summary[f"__m_{out}"] = F.max(src)
        carry[f"__c_{out}"] = F.max(f"__m_{out}").over(full)
        final[out] = F.col(f"__c_{out}")

    per_segment = cut.groupBy(*by).agg(*[c.alias(n) for n, c in summary.items()])
    carried = per_segment.select(*by, *[c.alias(n) for n, c in carry.items()])
    kept = [c for c in df.columns if c not in final]
    return (
        cut.select("*", *[c.alias(n) for n, c in local.items()])
        .join(carried, by, "inner")
        .select(*kept, *[c.alias(n) for n, c in final.items()])
    )


def _plain(df, keys, order, row_number, lag, lead, running, first, last, ffill, bfill, overall) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    onward = window.rowsBetween(0, Window.unboundedFollowing)
    full = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out: dict[str, Column] = {}
    if row_number:
        out[row_number] = F.row_number().over(window).cast("bigint")
    out.update({o: F.lag(c).over(window) for o, c in lag.items()})
    out.update({o: F.lead(c).over(window) for o, c in lead.items()})
    out.update({o: F.sum(c).over(upto) for o, c in running.items()})
    out.update({o: F.first(c).over(full) for o, c in first.items()})
    out.update({o: F.last(c).over(full) for o, c in last.items()})
    out.update({o: F.last(c, ignorenulls=True).over(upto) for o, c in ffill.items()})
    out.update({o: F.first(c, ignorenulls=True).over(onward) for o, c in bfill.items()})
    out.update({o: F.max(c).over(full) for o, c in overall.items()})
    kept = [c for c in df.columns if c not in out]
    return df.select(*kept, *[c.alias(n) for n, c in out.items()])
