"""Figures of the last four earlier terms of a vehicle, driver or policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast import TRIPLET
from hindcast.functions.rows import ratio_of_sums
from hindcast.operators.reliable import stored
from hindcast.operators.timeline import read_timeline

HISTORY_COVERAGES = ("DC", "COMPSP", "APCOLL", "TPL", "UIN", "AB")
RANKS = 4


def term_aggregates(
    sessions: DataFrame, kk: str, coverages: Sequence[str] = HISTORY_COVERAGES,
    with_end: bool = False,
) -> DataFrame:
    """Per id and term: premium, days, distinct counts, and losses with their rate per day.

    ``sessions`` holds one ``session_loss_<cvg>`` per coverage. ``with_end`` adds ``term_end``, the
    last day on which a session of the term could still bring a loss.
    """
    x, y = [k for k in TRIPLET if k != kk]
    figures: list[Column] = [
        F.sum("session_prem").alias(f"term_prem_{kk}"),
        ratio_of_sums("session_prem", "ver_days").alias(f"term_prem_mean_{kk}"),
        F.count_distinct("ver_eff").alias(f"ver_cnt_{kk}"),
        F.min("ver_days").alias(f"ver_days_min_{kk}"),
        F.max("ver_days").alias(f"ver_days_max_{kk}"),
        F.avg("term_days").alias(f"term_days_mean_{kk}"),
        F.count_distinct(x).alias(f"cntd_{x}_{kk}"),
        F.count_distinct(y).alias(f"cntd_{y}_{kk}"),
    ]
    for c in coverages:
        loss = f"session_loss_{c}"
        figures += [
            ratio_of_sums(loss, "ver_days").alias(f"term_loss_mean_{c}_{kk}"),
            F.sum(loss).alias(f"term_loss_{c}_{kk}"),
        ]
    if with_end:
        figures.append(F.max("ver_exp").alias("term_end"))
    return sessions.groupBy(kk, "term_eff").agg(*figures)


def previous_terms(
    events: DataFrame, terms: DataFrame, kk: str, ranks: int = RANKS,
    known_before: bool = False,
) -> DataFrame:
    """Distinct (id, term start) of the events with the figures of its ``ranks`` last earlier terms.

    Each term row carries the list of the terms up to it, at most ``ranks`` long; an event then
    needs only one lookup, the newest term that began before it. Earlier terms count by their start
    alone. With ``known_before`` a term counts only once its ``term_end`` has passed, so that no loss
    of the event's own time leaks in; the last terms are then those that ended last.
    """
    figures = _term_figures(terms, kk)
    found = _earlier_terms(events, terms, kk, ranks, known_before)
    return found.selectExpr(kk, "term_eff", *_per_rank(figures, kk, "_terms", ranks))


def _term_figures(terms: DataFrame, kk: str) -> list[str]:
    return [c for c in terms.columns if c not in {kk, "term_eff", "term_end"}]


def _earlier_terms(
    events: DataFrame, terms: DataFrame, kk: str, ranks: int, known_before: bool = False
) -> DataFrame:
    """:func:`previous_terms` with the terms still in one array ``_terms``, oldest first."""
    figures = _term_figures(terms, kk)
    shown = F.date_add(F.col("term_end" if known_before else "term_eff"), 1)
    per_day = terms.dropna(subset=[kk, "term_eff"]).withColumn("_visible", shown)
    order = ["_visible", "term_eff"]
    recent = (
        Window.partitionBy(kk).orderBy(*order).rowsBetween(-(ranks - 1), Window.currentRow)
    )
    listed = per_day.select(
        kk, "_visible", "term_eff",
        F.collect_list(F.struct("term_eff", *figures)).over(recent).alias("_terms"),
    )
    marks = listed.groupBy(kk, "_visible").agg(F.max_by("_terms", "term_eff").alias("_terms"))
    asked = events.select(kk, "term_eff").dropna().distinct()
    return read_timeline(asked, marks, [kk], "term_eff", "_visible", ["_terms"])


def _per_rank(figures: Sequence[str], kk: str, listed: str, ranks: int) -> list[str]:
    """Expressions of the figures of each rank, the last term of the array being the first."""
    out = []
    for r in range(1, ranks + 1):
        term = f"try_element_at({listed}, -{r})"
        out += [f"{term}.`{c}` as `{c}_{r}`" for c in figures]
        out.append(f"datediff(term_eff, {term}.term_eff) as term_dayssince_{kk}_{r}")
    return out


def add_previous_terms(
    events: DataFrame, sessions: DataFrame, ids: Sequence[str] = TRIPLET,
    coverages: Sequence[str] = HISTORY_COVERAGES,
) -> DataFrame:
    """Events with the previous-term figures of each id, NULL where there are fewer terms.

    Both inputs are read once per id, so pass stored or checkpointed tables. Every lookup starts from
    the events as given, not from the result of the one before. It is stored, so that only one id's
    shuffles are on disk at a time. The largest is joined first, when events are narrow; small ones
    may then be broadcast. Terms travel through the joins as one array per id and become columns at
    the end: the joins would else move four times their figures as columns, too many for generated code.
    """
    found, added = [], []
    for kk in ids:
        terms = term_aggregates(sessions, kk, coverages)
        listed = f"_terms_{kk}"
        found.append((kk, stored(
            _earlier_terms(events, terms, kk, RANKS).withColumnRenamed("_terms", listed))))
        added += _per_rank(_term_figures(terms, kk), kk, listed, RANKS)
    out = events
    for kk, rows in sorted(found, key=lambda x: x[1].count(), reverse=True):
        out = out.join(rows, [kk, "term_eff"], "left")
    return out.selectExpr(*[f"`{c}`" for c in events.columns], *added)
