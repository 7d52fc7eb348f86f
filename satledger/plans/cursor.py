"""Report after report without gaps or repeats.

A show's cursor is the upper end of its last report; the next one covers the
half-open window ``(cursor, last boost]``.  The window is noted before the report is
written and the cursor moves after it, so a run that crashed is done again over the
same window, and a run without new boosts reports nothing.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satledger.operators.report import report_cutoff, valid_invoices
from satledger.plans.render import report_lines, write_report
from satledger.session import read_json, write_json


def cursor_file(cursors: str, show: str) -> str:
    return f"{cursors}/{hashlib.sha256(show.encode()).hexdigest()[:16]}.json"


def next_report(inv: DataFrame, show: str, pattern: str, cursors: str, reports: str, start: int,
                excluded: Iterable[str] | None = None, write: Callable[[DataFrame, int, str], None] | None = None) -> dict | None:
    """Write the next report of ``show`` and move its cursor; its window ``since, cutoff``
    and ``path``, or None when there is no boost after the cursor.

    ``start``: the lower bound of the first report.  ``write(payments, since, path)`` gets
    the payments up to the cutoff; by default it writes the Markdown report."""
    spark = inv.sparkSession
    excluded = list(excluded or [])
    file = cursor_file(cursors, show)
    state = read_json(spark, file) or {"show": show, "cursor": start, "open": None}
    window = state["open"]
    if window is None:
        since = state["cursor"]
        cutoff = report_cutoff(valid_invoices(inv, pattern, since, excluded)).first()["cutoff"]
        if cutoff is None:
            return None
        window = {"since": since, "cutoff": cutoff, "path": f"{reports}/{file.rsplit('/', 1)[1][:-5]}-{since}-{cutoff}"}
        write_json(spark, file, {**state, "open": window})
    upto = inv.filter(F.col("creation_date") <= window["cutoff"])
    if write is None:
        write_report(report_lines(upto, pattern, window["since"], excluded), window["path"])
    else:
        write(upto, window["since"], window["path"])
    write_json(spark, file, {"show": show, "cursor": window["cutoff"], "open": None})
    return window
