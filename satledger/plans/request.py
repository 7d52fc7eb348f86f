"""A report request - show and ``since`` as the report form sends them.

The form's show value is the regex itself (or a configured show name); an
absent ``since`` defaults to two weeks before ``as_of`` (C9), the cursor of
a first report.  The result is the rendered report's line rows."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from satledger import constants as K
from satledger.functions.columns import relative_bound
from satledger.plans.render import report_lines


EVERY_SHOW = ".*"


def resolve_show(show: str | None, shows: dict[str, str]) -> str:
    if not show:
        return EVERY_SHOW
    return shows.get(show, show)


def report_for_request(inv: DataFrame, show: str | None, since: int | str | None, as_of: int,
                       shows: dict[str, str], excluded: Iterable[str] | None = None) -> DataFrame:
    bound = int(since) if since not in (None, "") else relative_bound(as_of, K.TWO_WEEKS_SECONDS)
    return report_lines(inv, resolve_show(show, shows), bound, excluded)
