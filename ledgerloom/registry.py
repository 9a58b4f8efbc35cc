"""All registered queries of the enrichment engine and their SQL."""

from __future__ import annotations

from .plans import clock, contracts, levels, loop, normal, people, places, profiles, publish, refine, semantics, shops, texts, time, users


def _all() -> dict:
    return time.queries() | profiles.queries() | refine.queries() | users.queries() | contracts.queries() | people.queries() | texts.queries() | clock.queries() | places.queries() | loop.queries() | shops.queries() | levels.queries() | semantics.queries() | normal.queries() | publish.queries()


def queries() -> dict:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
