"""Loading: requirements whose fetches land rows in the catalog's tables, and queries that run once these are there.

A Loader ties Requirements to Fetchers. Subscribing to a fetched slot runs its fetcher and puts the rows into a table as upserts by
key (a Z-set of +1 entries, so that subscriptions hear of them); a table without a key gets them appended. A derived slot's rows are
its query's result once all its upstream slots are ready.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from brindle.operators.delta import ZSet, apply_zset, replaced_rows
from brindle.plans.dialect import DialectError
from brindle.plans.lower import query
from brindle.sources.catalog import Catalog, ConstraintError, Fetchers
from brindle.sources.requirements import Requirements, State


class Loader:
    """fetchers by name; landed(table, changes) is told of rows that came in; run decides when a fetch runs (by default at once)."""

    def __init__(self, catalog: Catalog, fetchers: Fetchers, landed: Callable[[str, ZSet], None] = lambda table, changes: None, run: Callable[[Callable[[], None]], None] = lambda job: job()):
        self.catalog, self.fetchers, self.landed, self.run = catalog, fetchers, landed, run
        self.requirements = Requirements(self._dispatch)
        self.calls: dict[tuple, tuple[str, str, dict]] = {}
        self.queries: dict[tuple, tuple[str, dict]] = {}

    def fetched(self, name: str, table: str, **params) -> tuple:
        """A slot for the fetcher's rows in a table; the same name and parameters are one slot."""
        key = self.requirements.fetched(name, *sorted(params.items()))
        if self.calls.setdefault(key, (name, table, params))[1] != table:
            raise DialectError(f"{name} already lands in {self.calls[key][1]}")
        return key

    def derived(self, sql: str, params: dict | None = None, upstream: tuple = ()) -> tuple:
        key = self.requirements.derived(sql, params, upstream)
        self.queries[key] = (sql, params or {})
        return key

    def subscribe(self, key: tuple) -> State:
        self.requirements.subscribe(key)
        return self.requirements.state(key)

    def unsubscribe(self, key: tuple) -> None:
        self.requirements.unsubscribe(key)

    def invalidate(self, key: tuple) -> None:
        """The fetch runs again; rows that are there stay until new ones replace them."""
        self.requirements.invalidate(key)

    def rows(self, key: tuple) -> DataFrame:
        """A derived slot's result."""
        if self.requirements.state(key) is not State.READY:
            raise DialectError(f"the requirement is {self.requirements.state(key).value}")
        return query(self.catalog, *self.queries[key])

    def land(self, table: str, rows: DataFrame) -> ZSet:
        """Rows as upserts of a table, null and form checked. Rows they replace are part of the changes."""
        checked = self.catalog.checked(table, rows.select(*self.catalog[table].domains), unique=False)
        changes = ZSet.of(table, checked, 1)
        if self.catalog[table].key:
            changes = replaced_rows(self.catalog, changes)
        apply_zset(self.catalog, changes)
        self.landed(table, changes)
        return changes

    def _dispatch(self, key: tuple, generation: int) -> None:
        name, table, params = self.calls[key]

        def job() -> None:
            try:
                rows = self.fetchers.fetch(name, **params)
                if self.requirements.slots.get(key) is None or self.requirements.slots[key].generation != generation:
                    return  # cancelled or asked again meanwhile: these rows are out of date
                self.land(table, rows)
            except (DialectError, ConstraintError, PySparkException, OSError) as e:
                self.requirements.failed(key, generation, str(e))
            else:
                self.requirements.ready(key, generation)

        self.run(job)
