"""Load states of parameterised sources and of the queries that depend on them.

A fetched slot is known by name and arguments, a derived one by its SQL, parameters and upstream slots. Slots are counted; the
first subscription of a slot starts its fetch, a later result with an old generation is ignored. A slot is in error if any upstream
slot is, else loading while any is not ready, else ready; a failed refresh leaves a ready slot ready.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from brindle.plans.dialect import DialectError


class State(Enum):
    IDLE = "idle"
    LOADING = "loading"
    READY = "ready"
    ERROR = "error"


@dataclass
class Slot:
    key: tuple
    upstream: tuple = ()
    state: State = State.IDLE
    count: int = 0
    generation: int = 0
    error: str | None = None
    down: set = field(default_factory=set)


class Requirements:
    """dispatch(key, generation) starts a fetch; its result comes through ready() or failed(). changed(key, state) is told of changes."""

    def __init__(self, dispatch: Callable[[tuple, int], None], changed: Callable[[tuple, State], None] = lambda key, state: None, cancel: Callable[[tuple], None] = lambda key: None):
        self.dispatch, self.changed, self.cancel = dispatch, changed, cancel
        self.slots: dict[tuple, Slot] = {}

    def fetched(self, name: str, *args) -> tuple:
        key = ("fetch", name, tuple(map(repr, args)))
        self.slots.setdefault(key, Slot(key))
        return key

    def derived(self, sql: str, params: dict | None = None, upstream: tuple = ()) -> tuple:
        if unknown := [u for u in upstream if u not in self.slots]:
            raise DialectError(f"unknown requirement {unknown[0]}")
        key = ("query", sql, tuple(sorted((k, repr(v)) for k, v in (params or {}).items())), tuple(sorted(upstream, key=repr)))
        if key not in self.slots:
            self.slots[key] = Slot(key, key[3])
            for u in key[3]:
                self.slots[u].down.add(key)
        return key

    def state(self, key: tuple) -> State:
        return self.slots[key].state if key in self.slots else State.IDLE

    def subscribe(self, key: tuple) -> State:
        slot = self.slots[key]
        for u in slot.upstream:
            self.subscribe(u)
        slot.count += 1
        if slot.count == 1:
            if slot.key[0] == "fetch" and slot.state is not State.READY:
                self._fetch(slot)
            self._derive(slot)
        return slot.state

    def unsubscribe(self, key: tuple) -> None:
        slot = self.slots.get(key)
        if slot is None or not slot.count:
            return
        slot.count -= 1
        if not slot.count:
            if slot.state is State.LOADING and slot.key[0] == "fetch":
                self.cancel(key)
            del self.slots[key]
            for u in slot.upstream:
                if u in self.slots:
                    self.slots[u].down.discard(key)
        for u in slot.upstream:
            self.unsubscribe(u)

    def invalidate(self, key: tuple) -> None:
        """Results on their way count no more; a subscribed slot is fetched again."""
        slot = self.slots.get(key)
        if slot is None:
            return
        if slot.key[0] != "fetch":
            for u in slot.upstream:
                self.invalidate(u)
            return
        slot.generation += 1
        self.cancel(key)
        if slot.count:
            self._fetch(slot)
        else:
            self._set(slot, State.IDLE)

    def ready(self, key: tuple, generation: int) -> bool:
        slot = self.slots.get(key)
        if slot is None or slot.generation != generation:
            return False
        slot.error = None
        self._set(slot, State.READY)
        return True

    def failed(self, key: tuple, generation: int, error: str) -> bool:
        slot = self.slots.get(key)
        if slot is None or slot.generation != generation:
            return False
        slot.error = error
        if slot.state is not State.READY:
            self._set(slot, State.ERROR)
        return True

    def _fetch(self, slot: Slot) -> None:
        if slot.state is not State.READY:  # what is shown stays while it is refreshed
            self._set(slot, State.LOADING)
        self.dispatch(slot.key, slot.generation)

    def _derive(self, slot: Slot) -> None:
        if slot.key[0] == "query":
            states = [self.state(u) for u in slot.upstream]
            if State.ERROR in states:
                new = State.READY if slot.state is State.READY else State.ERROR
            else:
                new = State.READY if all(s is State.READY for s in states) else State.READY if slot.state is State.READY else State.LOADING
            self._set(slot, new)

    def _set(self, slot: Slot, state: State) -> None:
        if slot.state is not state:
            slot.state = state
            self.changed(slot.key, state)
            for d in list(slot.down):
                if d in self.slots and self.slots[d].count:
                    self._derive(self.slots[d])
