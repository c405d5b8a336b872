"""Strategies as objects: each judges an event by what it has seen, and its memory can be exported and taken up again."""

from __future__ import annotations

import functools
import math
import random
from collections import deque
from decimal import Decimal

D = Decimal


class Trailing:
    """The last ``width`` values of a series, with their extremes and spread."""

    def __init__(self, width: int, kind: type = Decimal):
        self.kind, self.values = kind, deque(maxlen=width)

    @property
    def full(self) -> bool:
        return len(self.values) == self.values.maxlen

    def push(self, value) -> None:
        self.values.append(value)

    def spread(self) -> tuple[float, float]:
        """Mean and population deviation."""
        n = len(self.values)
        mean = math.fsum(self.values) / n
        return mean, math.sqrt(math.fsum((v - mean) ** 2 for v in self.values) / n)

    def export(self) -> list[str]:
        return [str(v) if self.kind is Decimal else v.hex() for v in self.values]

    def load(self, values: list[str]) -> None:
        self.values.clear()
        self.values.extend(D(v) if self.kind is Decimal else float.fromhex(v) for v in values)


class Strategy:
    """What a replay calls at every event: orders as (side, quantity, kind, limit, instrument), later parts optional.

    export_state() gives JSON-ready values, import_state() takes them up: a run that goes on in another process decides as
    if it had never stopped."""

    def __call__(self, e: dict, index: int, total: int, book) -> list[tuple]:
        raise NotImplementedError

    def export_state(self) -> dict:
        return {}

    def import_state(self, state: dict) -> None:
        if state:
            raise ValueError(f"{type(self).__name__} has no state to take up")


class Positions(Strategy):
    """Wants a position after some bars and trades the difference from what is held; flat before the last bar."""

    def __call__(self, e, index, total, book):
        if e["event_type"] != "bar":
            return []
        wanted = self.judge(e, index)
        self.learn(e)
        if index == total - 2:
            wanted = D(0)
        if wanted is None or index >= total - 1:
            return []
        missing = wanted - book.quantity.get(e["instrument_id"], D(0))
        return [(1, missing, "bar")] if missing > 0 else [(-1, -missing, "bar")] if missing < 0 else []

    def judge(self, e: dict, index: int) -> Decimal | None:
        """The wanted position, None to leave it as it is."""
        return None

    def learn(self, e: dict) -> None:
        """Remember the bar: it counts for later ones."""


class BuyHold(Positions):
    """One unit from the first event on."""

    def judge(self, e, index):
        return D(1) if index == 0 else None


class Flat(Positions):
    """Never anything: the null that must earn exactly nothing."""

    def judge(self, e, index):
        return D(0)


class SeededRandom(Positions):
    """A position of -1, 0 or 1 drawn at every third event: the control that no edge should lose to."""

    def __init__(self, seed: int = 7):
        self.rng = random.Random(seed)

    def judge(self, e, index):
        return None if index % 3 else D(self.rng.choice((-1, 0, 1)))

    def export_state(self):
        version, internal, gauss = self.rng.getstate()
        return {"version": version, "internal": list(internal), "gauss": gauss}

    def import_state(self, state):
        self.rng.setstate((state["version"], tuple(state["internal"]), state["gauss"]))


class Breakout(Positions):
    """Donchian channel: long above the highest, short below the lowest of the last ``lookback`` closes."""

    def __init__(self, lookback: int = 10):
        if lookback < 2:
            raise ValueError("a channel needs two closes at least")
        self.channel = Trailing(lookback)

    def judge(self, e, index):
        if not self.channel.full:
            return None
        close, seen = D(str(e["close"])), self.channel.values
        return D(1) if all(close > v for v in seen) else D(-1) if all(close < v for v in seen) else None

    def learn(self, e):
        self.channel.push(D(str(e["close"])))

    def export_state(self):
        return {"channel": self.channel.export()}

    def import_state(self, state):
        self.channel.load(state["channel"])


class Reversion(Positions):
    """Against moves of ``entry`` deviations from the mean of the last ``lookback`` closes, flat again near it, unless the
    moves between these closes vary by more than ``calm``."""

    NEAR = 0.25

    def __init__(self, lookback: int = 12, entry: float = 1.0, calm: float = 0.03):
        self.entry, self.calm = entry, calm
        self.closes, self.moves = Trailing(lookback, float), Trailing(lookback - 1, float)

    def judge(self, e, index):
        if not self.closes.full or (self.moves.full and len(self.moves.values) > 1 and self.moves.spread()[1] > self.calm):
            return None
        mean, deviation = self.closes.spread()
        if deviation == 0:
            return None
        off = (float(e["close"]) - mean) / deviation
        if abs(off) >= self.entry:
            return D(-1) if off > 0 else D(1)
        return D(0) if abs(off) < self.NEAR else None

    def learn(self, e):
        close = float(e["close"])
        if self.closes.values:
            self.moves.push(close / self.closes.values[-1] - 1)
        self.closes.push(close)

    def export_state(self):
        return {"closes": self.closes.export(), "moves": self.moves.export()}

    def import_state(self, state):
        self.closes.load(state["closes"])
        self.moves.load(state["moves"])


#: What a sweep's variants name.
FAMILIES = {"buy_hold": BuyHold, "donchian": Breakout, "mean_reversion": Reversion, "reversion": functools.partial(Reversion, calm=math.inf), "flat": Flat, "seeded_random": SeededRandom}
