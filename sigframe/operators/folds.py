"""Order-dependent state machines: one step function, run over groups in batch and over streams.

In batch only clusters of flips are folded; bands, zones and pools are scans over blocks (``scans``), and their steps here are what a stream takes.
A fold takes a key's rows sorted by ``bar_idx``, in batches, and keeps its state between them; it never holds a whole key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEY

Step = Callable[[dict[str, Any], dict[str, Any]], list[dict[str, Any]]]


def fold(df: DataFrame, step: Step, schema: str, keys: list[str] = KEY, order: tuple[str, ...] = ("bar_idx",)) -> DataFrame:
    """Rows that ``step(state, row)`` gives, with the keys put before them; state starts as an empty dict for each key.

    Keys are dealt to tasks and sorted there; rows stream through, and a key's state ends with its last row.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    out_schema = ", ".join([*[f"{k} string" for k in keys], schema])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, {}
        for b in batches:
            got = []
            for row in b.to_dict("records"):
                key = tuple(row[k] for k in keys)
                if key != now:
                    now, state = key, {}
                clean = {k: None if isinstance(v, float) and np.isnan(v) else v for k, v in row.items()}
                got += [(*key, *(r.get(n) for n in names)) for r in step(state, clean)]
            yield pd.DataFrame(got, columns=[*keys, *names])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(work, out_schema)


def ratchet(state: dict, r: dict) -> list[dict]:
    """Bands that only tighten while the close stays inside them, and the direction (-1 is bullish)."""
    if r["width"] is None:
        return []
    up, low = r["hl2"] + r["width"], r["hl2"] - r["width"]
    if "up" in state:
        if not (low > state["low"] or state["c"] < state["low"]):
            low = state["low"]
        if not (up < state["up"] or state["c"] > state["up"]):
            up = state["up"]
        side = state["side"]
        side = (-1 if r["c"] > up else 1) if side == 1 else (1 if r["c"] < low else -1)
    else:
        side = 1
    state.update(up=up, low=low, side=side, c=r["c"])
    return [{"bar_idx": r["bar_idx"], "direction": side, "line": low if side == -1 else up, "regime": r["regime"]}]


def affine(share: float) -> Step:
    """One bar of an exponential mean of ``c``, from the first value on; a missing value repeats nothing and changes nothing."""

    def step(state: dict, r: dict) -> list[dict]:
        if r["c"] is None:
            return []
        state["y"] = r["c"] if "y" not in state else state["y"] + share * (r["c"] - state["y"])
        return [{"bar_idx": r["bar_idx"], "y": state["y"]}]

    return step


AFFINE = "bar_idx long, y double"
RATCHET = "bar_idx long, direction int, line double, regime string"


def zone_pool(most: int = 3, life: int = 200, spread: float = 0.6) -> Step:
    """Line zones: a candidate (kind "candidate", price, atr) opens one unless an active one is within ``spread`` ATR; the oldest goes when there are more than ``most``.

    A touch (kind "touch", low, high) of an active zone gives it ``life`` more bars.
    """

    def step(state: dict, r: dict) -> list[dict]:
        pool, out = state.setdefault("pool", []), []
        for z in [z for z in pool if z["expires_idx"] < r["bar_idx"]]:
            pool.remove(z)
            out.append(z | {"status": "expired"})
        if r["kind"] == "touch":
            for z in pool:
                if r["low"] <= z["price"] <= r["high"]:
                    z["expires_idx"] = r["bar_idx"] + life
        elif all(abs(z["price"] - r["price"]) > spread * r["atr"] for z in pool):
            pool.append({"price": r["price"], "created_idx": r["bar_idx"], "expires_idx": r["bar_idx"] + life})
            if len(pool) > most:
                old = pool.pop(0)
                out.append(old | {"expires_idx": r["bar_idx"], "status": "evicted_by_capacity"})
        elif r["kind"] == "end":
            pass
        if r.get("last"):
            out += [z | {"status": "active"} for z in pool]
            pool.clear()
        return out

    return step


ZONE_POOL = "price double, created_idx long, expires_idx long, status string"


def liquidity_pools(least: int = 3, share: float = 0.4, keep: int = 50) -> Step:
    """Pools of at least ``least`` pivots of a kind within a share of the ATR of the newest one, in an unbroken run of the newest ``keep``.

    Rows are pivots (kind "pivot", price, atr) and bars (kind "bar", high, low); a pool ends when a bar has passed both its edges. ``high`` pools end above, others below.
    """

    def step(state: dict, r: dict) -> list[dict]:
        pivots, pools = state.setdefault("pivots", []), state.setdefault("pools", [])
        if r["kind"] == "pivot":
            pivots.insert(0, (r["bar_idx"], r["price"]))
            del pivots[keep:]
            near = []
            for p in pivots:
                if abs(p[1] - r["price"]) > share * r["atr"]:
                    break
                near.append(p)
            if len(near) >= least:
                lo, hi, start = min(p[1] for p in near), max(p[1] for p in near), near[-1][0]
                for z in pools:
                    if z["start_idx"] == start:
                        z.update(lo=lo, hi=hi, n=len(near))
                        return []
                pools.append({"start_idx": start, "known_idx": r["bar_idx"], "lo": lo, "hi": hi, "n": len(near)})
            return []
        gone = [z for z in pools if (r["high"] > z["hi"] if r["side"] == "high" else r["low"] < z["lo"])]
        for z in gone:
            pools.remove(z)
        out = [z | {"broken_idx": r["bar_idx"]} for z in gone]
        if r.get("last"):
            out += [z | {"broken_idx": None} for z in pools]
        return out

    return step


POOL = "start_idx long, known_idx long, lo double, hi double, n long, broken_idx long"


def clusters(windows: dict[str, int], least: int = 2) -> Step:
    """Greedy clusters of events of one direction on different rungs: an event joins if its rung is new and it comes within the window, which only widens.

    Rows need ``rung`` and ``t``; windows are seconds by rung.
    """

    def close(z: dict | None) -> list[dict]:
        return [{"start_t": z["start"], "known_at": z["last"], "k": len(z["rungs"]), "rungs": ">".join(z["rungs"])}] if z and len(z["rungs"]) >= least else []

    def step(state: dict, r: dict) -> list[dict]:
        z, out = state.get("open"), []
        if z and r["rung"] not in z["rungs"] and r["t"] - z["start"] <= max(z["window"], windows[r["rung"]]):
            z["rungs"].append(r["rung"])
            z["window"], z["last"] = max(z["window"], windows[r["rung"]]), r["t"]
        else:
            out = close(z)
            state["open"] = z = {"start": r["t"], "last": r["t"], "window": windows[r["rung"]], "rungs": [r["rung"]]}
        if r.get("last_row"):
            out += close(z)
            state["open"] = None
        return out

    return step


CLUSTER = "start_t long, known_at long, k long, rungs string"


def last_marked(df: DataFrame, keys: list[str], order: list[str], name: str = "last_row") -> DataFrame:
    """Marks the last row of each key, so that a fold can say what is still open."""
    at = F.struct(*order)
    end = df.groupBy(*keys).agg(F.max(at).alias("_end"))
    return df.join(end, keys).withColumn(name, at == F.col("_end")).drop("_end")


