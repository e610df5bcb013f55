"""Occurrences of motifs in curves that arrive as a stream (an extension: the
batch search of operators.discovery over points in order of x).

State per curve: the last points that a window needs, and for every motif the
open run of shifts within the radius. An occurrence goes out when its run ends."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "curve_id long, motif_id long, shift int, diss double"


def _matcher(motifs: Sequence[tuple[int, Sequence[float], int, float]]):
    longest = max(len(v) for _, v, _, _ in motifs)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"points": [], "open": {}, "end": 0}
        points: dict[int, float] = {int(x): y for x, y in held["points"]}
        arrived = sorted((int(x), y) for b in batches for x, y in zip(b["x"], b["y"], strict=True) if y is not None and y == y and int(x) > held["end"])
        out = []
        for x, y in arrived:
            # The points between are missing; windows that end there are judged too.
            for end in range(held["end"] + 1, x + 1):
                if end == x:
                    points[x] = y
                for motif_id, v, least, r in motifs:
                    s = end - len(v) + 1
                    if s < 1:
                        continue
                    gaps = [(points[s + i] - w) ** 2 for i, w in enumerate(v) if w is not None and s + i in points]
                    name = str(motif_id)
                    if len(gaps) < least:
                        continue  # not a valid shift: the run goes on over it
                    d = sum(gaps) / len(gaps)
                    best = held["open"].get(name)
                    if d <= r:
                        if best is None or d < best[1]:
                            held["open"][name] = [s, d]
                    elif best is not None:
                        out.append((key[0], motif_id, *held["open"].pop(name)))
                for old in [p for p in points if p <= end - longest]:
                    del points[old]
            held["end"] = x
        held["points"] = list(points.items())
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=["curve_id", "motif_id", "shift", "diss"])

    return run


def match(stream: DataFrame, motifs: Sequence[tuple[int, Sequence[float], int, float]]) -> DataFrame:
    """stream: curve_id, x, y with x ascending per curve over time (late points
    are left out). motifs: (motif_id, values with None for gaps, least overlap,
    radius). Runs that are still open have no row yet."""
    return stream.select("curve_id", "x", "y").groupBy("curve_id").applyInPandasWithState(_matcher(motifs), OUTPUT, "held string", "append", GroupStateTimeout.NoTimeout)
