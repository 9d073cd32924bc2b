"""Chooses how to match from the statistics of the marker table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presentia.operators import matching


@dataclass(frozen=True)
class Step:
    """Markers of ``least`` to ``most`` bases, matched in one way."""

    kind: str
    least: int
    most: int
    lengths: list[int] = field(default_factory=list)


@dataclass(frozen=True)
class Plan:
    steps: list[Step]
    longest: int = 0

    @property
    def empty(self) -> bool:
        return not self.steps


def statistics(markers: DataFrame) -> dict[str, dict]:
    """Number, bases, shortest, longest and lengths of distinct markers, short (below SHORT) and long apart."""
    short = F.col("length") < matching.SHORT
    rows = markers.groupBy(short.alias("short")).agg(
        F.count("*").alias("n"), F.sum("length").alias("bases"), F.min("length").alias("least"), F.max("length").alias("most"),
        F.array_sort(F.collect_set(F.when(short, F.col("length")))).alias("lengths"),
    )
    return {"short" if r.short else "long": r.asDict() for r in rows.collect()}  # two rows at most


def choose(stats: dict[str, dict], strategy: str = "auto") -> Plan:
    """Few markers are compared with every chunk; many by seeds, broadcast only under a checked size, also if asked for."""
    if not stats:
        return Plan([])
    longest = max(s["most"] for s in stats.values())
    n, bases = sum(s["n"] for s in stats.values()), sum(s["bases"] for s in stats.values())
    small = n <= matching.BROADCAST_MARKERS and bases <= matching.BROADCAST_BASES
    if strategy == "nested" and (bases > matching.BROADCAST_BASES or n > 20 * matching.BROADCAST_MARKERS):
        raise ValueError(f"{n} markers of {bases} bases are too many to compare with every chunk; use auto or shuffled")
    if strategy == "nested" or strategy == "auto" and small:
        return Plan([Step("nested", 1, longest)], longest)
    steps = []
    if short := stats.get("short"):
        few = short["n"] <= matching.BROADCAST_MARKERS and strategy not in ("by_length",)
        steps.append(Step("nested" if few else "by_length", short["least"], short["most"], list(short["lengths"])))
    if long := stats.get("long"):
        fits = long["bases"] <= matching.BROADCAST_BASES
        kind = "seeded" if fits and strategy != "shuffled" else "shuffled"
        steps.append(Step(kind, long["least"], long["most"]))
    return Plan(steps, longest)
