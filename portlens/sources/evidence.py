"""Choice between evidence sources, best first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

SOURCES = ("PROFILE_ONLY", "LOG_ONLY", "METRICS_ONLY")


def first_present(probes: dict[str, DataFrame], strategy: str = "AUTO") -> str:
    """The first source whose probe has a row. A probe is cheap: single uses of features, not rolled up."""
    turns = _turns(strategy)
    for name in turns:
        if name in probes and not probes[name].isEmpty():
            return name
    raise ValueError("no source has usage rows: " + ", ".join(turns))


def choose_in_plan(candidates: dict[str, tuple[DataFrame, Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Rows of the first source that has any, with its name as `strategy`, chosen inside the plan.

    A candidate is (input, probe, build): `probe` gives single uses of an input, `build`
    its usage rows. The input of a source is filtered by whether an earlier one has a use,
    an uncorrelated EXISTS that is asked once; so a losing source parses and rolls up no
    row, and nothing runs on the driver.
    """
    every, earlier = [], []
    for name in SOURCES:
        if name not in candidates:
            continue
        source, probe, build = candidates[name]
        found = probe(source).select(F.lit(1).alias("one")).limit(1)
        gate: Column = F.lit(True)
        for other in earlier:
            gate = gate & ~other.exists()
        gated = source.filter(gate) if earlier else source
        every.append(build(gated).select(F.lit(name).alias("strategy"), "*"))
        earlier.append(found)
    chosen = every[0]
    for other in every[1:]:
        chosen = chosen.unionByName(other, allowMissingColumns=True)
    return chosen


def _turns(strategy: str) -> tuple[str, ...]:
    if strategy != "AUTO" and strategy not in SOURCES:
        raise ValueError(f"unknown strategy: {strategy}")
    return SOURCES if strategy == "AUTO" else (strategy,)


def choose_evidence(candidates: dict[str, Callable[[], DataFrame]], strategy: str = "AUTO") -> tuple[str, DataFrame]:
    """The first source with usage rows, and its name.

    AUTO tries profile, log and counters in this order; any other strategy
    tries that source alone. A source is built only when its turn comes, and
    asking whether it has a row reads no more than it takes to find one.
    """
    turns = _turns(strategy)
    for name in turns:
        if name in candidates:
            frame = candidates[name]()
            if not frame.isEmpty():
                return name, frame
    raise ValueError("no source has usage rows: " + ", ".join(turns))


def confidence(sources: list[str]) -> str:
    if sources == ["PROFILE_ONLY"]:
        return "high"
    return "mixed" if "PROFILE_ONLY" in sources else "low"
