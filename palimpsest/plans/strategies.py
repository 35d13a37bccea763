"""Strategy presets: budgets, thresholds, limits and the registry of user-defined strategies.

The presets are named by what they do. Numbers are the defaults of their behaviour.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    """Optional settings; None takes the strategy's default. Unknown names and bad values are refused."""

    reserve_tokens: int | None = None
    threshold_ratio: float | None = None
    keep_recent_tokens: int | None = None
    tail_turns: int | None = None
    prune: bool | None = None
    idle_minutes: int | None = None
    keep_recent_tools: int | None = None
    min_prune_tokens: int | None = None
    protect_tool_tokens: int | None = None
    tool_high_water_chars: int | None = None
    tool_low_water_chars: int | None = None
    max_summary_tokens: int | None = None
    max_summary_attempts: int | None = None
    summary_retry_delay_ms: int | None = None
    summary_tool_chars: int | None = None
    max_overflow_retries: int | None = None
    max_consecutive_failures: int | None = None
    restore_context: bool | None = None
    max_restore_tokens: int | None = None
    max_restored_files: int | None = None
    max_restored_images: int | None = None
    max_file_tokens: int | None = None
    max_skill_tokens: int | None = None
    summarization_provider: str | None = None
    summarization_model: str | None = None

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if v is None:
                continue
            if f.name == "threshold_ratio":
                if not (isinstance(v, (int, float)) and 0 < v <= 1):
                    raise ValueError("threshold_ratio must be above 0 and at most 1")
            elif f.name in ("prune", "restore_context"):
                if not isinstance(v, bool):
                    raise ValueError(f"{f.name} must be true or false")
            elif f.name.startswith("summarization_"):
                if not isinstance(v, str) or not v:
                    raise ValueError(f"{f.name} must be a non-empty string")
            elif isinstance(v, bool) or not isinstance(v, int) or v < 0:
                raise ValueError(f"{f.name} must be a non-negative integer")
        if (self.summarization_provider is None) != (self.summarization_model is None):
            raise ValueError("a summarization route needs a provider and a model")


def config(**settings: object) -> Config:
    unknown = set(settings) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Config(**settings)


STRATEGIES = ("idle_headroom", "user_tail", "turn_tail", "split_turn", "image_guard", "round_keep", "head_tail", "calibrated")


def budget(strategy: str, window: Column, output: Column, reserve: int | None = None, ratio: float | None = None, keep: int | None = None) -> tuple[Column, Column]:
    """(trigger, retain) of a strategy as long columns."""
    zero = F.lit(0)
    lit = lambda v: F.lit(v)
    # The presets' reserves, headrooms and shares.
    r = lambda default: default if reserve is None else lit(reserve)
    share = lambda c, default: F.floor(c * (default if ratio is None else ratio))
    retain = zero
    if strategy == "idle_headroom":
        room = F.greatest(zero, window - r(F.least(output, lit(20_000))))
        trigger = room - 13_000 if ratio is None else F.least(F.floor(room * ratio), room - 13_000)
    elif strategy == "user_tail":
        trigger = F.least(F.floor(window * min(0.9, 0.9 if ratio is None else ratio)), window - r(zero))
        retain = lit(20_000)
    elif strategy == "turn_tail":
        room = F.greatest(zero, window - r(F.when(output == 0, 32_000).otherwise(output)))
        trigger, retain = share(room, 1.0), F.least(lit(15_000), F.greatest(lit(2_000), F.floor(room * 0.25)))
    elif strategy == "split_turn":
        trigger, retain = share(F.greatest(zero, window - r(lit(16_384))), 1.0), lit(20_000)
    elif strategy == "image_guard":
        room = F.greatest(zero, window - r(lit(20_000))) - 13_000
        part = window * (0.85 if ratio is None else ratio)
        trigger = F.floor(F.when(room > 0, F.least(part, room.cast("double"))).otherwise(part))
    elif strategy == "round_keep":
        trigger = window - r(F.least(output, lit(21_000))) - 13_000 if ratio is None else F.floor(window * ratio)
    elif strategy == "head_tail":
        own = 50_000 if reserve is None else reserve
        left = F.when((lit(own) > 0) & (lit(own) < window), window - own).otherwise(window)
        trigger, retain = F.least(F.ceil(window * (0.85 if ratio is None else ratio)), left), lit(20_000)
    elif strategy == "calibrated":
        room = window * 0.9
        trigger, retain = F.floor(F.least(room * (0.9 if ratio is None else ratio), room - (reserve or 0))), lit(20_000)
    elif strategy == "host_native":
        trigger, retain = F.floor(F.least(window * 0.8, (window - output - 65_536).cast("double"))), F.floor((window - output) * 0.16)
    else:
        raise ValueError(f"no such strategy: {strategy}")
    return F.greatest(zero, trigger).cast("long"), (F.greatest(zero, retain) if keep is None else lit(keep)).cast("long")


def budget_table(inputs: DataFrame, reserve: int | None = None, ratio: float | None = None, keep: int | None = None, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """One row for each input (window, output) and strategy: trigger, retain, strict (fires only above the trigger)."""
    rows = [F.struct(F.lit(s).alias("strategy"), t.alias("trigger"), k.alias("retain"), F.lit(s == "split_turn").alias("strict")) for s in strategies for t, k in [budget(s, F.col("window"), F.col("output"), reserve, ratio, keep)]]
    return inputs.select("window", "output", F.inline(F.array(*rows)))


def fires(measured: Column, trigger: Column, strict: Column) -> Column:
    return F.when(strict, measured > trigger).otherwise(measured >= trigger)


def usable_window(window: Column, output: Column, input_limit: Column, reserve: int | None = None) -> Column:
    """What is left for input; a stated input limit is used with its own, smaller reserve."""
    out = F.when(F.coalesce(output, F.lit(0)) == 0, 32_000).otherwise(output)
    limited = input_limit - (F.least(F.lit(20_000), out) if reserve is None else F.lit(reserve))
    return F.greatest(F.lit(0), F.when(F.coalesce(input_limit, F.lit(0)) > 0, limited).otherwise(window - (out if reserve is None else F.lit(reserve)))).cast("long")


def learned_trigger(window: Column, input_limit: Column, observed: Column, ratio: float = 0.85, reserve: int = 50_000) -> Column:
    """The trigger under a capacity that was learned from errors."""
    effective = F.least(F.coalesce(input_limit, window), F.coalesce(observed, F.lit(1 << 62)))
    return F.least(effective * ratio, F.when((F.lit(reserve) > 0) & (F.lit(reserve) < effective), (effective - reserve).cast("double")))


def ignored_overflow(kind: Column, measured: Column, effective: Column) -> Column:
    """A too-large request with less than half the window is not the history's fault."""
    return (kind == "request-too-large") & (measured < effective * 0.5)


def output_cap(rule: str, window: Column, limit: Column, reserve: Column, estimated: Column) -> Column:
    """Most tokens a summary may take."""
    one = F.lit(1)
    if rule == "reserve":
        cap = F.least(limit, F.floor(reserve * 0.8))
    elif rule == "prefix":
        cap = F.least(limit, F.floor(reserve * 0.5))
    elif rule == "room":
        cap = F.least(F.lit(20_000), limit, window - estimated - 1_024)
    elif rule == "eighth":
        cap = F.floor(F.least(limit, F.floor(window / 8)) * 0.85)
    else:
        raise ValueError(rule)
    return F.greatest(one, cap).cast("long")


SHRINK_RATIOS = (0.7, 0.5, 0.35)


def shrunken(tokens: Column, attempt: int) -> Column:
    return F.floor(tokens * SHRINK_RATIOS[attempt]).cast("long")


# --- a trace that shows each strategy's effect, for teaching

#: The blocks of the trace in tokens at a window of 131,072.
TRACE = (("system", "system", 3_600), ("user-a", "dialogue", 7_400), ("tool-a", "tool", 18_500), ("dialogue", "dialogue", 8_200), ("tool-b", "tool", 23_900), ("tool-c", "tool", 16_300), ("recent", "recent", 18_700))
SCENARIOS = {"coding": (1.0, 1.0), "tools": (1.6, 1.0), "requirements": (0.65, 1.8)}


def _half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("long")


def trace_simulation(spark: SparkSession, windows: tuple[int, ...] = (131_072, 262_144, 524_288, 1_048_576)) -> DataFrame:
    """Per strategy, window and scenario: tokens before and after, and tokens pruned."""
    blocks = spark.createDataFrame(TRACE, "id string, kind string, base long")
    cases = spark.createDataFrame([(w, 8_192, s, t, d) for w in windows for s, (t, d) in SCENARIOS.items()], "window long, output long, scenario string, tool_weight double, dialogue_weight double")
    weight = F.when(F.col("kind") == "tool", F.col("tool_weight")).when(F.col("kind") == "dialogue", F.col("dialogue_weight")).otherwise(1.0)
    scale = F.col("window") / 131_072.0
    # A few fixed rows on both sides.
    sized = cases.join(F.broadcast(blocks)).withColumn("tokens", _half_up(F.col("base") * weight * scale))
    sums = sized.groupBy("window", "output", "scenario").agg(F.sum("tokens").alias("before"), F.sum(F.when(F.col("kind") == "tool", F.col("tokens")).otherwise(0)).alias("tools"), F.max(F.when(F.col("id") == "system", F.col("tokens"))).alias("system"), F.max(F.when(F.col("id") == "recent", F.col("tokens"))).alias("recent"))
    retain = {s: budget(s, F.col("window"), F.col("output"))[1] for s in (*STRATEGIES, "host_native")}
    rows = []
    for s in retain:
        restored = {"round_keep": 19_600, "user_tail": 10_800, "head_tail": 10_800, "idle_headroom": 12_600, "image_guard": 12_600}.get(s)
        after = F.col("system") + _half_up(F.lit(4_300 if s == "split_turn" else 3_200) * scale)
        if s in ("host_native", "turn_tail", "split_turn", "calibrated"):
            after = after + F.least(retain[s], F.col("recent"))
        if restored:
            after = after + _half_up(F.lit(restored) * scale)
        pruned = _half_up(F.col("tools") * 0.48) if s in ("host_native", "image_guard") else F.lit(0).cast("long")
        rows.append(F.struct(F.lit(s).alias("strategy"), after.alias("after"), pruned.alias("pruned")))
    return sums.select("window", "scenario", "before", F.inline(F.array(*rows)))


# --- strategies of one's own

_REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register_strategy(name: str, plan: Callable[..., DataFrame]) -> None:
    """``plan(entries, config)`` returns the selected rows (session_id, pos)."""
    if not name or name in _REGISTRY:
        raise ValueError(f"strategy name taken or empty: {name!r}")
    _REGISTRY[name] = plan


def strategy(name: str) -> Callable[..., DataFrame]:
    return _REGISTRY[name]


