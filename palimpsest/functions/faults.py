"""What a failed request means to each strategy.

An error is a chain of (code, message), the outermost first. A strategy that follows
causes looks at the whole chain, any other at its first link.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Per strategy, classes in the order they are tried, with the patterns of the code and of the message
# (None: not looked at). All patterns ignore case.
FAULTS: dict[str, tuple[tuple[str, str | None, str | None], ...]] = {
    "idle_headroom": (("overflow", None, r"prompt.{0,16}too.?long|context.{0,30}(overflow|exceed|limit)|maximum.{0,20}token"),),
    "user_tail": (
        ("terminal", r"ABORT|CANCEL|INTERRUPT|SESSION_BUDGET_EXCEEDED", None),
        ("overflow", r"CONTEXT.*(EXCEED|OVERFLOW|LENGTH)|PROMPT_TOO_LONG", r"context.{0,35}(exceed|overflow|limit)|prompt.{0,16}too.?long|maximum context length"),
    ),
    "split_turn": (
        ("terminal", r"quota|billing|budget|GoUsageLimit|FreeUsageLimit|context.?window|max.?tokens|truncated", r"quota|billing|budget|GoUsageLimit|FreeUsageLimit|context.?window|max.?tokens|truncated"),
        (
            "transient",
            r"overloaded|rate.?limit|429|50[0234]|524|service.?unavailable|server.?error|network|connection|fetch failed|ENOTFOUND|EAI_AGAIN|socket|timed? out|timeout|terminated|ended without|websocket|please retry",
            r"overloaded|rate.?limit|429|50[0234]|524|service.?unavailable|server.?error|network|connection|fetch failed|ENOTFOUND|EAI_AGAIN|socket|timed? out|timeout|terminated|ended without|websocket|please retry",
        ),
    ),
    "image_guard": (("overflow", None, r"context.{0,40}(exceed|limit|overflow)|prompt.{0,16}too.?long|maximum.{0,20}token"),),
    "round_keep": (
        ("media", r"MEDIA_TOO_LARGE|IMAGE_TOO_LARGE|UNSUPPORTED_CONTENT|REQUEST_TOO_LARGE", None),
        ("overflow", r"CONTEXT.*(EXCEED|OVERFLOW)|PROMPT_TOO_LONG", r"context.*(window|length|exceed)|prompt.*too long|tokens?\s*>\s*\d"),
    ),
    "head_tail": (
        ("overflow", r"CONTEXT.*(EXCEED|OVERFLOW)|PROMPT_TOO_LONG", r"context.*(length|window|exceed)|prompt.*too long"),
        ("incomplete", r"MAX_TOKENS|EMPTY_RESPONSE", None),
        ("transient", r"RATE_LIMIT|TIMEOUT|SERVER|NETWORK|OVERLOADED|UNAVAILABLE", None),
    ),
    "calibrated": (("cancelled", r"^(?:ABORTED|CANCELLED|CANCELED|ABORT_ERR)$", None),),
    "turn_tail": (),
}
FOLLOWS_CAUSES = frozenset({"head_tail", "calibrated"})
# Fixed value: the code of a request that is too large, an overflow to ``head_tail`` from half of the window on.
_TOO_LARGE = r"REQUEST_TOO_LARGE"


# The class of an error that is known by its name alone.
NAMED = {"user_tail": ("terminal", r"^AbortError$"), "calibrated": ("cancelled", r"(?i)Abort|Cancel")}


def has_code(chain: Column, pattern: str) -> Column:
    """Whether any link of the chain has such a code."""
    return F.exists(F.coalesce(chain, F.array().cast("array<struct<code:string,message:string,name:string>>")), lambda x: F.coalesce(x["code"].rlike(f"(?i){pattern}"), F.lit(False)))


def transient(strategy: str, chain: Column) -> Column:
    """Whether some link is a passing fault, whatever class comes first."""
    return F.coalesce(reduce(lambda a, b: a | b, [has_code(chain, code) for name, code, _ in FAULTS[strategy] if name == "transient" and code], F.lit(False)), F.lit(False))


def fault_class(strategy: str, chain: Column, requested: Column | None = None, window: Column | None = None, named: bool = False) -> Column:
    """The class of an error (array of struct code, message), null where the strategy has none for it.

    With ``named`` the links have a ``name`` too, by which some strategies know an abort.
    """
    links = chain if strategy in FOLLOWS_CAUSES else F.slice(chain, 1, 1)
    matches = lambda text, pattern: F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False)) if pattern else F.lit(False)

    def has(code: str | None, message: str | None) -> Column:
        return F.exists(links, lambda x: matches(x["code"], code) | matches(x["message"], message))

    out = None
    if named and strategy in NAMED:
        name, pattern = NAMED[strategy]
        out = F.when(F.exists(links, lambda x: F.coalesce(x["name"].rlike(pattern), F.lit(False))), name)
    for name, code, message in FAULTS[strategy]:
        hit = has(code, message)
        if name == "overflow" and strategy == "head_tail" and requested is not None:
            hit = hit | (has(_TOO_LARGE, None) & (requested >= window * 0.5))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(None).cast("string") if out is None else out


def causes_of(error: BaseException) -> list[tuple[str, str, str]]:
    """(code, message, name) of a Python error and its causes; ``name`` is what it calls itself, else its class."""
    out, seen, e = [], set(), error
    while e is not None and id(e) not in seen:
        seen.add(id(e))
        out.append((str(getattr(e, "code", "") or ""), str(e), str(getattr(e, "name", "") or type(e).__name__)))
        e = e.__cause__
    return out


def request_trigger(status: Column, code: Column) -> Column:
    """What a failed model request asks for: ``request-too-large``, ``context-overflow``, or null (not the history's fault)."""
    # The status of a request that is too large, and the code of a full window.
    return F.when(status == 413, "request-too-large").when(code == "CONTEXT_WINDOW_EXCEEDED", "context-overflow")
