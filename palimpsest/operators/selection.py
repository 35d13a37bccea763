"""Selecting history by token budget. ``price`` is a long column of the entries.

Sums of later rows are taken as total minus prefix, so one sort serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ceil_div
from .scans import Running, scans
from .structure import all_rows, balanced, checkpoint, indexed, orphan_sessions, rounds, rows_upto, session_order, turns, typed_user

def _by_round() -> WindowSpec:
    return W.partitionBy("session_id").orderBy("round")


def with_suffix(entries: DataFrame, price: str = "price") -> DataFrame:
    """With ``suffix`` (this row and later ones), ``later`` (only later ones) and ``total``."""
    rows = entries.withColumns({"total": F.sum(price).over(all_rows()), "_upto": F.sum(price).over(rows_upto())})
    return rows.withColumns({"later": F.col("total") - F.col("_upto"), "suffix": F.col("total") - F.col("_upto") + F.col(price)}).drop("_upto")


def with_cut(entries: DataFrame, keep: int, price: str = "price") -> DataFrame:
    """Rows with ``idx``, ``total``, ``cut`` (index of the first kept row, 0: nothing selected) and ``chosen`` (before the cut).

    The cut is the first valid one at or after the last row whose suffix reaches
    ``keep``, else the first valid one. Valid: not a result, nothing open before.
    A start that holds nothing but checkpoints is not chosen.
    """
    rows = indexed(with_suffix(balanced(entries), price))
    rows = rows.withColumns({"_valid": (F.col("role") != "tool") & (F.col("open_before") == 0), "_reach": F.max(F.when(F.col("suffix") >= keep, F.col("idx"))).over(all_rows())})
    at_reach, at_all = F.when(F.col("_valid") & (F.col("idx") >= F.col("_reach")), F.col("idx")), F.when(F.col("_valid"), F.col("idx"))
    rows = rows.withColumn("cut", F.coalesce(F.min(at_reach).over(all_rows()), F.min(at_all).over(all_rows()), F.lit(0)).cast("long"))
    fresh = F.coalesce(F.max(F.when(F.col("idx") < F.col("cut"), ~checkpoint())).over(all_rows()), F.lit(False))
    rows = rows.withColumn("cut", F.when(fresh, F.col("cut")).otherwise(0))
    return rows.withColumn("chosen", F.col("idx") < F.col("cut")).drop("_valid", "_reach", "later", "suffix", "open_before", "open_after")


def suffix_cut(entries: DataFrame, keep: int, price: str = "price", block: int | None = None) -> DataFrame:
    """Per session: total, cut, rows and tokens selected, by ``with_cut``.

    With ``block`` sessions are dealt by that many places and only running values and a
    row for each session are formed; prices must not be negative then.
    """
    if block is not None:
        return _blocked_cut(entries, keep, price, block)
    zero = F.lit(0).cast("long")
    return with_cut(entries, keep, price).groupBy("session_id").agg(
        F.first("total").alias("total"), F.first("cut").alias("cut"), F.count_if("chosen").alias("selected_rows"), F.coalesce(F.sum(F.when(F.col("chosen"), F.col(price))), zero).alias("selected_tokens"),
    )


def _blocked_cut(entries: DataFrame, keep: int, price: str, block: int) -> DataFrame:
    own = F.col(price)
    rows = scans(balanced(entries, block), ["session_id"], {"idx": Running(F.lit(1).cast("long")), "before": Running(own), "later": Running(own, backward=True), "after": Running(F.lit(1), backward=True)}, block=block)
    valid = (F.col("role") != "tool") & (F.col("open_before") == 0)
    # Without negative prices a row lies at or after the last one whose suffix reaches `keep` if what is later doesn't.
    first = lambda ok: F.min_by(F.struct("idx", "before"), F.when(ok, F.col("idx")))
    found = rows.groupBy("session_id").agg(F.sum(own).alias("total"), first(valid & ((F.col("later") < keep) | (F.col("after") == 0))).alias("near"), first(valid).alias("any"), F.min(F.when(~checkpoint(), F.col("idx"))).alias("fresh"))
    cut = F.coalesce("near", "any")
    some = F.coalesce(F.col("fresh") < cut["idx"], F.lit(False))
    zero = F.lit(0).cast("long")
    at = F.when(some, cut["idx"]).otherwise(zero)
    return found.select("session_id", "total", at.alias("cut"), at.alias("selected_rows"), F.when(some, cut["before"]).otherwise(zero).alias("selected_tokens"))


def split_turn(entries: DataFrame, cuts: DataFrame) -> DataFrame:
    """Per cut session: rows of the history part and of the turn prefix when the cut falls on an answer."""
    rows = indexed(entries).join(cuts.where("cut > 0").select("session_id", "cut"), "session_id")
    ends = rows.groupBy("session_id", "cut").agg(F.max(F.when((F.col("idx") == F.col("cut")) & (F.col("role") == "assistant"), True)).alias("mid"), F.max(F.when((F.col("idx") < F.col("cut")) & (F.col("role") == "user") & ~checkpoint(), F.col("idx"))).alias("start"))
    begin = F.when(F.col("mid") & F.col("start").isNotNull(), F.col("start")).otherwise(F.col("cut"))
    return ends.select("session_id", "cut", begin.alias("history_rows"), (F.col("cut") - begin).alias("prefix_rows"))


def with_typed_cut(entries: DataFrame, keep: int, price: str = "price") -> DataFrame:
    """Rows with ``idx`` and ``cut``: where the suffix reaches ``keep``, but not after the latest typed message, moved back to
    a row with no call open that is no result."""
    rows = indexed(with_suffix(balanced(entries), price))
    aim = F.coalesce(F.max(F.when(F.col("suffix") >= keep, F.col("idx"))).over(all_rows()), F.lit(0))
    rows = rows.withColumns({"_aim": aim, "_user": F.max(F.when(typed_user(), F.col("idx"))).over(all_rows())})
    most = F.when(F.col("_user") > 0, F.least("_aim", "_user")).otherwise(F.col("_aim"))
    good = (F.col("open_before") == 0) & (F.col("role") != "tool") & (F.col("idx") <= most)
    cut = F.coalesce(F.max(F.when(good, F.col("idx"))).over(all_rows()), F.lit(0)).cast("long")
    return rows.withColumn("cut", cut).drop("_aim", "_user", "open_before", "open_after", "suffix", "later", "total")


def typed_cut(entries: DataFrame, keep: int, price: str = "price") -> DataFrame:
    """Per session the ``cut`` of ``with_typed_cut``; 0 where a result is unexpected, as then no row is safe."""
    cuts = with_typed_cut(entries, keep, price).groupBy("session_id").agg(F.first("cut").alias("cut"))
    rows = cuts.join(orphan_sessions(entries).withColumn("_orphan", F.lit(True)), "session_id", "left")
    return rows.select("session_id", F.when(F.col("_orphan"), F.lit(0)).otherwise(F.col("cut")).cast("long").alias("cut"))


def _round_sums(entries: DataFrame, mode: str, price: str) -> DataFrame:
    own = rounds(entries, mode).groupBy("session_id", "round").agg(F.sum(price).alias("tokens"), F.count("*").alias("rows"))
    upto = F.sum("tokens").over(_by_round().rowsBetween(W.unboundedPreceding, 0))
    return own.withColumns({"rounds": F.count("*").over(all_rows()), "upto": upto, "later": F.sum("tokens").over(all_rows()) - upto})


def keep_groups(entries: DataFrame, target: int, mode: str = "message", price: str = "price") -> DataFrame:
    """Per session: rounds, and those kept: a round is kept while the later ones hold less than ``target`` (the crossing one too)."""
    g = _round_sums(entries, mode, price)
    kept = F.col("later") < target
    return g.groupBy("session_id").agg(F.count("*").alias("rounds"), F.count_if(kept).alias("kept_rounds"), F.coalesce(F.sum(F.when(kept, F.col("tokens"))), F.lit(0)).alias("kept_tokens"), F.coalesce(F.sum(F.when(~kept, F.col("rows"))), F.lit(0)).alias("selected_rows"))


def keep_rounds(entries: DataFrame, least: int, tokens: int, mode: str = "assistant", price: str = "price") -> DataFrame:
    """Per session ``keep``: the last ``least`` rounds, and more while they hold fewer than ``tokens``; at least one is left over.

    With ``least`` 0 the count of kept tokens starts from all rounds, so nothing is added.
    """
    g = _round_sums(entries, mode, price)
    back = F.col("rounds") - F.col("round")  # 1 for the last
    most = F.least(F.lit(least), F.greatest(F.col("rounds") - 1, F.lit(0)))
    needed = F.when((back > most) & (most > 0) & (F.col("later") < tokens) & (back <= F.col("rounds") - 1), 1).otherwise(0)
    return g.groupBy("session_id").agg((F.max(most) + F.sum(needed)).alias("keep"), F.max("rounds").alias("rounds"))


def drop_for_gap(entries: DataFrame, gap: int | None, mode: str = "message", price: str = "price") -> DataFrame:
    """Per session ``dropped``: oldest rounds until they cover ``gap`` (a fifth without one); one at least goes, one stays."""
    g = _round_sums(entries, mode, price)
    if gap is None:
        return g.groupBy("session_id").agg(F.max("rounds").alias("rounds")).withColumn("dropped", F.least(F.greatest(F.floor(F.col("rounds") * 0.2), F.lit(1)), F.col("rounds") - 1).cast("long"))
    n = F.count_if((F.col("upto") - F.col("tokens")) < gap)
    return g.groupBy("session_id").agg(F.max("rounds").alias("rounds"), n.alias("n")).select("session_id", "rounds", F.least(F.greatest("n", F.lit(1)), F.col("rounds") - 1).cast("long").alias("dropped"))


def keep_more_for_gap(entries: DataFrame, keep: int, gap: int | None, mode: str = "assistant", price: str = "price") -> DataFrame:
    """Per session ``keep``: rounds before the kept ones join them until they cover ``gap``; half of the rest if all would; never above rounds - 2."""
    g = _round_sums(entries, mode, price).where(F.col("round") < F.col("rounds") - keep)
    rest = g.withColumn("after", F.sum("tokens").over(W.partitionBy("session_id").orderBy(F.desc("round")).rowsBetween(W.unboundedPreceding, -1)))
    more = F.count_if((F.coalesce("after", F.lit(0)) < gap) & (F.col("round") >= 1)) if gap is not None else F.lit(1).cast("long")
    out = rest.groupBy("session_id").agg(F.max("rounds").alias("rounds"), more.alias("more"))
    left = F.col("rounds") - keep
    if gap is not None:
        out = out.withColumn("more", F.when(F.col("more") >= left - 1, F.greatest(F.lit(1), F.floor(left / 2))).otherwise(F.col("more")))
    return out.select("session_id", "rounds", F.greatest(F.lit(0), F.least(F.col("rounds") - 2, F.lit(keep) + F.col("more"))).cast("long").alias("keep"))


def recent_within(entries: DataFrame, budget: Column | int, price: str = "price") -> DataFrame:
    """Per session: start of the longest suffix within ``budget``; one row goes if all fit, and results at its head go."""
    rows = indexed(with_suffix(entries, price))
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    fit = F.coalesce(F.min(F.when(F.col("suffix") <= budget, F.col("idx"))).over(all_rows()), F.col("n"))
    rows = rows.withColumn("_from", F.greatest(fit, F.lit(1)))
    out = rows.groupBy("session_id").agg(F.max("n").alias("rows"), F.min(F.when((F.col("idx") >= F.col("_from")) & (F.col("role") != "tool"), F.col("idx"))).alias("start"))
    return out.select("session_id", "rows", F.coalesce("start", "rows").alias("start"))


def retain_users(entries: DataFrame, budget: int, price: str = "price") -> DataFrame:
    """Typed messages kept newest first within ``budget``; the one on the boundary is kept in part: session_id, pos, tokens, kept_tokens."""
    rows = with_suffix(entries.where(typed_user()), price).where(F.col("later") < budget)
    return rows.select("session_id", "pos", F.col(price).alias("tokens"), F.least(price, F.lit(budget) - F.col("later")).alias("kept_tokens"))


def latest_representation(entries: DataFrame) -> DataFrame:
    """One row for each typed message id: the latest row, in the place of the first."""
    users = entries.where(typed_user())
    cols = [c for c in users.columns if c not in ("session_id", "message_id", "pos")]
    return users.groupBy("session_id", "message_id").agg(F.min("pos").alias("pos"), F.max_by(F.struct(*cols), "pos").alias("r")).select("session_id", "message_id", "pos", "r.*")


def head_tail_users(entries: DataFrame, budget: int = 20_000, head: int = 2_000, price: str = "price") -> DataFrame:
    """Typed messages restored as a head and a tail: session_id, pos, part, kept_tokens.

    ``part`` is all, tail, split (its end in the tail, its start maybe in the head),
    head, clip (the head's last, in part) or gone.
    """
    rows = with_suffix(latest_representation(entries), price)
    head = min(head, budget)
    tail = budget - head
    p = F.col(price)
    state = F.when(F.col("total") <= budget, "all").when((F.col("later") < tail) & (F.col("later") + p <= tail), "tail").when(F.col("later") < tail, "split")
    rows = rows.withColumn("part", state)
    early = F.sum(F.when(F.col("part").isNull(), p).otherwise(0)).over(session_order().rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumns({"before": early - F.when(F.col("part").isNull(), p).otherwise(0), "heads": F.sum(F.when(F.col("part").isNull(), p).otherwise(0)).over(all_rows())})
    part = F.coalesce("part", F.when(F.col("before") + p <= head, "head").when(F.col("before") < head, "clip").otherwise("gone"))
    kept = F.when(part.isin("all", "tail", "head"), p).when(part == "split", F.lit(tail) - F.col("later") + F.greatest(F.lit(head) - F.col("heads"), F.lit(0))).when(part == "clip", F.lit(head) - F.col("before")).otherwise(0)
    return rows.select("session_id", "pos", part.alias("part"), kept.cast("long").alias("kept_tokens"))


def branch(entries: DataFrame, budget: int, price: str = "price") -> DataFrame:
    """Newest messages within ``budget``; a checkpoint that would go over is still taken while less than 90 % is used."""
    rows = with_suffix(entries.where(~F.col("role").isin("system", "developer")), price)
    over = F.col("suffix") > budget
    rows = rows.withColumn("edge", F.max(F.when(over, F.col("pos"))).over(all_rows()))
    taken = F.lit(True) if budget <= 0 else ~over & (F.col("edge").isNull() | (F.col("pos") > F.col("edge"))) | ((F.col("pos") == F.col("edge")) & checkpoint() & (F.col("later") < 0.9 * budget))
    return rows.where(taken).select("session_id", "pos", F.col(price).alias("tokens"))


def turn_tail(entries: DataFrame, budget: int, tail_turns: int | None = None) -> DataFrame:
    """Per session ``kept``: where the tail of whole turns within ``budget`` begins (its rows for none).

    Turns are taken newest first; of the first that is too large, the earliest balanced
    suffix that fits. The price of a run of messages is that of its JSON array
    (``json_len`` of the rows, commas, brackets), which is no sum of rows; but a turn's
    price depends on that turn alone, so running sums over turns tell where taking ends.
    """
    rows = turns(indexed(balanced(entries)))
    turn = W.partitionBy("session_id", "turn_no")
    upto = turn.orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    array = lambda chars, n: F.floor((chars + F.greatest(n - 1, F.lit(0)) + 4) / 4).cast("long")
    rows = rows.withColumns({"_chars": F.sum("json_len").over(turn), "_rows": F.count("*").over(turn), "_seen": F.sum("json_len").over(upto) - F.col("json_len"), "_nth": F.row_number().over(turn.orderBy("idx")) - 1})
    rows = rows.withColumn("_from", array(F.col("_chars") - F.col("_seen"), F.col("_rows") - F.col("_nth")))  # the price from this row to the turn's end
    head, clean = F.col("_nth") == 0, (F.col("open_before") == 0) & (F.col("role") != "tool")
    spots = F.collect_list(F.when(clean & ~head, F.struct("_from", "idx")))
    own = rows.groupBy("session_id", "turn_no").agg(
        F.max("n").alias("rows"), F.min("idx").alias("start"), F.max(F.when(head, F.col("_from"))).alias("size"), F.max(F.when(head, F.col("open_before") == 0)).alias("cut"), spots.alias("spots"),
    )
    back = W.partitionBy("session_id").orderBy(F.desc("turn_no"))
    sofar = back.rowsBetween(W.unboundedPreceding, 0)
    real = F.col("turn_no") > 0  # rows before the first turn belong to none
    own = own.withColumns({"_upto": F.sum("size").over(sofar), "_age": F.row_number().over(back)})
    inside = real & (F.lit(True) if tail_turns is None else F.col("_age") <= tail_turns)
    own = own.withColumn("_ends", F.max((inside & ~(F.col("cut") & (F.col("_upto") <= budget))).cast("int")).over(sofar))
    own = own.withColumn("_ended", F.coalesce(F.max("_ends").over(back.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    left = F.lit(budget) - (F.col("_upto") - F.col("size"))
    part = F.array_min(F.transform(F.filter("spots", lambda x: x["_from"] <= left), lambda x: x["idx"]))
    place = F.when(inside & (F.col("_ends") == 0), F.col("start")).when(inside & (F.col("_ended") == 0), part)
    out = own.groupBy("session_id").agg(F.max("rows").alias("rows"), F.min(place).alias("kept"))
    return out.select("session_id", "rows", F.coalesce(F.nullif("kept", F.lit(0)), F.col("rows")).alias("kept"))


def append_within(items: DataFrame, budget: int, pool: int | None = None) -> DataFrame:
    """Per session: texts put one after another under a budget of tokens, each cut to what is left.

    ``items``: session_id, ord, label, body, cap. Each text costs a quarter of its
    characters, its header included. With ``pool``, items whose column ``pooled`` is true
    also share that many tokens inside the budget; one whose column ``excerpt`` is true
    states in its header what it was cut to. Result: session_id, ord, text, used.
    """
    own = {n: F.col(n) if n in items.columns else F.lit(False) for n in ("pooled", "excerpt")}
    # No more of a body than its cap allows has to be gathered.
    body = F.substring("body", F.lit(1), F.least(F.col("cap") * 4, F.lit((1 << 31) - 1)).cast("int"))
    order = F.array_sort(F.collect_list(F.struct("ord", "label", body.alias("body"), "cap", *[c.alias(n) for n, c in own.items()])))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.lit(budget if pool is None else pool).cast("long").alias("pool"), F.array().cast("array<struct<ord:bigint,text:string,used:bigint>>").alias("out"))

    def step(a: Column, i: Column) -> Column:
        most = F.least(a["left"], i["cap"], F.when(i["pooled"], a["pool"]).otherwise(a["left"]))
        cut = F.when(i["excerpt"], F.concat(F.lit("; excerpt up to "), most.cast("string"), F.lit(" tokens"))).otherwise("")
        header = F.concat(F.lit("["), i["label"], cut, F.lit("]\n"))
        room = F.greatest(F.lit(0), most * 4 - F.length(header))
        text = F.concat(header, F.substring(i["body"], F.lit(1), room.cast("int")))
        used = F.floor((F.length(text) + 3) / 4).cast("long")
        done = F.struct(i["ord"].cast("long").alias("ord"), text.alias("text"), used.alias("used"))
        fits = (room > 0) & (F.length(i["body"]) > 0)
        spent = F.when(fits, used).otherwise(F.lit(0)).cast("long")
        return F.struct(
            (a["left"] - spent).alias("left"), (a["pool"] - F.when(i["pooled"], spent).otherwise(F.lit(0).cast("long"))).alias("pool"), F.when(fits, F.concat(a["out"], F.array(done))).otherwise(a["out"]).alias("out")
        )

    done = items.groupBy("session_id").agg(order.alias("items")).select("session_id", F.aggregate("items", start, step)["out"].alias("out"))
    return done.select("session_id", F.explode("out").alias("o")).select("session_id", "o.*")


def fit_rows(rows: DataFrame, available: int) -> DataFrame:
    """Shorten and blank until the joined rows fit ``available`` tokens of three characters.

    ``rows``: session_id, idx, grp, user (boolean), text, and ``short``, the text with
    its tool output cut closer. If the texts don't fit, all become ``short``; then the
    oldest groups without a user's text are blanked, the first row of each carrying a
    note, as many as it takes. Rows are joined by two characters, blank ones too.
    Sessions that still don't fit have ``fits`` false.

    How much blanking a group saves doesn't depend on the others, so the groups that go
    are found by a running sum over groups.
    """
    # Fixed value: what stands for a blanked group.
    note = "[Earlier assistant/tool activity omitted to fit the summary request]"
    chars = lambda c: F.sum(F.length(c)).over(all_rows()) + 2 * F.greatest(F.col("n") - 1, F.lit(0))
    tokens = lambda c: F.greatest(F.lit(1), ceil_div(c, 3))
    rows = rows.withColumn("n", F.count("*").over(all_rows()))
    rows = rows.withColumn("text", F.when(tokens(chars("text")) <= available, F.col("text")).otherwise(F.col("short")))
    group = W.partitionBy("session_id", "grp")
    may_go = ~F.max("user").over(group) & (F.min("idx").over(group) > F.min("idx").over(all_rows()))
    rows = rows.withColumns({"size": chars("text"), "may_go": may_go, "first": F.col("idx") == F.min("idx").over(group)})
    saved = F.when(F.col("may_go"), F.length("text") - F.when(F.col("first"), F.lit(len(note))).otherwise(0)).otherwise(0)
    # What the groups before this one save if all of them that may go do.
    rows = rows.withColumn("before", F.coalesce(F.sum(saved).over(W.partitionBy("session_id").orderBy("grp").rangeBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # Groups go in order until the first point at which the rest fits.
    enough = F.min(F.when(tokens(F.col("size") - F.col("before")) <= available, F.col("grp"))).over(all_rows())
    rows = rows.withColumn("stop", enough)
    gone = F.col("may_go") & (F.col("stop").isNull() | (F.col("grp") < F.col("stop")))
    rows = rows.withColumn("text", F.when(gone, F.when(F.col("first"), note).otherwise("")).otherwise(F.col("text")))
    return rows.withColumn("fits", tokens(chars("text")) <= available).select("session_id", "idx", "text", "fits")
