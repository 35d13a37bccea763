"""Chat formatting by quotation linking.

Quoted lines (``>`` marks, nested) are parsed into passages, a passage being a run of
lines of one quote level outside fenced code. Normalised passages, their lines and
their sentences are hashed and linked to the latest earlier message of the conversation
whose own text has the same whole, paragraph, line or sentence. Only what is linked
is removed from the reply; what is found nowhere stays in it.

The links make each conversation a forest. An Euler tour of every tree, ranked by
pointer jumping, gives each message its thread, depth and place in reply order, so that
branches stay apart. ``conversations`` builds from these the ordered conversations.

Only DataFrame expressions are used. A conversation, a message quoted by many, or a
passage of any size is spread over blocks of turns; no pair of messages is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

_MARK = "^[ \\t]*(?:>[ \\t]*)+"
_FENCE = "^[ \\t]*```"
_TURNS, _SALT, _MOST = 512, 16, 4096
_UNIT_WORDS = 4  # a shorter sentence or line says too little to name an original


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "\\s+", " "))


def _sentences(text: Column) -> Column:
    """The sentences of a normalised text that are long enough to link by."""
    return F.filter(F.split(text, "(?<=[.!?]) "), lambda x: F.size(F.split(x, " ")) >= _UNIT_WORDS)


def _latest_earlier(quotes: DataFrame, originals: DataFrame) -> DataFrame:
    """(conv, hash, turn) of ``quotes`` with ``link``: the latest smaller turn of ``originals`` with the same conv and hash."""
    rows = quotes.select("conv", "hash", "turn", F.lit(None).cast("long").alias("of")).distinct().union(originals.select("conv", "hash", "turn", F.col("turn").alias("of")).distinct())
    rows = rows.withColumn("block", F.floor(F.col("turn") / _TURNS))
    within = W.partitionBy("conv", "hash", "block").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max("of").over(within)).where("of is null")
    blocks = rows.groupBy("conv", "hash", "block").agg(F.max("of").alias("most"))
    before = W.partitionBy("conv", "hash").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    far = blocks.withColumn("far", F.max("most").over(before)).drop("most")
    return near.join(far, ["conv", "hash", "block"], "left").select("conv", "hash", "turn", F.coalesce("near", "far").alias("link"))


def _tour(links: DataFrame) -> DataFrame:
    """conv, turn, thread_turn, reply_depth, thread_place of every turn of a tree.

    ``links``: conv, turn, parent_turn (smaller), one row a turn. A turn is entered and
    left once in the tour; each of the two points to the step before it. As no step is
    pointed to twice, the joins of the pointer jumping have no hot key. A round doubles
    the distance: their number is the logarithm of the largest tree.
    """
    # The sibling before each turn: within its block of turns, else the last of an earlier block.
    own = links.select("conv", "parent_turn", "turn", F.floor(F.col("turn") / _TURNS).alias("block"))
    near = own.withColumn("near", F.lag("turn").over(W.partitionBy("conv", "parent_turn", "block").orderBy("turn")))
    blocks = own.groupBy("conv", "parent_turn", "block").agg(F.max("turn").alias("last"))
    blocks = blocks.withColumn("far", F.lag("last").over(W.partitionBy("conv", "parent_turn").orderBy("block"))).drop("last")
    siblings = near.join(blocks, ["conv", "parent_turn", "block"]).select("conv", "turn", "parent_turn", F.coalesce("near", "far").alias("sibling"))
    last = links.groupBy("conv", F.col("parent_turn").alias("turn")).agg(F.max("turn").alias("last_child"))
    nodes = siblings.join(last, ["conv", "turn"], "full")
    step = lambda turn, left: F.struct(turn.alias("turn"), F.lit(left).alias("left"))
    entered = F.when(F.col("sibling").isNotNull(), step(F.col("sibling"), True)).when(F.col("parent_turn").isNotNull(), step(F.col("parent_turn"), False))
    left = F.when(F.col("last_child").isNotNull(), step(F.col("last_child"), True)).otherwise(step(F.col("turn"), False))
    both = F.explode(F.array(F.struct(F.lit(False).alias("left"), entered.alias("to")), F.struct(F.lit(True).alias("left"), left.alias("to"))))
    tour = nodes.select("conv", "turn", both.alias("e")).select("conv", "turn", "e.left", F.col("e.to.turn").alias("to_turn"), F.col("e.to.left").alias("to_left"))
    there = F.col("to_turn").isNotNull()
    # Steps entered and left from the one pointed to up to, not with, this one; ``start`` is known at the end.
    tour = tour.withColumns({"ins": F.when(there & ~F.col("to_left"), 1).otherwise(0).cast("long"), "outs": F.when(there & F.col("to_left"), 1).otherwise(0).cast("long"), "start": F.when(~there, F.col("turn"))})
    tour = materialize(tour, "tour")
    while tour.where("to_turn is not null").limit(1).count():
        nxt = tour.select("conv", F.col("turn").alias("to_turn"), F.col("left").alias("to_left"), F.col("to_turn").alias("n_turn"), F.col("to_left").alias("n_left"), F.col("ins").alias("n_ins"), F.col("outs").alias("n_outs"), F.col("start").alias("n_start"))
        jumped = tour.join(nxt, ["conv", "to_turn", "to_left"], "left")
        zero = F.lit(0).cast("long")
        tour = materialize(jumped.select("conv", "turn", "left", F.col("n_turn").alias("to_turn"), F.col("n_left").alias("to_left"), (F.col("ins") + F.coalesce("n_ins", zero)).alias("ins"), (F.col("outs") + F.coalesce("n_outs", zero)).alias("outs"), F.coalesce("start", "n_start").alias("start")), "tour")
    return tour.where("not left").select("conv", "turn", F.col("start").alias("thread_turn"), (F.col("ins") - F.col("outs")).alias("reply_depth"), F.col("ins").alias("thread_place"))


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per row: conv, turn, role, reply_text (without linked quotes), n_quoted_lines, n_passages,
    n_linked, parent_turn, thread_turn, reply_depth, thread_place.

    A passage that is found as a whole goes as a whole. Of others, lines of at least four
    words that are found go, shorter ones only beside another found line, and sentences of
    at least four words that are found, also where they are wrapped or stand beside others
    in a line. What is found in no earlier message stays in ``reply_text``, as do marks in
    fenced code and passages without a word, which don't count. A quoted line without a
    word goes with the last of its passage. ``n_linked`` counts what was found: wholes,
    else lines, else sentences. ``parent_turn`` is the message with the most linked words,
    among passages of level one if any is linked there, the latest of equal ones; null
    without a link. Each unit is linked to the latest earlier message that has it.
    ``thread_turn`` is the turn that its chain of parents begins with (its own without
    a parent), ``reply_depth`` the length of that chain, ``thread_place`` its place in
    the thread (from 0), every message after the one it answers and before the next
    branch. Null texts count as empty; texts of any length are read whole. Rows with a
    null conversation or turn are their own threads (thread_turn is then the turn).
    Repeated rows are linked alike; several messages of one turn share a parent, the
    latest of theirs, and a place. An empty table gives an empty one; columns of other
    names are left out.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), t.alias("text"))
    rows = rows.withColumn("mid", F.sha2(F.col("text"), 256))
    quoting = rows.where("conv is not null and turn is not null").where(F.col("text").rlike("(?m)" + _MARK)).select("conv", "turn", "mid", "text").distinct()
    # One row for each line of a quoting message; runs of one level are passages.
    each = quoting.select("conv", "turn", "mid", F.posexplode(F.split("text", "\\r?\\n", -1)).alias("at", "line"))
    message = W.partitionBy("conv", "turn", "mid").orderBy("at")
    fences = F.sum(F.col("line").rlike(_FENCE).cast("int")).over(message)
    mark = F.when(fences % 2 == 0, F.regexp_extract("line", _MARK, 0)).otherwise("")
    each = each.withColumn("mark", mark).withColumns({"level": F.length("mark") - F.length(F.translate("mark", ">", "")), "body": F.substring("line", F.length("mark") + 1, F.length("line"))})
    each = each.withColumn("new", (F.coalesce(F.lag("level").over(message), F.lit(-1)) != F.col("level")).cast("int"))
    each = materialize(each.withColumn("passage", F.sum("new").over(message)).drop("new"), "quote-lines")
    of_message = ["conv", "turn", "mid"]
    of_passage = [*of_message, "passage"]
    # A line's pieces end where a sentence ends or the line does; a sentence is one or more pieces.
    split = F.split(F.btrim("body", F.lit(" \t\r\n\x0b\f")), "(?<=[.!?])\\s+", -1)
    pieces = each.where("level > 0").select(*of_passage, "level", "at", F.posexplode(split).alias("nth", "piece")).withColumn("body", _normal(F.col("piece"))).where("body <> ''")
    place = W.partitionBy(*of_passage).orderBy("at", "nth")
    ended = F.coalesce(F.lag(F.col("body").rlike("[.!?]$")).over(place), F.lit(False))
    pieces = pieces.withColumns({"ended": ended.cast("int"), "words": F.size(F.split("body", " "))})
    pieces = materialize(pieces.withColumn("sentence", F.sum("ended").over(place).cast("int")).drop("ended"), "quote-pieces")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "nth", "body"))), lambda x: x["body"]), " ")
    unit = lambda rank, of: pieces.groupBy(*of_passage, of.alias("unit")).agg(joined.alias("body"), F.sum("words").alias("words")).withColumn("rank", F.lit(rank))
    units = unit(0, F.lit(0)).unionByName(unit(1, F.col("at"))).unionByName(unit(2, F.col("sentence")).where(F.col("words") >= _UNIT_WORDS))
    keyed = materialize(units.select(*of_passage, "rank", "unit", "words", F.sha2("body", 256).alias("hash")), "quote-keys")
    # Only conversations with a quote are searched; dealt by a salt, as one may hold most messages.
    convs = keyed.select("conv").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1))))
    salted = rows.where("turn is not null").withColumn("salt", F.pmod(F.xxhash64("turn", "mid"), F.lit(_SALT)).cast("int")).join(convs, ["conv", "salt"], "left_semi")
    unquoted = each.where("level = 0").groupBy(*of_message).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("unquoted"))
    marked = each.select(*of_message).distinct().join(unquoted, of_message, "left").withColumn("unquoted", F.coalesce("unquoted", F.lit("")))
    own = salted.join(marked, of_message, "left").select("conv", "turn", F.coalesce("unquoted", "text").alias("own"))
    paragraphs = F.split("own", "\\r?\\n[ \\t]*\\r?\\n")
    units = F.concat(F.array(_normal(F.col("own"))), F.transform(paragraphs, _normal), F.transform(F.split("own", "\\r?\\n"), _normal), F.flatten(F.transform(paragraphs, lambda x: _sentences(_normal(x)))))
    originals = own.select("conv", "turn", F.explode(F.array_distinct(units)).alias("body")).where("body <> ''").select("conv", "turn", F.sha2("body", 256).alias("hash"))
    linked = keyed.join(_latest_earlier(keyed, originals), ["conv", "hash", "turn"], "left")
    # A short line says too little alone: it needs a found line beside it.
    there, lines = F.col("link").isNotNull(), W.partitionBy(*of_passage, "rank").orderBy("unit")
    beside = F.coalesce(F.lag(there).over(lines), F.lit(False)) | F.coalesce(F.lead(there).over(lines), F.lit(False))
    sure = there & ((F.col("rank") != 1) | (F.col("words") >= _UNIT_WORDS) | beside)
    linked = materialize(linked.withColumn("sure", sure).where("sure").select(*of_passage, "rank", "unit", "link"), "quotes")
    for rank, of in ((0, None), (1, "at"), (2, "sentence")):
        own = linked.where(F.col("rank") == rank).select(*of_passage, *([F.col("unit").alias(of)] if of else []), F.col("link").alias(f"link{rank}"))
        pieces = pieces.join(own, [*of_passage, *([of] if of else [])], "left")
    gone = [F.col(f"link{rank}").isNotNull() for rank in range(3)]
    taken = F.when(gone[0], F.struct(F.lit(0).alias("rank"), F.lit(0).alias("unit"))).when(gone[1], F.struct(F.lit(1).alias("rank"), F.col("at").alias("unit"))).when(gone[2], F.struct(F.lit(2).alias("rank"), F.col("sentence").alias("unit")))
    pieces = materialize(pieces.select(*of_passage, "level", "at", "nth", "piece", "words", taken.alias("taken"), F.coalesce("link0", "link1", "link2").alias("link")), "quote-links")
    counts = pieces.groupBy(*of_message).agg(F.count_distinct("passage").alias("n_passages"), F.count_distinct(F.when(F.col("taken").isNotNull(), F.struct("passage", "taken"))).alias("n_linked"))
    shares = pieces.where("link is not null").groupBy(*of_message, (F.col("level") == 1).alias("direct"), "link").agg(F.sum("words").alias("words"))
    parents = shares.groupBy(*of_message).agg(F.max_by("link", F.struct("direct", "words", "link")).alias("parent_turn"))
    found = counts.join(parents, of_message, "left")
    left = F.array_sort(F.collect_list(F.when(F.col("link").isNull(), F.struct("nth", "piece"))))
    by_line = pieces.groupBy(*of_passage, "at").agg(F.transform(left, lambda x: x["piece"]).alias("left"), F.count("*").alias("n"))
    by_passage = pieces.groupBy(*of_passage).agg(F.count_if(F.col("link").isNull()).alias("stay"))
    lines_left = each.join(by_line, [*of_passage, "at"], "left").join(by_passage, of_passage, "left")
    whole = F.when(F.col("left").isNull(), (F.coalesce("stay", F.lit(1)) > 0) | (F.col("level") == 0)).otherwise(F.size("left") == F.col("n"))
    line = F.when(whole, F.col("line")).when(F.size("left") > 0, F.concat("mark", F.array_join("left", " ")))
    kept = F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct(F.col("at"), line.alias("line")))))
    replies = lines_left.groupBy(*of_message).agg(F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("reply"), F.count_if(F.col("level") > 0).alias("n_quoted_lines"))
    replies = materialize(replies.join(found, of_message, "left"), "replies")
    links = materialize(replies.where("parent_turn is not null").groupBy("conv", "turn").agg(F.max("parent_turn").alias("parent_turn")), "reply-links")
    out = rows.join(replies.drop("parent_turn"), of_message, "left").join(_tour(links), ["conv", "turn"], "left").join(links, ["conv", "turn"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), F.btrim(F.coalesce("reply", "text"), F.lit(" \t\r\n")).alias("reply_text"),
        F.coalesce("n_quoted_lines", zero).alias("n_quoted_lines"), F.coalesce("n_passages", zero).alias("n_passages"), F.coalesce("n_linked", zero).alias("n_linked"),
        "parent_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("reply_depth", zero).alias("reply_depth"), F.coalesce("thread_place", zero).alias("thread_place"),
    )


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The conversations in reply order without quotes: conv, part, piece, n_messages, messages.

    ``messages`` is an array of (place, turn, role, text, parent_turn, reply_depth) by
    place: threads in the order of their first turns, each in the order of its branches.
    A row holds 512 places of a conversation, ``part`` numbers them; in the odd case of
    more than 4,096 different messages there (many at one turn), they are dealt by hash
    over several ``piece`` rows. So no row grows with a conversation. Equal messages of
    one turn are one. Rows with a null turn come last in their conversation, rows with a
    null conversation stand under null. See ``link_quotes`` for the rest.
    """
    rows = materialize(link_quotes(messages, conv, turn, role, text).select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col("reply_text").alias("text"), "parent_turn", "thread_turn", "reply_depth", "thread_place"), "linked")
    # Where each thread begins: running sums within blocks of turns, and over the blocks.
    threads = rows.groupBy("conv", "thread_turn").agg((F.max("thread_place") + 1).alias("n")).withColumn("block", F.floor(F.col("thread_turn") / _TURNS))
    upto = W.partitionBy("conv", "block").orderBy(F.asc_nulls_last("thread_turn")).rowsBetween(W.unboundedPreceding, -1)
    blocks = threads.groupBy("conv", "block").agg(F.sum("n").alias("n"))
    before = W.partitionBy("conv").orderBy(F.asc_nulls_last("block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv").alias("b_conv"), F.col("block").alias("b_block"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    begins = threads.withColumn("nth", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(blocks, F.col("conv").eqNullSafe(F.col("b_conv")) & F.col("block").eqNullSafe(F.col("b_block")))
    begins = begins.select(F.col("conv").alias("t_conv"), F.col("thread_turn").alias("t_turn"), (F.col("base") + F.col("nth")).alias("begin"))
    placed = rows.join(begins, F.col("conv").eqNullSafe(F.col("t_conv")) & F.col("thread_turn").eqNullSafe(F.col("t_turn"))).withColumn("place", F.col("begin") + F.col("thread_place"))
    placed = placed.withColumn("part", F.floor(F.col("place") / _TURNS))
    crowded = placed.groupBy(F.col("conv").alias("c_conv"), F.col("part").alias("c_part")).agg(F.ceil(F.count("*") / _MOST).alias("pieces")).where("pieces > 1")
    placed = placed.join(crowded, F.col("conv").eqNullSafe(F.col("c_conv")) & (F.col("part") == F.col("c_part")), "left")
    placed = placed.withColumn("piece", F.coalesce(F.pmod(F.xxhash64("turn", "role", "text"), F.col("pieces")), F.lit(0)).cast("int"))
    built = placed.groupBy("conv", "part", "piece").agg(F.array_sort(F.collect_set(F.struct("place", "turn", "role", "text", "parent_turn", "reply_depth"))).alias("messages"))
    return built.select(F.col("conv").alias(conv), "part", "piece", F.size("messages").cast("long").alias("n_messages"), "messages")
