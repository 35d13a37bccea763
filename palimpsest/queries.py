"""Registered queries over the supplied tables, each with its SQL where SQL can say it.

``conversations`` is read as session logs directly; ``events`` through the adapter that
``sources.logs.entries_from_events`` describes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions import blocks, faults, pricing, text
from .functions.blocks import message_text
from .operators import lineage, lookups, pruning, selection, state, structure, surface, trials, usage
from .plans import compaction, presets, restoration, retries, strategies
from .sources import logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations priced at a quarter of their characters."""
    return compaction.priced(logs.entries_from_conversations(logs.table(spark, sf_dir, "conversations")), pricing.chars4(F.col("blocks")))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.entries_from_events(logs.table(spark, sf_dir, "events")).withColumn("price", F.col("tokens"))


U16 = r"(length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')))"
CONV = f"""e AS (SELECT conv_id AS session_id, turn AS pos, role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, (({U16} + 3) // 4)::BIGINT AS price, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS idx, count(*) OVER (PARTITION BY session_id) AS n FROM e),
s AS (SELECT *, sum(price) OVER (PARTITION BY session_id)::BIGINT AS total,
             coalesce(sum(price) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::BIGINT AS later FROM p)"""
LOG = """t0 AS (SELECT *, regexp_extract(props, '[0-9]+')::BIGINT AS k, floor(value * 100)::BIGINT AS chars FROM events),
t AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_id AS seq, epoch_us(ts) // 1000 AS time_ms, event_type AS kind, k, chars,
  (chars + 3) // 4 AS price, 'm' || (k % 50) AS message_id,
  CASE WHEN event_type = 'signup' AND k % 25 = 0 THEN 'system' WHEN event_type = 'signup' THEN 'user' WHEN event_type IN ('view', 'purchase') THEN 'assistant' ELSE 'tool' END AS role,
  CASE WHEN event_type = 'signup' THEN CASE k % 25 WHEN 0 THEN 'system-prompt' WHEN 1 THEN 'compact-checkpoint' ELSE 'user' END WHEN event_type IN ('view', 'purchase') THEN 'model' ELSE 'tool' END AS source_kind,
  CASE WHEN event_type = 'signup' AND k % 25 > 1 THEN CASE k % 7 WHEN 0 THEN 'snapshot' WHEN 1 THEN 'instructions' END END AS source_form,
  CASE WHEN event_type = 'view' THEN 'c' || (k % 4) END AS call_id, CASE WHEN event_type IN ('click', 'error') THEN 'c' || (k % 4) END AS result_id,
  event_type = 'error' AS is_error, CASE WHEN event_type = 'purchase' THEN CASE k % 10 WHEN 0 THEN 'error' WHEN 1 THEN 'aborted' ELSE 'stop' END END AS finish,
  event_type = 'purchase' AS has_usage, chars // 2 AS u_input, chars // 4 AS u_output, 10 AS u_cache, CASE WHEN k % 3 > 0 THEN chars WHEN k % 2 = 0 THEN 0 END AS u_total,
  'src/f' || (k % 20) || '.py' AS path, list_extract(['read_file', 'write-file', 'Bash', 'grep'], (k % 4 + 1)::INTEGER) AS tool
  FROM t0)"""
CALLS = """ev AS (SELECT session_id, pos, coalesce(call_id, result_id) AS id, call_id IS NOT NULL AS call FROM t WHERE call_id IS NOT NULL OR result_id IS NOT NULL),
iv0 AS (SELECT *, min(CASE WHEN NOT call THEN pos END) OVER (PARTITION BY session_id, id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closed_at FROM ev),
iv AS (SELECT session_id, pos, id, closed_at FROM iv0 WHERE call),
st AS (SELECT session_id, pos, sum(d)::BIGINT AS d FROM (SELECT session_id, pos, 1 AS d FROM iv UNION ALL SELECT session_id, closed_at, -1 FROM iv WHERE closed_at IS NOT NULL) GROUP BY ALL),
b AS (SELECT t.*, coalesce(d, 0) AS d, (sum(coalesce(d, 0)) OVER (PARTITION BY t.session_id ORDER BY t.pos))::BIGINT AS open_after,
             row_number() OVER (PARTITION BY t.session_id ORDER BY t.pos) - 1 AS idx, count(*) OVER (PARTITION BY t.session_id) AS n FROM t LEFT JOIN st ON t.session_id = st.session_id AND t.pos = st.pos),
c AS (SELECT *, open_after - d AS open_before, sum(price) OVER (PARTITION BY session_id)::BIGINT AS total,
             coalesce(sum(price) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::BIGINT AS later FROM b)"""

# The log without results that no open call expects.
EXPECTED = LOG.replace("t AS (SELECT user_id", "ta AS (SELECT user_id") + """,
ux AS (SELECT session_id, pos FROM (SELECT session_id, pos, result_id, lag(call_id IS NOT NULL) OVER (PARTITION BY session_id, coalesce(call_id, result_id) ORDER BY pos) AS prior FROM ta WHERE call_id IS NOT NULL OR result_id IS NOT NULL) WHERE result_id IS NOT NULL AND NOT coalesce(prior, false)),
t AS (SELECT * FROM ta WHERE NOT EXISTS (SELECT 1 FROM ux WHERE ux.session_id = ta.session_id AND ux.pos = ta.pos))"""
# The rows of each session's first span that has more than checkpoints in it.
FIRST_SPAN = LOG.replace("t AS (SELECT user_id", "ta AS (SELECT user_id") + """,
i0 AS (SELECT *, sum((role = 'system')::BIGINT) OVER (PARTITION BY session_id ORDER BY pos) AS island FROM ta),
i1 AS (SELECT session_id, min(island) AS island FROM i0 WHERE role <> 'system' AND source_kind <> 'compact-checkpoint' GROUP BY session_id),
t AS (SELECT i0.* EXCLUDE (island) FROM i0 JOIN i1 ON i0.session_id = i1.session_id AND i0.island = i1.island WHERE role <> 'system')"""

# The rows of all spans with more than checkpoints in them; session_id is the span's, ``owner`` the session.
SPANS = LOG.replace("t AS (SELECT user_id", "ta AS (SELECT user_id") + """,
i0 AS (SELECT *, sum((role = 'system')::BIGINT) OVER (PARTITION BY session_id ORDER BY pos) AS island, coalesce(sum(price) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS tail FROM ta),
i1 AS (SELECT *, bool_or(source_kind <> 'compact-checkpoint') OVER (PARTITION BY session_id, island) AS fresh FROM i0 WHERE role <> 'system'),
t AS (SELECT * EXCLUDE (session_id, fresh), session_id AS owner, session_id || '#' || island AS session_id FROM i1 WHERE fresh)"""

# --- prices


def _priced(name: str, of, sql: str) -> None:
    @query(name, f"WITH e AS (SELECT conv_id AS session_id, turn AS pos, role, coalesce(text, '') AS text FROM conversations) SELECT session_id, pos, ({sql})::BIGINT AS tokens FROM e")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = logs.entries_from_conversations(logs.table(spark, sf_dir, "conversations"))
        return rows.select("session_id", "pos", of().cast("long").alias("tokens"))


_first = lambda: F.col("blocks")[0]["text"]
_priced("price_chars4", lambda: pricing.chars4(F.col("blocks")), f"({U16} + 3) // 4")
_priced("price_chars4_others", lambda: pricing.chars4(F.col("blocks"), others=True), f"({U16} + 3) // 4")
_priced("price_block4", lambda: pricing.block4(F.col("blocks")), f"({U16} + 3) // 4")
_priced("price_bytes4", lambda: pricing.bytes4(F.col("blocks"), F.col("role"), F.lit("")), "(strlen(text) + 3) // 4")
ASCII = r"length(regexp_replace({0}, '[^\x00-\x7F]', '', 'g'))"
_WEIGHTED = lambda c: f"(({ASCII.format(c)} + 3) // 4 + length({c}) - {ASCII.format(c)})"
_priced("price_ascii_weighted", lambda: pricing.weighted_message(F.col("blocks"), F.col("role")), f"{_WEIGHTED('text')} + {_WEIGHTED('role')}")
_CJK = r"length(regexp_replace(text, '[^\x{3400}-\x{9fff}\x{f900}-\x{faff}]', '', 'g'))"
_priced("price_cjk", lambda: pricing.cjk(_first()), f"({_CJK} * 6 + ({U16} - {_CJK}) + 3) // 4")
_MESSAGE = "'{\"role\":\"' || role || '\",\"content\":\"' || replace(replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n') || '\"}'"


def _message_json():
    return F.to_json(F.struct("role", _first().alias("content")))


_priced("price_json3", lambda: pricing.json3(_message_json()), f"greatest(1, (length({_MESSAGE}) + length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) + 2) // 3)")


@query("price_slice_json4", f"""WITH e AS (SELECT conv_id AS session_id, role, coalesce(text, '') AS text FROM conversations)
SELECT session_id, ((sum(length({_MESSAGE}) + length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))) + greatest(count(*) - 1, 0) + 4) // 4)::BIGINT AS tokens FROM e GROUP BY session_id""")
def price_slice_json4(spark, sf_dir):
    rows = conv(spark, sf_dir).groupBy("session_id").agg(F.sum(text.u16len(_message_json())).alias("len"), F.count("*").alias("n"))
    return rows.select("session_id", pricing.slice_json4(F.col("len"), F.col("n")).alias("tokens"))


_PARTS = "x AS (SELECT *, 'thought ' || k AS thought, CASE WHEN call_id IS NULL THEN kind || ' ' || k ELSE '{\"path\": \"' || path || '\"}' END AS body FROM t WHERE role IN ('user', 'assistant'))"
_CALLED = "CASE WHEN call_id IS NULL THEN 0 ELSE length(tool) END + length(body)"
_CALL_JSON = """length('{"type":"tool-call","id":"' || call_id || '","name":"' || tool || '","arguments":"{\\"path\\": \\"' || path || '\\"}"}')"""
_FILE_JSON = """length('{"type":"file","media_type":"text/csv"}')"""


@query("price_mixed_blocks", f"""WITH {LOG}, {_PARTS}, y AS (SELECT *, {_CALLED} + length(thought) AS plain, (length(thought) + 3) // 4 AS th, CASE WHEN call_id IS NULL THEN (length(body) + 3) // 4 ELSE ({_CALL_JSON} + 3) // 4 END AS own FROM x)
SELECT session_id, pos, ((plain + 4800 + 3) // 4)::BIGINT AS whole, ((plain + {_FILE_JSON} + length('{{"type":"image","media_type":"image/png"}}') + 3) // 4)::BIGINT AS others,
 (own + th + 2000 + ({_FILE_JSON} + 3) // 4)::BIGINT AS by_block, (own + th + 1600 + ({_FILE_JSON} + 3) // 4)::BIGINT AS by_block_small, (({_CALLED} + 7373 + 3) // 4)::BIGINT AS bytes FROM y""")
def price_mixed_blocks(spark, sf_dir):
    """Messages with speech or a call, reasoning, an image and a file, where the prices differ."""
    rows = log(spark, sf_dir).where("role in ('user', 'assistant')")
    thought = logs.block("reasoning", F.concat(F.lit("thought "), F.col("k").cast("string")))
    b = F.concat("blocks", F.array(thought, logs.block("image", media_type=F.lit("image/png")), logs.block("file", media_type=F.lit("text/csv"))))
    rows = rows.withColumn("blocks", b)
    b = F.col("blocks")
    return rows.select(
        "session_id", "pos", pricing.chars4(b).alias("whole"), pricing.chars4(b, others=True).alias("others"), pricing.block4(b).alias("by_block"), pricing.block4(b, image=1600).alias("by_block_small"),
        pricing.bytes4(b, F.col("role"), F.lit("")).alias("bytes"),
    )


@query("usage_totals_of_rows", f"""WITH {LOG} SELECT session_id, pos, coalesce(nullif(u_total, 0), u_input + u_output + u_cache)::BIGINT AS zero_absent, coalesce(u_total, u_input + u_output + u_cache)::BIGINT AS zero_counts FROM t WHERE has_usage""")
def usage_totals_of_rows(spark, sf_dir):
    u = F.col("usage")
    return log(spark, sf_dir).where("usage is not null").select("session_id", "pos", pricing.usage_total(u, True).alias("zero_absent"), pricing.usage_total(u, False).alias("zero_counts"))


@query("metered_prices", f"WITH {LOG} SELECT session_id, pos, CASE WHEN k % 2 = 0 THEN k ELSE price END::BIGINT AS tokens FROM t")
def metered_prices(spark, sf_dir):
    return log(spark, sf_dir).select("session_id", "pos", pricing.metered(F.when(F.col("k") % 2 == 0, F.col("k")), F.col("price")).cast("long").alias("tokens"))


# --- context size


@query("context_totals", f"WITH {CONV} SELECT session_id, sum(price)::BIGINT AS tokens, count(*) AS messages FROM p GROUP BY session_id")
def context_totals(spark, sf_dir):
    return conv(spark, sf_dir).groupBy("session_id").agg(F.sum("price").alias("tokens"), F.count("*").alias("messages"))


_ANCHOR = {
    "stale_flag": ("coalesce(nullif(u_total, 0), u_input + u_output + u_cache)", "finish NOT IN ('error', 'aborted') AND n > 0", "a.n + later", "total", "a.seq < cp"),
    "since_checkpoint": ("coalesce(u_total, u_input + u_output + u_cache)", "finish NOT IN ('error', 'aborted') AND n > 0 AND seq >= cp", "a.n + later", "total", "false"),
    "last_only": ("coalesce(nullif(u_total, 0), u_input + u_output + u_cache)", "true", "a.n", "total", "false"),
    "clamped": ("coalesce(u_total, u_input + u_output + u_cache)", "true", "greatest(a.n - coalesce(r.gone, 0), 0) + later", "total", "false"),
    "floored": ("u_input + u_output + u_cache", "true", "greatest(a.n + z.later - coalesce(r.gone, 0), 0)", "total", "false"),
    "padded": ("u_input + u_output + u_cache", "true", "greatest(a.n + (later * 3 + 1) // 2 - coalesce(r.gone, 0), 0)", "(total * 3 + 1) // 2", "false"),
}


#: Rows after the first of the anchor's message id, without its own: an answer may be several rows with results between.
_FLOORED = """, b AS (SELECT a.session_id, a.message_id, a.pos, coalesce(max(t.pos), -1) AS other FROM a LEFT JOIN t ON t.session_id = a.session_id AND t.role = 'assistant' AND t.pos < a.pos AND t.message_id <> a.message_id GROUP BY ALL),
f AS (SELECT b.session_id, b.message_id, min(t.pos) AS first FROM b JOIN t ON t.session_id = b.session_id AND t.message_id = b.message_id AND t.pos > b.other GROUP BY ALL),
z AS (SELECT f.session_id, coalesce(sum(t.price), 0) AS later FROM f LEFT JOIN t ON t.session_id = f.session_id AND t.pos > f.first AND t.message_id <> f.message_id GROUP BY f.session_id)"""


def _context(policy: str) -> None:
    count, valid, size, bare, stale = _ANCHOR[policy]
    more, join = (_FLOORED, " LEFT JOIN z ON z.session_id = d.session_id") if policy == "floored" else ("", "")

    @query(f"context_{policy}", f"""WITH {LOG}, cps AS (SELECT session_id, coalesce(max(CASE WHEN source_kind = 'compact-checkpoint' THEN seq END), -1) AS cp FROM t GROUP BY session_id),
w AS (SELECT t.*, cp, {count} AS n, sum(price) OVER (PARTITION BY t.session_id) AS total, coalesce(sum(price) OVER (PARTITION BY t.session_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM t JOIN cps ON t.session_id = cps.session_id),
a AS (SELECT * FROM w WHERE has_usage AND {valid} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) = 1),
r AS (SELECT session_id, seq, sum(k)::BIGINT AS gone FROM t WHERE has_usage GROUP BY ALL){more}
SELECT d.session_id, CASE WHEN a.n IS NULL THEN {bare.replace('total', 'd.total')} ELSE {size} END::BIGINT AS tokens, coalesce({stale}, false) AS stale
FROM (SELECT session_id, sum(price) AS total FROM t GROUP BY session_id) d LEFT JOIN a ON a.session_id = d.session_id LEFT JOIN r ON r.session_id = a.session_id AND r.seq = a.seq{join}""")
    def run(spark, sf_dir):
        rows = log(spark, sf_dir)
        removed = rows.where("usage is not null").select("session_id", "seq", F.col("k").alias("tokens"))
        return usage.context_size(rows, policy, removed=removed if policy in ("clamped", "floored", "padded") else None)


for _p in _ANCHOR:
    _context(_p)


@query("request_budget", f"""WITH {LOG}, cps AS (SELECT session_id, coalesce(max(CASE WHEN source_kind = 'compact-checkpoint' THEN seq END), -1) AS cp FROM t GROUP BY session_id),
w AS (SELECT t.*, CASE WHEN u_total IS NOT NULL THEN u_total - u_output ELSE u_input + u_cache END AS seen FROM t JOIN cps USING (session_id) WHERE seq > cp),
a AS (SELECT session_id, seen FROM w WHERE has_usage AND finish NOT IN ('error', 'aborted') AND seen > 0 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) = 1),
m AS (SELECT session_id, coalesce(sum(price) FILTER (role <> 'system'), 0) AS messages, coalesce(sum(price) FILTER (role = 'system'), 0) AS overhead FROM t GROUP BY session_id),
q0 AS (SELECT session_id, role, lag(role) OVER (PARTITION BY session_id ORDER BY pos) AS prior FROM t WHERE role = 'assistant' OR (role = 'user' AND source_kind = 'user')),
q AS (SELECT session_id, count(*) FILTER (role = 'assistant' AND prior = 'user') AS pairs FROM q0 GROUP BY session_id),
f AS (SELECT m.session_id, messages + overhead AS request, messages, overhead, coalesce(pairs, 0) AS pairs, 90000::DOUBLE / least(4.0::DOUBLE, greatest(1.0::DOUBLE, coalesce(seen, 0)::DOUBLE / (messages + overhead))) AS input FROM m LEFT JOIN a USING (session_id) LEFT JOIN q USING (session_id)),
g AS (SELECT *, greatest(0, least(input * 0.9::DOUBLE, input)) AS trig FROM f)
SELECT session_id, request::BIGINT AS request_tokens, floor(trig)::BIGINT AS trigger_tokens, greatest(1, floor(trig - overhead))::BIGINT AS message_trigger_tokens,
 greatest(1, floor(least(CASE WHEN pairs >= 5 AND 8192 < input THEN input * 0.5::DOUBLE ELSE trig * 0.7::DOUBLE END, trig - 1) - overhead))::BIGINT AS target_tokens, pairs, request >= trig AS fires FROM g""")
def request_budget(spark, sf_dir):
    rows = log(spark, sf_dir)
    sessions = rows.select("session_id").distinct().select("session_id", F.lit(100_000).cast("long").alias("context_window"), F.lit(None).cast("long").alias("input_limit"), F.lit(8_192).cast("long").alias("max_output_tokens"))
    return usage.request_budget(rows, sessions)


# --- budgets and triggers

_INPUTS = "i(w, o) AS (VALUES (131072::BIGINT, 8192::BIGINT), (200000, 32000), (50000, 8000), (50001, 8000), (1048576, 0))"
_BUDGET_SQL = {
    "idle_headroom": ("greatest(0, w - least(o, 20000)) - 13000", "0"),
    "user_tail": ("least(floor(w * 0.9::DOUBLE), w)", "20000"),
    "turn_tail": ("floor(greatest(0, w - CASE WHEN o = 0 THEN 32000 ELSE o END))", "least(15000, greatest(2000, floor(greatest(0, w - CASE WHEN o = 0 THEN 32000 ELSE o END) * 0.25::DOUBLE)))"),
    "split_turn": ("greatest(0, w - 16384)", "20000"),
    "image_guard": ("floor(CASE WHEN w - 33000 > 0 THEN least(w * 0.85::DOUBLE, w - 33000) ELSE w * 0.85::DOUBLE END)", "0"),
    "round_keep": ("w - least(o, 21000) - 13000", "0"),
    "head_tail": ("least(ceil(w * 0.85::DOUBLE), CASE WHEN 50000 < w THEN w - 50000 ELSE w END)", "20000"),
    "calibrated": ("floor(least(w * 0.9::DOUBLE * 0.9::DOUBLE, w * 0.9::DOUBLE))", "20000"),
    "host_native": ("floor(least(w * 0.8::DOUBLE, w - o - 65536))", "floor((w - o) * 0.16::DOUBLE)"),
}


@query("budget_table", f"WITH {_INPUTS} " + " UNION ALL ".join(f"SELECT w AS \"window\", o AS output, '{s}' AS strategy, greatest(0, {t})::BIGINT AS trigger, greatest(0, {k})::BIGINT AS retain, {'true' if s == 'split_turn' else 'false'} AS strict FROM i" for s, (t, k) in _BUDGET_SQL.items()))
def budget_table(spark, sf_dir):
    inputs = spark.sql("SELECT * FROM VALUES (131072L, 8192L), (200000L, 32000L), (50000L, 8000L), (50001L, 8000L), (1048576L, 0L) AS t(window, output)")
    return strategies.budget_table(inputs, strategies=(*strategies.STRATEGIES, "host_native"))


@query("pressure_flags", f"""WITH {LOG}, m AS (SELECT session_id, sum(price)::BIGINT AS tokens FROM t GROUP BY session_id), x AS (SELECT session_id, tokens, 100000::BIGINT AS w, 8192::BIGINT AS o FROM m)
{" UNION ALL ".join(f"SELECT session_id, '{s}' AS strategy, tokens, greatest(0, {t})::BIGINT AS trigger, tokens {'>' if s == 'split_turn' else '>='} greatest(0, {t}) AS fires FROM x" for s, (t, _) in _BUDGET_SQL.items() if s != "host_native")}""")
def pressure_flags(spark, sf_dir):
    sums = log(spark, sf_dir).groupBy("session_id").agg(F.sum("price").alias("tokens")).select("session_id", "tokens", F.lit(100_000).cast("long").alias("window"), F.lit(8_192).cast("long").alias("output"))
    budgets = [F.struct(F.lit(s).alias("strategy"), strategies.budget(s, F.col("window"), F.col("output"))[0].alias("trigger")) for s in strategies.STRATEGIES]
    rows = sums.select("session_id", "tokens", F.inline(F.array(*budgets)))
    return rows.select("session_id", "strategy", "tokens", "trigger", strategies.fires(F.col("tokens"), F.col("trigger"), F.col("strategy") == "split_turn").alias("fires"))


@query("usable_windows", f"""WITH {LOG} SELECT DISTINCT session_id, greatest(0, CASE WHEN session_id % 3 = 0 THEN 50000 - 8192 ELSE 100000 - CASE WHEN session_id % 3 = 1 THEN 32000 ELSE 8192 END END)::BIGINT AS usable FROM t""")
def usable_windows(spark, sf_dir):
    s = F.col("session_id") % 3
    limit, out = F.when(s == 0, F.lit(50_000)), F.when(s == 1, F.lit(0)).otherwise(8_192)
    return log(spark, sf_dir).select("session_id").distinct().select("session_id", strategies.usable_window(F.lit(100_000), out, limit).alias("usable"))


@query("observed_windows", f"""WITH {LOG}, o AS (SELECT session_id, 'r' || (k % 3) AS route, seq, price * 100 AS observed FROM t WHERE kind = 'error' AND k % 2 = 0)
SELECT session_id, route, max_by(observed, seq)::BIGINT AS observed, floor(least(least(100000, max_by(observed, seq)) * 0.85::DOUBLE, CASE WHEN 50000 < least(100000, max_by(observed, seq)) THEN least(100000, max_by(observed, seq)) - 50000 END))::BIGINT AS trigger FROM o GROUP BY ALL""")
def observed_windows(spark, sf_dir):
    rows = log(spark, sf_dir).where(F.expr("role = 'tool' and is_error")).select("session_id", F.concat(F.lit("r"), (F.col("k") % 3).cast("string")).alias("route"), "seq", F.when(F.col("k") % 2 == 0, F.col("price") * 100).alias("observed"))
    learned = state.observed_window(rows)
    return learned.withColumn("trigger", F.floor(strategies.learned_trigger(F.lit(100_000).cast("long"), F.lit(None).cast("long"), F.col("observed"))).cast("long"))


@query("growth_gate", f"""WITH {LOG}, m AS (SELECT session_id, sum(price)::BIGINT AS measured, (sum(price) FILTER (k % 2 = 0 AND session_id % 2 = 0) * 2)::BIGINT AS last_compacted FROM t GROUP BY session_id)
SELECT session_id, measured, last_compacted, measured < 50000 AS ignored FROM m WHERE last_compacted IS NULL OR measured > last_compacted""")
def growth_gate(spark, sf_dir):
    m = log(spark, sf_dir).groupBy("session_id").agg(F.sum("price").alias("measured"), (F.sum(F.when((F.col("k") % 2 == 0) & (F.col("session_id") % 2 == 0), F.col("price"))) * 2).alias("last_compacted"))
    return state.grown(m).withColumn("ignored", strategies.ignored_overflow(F.lit("request-too-large"), F.col("measured"), F.lit(100_000)))


@query("output_caps", f"WITH {_INPUTS} SELECT w AS \"window\", o AS output, greatest(1, least(o, 13107))::BIGINT AS reserve_cap, greatest(1, least(o, 8192))::BIGINT AS prefix_cap, greatest(1, least(20000, o, w - 40000 - 1024))::BIGINT AS room_cap, greatest(1, floor(least(o, w // 8) * 0.85::DOUBLE))::BIGINT AS eighth_cap, floor(w * 0.5::DOUBLE)::BIGINT AS shrunken FROM i")
def output_caps(spark, sf_dir):
    inputs = spark.sql("SELECT * FROM VALUES (131072L, 8192L), (200000L, 32000L), (50000L, 8000L), (50001L, 8000L), (1048576L, 0L) AS t(window, output)")
    cap = lambda rule: strategies.output_cap(rule, F.col("window"), F.col("output"), F.lit(16_384), F.lit(40_000)).alias(f"{rule}_cap")
    return inputs.select("window", "output", cap("reserve"), cap("prefix"), cap("room"), cap("eighth"), strategies.shrunken(F.col("window"), 1).alias("shrunken"))


@query("backoff_delays", "SELECT n AS attempt, least(60000, 2000 * 2 ** n)::BIGINT AS long_ms, least(60000, 200 * 2 ** n)::BIGINT AS short_ms, least(32000, 500 * 2 ** n)::BIGINT AS mid_ms FROM (SELECT unnest(range(0, 10))::BIGINT AS n)")
def backoff_delays(spark, sf_dir):
    n = F.col("attempt")
    return spark.range(10).withColumnRenamed("id", "attempt").select("attempt", state.backoff_ms(n, 2000, 60_000).alias("long_ms"), state.backoff_ms(n, 200, 60_000).alias("short_ms"), state.backoff_ms(n, 500, 32_000).alias("mid_ms"))


@query("trace_simulation", """WITH b(id, kind, base) AS (VALUES ('system','system',3600),('user-a','dialogue',7400),('tool-a','tool',18500),('dialogue','dialogue',8200),('tool-b','tool',23900),('tool-c','tool',16300),('recent','recent',18700)),
c(scenario, tw, dw) AS (VALUES ('coding',1.0::DOUBLE,1.0::DOUBLE),('tools',1.6::DOUBLE,1.0::DOUBLE),('requirements',0.65::DOUBLE,1.8::DOUBLE)), w AS (SELECT unnest([131072,262144,524288,1048576])::BIGINT AS w, 8192 AS o),
z AS (SELECT w, o, scenario, id, kind, floor(base * CASE kind WHEN 'tool' THEN tw WHEN 'dialogue' THEN dw ELSE 1.0::DOUBLE END * (w / 131072.0::DOUBLE) + 0.5)::BIGINT AS tokens FROM b, c, w),
s AS (SELECT w, o, scenario, sum(tokens)::BIGINT AS before, sum(tokens) FILTER (kind = 'tool') AS tools, max(tokens) FILTER (id = 'system') AS sys, max(tokens) FILTER (id = 'recent') AS recent, w / 131072 AS x FROM z GROUP BY w, o, scenario)
""" + " UNION ALL ".join(
    f"SELECT w AS \"window\", scenario, before, '{s}' AS strategy, (sys + floor({4300 if s == 'split_turn' else 3200} * x + 0.5){' + least(greatest(0, ' + k + '), recent)' if s in ('host_native', 'turn_tail', 'split_turn', 'calibrated') else ''}{f' + floor({r} * x + 0.5)' if (r := {'round_keep': 19600, 'user_tail': 10800, 'head_tail': 10800, 'idle_headroom': 12600, 'image_guard': 12600}.get(s)) else ''})::BIGINT AS after, {'floor(tools * 0.48::DOUBLE + 0.5)::BIGINT' if s in ('host_native', 'image_guard') else '0::BIGINT'} AS pruned FROM s"
    for s, (_, k) in _BUDGET_SQL.items()
))
def trace_simulation(spark, sf_dir):
    return strategies.trace_simulation(spark)


# --- structure


@query("spans", f"""WITH {LOG}, i AS (SELECT *, sum((role = 'system')::BIGINT) OVER (PARTITION BY session_id ORDER BY pos)::BIGINT AS island FROM t)
SELECT session_id, island, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS "rows", bool_or(source_kind <> 'compact-checkpoint') AS eligible FROM i WHERE role <> 'system' GROUP BY session_id, island""")
def spans(spark, sf_dir):
    return structure.spans(log(spark, sf_dir))


@query("first_span", f"""WITH {LOG}, i AS (SELECT *, sum((role = 'system')::BIGINT) OVER (PARTITION BY session_id ORDER BY pos)::BIGINT AS island FROM t),
g AS (SELECT session_id, island, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS "rows", bool_or(source_kind <> 'compact-checkpoint') AS eligible FROM i WHERE role <> 'system' GROUP BY session_id, island)
SELECT session_id, island, first_pos, last_pos, "rows" FROM g WHERE eligible QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY first_pos) = 1""")
def first_span(spark, sf_dir):
    return structure.first_eligible(structure.spans(log(spark, sf_dir)))


@query("balanced_cuts", f"WITH {LOG}, {CALLS} SELECT session_id, pos, open_before, open_after FROM c WHERE open_after = 0")
def balanced_cuts(spark, sf_dir):
    return structure.balanced(log(spark, sf_dir)).where("open_after = 0").select("session_id", "pos", "open_before", "open_after")


@query("call_intervals", f"WITH {LOG}, {CALLS} SELECT session_id, pos, id AS call_id, closed_at FROM iv")
def call_intervals(spark, sf_dir):
    return structure.call_intervals(log(spark, sf_dir)).select("session_id", "pos", "call_id", "closed_at")




@query("orphan_sessions", f"WITH {LOG}, ev AS (SELECT session_id, pos, coalesce(call_id, result_id) AS id, call_id IS NOT NULL AS call FROM t WHERE kind IN ('view', 'click', 'error')), l AS (SELECT *, lag(call) OVER (PARTITION BY session_id, id ORDER BY pos) AS prior FROM ev) SELECT DISTINCT session_id FROM l WHERE NOT call AND NOT coalesce(prior, false)")
def orphan_sessions(spark, sf_dir):
    return structure.orphan_sessions(log(spark, sf_dir))


_SAFE = f"""{EXPECTED}, {CALLS}, i AS (SELECT *, (sum((role = 'system')::BIGINT) OVER (PARTITION BY session_id ORDER BY pos))::BIGINT AS island FROM c),
se AS (SELECT session_id, island, min(idx) FILTER (open_before = 0) AS a, max(idx + 1) FILTER (open_after = 0) AS b FROM i WHERE role <> 'system' GROUP BY ALL),
z AS (SELECT i.* EXCLUDE (total, later, n) FROM i JOIN se ON i.session_id = se.session_id AND i.island = se.island WHERE role <> 'system' AND idx >= a AND idx < b),
ss AS (SELECT session_id, island, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS "rows" FROM z GROUP BY ALL HAVING count(*) > 1 AND bool_or(source_kind <> 'compact-checkpoint'))"""


@query("safe_spans", f'WITH {_SAFE} SELECT session_id, island, first_pos, last_pos, "rows" FROM ss')
def safe_spans(spark, sf_dir):
    """On logs from which unexpected results were removed."""
    return structure.safe_spans(expected_only(log(spark, sf_dir)))


def expected_only(entries: DataFrame) -> DataFrame:
    return entries.join(structure.unexpected_results(entries), ["session_id", "pos"], "left_anti")


@query("completed_spans", f"""WITH {LOG}, {CALLS}, i AS (SELECT *, sum((role = 'system')::BIGINT) OVER (PARTITION BY session_id ORDER BY pos)::BIGINT AS island FROM c),
a AS (SELECT session_id, island, min(pos) AS first_pos FROM i WHERE role NOT IN ('system', 'tool') AND open_before = 0 GROUP BY ALL),
z AS (SELECT i.session_id, i.island, first_pos, max(pos) AS last_pos FROM i JOIN a ON i.session_id = a.session_id AND i.island = a.island WHERE role <> 'system' AND pos >= first_pos AND open_after = 0 GROUP BY ALL),
f AS (SELECT z.*, count(*) AS "rows", bool_or(role IN ('assistant', 'tool')) AS works FROM z JOIN i ON i.session_id = z.session_id AND i.island = z.island AND role <> 'system' AND pos BETWEEN first_pos AND last_pos GROUP BY ALL)
SELECT session_id, first_pos, last_pos, "rows" FROM f WHERE works QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY island) = 1""")
def completed_spans(spark, sf_dir):
    return structure.completed_spans(log(spark, sf_dir))


_ROUND_SQL = {
    "assistant": "role = 'assistant'",
    "pending": "role = 'assistant' AND open_before = 0",
    "message": "role = 'assistant' AND open_before = 0 AND (lastid IS NULL OR lastid <> message_id)",
}
_ROUNDS = lambda mode: f"""l AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN message_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lastid FROM c),
r AS (SELECT *, sum(({_ROUND_SQL[mode]} AND idx > 0)::BIGINT) OVER (PARTITION BY session_id ORDER BY pos)::BIGINT AS round FROM l),
g0 AS (SELECT session_id, round, sum(price)::BIGINT AS tokens, count(*) AS "rows" FROM r GROUP BY ALL),
g AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS rounds, sum(tokens) OVER (PARTITION BY session_id ORDER BY round)::BIGINT AS upto, (sum(tokens) OVER (PARTITION BY session_id) - sum(tokens) OVER (PARTITION BY session_id ORDER BY round))::BIGINT AS later FROM g0)"""  # noqa: E731


def _rounds(mode: str) -> None:
    @query(f"rounds_{mode}", f"WITH {LOG}, {CALLS}, {_ROUNDS(mode)} SELECT session_id, pos, round FROM r")
    def run(spark, sf_dir):
        return structure.rounds(log(spark, sf_dir), mode).select("session_id", "pos", "round")


for _m in _ROUND_SQL:
    _rounds(_m)


@query("enough_rounds", f"WITH {LOG}, {CALLS}, {_ROUNDS('assistant')} SELECT session_id, count(DISTINCT round) AS rounds FROM r GROUP BY session_id HAVING count(DISTINCT round) >= 2 AND bool_or(role = 'assistant')")
def enough_rounds(spark, sf_dir):
    return structure.enough(structure.rounds(log(spark, sf_dir)))


@query("turn_ids", f"WITH {LOG} SELECT session_id, pos, sum((role = 'user' AND source_kind <> 'compact-checkpoint')::BIGINT) OVER (PARTITION BY session_id ORDER BY pos)::BIGINT AS turn_no FROM t")
def turn_ids(spark, sf_dir):
    return structure.turns(log(spark, sf_dir)).select("session_id", "pos", "turn_no")


@query("blocked_running_sum", f"WITH {LOG} SELECT session_id, pos, coalesce(sum(price) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM t")
def blocked_running_sum(spark, sf_dir):
    return structure.running_sum(log(spark, sf_dir), "price", "before", block=16).select("session_id", "pos", F.col("before").cast("long").alias("before"))


# --- selection


@query("suffix_cut", f"""WITH {CONV}, r AS (SELECT *, max(CASE WHEN later + price >= 500 THEN idx END) OVER (PARTITION BY session_id) AS reach FROM s),
c AS (SELECT session_id, max(total) AS total, coalesce(min(idx) FILTER (idx >= reach), min(idx), 0) AS cut FROM r GROUP BY session_id)
SELECT c.session_id, c.total, c.cut, count(s.idx) AS selected_rows, coalesce(sum(s.price), 0)::BIGINT AS selected_tokens FROM c LEFT JOIN s ON s.session_id = c.session_id AND s.idx < c.cut GROUP BY ALL""")
def suffix_cut(spark, sf_dir):
    return selection.suffix_cut(conv(spark, sf_dir), 500)


@query("suffix_cut_tools", f"""WITH {LOG}, {CALLS}, r AS (SELECT *, role <> 'tool' AND open_before = 0 AS valid, max(CASE WHEN later + price >= 8000 THEN idx END) OVER (PARTITION BY session_id) AS reach FROM c),
k AS (SELECT session_id, max(total) AS total, coalesce(min(idx) FILTER (valid AND idx >= reach), min(idx) FILTER (valid), 0) AS cut FROM r GROUP BY session_id),
z AS (SELECT k.session_id, k.total, k.cut, count(c.idx) AS n, coalesce(sum(c.price), 0) AS tok, coalesce(bool_and(c.source_kind = 'compact-checkpoint'), true) AS none FROM k LEFT JOIN c ON c.session_id = k.session_id AND c.idx < k.cut GROUP BY ALL)
SELECT session_id, total, CASE WHEN none THEN 0 ELSE cut END::BIGINT AS cut, CASE WHEN none THEN 0 ELSE n END::BIGINT AS selected_rows, CASE WHEN none THEN 0 ELSE tok END::BIGINT AS selected_tokens FROM z""")
def suffix_cut_tools(spark, sf_dir):
    return selection.suffix_cut(log(spark, sf_dir), 8_000)


# The same by blocks of places, small ones here, so that sessions are spread.
@query("blocked_balance", ORACLE_SQL["balanced_cuts"])
def blocked_balance(spark, sf_dir):
    return structure.balanced(log(spark, sf_dir), block=16).where("open_after = 0").select("session_id", "pos", "open_before", "open_after")


@query("blocked_intervals", ORACLE_SQL["call_intervals"])
def blocked_intervals(spark, sf_dir):
    return structure.call_intervals(log(spark, sf_dir), block=16).select("session_id", "pos", "call_id", "closed_at")


@query("blocked_rounds", ORACLE_SQL["rounds_message"])
def blocked_rounds(spark, sf_dir):
    return structure.rounds(log(spark, sf_dir), "message", block=16).select("session_id", "pos", "round")


@query("blocked_suffix_cut", ORACLE_SQL["suffix_cut_tools"])
def blocked_suffix_cut(spark, sf_dir):
    return selection.suffix_cut(log(spark, sf_dir), 8_000, block=16)


@query("split_turn", f"""WITH {CONV}, r AS (SELECT *, max(CASE WHEN later + price >= 300 THEN idx END) OVER (PARTITION BY session_id) AS reach FROM s),
c AS (SELECT session_id, coalesce(min(idx) FILTER (idx >= reach), min(idx), 0) AS cut FROM r GROUP BY session_id),
z AS (SELECT c.session_id, c.cut, bool_or(s.idx = c.cut AND role = 'assistant') AS mid, max(s.idx) FILTER (s.idx < c.cut AND role = 'user') AS start FROM c JOIN s ON s.session_id = c.session_id WHERE c.cut > 0 GROUP BY ALL)
SELECT session_id, cut, CASE WHEN mid AND start IS NOT NULL THEN start ELSE cut END::BIGINT AS history_rows, (cut - CASE WHEN mid AND start IS NOT NULL THEN start ELSE cut END)::BIGINT AS prefix_rows FROM z""")
def split_turn(spark, sf_dir):
    rows = conv(spark, sf_dir)
    return selection.split_turn(rows, selection.suffix_cut(rows, 300))


@query("typed_cut", f"""WITH {CONV}, r AS (SELECT *, coalesce(max(CASE WHEN later + price >= 400 THEN idx END) OVER (PARTITION BY session_id), 0) AS aim0, max(CASE WHEN role = 'user' THEN idx END) OVER (PARTITION BY session_id) AS u FROM s)
SELECT session_id, max(CASE WHEN u > 0 THEN least(aim0, u) ELSE aim0 END)::BIGINT AS cut FROM r GROUP BY session_id""")
def typed_cut(spark, sf_dir):
    return selection.typed_cut(conv(spark, sf_dir), 400)


@query("keep_groups", f"WITH {LOG}, {CALLS}, {_ROUNDS('message')} SELECT session_id, count(*) AS rounds, count(*) FILTER (later < 6000) AS kept_rounds, coalesce(sum(tokens) FILTER (later < 6000), 0)::BIGINT AS kept_tokens, coalesce(sum(\"rows\") FILTER (later >= 6000), 0)::BIGINT AS selected_rows FROM g GROUP BY session_id")
def keep_groups(spark, sf_dir):
    return selection.keep_groups(log(spark, sf_dir), 6_000)


@query("keep_rounds", f"WITH {LOG}, {CALLS}, {_ROUNDS('assistant')} SELECT session_id, (max(least(1, rounds - 1)) + count(*) FILTER (rounds - round > least(1, rounds - 1) AND later < 3000 AND round >= 1))::BIGINT AS keep, max(rounds) AS rounds FROM g GROUP BY session_id")
def keep_rounds(spark, sf_dir):
    return selection.keep_rounds(log(spark, sf_dir), 1, 3_000)


@query("drop_for_gap", f"WITH {LOG}, {CALLS}, {_ROUNDS('message')} SELECT session_id, max(rounds) AS rounds, least(greatest(count(*) FILTER (upto - tokens < 5000), 1), max(rounds) - 1)::BIGINT AS dropped FROM g GROUP BY session_id")
def drop_for_gap(spark, sf_dir):
    return selection.drop_for_gap(log(spark, sf_dir), 5_000)


@query("drop_fifth", f"WITH {LOG}, {CALLS}, {_ROUNDS('message')} SELECT session_id, max(rounds) AS rounds, least(greatest(floor(max(rounds) * 0.2), 1), max(rounds) - 1)::BIGINT AS dropped FROM g GROUP BY session_id")
def drop_fifth(spark, sf_dir):
    return selection.drop_for_gap(log(spark, sf_dir), None)


@query("keep_more_for_gap", f"""WITH {LOG}, {CALLS}, {_ROUNDS('assistant')}, h AS (SELECT session_id, round, rounds, coalesce(sum(tokens) OVER (PARTITION BY session_id ORDER BY round DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM g WHERE round < rounds - 1),
k AS (SELECT session_id, max(rounds) AS rounds, count(*) FILTER (after < 4000 AND round >= 1) AS more FROM h GROUP BY session_id)
SELECT session_id, rounds, greatest(0, least(rounds - 2, 1 + CASE WHEN more >= rounds - 2 THEN greatest(1, (rounds - 1) // 2) ELSE more END))::BIGINT AS keep FROM k""")
def keep_more_for_gap(spark, sf_dir):
    return selection.keep_more_for_gap(log(spark, sf_dir), 1, 4_000)


@query("recent_within", f"""WITH {LOG}, {CALLS}, f AS (SELECT *, greatest(coalesce(min(CASE WHEN later + price <= 9000 THEN idx END) OVER (PARTITION BY session_id), n), 1) AS lo FROM c)
SELECT session_id, max(n) AS "rows", coalesce(min(idx) FILTER (idx >= lo AND role <> 'tool'), max(n))::BIGINT AS start FROM f GROUP BY session_id""")
def recent_within(spark, sf_dir):
    return selection.recent_within(log(spark, sf_dir), 9_000)


@query("retain_users", f"WITH {CONV}, u AS (SELECT session_id, pos, price, coalesce(sum(price) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM p WHERE role = 'user') SELECT session_id, pos, price AS tokens, least(price, 120 - later)::BIGINT AS kept_tokens FROM u WHERE later < 120")
def retain_users(spark, sf_dir):
    return selection.retain_users(conv(spark, sf_dir), 120)


_LATEST = "lr AS (SELECT session_id, message_id, min(pos) AS pos, max_by(price, pos) AS price FROM t WHERE role = 'user' AND source_kind = 'user' GROUP BY ALL)"


@query("latest_representation", f"WITH {LOG}, {_LATEST} SELECT session_id, message_id, pos, price FROM lr")
def latest_representation(spark, sf_dir):
    return selection.latest_representation(log(spark, sf_dir)).select("session_id", "message_id", "pos", "price")


@query("head_tail_users", f"""WITH {LOG}, {_LATEST}, w AS (SELECT *, sum(price) OVER (PARTITION BY session_id) AS total, coalesce(sum(price) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM lr),
x AS (SELECT *, CASE WHEN total <= 5000 THEN 'all' WHEN later < 4200 AND later + price <= 4200 THEN 'tail' WHEN later < 4200 THEN 'split' END AS q FROM w),
y AS (SELECT *, coalesce(sum(CASE WHEN q IS NULL THEN price END) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, coalesce(sum(CASE WHEN q IS NULL THEN price END) OVER (PARTITION BY session_id), 0) AS heads FROM x),
z AS (SELECT *, coalesce(q, CASE WHEN before + price <= 800 THEN 'head' WHEN before < 800 THEN 'clip' ELSE 'gone' END) AS part FROM y)
SELECT session_id, pos, part, CASE WHEN part IN ('all', 'tail', 'head') THEN price WHEN part = 'split' THEN 4200 - later + greatest(800 - heads, 0) WHEN part = 'clip' THEN 800 - before ELSE 0 END::BIGINT AS kept_tokens FROM z""")
def head_tail_users(spark, sf_dir):
    return selection.head_tail_users(log(spark, sf_dir), 5_000, 800)


@query("branch_selection", f"""WITH {LOG}, u AS (SELECT *, coalesce(sum(price) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM t WHERE role <> 'system'),
v AS (SELECT *, max(CASE WHEN later + price > 7000 THEN pos END) OVER (PARTITION BY session_id) AS edge FROM u)
SELECT session_id, pos, price AS tokens FROM v WHERE edge IS NULL OR pos > edge OR (pos = edge AND source_kind = 'compact-checkpoint' AND later < 6300)""")
def branch_selection(spark, sf_dir):
    return selection.branch(log(spark, sf_dir), 7_000)


def _tail_sql(budget: int) -> str:
    """``tl``: session_id, kept. Over ``v``: session_id, idx, n, role, cp, open_before, len."""
    return f"""u0 AS (SELECT *, sum((role = 'user' AND NOT cp)::BIGINT) OVER (PARTITION BY session_id ORDER BY idx) AS turn FROM v),
u1 AS (SELECT *, (sum(len) OVER w + count(*) OVER w - 1 + 4) // 4 AS rest, row_number() OVER (PARTITION BY session_id, turn ORDER BY idx) AS nth FROM u0 WINDOW w AS (PARTITION BY session_id, turn ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
u2 AS (SELECT session_id, turn, idx AS start, rest AS size, open_before = 0 AS cut, sum(rest) OVER (PARTITION BY session_id ORDER BY turn DESC) AS upto FROM u1 WHERE nth = 1 AND turn > 0),
u3 AS (SELECT session_id, max(turn) AS turn FROM u2 WHERE NOT cut OR upto > {budget} GROUP BY session_id),
u4 AS (SELECT u2.session_id, min(start) AS kept FROM u2 LEFT JOIN u3 ON u2.session_id = u3.session_id WHERE u3.turn IS NULL OR u2.turn > u3.turn GROUP BY ALL),
u5 AS (SELECT u1.session_id, min(idx) AS part FROM u1 JOIN u3 ON u1.session_id = u3.session_id AND u1.turn = u3.turn JOIN u2 ON u2.session_id = u1.session_id AND u2.turn = u1.turn
       WHERE nth > 1 AND open_before = 0 AND role <> 'tool' AND rest <= {budget} - (upto - size) GROUP BY ALL),
tl AS (SELECT s.session_id, n, coalesce(nullif(coalesce(part, kept), 0), n) AS kept FROM (SELECT session_id, max(n) AS n FROM v GROUP BY session_id) s LEFT JOIN u4 ON s.session_id = u4.session_id LEFT JOIN u5 ON s.session_id = u5.session_id)"""


_ROW_JSON = """length(CASE WHEN call_id IS NULL THEN '{"role":"' || role || '","blocks":[{"type":"text","text":"' || kind || ' ' || k || '"}]}'
 ELSE '{"role":"assistant","blocks":[{"type":"tool-call","id":"' || call_id || '","name":"' || tool || '","arguments":"{\\"path\\": \\"' || path || '\\"}"}]}' END)"""


@query("turn_tail", f"WITH {LOG}, {CALLS}, v AS (SELECT session_id, idx, n, role, source_kind = 'compact-checkpoint' AS cp, open_before, {_ROW_JSON} AS len FROM c), {_tail_sql(400)} SELECT session_id, n AS \"rows\", kept FROM tl")
def turn_tail(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("json_len", text.u16len(F.to_json(F.struct("role", "blocks"))))
    return selection.turn_tail(rows, 400)


@query("appended_within_budget", """WITH RECURSIVE e AS (SELECT conv_id AS session_id, turn AS ord, '[' || role || ']' || chr(10) AS header, coalesce(text, '') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations),
f AS (SELECT session_id, 0::BIGINT AS nth, 400::BIGINT AS room, NULL::BIGINT AS ord, NULL::VARCHAR AS text, 0::BIGINT AS used FROM e GROUP BY session_id
 UNION ALL SELECT session_id, nth, left_ - CASE WHEN fits THEN cost ELSE 0 END, CASE WHEN fits THEN ord END, body, cost FROM (
  SELECT *, space > 0 AND length(own) > 0 AS fits, header || left(own, space) AS body, ((length(header || left(own, space)) + 3) // 4)::BIGINT AS cost
  FROM (SELECT e.session_id, e.nth, e.ord, f.room AS left_, header, e.body AS own, greatest(0, least(f.room, 100) * 4 - length(header)) AS space FROM f JOIN e ON e.session_id = f.session_id AND e.nth = f.nth + 1)))
SELECT session_id, ord, text, used FROM f WHERE ord IS NOT NULL""")
def appended_within_budget(spark, sf_dir):
    """A fold whose budget depends on earlier clips."""
    rows = conv(spark, sf_dir).select("session_id", F.col("pos").alias("ord"), "role", logs.text_of().alias("body"), F.lit(100).cast("long").alias("cap"))
    return selection.append_within(rows.withColumnRenamed("role", "label"), 400)


_NOTE = "'[Earlier assistant/tool activity omitted to fit the summary request]'"
_TOKENS = lambda chars: f"greatest(1, ({chars} + 2 * (n - 1) + 2) // 3)"


@query("fitted_rows", f"""WITH {CONV}, g0 AS (SELECT session_id, pos, idx, n, role, text, CASE WHEN length(text) > 256 THEN left(text, 256) || chr(10) || '[' || (length(text) - 256) || ' characters omitted]' ELSE text END AS short,
 sum((role = 'assistant' AND idx > 0)::BIGINT) OVER (PARTITION BY session_id ORDER BY pos) AS grp, sum(length(text)) OVER (PARTITION BY session_id) AS chars FROM p),
g1 AS (SELECT session_id, pos, n, role, grp, CASE WHEN {_TOKENS('chars')} <= 600 THEN text ELSE short END AS text, idx, row_number() OVER (PARTITION BY session_id, grp ORDER BY pos) = 1 AS head FROM g0),
g2 AS (SELECT session_id, grp, max(n) AS n, NOT bool_or(role = 'user') AND grp > 0 AS goes, sum(length(text)) AS chars FROM g1 GROUP BY session_id, grp),
g3 AS (SELECT *, sum(chars) OVER (PARTITION BY session_id) - coalesce(sum(CASE WHEN goes THEN chars - length({_NOTE}) ELSE 0 END) OVER (PARTITION BY session_id ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM g2),
g4 AS (SELECT session_id, min(grp) AS stop FROM g3 WHERE {_TOKENS('left_')} <= 600 GROUP BY session_id),
g5 AS (SELECT g1.*, goes AND (stop IS NULL OR g1.grp < stop) AS gone FROM g1 JOIN g2 ON g1.session_id = g2.session_id AND g1.grp = g2.grp LEFT JOIN g4 ON g4.session_id = g1.session_id),
g6 AS (SELECT *, CASE WHEN gone AND head THEN length({_NOTE}) WHEN gone THEN 0 ELSE length(text) END AS chars FROM g5)
SELECT session_id, pos AS idx, chars, {_TOKENS('sum(chars) OVER (PARTITION BY session_id)')} <= 600 AS fits FROM g6""")
def fitted_rows(spark, sf_dir):
    rows = structure.rounds(conv(spark, sf_dir)).select("session_id", F.col("pos").alias("idx"), F.col("round").alias("grp"), (F.col("role") == "user").alias("user"), logs.text_of().alias("text"))
    rows = rows.withColumn("short", text.clip(F.col("text"), 256, "\n[{} characters omitted]"))
    return selection.fit_rows(rows, 600).select("session_id", "idx", F.length("text").cast("long").alias("chars"), "fits")


@query("last_occurrence", f"WITH {LOG} SELECT session_id, max(pos) FILTER (role = 'user' AND source_kind = 'user') AS last_user, max(pos) FILTER (role = 'assistant') AS last_answer FROM t GROUP BY session_id")
def last_occurrence(spark, sf_dir):
    return log(spark, sf_dir).groupBy("session_id").agg(F.max(F.when(structure.typed_user(), F.col("pos"))).alias("last_user"), F.max(F.when(F.col("role") == "assistant", F.col("pos"))).alias("last_answer"))


# --- pruning

_TOOL_ROWS = "tr AS (SELECT * FROM t WHERE role = 'tool' AND NOT is_error AND k % 4 < 3 AND EXISTS (SELECT 1 FROM t c WHERE c.session_id = t.session_id AND c.call_id = t.result_id))"


def _tools(rows: DataFrame) -> DataFrame:
    named = lookups.identify_results(rows).select("session_id", "pos", "name")
    rows = rows.join(named, ["session_id", "pos"])
    return pruning.eligible_tools(rows, ("readfile", "writefile", "bash"), text.normal_name(F.col("name"), only_letters=True), F.lit(False))


@query("clear_old_tools", f"WITH {LOG}, {_TOOL_ROWS} SELECT session_id, pos, price FROM tr QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) > 5")
def clear_old_tools(spark, sf_dir):
    return pruning.clear_old(_tools(log(spark, sf_dir)), 5).select("session_id", "pos", "price")


@query("last_answers", f"WITH {LOG} SELECT session_id, pos FROM t WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) <= 3")
def last_answers(spark, sf_dir):
    return pruning.last_n(log(spark, sf_dir).where("role = 'assistant'"), 3).select("session_id", "pos")


@query("low_water_clear", f"""WITH {LOG}, {_TOOL_ROWS}, w AS (SELECT *, sum(chars) OVER (PARTITION BY session_id) AS total, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) AS nth FROM tr),
x AS (SELECT *, total - coalesce(sum(chars) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains FROM w WHERE total > 40000 AND nth > 2)
SELECT session_id, pos, chars FROM x WHERE remains > 20000""")
def low_water_clear(spark, sf_dir):
    return pruning.low_water(_tools(log(spark, sf_dir)), "chars", 40_000, 20_000, 2).select("session_id", "pos", "chars")


@query("backward_prune", f"""WITH {LOG}, w AS (SELECT *, sum((role = 'user')::BIGINT) OVER (PARTITION BY session_id ORDER BY pos DESC) AS turns FROM t),
x AS (SELECT *, turns >= 2 AND role = 'tool' AND NOT is_error AS seen, max(CASE WHEN source_kind = 'compact-checkpoint' OR (turns >= 2 AND role = 'tool' AND NOT is_error AND k = 77) THEN pos END) OVER (PARTITION BY session_id) AS stop FROM w),
y AS (SELECT *, sum(price) OVER (PARTITION BY session_id ORDER BY pos DESC) AS kept FROM x WHERE seen AND (stop IS NULL OR pos > stop)),
z AS (SELECT *, sum(price) OVER (PARTITION BY session_id) AS saved FROM y WHERE kept > 2000)
SELECT session_id, pos, price FROM z WHERE saved > 3000""")
def backward_prune(spark, sf_dir):
    return pruning.backward(log(spark, sf_dir), "price", F.col("k") == 77, 2_000, 3_000).select("session_id", "pos", "price")


@query("grouped_prune", f"""WITH {LOG}, w AS (SELECT *, sum((call_id IS NOT NULL)::BIGINT) OVER (PARTITION BY session_id ORDER BY pos) AS batch FROM t),
x AS (SELECT *, CASE WHEN batch = 0 THEN pos - 1099511627776 ELSE batch END AS grp FROM w WHERE role = 'tool' AND NOT is_error)
SELECT session_id, pos, price FROM x QUALIFY dense_rank() OVER (PARTITION BY session_id ORDER BY grp DESC) > 5""")
def grouped_prune(spark, sf_dir):
    return pruning.grouped(log(spark, sf_dir), (F.col("role") == "tool") & ~F.col("is_error"), 5).select("session_id", "pos", "price")


@query("prune_savings", f"""WITH {LOG}, {_TOOL_ROWS}, c AS (SELECT session_id, pos, greatest(price - 13, 0) AS saved FROM tr QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) > 5),
a AS (SELECT session_id, max(pos) AS anchor_pos FROM t WHERE has_usage GROUP BY session_id)
SELECT c.session_id, sum(saved)::BIGINT AS saved, coalesce(sum(saved) FILTER (pos <= anchor_pos), 0)::BIGINT AS anchored FROM c LEFT JOIN a ON a.session_id = c.session_id GROUP BY c.session_id""")
def prune_savings(spark, sf_dir):
    rows = log(spark, sf_dir)
    anchor = rows.where("usage is not null and role = 'assistant'").groupBy("session_id").agg(F.max("pos").alias("anchor_pos"))
    return pruning.savings(pruning.clear_old(_tools(rows), 5), "price", 13, anchor)


@query("image_pressure", f"WITH {LOG} SELECT session_id, count(*) FILTER (k % 3 = 0) AS images FROM t WHERE role = 'tool' GROUP BY session_id HAVING count(*) FILTER (k % 3 = 0) >= 8")
def image_pressure(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("blocks", F.when(F.col("k") % 3 == 0, F.concat("blocks", F.array(logs.block("image", media_type=F.lit("image/png"))))).otherwise(F.col("blocks")))
    return pruning.image_pressure(rows, 8)


# --- lookups


@query("tool_identity", f"WITH {LOG}, k AS (SELECT session_id, call_id, max_by(tool, pos) AS name, max_by(path, pos) AS path FROM t WHERE call_id IS NOT NULL GROUP BY ALL) SELECT t.session_id, t.pos, result_id AS call_id, t.is_error, name, k.path AS path FROM t LEFT JOIN k ON k.session_id = t.session_id AND k.call_id = result_id WHERE result_id IS NOT NULL")
def tool_identity(spark, sf_dir):
    rows = lookups.identify_results(log(spark, sf_dir))
    return rows.select("session_id", "pos", "call_id", "is_error", "name", text.path_from_json(F.col("arguments")).alias("path"))


@query("archive_scan", f"WITH {LOG}, k AS (SELECT session_id, call_id, max_by(tool, pos) AS name FROM t WHERE call_id IS NOT NULL GROUP BY ALL) SELECT t.session_id, t.pos, t.seq, name AS tool_name FROM t LEFT JOIN k ON k.session_id = t.session_id AND k.call_id = t.result_id")
def archive_scan(spark, sf_dir):
    return logs.snapshot(log(spark, sf_dir)).select("session_id", "pos", "seq", "tool_name")


@query("recovered_sessions", f"WITH {LOG}, s AS (SELECT DISTINCT session_id FROM t), o AS (SELECT session_id, count(*) AS faults, max(pos) AS last_fault FROM t WHERE kind = 'error' AND k >= 50 GROUP BY session_id) SELECT s.session_id, faults, last_fault FROM s LEFT JOIN o ON s.session_id = o.session_id")
def recovered_sessions(spark, sf_dir):
    rows = log(spark, sf_dir)
    seen = rows.where("is_error and k >= 50").groupBy("session_id").agg(F.count("*").alias("faults"), F.max("pos").alias("last_fault"))
    return logs.with_recovery(rows.select("session_id").distinct(), seen)


@query("joined_texts", f"""WITH {LOG} SELECT session_id, pos, CASE WHEN call_id IS NULL THEN kind || ' ' || k || chr(10) || chr(10) ELSE '' END || 'why ' || k AS thoughts, CASE WHEN call_id IS NULL THEN kind || ' ' || k ELSE '' END AS plain, CASE WHEN call_id IS NULL THEN kind || ' ' || k ELSE '' END || '|' AS slots FROM t""")
def joined_texts(spark, sf_dir):
    """Texts with reasoning joined by a blank line, without it, and with an empty slot for each other block."""
    rows = log(spark, sf_dir).withColumn("blocks", F.concat("blocks", F.array(logs.block("reasoning", F.concat(F.lit("why "), F.col("k").cast("string"))))))
    return rows.select("session_id", "pos", logs.text_of("\n\n", ("text", "reasoning")).alias("thoughts"), logs.text_of("").alias("plain"), logs.text_of("|", keep_slots=True).alias("slots"))


@query("context_prefixes", f"WITH {LOG} SELECT session_id, pos, role = 'system' OR (role = 'user' AND source_kind <> 'user' AND k % 2 = 1) AS guarded FROM t")
def context_prefixes(spark, sf_dir):
    """Protected rows and reminders among the user's messages (here: odd rows begin as one, only untyped ones count)."""
    said = F.when(F.col("k") % 2 == 1, F.concat(F.lit("  <system-reminder>"), logs.text_of())).otherwise(logs.text_of())
    return log(spark, sf_dir).select("session_id", "pos", structure.context_prefix(said).alias("guarded"))


@query("injected_context", f"""WITH {LOG}, u AS (SELECT *, CASE k % 5 WHEN 0 THEN 'skill' WHEN 1 THEN 'plan' WHEN 2 THEN 'agent-instructions' ELSE source_kind END AS sk FROM t WHERE role = 'user')
SELECT session_id, pos, sk IN ('skill', 'plan', 'agent-instructions') OR coalesce(source_form, '') IN ('instructions', 'snapshot') AS context, CASE WHEN sk = 'plan' OR source_form = 'snapshot' THEN '{{"source_kind":"' || sk || '"' || CASE WHEN source_form IS NULL THEN '' ELSE ',"source_form":"' || source_form || '"' END || '}}' END AS shared FROM u""")
def injected_context(spark, sf_dir):
    """Rows that are context by form or kind, and the state that versions of one context share."""
    kind = F.when(F.col("k") % 5 == 0, "skill").when(F.col("k") % 5 == 1, "plan").when(F.col("k") % 5 == 2, "agent-instructions").otherwise(F.col("source_kind"))
    rows = lookups.with_state(log(spark, sf_dir).where("role = 'user'").withColumn("source_kind", kind), forms=("snapshot",), kinds="plan")
    return rows.select("session_id", "pos", F.col("state_key").isNotNull().alias("context"), F.when(F.col("state_key") != F.col("source"), F.col("state_key")).alias("shared"))


@query("explicit_regions", f"WITH {LOG} SELECT session_id, count(*) AS \"rows\", sum(price)::BIGINT AS tokens FROM t WHERE pos BETWEEN 5 AND 24 GROUP BY session_id")
def explicit_regions(spark, sf_dir):
    """The range that a caller names (its feature)."""
    return compaction.select_region(log(spark, sf_dir), 5, 24).groupBy("session_id").agg(F.count("*").alias("rows"), F.sum("price").alias("tokens"))


@query("snapshot_identity", f"WITH {LOG}, k AS (SELECT session_id, call_id, max_by(tool, pos) AS name FROM t WHERE call_id IS NOT NULL GROUP BY ALL) SELECT t.session_id, t.pos + 1000 AS pos, t.seq, name AS tool_name FROM t LEFT JOIN k ON k.session_id = t.session_id AND k.call_id = result_id WHERE t.k % 5 < 4")
def snapshot_identity(spark, sf_dir):
    rows = log(spark, sf_dir)
    surface = rows.where("k % 5 < 4").select("session_id", (F.col("pos") + 1000).alias("pos"), "seq")
    return logs.snapshot(rows, surface).select("session_id", "pos", "seq", "tool_name")


_REPLAY = lambda now: f"""{LOG}, w AS (SELECT *, lag(source_kind = 'compact-checkpoint') OVER (PARTITION BY session_id ORDER BY pos) AS after_point,
  max(CASE WHEN source_kind = 'compact-checkpoint' THEN pos END) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS point FROM t WHERE {now}),
o AS (SELECT session_id, pos AS seq, CASE WHEN source_kind = 'compact-checkpoint' THEN coalesce(point, 0) ELSE pos - 1 END AS a, pos - 1 AS b FROM w
      WHERE source_kind = 'compact-checkpoint' AND pos > 0 OR is_error AND k % 10 = 3 AND pos > 1 AND NOT after_point),
ca AS (SELECT session_id, seq, a FROM o UNION ALL SELECT ca.session_id, ca.seq, o.a FROM ca JOIN o ON o.session_id = ca.session_id AND o.seq = ca.a),
cb AS (SELECT session_id, seq, b FROM o UNION ALL SELECT cb.session_id, cb.seq, o.b FROM cb JOIN o ON o.session_id = cb.session_id AND o.seq = cb.b),
iv AS (SELECT session_id, seq, min(a) AS low, any_value(high) AS high FROM ca JOIN (SELECT session_id, seq, min(b) AS high FROM cb GROUP BY ALL) USING (session_id, seq) GROUP BY session_id, seq),
lf AS (SELECT w.session_id, w.pos AS place FROM w ANTI JOIN o ON o.session_id = w.session_id AND o.seq = w.pos),
tp AS (SELECT lf.session_id, place, coalesce(max(iv.seq), place) AS seq FROM lf LEFT JOIN iv ON iv.session_id = lf.session_id AND place BETWEEN low AND high GROUP BY lf.session_id, place),
sf AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY min(place)) - 1 AS pos, seq FROM tp GROUP BY session_id, seq)"""  # noqa: E731
_MIDDLE = "time_ms <= (SELECT (min(time_ms) + max(time_ms)) // 2 FROM t)"


def _replayed(spark, sf_dir, middle: bool) -> tuple[DataFrame, DataFrame]:
    """The log and its surface, at the end or in the middle of the log's time."""
    rows, now = log(spark, sf_dir), None
    if middle:
        now = F.col("time_ms") <= rows.agg(F.floor((F.min("time_ms") + F.max("time_ms")) / 2)).first()[0]
    messages = rows.select("session_id", F.col("pos").alias("seq"), "time_ms")
    return rows, surface.replay(messages, logs.operations_from_events(rows), now, block=16)[0]


@query("replayed_surface", f"WITH RECURSIVE {_REPLAY('true')} SELECT session_id, pos, seq FROM sf")
def replayed_surface(spark, sf_dir):
    return _replayed(spark, sf_dir, False)[1]


@query("surface_as_of", f"WITH RECURSIVE {_REPLAY(_MIDDLE)} SELECT session_id, pos, seq FROM sf")
def surface_as_of(spark, sf_dir):
    return _replayed(spark, sf_dir, True)[1]


@query("measured_surface", f"""WITH RECURSIVE {_REPLAY(_MIDDLE)}, m AS (SELECT session_id, pos - 1 AS seq, pos AS stamp, chars // 3 AS tokens FROM w WHERE kind = 'purchase' UNION ALL SELECT session_id, pos - 2, pos, chars // 5 FROM w WHERE kind = 'click'),
mm AS (SELECT session_id, seq, max_by(tokens, stamp) AS tokens FROM m GROUP BY ALL)
SELECT sf.session_id, sf.pos, sf.seq, coalesce(mm.tokens, w.price)::BIGINT AS tokens, w.finish, CASE WHEN w.has_usage THEN w.u_total END AS usage_total
FROM sf JOIN w ON w.session_id = sf.session_id AND w.pos = sf.seq LEFT JOIN mm ON mm.session_id = sf.session_id AND mm.seq = sf.seq""")
def measured_surface(spark, sf_dir):
    """Measurements: an answer measures the row before it, a result the one two before it; the latest by that time counts."""
    rows, visible = _replayed(spark, sf_dir, True)
    numbered = rows.withColumns({"seq": F.col("pos"), "at": F.col("pos")})
    measured = lambda kind, back, part: numbered.where(kind).select("session_id", (F.col("pos") - back).alias("seq"), F.col("pos").alias("measured_at"), F.floor(F.col("chars") / part).cast("long").alias("tokens"), "time_ms")
    middle = rows.agg(F.floor((F.min("time_ms") + F.max("time_ms")) / 2)).first()[0]
    prices = measured(F.col("usage").isNotNull(), 1, 3).unionByName(measured((F.col("role") == "tool") & ~F.col("is_error"), 2, 5))
    answers = numbered.where("usage is not null").select("session_id", "seq", F.col("pos").alias("answered_at"), "finish", "usage", "time_ms")
    out = surface.attach(logs.snapshot(numbered, visible), prices, answers, F.col("price"), F.col("time_ms") <= middle)
    return out.select("session_id", "pos", "seq", "tokens", "finish", F.col("usage.total").alias("usage_total"))


@query("latest_records", f"WITH {LOG} SELECT session_id, max(seq) AS seq, max_by('{{\"count\":' || k || '}}', seq) AS data FROM t WHERE kind = 'error' GROUP BY session_id")
def latest_records(spark, sf_dir):
    rows = log(spark, sf_dir).where("role = 'tool' and is_error").select("session_id", "seq", F.col("k").alias("count"), F.lit(None).cast("string").alias("left_out"))
    return logs.latest(logs.record(rows, "engine", "failures", ["count", "left_out"]), "engine", "failures")


@query("failed_calls", f"WITH {LOG}, r AS (SELECT session_id, result_id, min_by(is_error, pos) AS failed FROM t WHERE result_id IS NOT NULL GROUP BY ALL) SELECT t.session_id, t.pos, t.call_id, coalesce(failed, false) AS failed FROM t LEFT JOIN r ON r.session_id = t.session_id AND r.result_id = t.call_id WHERE t.call_id IS NOT NULL")
def failed_calls(spark, sf_dir):
    return lookups.failed_calls(log(spark, sf_dir)).select("session_id", "pos", "call_id", "failed")


@query("completed_batches", f"""WITH {LOG}, cp AS (SELECT session_id, max(seq) AS cp FROM t WHERE source_kind = 'compact-checkpoint' GROUP BY session_id),
f AS (SELECT t.* FROM t LEFT JOIN cp USING (session_id) WHERE role = 'assistant' AND seq > coalesce(cp, -1) QUALIFY row_number() OVER (PARTITION BY session_id, message_id ORDER BY pos) = 1),
r AS (SELECT session_id, result_id, max(seq) AS rs FROM t WHERE result_id IS NOT NULL GROUP BY ALL)
SELECT f.session_id, count(*) FILTER (coalesce(rs > f.seq, false)) AS batches FROM f LEFT JOIN r ON r.session_id = f.session_id AND r.result_id = f.call_id WHERE f.call_id IS NOT NULL GROUP BY f.session_id""")
def completed_batches(spark, sf_dir):
    """Since each session's last checkpoint."""
    rows = log(spark, sf_dir)
    return lookups.completed_batches(rows, rows.where("source_kind = 'compact-checkpoint'").groupBy("session_id").agg(F.max("seq").alias("seq")))


@query("succeeded_calls", f"WITH {LOG} SELECT session_id, pos, call_id FROM t WHERE call_id IS NOT NULL AND EXISTS (SELECT 1 FROM t r WHERE r.session_id = t.session_id AND r.result_id = t.call_id AND NOT r.is_error)")
def succeeded_calls(spark, sf_dir):
    return lookups.succeeded_calls(log(spark, sf_dir)).select("session_id", "pos", "call_id")


@query("outside_selection", f"WITH {LOG} SELECT session_id, pos, seq FROM t WHERE k % 10 >= 6")
def outside_selection(spark, sf_dir):
    rows = log(spark, sf_dir)
    return lookups.outside(rows, rows.where("k % 10 < 6")).select("session_id", "pos", "seq")


@query("newer_state_wins", f"""WITH {LOG}, x AS (SELECT session_id, 'k' || (k % 6) AS key, seq, k FROM t WHERE role = 'user'), v AS (SELECT session_id, key, max(seq) AS vs FROM x WHERE k % 2 = 1 GROUP BY ALL), h AS (SELECT session_id, key, max(seq) AS seq FROM x WHERE k % 2 = 0 GROUP BY ALL)
SELECT h.session_id, h.key, h.seq FROM h LEFT JOIN v ON v.session_id = h.session_id AND v.key = h.key WHERE vs IS NULL OR vs < h.seq""")
def newer_state_wins(spark, sf_dir):
    rows = log(spark, sf_dir).where("role = 'user'").select("session_id", F.concat(F.lit("k"), (F.col("k") % 6).cast("string")).alias("key"), "seq", "k")
    kept = lineage.latest_by_key(rows.where("k % 2 = 0"), ["session_id", "key"], "seq", ["seq"])
    return lookups.not_superseded(kept, rows.where("k % 2 = 1"))


@query("checkpoint_records", f"""WITH {LOG}, c AS (SELECT session_id, seq, 'f' || (k % 3) AS fingerprint FROM t WHERE role = 'user'), s AS (SELECT session_id, 'f' || (k % 3) AS fingerprint, seq AS prepared_after, seq AS ord, 'd' || k AS data FROM t WHERE has_usage)
SELECT c.session_id, c.seq, c.fingerprint, max_by(data, ord) AS data FROM c JOIN s ON s.session_id = c.session_id AND s.fingerprint = c.fingerprint AND prepared_after < c.seq GROUP BY ALL""")
def checkpoint_records(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("fingerprint", F.concat(F.lit("f"), (F.col("k") % 3).cast("string")))
    saved = rows.where("usage is not null").select("session_id", "fingerprint", F.col("seq").alias("prepared_after"), F.col("seq").alias("ord"), F.concat(F.lit("d"), F.col("k").cast("string")).alias("data"))
    return lookups.checkpoint_records(rows.where("role = 'user'").select("session_id", "seq", "fingerprint"), saved)


@query("file_lookup", "WITH w AS (SELECT user_id AS session_id, 'src/f' || regexp_extract(props, '[0-9]+') || '.py' AS path, count(*) AS reads FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT session_id, w.path, reads, left(text, 40) AS content FROM w LEFT JOIN (SELECT 'src/f' || doc_id || '.py' AS path, text FROM documents) d ON d.path = w.path")
def file_lookup(spark, sf_dir):
    wanted = log(spark, sf_dir).where(F.expr("role = 'assistant' and usage is null")).groupBy("session_id", F.concat(F.lit("src/f"), F.col("k").cast("string"), F.lit(".py")).alias("path")).agg(F.count("*").alias("reads"))
    return logs.read_files(wanted, logs.files_from_documents(logs.table(spark, sf_dir, "documents")), 40)[0].select("session_id", "path", "reads", "content")


@query("original_users", f"""WITH {LOG}, u AS (SELECT session_id, message_id, min(seq) AS first_seq FROM t WHERE role = 'user' AND source_kind = 'user' GROUP BY ALL) SELECT t.session_id, t.pos FROM t JOIN u ON u.session_id = t.session_id AND u.message_id = t.message_id WHERE first_seq > 1000 AND first_seq < 6000""")
def original_users(spark, sf_dir):
    return lookups.original_users(log(spark, sf_dir), F.lit(1000), F.lit(6000)).select("session_id", "pos")


@query("orphan_closure", f"""WITH RECURSIVE {LOG}, l AS (SELECT DISTINCT session_id, pos, coalesce(call_id, result_id) AS id FROM t WHERE kind IN ('view', 'click', 'error')),
f AS (SELECT session_id, min(pos) AS pos FROM t WHERE role <> 'system' GROUP BY session_id),
n AS (SELECT DISTINCT a.session_id, a.id, b.id AS other FROM l a JOIN l b ON b.session_id = a.session_id AND b.pos = a.pos),
r AS (SELECT session_id, id FROM f JOIN l USING (session_id, pos) UNION SELECT r.session_id, n.other FROM r JOIN n ON n.session_id = r.session_id AND n.id = r.id)
SELECT session_id, pos FROM f UNION SELECT session_id, pos FROM r JOIN l USING (session_id, id)""")
def orphan_closure(spark, sf_dir):
    return lookups.orphan_closure(log(spark, sf_dir))


@query("ordered_lookup", f"WITH {LOG} SELECT session_id, seq, 1000 - pos AS ord, role FROM t WHERE k % 9 = 0")
def ordered_lookup(spark, sf_dir):
    rows = log(spark, sf_dir)
    wanted = rows.where("k % 9 = 0").select("session_id", "seq", (F.lit(1000) - F.col("pos")).alias("ord"))
    return lookups.ordered_lookup(wanted, rows.select("session_id", "seq", "role"))


@query("protected_paths", f"WITH {LOG}, g AS (SELECT DISTINCT session_id, path FROM t WHERE source_form = 'instructions') SELECT t.session_id, t.pos, t.path FROM t LEFT JOIN g ON g.session_id = t.session_id AND g.path = t.path WHERE result_id IS NOT NULL AND g.path IS NULL")
def protected_paths(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("path", F.concat(F.lit("src/f"), (F.col("k") % 20).cast("string"), F.lit(".py")))
    return lookups.unprotected_paths(rows.where("tool_call_id is not null"), rows.where("source_form = 'instructions'")).select("session_id", "pos", "path")


@query("retained_state", f"""WITH {LOG}, u AS (SELECT *, CASE WHEN source_kind = 'user' AND source_form IS NOT NULL THEN 'note' ELSE source_kind END AS sk FROM t WHERE role = 'user')
SELECT session_id, pos, 0 AS nth, 'user' AS what, 'signup ' || k AS text FROM u WHERE sk = 'user'
UNION ALL (SELECT session_id, pos, 0, 'context', 'signup ' || k FROM u WHERE sk = 'note' QUALIFY row_number() OVER (PARTITION BY session_id, source_form, CASE WHEN source_form = 'instructions' THEN message_id END ORDER BY pos DESC) = 1)
UNION ALL SELECT session_id, pos, n::INTEGER, 'user', 'saved ' || k || ' ' || n FROM u, (SELECT unnest([0, 1]) AS n) WHERE sk = 'compact-checkpoint' AND k % 2 = 1""")
def retained_state(spark, sf_dir):
    rows = log(spark, sf_dir)
    rows = rows.withColumn("source_kind", F.when((F.col("source_kind") == "user") & F.col("source_form").isNotNull(), "note").otherwise(F.col("source_kind")))
    saved = rows.where("source_kind = 'compact-checkpoint' and k % 2 = 1").select("session_id", "seq", F.explode(F.array(F.lit(0), F.lit(1))).alias("nth"), "k")
    saved = saved.select("session_id", "seq", "nth", F.concat(F.lit("saved "), F.col("k").cast("string"), F.lit(" "), F.col("nth").cast("string")).alias("text"))
    return lookups.retained_state(rows, saved).drop("state_key")


# --- lineage, sets, order


@query("file_lineage", f"WITH {LOG}, x AS (SELECT session_id, path, CASE tool WHEN 'read_file' THEN 'read' WHEN 'write-file' THEN 'modified' END AS action, pos FROM t WHERE call_id IS NOT NULL) SELECT session_id, path, action, min(pos) AS first_pos FROM x WHERE action IS NOT NULL GROUP BY ALL")
def file_lineage(spark, sf_dir):
    return lineage.touched(log(spark, sf_dir))


@query("read_not_modified", f"WITH {LOG} SELECT session_id, path FROM t WHERE call_id IS NOT NULL AND tool = 'read_file' EXCEPT SELECT session_id, path FROM t WHERE call_id IS NOT NULL AND tool = 'write-file'")
def read_not_modified(spark, sf_dir):
    return lineage.only_read(lineage.touched(log(spark, sf_dir)))


@query("lineage_union", f"WITH {LOG} SELECT session_id, path, CASE tool WHEN 'read_file' THEN 'read' ELSE 'modified' END AS action FROM t WHERE call_id IS NOT NULL AND tool IN ('read_file', 'write-file') UNION SELECT session_id, 'docs/' || k, 'read' FROM t WHERE source_kind = 'compact-checkpoint' UNION SELECT session_id, 'lib/' || k, 'modified' FROM t WHERE source_kind = 'compact-checkpoint'")
def lineage_union(spark, sf_dir):
    rows = log(spark, sf_dir)
    k = F.col("k").cast("string")
    notes = rows.where("source_kind = 'compact-checkpoint'").select("session_id", F.concat(F.lit("Summary\n<read-files>\ndocs/"), k, F.lit("\n</read-files>\n\n<modified-files>\nlib/"), k, F.lit("\n</modified-files>")).alias("text"))
    return lineage.lineage(lineage.touched(rows), lineage.tagged(notes))


@query("activity", f"""WITH {LOG}, r AS (SELECT session_id, result_id, min_by(is_error, pos) AS failed FROM t WHERE result_id IS NOT NULL GROUP BY ALL),
x AS (SELECT t.session_id, t.pos, CASE tool WHEN 'read_file' THEN 'read' WHEN 'write-file' THEN 'edited' END AS kind, t.path || CASE WHEN coalesce(failed, false) THEN ' (failed)' ELSE '' END AS item FROM t LEFT JOIN r ON r.session_id = t.session_id AND r.result_id = t.call_id WHERE t.call_id IS NOT NULL)
SELECT session_id, kind, item, min(pos) AS first_pos FROM x WHERE kind IS NOT NULL GROUP BY ALL""")
def activity(spark, sf_dir):
    return lineage.activity(log(spark, sf_dir))


@query("latest_by_key", f"WITH {LOG} SELECT session_id, path, max(seq) AS seq, max_by(price, seq) AS price FROM t GROUP BY ALL")
def latest_by_key(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("path", F.concat(F.lit("src/f"), (F.col("k") % 20).cast("string"), F.lit(".py")))
    return lineage.latest_by_key(rows, ["session_id", "path"], "seq", ["seq", "price"])


@query("topk_recent_files", f"WITH {LOG}, f AS (SELECT session_id, path, max(time_ms) AS time_ms, min(pos) AS first_pos FROM t WHERE result_id IS NOT NULL AND NOT is_error GROUP BY ALL) SELECT session_id, path, time_ms, first_pos, row_number() OVER (PARTITION BY session_id ORDER BY time_ms DESC, first_pos)::INTEGER AS rank FROM f QUALIFY rank <= 5")
def topk_recent_files(spark, sf_dir):
    rows = log(spark, sf_dir).where("role = 'tool' and not is_error").withColumn("path", F.concat(F.lit("src/f"), (F.col("k") % 20).cast("string"), F.lit(".py")))
    return lineage.top_recent(rows, "path", "time_ms", 5)


_SOURCES = "x AS (SELECT session_id, pos, CASE source_form WHEN 'snapshot' THEN 'snapshot' ELSE 's' || (k % 10) END AS state_key, 's' || (k % 10) AS source FROM t WHERE role = 'user' AND source_kind = 'user')"


@query("distinct_sources", f"WITH {LOG}, {_SOURCES}, v AS (SELECT DISTINCT session_id, source FROM x WHERE pos % 5 = 0), n AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY session_id, state_key ORDER BY pos DESC) = 1) SELECT n.session_id, n.state_key, n.source, n.pos FROM n LEFT JOIN v ON v.session_id = n.session_id AND v.source = n.source WHERE v.source IS NULL")
def distinct_sources(spark, sf_dir):
    source = F.concat(F.lit("s"), (F.col("k") % 10).cast("string"))
    rows = log(spark, sf_dir).where(structure.typed_user()).select("session_id", "pos", F.when(F.col("source_form") == "snapshot", "snapshot").otherwise(source).alias("state_key"), source.alias("source"))
    return lineage.newest_sources(rows, rows.where("pos % 5 = 0")).select("session_id", "state_key", "source", "pos")


@query("distinct_arguments", f"WITH {LOG} SELECT session_id, path, max(pos) AS pos FROM t WHERE call_id IS NOT NULL GROUP BY ALL")
def distinct_arguments(spark, sf_dir):
    return lineage.distinct_newest(logs.calls_of(log(spark, sf_dir)), "arguments").select("session_id", text.path_from_json(F.col("arguments")).alias("path"), "pos")


@query("prior_summaries", f"""WITH {LOG}, d AS (SELECT session_id, 'checkpoint ' || (k % 3) AS text, min(pos) AS pos FROM t WHERE source_kind = 'compact-checkpoint' GROUP BY ALL), j AS (SELECT session_id, string_agg(text, chr(10) || chr(10) ORDER BY pos, text) AS committed FROM d GROUP BY session_id),
s AS (SELECT DISTINCT session_id, 'saved ' || session_id AS summary FROM t WHERE session_id % 2 = 0)
SELECT coalesce(j.session_id, s.session_id) AS session_id, coalesce(committed, summary, '') AS prior FROM j FULL JOIN s ON s.session_id = j.session_id""")
def prior_summaries(spark, sf_dir):
    rows = log(spark, sf_dir)
    cps = rows.where("source_kind = 'compact-checkpoint'").select("session_id", "pos", F.concat(F.lit("checkpoint "), (F.col("k") % 3).cast("string")).alias("text"))
    saved = rows.where("session_id % 2 = 0").select("session_id", F.concat(F.lit("saved "), F.col("session_id").cast("string")).alias("summary")).distinct()
    return lineage.prior_summary(cps, saved)


@query("restored_files", """WITH w AS (SELECT user_id AS session_id, 'src/f' || regexp_extract(props, '[0-9]+')::BIGINT * 20 || '.py' AS path, max(event_id) AS e FROM events WHERE event_type = 'click' GROUP BY ALL), d AS (SELECT 'src/f' || doc_id || '.py' AS path, text FROM documents),
f AS (SELECT w.session_id, w.path, -w.e AS rank, row_number() OVER (PARTITION BY session_id ORDER BY -w.e) AS nth, left(text, 40) AS content FROM w JOIN d ON d.path = w.path) SELECT session_id, path, rank, nth::INTEGER AS nth, content FROM f WHERE nth <= 5""")
def restored_files(spark, sf_dir):
    rows = log(spark, sf_dir).where("role = 'tool' and not is_error").groupBy("session_id", F.concat(F.lit("src/f"), (F.col("k") * 20).cast("string"), F.lit(".py")).alias("path")).agg((-F.max("seq")).alias("rank"))
    return lineage.restored_files(rows, logs.files_from_documents(logs.table(spark, sf_dir, "documents")), 5, 10)


@query("latest_todos", f"""WITH {LOG}, s AS (SELECT session_id, result_id FROM t WHERE result_id IS NOT NULL AND NOT is_error GROUP BY ALL) SELECT t.session_id, max_by('["item ' || k || '"]', pos) AS todos FROM t JOIN s ON s.session_id = t.session_id AND s.result_id = t.call_id WHERE k % 4 = 3 AND k % 3 > 0 GROUP BY t.session_id""")
def latest_todos(spark, sf_dir):
    k = F.col("k").cast("string")
    args = F.when(F.col("k") % 3 > 0, F.concat(F.lit('{"todos": ["item '), k, F.lit('"]}'))).otherwise('{"todos": "none"')
    call = F.transform("blocks", lambda b: b.withField("name", F.when(b["name"] == "grep", "TodoWrite").otherwise(b["name"])).withField("arguments", args))
    rows = log(spark, sf_dir)
    return lineage.latest_todos(rows.withColumn("blocks", F.when(F.exists("blocks", lambda b: b["type"] == "tool-call"), call).otherwise(F.col("blocks"))))


@query("last_images", "SELECT n::BIGINT AS n, list_slice(range(0, n)::BIGINT[], greatest(n - 2 + 1, 1), n)::VARCHAR AS kept FROM (SELECT unnest(range(1, 7)) AS n)")
def last_images(spark, sf_dir):
    rows = spark.range(1, 7).withColumnRenamed("id", "n")
    kept = lineage.last_images(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), 4_000)
    return rows.select("n", F.concat(F.lit("["), F.array_join(F.transform(kept, lambda x: x.cast("string")), ", "), F.lit("]")).alias("kept"))


# --- text


@query("transcripts_more", """SELECT conv_id AS session_id, md5(string_agg(CASE role WHEN 'user' THEN '[User]: ' ELSE '[Assistant]: ' END || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""")
def transcripts_more(spark, sf_dir):
    return blocks.transcript(conv(spark, sf_dir), blocks.message_text("more", 2_000)).select("session_id", F.md5("transcript").alias("digest"))


_CALL = "'{\"path\": \"' || path || '\"}'"


@query("transcripts_marked", f"""WITH {LOG}, m AS (SELECT session_id, pos, CASE WHEN role = 'tool' THEN CASE WHEN is_error THEN '[Tool error]: ' ELSE '[Tool result]: ' END || CASE WHEN length(kind || ' ' || k) > 7 THEN left(kind || ' ' || k, 7) || chr(10) || '[truncated]' ELSE kind || ' ' || k END
 WHEN call_id IS NOT NULL THEN '[Assistant tool call]: ' || tool || '(' || {_CALL} || ')' WHEN role = 'user' THEN '[User]: ' || kind || ' ' || k ELSE '[Assistant]: ' || kind || ' ' || k END AS line FROM t WHERE source_kind <> 'compact-checkpoint')
SELECT session_id, md5(string_agg(line, chr(10) || chr(10) ORDER BY pos)) AS digest FROM m GROUP BY session_id""")
def transcripts_marked(spark, sf_dir):
    return blocks.transcript(log(spark, sf_dir), blocks.message_text("marked", 7)).select("session_id", F.md5("transcript").alias("digest"))


@query("transcripts_named", f"""WITH {LOG}, m AS (SELECT session_id, pos, CASE WHEN role = 'tool' THEN '[Tool result (' || result_id || ')] ' || CASE WHEN length(kind || ' ' || k) > 7 THEN left(kind || ' ' || k, 7) || chr(10) || '[' || (length(kind || ' ' || k) - 7) || ' characters omitted]' ELSE kind || ' ' || k END
 WHEN call_id IS NOT NULL THEN '[Tool call] ' || tool || '(' || {_CALL} || ')' ELSE '[' || role || '] ' || kind || ' ' || k END AS line FROM t WHERE source_kind <> 'compact-checkpoint')
SELECT session_id, md5(string_agg(line, chr(10) || chr(10) ORDER BY pos)) AS digest FROM m GROUP BY session_id""")
def transcripts_named(spark, sf_dir):
    return blocks.transcript(log(spark, sf_dir), blocks.named_message_text(7)).select("session_id", F.md5("transcript").alias("digest"))


@query("path_from_json", "SELECT event_id, 'src/' || regexp_extract(props, '[0-9]+') AS path, NULL::VARCHAR AS number_path, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def path_from_json(spark, sf_dir):
    rows = logs.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    args = F.concat(F.lit('{"file_path": "", "path": "src/'), k, F.lit('"}'))
    return rows.select("event_id", text.path_from_json(args).alias("path"), text.path_from_json(F.replace("props", F.lit("k"), F.lit("path"))).alias("number_path"), k.cast("long").alias("k"))


@query("tool_names", "SELECT event_id, lower(regexp_replace(n, '[-_]', '', 'g')) AS plain, regexp_replace(lower(n), '[^a-z0-9]', '', 'g') AS letters, lower(regexp_replace(regexp_extract(n, '[^./]*$'), '[-_]', '', 'g')) AS last FROM (SELECT event_id, 'Mod.' || event_type || '_X-' || event_id AS n FROM events)")
def tool_names(spark, sf_dir):
    n = F.concat(F.lit("Mod."), F.col("event_type"), F.lit("_X-"), F.col("event_id").cast("string"))
    return logs.table(spark, sf_dir, "events").select("event_id", text.normal_name(n).alias("plain"), text.normal_name(n, only_letters=True).alias("letters"), text.normal_name(n, last_segment=True).alias("last"))


@query("nested_paths", "SELECT event_id, 'c/' || k || ',a/' || k || ',b' AS paths FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)")
def nested_paths(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    args = F.concat(F.lit('{"files": [{"path": "a/'), k, F.lit('"}, " b "], "target_file": "c/'), k, F.lit('", "other": "x"}'))
    return logs.table(spark, sf_dir, "events").select("event_id", F.array_join(text.collect_paths(args), ",").alias("paths"))


@query("patch_paths", "SELECT event_id, 'src/' || event_id || '.py' AS first, 'old file' AS second, 2::BIGINT AS n FROM events")
def patch_paths(spark, sf_dir):
    patch = F.concat(F.lit("*** Begin\n*** Update File: src/"), F.col("event_id").cast("string"), F.lit(".py\n+x *** Add File: no\n*** Delete File: old file\n"))
    found = text.patch_paths(patch)
    return logs.table(spark, sf_dir, "events").select("event_id", found[0].alias("first"), found[1].alias("second"), F.size(found).cast("long").alias("n"))


_SUMMARY = "CASE turn % 4 WHEN 0 THEN '<analysis>x' || chr(10) || 'y</analysis> <summary> ' || coalesce(text, '') || ' </summary>' WHEN 1 THEN coalesce(text, '') WHEN 2 THEN '<summary>' || coalesce(text, '') ELSE '<analysis>' || coalesce(text, '') END"


@query("stripped_summaries", f"WITH x AS (SELECT conv_id, turn, coalesce(text, '') AS text, {_SUMMARY} AS raw FROM conversations) SELECT conv_id, turn, CASE WHEN turn % 4 < 2 THEN trim(text, ' ') END AS strict, CASE WHEN turn % 4 < 2 THEN trim(text, ' ') ELSE trim(raw, ' ') END AS loose FROM x")
def stripped_summaries(spark, sf_dir):
    rows = logs.table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    t = F.col("text")
    raw = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("<analysis>x\ny</analysis> <summary> "), t, F.lit(" </summary>"))).when(F.col("turn") % 4 == 1, t).when(F.col("turn") % 4 == 2, F.concat(F.lit("<summary>"), t)).otherwise(F.concat(F.lit("<analysis>"), t))
    return rows.select("conv_id", "turn", text.stripped_summary(raw).alias("strict"), text.stripped_summary(raw, strict=False).alias("loose"))


@query("state_snapshots", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND trim(text, ' ') <> '' THEN trim(text, ' ') END AS state FROM conversations")
def state_snapshots(spark, sf_dir):
    raw = F.concat(F.lit("note <state_snapshot>"), F.col("text"), F.when(F.col("turn") % 2 == 0, "</state_snapshot>").otherwise(""))
    return logs.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.state_snapshot(raw).alias("state"))


@query("token_gaps", "SELECT event_id, greatest(event_id % 3000 - 1500, 0) AS gap, nullif(greatest(event_id % 3000 + 1000 - 2500, 0), 0) AS grouped FROM events")
def token_gaps(spark, sf_dir):
    rows = logs.table(spark, sf_dir, "events")
    n = F.col("event_id") % 3000
    plain = F.concat(F.lit("prompt is too long: "), n.cast("string"), F.lit(" tokens > 1500 maximum"))
    commas = F.concat(F.lit("got "), F.format_number(n + 1000, 0), F.lit(" tokens > 2,500"))
    return rows.select("event_id", text.token_gap(plain).alias("gap"), text.token_gap(commas, commas=True).alias("grouped"))


#: Errors as (code, message, code of the cause), one for each eighth event.
_ERRORS = (
    ("", "prompt is too long: 210000 tokens > 200000", ""), ("CONTEXT_WINDOW_EXCEEDED", "refused", ""), ("IMAGE_TOO_LARGE", "no", ""), ("ABORTED", "the user stopped", ""),
    ("", "service unavailable", "RATE_LIMIT"), ("MAX_TOKENS", "summary truncated", ""), ("", "context length above the limit", ""), ("X", "no such file", "PROMPT_TOO_LONG"),
)
_ERROR_SQL = {
    "idle_headroom": "CASE WHEN regexp_matches(m, '(?i)prompt.{0,16}too.?long|context.{0,30}(overflow|exceed|limit)|maximum.{0,20}token') THEN 'overflow' END",
    "user_tail": "CASE WHEN regexp_matches(c, '(?i)ABORT|CANCEL|INTERRUPT|SESSION_BUDGET_EXCEEDED') THEN 'terminal' WHEN regexp_matches(c, '(?i)CONTEXT.*(EXCEED|OVERFLOW|LENGTH)|PROMPT_TOO_LONG') OR regexp_matches(m, '(?i)context.{0,35}(exceed|overflow|limit)|prompt.{0,16}too.?long|maximum context length') THEN 'overflow' END",
    "image_guard": "CASE WHEN regexp_matches(m, '(?i)context.{0,40}(exceed|limit|overflow)|prompt.{0,16}too.?long|maximum.{0,20}token') THEN 'overflow' END",
    "round_keep": "CASE WHEN regexp_matches(c, '(?i)MEDIA_TOO_LARGE|IMAGE_TOO_LARGE|UNSUPPORTED_CONTENT|REQUEST_TOO_LARGE') THEN 'media' WHEN regexp_matches(c, '(?i)CONTEXT.*(EXCEED|OVERFLOW)|PROMPT_TOO_LONG') OR regexp_matches(m, '(?i)context.*(window|length|exceed)|prompt.*too long|tokens?\\s*>\\s*\\d') THEN 'overflow' END",
    "head_tail": "CASE WHEN regexp_matches(c || '|' || k, '(?i)CONTEXT[^|]*(EXCEED|OVERFLOW)|PROMPT_TOO_LONG') OR regexp_matches(m, '(?i)context.*(length|window|exceed)|prompt.*too long') THEN 'overflow' WHEN regexp_matches(c || '|' || k, '(?i)MAX_TOKENS|EMPTY_RESPONSE') THEN 'incomplete' WHEN regexp_matches(c || '|' || k, '(?i)RATE_LIMIT|TIMEOUT|SERVER|NETWORK|OVERLOADED|UNAVAILABLE') THEN 'transient' END",
    "calibrated": "CASE WHEN regexp_matches(c, '(?i)^(?:ABORTED|CANCELLED|CANCELED|ABORT_ERR)$') OR regexp_matches(k, '(?i)^(?:ABORTED|CANCELLED|CANCELED|ABORT_ERR)$') THEN 'cancelled' END",
}


@query("fault_classes", "WITH x(i, c, m, k) AS (VALUES " + ", ".join(f"({i}, '{c}', '{m}', '{k}')" for i, (c, m, k) in enumerate(_ERRORS)) + ") SELECT event_id, " + ", ".join(f"{sql} AS {name}" for name, sql in _ERROR_SQL.items()) + " FROM events JOIN x ON event_id % 8 = i")
def fault_classes(spark, sf_dir):
    link = lambda c, m: F.struct(F.lit(c).alias("code"), F.lit(m).alias("message"))
    chains = F.array(*[F.array(link(c, m), link(k, "")) for c, m, k in _ERRORS])
    chain = F.element_at(chains, (F.col("event_id") % 8 + 1).cast("int"))
    return logs.table(spark, sf_dir, "events").select("event_id", *[faults.fault_class(name, chain).alias(name) for name in _ERROR_SQL])


@query("request_triggers", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'request-too-large' WHEN 1 THEN 'context-overflow' END AS asks_for FROM events")
def request_triggers(spark, sf_dir):
    i = F.col("event_id") % 3
    return logs.table(spark, sf_dir, "events").select("event_id", faults.request_trigger(F.when(i == 0, 413).otherwise(400), F.when(i == 1, "CONTEXT_WINDOW_EXCEEDED").otherwise("BAD")).alias("asks_for"))


@query("response_faults", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'truncated' WHEN 1 THEN 'error' WHEN 2 THEN 'not text' WHEN 3 THEN 'empty' END AS fault FROM events")
def response_faults(spark, sf_dir):
    i = F.col("event_id") % 6
    finish = F.when(i == 0, "max-tokens").when(i == 1, "error").otherwise("stop")
    kinds = F.when(i == 2, F.array(F.lit("text"), F.lit("image"))).otherwise(F.array(F.lit("text")))
    return logs.table(spark, sf_dir, "events").select("event_id", text.response_fault(finish, kinds, F.when(i == 3, "  ").otherwise("body")).alias("fault"))


@query("file_tag_texts", f"""WITH {LOG}, f AS (SELECT session_id, list_sort(list_distinct(list(path) FILTER (tool = 'read_file'))) AS r, list_sort(list_distinct(list(path) FILTER (tool = 'write-file'))) AS w FROM t WHERE call_id IS NOT NULL GROUP BY session_id), g AS (SELECT session_id, list_filter(coalesce(r, []), lambda x: NOT list_contains(coalesce(w, []), x)) AS r, coalesce(w, []) AS w FROM f)
SELECT session_id, CASE WHEN len(r) > 0 THEN chr(10) || chr(10) || '<read-files>' || chr(10) || array_to_string(r, chr(10)) || chr(10) || '</read-files>' ELSE '' END || CASE WHEN len(w) > 0 THEN chr(10) || chr(10) || '<modified-files>' || chr(10) || array_to_string(w, chr(10)) || chr(10) || '</modified-files>' ELSE '' END AS tags FROM g""")
def file_tag_texts(spark, sf_dir):
    rows = logs.calls_of(log(spark, sf_dir)).withColumn("path", text.path_from_json(F.col("arguments")))
    g = rows.groupBy("session_id").agg(F.collect_set(F.when(F.col("name") == "read_file", F.col("path"))).alias("r"), F.collect_set(F.when(F.col("name") == "write-file", F.col("path"))).alias("w"))
    return g.select("session_id", text.file_tags(F.col("r"), F.col("w")).alias("tags"))


_PATHS = lambda c: f"CASE WHEN len({c}) > 0 THEN '- ' || array_to_string({c}, chr(10) || '- ') ELSE '- none' END"


@query("files_sections", f"""WITH {LOG}, f AS (SELECT session_id, coalesce(list_sort(list_distinct(list(path) FILTER (tool = 'read_file'))), []) AS r, coalesce(list_sort(list_distinct(list(path) FILTER (tool = 'write-file'))), []) AS w FROM t WHERE call_id IS NOT NULL GROUP BY session_id)
SELECT session_id, '## Files' || chr(10) || 'Read:' || chr(10) || {_PATHS('r')} || chr(10) || 'Edited:' || chr(10) || {_PATHS('w')} AS section FROM f""")
def files_sections(spark, sf_dir):
    rows = logs.calls_of(log(spark, sf_dir)).withColumn("path", text.path_from_json(F.col("arguments")))
    named = lambda tool: F.array_sort(F.collect_set(F.when(F.col("name") == tool, F.col("path"))))
    g = rows.groupBy("session_id").agg(named("read_file").alias("r"), named("write-file").alias("w"))
    return g.select("session_id", text.files_section(F.col("r"), F.col("w")).alias("section"))


@query("clipped_text", "SELECT conv_id, turn, CASE WHEN length(text) > 100 THEN left(text, 100) || chr(10) || '[' || (length(text) - 100) || ' characters omitted]' ELSE text END AS clipped FROM conversations")
def clipped_text(spark, sf_dir):
    return logs.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.clip(F.col("text"), 100, "\n[{} characters omitted]").alias("clipped"))


@query("summary_inputs", f"WITH {LOG} SELECT session_id, pos, CASE WHEN role = 'tool' AND length(kind || ' ' || k) > 7 THEN left(kind || ' ' || k, 7) || chr(10) || '[Output shortened for the request]' WHEN call_id IS NOT NULL THEN '' ELSE kind || ' ' || k END AS text, CASE WHEN role = 'tool' THEN left(kind || ' ' || k, 6) || CASE WHEN length(kind || ' ' || k) > 6 THEN chr(10) || '[Output left out of the request]' ELSE '' END WHEN call_id IS NOT NULL THEN '' ELSE kind || ' ' || k END AS shared FROM t")
def summary_inputs(spark, sf_dir):
    rows = log(spark, sf_dir)
    return rows.select("session_id", "pos", logs.text_of(blocks=blocks.summary_input(F.col("role"), 7)).alias("text"), logs.text_of(blocks=blocks.shared_budget(F.col("role"), 6)).alias("shared"))


_LISTED = "CASE k % 13 WHEN 0 THEN 'tool-catalog' WHEN 1 THEN 'skill-list' WHEN 2 THEN 'discovery-note' ELSE source_kind END"


@query("large_request_rows", f"WITH {LOG} SELECT session_id, pos, CASE WHEN call_id IS NOT NULL THEN '' WHEN length(kind || ' ' || k) > 8 THEN left(kind || ' ' || k, 8) || chr(10) || '[Output shortened for the request]' ELSE kind || ' ' || k END AS text FROM t WHERE k % 13 > 2")
def large_request_rows(spark, sf_dir):
    """A request after one that was too large: no listings, every text short."""
    rows = log(spark, sf_dir).withColumn("source_kind", F.expr(_LISTED)).where(blocks.asked_about(F.col("source_kind")))
    return rows.select("session_id", "pos", logs.text_of(blocks=blocks.summary_input(F.col("role"), 8, too_large=True)).alias("text"))


@query("price_attachments", f"""WITH {LOG}, x AS (SELECT *, strlen('{{"id":"ü' || k || '"}}') AS j, CASE WHEN call_id IS NULL THEN strlen(kind || ' ' || k) ELSE strlen(tool || '{{"path": "' || path || '"}}') END AS own FROM t)
SELECT session_id, pos, ((own + CASE WHEN k % 3 = 0 THEN j ELSE 7373 END + CASE WHEN k % 2 = 0 THEN j ELSE 0 END + 3) // 4)::BIGINT AS tokens FROM x WHERE role IN ('user', 'assistant')""")
def price_attachments(spark, sf_dir):
    """Messages with an image, some of them moved out of the log, and some with a file."""
    attachment = F.concat(F.lit('{"id":"ü'), F.col("k").cast("string"), F.lit('"}'))
    image = logs.block("image", name=F.when(F.col("k") % 3 == 0, "offloaded"), arguments=attachment)
    more = F.when(F.col("k") % 2 == 0, F.array(image, logs.block("file", arguments=attachment))).otherwise(F.array(image))
    rows = log(spark, sf_dir).where("role in ('user', 'assistant')")
    return rows.select("session_id", "pos", pricing.bytes4(F.concat("blocks", more), F.col("role"), F.lit("")).alias("tokens"))


@query("media_placeholders", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '[Attached image/png: image]' WHEN 1 THEN '[Attached file]' ELSE 'plain' END AS text FROM events")
def media_placeholders(spark, sf_dir):
    i = F.col("event_id") % 3
    own = F.when(i == 0, F.array(logs.block("image", media_type=F.lit("image/png")))).when(i == 1, F.array(logs.block("file"))).otherwise(F.array(logs.block("text", F.lit("plain"))))
    return logs.table(spark, sf_dir, "events").select("event_id", logs.text_of(blocks=blocks.media_as_text(own)).alias("text"))


@query("fingerprints", f"""WITH {LOG}, c AS (SELECT *, CASE WHEN kind = 'view' THEN 'call ' || (k % 20) ELSE kind || ' ' || k END AS content FROM t)
SELECT session_id, pos, min(pos) OVER (PARTITION BY session_id, content) AS same_as, count(*) OVER (PARTITION BY content) AS times FROM c""")
def fingerprints(spark, sf_dir):
    """Each row with the first row of its session, and the number of all rows, that have its content."""
    rows = log(spark, sf_dir).select("session_id", "pos", lookups.fingerprint().alias("f"))
    times = rows.groupBy("f").agg(F.count("*").alias("times"))
    return rows.withColumn("same_as", F.min("pos").over(W.partitionBy("session_id", "f"))).join(times, "f").select("session_id", "pos", "same_as", "times")


@query("session_paths", "SELECT event_id, regexp_replace(regexp_replace(trim(s), '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS name, replace(s, '|', chr(92) || '|') AS cell FROM (SELECT event_id, ' /' || event_type || '|' || event_id || '/ ' AS s FROM events)")
def session_paths(spark, sf_dir):
    s = F.concat(F.lit(" /"), F.col("event_type"), F.lit("|"), F.col("event_id").cast("string"), F.lit("/ "))
    return logs.table(spark, sf_dir, "events").select("event_id", text.session_path(s).alias("name"), text.markdown_cell(s).alias("cell"))


def _ends_sql(text: str, front: str, back: str, gone: str, most: int) -> str:
    """Both ends of ``text`` in whole characters of at most ``front`` and ``back`` bytes, neither above ``most``."""
    long = lambda side, n: f"{side}({text}, list_max(list_filter(range(0, {most + 1}), lambda i: strlen({side}({text}, i)) <= {n})))"
    return f"{long('left', front)} || '…' || {gone} || ' tokens truncated…' || {long('right', back)}"


@query("middle_truncated", f"SELECT doc_id, CASE WHEN strlen(text) <= 200 THEN text ELSE {_ends_sql('text', '100', '100', '((strlen(text) - 200 + 3) // 4)', 100)} END AS cut FROM documents")
def middle_truncated(spark, sf_dir):
    return logs.table(spark, sf_dir, "documents").select("doc_id", text.middle_truncate(F.col("text"), F.lit(50)).alias("cut"))


def _clip_sql(side: str, budget: int) -> str:
    part = f"{side}(text, i)"
    return f"{side}(text, list_max(list_filter(range(0, {4 * budget + 1}), lambda i: {_WEIGHTED(part)} <= {budget})))"


@query("weighted_clips", f"SELECT doc_id, {_clip_sql('left', 40)} AS head, {_clip_sql('right', 40)} AS tail FROM documents")
def weighted_clips(spark, sf_dir):
    t = F.col("text")
    return logs.table(spark, sf_dir, "documents").select("doc_id", text.weighted_clip(t, F.lit(40), F.lit(False)).alias("head"), text.weighted_clip(t, F.lit(40), F.lit(True)).alias("tail"))


@query("json_objects", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS found FROM events")
def json_objects(spark, sf_dir):
    prose = F.concat(F.lit("result {not json} then "), F.col("props"), F.lit(" and more"))
    return logs.table(spark, sf_dir, "events").select("event_id", text.json_object(prose).alias("found"))


# --- state


@query("idle_sessions", f"WITH {LOG}, l AS (SELECT session_id, max_by(time_ms, pos) AS last_ms FROM t WHERE role = 'assistant' GROUP BY session_id) SELECT session_id, (1706745600000 - last_ms)::BIGINT AS idle_ms FROM l WHERE 1706745600000 - last_ms >= 1440 * 60000")
def idle_sessions(spark, sf_dir):
    return state.idle(log(spark, sf_dir), 1_706_745_600_000, 1440)


_TRIES = "a AS (SELECT session_id, pos AS ord, kind = 'purchase' AS ok FROM t WHERE kind IN ('error', 'purchase'))"


@query("failure_circuit", f"WITH {LOG}, {_TRIES}, l AS (SELECT *, max(CASE WHEN ok THEN ord END) OVER (PARTITION BY session_id) AS last FROM a) SELECT session_id, count(*) FILTER (NOT ok AND (last IS NULL OR ord > last)) AS failures, count(*) FILTER (NOT ok AND (last IS NULL OR ord > last)) >= 3 AS open FROM l GROUP BY session_id")
def failure_circuit(spark, sf_dir):
    rows = log(spark, sf_dir).where("usage is not null or (role = 'tool' and is_error)")
    return state.failure_circuit(rows.select("session_id", F.col("pos").alias("ord"), F.col("usage").isNotNull().alias("ok")))


@query("overflow_attempts", f"""WITH {LOG}, s AS (SELECT *, last_value(CASE WHEN role = 'user' THEN pos END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS series FROM t)
SELECT session_id, pos AS ord, series, row_number() OVER (PARTITION BY session_id, series ORDER BY pos) AS attempt, row_number() OVER (PARTITION BY session_id, series ORDER BY pos) <= 2 AS allowed FROM s WHERE kind = 'error'""")
def overflow_attempts(spark, sf_dir):
    rows = state.series(log(spark, sf_dir), F.col("role") == "user", F.col("pos"))
    rows = rows.where("role = 'tool' and is_error").select("session_id", F.col("pos").alias("ord"), "series")
    return state.retry_budget(rows, "series", 2)


@query("request_series", f"WITH {LOG} SELECT session_id, pos, last_value(CASE WHEN role = 'user' OR (has_usage AND finish = 'stop') THEN seq END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS series FROM t")
def request_series(spark, sf_dir):
    starts = (F.col("role") == "user") | (F.col("usage").isNotNull() & (F.col("finish") == "stop"))
    return state.series(log(spark, sf_dir), starts, F.col("seq")).select("session_id", "pos", "series")


@query("open_sections", f"WITH {LOG}, x AS (SELECT session_id, pos, CASE WHEN kind = 'view' THEN 1 WHEN kind = 'purchase' OR role = 'system' THEN 0 END AS v FROM t) SELECT session_id, max_by(v, pos) = 1 AS open FROM x WHERE v IS NOT NULL GROUP BY session_id")
def open_sections(spark, sf_dir):
    begin = F.exists("blocks", lambda b: b["type"] == "tool-call")
    return state.open_sections(log(spark, sf_dir), begin, F.col("usage").isNotNull(), F.col("role") == "system")


@query("rapid_refills", f"""WITH {LOG}, x AS (SELECT session_id, pos AS ord, 't' || (pos // 20) AS turn_key, (k % 5)::BIGINT AS batches FROM t WHERE kind = 'purchase'), f AS (SELECT *, row_number() OVER (PARTITION BY session_id, turn_key ORDER BY ord) > 1 AND batches < 3 AS quick FROM x),
r AS (SELECT *, sum((NOT quick)::BIGINT) OVER (PARTITION BY session_id, turn_key ORDER BY ord) AS run FROM f), z AS (SELECT *, sum(quick::BIGINT) OVER (PARTITION BY session_id, turn_key, run ORDER BY ord)::BIGINT AS refills FROM r)
SELECT session_id, ord, turn_key, batches, refills, refills >= 3 AS blocked FROM z""")
def rapid_refills(spark, sf_dir):
    rows = log(spark, sf_dir).where("usage is not null").select("session_id", F.col("pos").alias("ord"), F.concat(F.lit("t"), F.floor(F.col("pos") / 20).cast("string")).alias("turn_key"), (F.col("k") % 5).alias("batches"))
    return state.rapid_refills(rows)


@query("valid_ranges", f"""WITH {LOG}, {CALLS}, x AS (SELECT * FROM c WHERE idx BETWEEN session_id % 7 AND session_id % 7 + session_id % 11 AND NOT (session_id % 5 = 0 AND idx = session_id % 7 + 2))
SELECT session_id, max(idx) - min(idx) + 1 = count(*) AS contiguous, NOT bool_or(role = 'system') AS unprotected, min_by(open_before, idx) = 0 AND max_by(open_after, idx) = 0 AS balanced, (max(idx) - min(idx) + 1 = count(*)) AND NOT bool_or(role = 'system') AND min_by(open_before, idx) = 0 AND max_by(open_after, idx) = 0 AS valid FROM x GROUP BY session_id""")
def valid_ranges(spark, sf_dir):
    rows = structure.indexed(structure.balanced(log(spark, sf_dir)))
    s = F.col("session_id")
    return state.valid_ranges(rows.where(F.col("idx").between(s % 7, s % 7 + s % 11) & ~((s % 5 == 0) & (F.col("idx") == s % 7 + 2))))


@query("unchanged_sessions", f"WITH {LOG} SELECT session_id FROM t GROUP BY session_id HAVING NOT bool_or(k = 13 AND kind = 'click')")
def unchanged_sessions(spark, sf_dir):
    rows = log(spark, sf_dir)
    changed = rows.withColumn("price", F.when((F.col("k") == 13) & (F.col("role") == "tool") & ~F.col("is_error"), F.col("price") + 1).otherwise(F.col("price")))
    return state.unchanged(state.version(rows, ["pos", "seq", "price"]), state.version(changed, ["pos", "seq", "price"]))


@query("shrink_checks", f"WITH {LOG}, o AS (SELECT session_id, sum(price)::BIGINT AS old_tokens FROM t GROUP BY session_id) SELECT session_id, 400 + session_id AS tokens, old_tokens, 400 + session_id < old_tokens AS accepted FROM o")
def shrink_checks(spark, sf_dir):
    rows = log(spark, sf_dir)
    return state.shrinks(rows, rows.select("session_id").distinct().withColumn("tokens", F.lit(400) + F.col("session_id"))).select("session_id", "tokens", "old_tokens", "accepted")


# --- replacing and compacting


@query("replaced_entries", f"WITH {LOG} SELECT session_id, pos, CASE WHEN role = 'tool' AND k % 4 = 0 THEN '[cleared]' WHEN call_id IS NOT NULL THEN '' ELSE kind || ' ' || k END AS text FROM t")
def replaced_entries(spark, sf_dir):
    rows = log(spark, sf_dir)
    new = rows.where("role = 'tool' and k % 4 = 0").select("session_id", "seq", F.array(logs.block("text", F.lit("[cleared]"))).alias("blocks"))
    return logs.replace(rows, new).select("session_id", "pos", logs.text_of().alias("text"))


@query("compacted_entries", f"""WITH {LOG} SELECT session_id, pos, role, source_kind FROM t WHERE NOT (pos BETWEEN 3 AND 9) OR session_id % 2 = 1 UNION ALL SELECT session_id, min(pos), 'user', 'compact-checkpoint' FROM t WHERE pos BETWEEN 3 AND 9 AND session_id % 2 = 0 GROUP BY session_id""")
def compacted_entries(spark, sf_dir):
    rows = log(spark, sf_dir)
    points = rows.where("session_id % 2 = 0").groupBy("session_id").agg((F.max("seq") + 1).alias("seq")).withColumn("blocks", F.array(logs.block("text", F.lit("summary"))))
    return logs.compact(rows, rows.where("pos between 3 and 9"), points).select("session_id", "pos", "role", "source_kind")


@query("checkpoint_parts", "SELECT conv_id AS session_id, array_to_string(['before', 'summary ' || conv_id] || list('kept ' || turn ORDER BY turn), '|') AS parts FROM conversations GROUP BY conv_id")
def checkpoint_parts(spark, sf_dir):
    kept = F.transform(F.array_sort(F.collect_list("turn")), lambda x: F.concat(F.lit("kept "), x.cast("string")))
    rows = logs.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(kept.alias("restored"))
    return rows.select("session_id", F.array_join(F.concat(F.array(F.lit("before"), F.concat(F.lit("summary "), F.col("session_id").cast("string"))), "restored"), "|").alias("parts"))


_SPAN = "i AS (SELECT *, sum((role = 'system')::BIGINT) OVER (PARTITION BY session_id ORDER BY pos) AS island FROM t)"
_CHOSEN = "count(*) AS \"rows\", sum(price)::BIGINT AS tokens, min(pos) AS first_pos, max(pos) AS last_pos"


def _recent_rounds_sql(mode: str) -> str:
    return f"""WITH {SPANS}, {CALLS}, e AS (SELECT session_id, max(pos) FILTER (open_after = 0) AS endpos FROM c GROUP BY session_id),
d AS (SELECT c.*, min(tail) OVER (PARTITION BY c.session_id) AS rest, count(*) OVER (PARTITION BY c.session_id) AS m FROM c JOIN e ON c.session_id = e.session_id AND pos <= endpos),
l AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN message_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lastid FROM d WHERE m >= 2),
r AS (SELECT *, sum(({_ROUND_SQL[mode]} AND idx > 0)::BIGINT) OVER (PARTITION BY session_id ORDER BY pos)::BIGINT AS round FROM l),
g AS (SELECT *, sum(price) OVER (PARTITION BY session_id) - sum(price) OVER (PARTITION BY session_id ORDER BY round RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS newer FROM r)
SELECT owner AS session_id, {_CHOSEN} FROM g WHERE newer >= greatest(0, 6000 - rest) GROUP BY owner, island HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY owner ORDER BY island) = 1"""


_SELECT_SQL = {
    "idle_headroom": _recent_rounds_sql("message"),
    "image_guard": _recent_rounds_sql("pending"),
    "round_keep": f"""WITH {SPANS}, {CALLS}, r AS (SELECT *, sum((role = 'assistant' AND idx > 0)::BIGINT) OVER (PARTITION BY session_id ORDER BY pos) AS round FROM c),
w0 AS (SELECT session_id, round, sum(price) AS tokens FROM r GROUP BY ALL),
w1 AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS rounds, coalesce(sum(tokens) OVER (PARTITION BY session_id ORDER BY round ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS newer FROM w0),
w2 AS (SELECT session_id, max(rounds) AS rounds, CASE WHEN max(rounds) = 1 THEN 0 ELSE greatest(1, count(*) FILTER (round > 0 AND newer < 6000)) END AS keep FROM w1 GROUP BY session_id),
x AS (SELECT r.* FROM r JOIN w2 ON r.session_id = w2.session_id AND round < rounds - keep), e AS (SELECT session_id, max(pos) FILTER (open_after = 0) AS endpos FROM x GROUP BY session_id)
SELECT owner AS session_id, {_CHOSEN} FROM x JOIN e ON x.session_id = e.session_id AND pos <= endpos GROUP BY owner, island HAVING count(DISTINCT round) >= 2 AND bool_or(role = 'assistant') QUALIFY row_number() OVER (PARTITION BY owner ORDER BY island) = 1""",
    "turn_tail": f"""WITH {SPANS}, {CALLS}, v AS (SELECT *, source_kind = 'compact-checkpoint' AS cp, price * 4 AS len FROM c), {_tail_sql(6000)}
SELECT owner AS session_id, {_CHOSEN} FROM c JOIN tl ON c.session_id = tl.session_id WHERE idx < kept GROUP BY owner, island HAVING bool_or(source_kind <> 'compact-checkpoint') QUALIFY row_number() OVER (PARTITION BY owner ORDER BY island) = 1""",
    "split_turn": f"""WITH {FIRST_SPAN}, {CALLS}, v AS (SELECT *, role <> 'tool' AND open_before = 0 AS valid, max(CASE WHEN later + price >= 6000 THEN idx END) OVER (PARTITION BY session_id) AS reach FROM c),
g AS (SELECT session_id, coalesce(min(idx) FILTER (valid AND idx >= reach), min(idx) FILTER (valid), 0) AS cut FROM v GROUP BY session_id)
SELECT c.session_id, {_CHOSEN} FROM c JOIN g ON c.session_id = g.session_id WHERE idx < cut GROUP BY c.session_id HAVING bool_or(source_kind <> 'compact-checkpoint')""",
    "calibrated": f"""WITH {_SAFE}, l AS (SELECT session_id, max(pos) FILTER (role = 'user' AND source_kind = 'user') AS latest FROM t GROUP BY session_id),
y AS (SELECT z.*, last_pos, latest, row_number() OVER w - 1 AS i, coalesce(sum(price) OVER (PARTITION BY z.session_id, z.island ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS suffix
      FROM z JOIN ss ON z.session_id = ss.session_id AND z.island = ss.island JOIN l ON l.session_id = z.session_id WINDOW w AS (PARTITION BY z.session_id, z.island ORDER BY pos)),
m AS (SELECT session_id, island, coalesce(max(i) FILTER (suffix >= 6000), 0) AS reach, max(i) FILTER (role = 'user' AND source_kind = 'user') AS typed FROM y GROUP BY ALL),
q AS (SELECT y.session_id, y.island, max(i) AS cut FROM y JOIN m ON y.session_id = m.session_id AND y.island = m.island WHERE open_before = 0 AND role <> 'tool' AND i <= CASE WHEN typed > 0 THEN least(reach, typed) ELSE reach END GROUP BY ALL)
SELECT y.session_id, {_CHOSEN} FROM y LEFT JOIN q ON y.session_id = q.session_id AND y.island = q.island WHERE last_pos < coalesce(latest, -1) OR i < coalesce(cut, 0)
GROUP BY y.session_id, y.island HAVING bool_or(source_kind <> 'compact-checkpoint') QUALIFY row_number() OVER (PARTITION BY y.session_id ORDER BY y.island) = 1""",
    "user_tail": f"""WITH {LOG}, {CALLS}, i AS (SELECT *, sum((role = 'system')::BIGINT) OVER (PARTITION BY session_id ORDER BY pos) AS island FROM c),
a AS (SELECT session_id, island, min(pos) AS first_pos FROM i WHERE role NOT IN ('system', 'tool') AND open_before = 0 GROUP BY ALL),
z AS (SELECT i.session_id, i.island, max(pos) AS last_pos FROM i JOIN a ON i.session_id = a.session_id AND i.island = a.island WHERE role <> 'system' AND pos >= first_pos AND open_after = 0 GROUP BY ALL),
g AS (SELECT i.session_id, i.island, {_CHOSEN} FROM i JOIN a ON i.session_id = a.session_id AND i.island = a.island JOIN z ON i.session_id = z.session_id AND i.island = z.island
      WHERE role <> 'system' AND i.pos BETWEEN a.first_pos AND z.last_pos GROUP BY ALL HAVING bool_or(role IN ('assistant', 'tool')))
SELECT session_id, "rows", tokens, first_pos, last_pos FROM g QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY island) = 1 AND "rows" > 1""",
    "head_tail": f"""WITH {LOG}, {_SPAN}, s AS (SELECT session_id, island, count(*) AS "rows", sum(price)::BIGINT AS tokens, min(pos) AS first_pos, max(pos) AS last_pos FROM i WHERE role <> 'system' GROUP BY ALL HAVING bool_or(source_kind <> 'compact-checkpoint'))
SELECT session_id, "rows", tokens, first_pos, last_pos FROM s QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY island) = 1""",
}


def _select(preset: str, keep: int) -> None:
    @query(f"select_{preset}", _SELECT_SQL.get(preset))
    def run(spark, sf_dir):
        """What the preset hands to a summary (without SQL: compared with literal walks in the tests)."""
        rows = log(spark, sf_dir)
        if preset == "calibrated":
            rows = expected_only(rows)
        if preset == "turn_tail":
            rows = rows.withColumn("json_len", F.col("price") * 4)
        return presets.SELECT[preset](rows, keep).groupBy("session_id").agg(F.count("*").alias("rows"), F.sum("price").alias("tokens"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


for _p in strategies.STRATEGIES:
    _select(_p, 6_000)


def _kept_users(name: str, preset: Callable[..., DataFrame], sql: str | None = None) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        """The users' texts that the preset keeps of whole conversations (without SQL: literal walks in the tests)."""
        rows = conv(spark, sf_dir)
        return preset(rows, rows, 300).select("session_id", "ord", F.length("text").cast("long").alias("chars"))


_CUT = _ends_sql("text", "2 * kept", "2 * kept", "((strlen(text) - 4 * kept + 3) // 4)", 600)
_kept_users("retained_users", presets.retained_users, f"""WITH {CONV}, u AS (SELECT session_id, pos, text, price, coalesce(sum(price) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS newer FROM p WHERE role = 'user'),
g AS (SELECT *, least(price, 300 - newer)::BIGINT AS kept, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS ord FROM u WHERE newer < 300)
SELECT session_id, ord, length('[Retained user message ' || ord || ']' || chr(10) || CASE WHEN kept < price AND strlen(text) > 4 * kept THEN {_CUT} ELSE text END) AS chars FROM g""")
_kept_users("head_and_tail_users", presets.head_and_tail_users)


_WINDOW, _OUTPUT = 120_000, 8_192


def _sessions(rows: DataFrame) -> DataFrame:
    return rows.select("session_id").distinct().select("session_id", F.lit(_WINDOW).cast("long").alias("window"), F.lit(_OUTPUT).cast("long").alias("output"))


def _compact(preset: str, keep: int) -> None:
    log_sql = EXPECTED if preset == "calibrated" else LOG
    fires = ">" if preset == "split_turn" else ">="

    @query(f"compact_{preset}", f"""WITH chosen AS ({_SELECT_SQL[preset]}), b AS (SELECT {_WINDOW} AS w, {_OUTPUT} AS o), d AS (WITH {log_sql} SELECT session_id, sum(price) AS total FROM t GROUP BY session_id)
SELECT chosen.session_id, "rows", chosen.tokens AS old_tokens, 2::BIGINT AS tokens, 2 < chosen.tokens AS accepted FROM chosen JOIN d ON d.session_id = chosen.session_id, b WHERE total {fires} {_BUDGET_SQL[preset][0]}""")
    def run(spark, sf_dir):
        """The preset's whole plan with a model that always answers the same."""
        rows = log(spark, sf_dir).withColumn("json_len", F.col("price") * 4)
        rows = expected_only(rows) if preset == "calibrated" else rows
        return compaction.run(rows, _sessions(rows), preset, F.col("tokens"), keep, lambda prompt: "summary!")[1]


for _p in ("idle_headroom", "turn_tail", "split_turn", "image_guard", "round_keep", "calibrated"):
    _compact(_p, 6_000)


def _events(rows: DataFrame) -> DataFrame:
    """Who holds each session, of events that stand for begins and ends: calls and results of one id, requests and answers."""
    call, k = F.exists("blocks", lambda b: b["type"] == "tool-call"), F.col("k")
    return state.ownership(rows, call & (k % 4 == 1), (F.col("role") == "tool") & (k % 4 == 1), F.col("role") == "user", F.col("usage").isNotNull())


_OWNERS = """o0 AS (SELECT session_id, max(pos) FILTER (call_id = 'c1') AS b, max(pos) FILTER (result_id = 'c1') AS e, max(pos) FILTER (role = 'user') AS tb, max(pos) FILTER (has_usage) AS te FROM t GROUP BY session_id),
ow AS (SELECT session_id, coalesce(b, -1) > coalesce(e, -1) AS active, coalesce(tb, -1) > coalesce(te, -1) AS in_turn FROM o0)"""


@query("session_owners", f"""WITH {LOG}, {_OWNERS} SELECT session_id, active, in_turn, CASE WHEN active THEN 'active' WHEN NOT in_turn THEN 'no turn' END AS refused, CASE WHEN active THEN 'active' WHEN in_turn THEN 'in a turn' END AS by_hand FROM ow""")
def session_owners(spark, sf_dir):
    return _events(log(spark, sf_dir)).select("session_id", "active", "in_turn", state.refusal(False).alias("refused"), state.refusal(True).alias("by_hand"))


@query("own_strategy", f"""WITH {LOG}, {_OWNERS}, d AS (SELECT session_id, sum(price) AS total FROM t GROUP BY session_id HAVING sum(price) >= greatest(0, {_WINDOW} - 16384))
SELECT t.session_id, count(*) AS "rows", sum(price)::BIGINT AS old_tokens, 2::BIGINT AS tokens, 2 < sum(price) AS accepted FROM t JOIN d ON t.session_id = d.session_id JOIN ow ON t.session_id = ow.session_id WHERE role <> 'system' AND NOT active AND NOT in_turn GROUP BY t.session_id""")
def own_strategy(spark, sf_dir):
    """A strategy registered by its user, asked for by hand: sessions that are held or in a turn are left alone."""
    if "all_but_protected" not in strategies._REGISTRY:
        strategies.register_strategy("all_but_protected", lambda due, keep: due.where(~structure.protected()).select("session_id", "pos", "seq", "price"))
    rows = log(spark, sf_dir)
    return compaction.run(rows, _sessions(rows), "all_but_protected", F.col("tokens"), 0, lambda prompt: "summary!", owners=_events(rows), manual=True)[1]


@query("retried_requests", f"""WITH {LOG}, x AS (SELECT session_id, pos, kind = 'error' AS failed, lead(source_kind = 'compact-checkpoint') OVER (PARTITION BY session_id ORDER BY pos) AS nxt FROM t WHERE kind = 'error' OR source_kind = 'compact-checkpoint') SELECT session_id, pos, coalesce(nxt, false) AS retry FROM x WHERE failed""")
def retried_requests(spark, sf_dir):
    return state.retried(log(spark, sf_dir), F.col("is_error"), structure.checkpoint())


def _answer(prompt: str) -> str:
    if len(prompt) % 5 == 0:
        raise RuntimeError("refused")
    return "" if len(prompt) % 5 == 1 else f"{len(prompt)} characters"


@query("summarized_sessions", """WITH x AS (SELECT conv_id AS session_id, length(string_agg(CASE role WHEN 'user' THEN '[User]: ' ELSE '[Assistant]: ' END || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS n FROM conversations GROUP BY conv_id)
SELECT session_id, CASE WHEN n % 5 > 1 THEN n || ' characters' END AS summary, CASE n % 5 WHEN 0 THEN 'refused' WHEN 1 THEN 'empty summary' END AS error FROM x""")
def summarized_sessions(spark, sf_dir):
    """Requests, answers and failures of a model, here one that counts, refuses or says nothing."""
    rows = conv(spark, sf_dir)
    return logs.summarize(compaction.requests(rows, rows), _answer, 8_192)


def _busy(session: int, number: int, prompt: str) -> str:
    if number < session % 6:
        raise RuntimeError("overloaded" if session % 7 else "refused")
    return "" if session % 11 == 0 else f"{len(prompt)} characters"


@query("retried_summaries", """WITH x AS (SELECT conv_id AS session_id, length(string_agg(CASE role WHEN 'user' THEN '[User]: ' ELSE '[Assistant]: ' END || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS n FROM conversations GROUP BY conv_id),
y AS (SELECT *, session_id % 6 AS busy, CASE WHEN session_id % 6 > 0 AND session_id % 7 = 0 THEN 1 ELSE least(session_id % 6 + 1, 4) END AS asked FROM x)
SELECT session_id, asked::INTEGER AS asked, CASE WHEN busy >= asked OR session_id % 11 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN busy < asked AND session_id % 11 > 0 THEN n || ' characters' END AS summary,
       CASE WHEN busy >= asked THEN CASE WHEN session_id % 7 > 0 THEN 'overloaded' ELSE 'refused' END WHEN session_id % 11 = 0 THEN 'summary empty' END AS error FROM y""")
def retried_summaries(spark, sf_dir):
    """Requests in rounds: passing faults are waited out up to the fourth request, others end it."""
    units = retries.units_of(conv(spark, sf_dir), message_text("more", 2_000), "split_turn")
    return retries.summarize(retries.opened(units), _busy, "split_turn", base_ms=1)[0].select("session_id", "asked", "status", "summary", "error")


@query("compaction_verdicts")
def compaction_verdicts(spark, sf_dir):
    """The whole plan with the model-free checkpoint (checked by invariants in the tests)."""
    rows = log(spark, sf_dir)
    sessions = rows.select("session_id").distinct().select("session_id", F.lit(30_000).cast("long").alias("window"), F.lit(8_192).cast("long").alias("output"))
    return compaction.run(rows, sessions, "split_turn", F.col("tokens"), 6_000)[1]


@query("compacted_sessions")
def compacted_sessions(spark, sf_dir):
    rows = log(spark, sf_dir)
    sessions = rows.select("session_id").distinct().select("session_id", F.lit(30_000).cast("long").alias("window"), F.lit(8_192).cast("long").alias("output"))
    out = compaction.run(rows, sessions, "split_turn", F.col("tokens"), 6_000)[0]
    return out.groupBy("session_id").agg(F.count("*").alias("rows"), F.count_if(structure.checkpoint()).alias("checkpoints"), F.sum("price").alias("tokens"))


@query("basic_ranges", f"""WITH {LOG}, {CALLS}, a AS (SELECT *, row_number() OVER (PARTITION BY session_id, role = 'assistant' ORDER BY pos DESC) AS nth, lead(role) OVER (PARTITION BY session_id ORDER BY pos) AS nxt FROM c),
r AS (SELECT *, sum(CASE WHEN role = 'user' OR (role = 'assistant' AND nth <= 3) THEN price ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos) + 120 AS point, sum(price) OVER (PARTITION BY session_id ORDER BY pos) AS rng, bool_or(source_kind <> 'compact-checkpoint') OVER (PARTITION BY session_id ORDER BY pos) AS fresh FROM a)
SELECT session_id, coalesce(min(idx + 1) FILTER (open_after = 0 AND coalesce(nxt <> 'tool', true) AND fresh AND point < rng AND point + later <= 60000), max(n))::BIGINT AS cut, max(n) AS "rows" FROM r GROUP BY session_id""")
def basic_ranges(spark, sf_dir):
    return restoration.basic_range(log(spark, sf_dir), 60_000)


@query("reread_files", f"""WITH {LOG}, v AS (SELECT session_id, result_id, pos, seq, time_ms, is_error, kind || ' ' || k AS body FROM t WHERE result_id IS NOT NULL),
c AS (SELECT session_id, call_id, pos, path, pos >= 40 AS stays FROM t WHERE call_id IS NOT NULL AND tool = 'read_file'),
r AS (SELECT v.session_id, v.pos, v.time_ms, v.body, c.path, c.stays FROM v ASOF JOIN c ON c.session_id = v.session_id AND c.call_id = v.result_id AND c.pos < v.pos WHERE NOT is_error),
l AS (SELECT session_id, path, max_by(time_ms, pos) AS time_ms, max_by(body, pos) AS body, max_by(stays, pos) AS stays, min(pos) AS first_pos FROM r GROUP BY ALL),
n AS (SELECT session_id, path, row_number() OVER (PARTITION BY session_id ORDER BY time_ms DESC, first_pos) AS nth, (length(body) + 3) // 4 AS tokens, body FROM l WHERE NOT stays)
SELECT session_id, path, nth::INTEGER AS nth, tokens::BIGINT AS tokens, CASE WHEN tokens <= 2 AND sum(CASE WHEN tokens <= 2 THEN tokens ELSE 0 END) OVER (PARTITION BY session_id ORDER BY nth) <= 7 THEN body END AS text FROM n WHERE nth <= 5""")
def reread_files(spark, sf_dir):
    """Files read last before a checkpoint over the first 40 rows of each session; a text of above two tokens is only named."""
    rows = log(spark, sf_dir)
    return restoration.reread_files(rows, rows.where("pos < 40").select("session_id", "pos"), budget=7, file_tokens=2)


@query("restored_context")
def restored_context(spark, sf_dir):
    """State, skills and files of the first half of each session under one budget (its parts have SQL of their own)."""
    rows = log(spark, sf_dir)
    out = restoration.restore(rows, rows.where("pos < 30").select("session_id", "pos"), logs.files_from_documents(logs.table(spark, sf_dir, "documents")), budget=2_000, file_tokens=300)
    return out.select("session_id", "ord", "used", F.md5("text").alias("digest"))


# --- trials

_OUTCOMES = ("committed", "runtime-error", "skipped-no-benefit", "summary-truncated", "provider-error", "summary-invalid", "skipped-no-eligible-history", "pruned-only")
_CASES = """o AS (SELECT event_id, user_id, CASE event_id % 9 WHEN 0 THEN 'committed' WHEN 1 THEN 'runtime-error' WHEN 2 THEN 'skipped-no-benefit' WHEN 3 THEN 'summary-truncated' WHEN 4 THEN 'provider-error' WHEN 5 THEN 'summary-invalid' WHEN 6 THEN 'skipped-no-eligible-history' WHEN 7 THEN 'pruned-only' ELSE 'runtime-error' END AS outcome FROM events)"""


def _outcomes(spark, sf_dir):
    i = F.col("event_id") % 9
    yes, no = F.lit(True), F.lit(False)
    said = F.when(i == 1, "flush failed").when(i.isin(6, 7), "No compactable history").otherwise("done")
    reason = F.when(i == 2, "not smaller than the selected history").when(i == 3, "stopped at its output limit").when(i == 5, "an empty context summary").otherwise("unknown")
    column = trials.outcome(i == 0, i.isin(0, 6, 7), said, reason, no, no, i == 4, F.when(i == 7, yes).otherwise(no))
    return logs.table(spark, sf_dir, "events").select("event_id", "user_id", column.alias("outcome"))


@query("outcome_class", f"WITH {_CASES} SELECT event_id, user_id, outcome FROM o")
def outcome_class(spark, sf_dir):
    return _outcomes(spark, sf_dir)


@query("outcome_histogram", f"WITH {_CASES} SELECT user_id, {', '.join(f'''count(*) FILTER (outcome = '{o}') AS {o.replace('-', '_')}''' for o in _OUTCOMES)} FROM o GROUP BY user_id")
def outcome_histogram(spark, sf_dir):
    return trials.histogram(_outcomes(spark, sf_dir), ["user_id"], "outcome", list(_OUTCOMES))


@query("usage_by_field", f"WITH {LOG} SELECT session_id, coalesce(sum(u_input) FILTER (has_usage), 0)::BIGINT AS input_tokens, coalesce(sum(u_output) FILTER (has_usage), 0)::BIGINT AS output_tokens, coalesce(sum(u_cache) FILTER (has_usage), 0)::BIGINT AS cache_read_tokens, 0::BIGINT AS cache_write_tokens, count(*) FILTER (NOT has_usage) AS missing FROM t WHERE role = 'assistant' GROUP BY session_id")
def usage_by_field(spark, sf_dir):
    return trials.usage_totals(log(spark, sf_dir).where("role = 'assistant'"))


@query("repeated_reads", f"WITH {LOG}, r AS (SELECT session_id, row_number() OVER (PARTITION BY session_id, path, k ORDER BY pos) AS nth FROM t WHERE call_id IS NOT NULL) SELECT session_id, count(*) AS reads, count(*) FILTER (nth > 1) AS repeated FROM r GROUP BY session_id")
def repeated_reads(spark, sf_dir):
    rows = log(spark, sf_dir)
    calls = logs.calls_of(rows).join(rows.select("session_id", "pos", "k"), ["session_id", "pos"])
    return trials.repeated_reads(calls, ["session_id", "arguments", "k"], "pos")


@query("recall_scores", f"WITH {LOG} SELECT session_id, count(*) FILTER (k % 3 > 0) AS passed, count(*) AS total FROM t GROUP BY session_id")
def recall_scores(spark, sf_dir):
    return trials.recall_score(log(spark, sf_dir).withColumn("passed", F.col("k") % 3 > 0))


@query("reductions", f"WITH {LOG}, m AS (SELECT session_id, sum(price) AS b, sum(price) FILTER (pos >= 20) AS a FROM t GROUP BY session_id) SELECT session_id, round(100.0::DOUBLE * (1 - a::DOUBLE / b), 1) AS percent FROM m")
def reductions(spark, sf_dir):
    m = log(spark, sf_dir).groupBy("session_id").agg(F.sum("price").alias("b"), F.sum(F.when(F.col("pos") >= 20, F.col("price"))).alias("a"))
    return m.select("session_id", trials.reduction_percent(F.col("b"), F.col("a")).alias("percent"))


_PHASES = "ph AS (SELECT user_id AS trial, n AS phase, (user_id + n) % 11 > 0 AS changed, (user_id + n) % 13 > 0 AS tested, 10 AS total, CASE WHEN user_id % 6 = 0 THEN 9 ELSE 10 END AS passed, n <= 3 AND user_id % 8 > 0 AS replayed FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(1, 6))::BIGINT AS n) WHERE n <= 5 - (user_id % 10 = 9)::BIGINT)"
_COMPS = "cm AS (SELECT user_id AS trial, n AS after_phase, CASE WHEN (user_id + n) % 5 = 0 THEN 'runtime-error' ELSE 'committed' END AS outcome FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest([1, 2, 3])::BIGINT AS n))"


@query("trial_scores", f"""WITH {_PHASES}, {_COMPS}, p AS (SELECT trial, count(*) AS phases, bool_and(changed AND tested) AS worked, max_by(passed = total, phase) AS accepted, count(*) FILTER (replayed) AS replays FROM ph GROUP BY trial),
d AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY after_phase) AS nth FROM cm WHERE outcome = 'committed'), c AS (SELECT trial, count(*) AS committed, max(after_phase) FILTER (nth = 3) AS third FROM d GROUP BY trial),
a AS (SELECT DISTINCT ph.trial FROM ph JOIN c ON c.trial = ph.trial WHERE changed AND phase > third),
r AS (SELECT p.*, coalesce(committed, 0) AS committed, a.trial IS NOT NULL AS continued, p.trial % 7 = 0 AS baseline, p.trial % 17 = 0 AS failed FROM p LEFT JOIN c ON c.trial = p.trial LEFT JOIN a ON a.trial = p.trial),
s AS (SELECT *, CASE WHEN phases < 5 THEN 'not-completed' WHEN accepted AND worked THEN 'passed' ELSE 'failed' END AS task_status, NOT baseline AND committed <> 3 AS short FROM r)
SELECT trial, task_status, CASE WHEN baseline THEN 'not-applicable' WHEN short THEN 'incomplete' ELSE 'complete' END AS compaction_status, committed::BIGINT AS committed, continued,
 CASE WHEN failed THEN 'runtime-error' WHEN task_status <> 'passed' THEN 'task-failed' WHEN short OR replays <> 3 OR (NOT baseline AND NOT continued) THEN 'compaction-incomplete' ELSE 'passed' END AS status FROM s""")
def trial_scores(spark, sf_dir):
    users = logs.table(spark, sf_dir, "events").select(F.col("user_id").alias("trial")).distinct()
    t, n = F.col("trial"), F.col("phase")
    phases = users.withColumn("phase", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long")))).where(n <= F.lit(5) - (t % 10 == 9).cast("int"))
    phases = phases.select("trial", "phase", ((t + n) % 11 > 0).alias("changed"), ((t + n) % 13 > 0).alias("tested"), F.when(t % 6 == 0, 9).otherwise(10).alias("passed"), F.lit(10).alias("total"), ((n <= 3) & (t % 8 > 0)).alias("replayed"))
    comps = users.withColumn("after_phase", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long")))).withColumn("outcome", F.when((t + F.col("after_phase")) % 5 == 0, "runtime-error").otherwise("committed"))
    meta = users.select("trial", (t % 7 == 0).alias("baseline"), F.lit(5).alias("planned"), F.lit(3).alias("needed"), (t % 17 == 0).alias("failed"))
    return trials.trial_scores(phases, comps, meta)
