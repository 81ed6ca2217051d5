"""Queries of completion logs, call audits, token reports, sources and streams, with their SQL.

The given tables hold no completions; they are made from ``events``, one for each event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim_result
from ..functions.toolcalls import native_calls
from ..operators import audit, completions, embedding, evaluation, history, search, telemetry, textsearch, tokens, vector_index
from ..operators.caching import TableCache
from ..sources import files
from ..sources.shared import shared_path
from ..streaming import rollups
from .registry import _AFTER, _RANKED, _TOKENS, _TRACE, _TURNS, _USED, BUDGET, KEEP, chunks_sql, query, table, trace_of

#: A completion's text by its event: clean JSON, a fence with a comma too many, an open brace, a Python literal, prose, junk.
_RAW1 = """'{"tool": "' || event_type || '", "args": ' || props || ',}'"""
_RAW2 = """'{"name": "' || event_type || '", "arguments": {"path": "../u' || user_id || '"}'"""
_TEXT = f"""CASE event_id % 6
WHEN 0 THEN '{{"name": "' || event_type || '", "arguments": ' || props || '}}'
WHEN 1 THEN 'Looking.' || chr(10) || '```json' || chr(10) || {_RAW1} || chr(10) || '```'
WHEN 2 THEN 'I' || chr(39) || 'll try ' || {_RAW2}
WHEN 3 THEN '{{' || chr(39) || 'name' || chr(39) || ': ' || chr(39) || event_type || chr(39) || ', ' || chr(39) || 'arguments' || chr(39) || ': {{' || chr(39) || 'k' || chr(39) || ': True}}}}'
WHEN 4 THEN 'plain answer ' || event_id
ELSE '{{"name": broken ' || event_id || '}}' END"""
_MODEL = "'m' || event_id % 3"
_C = f"WITH c AS (SELECT *, event_id % 6 AS kind, {_TEXT} AS text, {_MODEL} AS model FROM events)"
_REPAIRS = "CASE kind WHEN 1 THEN 'fenced,trailing_comma,name_key:tool,arg_key:args' WHEN 2 THEN 'unclosed_braces' WHEN 3 THEN 'python_literal' ELSE '' END"
_K = "CASE WHEN kind < 2 THEN json_extract_string(props, '$.k') WHEN kind = 3 THEN 'true' END"


def _completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(_MODEL).alias("model"), F.expr(_TEXT).alias("text"))
    return completions.parsed(own)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _completions(spark, sf_dir).select("event_id", "model", F.explode("parsed.calls").alias("c"))
    return each.select(F.col("event_id").alias("call_id"), "model", "c.name", "c.arguments")


@query(f"{_C} SELECT event_id, CAST(kind < 4 AS INTEGER) AS n_calls, CASE WHEN kind < 4 THEN event_type END AS name, {_K} AS k, {_REPAIRS} AS repairs, CAST(kind = 5 AS INTEGER) AS n_problems, CASE kind WHEN 1 THEN 'Looking.' WHEN 2 THEN 'I''ll try' ELSE '' END AS prose_before FROM c")
def p1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get(F.col("parsed.calls"), F.lit(0))
    repairs = F.array_join(F.flatten(F.transform("parsed.calls", lambda c: c["repairs"])), ",")
    return _completions(spark, sf_dir).select("event_id", F.size("parsed.calls").alias("n_calls"), first["name"].alias("name"), F.get_json_object(first["arguments"], "$.k").alias("k"), repairs.alias("repairs"), F.size("parsed.problems").alias("n_problems"), "parsed.prose_before")


@query("SELECT event_id, event_type AS name, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 2 = 1 THEN 'go' END AS bare, 'id' || event_id AS id FROM events")
def p2_native_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = """'[{"id": "id' || event_id || '", "function": {"name": "' || event_type || '", "arguments": ' || CASE WHEN event_id % 2 = 0 THEN props ELSE '"go"' END || '}}]'"""
    each = table(spark, sf_dir, "events").select("event_id", F.explode(native_calls(F.expr(raw))).alias("c"))
    return each.select("event_id", "c.name", F.get_json_object("c.arguments", "$.k").alias("k"), F.get_json_object("c.arguments", "$.__positional__").alias("bare"), "c.id")


@query(f"{_C} SELECT count(*) AS completions, count(*) FILTER (WHERE kind < 4) AS with_calls, count(*) FILTER (WHERE kind IN (1, 2, 3)) AS repaired, count(*) FILTER (WHERE kind < 4) AS calls_found, count(*) FILTER (WHERE kind = 5) AS unparseable, round(100.0 * count(*) FILTER (WHERE kind IN (1, 2, 3)) / greatest(count(*) FILTER (WHERE kind < 4), 1), 1) AS repair_pct FROM c")
def p3_parse_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completions.parse_stats(_completions(spark, sf_dir))


@query(f"{_C} SELECT kind, count(*) AS n FROM (SELECT unnest(string_split({_REPAIRS}, ',')) AS kind FROM c WHERE kind IN (1, 2, 3)) GROUP BY kind")
def p3_repair_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completions.repair_kinds(_completions(spark, sf_dir))


@query(f"{_C} SELECT model, count(*) AS completions, count(*) FILTER (WHERE kind < 4) AS with_calls, count(*) FILTER (WHERE kind IN (1, 2, 3)) AS repaired, count(*) FILTER (WHERE kind < 4) AS calls_found, count(*) FILTER (WHERE kind = 5) AS unparseable, round(100.0 * count(*) FILTER (WHERE kind IN (1, 2, 3)) / greatest(count(*) FILTER (WHERE kind < 4), 1), 1) AS repair_pct FROM c GROUP BY model")
def p4_repair_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completions.parse_stats(_completions(spark, sf_dir), "model")


@query(f"{_C} SELECT event_id, CASE kind WHEN 1 THEN 'Looking.' || chr(10) || {_RAW1} WHEN 2 THEN 'I''ll try' || chr(10) || {_RAW2} ELSE text END AS recorded, CASE WHEN kind = 3 THEN '[calling ' || event_type || '(k=True)]' WHEN kind < 2 THEN '[calling ' || event_type || '(k=' || json_extract_string(props, '$.k') || ')]' WHEN kind = 2 THEN '[calling ' || event_type || '(path=''../u' || user_id || ''')]' ELSE '' END AS call_line FROM c")
def p5_history_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completions.history_text(_completions(spark, sf_dir)).select("event_id", "recorded", "call_line")


_STEPS = """WITH s AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, event_id % 5 > 0 AND event_id % 3 < 2 AS called, event_id % 5 > 0 AND event_id % 3 = 2 AS bad FROM events),
i AS (SELECT *, sum(called::INT) OVER (PARTITION BY run_id ORDER BY step) AS island FROM s WHERE step <= 15),
k AS (SELECT *, sum((NOT called)::INT) OVER (PARTITION BY run_id, island ORDER BY step) AS streak FROM i),
e AS (SELECT *, CASE WHEN NOT called AND NOT bad THEN 'answered' WHEN streak > 2 THEN 'parse_retries_exhausted' WHEN step = 15 THEN 'exhausted' END AS outcome FROM k),
f AS (SELECT run_id, min(step) AS stop FROM e WHERE outcome IS NOT NULL GROUP BY run_id),
o AS (SELECT e.run_id, coalesce(max(outcome) FILTER (WHERE step = stop), 'unfinished') AS outcome, count(*) AS iterations, CAST(sum(called::INT) AS BIGINT) AS tool_calls FROM e LEFT JOIN f USING (run_id) WHERE stop IS NULL OR step <= stop GROUP BY e.run_id)"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), number.alias("step"), F.expr("CAST(event_id % 5 > 0 AND event_id % 3 < 2 AS INT)").alias("n_calls"), F.expr("CAST(event_id % 5 > 0 AND event_id % 3 = 2 AS INT)").alias("n_problems"))
    return completions.run_outcomes(own)


@query(f"{_STEPS} SELECT * FROM o")
def p7_run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir)


@query(f"{_STEPS} SELECT run_id % 3 AS policy, count(*) FILTER (WHERE outcome = 'answered') AS done, count(*) FILTER (WHERE outcome <> 'answered') AS failed, round(avg(CASE WHEN outcome = 'answered' THEN iterations ELSE 15 END), 4) AS avg_iterations, CAST(sum(tool_calls) AS BIGINT) AS tool_calls FROM o GROUP BY run_id % 3")
def p6_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completions.compare_policies(_outcomes(spark, sf_dir).withColumn("policy", F.col("run_id") % 3))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("CASE event_type WHEN 'view' THEN 'views' ELSE event_type END").alias("name")
    return table(spark, sf_dir, "events").select(name).distinct().select("name", F.array(F.lit("k")).alias("required"), F.expr("CASE name WHEN 'purchase' THEN 'ask' ELSE 'allow' END").alias("default_policy"))


@query(f"""{_C}, n AS (SELECT string_agg(DISTINCT CASE event_type WHEN 'view' THEN 'views' ELSE event_type END, ', ' ORDER BY CASE event_type WHEN 'view' THEN 'views' ELSE event_type END) AS names FROM events)
SELECT event_id AS call_id, event_type AS name, CASE WHEN event_type = 'view' THEN 'no tool named ''view''. Did you mean ''views''? Available: ' || names WHEN kind = 2 THEN 'invalid arguments -- missing required: k' END AS error FROM c, n WHERE kind < 4""")
def a1_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.resolve(_calls(spark, sf_dir), _catalog(spark, sf_dir)).select("call_id", "name", "error")


_DECIDED = f"""{_C}, d AS (SELECT event_id AS call_id, model, event_type AS name, CASE event_type WHEN 'click' THEN 'deny' WHEN 'purchase' THEN 'ask' WHEN 'view' THEN 'ask' ELSE 'allow' END AS policy FROM c WHERE kind < 4),
a AS (SELECT *, CASE policy WHEN 'allow' THEN true WHEN 'deny' THEN false ELSE call_id % 2 = 0 END AS allowed FROM d)"""


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    overrides = spark.createDataFrame([("click", "deny")], "name string, override string")
    answers = table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), (F.col("event_id") % 2 == 0).alias("approved"))
    return audit.decide(_calls(spark, sf_dir).drop("arguments"), _catalog(spark, sf_dir), overrides, answers)


@query(f"{_DECIDED} SELECT * FROM a")
def a4_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir)


_OUTSIDE = "concat(CASE event_id % 5 WHEN 0 THEN 'write_' WHEN 1 THEN 'get_' WHEN 2 THEN 'Delete_' WHEN 3 THEN 'output_' ELSE 'x' END, event_type)"


@query(f"""WITH n AS (SELECT event_id AS call_id, {_OUTSIDE} AS name, auto FROM events, (VALUES (TRUE), (FALSE)) t(auto)),
p AS (SELECT *, CASE WHEN name = 'get_click' THEN 'deny' WHEN regexp_matches(lower(name), '{audit.MUTATING}') THEN 'ask' ELSE 'allow' END AS own FROM n)
SELECT call_id, name, auto, CASE WHEN own = 'ask' AND auto THEN 'auto' ELSE own END AS policy, own = 'allow' OR (own = 'ask' AND auto) AS allowed FROM p""")
def a4_outside_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools from outside, asked about where their name says that they change things; with and without approving by itself."""
    calls = table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.expr(_OUTSIDE).alias("name"))
    catalog = calls.select("name").distinct().select("name", audit.external_policy(F.col("name"), F.lit("allow")).alias("default_policy"))
    overrides = spark.createDataFrame([("get_click", "deny")], "name string, override string")
    both = [audit.decide(calls, catalog, overrides, auto_approve=auto).withColumn("auto", F.lit(auto)) for auto in (True, False)]
    return both[0].unionByName(both[1])


@query(f"{_DECIDED} SELECT model, count(*) AS checks, count(*) FILTER (WHERE NOT allowed) AS denied, string_agg(DISTINCT name, ',' ORDER BY name) FILTER (WHERE NOT allowed) AS denied_tools FROM a GROUP BY model")
def a5_audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_summary(_decisions(spark, sf_dir), "model").withColumn("denied_tools", F.array_join("denied_tools", ","))


ROOT = "/work/root"
#: Parts of made-up paths; which ones an event's path has, and how many, the digest of its columns says.
_PICKS = ("'..'", "'.'", "''", "'src'", "event_type", "'.git'", "'config'", "'id_rsa'", "'B.PEM'", "'a%2Fb'", "concat('p', user_id)", "'work'", "'root'", "'.env'", "'deep'", "event_type")
_HEX = "'0123456789abcdef'"
_DIGEST = "md5(concat(event_id, event_type, user_id, props))"


def _path_of(at: int) -> str:
    """A path from the eight hexadecimal digits at ``at``: how it begins, how many parts it has, which (for Spark)."""
    digit = lambda i: f"instr({_HEX}, substr(h, {i}, 1))"
    parts = f"transform(sequence(1, {digit(at)} % 5 + 1), i -> element_at(array({', '.join(_PICKS)}), {digit(f'{at + 1} + i')}))"
    return f"concat(CASE {digit(at + 1)} % 4 WHEN 0 THEN '/' WHEN 1 THEN '{ROOT}/' ELSE '' END, array_join({parts}, '/'))"


def _path_sql(at: int) -> str:
    digit = lambda i: f"instr({_HEX}, h[{i}])"
    parts = f"list_transform(range(1, {digit(at)} % 5 + 2), lambda i: [{', '.join(_PICKS)}][{digit(f'{at + 1} + i')}])"
    return f"CASE {digit(at + 1)} % 4 WHEN 0 THEN '/' WHEN 1 THEN '{ROOT}/' ELSE '' END || array_to_string({parts}, '/')"


def _problem_sql(path: str) -> str:
    whole = f"CASE WHEN starts_with({path}, '/') THEN {path} ELSE '{ROOT}/' || {path} END"
    parts = f"list_reduce([[]::VARCHAR[]] || list_transform(string_split({whole}, '/'), lambda x: [x]), lambda a, x: CASE WHEN x[1] IN ('', '.') THEN a WHEN x[1] = '..' THEN a[: len(a) - 1] ELSE a || x END)"
    names = ", ".join(f"'{n}'" for n in audit.SECRET_NAMES)
    suffix = " OR ".join(f"ends_with(lower(p[-1]), '{x}')" for x in audit.SECRET_SUFFIXES)
    coded = " OR ".join(f"contains(lower({path}), '{x}')" for x in audit.ENCODED if x.isprintable())
    return f"""(SELECT CASE WHEN trim({path}) = '' THEN 'empty' WHEN {coded} THEN 'encoded' WHEN NOT coalesce(p[1] = 'work' AND p[2] = 'root', FALSE) THEN 'escape'
WHEN lower(p[-1]) IN ({names}) OR {suffix} OR (list_contains(p, '.git') AND p[-1] = 'config') THEN 'credential' END FROM (SELECT {parts} AS p))"""


_PATHS = f"WITH e AS (SELECT *, {_DIGEST} AS h FROM events), p AS (SELECT *, {_path_sql(1)} AS a, {_path_sql(9)} AS b FROM e), j AS (SELECT *, {_problem_sql('a')} AS pa, {_problem_sql('b')} AS pb FROM p)"


def _pathed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with two paths ``a`` and ``b`` made from their columns."""
    return table(spark, sf_dir, "events").withColumn("h", F.expr(_DIGEST)).withColumns({"a": F.expr(_path_of(1)), "b": F.expr(_path_of(9))})


@query(f"{_PATHS} SELECT event_id, a AS path, pa AS problem FROM j")
def a6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pathed(spark, sf_dir).select("event_id", F.col("a").alias("path"), audit.path_problem(F.col("a"), ROOT).alias("problem"))


_SHAPED = "(contains({0}, '/') OR contains({0}, '..'))"


@query(f"""{_PATHS} SELECT event_id, concat_ws(',', CASE WHEN {_SHAPED.format("a")} THEN pa END, CASE WHEN {_SHAPED.format("b")} THEN pb END) AS refused FROM j""")
def a7_argument_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two paths of each event, one behind a flag in a list, one in a nested object."""
    one = lambda c, *names: F.struct(c.alias(names[0])) if names else c
    arguments = F.to_json(F.struct(F.array(F.concat(F.lit("--output="), "a")).alias("o"), one(F.col("b"), "p").alias("n"), F.lit("--color=auto").alias("c"), F.col("event_type").alias("t")))
    done = audit.confine(_pathed(spark, sf_dir).select("event_id", arguments.alias("arguments")), ROOT)
    return done.select("event_id", F.array_join("refused.problem", ",").alias("refused"))


#: Programs and first arguments of made-up commands.
_PROGRAMS = ("ls", "cat", "/usr/bin/git", "git", "python", "grep", "rm", "find")
_FIRST = ("-l", "status", "push", "-exec", "a|b", "log", "-n3", "-c=x", "$(x)", "diff", "x.txt", "commit", "--stat", "blame", "-ok", "remote")


@query(f"""{_PATHS}, c AS (SELECT *, [{', '.join(f"'{x}'" for x in _PROGRAMS)}][instr({_HEX}, h[17]) % 8 + 1] AS program, [{', '.join(f"'{x}'" for x in _FIRST)}][instr({_HEX}, h[18])] AS first, instr({_HEX}, h[19]) AS kind FROM j)
SELECT event_id, CASE WHEN kind = 1 THEN 'empty' WHEN kind = 2 THEN 'quoting' WHEN regexp_matches(first, '{audit.SHELL}') THEN 'shell'
WHEN regexp_extract(program, '[^/]+$') NOT IN ({', '.join(f"'{x}'" for x in audit.PROGRAMS)}) THEN 'program'
WHEN string_split(first, '=')[1] IN ({', '.join(f"'{x}'" for x in audit.BANNED_FLAGS)}) THEN 'flag'
WHEN {_SHAPED.format('a')} AND pa IS NOT NULL THEN pa
WHEN regexp_extract(program, '[^/]+$') = 'git' AND coalesce(CASE WHEN starts_with(first, '-') THEN a ELSE first END, '') NOT IN ({', '.join(f"'{x}'" for x in audit.GIT_READS)}) THEN 'git' END AS refusal FROM c""")
def a8_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program, an argument and a path for each event; some commands are blank, some have an open quote."""
    digit = lambda i: F.expr(f"instr({_HEX}, substr(h, {i}, 1))")
    program = F.element_at(F.array(*map(F.lit, _PROGRAMS)), digit(17) % 8 + 1)
    line = F.concat_ws(" ", program, F.element_at(F.array(*map(F.lit, _FIRST)), digit(18)), "a")
    command = F.when(digit(19) == 1, F.lit(" ")).when(digit(19) == 2, F.concat(F.lit('ls "'), line)).otherwise(line)
    return audit.audit_commands(_pathed(spark, sf_dir).select("event_id", command.alias("command")), ROOT).select("event_id", "refusal")


_DROPPED = f"""{_USED}, {_TURNS}, o AS (SELECT conv_id FROM u WHERE tokens > {int(BUDGET * 0.85)}),
d AS (SELECT conv_id, turn, role, text FROM (SELECT *, max(turn_no) OVER (PARTITION BY conv_id) AS last FROM t) WHERE turn_no <= last - {KEEP} AND conv_id IN (SELECT conv_id FROM o))"""


@query(f"""{_DROPPED}, m AS (SELECT conv_id, CASE WHEN role = 'system' THEN 0 ELSE 2 END AS k, turn, role, text FROM conversations WHERE (conv_id, turn) NOT IN (SELECT conv_id, turn FROM d)
UNION ALL SELECT conv_id, 1, -1, 'user', '[Summary of ' || count(*) || ' earlier messages, which have been dropped to stay within the context window:]' || chr(10) || chr(10) || 's' || length(string_agg(role || ': ' || text[:1500], chr(10))) FROM d GROUP BY conv_id)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY k, turn) - 1 AS INTEGER) AS pos, role, text FROM m""")
def h6_summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.summarize(table(spark, sf_dir, "conversations"), BUDGET, KEEP, lambda t: f"s{len(t)}")


@query(_AFTER + f""", g AS (SELECT d.conv_id, '[Summary of ' || count(*) || ' earlier messages, which have been dropped to stay within the context window:]' || chr(10) || chr(10) || 's' || length(string_agg(role || ': ' || text[:1500], chr(10))) AS text FROM d JOIN conversations USING (conv_id, turn) GROUP BY d.conv_id),
s AS (SELECT conv_id, text FROM conversations WHERE (conv_id, turn) NOT IN (SELECT conv_id, turn FROM d) UNION ALL SELECT conv_id, text FROM g),
x AS (SELECT conv_id, 'truncate' AS strategy, * EXCLUDE (conv_id) FROM k UNION ALL SELECT conv_id, 'summarize', * EXCLUDE (conv_id) FROM s),
y AS (SELECT conv_id, strategy, CAST(sum({_TOKENS.format(t='text')} + 10) AS BIGINT) AS after, count(*) AS n_messages FROM x GROUP BY conv_id, strategy)
SELECT conv_id, strategy, tokens AS before, after, tokens - after AS saved, n_messages FROM y JOIN u USING (conv_id)""")
def h7_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.compare_strategies(table(spark, sf_dir, "conversations"), BUDGET, KEEP, lambda t: f"s{len(t)}")


@query("SELECT doc_id, CASE WHEN length(text) > 401 THEN text[:200] || chr(10) || chr(10) || '... [' || (length(text) - 401) || ' characters trimmed to fit the context window. Full output saved to .spill/' || source || '_' || doc_id || '.txt -- read_file it if you need the middle.] ...' || chr(10) || chr(10) || right(text, 201) ELSE text END AS content FROM documents")
def h8_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", trim_result(F.col("text"), files.spill_path(F.col("source"), F.col("doc_id").cast("string")), 401).alias("content"))


@query("SELECT '.spill/' || source || '_' || doc_id || '.txt' AS spill_path, text AS content FROM documents WHERE length(text) > 4000")
def s6_spilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.spilled(table(spark, sf_dir, "documents").select(F.col("source").alias("name"), F.col("doc_id").cast("string").alias("call_id"), F.col("text").alias("content")))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text AS content FROM conversations")
def s2_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    return files.messages_of(files.conversation_json(own)).select("conv_id", "turn", "role", "content")


@query("""WITH m AS (SELECT user_id AS conv_id, event_id AS turn, event_id % 3 AS r, event_id // 9 AS call FROM events),
w AS (SELECT *, last_value(CASE WHEN r = 0 THEN call END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open FROM m)
SELECT conv_id, turn, CAST(call AS VARCHAR) AS tool_call_id FROM w WHERE r = 1 AND (open IS NULL OR open <> call)""")
def h10_unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = F.floor(F.col("event_id") / 9).cast("string")
    kind = F.col("event_id") % 3
    role = F.when(kind == 0, "assistant").when(kind == 1, "tool").otherwise("user")
    made = F.when(kind == 0, F.array(F.struct(call.alias("id"))))
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), role.alias("role"), F.when(kind == 1, call).alias("tool_call_id"), made.alias("tool_calls"))
    return history.unpaired_results(own).select("conv_id", "turn", "tool_call_id")


@query("SELECT event_id AS step, event_type AS name, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN (repeat('e', 190) || props || props)[:200] END AS error FROM events")
def m1_step_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = F.struct(F.col("event_type").alias("name"), F.col("value").alias("duration_ms"), (F.col("event_type") != "error").alias("ok"), F.concat(F.repeat(F.lit("e"), 190), "props", "props").alias("content"))
    none = F.lit(False)
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.col("value").alias("model_ms"), F.col("value").alias("elapsed_s"), F.lit(1).alias("prompt_tokens"), F.lit(1).alias("completion_tokens"), none.alias("compacted"), none.alias("repaired"), F.array(result).alias("results"))
    return telemetry.step_records(own).select("step", F.inline("tools")).select("step", "name", "ok", "error")


@query(_TRACE + " SELECT run_id, count(*) AS iterations, count(*) AS tool_calls, round(count(*) FILTER (WHERE event_id % 5 = 0) / count(*), 6) AS repair_rate, CAST(sum(event_id % 100) AS BIGINT) AS prompt_tokens FROM e GROUP BY run_id")
def m4_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.run_metrics(trace_of(table(spark, sf_dir, "events")))


@query(_TRACE + """, r AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS f, count(*) FILTER (WHERE event_id % 5 = 0) AS p, count(*) FILTER (WHERE event_id % 11 = 0) AS c, sum(event_id % 100)::BIGINT AS i, sum(event_id % 7)::BIGINT AS o, ((2 * CAST(sum(CAST(value AS DECIMAL(20,6))) * 1000000 AS HUGEINT) + 100000) // 200000 + 500) // 1000 AS s FROM e GROUP BY run_id)
SELECT run_id, 'trace ' || run_id || ': ' || n || ' steps, ' || n || ' tool calls' || CASE WHEN f > 0 THEN ', ' || f || ' failed' ELSE '' END || CASE WHEN p > 0 THEN ', ' || p || ' repaired' ELSE '' END || CASE WHEN c > 0 THEN ', ' || c || ' compactions' ELSE '' END || ', ' || i || '+' || o || ' tokens, model ' || s // 10 || '.' || s % 10 || 's' AS line FROM r""")
def m5_summary_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.summary_line(telemetry.run_rollup(trace_of(table(spark, sf_dir, "events"))))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x00-\x20]')) AS tokens, text IN (SELECT text FROM documents WHERE doc_id % 3 = 0) AS cached FROM documents""")
def t4_exact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one cache: a third of the documents, then all; only texts that the first has not seen are counted again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = TableCache(spark, shared_path(spark, "counts"), "tokens BIGINT")
    tokens.exact_counts(docs.where("doc_id % 3 = 0"), tokens.word_tokens, cache)
    return tokens.exact_counts(docs, tokens.word_tokens, cache).select("doc_id", "tokens", "cached")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("label"), "text", F.expr("greatest(1, length(text) * (1 + doc_id % 4) DIV 8)").alias("real"))


_SAMPLES = "WITH s AS (SELECT doc_id AS label, text, greatest(1, length(text) * (1 + doc_id % 4) // 8) AS real FROM documents WHERE text IS NOT NULL)"


@query(_SAMPLES + """, c AS (SELECT length(text) / real AS r, len(regexp_extract_all(text, '[{}\\[\\]":,\\\\]')) / greatest(length(text), 1) >= 0.05 AS dense FROM s) SELECT dense, count(*) AS n, round(avg(r), 4) AS chars_per_token FROM c GROUP BY dense""")
def t5_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.calibration_means(_samples(spark, sf_dir).where("text is not null"))


@query(f"{_SAMPLES}, e AS (SELECT label, real, {_TOKENS.format(t='text')} AS estimate FROM s) SELECT label, CAST(estimate AS BIGINT) AS estimate FROM e WHERE estimate < real OR estimate > 2 * real")
def t6_out_of_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.out_of_bounds(_samples(spark, sf_dir)).select("label", "estimate")


_ASCII = "regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+')"


def _counted(rows: str, keys: str, text: str, dims: int) -> str:
    """``keys, b, n``: the signed counts of the words of ``text``, as the counting embedder has them."""
    words = _ASCII.format(text=text)
    return f"""SELECT {keys}, b, sum(s) AS n FROM (SELECT {keys}, CAST('0x' || left(md5(word), 7) AS BIGINT) % {dims} AS b, CASE WHEN md5(word)[8] < '8' THEN 1 ELSE -1 END AS s
FROM (SELECT {keys}, unnest({words}) AS word FROM {rows}) WHERE word <> '') GROUP BY ALL"""


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), v AS ({_counted("d", "doc_id", "'search_document: ' || t", 16)}),
f AS (SELECT x.doc_id, string_agg(CAST(coalesce(n, 0) AS BIGINT), ',' ORDER BY i) AS vector FROM (SELECT doc_id, unnest(range(16)) AS i FROM d) x LEFT JOIN v ON v.doc_id = x.doc_id AND v.b = x.i GROUP BY x.doc_id)
SELECT doc_id, sha1('counts16' || chr(0) || 'search_document: ' || t) AS key, t IN (SELECT t FROM d WHERE doc_id % 2 = 0) AS cached, vector FROM d JOIN f USING (doc_id)""")
def e2_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one cache: every second document, then all; the second run embeds only what the first has not."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache, embedder = TableCache(spark, shared_path(spark, "vectors"), "vector ARRAY<FLOAT>"), embedding.counting_embedder(16)
    embedding.embed(docs.where("doc_id % 2 = 0"), embedder, "counts16", cache=cache)
    done = embedding.embed(docs, embedder, "counts16", cache=cache)
    return done.select("doc_id", "key", "cached", F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors, vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")


@query()
def v4_approximate_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_index.approximate_top_k(*_vectors(spark, sf_dir))


_EXACT = _RANKED.format(where="") + ", t AS (SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k})"


@query(_EXACT.format(k=10) + " SELECT query_id, count(*) AS wanted, string_agg(vec_id, ',' ORDER BY rank) AS ids, TRUE AS reached FROM t GROUP BY query_id")
def v4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten exact neighbours of each query, and whether the index finds nine tenths of all of them."""
    vectors, asked = _vectors(spark, sf_dir)
    exact = search.top_k(vectors, asked, k=10)
    all_ids = exact.groupBy("query_id").agg(F.count("*").alias("wanted"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"].cast("string")), ",").alias("ids"))
    total = evaluation.recall(exact, vector_index.approximate_top_k(vectors, asked, k=10)).where("query_id is null").select((F.col("recall") >= 0.9).alias("reached"))
    return all_ids.join(F.broadcast(total))  # one row


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question for every twentieth document: its first words, answered where a later passage is."""
    return table(spark, sf_dir, "documents").where("doc_id % 20 = 0 and text is not null").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 100).alias("question"), F.array(F.col("doc_id").cast("string")).alias("sources"), F.trim(F.substring("text", 120, 24)).alias("marker"))


@query("""WITH q AS (SELECT doc_id AS query_id, doc_id AS source, lower(trim(text[120:143])) AS m FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL)
SELECT q.query_id, CAST(d.doc_id AS VARCHAR) AS chunk_id FROM q JOIN documents d ON d.doc_id = q.source WHERE contains(lower(d.text), q.m)""")
def r1_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("doc_id").cast("string")
    chunks = table(spark, sf_dir, "documents").select(own.alias("chunk_id"), own.alias("source"), "text")
    return evaluation.relevant_chunks(chunks, _asked(spark, sf_dir)).select("query_id", "chunk_id")


def _ablation(cases: list[tuple[str, int, str, str]]) -> str:
    """Metrics of each case (name, chunk size, the documents' and the questions' prefix) as SQL."""
    sizes = sorted({size for _, size, _, _ in cases})
    every = " UNION ALL ".join(f"SELECT {size} AS size, * FROM (WITH {chunks_sql(size, size // 6)} SELECT source, source || '#' || index AS chunk_id, text FROM chunks)" for size in sizes)
    rows = ", ".join(f"('{name}', {i}, {size}, '{own}', '{asked}')" for i, (name, size, own, asked) in enumerate(cases))
    return f"""WITH cases(variant, position, size, own, asked) AS (VALUES {rows}), pieces AS ({every}),
q AS (SELECT doc_id AS query_id, CAST(doc_id AS VARCHAR) AS source, text[:100] AS question, lower(trim(text[120:143])) AS m FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL),
c AS (SELECT position, chunk_id, pieces.source, text, CAST('0x' || left(md5({{key}}), 15) AS BIGINT) AS vec_id, own || '[' || pieces.source || ']' || chr(10) || text AS context FROM pieces JOIN cases USING (size)),
a AS (SELECT position, query_id, source, m, asked || question AS context FROM q, cases),
cv AS ({_counted("c", "position, vec_id", "context", 64)}), av AS ({_counted("a", "position, query_id", "context", 64)}),
cn AS (SELECT position, vec_id, sqrt(sum(n * n)) AS size FROM cv GROUP BY ALL), an AS (SELECT position, query_id, sqrt(sum(n * n)) AS size FROM av GROUP BY ALL),
dots AS (SELECT position, query_id, vec_id, sum(av.n * cv.n) AS dot FROM av JOIN cv USING (position, b) GROUP BY ALL),
s AS (SELECT a.position, a.query_id, c.vec_id, round(CASE WHEN coalesce(an.size, 0) = 0 OR coalesce(cn.size, 0) = 0 THEN 0 ELSE coalesce(dot, 0) / an.size / cn.size END, 6) AS score
      FROM a JOIN (SELECT DISTINCT position, vec_id FROM c) c USING (position) LEFT JOIN dots ON dots.position = a.position AND dots.query_id = a.query_id AND dots.vec_id = c.vec_id
      LEFT JOIN cn ON cn.position = a.position AND cn.vec_id = c.vec_id LEFT JOIN an ON an.position = a.position AND an.query_id = a.query_id),
h AS (SELECT *, row_number() OVER (PARTITION BY position, query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10),
gold AS (SELECT a.position, query_id, vec_id FROM a JOIN c ON c.position = a.position AND c.source = a.source WHERE contains(lower(c.text), m)),
tot AS (SELECT position, query_id, count(*) AS total FROM gold GROUP BY ALL),
p AS (SELECT a.position, a.query_id, coalesce(any_value(total), 0) AS total, min(rank) FILTER (WHERE g.vec_id IS NOT NULL) AS first_rank, count(g.vec_id) FILTER (WHERE rank <= 1) AS f1, count(g.vec_id) FILTER (WHERE rank <= 3) AS f3, count(g.vec_id) FILTER (WHERE rank <= 5) AS f5
      FROM a LEFT JOIN h ON h.position = a.position AND h.query_id = a.query_id LEFT JOIN gold g ON g.position = h.position AND g.query_id = h.query_id AND g.vec_id = h.vec_id LEFT JOIN tot ON tot.position = a.position AND tot.query_id = a.query_id GROUP BY ALL),
metrics AS (SELECT variant, position, count(*) AS n, {", ".join(f"round(avg((f{k} > 0)::INT), 6) AS hit_{k}, round(avg(f{k} / {k}.0), 6) AS p_{k}, round(avg(CASE WHEN total = 0 THEN 0 ELSE f{k} * 1.0 / total END), 6) AS r_{k}" for k in (1, 3, 5))},
      round(sum(coalesce(1.0 / first_rank, 0)) / greatest(count(*), 1), 6) AS mrr FROM p JOIN cases USING (position) GROUP BY ALL)"""


_SIZES = _ablation([(str(n), n, "search_document: ", "search_query: ") for n in (200, 300, 600, 1200, 2000)]).format(key="position || ':' || chunk_id")


@query(f"{_SIZES} SELECT * FROM metrics")
def r8_chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return evaluation.ablate_chunk_size(docs, _asked(spark, sf_dir), embedding.counting_embedder(64), "counts64")


@query(f"""{_SIZES}, best AS (SELECT * FROM metrics ORDER BY hit_3 DESC, mrr DESC, position LIMIT 1), own AS (SELECT hit_3 AS h, mrr AS m FROM metrics WHERE variant = '600')
SELECT variant, hit_3, mrr, round(hit_3 - h, 6) AS hit_3_delta, round(mrr - m, 6) AS mrr_delta FROM best, own""")
def r9_best_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.best_setting(r8_chunk_sizes(spark, sf_dir), "600")


def _violations(size: int) -> str:
    return f"""SELECT * FROM (WITH {chunks_sql(size, size // 6)},
q AS (SELECT doc_id AS query_id, CAST(doc_id AS VARCHAR) AS source, lower(trim(text[120:143])) AS m FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL),
n AS (SELECT source, count(*) AS n FROM chunks GROUP BY source),
g AS (SELECT query_id, q.source, count(*) AS g FROM q JOIN chunks USING (source) WHERE contains(lower(text), m) GROUP BY ALL)
SELECT q.query_id, q.source, CASE WHEN g IS NULL THEN 'missing' ELSE 'too_common' END AS problem, {size} AS size FROM q LEFT JOIN g USING (query_id) LEFT JOIN n ON n.source = q.source WHERE g IS NULL OR g > greatest(1, n // 2))"""


@query(" UNION ALL ".join(map(_violations, (200, 600, 2000))))
def r10_gold_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.gold_violations_by_size(table(spark, sf_dir, "documents"), _asked(spark, sf_dir))


@query(_ablation([(name, 600, *pair) for name, pair in evaluation.PREFIXES.items()]).format(key="chunk_id") + " SELECT * FROM metrics")
def r8_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.ablate_prefixes(table(spark, sf_dir, "documents").select("doc_id", "text"), _asked(spark, sf_dir), embedding.counting_embedder(64), "counts64")


_COARSE = """, c AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 8) / 8) AS v, embedding FROM embeddings),
cs AS (SELECT q.query_id, c.vec_id, round(list_dot_product(q.v::DOUBLE[], c.v) / sqrt(list_dot_product(q.v::DOUBLE[], q.v::DOUBLE[])) / sqrt(list_dot_product(c.v, c.v)), 6) AS score FROM q, c),
ct AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cs QUALIFY rank <= 10)"""


@query(_EXACT.format(k=10) + _COARSE + """ SELECT coalesce(t.query_id, ct.query_id) AS query_id, CAST(coalesce(t.rank, ct.rank) AS INTEGER) AS rank, t.vec_id AS id_a, t.score AS score_a, ct.vec_id AS id_b, ct.score AS score_b
FROM t FULL JOIN ct ON t.query_id = ct.query_id AND t.rank = ct.rank WHERE t.vec_id IS DISTINCT FROM ct.vec_id OR abs(t.score - ct.score) > 1e-4""")
def v5_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the ranking over vectors cut to eighths differs from that over the vectors themselves."""
    vectors, asked = _vectors(spark, sf_dir)
    coarse = vectors.withColumn("embedding", F.transform("embedding", lambda x: F.floor(x.cast("double") * 8) / 8))
    return search.ranking_differences(search.top_k(vectors, asked, k=10), search.top_k(coarse, asked, k=10), "vec_id").select("query_id", "rank", "id_a", "score_a", "id_b", "score_b")


@query(r"""WITH l AS (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS a FROM documents), x AS (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM l)
SELECT doc_id, array_to_string([i || '  ' || a[i] FOR i IN range(1, least(len(a), 3) + 1)], chr(10)) AS shown FROM x WHERE len(a) > 0""")
def g2_read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textsearch.read_lines(table(spark, sf_dir, "documents"), 1, 3).where("error is null").select("doc_id", "shown")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


def _drained(frame: DataFrame, name: str) -> DataFrame:
    """All the stream appends by the end of its input."""
    spark = frame.sparkSession
    path = shared_path(spark, name)
    frame.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(frame.schema).parquet(path)


@query("SELECT event_id, event_type AS name FROM events WHERE event_id % 6 < 4")
def st2_stream_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rollups.parsed_completions(_stream(spark, sf_dir).select("event_id", F.expr(_TEXT).alias("text")))
    return _drained(found.select("event_id", F.explode("parsed.calls").alias("c")).select("event_id", "c.name"), "st2")


#: The call log arrives in six slices of time; every 50th call is two slices late.
_SLICES = 6
_ARRIVED = f"""WITH span AS (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM events),
a AS (SELECT ts, event_type AS model, value AS latency_ms, event_type = 'error' AS failed, CAST((epoch_us(ts) - low) * {_SLICES} // (high - low + 1) + CASE WHEN event_id % 50 = 0 THEN 2 ELSE 0 END AS INTEGER) AS slice FROM events, span),
high AS (SELECT s.slice, max(ts) AS seen FROM (SELECT DISTINCT slice FROM a) s LEFT JOIN a ON a.slice < s.slice GROUP BY s.slice),
f AS (SELECT a.*, date_trunc('minute', ts) AS minute, date_trunc('minute', ts) + INTERVAL 1 MINUTE <= seen - INTERVAL 10 MINUTE AS dropped, date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM a) AS closed FROM a JOIN high USING (slice))"""


def _minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed minutes of a call log that comes slice by slice, some of it late."""
    events, path = table(spark, sf_dir, "events"), shared_path(spark, "log")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(micros), F.max(micros)).first()
    late = F.when(F.col("event_id") % 50 == 0, 2).otherwise(0)
    slice_ = F.floor((micros - F.lit(low or 0)) * _SLICES / F.lit((high or 0) - (low or 0) + 1)).cast("int") + late
    log = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model"), F.col("value").alias("latency_ms"), F.when(F.col("event_type") == "error", "x").alias("error"), slice_.alias("slice"))
    held = f"{path}-slices"
    log.write.partitionBy("slice").parquet(held)
    done = f"{path}-minutes"
    for number in range(_SLICES + 2):  # a slice arrives, the stream wakes up and goes on where it was
        part = spark.read.schema(log.schema).parquet(held).where(F.col("slice") == number).drop("slice")
        part.write.mode("append").parquet(path)
        minutes = rollups.calls_per_minute(spark.readStream.schema(log.drop("slice").schema).parquet(path))
        minutes.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(done).awaitTermination()
    return spark.read.schema(minutes.schema).parquet(done)


@query(_ARRIVED + """ SELECT minute, model, count(*) AS calls, count(*) FILTER (WHERE failed) AS errors, quantile_disc(latency_ms, 0.5) AS p50_ms, quantile_disc(latency_ms, 0.95) AS p95_ms
FROM f WHERE closed AND NOT coalesce(dropped, FALSE) GROUP BY ALL""")
def st3_calls_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches of one slice: calls behind the watermark are dropped."""
    done = rollups.with_percentiles(_minutes(spark, sf_dir))
    return done.select(F.col("minute").cast("timestamp_ntz").alias("minute"), "model", "calls", "errors", "p50_ms", "p95_ms")


@query(_ARRIVED + """ SELECT date_trunc('day', minute) AS day, model, CAST(count(*) FILTER (WHERE NOT coalesce(dropped, FALSE)) AS BIGINT) AS calls, count(*) FILTER (WHERE dropped) AS dropped,
quantile_disc(latency_ms, 0.5) FILTER (WHERE NOT coalesce(dropped, FALSE)) AS p50_ms FROM f WHERE closed GROUP BY ALL HAVING count(*) FILTER (WHERE NOT coalesce(dropped, FALSE)) > 0""")
def st3_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes merged to days, latency by latency, beside the calls that came too late."""
    minutes = _minutes(spark, sf_dir)
    days = rollups.with_percentiles(rollups.coarser(minutes, "day"), (0.5,))
    ts = F.col("ts").cast("timestamp")
    every = table(spark, sf_dir, "events").select(ts.alias("ts"), F.col("event_type").alias("model"))
    last = F.window("ts", "1 minute")["end"] <= F.lit(every.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 10 MINUTES")
    closed = every.where(last).groupBy(F.date_trunc("day", "ts").alias("minute"), "model").agg(F.count("*").alias("n"))
    both = days.join(closed.withColumnsRenamed({"minute": "_day", "model": "_model"}), (F.col("minute") == F.col("_day")) & F.col("model").eqNullSafe(F.col("_model")))
    return both.select(F.col("minute").cast("timestamp_ntz").alias("day"), "model", "calls", (F.col("n") - F.col("calls")).alias("dropped"), "p50_ms")
