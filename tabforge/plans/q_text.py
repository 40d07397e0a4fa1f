"""Queries for the text operators (X1-X7) over conversation turns and web pages.

The conversations carry no error lines, markers or fences, so the message fixture
derives them from each real turn with ``concat``: a hash of (conv_id, turn) picks
one of a few error lines / wrappers, identically in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabforge.functions import text as T
from tabforge.functions.scalar import hash_bucket
from tabforge.operators import textops as TO
from tabforge.plans import fixtures as X
from tabforge.plans.catalog import register

# error lines appended to turns (the last one means: none)
ERROR_LINES = (
    "ChainedAssignmentError: value set on a copy of a slice",
    "TypeError: Encoders require their input to be uniformly strings or numbers. Got ['bool', 'str']",
    "KeyError: 'Cabin_Deck'",
    "TypeError: '<' not supported between instances of 'str' and 'bool'",
    "ValueError: X has 12 features but RandomForestClassifier is expecting 14 features as input",
    "ValueError: could not convert string to float: 'Europa'",
    "ValueError: Input contains NaN, infinity or a value too large",
    "",
)

_KEY_SQL = "cast(conv_id as varchar) || '_' || cast(turn as varchar)"


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _base(spark, d):
    c = X.table(spark, d, "conversations")
    return c.withColumn("b", hash_bucket(F.concat_ws("_", "conv_id", "turn"), "m"))


_BASE_SQL = f"select *, {X.sql_hash8(_KEY_SQL, 'm')} as b from conversations"


def _messages(spark, d):
    b = _base(spark, d)
    line = F.element_at(F.array(*[F.lit(x) for x in ERROR_LINES]), (F.col("b") % len(ERROR_LINES) + 1).cast("int"))
    msg = F.when(line == "", F.col("text")).otherwise(F.concat(F.col("text"), F.lit("\n"), line))
    return b.withColumn("message", msg)


_MSG_SQL = f"""select *, case when line = '' then text else text || chr(10) || line end as message from (
  select *, [{", ".join(_sq(x) for x in ERROR_LINES)}][cast(b % {len(ERROR_LINES)} as int) + 1] as line from ({_BASE_SQL}))"""


def _sql_classify(col="message"):
    parts = " ".join(f"when regexp_matches({col}, {_sq(p)}, 'i') then {_sq(lbl)}" for p, lbl in T.ERROR_RULES)
    return f"case {parts} else 'unknown' end"


@register("classify_messages", "X1", f"select conv_id, turn, {_sql_classify()} as label from ({_MSG_SQL})")
def q_classify(spark, d):
    return TO.classify_messages(_messages(spark, d), "message").select("conv_id", "turn", "label")


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+\\z', '', 'g')"


_EDA_PAT = "(?s)EDA_REPORT_START\\n(.*?)EDA_REPORT_END"


@register(
    "extract_block",
    "X2",
    f"""select conv_id, turn, case when regexp_matches(m, '{_EDA_PAT}') then {_strip_sql(f"regexp_extract(m, '{_EDA_PAT}', 1)")} end as report
from (select conv_id, turn, case when role = 'assistant' then 'EDA_REPORT_START' || chr(10) || text || chr(10) || 'EDA_REPORT_END' else text end as m
      from conversations)""",
)
def q_extract_block(spark, d):
    c = X.table(spark, d, "conversations")
    m = F.when(F.col("role") == "assistant", F.concat(F.lit("EDA_REPORT_START\n"), "text", F.lit("\nEDA_REPORT_END"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", T.extract_block(m, "EDA_REPORT_START", "EDA_REPORT_END").alias("report"))


def _fenced(spark, d):
    b = _base(spark, d)
    k = F.col("b") % 3
    m = (
        F.when(k == 0, F.concat(F.lit("```python\n"), "text", F.lit("\n```")))
        .when(k == 1, F.concat(F.lit("Here it is:\n```\n"), "text", F.lit("\n```\nDone.")))
        .otherwise(F.col("text"))
    )
    return b.withColumn("m", m)


_FENCED_SQL = f"""select conv_id, turn, case when b % 3 = 0 then '```python' || chr(10) || text || chr(10) || '```'
  when b % 3 = 1 then 'Here it is:' || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || 'Done.' else text end as m
from ({_BASE_SQL})"""

_TAG = "(?s)```python\\s*\\n(.*?)```"
_PLAIN = "(?s)```\\s*\\n(.*?)```"


@register(
    "extract_code_block",
    "X3",
    f"""select conv_id, turn, case when regexp_matches(m, '{_TAG}') then {_strip_sql(f"regexp_extract(m, '{_TAG}', 1)")}
  when regexp_matches(m, '{_PLAIN}') then {_strip_sql(f"regexp_extract(m, '{_PLAIN}', 1)")} end as code from ({_FENCED_SQL})""",
)
def q_extract_code_block(spark, d):
    return _fenced(spark, d).select("conv_id", "turn", T.extract_code_block("m").alias("code"))


@register(
    "strip_fences",
    "X5",
    f"""select conv_id, turn, case when starts_with(m, '```') then
  regexp_replace(regexp_replace(m, '^```[^\\n]*(\\n|\\z)', ''), '\\n[ \\t]*```[ \\t]*\\z', '') else m end as stripped from ({_FENCED_SQL})""",
)
def q_strip_fences(spark, d):
    return _fenced(spark, d).select("conv_id", "turn", T.strip_fences("m").alias("stripped"))


def _keyed(spark, d):
    b = _base(spark, d)
    w = F.when(F.col("b") % 4 == 0, F.lit("2.0,abc")).otherwise(F.concat(F.lit("2.0, 1.5,"), F.col("turn").cast("string")))
    m = F.concat(F.lit("OUTPUT_PATH:/data/out_"), F.col("conv_id").cast("string"), F.lit(".csv\nWEIGHTS:"), w, F.lit("\n"), F.col("text"))
    return b.withColumn("m", m)


_KEYED_SQL = f"""select conv_id, turn, 'OUTPUT_PATH:/data/out_' || cast(conv_id as varchar) || '.csv' || chr(10) || 'WEIGHTS:' ||
  case when b % 4 = 0 then '2.0,abc' else '2.0, 1.5,' || cast(turn as varchar) end || chr(10) || text as m from ({_BASE_SQL})"""


@register(
    "extract_keyed_line",
    "X4",
    f"""with k as (select conv_id, turn, {_strip_sql("regexp_extract(m, 'OUTPUT_PATH:(.*?)(?:\\n|$)', 1)")} as output_path,
  list_transform(string_split({_strip_sql("regexp_extract(m, 'WEIGHTS:(.*?)(?:\\n|$)', 1)")}, ','), lambda x: try_cast({_strip_sql('x')} as double)) as ws
  from ({_KEYED_SQL}))
select conv_id, turn, output_path, case when len(list_filter(ws, lambda x: x is null)) > 0 then null else len(ws) end as n_weights,
  case when len(list_filter(ws, lambda x: x is null)) > 0 then null else list_sum(ws) end as weight_sum from k""",
)
def q_extract_keyed_line(spark, d):
    k = _keyed(spark, d)
    ws = T.parse_numbers(T.extract_keyed_line("m", "WEIGHTS"))
    return k.select(
        "conv_id",
        "turn",
        T.extract_keyed_line("m", "OUTPUT_PATH").alias("output_path"),
        F.size(ws).cast("bigint").alias("n_weights"),
        F.aggregate(ws, F.lit(0.0), lambda acc, x: acc + x).alias("weight_sum"),
    ).withColumn("n_weights", F.when(F.col("weight_sum").isNull(), None).otherwise(F.col("n_weights")))


_REC_SQL = f"""select conv_id, turn, case cast(turn % 5 as int)
  when 0 then case when b % 2 = 0 then '{{"kind": "task", "id": "' || {_KEY_SQL} || '", "status": {{"state": "working"}}}}' else '{{"kind": "task", "status": {{}}}}' end
  when 1 then case when b % 2 = 0 then '{{"kind": "status-update", "status": {{"state": "completed"}}}}' else '{{"kind": "status-update"}}' end
  when 2 then case when b % 2 = 0 then '{{"kind": "artifact-update", "artifact": {{"parts": [{{"text": "' || cast(length(text) as varchar) || '"}}]}}}}' else '{{"kind": "artifact-update", "artifact": {{"parts": []}}}}' end
  when 3 then case when b % 2 = 0 then '{{"kind": "message", "role": "agent", "parts": [{{"text": "' || cast(length(text) as varchar) || '"}}]}}' else '{{"kind": "message", "role": "' || role || '", "parts": []}}' end
  else case when b % 2 = 0 then '{{"kind": "bogus"}}' else '{{"id": ' || cast(conv_id as varchar) || '}}' end end as rec from ({_BASE_SQL})"""


def _records(spark, d):
    b = _base(spark, d)
    key = F.concat_ws("_", "conv_id", "turn")
    ok = F.col("b") % 2 == 0
    ln = F.length("text").cast("string")
    t = (F.col("turn") % 5).cast("int")
    rec = (
        F.when(t == 0, F.when(ok, F.concat(F.lit('{"kind": "task", "id": "'), key, F.lit('", "status": {"state": "working"}}'))).otherwise(F.lit('{"kind": "task", "status": {}}')))
        .when(t == 1, F.when(ok, F.lit('{"kind": "status-update", "status": {"state": "completed"}}')).otherwise(F.lit('{"kind": "status-update"}')))
        .when(t == 2, F.when(ok, F.concat(F.lit('{"kind": "artifact-update", "artifact": {"parts": [{"text": "'), ln, F.lit('"}]}}'))).otherwise(F.lit('{"kind": "artifact-update", "artifact": {"parts": []}}')))
        .when(t == 3, F.when(ok, F.concat(F.lit('{"kind": "message", "role": "agent", "parts": [{"text": "'), ln, F.lit('"}]}'))).otherwise(F.concat(F.lit('{"kind": "message", "role": "'), F.col("role"), F.lit('", "parts": []}'))))
        .otherwise(F.when(ok, F.lit('{"kind": "bogus"}')).otherwise(F.concat(F.lit('{"id": '), F.col("conv_id").cast("string"), F.lit("}"))))
    )
    return b.select("conv_id", "turn", rec.alias("rec"))


def _sql_event_errors(j="rec"):
    def g(p):
        return f"json_extract_string({j}, '{p}')"

    kind = g("$.kind")
    checks = [
        (f"{kind} is null", "missing kind"),
        (f"{kind} is not null and {kind} not in ('task', 'status-update', 'artifact-update', 'message')", "unknown kind"),
        (f"{kind} = 'task' and json_extract({j}, '$.id') is null", "task: missing id"),
        (f"{kind} in ('task', 'status-update') and {g('$.status.state')} is null", "missing status.state"),
        (f"{kind} = 'artifact-update' and json_extract({j}, '$.artifact') is null", "artifact-update: missing artifact"),
        (f"{kind} = 'artifact-update' and json_extract({j}, '$.artifact') is not null and coalesce(json_array_length(json_extract({j}, '$.artifact.parts')), 0) = 0", "artifact: empty parts"),
        (f"{kind} = 'message' and coalesce(json_array_length(json_extract({j}, '$.parts')), 0) = 0", "message: empty parts"),
        (f"{kind} = 'message' and coalesce({g('$.role')} <> 'agent', true)", "message: role is not agent"),
    ]
    return "list_filter([" + ", ".join(f"case when coalesce({c}, false) then '{m}' end" for c, m in checks) + "], lambda x: x is not null)"


@register(
    "validate_records",
    "X6",
    f"""select conv_id, turn, cast(len(e) as int) as n_errors, array_to_string(e, '; ') as errors, cast(len(e) = 0 as int) as valid
from (select conv_id, turn, {_sql_event_errors()} as e from ({_REC_SQL}))""",
)
def q_validate_records(spark, d):
    r = TO.validate_records(_records(spark, d), "rec", "event")
    return r.select("conv_id", "turn", "n_errors", F.array_join("errors", "; ").alias("errors"), "valid")


_CARD_SQL = """select page_id, '{"name": "p' || cast(page_id as varchar) || '"' ||
  case when page_id % 3 = 0 then '' else ', "description": "page"' end ||
  ', "url": "' || url || '", "version": "1", "capabilities": {}, "defaultInputModes": ["text"], "defaultOutputModes": ["text"], "skills": ' ||
  case when page_id % 2 = 0 then '[{"id": "s"}]' else '[]' end || '}' as card from pages"""


def _sql_card_errors(j="card"):
    def g(p):
        return f"json_extract({j}, '{p}')"

    fields = ["name", "description", "url", "version", "capabilities", "defaultInputModes", "defaultOutputModes", "skills"]
    checks = [(f"{g('$.' + f)} is null", f"missing field: {f}") for f in fields]
    url = f"json_extract_string({j}, '$.url')"
    checks.append((f"{url} is not null and not (starts_with({url}, 'http://') or starts_with({url}, 'https://'))", "url not absolute"))
    checks.append((f"{g('$.capabilities')} is not null and json_type({g('$.capabilities')}) <> 'OBJECT'", "capabilities not an object"))
    for f in ("defaultInputModes", "defaultOutputModes"):
        checks.append((f"{g('$.' + f)} is not null and json_type({g('$.' + f)}) <> 'ARRAY'", f"{f} not an array"))
    checks.append((f"{g('$.skills')} is not null and json_type({g('$.skills')}) <> 'ARRAY'", "skills not an array"))
    checks.append((f"json_type({g('$.skills')}) = 'ARRAY' and json_array_length({g('$.skills')}) = 0", "skills empty"))
    return "list_filter([" + ", ".join(f"case when coalesce({c}, false) then '{m}' end" for c, m in checks) + "], lambda x: x is not null)"


@register(
    "validate_cards",
    "X6",
    f"""select page_id, cast(len(e) as int) as n_errors, array_to_string(e, '; ') as errors from (
  select page_id, {_sql_card_errors()} as e from ({_CARD_SQL}))""",
)
def q_validate_cards(spark, d):
    p = X.table(spark, d, "pages")
    card = F.concat(
        F.lit('{"name": "p'),
        F.col("page_id").cast("string"),
        F.lit('"'),
        F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.lit(', "description": "page"')),
        F.lit(', "url": "'),
        F.col("url"),
        F.lit('", "version": "1", "capabilities": {}, "defaultInputModes": ["text"], "defaultOutputModes": ["text"], "skills": '),
        F.when(F.col("page_id") % 2 == 0, F.lit('[{"id": "s"}]')).otherwise(F.lit("[]")),
        F.lit("}"),
    )
    r = TO.validate_records(p.select("page_id", card.alias("card")), "card", "card")
    return r.select("page_id", "n_errors", F.array_join("errors", "; ").alias("errors"))


_PARAM_SQL = f"""select conv_id, turn, case when b % 3 = 0 then 'TUNED_PARAMS:{{"model": "RandomForest", "params": {{"max_depth": ' || cast(turn as varchar) || '}}}}' || chr(10) || 'OUTPUT_PATH:/x'
  when b % 3 = 1 then 'TUNED_PARAMS:{{model: oops' else text end as m from ({_BASE_SQL})"""


@register(
    "parse_params",
    "X7",
    f"""select conv_id, turn, case when p is not null and json_valid(p) then coalesce(json_extract_string(p, '$.model'), 'XGBoost') else 'XGBoost' end as model,
  case when p is not null and json_valid(p) then try_cast(json_extract_string(p, '$.params.max_depth') as double) end as max_depth
from (select conv_id, turn, case when contains(m, 'TUNED_PARAMS:') then {_strip_sql("regexp_extract(m, '(?s)TUNED_PARAMS:(.*?)(?:\\nOUTPUT_PATH:|\\z)', 1)")} end as p from ({_PARAM_SQL}))""",
)
def q_parse_params(spark, d):
    b = _base(spark, d)
    m = (
        F.when(F.col("b") % 3 == 0, F.concat(F.lit('TUNED_PARAMS:{"model": "RandomForest", "params": {"max_depth": '), F.col("turn").cast("string"), F.lit("}}\nOUTPUT_PATH:/x")))
        .when(F.col("b") % 3 == 1, F.lit("TUNED_PARAMS:{model: oops"))
        .otherwise(F.col("text"))
    )
    r = TO.parse_params(b.withColumn("m", m), "m")
    return r.select("conv_id", "turn", "model", F.col("params").getItem("max_depth").try_cast("double").alias("max_depth"))


@register(
    "parse_event_params",
    "X7",
    """select event_id, case when event_type = 'error' then 'XGBoost' else event_type end as model,
  case when event_type <> 'error' then try_cast(json_extract_string(props, '$.k') as double) end as k, cast(event_type <> 'error' and json_valid(props) as int) as has_params
from events""",
)
def q_parse_event_params(spark, d):
    """The events' own JSON as the parameters of a message; error events carry a cut-off message."""
    e = X.table(spark, d, "events").select("event_id", "event_type", "props")
    whole = F.concat(F.lit('TUNED_PARAMS:{"model": "'), "event_type", F.lit('", "params": '), "props", F.lit("}\nOUTPUT_PATH:/x"))
    cut = F.concat(F.lit('TUNED_PARAMS:{"model": "'), "event_type", F.lit('", "params": '), "props")
    r = TO.parse_params(e.withColumn("m", F.when(F.col("event_type") == "error", cut).otherwise(whole)), "m")
    return r.select("event_id", "model", F.col("params").getItem("k").try_cast("double").alias("k"), (F.size("params") > 0).cast("int").alias("has_params"))


_PROPS_RULES = [TO.FieldRule("k", ("integer",), low=10, high=89), TO.FieldRule("v", ("number", "text"), required=False)]


@register(
    "check_event_props",
    "X6",
    """select event_id, cast(len(e) as int) as n_errors, array_to_string(e, '; ') as errors, cast(len(e) = 0 as int) as valid
from (select event_id, case when not coalesce(json_valid(props) and json_type(props) = 'OBJECT', false) then ['not a JSON object'] else list_filter([
    case when coalesce(json_type(props, '$.k'), 'NULL') = 'NULL' then 'k: missing' end,
    case when json_type(props, '$.k') not in ('UBIGINT', 'BIGINT', 'NULL') then 'k: not integer' end,
    case when try_cast(json_extract_string(props, '$.k') as double) < 10 then 'k: below 10' end,
    case when try_cast(json_extract_string(props, '$.k') as double) > 89 then 'k: above 89' end,
    case when json_type(props, '$.v') not in ('UBIGINT', 'BIGINT', 'DOUBLE', 'VARCHAR', 'NULL') then 'v: not number or text' end],
    lambda x: x is not null) end as e from events)""",
)
def q_check_event_props(spark, d):
    """The given JSON of ``events.props`` against a declared record."""
    r = TO.check_records(X.table(spark, d, "events").select("event_id", "props"), "props", _PROPS_RULES)
    return r.select("event_id", "n_errors", F.array_join("errors", "; ").alias("errors"), "valid")
