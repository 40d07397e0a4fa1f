"""DataFrame-level text operators (X1, X6, X7): message classification, JSON record
validation and parameter parsing, applied to a text/JSON column of a table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions import text as T

# The agent-card fields a card record must carry.
CARD_FIELDS = ("name", "description", "url", "version", "capabilities", "defaultInputModes", "defaultOutputModes", "skills")
DEFAULT_MODEL = "XGBoost"


def classify_messages(df: DataFrame, text_col: str, rules=T.ERROR_RULES) -> DataFrame:
    """Add ``label`` (first matching rule, else 'unknown')."""
    return df.withColumn("label", T.classify(text_col, rules))


def label_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _j(c: str, path: str) -> Column:
    return F.get_json_object(F.col(c), path)


def _errors(checks: list[tuple[Column, str]]) -> Column:
    """array of the messages whose check failed, in rule order."""
    return F.filter(F.array(*[F.when(bad, F.lit(msg)) for bad, msg in checks]), lambda x: x.isNotNull())


def event_errors(json_col: str) -> Column:
    """Errors of one event record by its ``kind``."""
    kind = _j(json_col, "$.kind")
    has_state = _j(json_col, "$.status.state").isNotNull()
    parts_a = F.coalesce(F.json_array_length(_j(json_col, "$.artifact.parts")), F.lit(0))
    parts_m = F.coalesce(F.json_array_length(_j(json_col, "$.parts")), F.lit(0))
    role = _j(json_col, "$.role")
    no = F.lit(False)
    checks = [
        (kind.isNull(), "missing kind"),
        (kind.isNotNull() & ~kind.isin("task", "status-update", "artifact-update", "message"), "unknown kind"),
        ((kind == "task") & _j(json_col, "$.id").isNull(), "task: missing id"),
        (kind.isin("task", "status-update") & ~has_state, "missing status.state"),
        ((kind == "artifact-update") & _j(json_col, "$.artifact").isNull(), "artifact-update: missing artifact"),
        ((kind == "artifact-update") & _j(json_col, "$.artifact").isNotNull() & (parts_a == 0), "artifact: empty parts"),
        ((kind == "message") & (parts_m == 0), "message: empty parts"),
        ((kind == "message") & F.coalesce(role != "agent", F.lit(True)), "message: role is not agent"),
    ]
    return _errors([(F.coalesce(b, no), m) for b, m in checks])


def card_errors(json_col: str) -> Column:
    """Errors of one agent-card record."""
    checks = [(_j(json_col, f"$.{f}").isNull(), f"missing field: {f}") for f in CARD_FIELDS]
    url = _j(json_col, "$.url")
    checks.append((url.isNotNull() & ~(url.startswith("http://") | url.startswith("https://")), "url not absolute"))
    caps = _j(json_col, "$.capabilities")
    checks.append((caps.isNotNull() & ~caps.startswith("{"), "capabilities not an object"))
    for f in ("defaultInputModes", "defaultOutputModes"):
        v = _j(json_col, f"$.{f}")
        checks.append((v.isNotNull() & ~v.startswith("["), f"{f} not an array"))
    sk = _j(json_col, "$.skills")
    checks.append((sk.isNotNull() & ~sk.startswith("["), "skills not an array"))
    checks.append((sk.startswith("[") & (F.json_array_length(sk) == 0), "skills empty"))
    return _errors([(F.coalesce(b, F.lit(False)), m) for b, m in checks])


@dataclass(frozen=True)
class FieldRule:
    """What a record must hold at ``path`` (``a.b``): one of ``kinds`` (integer, number, text, boolean,
    array, object), a number in low..high, one of ``among``, an array of at least ``min_items``. A
    field that is not ``required`` may be absent or null."""

    path: str
    kinds: tuple[str, ...] = ()
    required: bool = True
    low: float | None = None
    high: float | None = None
    among: tuple[str, ...] = ()
    min_items: int = 0


# type names that the variant's schema starts with, by kind
_KINDS = {"integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "text": ("STRING",), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


def record_errors(json_col: str, rules: list[FieldRule]) -> Column:
    """X6 by a declared record: the broken rules of a JSON text as texts, in rule order. The text is
    parsed once to a variant; text that is no JSON object has that one error."""
    v = F.try_parse_json(F.col(json_col).cast("string"))

    def of(v):
        checks = []
        for r in rules:
            at = f"$.{r.path}"
            field = F.try_variant_get(v, at, "variant")
            kind = F.schema_of_variant(field)
            there = kind.isNotNull() & (kind != "VOID")
            if r.required:
                checks.append((~there, f"{r.path}: missing"))
            names = [n for k in r.kinds for n in _KINDS[k]]
            if names:
                fits = reduce(lambda a, b: a | b, [kind.startswith(n) for n in names])
                checks.append((there & ~fits, f"{r.path}: not {' or '.join(r.kinds)}"))
            number = F.try_variant_get(v, at, "double")
            if r.low is not None:
                checks.append((number < r.low, f"{r.path}: below {r.low:g}"))
            if r.high is not None:
                checks.append((number > r.high, f"{r.path}: above {r.high:g}"))
            if r.among:
                checks.append((there & ~F.coalesce(F.try_variant_get(v, at, "string"), F.lit("")).isin(*r.among), f"{r.path}: not one of {', '.join(r.among)}"))
            if r.min_items:
                size = F.size(F.try_variant_get(v, at, "array<variant>"))
                checks.append((kind.startswith("ARRAY") & (size < r.min_items), f"{r.path}: fewer than {r.min_items} items"))
        return _errors([(F.coalesce(b, F.lit(False)), m) for b, m in checks])

    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, F.get(F.transform(F.array(v), of), F.lit(0))).otherwise(F.array(F.lit("not a JSON object")))


def check_records(df: DataFrame, json_col: str, rules: list[FieldRule]) -> DataFrame:
    """Add ``errors``, ``n_errors`` and ``valid`` by declared rules."""
    out = df.withColumn("errors", record_errors(json_col, rules)).withColumn("n_errors", F.size("errors"))
    return out.withColumn("valid", (F.col("n_errors") == 0).cast("int"))


def validate_records(df: DataFrame, json_col: str, kind: str = "event") -> DataFrame:
    """Add ``errors`` (array of texts), ``n_errors`` and ``valid``."""
    errs = event_errors(json_col) if kind == "event" else card_errors(json_col)
    return df.withColumn("errors", errs).withColumn("n_errors", F.size("errors")).withColumn(
        "valid", (F.col("n_errors") == 0).cast("int")
    )


def parse_params(df: DataFrame, text_col: str, key: str = "TUNED_PARAMS", until: str = "\nOUTPUT_PATH:") -> DataFrame:
    """JSON parameters after ``KEY:``; malformed or absent -> default model,
    empty params. Values stay text (numbers and names mix); cast them where they are read."""
    payload = T.payload_after(text_col, key, until)
    ok = payload.isNotNull() & F.get_json_object(payload, "$").isNotNull()
    model = F.when(ok, F.coalesce(F.get_json_object(payload, "$.model"), F.lit(DEFAULT_MODEL))).otherwise(F.lit(DEFAULT_MODEL))
    given = F.when(ok, F.from_json(F.get_json_object(payload, "$.params"), "map<string,string>"))
    params = F.coalesce(given, F.create_map().cast("map<string,string>"))
    return df.withColumn("model", model).withColumn("params", params)
