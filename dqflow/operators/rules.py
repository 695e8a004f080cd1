"""Validation rules: definition, registry, glob binding and compilation.

A rule's condition is SQL text with the placeholder ``field_value``; binding a
rule to a field substitutes the quoted column name.  That text is the extension
point for users, so rules can come from plain dicts or YAML.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = ("completeness", "validity", "consistency", "accuracy", "timeliness", "uniqueness")
SEVERITIES = ("critical", "warning", "info")
# Dimension weights; a dimension without a weight counts .2.
WEIGHTS = {"completeness": 0.25, "validity": 0.30, "consistency": 0.20, "accuracy": 0.15, "timeliness": 0.10}
DEFAULT_WEIGHT = 0.2


@dataclass(frozen=True)
class Rule:
    name: str
    dimension: str
    severity: str
    condition: str
    field_names: tuple
    description: str = ""
    threshold: float | None = None
    enabled: bool = True
    auto_remediate: bool = False
    remediation_action: str | None = None
    tags: tuple = ()
    strings_only: bool = False
    null_is_pass: bool = False

    def __post_init__(self):
        if self.dimension not in DIMENSIONS:
            raise ValueError(f"unknown dimension {self.dimension!r}")
        if self.severity not in SEVERITIES:
            raise ValueError(f"unknown severity {self.severity!r}")

    def applies_to(self, name: str, data_type: T.DataType | None = None) -> bool:
        if self.strings_only and data_type is not None and not isinstance(data_type, T.StringType):
            return False
        return any(glob_matches(p, name) for p in self.field_names)

    def predicate(self, column: str) -> str:
        """SQL text for one field; a string literal keeps its own text."""
        quoted = "`" + column.replace("`", "``") + "`"
        text = re.sub(r"'(?:[^'\\]|\\.|'')*'|\bfield_value\b", lambda m: quoted if m[0] == "field_value" else m[0], self.condition)
        return f"({quoted} IS NULL OR ({text}))" if self.null_is_pass else f"({text})"


def glob_matches(pattern: str, name: str) -> bool:
    """``*``, ``*x*``, ``*suffix``, ``prefix*`` or the exact name, any case."""
    pattern, name = pattern.lower(), name.lower()
    if pattern == "*":
        return True
    core = pattern.strip("*")
    if pattern.startswith("*") and pattern.endswith("*"):
        return core in name
    if pattern.startswith("*"):
        return name.endswith(core)
    if pattern.endswith("*"):
        return name.startswith(core)
    return pattern == name


def glob_column(pattern: str, column) -> Column:
    """The same match for names that are data."""
    name, pattern = F.lower(column), pattern.lower()
    core = pattern.strip("*")
    if pattern == "*":
        return F.lit(True)
    if pattern.startswith("*") and pattern.endswith("*"):
        return name.contains(core)
    if pattern.startswith("*"):
        return name.endswith(core)
    return name.startswith(core) if pattern.endswith("*") else name == pattern


def builtin_rules(as_of: dt.date) -> list[Rule]:
    latest = as_of.replace(year=as_of.year + 1, day=min(as_of.day, 28) if as_of.month == 2 else as_of.day)
    return [
        Rule("null_completeness", "completeness", "critical", "field_value IS NOT NULL", ("*",),
             "required values are present", auto_remediate=True, remediation_action="mark_incomplete"),
        Rule("blank_completeness", "completeness", "warning", "TRIM(field_value) != ''", ("*",),
             "text values are not blank", auto_remediate=True, remediation_action="mark_incomplete", strings_only=True),
        Rule("email_format", "validity", "warning",
             r"field_value RLIKE '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$'", ("email", "*email*"),
             "e-mail address format", tags=("format", "email"), strings_only=True),
        Rule("phone_format", "validity", "warning", r"field_value RLIKE '^\\+?1?[0-9]{10}$'",
             ("phone", "*phone*", "telephone"), "phone number format", auto_remediate=True,
             remediation_action="standardize_phone", tags=("format", "phone"), strings_only=True),
        Rule("date_range", "validity", "critical",
             f"try_cast(field_value AS DATE) BETWEEN DATE '1900-01-01' AND DATE '{latest}'", ("*date*",),
             "dates lie in a plausible range", tags=("date", "range")),
        Rule("npi_format", "validity", "critical",
             "field_value RLIKE '^[0-9]{10}$' AND luhn_check(concat('80840', field_value))",
             ("provider_npi", "npi", "*npi*"), "provider number format and check digit",
             tags=("healthcare", "npi", "format"), strings_only=True),
        Rule("icd10_format", "validity", "critical",
             r"field_value RLIKE '^[A-TV-Z][0-9][A-Z0-9](\\.[A-Z0-9]{0,4})?$'",
             ("diagnosis_code", "icd10", "*diagnosis*"), "diagnosis code format",
             tags=("healthcare", "icd10", "diagnosis"), strings_only=True),
        Rule("cpt_format", "validity", "critical", "field_value RLIKE '^[0-9]{5}$'",
             ("procedure_code", "cpt", "*cpt*"), "procedure code format",
             tags=("healthcare", "cpt", "procedure"), strings_only=True),
        Rule("primary_key_uniqueness", "uniqueness", "critical", "unique_count = total_count",
             ("id", "*_id", "key", "*_key"), "key fields are unique", tags=("uniqueness", "primary_key")),
    ]


@dataclass
class RuleSet:
    """Rules by name; a later rule of the same name replaces the earlier one."""

    rules: dict = field(default_factory=dict)

    @classmethod
    def builtin(cls, as_of: dt.date) -> "RuleSet":
        return cls({r.name: r for r in builtin_rules(as_of)})

    def register(self, rule: Rule) -> "RuleSet":
        self.rules[rule.name] = rule
        return self

    def unregister(self, name: str) -> "RuleSet":
        self.rules.pop(name, None)
        return self

    def enable(self, name: str, enabled: bool = True) -> "RuleSet":
        self.rules[name] = replace(self.rules[name], enabled=enabled)
        return self

    def with_rules(self, extra) -> "RuleSet":
        out = RuleSet(dict(self.rules))
        for r in extra or ():
            out.register(r)
        return out

    def load(self, config: dict) -> "RuleSet":
        """``{name: {dimension, severity, condition, field_names, ...}}``."""
        for name, c in config.items():
            known = {k: v for k, v in c.items() if k in Rule.__dataclass_fields__ and k != "name"}
            for k in ("field_names", "tags"):
                if k in known:
                    known[k] = tuple(known[k])
            self.register(Rule(name=name, **known))
        return self

    def load_yaml(self, path: str) -> "RuleSet":
        import yaml

        with open(path, encoding="utf-8") as f:
            return self.load(yaml.safe_load(f))

    def for_field(self, name: str, data_type=None) -> list[Rule]:
        return [r for r in self.rules.values() if r.enabled and r.applies_to(name, data_type)]

    def bind(self, schema: T.StructType) -> list[tuple[str, Rule]]:
        return [(f.name, r) for f in schema.fields for r in self.for_field(f.name, f.dataType)]


def registry_state(commands: DataFrame) -> DataFrame:
    """rule, pattern, enabled: the rules that a log of commands leaves registered.

    ``commands`` has rule, at (orderable, unique per rule), action (register, unregister, enable, disable) and
    pattern.  A later registration replaces an earlier one and is enabled; enabling and disabling count
    only after the newest registration.  One combining aggregate per rule: no rule's log is gathered.
    """
    place = F.col("action").isin("register", "unregister")
    switch = F.col("action").isin("enable", "disable")
    placed, switched = F.max_by(F.struct("at", "action", "pattern"), F.when(place, F.col("at"))), F.max_by(
        F.struct("at", "action"), F.when(switch, F.col("at")))
    state = commands.groupBy("rule").agg(placed.alias("p"), switched.alias("s"))
    return state.where("p.action = 'register'").select(
        "rule", F.col("p.pattern").alias("pattern"),
        F.coalesce((F.col("s.at") < F.col("p.at")) | (F.col("s.action") == "enable"), F.lit(True)).alias("enabled"))


def bind_names(rules: DataFrame, names: DataFrame) -> DataFrame:
    """(rule, name) of every enabled rule whose glob pattern fits a name, where both are data.

    Both meet on equal keys: a name offers itself, its prefixes, suffixes and parts, n (n + 1) / 2 of them for
    n letters.  Names are those of fields, so n is small whatever the tables hold.
    """
    on = rules.where("enabled").select("rule", F.lower("pattern").alias("g"))
    kind = F.when(F.col("g") == "*", "all").when(F.col("g").rlike(r"^\*.*\*$"), "part").when(F.startswith("g", F.lit("*")), "end").when(
        F.endswith("g", F.lit("*")), "start").otherwise("whole")
    on = on.select("rule", kind.alias("kind"), F.regexp_replace("g", r"^\*+|\*+$", "").alias("core"))
    low = names.select("name", F.lower("name").alias("n")).distinct()
    size = F.length("n")
    cuts = F.when(size > 0, F.sequence(F.lit(1), size))
    offers = low.select("name", F.explode(F.array_distinct(F.concat(
        F.array(F.struct(F.lit("whole").alias("kind"), F.col("n").alias("core")), F.struct(F.lit("all").alias("kind"), F.lit("").alias("core"))),
        F.coalesce(F.transform(cuts, lambda i: F.struct(F.lit("start").alias("kind"), F.substring("n", F.lit(1), i).alias("core"))), F.array()),
        F.coalesce(F.transform(cuts, lambda i: F.struct(F.lit("end").alias("kind"), F.substring("n", size - i + 1, i).alias("core"))), F.array()),
        F.coalesce(F.flatten(F.transform(cuts, lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda j: F.struct(
            F.lit("part").alias("kind"), F.substring("n", i, j).alias("core"))))), F.array()),
    ))).alias("o")).select("name", "o.kind", "o.core")
    return on.join(offers, ["kind", "core"]).select("rule", "name")


def checked_predicate(df: DataFrame, rule: Rule, column: str) -> Column | None:
    """The bound condition, or None when it does not analyse against ``df``.

    Analysis only touches metadata; a broken rule scores zero instead of
    failing the assessment of all others.
    """
    from pyspark.errors import AnalysisException, ParseException

    text = rule.predicate(column)
    try:
        df.select(F.expr(text).cast("boolean")).schema
    except (AnalysisException, ParseException):
        return None
    return F.expr(text)


def register_sql_functions(spark) -> None:
    """SQL functions that rule text may call."""
    bodies = {
        "is_luhn(s STRING)": "coalesce(s rlike '^[0-9]+$' AND luhn_check(s), false)",
        "is_npi(s STRING)": "coalesce(s rlike '^[0-9]{10}$' AND luhn_check(concat('80840', s)), false)",
        "standard_phone(s STRING)": (
            "CASE WHEN length(regexp_replace(regexp_replace(s, '[^0-9]', ''), '^1([0-9]{10})$', '$1')) = 10 "
            "THEN regexp_replace(regexp_replace(s, '[^0-9]', ''), '^1([0-9]{10})$', '$1') ELSE s END"
        ),
        "is_member_id(s STRING)": (
            "coalesce(upper(s) rlike '^([0-9]{9,12}|[A-Z]{1,3}[0-9]{6,9}|[A-Z][0-9]{8}[A-Z])$', false)"
        ),
    }
    for sig, body in bodies.items():
        kind = "STRING" if sig.startswith("standard") else "BOOLEAN"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {sig} RETURNS {kind} RETURN {body}")
