import datetime as dt

import pytest
from pyspark.sql import types as T

from dqflow.operators import assess as A
from dqflow.operators.rules import Rule, RuleSet, glob_matches

AS_OF = dt.date(2024, 6, 1)


@pytest.mark.parametrize(
    "pattern,name,hit",
    [("*", "x", True), ("*mail*", "user_EMAIL_1", True), ("*_id", "claim_id", True), ("*_id", "id_claim", False),
     ("prov*", "Provider", True), ("npi", "NPI", True), ("npi", "npi2", False)],
)
def test_glob(pattern, name, hit):
    assert glob_matches(pattern, name) is hit


def test_placeholder_is_a_token():
    r = Rule("r", "validity", "info", "field_value = 'field_value' AND my_field_value > 1", ("*",))
    assert r.predicate("a b") == "(`a b` = 'field_value' AND my_field_value > 1)"


def test_registry():
    rs = RuleSet.builtin(AS_OF)
    assert len(rs.rules) == 9
    names = {r.name for r in rs.for_field("provider_npi", T.StringType())}
    assert names == {"null_completeness", "blank_completeness", "npi_format"}
    rs.enable("npi_format", False)
    assert "npi_format" not in {r.name for r in rs.for_field("provider_npi", T.StringType())}
    with pytest.raises(ValueError):
        RuleSet().load({"x": {"dimension": "taste", "severity": "info", "condition": "true", "field_names": ["*"]}})


def test_later_rule_of_same_name_wins(spark):
    df = spark.range(10).select("id")
    rs = RuleSet().register(Rule("r", "validity", "info", "field_value < 5", ("id",)))
    out = A.rule_results(df, rs.with_rules([Rule("r", "validity", "info", "field_value < 8", ("id",))])).collect()
    assert len(out) == 1 and out[0]["passed_count"] == 8


def test_null_counts_as_violation_unless_allowed(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    rules = RuleSet().with_rules(
        [Rule("strict", "validity", "info", "field_value = 'a'", ("s",)), Rule("soft", "validity", "info", "field_value = 'a'", ("s",), null_is_pass=True)]
    )
    got = {r["rule"]: r["violation_count"] for r in A.rule_results(df, rules).collect()}
    assert got == {"strict": 1, "soft": 0}


def test_broken_rule_scores_zero(spark):
    rules = RuleSet().with_rules([Rule("bad", "validity", "info", "nope(field_value)", ("id",)), Rule("ok", "validity", "info", "true", ("id",))])
    got = {r["rule"]: (r["score"], r["error"] is not None) for r in A.rule_results(spark.range(4), rules).collect()}
    assert got == {"bad": (0.0, True), "ok": (100.0, False)}


def test_uniqueness_is_all_or_nothing(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, None)], "a_id int, b_id int")
    rules = RuleSet({r.name: r for r in RuleSet.builtin(AS_OF).rules.values() if r.dimension == "uniqueness"})
    got = {r["field"]: r["passed_count"] for r in A.rule_results(df, rules).collect()}
    assert got == {"a_id": 3, "b_id": 0}


def test_score_arithmetic(spark):
    rows = [("f", "completeness", 95.0), ("g", "completeness", 80.0), ("f", "validity", 87.0), ("g", "validity", 92.0)]
    res = spark.createDataFrame(rows, "field string, dimension string, score double")
    dims = {r["dimension"]: r["score"] for r in A.dimension_scores(res).collect()}
    assert dims["completeness"] == 87.5 and dims["validity"] == 89.5 and dims["timeliness"] == 100.0
    one = spark.createDataFrame([("completeness", 90.0), ("validity", 85.0), ("consistency", 95.0)], "dimension string, score double")
    assert A.overall_score(one, {"completeness": 0.3, "validity": 0.4, "consistency": 0.3}).first()[0] == pytest.approx(89.5)


def test_assessment_scans_once(spark, sf):
    """The counts take one scan and one more for uniqueness, whatever the number of rules."""
    df = spark.read.parquet(f"{sf}/customer.parquet")
    many = [Rule(f"r{i}", "validity", "info", f"field_value != {i}", ("c_custkey",)) for i in range(120)]
    plan = A.rule_results(df, RuleSet.builtin(AS_OF).with_rules(many))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    wide = A.one_pass(df, {f"k{i}": A.F.count_if(A.F.col("c_custkey") > i) for i in range(A.CHUNK + 5)})
    assert wide.count() == A.CHUNK + 5


def test_settled_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/customer.parquet")
    doc = A.as_document(A.assess(df, "customer", RuleSet.builtin(AS_OF)))
    from dqflow.sources.files import export_document

    assert "completeness" in export_document(doc, "json")
    with pytest.raises(ValueError):
        export_document(doc, "xml")


def test_registry_folded_from_commands(spark):
    """Unregistered rules go; a later registration replaces the pattern and is enabled; disabled rules bind nothing."""
    from dqflow.operators.rules import bind_names, glob_matches, registry_state

    log = spark.createDataFrame(
        [("a", 1, "register", "x*"), ("a", 2, "disable", None), ("a", 3, "register", "*Y*"), ("b", 1, "register", "*"), ("b", 2, "disable", None),
         ("c", 1, "register", "*z"), ("c", 2, "unregister", None), ("d", 1, "enable", None), ("e", 1, "register", "xyz"), ("e", 2, "disable", None),
         ("e", 3, "enable", None), ("f", 1, "register", "XY*")], "rule string, at int, action string, pattern string")
    state = {r["rule"]: (r["pattern"], r["enabled"]) for r in registry_state(log).collect()}
    assert state == {"a": ("*Y*", True), "b": ("*", False), "e": ("xyz", True), "f": ("XY*", True)}
    names = ["xyz", "XY", "y", "yx", "", "zz", "xyz"]
    got = bind_names(registry_state(log), spark.createDataFrame([(n,) for n in names], "name string")).collect()
    want = {(r, n) for r, (p, on) in state.items() if on for n in names if glob_matches(p, n)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
