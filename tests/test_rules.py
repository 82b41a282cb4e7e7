import pytest

from pagelake.operators import rules


def run(df, *rule_list, strict=True):
    return [r.asDict() for r in df.transform(rules.compile_rules(rule_list, strict=strict)).collect()]


@pytest.mark.parametrize(
    ("condition", "kept"),
    [
        ("score >= 60", ["60", "61", "未知", "nan?"]), ("score <= 60", ["59", "60", "未知", "nan?"]),
        ("score > 60", ["61", "未知", "nan?"]), ("score < 60", ["59", "未知", "nan?"]),
        ("score == 60", ["60"]), ("score != '60'", ["59", "61", "未知", "nan?"]), ("score contains 6", ["60", "61"]),
        ("", ["59", "60", "61", "未知", "nan?"]), ("no operator", ["59", "60", "61", "未知", "nan?"]),
        ("score >= abc", ["59", "60", "61", "未知", "nan?"]), ("gone == ''", ["59", "60", "61", "未知", "nan?"]),
    ],
)
def test_filter(spark, condition, kept):
    df = spark.createDataFrame([(s,) for s in ("59", "60", "61", "未知", "nan?")], "score string")
    assert [r["score"] for r in run(df, {"type": "filter", "condition": condition})] == kept


def test_nan_compares_false(spark):
    df = spark.createDataFrame([("nan",), ("1",)], "s string")
    assert [r["s"] for r in run(df, {"type": "filter", "condition": "s >= 0"})] == ["1"]


def test_order_and_missing_fields(spark):
    df = spark.createDataFrame([(" a-1 ", None), ("zz", "x")], "t string, u string")
    out = run(
        df,
        {"type": "field_map", "source": "t", "target": "u"},
        {"type": "trim", "source": "u"},
        {"type": "regex_extract", "source": "u", "target": "n", "pattern": r"(\w)-(\d)", "group": 2},
        {"type": "replace", "source": "u", "pattern": r"(?P<x>a)-", "replacement": r"\g<1>$1\\"},
        {"type": "trim", "source": "gone"}, {"type": "drop", "source": "gone"},
        {"type": "default", "source": "n", "default": "0"},
        {"type": "type_cast", "source": "n", "cast_type": "int"},
    )
    assert out == [{"u": "a$1\\1", "n": 1}, {"u": "zz", "n": 0}]


def test_split_is_literal(spark):
    df = spark.createDataFrame([("a.b.",), ("",), (None,)], "t string")
    out = run(df, {"type": "split", "source": "t", "target": "p", "separator": "."})
    assert [r["p"] for r in out] == [["a", "b", ""], None, None]


def test_bad_rules(spark):
    df = spark.createDataFrame([("a",)], "t string")
    for bad in ({"pattern": "("}, {"pattern": "a", "group": 3}):
        rule = {"type": "regex_extract", "source": "t", **bad}
        assert run(df, rule, strict=False) == [{"t": "a"}]
        with pytest.raises(rules.RuleError):
            run(df, rule)
    with pytest.raises(rules.RuleError):
        rules.compile_rules([{"type": "explode"}])


def test_default_fills_falsy_values_of_any_type(spark):
    df = spark.createDataFrame([("", 0, False, []), ("x", 3, True, [1])], "s string, i int, b boolean, a array<int>")
    out = run(df, *[{"type": "default", "source": c, "default": d} for c, d in (("s", "n"), ("i", 9), ("b", True))])
    assert [(r["s"], r["i"], r["b"]) for r in out] == [("n", 9, True), ("x", 3, True)]


def test_sites_have_their_own_rules_in_one_scan(spark):
    df = spark.createDataFrame([("a", " 1,5 ", "k"), ("b", "7", " q  r "), ("c", "x", None)], "site string, n string, t string")
    site_rules = {
        "a": [{"type": "type_cast", "source": "n", "cast_type": "float"}, {"type": "field_map", "source": "t", "target": "title"}],
        "b": [{"type": "filter", "condition": "n > 100"}],
    }
    cleaned = rules.clean_site(df, site_rules)
    assert [tuple(r) for r in cleaned.orderBy("site").collect()] == [("a", "15.0", None, "k"), ("c", "x", None, None)]
    scans = cleaned._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in scans


def test_postprocess_order(spark):
    df = spark.createDataFrame([(" Ab  12 元 ", 5)], "v string, n int")
    assert rules.postprocess(df, {"v": {"collapse_ws": True, "remove": "元", "regex_replace": ["B", "C"], "ignorecase": True, "upper": True}, "n": {"lower": True}}).first()["v"] == "AC 12 "
    assert rules.postprocess(df, {"v": {"digits_only": True}}).first()["v"] == "12"
    assert rules.postprocess(df, {"v": {"strip": False, "lower": True}}).first()["v"] == " ab  12 元 "


def test_named_groups_and_back_references(spark):
    df = spark.createDataFrame([("ab",), ("aa",)], "v string")
    assert run(df, {"type": "replace", "source": "v", "pattern": "(?P<one_1>a)", "replacement": r"\g<one_1>!"}) == [{"v": "a!b"}, {"v": "a!a!"}]
    out = run(df, {"type": "regex_extract", "source": "v", "target": "w", "pattern": "(?P<x>a)(?P=x)", "group": 0})
    assert [r["w"] or "" for r in out] == ["", "aa"]
    with pytest.raises((rules.RuleError, ValueError)):
        rules.compile_rules([{"type": "replace", "source": "v", "pattern": "a", "replacement": r"\g<y>"}], strict=True)(df)


def test_text_default_on_a_number_makes_text(spark):
    df = spark.createDataFrame([(1, None), (2, 7)], "id int, v int")
    assert [r["v"] for r in run(df, {"type": "default", "source": "v", "default": "sold out"})] == ["sold out", "7"]
    assert [r["v"] for r in run(df, {"type": "default", "source": "v", "default": "3"})] == [3, 7]
