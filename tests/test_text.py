"""Normalisation, n-grams, tags and small functions."""

import pytest
from pyspark.sql import functions as F

from memlattice.functions import jsonscan, scoring, tags as T, text
from memlattice.operators.retrieval import query_terms


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("given, want", [("Ｈｅｌｌｏ", "hello"), ("“测试”", "测试"), ("  A　B ", "a b"), (None, ""), ("", ""), ("'q'", "q")])
def test_normalize(spark, given, want):
    assert one(spark, text.normalize_search_text(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize(
    "given, index, required",
    [
        ("红烧肉", ["红", "烧", "肉", "红烧", "烧肉"], ["红烧", "烧肉"]),
        ("猫", ["猫"], ["猫"]),
        ("红烧", ["红", "烧", "红烧"], ["红烧"]),
        ("Python编程", ["python", "编", "程", "编程"], ["python", "编程"]),
        ("a b a", ["a", "b"], ["a", "b"]),
        ("", [], []),
        ("!!", [], []),
    ],
)
def test_ngrams_and_driver_twin(spark, given, index, required):
    assert one(spark, text.index_tokens(F.lit(given))) == index
    assert one(spark, text.required_terms(F.lit(given))) == required
    got = query_terms(given)
    assert got[0] == required and sorted(set(got[1])) == sorted(index)


def test_hit_limit(spark):
    assert [one(spark, text.hit_limit(F.lit(n), F.lit(50))) for n in (1, 2, 40)] == [800, 240, 50]


def test_tags(spark):
    tags = lambda *t: F.array(*[F.lit(x) for x in t]).cast("array<string>")
    assert one(spark, T.is_profile(tags("小明", "123456", "用户别名")))
    assert not one(spark, T.is_profile(tags("小明", "用户别名")))
    assert not one(spark, T.is_profile(tags("小明", "123456")))
    assert not one(spark, T.is_profile(tags("123456", "654321", "用户别名")))
    assert one(spark, T.normalize_tags(tags(" a ", "", "b", "a", "1"))) == ["a", "b", "1"]
    assert one(spark, T.nickname(tags("123456", "用户别名", "小明"))) == "小明"
    assert one(spark, T.session_user_id(tags("x12", "0123456"))) == "0123456"
    assert one(spark, T.normalize_tags(F.lit(None).cast("array<string>"))) == []


@pytest.mark.parametrize("given, want", [("a, b ,a", ["a", "b"]), ('["x", "y z"]', ["x", "y z"]), ("['x', 'y']", ["x", "y"]), ("", [])])
def test_parse_tags(spark, given, want):
    assert one(spark, T.parse_tags(F.lit(given))) == want


def test_lines_paths_titles(spark):
    assert one(spark, text.line_count(F.lit("a" + chr(10) + "b" + chr(13) + chr(10) + "c" + chr(0x2028) + "d" + chr(10)))) == 4
    assert one(spark, text.line_count(F.lit(""))) == 0
    assert one(spark, text.first_heading(F.lit("x\n# \n#  T 1 \n"))) == "T 1"
    assert one(spark, text.normal_path(F.lit(" /a\\b/c.md"))) == "a/b/c.md"
    assert one(spark, text.safe_title(F.lit(' .a/b:c. '))) == "a_b_c"
    assert one(spark, text.safe_title(F.lit(None).cast("string"))) == "untitled"


def test_remove_names_and_query(spark):
    assert one(spark, text.remove_names(F.lit("Hey NOVA, is a.b here"), ["nova|小新", "a.b"])) == "Hey , is here"
    assert one(spark, jsonscan.process_query(F.lit("Hello bot how"), F.lit(""), ["bot"])) == "Hello how"
    assert one(spark, jsonscan.process_query(F.lit("x"), F.lit("topic bot"), ["bot"])) == "topic bot"


def test_tokens(spark):
    assert one(spark, text.token_estimate(F.lit("abcd红"))) == 2
    assert jsonscan.within_budget("abcdef", 0.95) == "abc"
    assert jsonscan.within_budget("红烧abc", 1.3, True) == "abc"
    assert jsonscan.within_budget(None, 3) == ""
    with pytest.raises(ValueError):
        jsonscan.within_budget("a", -1)


def test_json():
    t = 'noise {"a": {"b": "}"}} ---JSON--- ```json {"x": 1, "y": 2} {"x": 3} ```'
    assert jsonscan.extract_object(t) == {"x": 3}
    assert jsonscan.extract_object(t, optional=("y",)) == {"x": 1, "y": 2}
    assert jsonscan.extract_object(t, required=("z",)) is None
    assert jsonscan.extract_object('} {"a": "\\"{"}') == {"a": '"{'}
    assert jsonscan.extract_object("") is None and jsonscan.extract_object(None) is None
    assert jsonscan.feedback_of('{"feedback_data": "{\\"k\\": 1}"}') == {"k": 1}
    assert jsonscan.feedback_of('{"feedback_data": "oops"}') is None


def test_scores(spark):
    assert one(spark, scoring.cycle_days(F.lit(5.0), F.lit(2.0), F.lit(1.0))) == 2  # halves to even
    assert one(spark, scoring.tier(F.lit(3.0))) == 1 and one(spark, scoring.tier(F.lit(10.0))) == 2
    assert abs(one(spark, scoring.cosine(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0)))) - 0.7071067) < 1e-6
    assert one(spark, scoring.cosine(F.array(F.lit(0.0)), F.array(F.lit(0.0)))) == 0.0
    assert scoring.DecayConfig.clamped(theta0=-1, theta1=-5, cycle_days=0).theta1 == 0.0


def test_content_and_times(spark):
    assert one(spark, text.content_text(F.lit('[{"type":"image"},{"type":"text","text":"hi"}]'))) == "hi"
    assert one(spark, text.content_text(F.lit("plain"))) == "plain"
    assert one(spark, text.coerce_timestamp(F.lit("12.5"), F.lit(0.0))) == 12.5
    assert one(spark, text.coerce_timestamp(F.lit("1970-01-02T00:00:00Z"), F.lit(0.0))) == 86400.0
    assert one(spark, text.coerce_timestamp(F.lit("zzz"), F.lit(7.0))) == 7.0
    assert one(spark, text.memory_line(F.lit("m1"), F.lit(" j "), F.lit("r"), F.lit(100.0), F.lit(70.0))) == "[m1] j\n——因为r（刚刚）"
    assert one(spark, text.cell_bar(F.lit(0.45))).count("█") == 4
