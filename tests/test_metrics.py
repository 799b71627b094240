import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.functions import metrics, significance, tails, text
from orderloom.functions.significance import chi2_upper, mannwhitney_upper, normal_two_sided, spearman_p
from orderloom.functions.vocabulary import ASPECT_PATTERNS, PRICE_BINS, PRICE_LABELS
from orderloom.operators import statistics


def column(spark, values, schema, expression):
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


def test_delay_and_late_flag(spark):
    at = dt.datetime
    values = [(at(2018, 1, 10, 12), at(2018, 1, 8)), (at(2018, 1, 5), at(2018, 1, 10)),
              (at(2018, 1, 10), at(2018, 1, 10)), (None, at(2018, 1, 10))]
    delay = metrics.delay_days(F.col("d"), F.col("e"))
    schema = "d timestamp_ntz, e timestamp_ntz"
    assert column(spark, values, schema, delay) == [2.5, -5.0, 0.0, None]
    assert column(spark, values, schema, metrics.late_flag(delay)) == [1.0, 0.0, 0.0, None]


def test_negative_review_and_expected_label(spark):
    values = [(s,) for s in (1, 2, 3, 4, 5, None)]
    assert column(spark, values, "s int", metrics.neg_review_flag(F.col("s"))) == [1, 1, 0, 0, 0, 0]
    assert column(spark, values[:5], "s int", metrics.expected_sentiment(F.col("s"))) == [
        "Negative", "Negative", "Neutral", "Positive", "Positive"]


def test_parse_aspects(spark):
    values = [("['Packaging', 'Price/Value']",), ("Packaging",), ("[]",), ("  ",), (None,)]
    assert column(spark, values, "x string", metrics.parse_aspects(F.col("x"))) == [
        ["Packaging", "Price/Value"], ["Packaging"], ["Uncategorized"], ["Uncategorized"], ["Uncategorized"]]
    odd = [("""["Men's wear", 'B']""",), ("['A', None]",), (r"""['it\'s', 4]""",), ("('A',)",), ("'A'",), ("Men's wear",), ("[ ]",)]
    assert column(spark, odd, "x string", metrics.parse_aspects(F.col("x"))) == [
        ["Men's wear", "B"], ["A", "None"], ["it's", "4"], ["A"], ["A"], ["Men's wear"], ["Uncategorized"]]
    arrays = [(["A", "B"],), ([],), (None,)]
    assert column(spark, arrays, "x array<string>", metrics.parse_aspect_array(F.col("x"))) == [
        ["A", "B"], ["Uncategorized"], ["Uncategorized"]]


def test_right_closed_bins(spark):
    values = [(v,) for v in (0.0, 50.0, 50.01, 150.0, 500.0, 501.0)]
    assert column(spark, values, "v double", metrics.right_closed_bin(F.col("v"), PRICE_BINS, PRICE_LABELS)) == [
        None, "<50", "50-150", "50-150", "150-500", ">500"]


def test_lexicon_counts_plain_words_twice(spark):
    values = [("Bom",), ("ótimo",), ("rápido",), ("não",), ("bom, não",), ("nada",), ("bom BOM bom",)]
    up, down = text.lexicon_counts(F.col("t"))
    assert column(spark, values, "t string", up) == [2, 2, 1, 0, 2, 0, 2]
    assert column(spark, values, "t string", down) == [0, 0, 0, 1, 1, 0, 0]
    label, score = text.lexicon_sentiment(up, down)
    assert column(spark, values, "t string", label) == [
        "Positive", "Positive", "Positive", "Negative", "Positive", "Neutral", "Positive"]
    assert column(spark, values, "t string", F.round(score, 4)) == [1.0, 1.0, 1.0, 1.0, 0.6667, 0.5, 1.0]


def test_default_aspects_need_accents_as_written(spark):
    values = [("A entrega atrasou e a caixa veio aberta",), ("Produto não veio",), ("péssimo",), ("tudo certo",)]
    assert column(spark, values, "t string", text.tag_aspects(F.col("t"), ASPECT_PATTERNS)) == [
        ["Delivery/Logistics", "Packaging"], ["Product Quality"], ["Product Quality"], ["Uncategorized"]]
    folded = text.tag_aspects(F.col("t"), ASPECT_PATTERNS, unaccented=True)
    assert column(spark, values[1:2], "t string", folded) == [["Product Quality", "Wrong/Missing Item"]]


def test_terms_drop_stop_words_before_pairs(spark):
    values = [("O produto é muito bom, x!",), ("a",), (None,)]
    found = text.terms(F.col("t"), ["muito"])
    assert column(spark, values, "t string", found) == [["produto", "bom", "produto bom"], [], None]


def test_published_p_values():
    assert chi2_upper(120.36, 3) == pytest.approx(6.44e-26, rel=5e-3)
    assert chi2_upper(397.5, 36) == pytest.approx(1.75e-62, rel=5e-3)
    assert spearman_p(-0.8388, 37) == pytest.approx(9.06e-11, rel=5e-3)
    assert normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert chi2_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    # two equal groups: U at its mean, half a step below it counts against
    assert mannwhitney_upper(50.0, 10, 10, 0.0) == pytest.approx(0.515, abs=1e-2)


def test_fold_equals_compatibility_decomposition(spark):
    import unicodedata

    values = ["Ｇｏｌｐｅ", "ﬁm ﬀ", "m² nº ª ½ ¾", "Ação ÉÜ ñ ç", "™ … ①② ℡", "ǅ Ĳ ŉ", "plain", "e\u0301", "日本 ß ø"]
    expected = [unicodedata.normalize("NFKD", v.lower()).encode("ascii", "ignore").decode() for v in values]
    assert column(spark, [(v,) for v in values], "x string", text.fold(F.col("x"))) == expected


def test_tail_expressions_match_the_scalar_functions(spark):
    """Small and large degrees of freedom, both sides of the middle, and the far tails."""
    student = [(t, float(df)) for t in (0.0, 1e-3, 0.3, 1.0, -2.5, 9.0, 35.0) for df in (1, 2, 3, 22, 101, 4_000, 90_000)]
    squared = [(x, df) for x in (1e-3, 0.5, 3.0, 20.0, 120.0, 900.0) for df in (1, 2, 3, 4, 9, 24, 71, 150)]
    normal = [(z,) for z in (-9.0, -1.0, -0.2, 0.0, 0.2, 1.0, 3.0, 12.0, 30.0)]
    got = spark.createDataFrame(student, "t double, df double").select("*", tails.student_two_sided(F.col("t"), F.col("df")).alias("p"))
    for t, df, p in got.collect():
        assert p == pytest.approx(significance.student_two_sided(t, df), rel=1e-8, abs=1e-300), (t, df)
    got = spark.createDataFrame(squared, "x double, df long").select("*", tails.chi2_upper(F.col("x"), F.col("df")).alias("p"))
    for x, df, p in got.collect():
        expected = significance.chi2_upper(x, df)
        assert p == pytest.approx(expected, rel=1e-9, abs=1e-300), (x, df)
    got = spark.createDataFrame(normal, "z double").select("*", tails.normal_upper(F.col("z")).alias("p"))
    for z, p in got.collect():
        assert p == pytest.approx(significance.normal_upper(z), rel=1e-11), z


def test_p_values_without_a_result(spark):
    pairs = spark.createDataFrame([(None, 10), (1.0, 10), (0.5, 2), (0.5, 10)], "rho double, n long")
    assert [r.p_value for r in statistics.spearman_with_p(pairs).collect()][:2] == [None, 0.0]
    assert np.isnan(statistics.spearman_with_p(pairs).collect()[2].p_value)
    one = spark.createDataFrame([(1, None), (2, 0.0)], "n_groups long, h double")
    assert [r.p_value for r in statistics.kruskal_with_p(one).collect()] == [None, 1.0]
    equal = spark.createDataFrame([(4.0, 2, 4, 210.0), (0.0, 0, 0, None)], "u double, n1 long, n2 long, tie_sum double")
    assert all(np.isnan(r.p_value) for r in statistics.mannwhitney_with_p(equal, "n1", "n2").collect())
