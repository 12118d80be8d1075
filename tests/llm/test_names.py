"""Columns that an operator adds or uses are refused, other names with an underscore pass; what counts as a letter."""

import pytest

from socspan.llm import decontaminate, language_id, line_dedup, mixing, quality_model, quality_rules
from socspan.llm.common import refuse, shared_dir

LANGUAGE = language_id.Model([], None)
CASES = [
    (lambda d: quality_rules.filter_quality(d), ["_quality_counts", "_kept", "_t_fences", "_T_LANG"]),
    (lambda d: decontaminate.find_leaks(d, d.selectExpr("doc_id as item_id", "text")), ["_leaks", "_key", "_found"]),
    (lambda d: quality_model.score(d, None), ["_quality"]),
    (lambda d: language_id.predict(d, LANGUAGE), ["_language"]),
    (lambda d: mixing.mix(d), ["_mix", "_look", "_p", "_cell"]),
    (lambda d: line_dedup.dedup_lines(d), ["_id", "_split", "_dedup"]),
]


@pytest.mark.parametrize("run, names", CASES)
def test_reserved_names_are_refused(spark, run, names):
    df = spark.createDataFrame([(1, "a b c", "en", "web", 5)], "doc_id long, text string, lang string, source string, extra int")
    for name in names:
        with pytest.raises(ValueError, match=name):
            run(df.withColumnRenamed("extra", name))


@pytest.mark.parametrize("run", [CASES[0][0], CASES[3][0], CASES[5][0]])
def test_other_underscored_names_pass(spark, run):
    df = spark.createDataFrame([(1, " ".join(chr(97 + i % 26) + "ord" + chr(97 + i // 26) for i in range(80)), "en", "web", 5)], "doc_id long, text string, lang string, source string, _n int")
    assert run(df).first()["_n"] == 5


def test_refuse_ignores_case(spark):
    df = spark.range(1)
    assert refuse(df, "other") is df
    with pytest.raises(ValueError, match="id"):
        refuse(df, "ID")


@pytest.mark.parametrize("text, known", [("²", False), ("½ ①", False), ("12_3", False), ("é", True), ("中", True), ("² a", True)])
def test_letters(text, known):
    m = language_id.Model(["en"], language_id.np.ones((1, language_id.GRAMS)))
    assert (m.predict(text)[0] == "en") is known


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Conf:
        def get(self, *a):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session(), "x")
