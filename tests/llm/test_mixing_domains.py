import pytest

from evenkeel.llm import soft_mixing as sm


def test_every_domain_is_kept_and_unknown_weights_raise(spark):
    docs = spark.createDataFrame([(2 * i + j, f"w{i} v{i} w{i}", f"d{i:02d}") for i in range(34) for j in range(2)], "doc_id long, text string, lang string")
    model = sm.classifier(docs, "doc_id", "text", "lang")
    assert model[0] == [f"d{i:02d}" for i in range(34)]
    members = spark.createDataFrame([(5, 1.0)], "tokens long, p0 double")
    with pytest.raises(ValueError, match="zz"):
        sm.fit_rates(members, ["a"], {"a": 1.0, "zz": 1.0})


def test_a_rare_domain_is_learned_from_a_large_table(spark):
    common = spark.range(20_000).selectExpr("id AS doc_id", "concat('the cat ', id % 7) AS text", "'big' AS lang")
    rare = spark.createDataFrame([(-1, "le chat noir", "rare")], common.schema)
    domains, priors, vocabulary = sm.classifier(common.union(rare), "doc_id", "text", "lang", sample=200)
    weight = {r.word: r.l1 - r.l0 for r in vocabulary.collect()}
    assert domains == ["big", "rare"] and weight["chat"] > 1 and weight["cat"] < -1
    assert priors[1] == pytest.approx(-9.9035, abs=1e-3)
