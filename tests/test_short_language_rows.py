"""Trigram scoring: a text's trigrams are rows once, its length is one more; counts are cut from the texts once."""

from pyspark.sql import functions as F

from locflow.operators import short_language as S


def test_one_row_a_trigram_and_one_for_the_length(spark):
    docs = spark.createDataFrame([("en", "the cat and the dog"), ("de", "der hund und die katze"), ("fr", "le chat et le chien")], "lang string, text string")
    profiles = S.build_gram_profiles(docs)
    assert "regexp_replace" not in profiles._jdf.queryExecution().optimizedPlan().toString()
    texts = spark.createDataFrame([(1, "the dog"), (2, "der hund"), (3, "12"), (4, "zzz qqq"), (5, "le chien"), (5, "le chat")], "doc_id long, text string")
    det = S.detect_short(texts, profiles, margin=1)
    assert "array_repeat" not in det._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: (r.detected, r.lead) for r in det.collect()}
    assert [got[n][0] for n in (1, 2, 3, 5)] == ["en", "de", "und", "fr"] and got[3] == ("und", 0)
    weight = {(r.lang, r.gram): r.weight for r in profiles.collect()}
    # a text without a known trigram is scored by its length alone
    unseen = sorted((weight[lang, ""] * 7 for lang in ("de", "en", "fr")), reverse=True)
    assert got[4][1] == unseen[0] - unseen[1]
    none = S.detect_short(texts, profiles.limit(0)).collect()
    assert {(r.detected, r.lead) for r in none} == {("und", 0)}
