from pyspark.sql import functions as F

from passagery.functions import signals as S
from passagery.functions import text as T
from passagery.functions import vectors as V


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).collect()[0]["x"]


def test_default_tokens(spark):
    assert one(spark, "What is SOW?", T.word_tokens) == ["sow"]
    assert one(spark, "the a of in for and CI", T.word_tokens) == ["ci"]
    assert one(spark, None, T.word_tokens) == [] and one(spark, "", T.word_tokens) == []
    assert one(spark, "Zażółć gęślą jaźń", T.word_tokens) == ["zażółć", "gęślą", "jaźń"]


def test_identifier_and_technical_tokens(spark):
    assert one(spark, "API-Retry-After", lambda c: T.identifier_tokens(c, False)) == ["api-retry-after", "api", "retry", "after"]
    assert one(spark, "key storage atk_", T.identifier_tokens) == ["key", "storage", "atk_", "atk", "key storage", "storage atk_", "atk_ atk"]
    got = one(spark, "snake_case kebab-case API.v1 status:404", T.technical_tokens)
    assert set(got) >= {"snake_case", "snake", "case", "kebab-case", "kebab", "api.v1", "api", "v1", "status:404", "status", "404"}
    assert one(spark, "x", T.identifier_tokens) == []


def test_other_tokens(spark):
    assert one(spark, "How retry the Retry of API_KEY", T.overlap_tokens) == ["retry", "api_key"]
    assert one(spark, "What is CI?", T.acronyms) == ["CI"]
    assert one(spark, "is it", T.diversity_tokens) == []
    assert one(spark, "the API-Retry-After of 4xx keys", T.feedback_tokens) == ["API-Retry-After", "keys"]


def test_strings(spark):
    assert one(spark, " A\\B.md ", T.normalise_source) == "a/b.md"
    assert one(spark, "  What \n IS  it ", T.normalise_question) == "what is it"
    assert one(spark, "Größe der *Stücke*", T.heading_slug) == "gr-sse-der-st-cke" and one(spark, "***", T.heading_slug) == "section"
    assert len(one(spark, "x" * 200, T.truncate)) == 123
    assert one(spark, "1, 2;x, 2,3", T.parse_numbers) == [1, 2, 3]
    assert one(spark, "3725", lambda c: T.duration(c.cast("double"))) == "1h 2m 5s"
    assert one(spark, "q", lambda c: T.passage_prefix(c, F.lit("multilingual-e5-base"), True)) == "query: q"
    assert one(spark, "See `timeout` of it", lambda c: T.topic(c, F.lit("Head"))) == "timeout"


def test_weights_and_gate(spark):
    w = lambda q: tuple(one(spark, q, lambda c: S.adaptive_weights(c, F.lit(0.7), F.lit(0.3))))
    assert w("What is CI?") == (0.35, 0.65)
    assert w("please tell me about the overall retry policy") == (0.8, 0.2)
    assert w("short one") == (0.7, 0.3) and w(None) == (0.7, 0.3)
    d = lambda q: one(spark, q, lambda c: S.decision(c, S.gate(c)))
    assert "identifier" in d("What does `retry_after` mean?")["protected"] and not d("What does `retry_after` mean?")["should_route"]
    assert d("What happens when a request or event is repeated?")["should_route"]
    assert not d("")["should_route"]


def test_instructions(spark):
    m = lambda q: one(spark, q, S.corpus_instruction)
    assert [m("Which header has code 429?"), m("Please explain the idea"), m("What is the difference here"), m("the first and the last"), m("Tell me something")] == [
        "precise", "semantic", "context", "multi", "generic",
    ]
    f = lambda q: one(spark, q, S.field_instruction)
    assert f("Which key is API-KEY?") == "precision" and f("Which page?") == "ambiguity"
    assert f("Please compare retries used during longer outages and recovery windows") == "multiple"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8], {"a": 2.0}, {"a": 3.0, "b": 1.0}, [[1.0, 0.0], [0.0, 1.0]])], "a array<float>, b array<float>, s map<string,double>, u map<string,double>, m array<array<float>>")
    r = df.select(V.dot("a", "b").alias("d"), V.cosine("a", "a").alias("c"), V.sparse_dot(F.col("s"), F.col("u")).alias("s"), V.late_interaction(F.col("m"), F.col("m")).alias("l")).collect()[0]
    assert abs(r["d"] - 0.6) < 1e-6 and r["c"] == 1.0 and r["s"] == 6.0 and r["l"] == 1.0
