"""What steps in Python are given at a time, and how often they run."""

from pyspark.sql import functions as F

from tessera.operators import scoring


def test_sloppy_phrases_hand_places_to_python_not_tokens(spark):
    rows = spark.createDataFrame([(0, "the x of"), (1, "of the of x the"), (2, "the"), (3, None)], "id long, s string")
    tokens = rows.select("id", F.transform(F.split("s", " "), lambda t, i: F.struct(t.alias("t"), i.alias("p"))).alias("w"))
    made = tokens.select("id", scoring.sloppy_freq("w", [("the", 0), ("of", 1)], 2).alias("f"))
    assert [r["f"] for r in made.orderBy("id").collect()] == [0.5, 1.0 + 1 / 3, 0.0, None]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "run(w#" not in plan


def test_texts_become_tokens_a_few_at_a_time(monkeypatch):
    import pyarrow as pa

    from tessera.functions import analysis

    held, plain = [], analysis._listed
    monkeypatch.setattr(analysis, "_listed", lambda values, many, multi: held.append(len(values)) or plain(values, many, multi))
    texts = ["Stories of the day " * 4096, None, "", "x²", *["The end"] * 9]
    got = analysis.made(pa.array(texts * 20), analysis.analyzer("english"), False).to_pylist()
    assert max(held) < len(texts) * 20 / 2
    assert [None if x is None else [(y["t"], y["p"]) for y in x] for x in got[:13]] == [None if t is None else analysis.terms("english", t) for t in texts]
