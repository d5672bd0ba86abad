"""How often a request reads the tokens of a field."""

from tessera.operators import scoring


def test_a_request_reads_a_fields_tokens_once_for_all_its_terms(spark, monkeypatch):
    from tessera.operators.collection import Collection

    passes, plain = [], scoring.Stats.learn

    def learn(self, column, terms):
        before = len(self.terms), len(self.fields)
        plain(self, column, terms)
        if (len(self.terms), len(self.fields)) != before and type(self) is scoring.Stats:
            passes.append(sorted(terms))

    monkeypatch.setattr(scoring.Stats, "learn", learn)
    c = Collection(spark.createDataFrame([(1, "a thing"), (2, "the thing of the day")], "id long, s string"), {"s": {"type": "text", "analyzer": "english"}})
    assert [r["id"] for r in c.search({"query": 's:thing AND NOT s:"of the"', "limit": -1}).docs.collect()] == [1]
    assert passes == [["of", "the", "thing"]]
