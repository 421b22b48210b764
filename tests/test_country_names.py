"""Names of all countries found by one search, held against a search for each."""

import random

from pyspark.sql import functions as F

from loomspan.operators import tagging


def test_one_search_counts_as_many_do(spark):
    r = random.Random(3)
    words = [w for p in tagging.COUNTRIES.values() for w in p.split("|")] + ["united", "States", "south", "Indiana", "us-", "USA's", "ſweden", "é", "_UK", "UK.", "chINA"]
    texts = [r.choice([" ", ", ", "-"]).join(r.choices(words, k=r.randint(0, 12))) for _ in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(900, None)], "doc_id long, text string")
    each = F.array(*[F.struct(F.lit(c).alias("country"), F.regexp_count("text", F.lit(rf"(?i)\b(?:{p})\b")).alias("n")) for c, p in tagging.COUNTRIES.items()])
    want = docs.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*").where("n > 0")
    got = tagging.country_counts(docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 800
    assert got._jdf.queryExecution().executedPlan().toString().count("(?i)") < len(tagging.COUNTRIES)
    assert not tagging._apart({"a": ["new york"], "b": ["york shire"]}) and not tagging._apart({"a": ["x"], "b": ["x y"]}) and not tagging._apart({"a": ["x.y"]})
