"""Template ranking against a plain loop, and what it sends."""

import random
from collections import Counter

from pyspark.sql import functions as F
from test_selector_criteria import shuffled

from folioscope.operators import templates


def _plain_ranks(texts, tags, fields, queries, asked_tags, asked_fields, sources, limit):
    score = Counter()
    for q, query in queries:
        for t, text in texts:
            score[q, t] += 5 * bool(query and query.strip(" ") and text and query.strip(" ").lower() in text.lower())
    for given, asked, weight in ((tags, asked_tags, 3), (fields, asked_fields, 2)):
        for q, value in {(q, v.lower()) for q, v in asked if v}:
            for t, v in given:
                score[q, t] += weight * (v is not None and v.lower() == value)
    for pair, n in Counter(s[:2] for s in sources).items():
        score[pair] += n + 1
    out = []
    for q in {q for q, _ in score}:
        best = sorted((-n, t) for (r, t), n in score.items() if r == q and n)
        out += [(q, t, -n, i + 1) for i, (n, t) in enumerate(best[:limit])]
    return sorted(out)


def test_template_ranks_equal_a_loop(spark):
    r = random.Random(5)
    words, values = ["red", "blue", "Green", "x y"], ["a", "B", "b", "c", None, "unasked"]
    texts = [(t, r.choice([None, " ".join(r.choices(words, k=3))])) for t in range(60)]
    tags, fields = ([(r.randint(0, 70), r.choice(values)) for _ in range(150)] for _ in range(2))
    queries = [(q, r.choice([*words, " BLUE ", "", None, "x  y"])) for q in range(12)]
    asked_tags, asked_fields = ([(r.randint(0, 13), r.choice(values[:-1])) for _ in range(20)] for _ in range(2))
    sources = [(r.randint(0, 15), r.randint(55, 80), "f") for _ in range(30)]
    df = spark.createDataFrame
    args = (df(texts, "template_id int, search_text string"), df(tags, "template_id int, tag string"), df(fields, "template_id int, field string"),
            df(queries, "request_id int, query string"), df(asked_tags, "request_id int, tag string"), df(asked_fields, "request_id int, field string"))
    for limit in (1, 3, None):
        for more in (sources, []):
            got = templates.rank_templates(*args, source_fields=df(more, "request_id int, template_id int, field string") if more else None, limit=limit)
            want = _plain_ranks(texts, tags, fields, queries, asked_tags, asked_fields, more, limit)
            assert sorted(tuple(x) for x in got.select("request_id", "template_id", "score", "rank").collect()) == want


def test_templates_alike_are_ranked_once(spark):
    """Every template has the one field that every request asks for: 200,000 pairs, of which none but the best are made."""
    df = spark.createDataFrame
    ids = spark.range(4000).select(F.col("id").alias("template_id"))
    asked = df([(q, "F") for q in range(50)], "request_id int, field string")
    got = templates.rank_templates(
        ids.withColumn("search_text", F.lit("none")), ids.withColumn("tag", F.lit("t")), ids.withColumn("field", F.lit("f")),
        df([(0, "query")], "request_id int, query string"), df([(0, "other")], "request_id int, tag string"), asked, limit=2)
    assert sorted((x.request_id, x.template_id, x.score, x["rank"]) for x in got.collect()) == [(q, t, 2, t + 1) for q in range(50) for t in range(2)]
    assert 0 < shuffled(got) < 500_000
