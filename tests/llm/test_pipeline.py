"""The pipeline's stages on a small corpus, held against plain Python."""

import collections
import random

import corpus_pipeline as cp
from feira.llm.common import materialize


def test_pipeline(spark):
    r = random.Random(1)
    rows = [(i, " ".join(f"w{r.randrange(900)}" for _ in range(60)), "en", f"s{i % 2}", 0) for i in range(60)]
    rows += [(100, rows[3][1], "en", "s0", 0), (101, rows[4][1].replace("w", "W", 1) + " end", "en", "s1", 0), (102, "123 456", "en", "s0", 0), (103, None, None, None, None), (104, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept, seen = docs, {}
    for name, stage in cp.STAGES:
        kept = materialize(stage(spark, kept, ""), f"test-{name}")
        seen[name] = [x["doc_id"] for x in kept.collect()]
        if name != "bpe":
            assert kept.columns == list(cp.COLUMNS)
    assert set(seen["language"]) == {x[0] for x in rows} - {102, 103, 104}
    assert set(seen["exact"]) == set(seen["language"]) - {3}
    assert set(seen["near"]) == set(seen["exact"]) - {101}
    n = collections.Counter(seen["mix"])
    assert set(n) <= set(seen["near"]) and max(n.values()) == 2 and 80 <= sum(n.values()) <= 92
    assert sorted(seen["mix"]) == sorted(seen["bpe"])
    empty = docs.filter("false")
    for name, stage in cp.STAGES:
        empty = materialize(stage(spark, empty, ""), f"empty-{name}")
        assert empty.count() == 0


def test_pipeline_rows_not_ids(spark):
    r = random.Random(2)
    a, b, c, d, e = (" ".join(f"w{r.randrange(900)}" for _ in range(60)) for _ in range(5))
    rows = [(1, a, "en", "s0", 0), (1, a, "en", "s0", 0), (1, a, "fr", "s1", 0), (None, a, "en", "s0", 0), (None, b, "en", "s0", 0), (None, b, "en", "s0", 0),
            (None, "123 456", "en", "s0", 0), (2, "123", "en", "s0", 0), (2, c, "en", "s0", 0), (3, d, "en", "s0", 0), (None, d + " end", "en", "s0", 0),
            (4, d.replace("w", "W", 1), "en", "s0", 0), (4, e, "en", "s0", 0), (4, "", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    def after(name, docs):
        out = materialize(dict(cp.STAGES)[name](spark, docs, ""), f"rows-{name}")
        return out, collections.Counter((x["doc_id"], x["text"], x["lang"]) for x in out.collect())

    out, seen = after("language", docs)
    assert seen == collections.Counter(x[:3] for x in rows if x[1] not in ("123 456", "123", ""))
    out, seen = after("exact", out)
    once = [(1, a, "fr"), (None, b, "en"), (2, c, "en"), (3, d, "en"), (None, d + " end", "en"), (4, d.replace("w", "W", 1), "en"), (4, e, "en")]
    assert seen == collections.Counter(once)
    out, seen = after("near", out)
    assert seen == collections.Counter([(1, a, "fr"), (None, b, "en"), (2, c, "en"), (3, d, "en"), (4, e, "en")])
