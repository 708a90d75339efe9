"""Benchmark items with too few literal words for a template."""

from grainwise.llm import decontaminate

ITEMS = ["What is 2+2?", "12 + 7 = ?", "Anna, Bert, Carl, Dora, Emil, Fritz", "Paris", "3 5 8 13 21 34 55 89 144", "", "?!"]


def test_excluded_items_are_found_verbatim(spark):
    texts = ["Q: what is 2+2? A: 4", "We compute 12 + 7 = ? here", "They are Anna, Bert, Carl, Dora, Emil, Fritz.", "I saw Paris.", "Capital:\nParis.\nEnd", "so 3 5 8 13 21 34 55 89 144 end"]
    texts += ["what is 2+3", "12.7 and 12, 7", "They are Hans, Bert, Ina, Dora, Jan, Fritz.", "3 5 9 13 22 34 56 89 145", None, "", "?!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.re_parameterised) for r in decontaminate.leaks(docs, bench).collect())
    assert got == [(0, 0, False), (1, 1, False), (2, 2, False), (4, 3, False), (5, 4, False)]
