"""Re-parameterised benchmark items whose new values coincide."""

from grainwise.llm import decontaminate

ITEM = "Yesterday Tom has 5 apples and 7 pears in the basket, so how many fruits are there at home with Tom?"


def test_new_values_may_coincide(spark):
    texts = [ITEM.replace("Tom", "Ann").replace("5", "4").replace("7", "4"), ITEM.replace("with Tom", "with Bob"), ITEM.replace("5 apples", "3 km").replace("7 pears", "3 km")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(0, ITEM), (1, ITEM.replace("5 apples", "5 km").replace("7 pears", "3 miles"))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect() if r.re_parameterised}
    assert (0, 0) in got and (2, 1) in got
