"""Quality rules for languages that hold a small share of the rows."""

import random

from grainwise.llm import quality_rules

ENGLISH = ["the", "river", "ran", "over", "old", "stones", "and", "was", "cold", "in", "winter"]
RUSSIAN = ["река", "текла", "по", "старым", "камням", "и", "была", "холодной", "зимой", "у", "дома"]
GREEK = ["το", "ποτάμι", "κυλούσε", "πάνω", "από", "παλιές", "πέτρες", "και", "ήταν", "κρύο", "χειμώνα"]


def prose(seed, words, n=120):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def test_a_language_below_a_hundredth_of_the_rows_is_kept(spark):
    rows = [(i, prose(i, ENGLISH), "en") for i in range(600)]
    rows += [(1000 + i, prose(i, RUSSIAN, 2000), "ru") for i in range(3)] + [(1010, "#%& " * 200 + prose(1, RUSSIAN), "ru")]
    rows += [(1020, prose(1, GREEK), "el"), (1021, "λίγα λόγια", "el")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = quality_rules.references(docs)
    assert sorted(found.classes) == sorted(found.words) == ["en", "ru"]
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs, found, ["doc_id"]).collect()}
    # Russian has enough text for a reference of its own, which still rejects junk; Greek has none and keeps the base verdict.
    assert all(got[i] for i in [*range(600), 1000, 1001, 1002, 1020])
    assert not got[1010] and not got[1021]
