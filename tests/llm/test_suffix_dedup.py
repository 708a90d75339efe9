"""Repeated byte strings against a dictionary of all strings."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainwise.llm import queries, suffix_dedup, textblocks
from grainwise.llm.suffix_order import repeats, suffix_ranks

SCHEMA = "doc_id long, text string"


def brute(rows, length=100):
    """Rows in the order of their ids; repeated ids only for equal texts."""
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if raw else 0
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((key, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def result(df):
    return sorted(str(tuple(r)[:5]) for r in df.collect())


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "ö", "délta", "x", "the", "of"]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [say(rng.randint(10, 60)) for _ in range(6)]
    texts = [None, "", "short", "a" * 99, "a" * 100, "b" * 1000, "ab" * 400 + "c", "ab" * 300]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.15 and texts[-1]:
            texts.append(texts[rng.randrange(5, len(texts))])  # an exact copy
        elif kind < 0.4 and texts[-1]:
            t = texts[-1]
            k = rng.randrange(len(t))
            texts.append(t[:k] + rng.choice(["Q", "", "ZZ"]) + t[k + 1 :])
        else:
            texts.append(" ".join(rng.choice(passages) if rng.random() < 0.4 else say(rng.randint(1, 40)) for _ in range(rng.randint(1, 6))))
    keys = list(range(len(texts)))
    rng.shuffle(keys)
    return list(zip(keys, texts, strict=True))


def test_bounded_suffix_ranks():
    rng = random.Random(1)
    for _ in range(400):
        s = [rng.randint(1, rng.choice([1, 2, 3])) for _ in range(rng.randint(1, 50))]
        assert np.argsort(suffix_ranks(np.array(s), 10**6)).tolist() == sorted(range(len(s)), key=lambda k: s[k:])
        depth = rng.randint(1, 12)
        ranks = suffix_ranks(np.array(s), depth)
        for i in range(len(s)):
            for j in range(len(s)):
                a, b = s[i : i + depth], s[j : j + depth]
                assert not (a < b and ranks[i] >= ranks[j]) and not (ranks[i] == ranks[j] and a != b)
        data = np.array([rng.randint(65, 66) for _ in range(90)], np.uint8)
        at = np.arange(90 - 10 + 1)
        names = repeats(data, at, 10).tolist()
        assert len(set(names)) == len({(n, data[p : p + 10].tobytes()) for n, p in zip(names, at, strict=True)}) == len({data[p : p + 10].tobytes() for p in at})


def test_anchors_depend_on_the_string_alone(monkeypatch):
    texts = [t for _, t in corpus(6)]
    data, offsets = textblocks.flat(pa.array(texts, pa.string()))

    def anchors():
        text, start, end, anchor = suffix_dedup.contexts(data, offsets, 100)
        return {int(p): (int(t), int(a)) for t, s, e, a in zip(text, start, end, anchor, strict=True) for p in range(s, e - 99)}

    whole = anchors()
    assert sorted(whole) == [p for lo, hi in zip(offsets, offsets[1:], strict=False) for p in range(lo, hi - 99)]
    by_string = {}
    for p, (t, a) in whole.items():
        assert offsets[t] <= p < offsets[t + 1]
        assert by_string.setdefault(data[p : p + 100].tobytes(), a) == a
    monkeypatch.setattr(suffix_dedup, "BLOCK", 150)
    assert anchors() == whole


@pytest.mark.parametrize(("seed", "hot", "order"), [(1, 2000, 1 << 19), (2, 3, 1 << 19), (4, 5, 2000), (5, 0, 1)])
def test_rows_against_brute_force(spark, monkeypatch, seed, hot, order):
    # Small slices and samples: these settings travel with the functions.
    for name, value in (("ORDER_BYTES", order), ("SAMPLE", 2)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert result(suffix_dedup.removed(docs, hot_contexts=hot)) == brute(rows)


def test_many_copies_of_one_passage(spark):
    rng = random.Random(9)
    passage = " ".join(str(rng.random()) for _ in range(12))
    rows = [(i, f"{rng.random()} {passage} {rng.random()}") for i in range(900)] + [(i, passage) for i in range(900, 1300)] + [(1300, "=" * 5000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert result(suffix_dedup.removed(docs, hot_contexts=50)) == brute(rows)


def test_repeated_rows_null_keys_long_text_and_clashes(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcd ") for _ in range(400_000))
    rows = [(None, "n" * 150), (5, "r" + "s" * 120), (5, "r" + "s" * 120), (7, long), (3, long[1000:1500] + "é" * 80)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("row", "key", "spans", "anchor")})
    assert result(suffix_dedup.removed(docs)) == brute(rows)
    kept = {r["doc_id"]: r["kept"] for r in suffix_dedup.removed(docs, with_text=True).collect()}
    assert bytes(kept[7]) == (long[:1000] + long[1500:]).encode()
    assert suffix_dedup.removed(docs.limit(0)).collect() == []


def test_query_columns(spark, tmp_path):
    rows = corpus(11, 30)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert result(queries.op12_suffix_dedup(spark, str(tmp_path))) == brute(rows)
