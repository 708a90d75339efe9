"""Periodic runs against all periods tried one by one."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainwise.llm import queries, runs
from grainwise.llm.suffix_trees import SuffixTree

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=6, exponent=4):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q) and not any(all(w[k] == w[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w):
    gone = {k for s, n, q in brute(w) for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def test_common_extensions_and_ranks():
    rng = random.Random(2)
    for _ in range(60):
        s = [rng.randint(1, 3) for _ in range(rng.randint(1, 80))]
        tree = SuffixTree(s)
        i, j = np.array([(a, b) for a in range(len(s)) for b in range(len(s)) if a != b] or [(0, len(s))]).T
        same = [next((k for k in range(len(s)) if max(a, b) + k >= len(s) or s[a + k] != s[b + k]), 0) for a, b in zip(i, j, strict=True)]
        assert tree.common(i, j).tolist() == same
        assert np.argsort(tree.rank).tolist() == sorted(range(len(s) + 1), key=lambda k: s[k:])
        assert np.argsort(tree.reversed_rank()).tolist() == sorted(range(len(s) + 1), key=lambda k: [-x for x in s[k:]])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 3)), max_size=6), st.sampled_from([" ", "\n", " \t"]))
def test_texts_against_brute_force(parts, blank):
    w = [x for unit, times, more in parts for x in (unit * times + unit[:more])]
    texts = [blank.join(w), None, " \n", blank.join(w[::-1] + w), blank.join(w)]
    got, whole = runs.found_in(pa.array(texts, pa.string()))
    for text, r, t in zip(texts, got, whole, strict=True):
        assert [tuple(x) for x in r.tolist()] == brute(WORD.findall(text or ""))
        assert t.decode() == collapsed(WORD.findall(text or ""))


def test_long_period_and_long_text():
    unit = [f"w{k}" for k in range(3000)]
    text = " ".join(["head"] + unit * 4 + unit[:10] + ["tail"] * 7 + [str(k) for k in range(40_000)])
    got, _ = runs.found_in(pa.array([text]))
    assert got[0].tolist() == [[1, 12_010, 3000], [12_011, 7, 1]]


def test_query_rows(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", "a " * 5, "a " * 6, "x y " * 8 + "x"] + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 90))) for _ in range(160)]
    rows = [(i if i != 9 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 4
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for key, text in rows:
        w, h = WORD.findall(text or ""), zlib.crc32(("" if key is None else str(key)).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute(w)
        top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        expected.append((key, len(found), *top, 1000 * top[1] // top[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, queries.op11_runs(spark, str(tmp_path)).collect()))) == sorted(map(str, expected))


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a " * 7, "x")], "doc_id long, text string, text_ string").withColumn("runs_", F.lit(1))
    rows = runs.detected(docs, ["doc_id", "text", "text_", "runs_"]).collect()
    assert (rows[0]["runs"][0], rows[0]["collapsed"], rows[0]["text_"]) == ((0, 7, 1), "a", "x")
    assert runs.detected(docs.limit(0), ["doc_id"]).collect() == []
