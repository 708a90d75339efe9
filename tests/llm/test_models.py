"""Near duplicates, the random field, the factorisation machine and the pipeline: brute force and odd rows."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash

import corpus_pipeline
from grainwise.llm import quality_machine, simhash, toxic_spans
from grainwise.llm import textblocks as tb


def fingerprint_by_hand(text):
    text = regex.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = regex.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints_by_hand(monkeypatch):
    monkeypatch.setattr(simhash, "BIT_ROWS", 7)
    random.seed(1)
    texts = [None, "", " \n", "A", "a b", "É é A\tb\x0bc"] + [" ".join(random.choices(["a", "B", "cc", "é", "ÉA"], k=random.randint(0, 30))) for _ in range(60)]
    assert simhash.fingerprints_of(pa.array(texts)).tolist() == [fingerprint_by_hand(t) for t in texts]


def near_codes(n=400):
    rng = random.Random(3)
    codes = [0, (1 << 64) - 1, 1, 3, 7, 15]
    for _ in range(n):
        base = rng.choice(codes) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 4)):
            base ^= 1 << rng.randrange(64)
        codes.append(base)
    return list(dict.fromkeys(codes))


def components_by_hand(codes, k=3):
    label = {c: c for c in codes}

    def find(c):
        while label[c] != c:
            label[c] = label[label[c]]
            c = label[c]
        return c

    for a, b in itertools.combinations(codes, 2):
        if (a ^ b).bit_count() <= k:
            x, y = sorted((find(a), find(b)))
            label[y] = x
    return {c: find(c) for c in codes}


def test_index_joins_exactly_the_close_codes(monkeypatch):
    monkeypatch.setattr(simhash, "PAIR_ROWS", 50)
    codes = np.array(near_codes(), np.uint64)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    a, b = simhash.index_links(np.zeros(len(codes), np.int64), codes, 3)
    assert (np.bitwise_count(codes[a] ^ codes[b]) <= 3).all() and len(a) < len(codes)
    labels = simhash.roots(np.arange(len(codes)), a, b)
    want = components_by_hand([int(c) for c in codes])
    assert len(set(labels.tolist())) == len(set(want.values()))


@pytest.mark.parametrize("hot", [20_000, 15])
def test_components_with_and_without_hot_groups(spark, hot):
    codes = near_codes(150)
    signed = [c - (1 << 64) if c >= 1 << 63 else c for c in codes]
    rows = [(i, c) for i, c in enumerate(signed)] + [(1000 + i, signed[i % 3]) for i in range(40)] + [(None, signed[0])]
    got = {r.fp: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long"), hot_group=hot).collect()}
    want = components_by_hand(codes)
    least = {}
    for i, c in enumerate(codes):
        least[want[c]] = min(least.get(want[c], i), i)
    assert got == {s: least[want[c]] for s, c in zip(signed, codes, strict=True)}


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    lengths = [1, 4, 2, 6]
    score = rng.normal(0, 2, sum(lengths))
    first = np.zeros(len(score), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    start, move = rng.normal(size=2), rng.normal(size=(2, 2))
    got, pair = toxic_spans.marginals(score, first, start, move)
    at = 0
    for n in lengths:
        weights = {}
        for path in itertools.product((0, 1), repeat=n):
            w = start[path[0]] + sum(score[at + i] for i in range(n) if path[i]) + sum(move[a, b] for a, b in zip(path, path[1:]))
            weights[path] = np.exp(w)
        total = sum(weights.values())
        for i in range(n):
            assert got[at + i] == pytest.approx(sum(w for p, w in weights.items() if p[i]) / total)
            if i:
                assert pair[at + i, 1, 1] == pytest.approx(sum(w for p, w in weights.items() if p[i] and p[i - 1]) / total)
        at += n


def toxic_texts(n, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "moon"]
    out = []
    for i in range(n):
        text = [rng.choice(words) + str(rng.randrange(30)) for _ in range(40)]
        if i % 4 == 0:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["Scoundrel", "nastything", "vileword"]))
        out.append(" ".join(text))
    return out, np.array([int(i % 4 == 0) for i in range(n)])


def test_toxic_spans_and_scores(spark):
    texts, label = toxic_texts(400, 1)
    model = toxic_spans.train(pa.array(texts), label, epochs=15)
    fresh, truth = toxic_texts(100, 2)
    score, spans = toxic_spans.score_texts(pa.array(fresh), model)
    assert ((score >= 0.3) == (truth == 1)).all()
    bad = {"scoundrel", "nastything", "vileword"}
    assert all(bad & set(fresh[0][s["start"] : s["end"]].lower().split()) for s in spans[0])
    assert spans[0]
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "é vileword", 0.5), (3, "beta1 " * 20000, 0.5)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in toxic_spans.scored(docs, model, ["doc_id"]).collect()}
    assert got[1].score == got[2].score < 0.3 and 0 <= got[3].score <= 1
    assert [(s.start, s.end) for s in got[None].spans] in ([(2, 10)], [(0, 10)])
    assert toxic_spans.scored(docs.filter("false"), model, ["doc_id"]).count() == 0


def test_classifiers_without_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxic_spans.scored(docs, toxic_spans.fit(docs, labels), ["doc_id"]).where("score between 0 and 1").count() == 10
    assert quality_machine.scored(docs, quality_machine.fit(docs, labels), ["doc_id"]).where("score between 0 and 1").count() == 10
    one = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    assert quality_machine.scored(docs, quality_machine.fit(docs, one), ["doc_id"]).where("score > 0.9").count() == 10


def test_machine_identity_and_scores():
    texts, label = toxic_texts(200, 5)
    texts = [t if y else t.upper().replace(" ", "## ") for t, y in zip(texts, label, strict=True)]
    m = quality_machine.train(pa.array(texts), label, epochs=4)
    who, what, value = quality_machine.rows_of(*tb.flat(pa.array(texts[:3])), m)
    logit, _ = quality_machine.raw_scores(who, what, value, m)
    for i in range(3):
        f, x = what[who == i], value[who == i]
        pairs = sum(float(m.factors[f[a]] @ m.factors[f[b]]) * x[a] * x[b] for a in range(len(f)) for b in range(a + 1, len(f)))
        assert logit[i] == pytest.approx(m.bias + float((m.linear[f] * x).sum()) + pairs, rel=1e-4, abs=1e-4)
    score = quality_machine.score_texts(pa.array([*texts, None, ""]), m)
    assert ((score[:-2] >= 0.5) == (label == 1)).mean() > 0.97 and score[-1] == score[-2]


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "river", "ran", "over", "old", "stones", "and", "was", "cold", "in", "winter", f"w{seed}x{rng.randrange(50)}"]) for _ in range(n)) + "."


def test_pipeline_on_odd_rows(spark):
    item = "the long road over the hill goes to an old and quiet town by the sea"
    rows = [(i, prose(i)) for i in range(30)]
    rows += [(40, rows[3][1]), (41, rows[3][1].upper()), (5, rows[5][1]), (42, prose(42) + " " + item), (43, prose(43) + " password = hunter22hunter2"), (44, "### " * 200), (45, None), (46, ""), (None, prose(47))]
    docs = spark.createDataFrame([(i, t, "en" if i != 7 else None, "s", len(t or ""), 1, "x", 2.0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __near_fp int, __quality_kept string, n_tokens double")
    folder = corpus_pipeline.scratch_path(spark, "pipeline-test")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, folder)
        path = f"{folder}/{name}"
        out.write.parquet(path)
        before, kept = kept, spark.read.parquet(path)
        seen[name] = kept
        if name != "byte_bpe":
            assert kept.columns == before.columns
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=lambda i: (i is None, i))
    assert ids(seen["quality_rules"]) == sorted([*range(30), 5, 40, 41, 42, 43]) + [None]
    assert ids(seen["near_duplicates"]) == [*range(30), 42, 43, None]
    assert ids(seen["decontamination"]) == ids(seen["secrets"]) == ids(seen["byte_bpe"]) == [*range(30), 43, None]
    clean = seen["secrets"].filter("doc_id = 43").first()
    assert "hunter22" not in clean.text and clean.text.endswith("[SECRET]") and clean.n_chars == len(clean.text)
    assert seen["byte_bpe"].filter("n_tokens <> size(ids)").isEmpty()
    empty = docs.filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name
