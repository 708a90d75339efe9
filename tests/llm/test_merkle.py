"""Proofs and roots against a plain recomputation of the whole tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from grainwise.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def joined(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return joined(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests, arity):
    """The top and, for each leaf, (position, others) level by level."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p // arity * arity : p // arity * arity + arity]
            paths[k].append((p % arity, run[: p % arity] + run[p % arity + 1 :]))
            at[k] = p // arity
        level = [joined(*level[i : i + arity]) for i in range(0, len(level), arity)]
    return level[0], paths


def brute(rows, arity=2):
    if not rows:
        return []
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    members = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for x in langs}
    trees = {x: tree([leaf_of(r) for r in members[x]], arity) for x in langs}
    root, above = tree([trees[x][0] for x in langs], arity)
    out = []
    for x, upper in zip(langs, above, strict=True):
        for row, path in zip(members[x], trees[x][1], strict=True):
            tampered = list(row)
            if zlib.crc32(str("" if row[0] is None else row[0]).encode()) % 7 == 0 and row[3] is not None:
                tampered[3] += 1
            fold = leaf_of(tampered)
            for at, others in path + upper:
                fold = joined(*others[:at], fold, *others[at:])
            out.append((row[0], leaf_of(row), trees[x][0], root, joined(*(d for _, o in path + upper for d in o)), fold, fold == root))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(map(str, r)))


def test_all_rows_against_brute_force(spark):
    rng = random.Random(5)
    langs = ["en"] * 600 + ["fr"] * 40 + [None, "", "é", "zz"]
    rows = [(i if rng.random() > 0.02 else rng.choice([None, 7]), rng.choice(["a", None]), rng.choice(langs), rng.choice([None, 5]), rng.choice(["t", "", None, "ö\n"])) for i in range(700)]
    rows += [rows[3]] * 300  # one row repeated: a leaf each
    assert ordered(merkle.verified(spark.createDataFrame(rows, SCHEMA)).collect()) == ordered(brute(rows))


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    rows = [(i, "s", "en", 3, "x" * 200_000) for i in range(n)]
    assert ordered(merkle.verified(spark.createDataFrame(rows, SCHEMA)).collect()) == ordered(brute(rows))


def test_other_arity_some_requests_and_clashing_columns(spark):
    rows = [(i, "s", "en" if i % 3 else "de", i, "t") for i in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("tree", "digest", "carry", "rank", "path")})
    built = merkle.build(docs, "lang", "doc_id", ("doc_id", "source", "lang", "n_chars", "text"), arity=4, carry=[F.col("doc_id").alias("doc_id")])
    wanted = built.leaves.nodes.filter("carry.doc_id % 100 = 0")
    got = merkle.proofs(built, wanted).select("carry.doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")), merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    expected = [r[:5] + (r[3],) for r in brute(rows, 4) if r[0] % 100 == 0]
    assert ordered(got) == ordered(expected)
