"""Merkle dataset manifest: a content-addressed tree of row digests, descended by rank digits (operator 13).

Leaves are digests of rows. Per group they stand in key order, and every ``arity`` consecutive nodes become one node, up
to one subroot; the subroots, in group order, become the root in the same way.

The store holds records from a digest to its children. Records of ``PAGE_LEVELS`` levels lie together in one row (a page),
addressed by the digest of its top node, so that a leaf is found in a few joins however large the table is. Requests go
down from the root: at each page, requests with equal leading digits of the rank are one row, the next digits pick the
child, and the children not picked are collected as a path segment. At the leaves the segments are reversed into a proof.

Ranks come from a range-partitioned, stored table: positions inside a partition plus the counts of the partitions before
it. No group is sorted in one task: a page takes at most ``arity ** PAGE_LEVELS`` rows.

Defined cases: null fields are ``-``; a null group or key sorts first; rows of equal group and key stand in the order of
their digests, repeated rows are leaves of their own; an empty table has no root and gives no rows; further columns of any
name are carried as they are. A text is digested as one value, which takes about three times its size in an executor.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grainwise.session import scratch_path

#: Levels of the tree in one stored row.
PAGE_LEVELS = 8
ONE_TREE = "*"
PATH = "array<struct<at:int,others:array<string>>>"


class Tree(NamedTuple):
    """A stored forest: ``nodes`` (tree, label, rank, n, digest, carry), its pages by depth, and (tree, n, digest) of the tops."""

    nodes: DataFrame
    pages: list[DataFrame]
    tops: DataFrame


class Manifest(NamedTuple):
    leaves: Tree
    subroots: Tree
    arity: int


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """The digest of a row: SHA-256 over its encoded fields."""
    return F.sha2(F.concat(*map(encoded, values)), 256)


def _joined(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def _height(n: Column, arity: int) -> Column:
    """Levels above ``n`` leaves."""
    powers = F.array(*[F.lit(arity**k).cast("long") for k in range(63) if arity**k < 1 << 62])
    return F.size(F.filter(powers, lambda p: p < n))


def _div(n: Column, d: int) -> Column:
    """Whole quotient of non-negative longs."""
    return F.call_function("div", n, F.lit(d).cast("long"))


def _left(n: Column, step: int, depth: int) -> Column:
    """Nodes left of ``n`` leaves after ``depth`` pages."""
    return _div(n + F.lit(step**depth - 1), step**depth) if depth else n


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (tree, label, key, digest, carry) stored with their rank in the tree and its size ``n``."""
    spark = rows.sparkSession
    raw, dealt = scratch_path(spark, "merkle-raw"), scratch_path(spark, "merkle-dealt")
    # Stored once, so that the sampling of ranges doesn't digest the texts again. The tie splits repeated rows.
    rows.withColumn("tie", F.monotonically_increasing_id()).write.parquet(raw)
    order = ["tree", "key", "digest", "tie"]
    rows = spark.read.parquet(raw).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    rows.withColumn("at", F.monotonically_increasing_id()).write.parquet(dealt)
    rows = spark.read.parquet(dealt).withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = W.partitionBy("tree").orderBy("part")
    shift = (F.sum("rows").over(before) - F.col("rows") - F.col("first")).alias("shift")
    parts = parts.select("tree", "part", shift, F.sum("rows").over(W.partitionBy("tree")).alias("n"))
    return rows.join(parts, ["tree", "part"]).select("tree", "label", (F.col("at") + F.col("shift")).alias("rank"), "n", "digest", "carry")


def _grow(rows: DataFrame, arity: int) -> Tree:
    """The forest over ``rows``, page level by page level; each level is a table of its own."""
    spark, step = rows.sparkSession, arity**PAGE_LEVELS
    path = scratch_path(spark, "merkle-nodes")
    _ranked(rows).write.parquet(path)
    nodes = spark.read.parquet(path)
    largest = nodes.agg(F.max("n")).first()[0] or 0
    level = nodes.select("tree", "rank", "n", "digest")
    pages, tops = [], level.filter("n = 1").drop("rank")
    while step ** len(pages) < largest:
        depth = len(pages)
        here = _left(F.col("n"), step, depth)
        members = F.sort_array(F.collect_list(F.struct("rank", "digest")))
        groups = level.filter(here > 1).groupBy("tree", "n", _div(F.col("rank"), step).alias("page")).agg(members.alias("members"))
        last = lambda tiers: F.element_at(tiers, -1)
        up = lambda tier: F.transform(
            F.sequence(F.lit(0), F.ceil(F.size(tier) / F.lit(arity)).cast("int") - 1), lambda i: _joined(F.slice(tier, i * arity + 1, arity))
        )
        height = F.least(F.lit(PAGE_LEVELS), _height(here, arity))
        first = F.array(F.transform("members", lambda m: m["digest"]))
        tiers = F.aggregate(F.sequence(F.lit(1), height), first, lambda acc, _: F.concat(acc, F.array(up(last(acc)))))
        stored = scratch_path(spark, "merkle-pages")
        groups.select("tree", "n", "page", tiers.alias("tiers")).select("*", F.element_at(last(F.col("tiers")), 1).alias("digest")).write.parquet(stored)
        pages.append(spark.read.parquet(stored))
        level = pages[-1].select("tree", F.col("page").alias("rank"), "n", "digest")
        tops = tops.unionByName(level.filter(_left(F.col("n"), step, depth + 1) == 1).drop("rank"))
    return Tree(nodes, pages, tops)


def build(rows: DataFrame, group: str, key: str, fields: Sequence[str], arity: int = 2, carry: Sequence[Column] = ()) -> Manifest:
    """The stored manifest of ``rows``; ``carry`` columns stay with the leaves."""
    leaves = rows.select(
        encoded(F.col(group)).alias("tree"),
        F.col(group).alias("label"),
        F.col(key).alias("key"),
        digest(*[F.col(c) for c in fields]).alias("digest"),
        F.struct(F.lit(None).cast("string").alias("none"), *carry).alias("carry"),
    )
    forest = _grow(leaves, arity)
    labels = forest.nodes.groupBy("tree").agg(F.first("label").alias("label"))
    tops = forest.tops.join(labels, "tree").select(F.lit(ONE_TREE).alias("tree"), F.lit(None).cast("string").alias("label"), F.col("label").alias("key"), "digest", F.struct("tree", "n", "digest").alias("carry"))
    return Manifest(forest, _grow(tops, arity), arity)


def _descend(tree: Tree, starts: DataFrame, wanted: DataFrame, arity: int) -> DataFrame:
    """From ``starts`` (tree, n, digest, path, above) to the ``wanted`` leaves (tree, rank, n, carry): carry, digest, path, above.

    ``path`` grows from the top: for each level, the digit picked and the children not picked.
    """
    step = arity**PAGE_LEVELS
    open_ = None
    for depth in reversed(range(len(tree.pages))):
        here, above = _left(F.col("n"), step, depth), _left(F.col("n"), step, depth + 1)
        fresh = starts.filter((here > 1) & (above <= 1)).withColumn("page", F.lit(0).cast("long"))
        open_ = fresh if open_ is None else open_.unionByName(fresh)
        # Requests below one page are one row: at most ``step`` digits, or at the leaves what is asked of them.
        digit = F.pmod(_div(F.col("rank"), step**depth), F.lit(step)).cast("int").alias("digit")
        page = _div(F.col("rank"), step ** (depth + 1)).alias("page")
        if depth:
            asked = wanted.select("tree", page, digit).distinct().select("*", F.lit(None).cast(wanted.schema["carry"].dataType).alias("carry"))
        else:
            asked = wanted.select("tree", page, digit, "carry")
        asked = asked.groupBy("tree", "page").agg(F.collect_list(F.struct("digit", "carry")).alias("asked"))
        # Addressed by content: equal digests have equal children.
        store = tree.pages[depth].groupBy("digest").agg(F.first("tiers").alias("tiers"))
        rows = open_.join(asked, ["tree", "page"]).join(store, "digest")

        def picked(a: Column) -> Column:
            index = lambda j: F.floor(a["digit"] / F.pow(F.lit(arity), j - 1)).cast("int")

            def segment(j: Column) -> Column:
                run = F.slice(F.element_at(F.col("tiers"), j), F.floor(index(j) / arity).cast("int") * arity + 1, arity)
                at = F.pmod(index(j), F.lit(arity)).cast("int")
                others = F.concat(F.slice(run, F.lit(1), at), F.slice(run, at + 2, arity))
                return F.struct(at.alias("at"), others.alias("others"))

            steps = F.transform(F.sequence(F.size("tiers") - 1, F.lit(1)), segment)
            return F.struct(
                a["carry"].alias("carry"), a["digit"].alias("digit"), F.element_at(F.element_at(F.col("tiers"), 1), a["digit"] + 1).alias("digest"), F.concat(F.col("path"), steps).alias("path")
            )

        rows = rows.select("tree", "n", "page", "above", F.explode(F.transform("asked", picked)).alias("p"))
        if depth:
            open_ = rows.select("tree", "n", "p.digest", "p.path", "above", (F.col("page") * step + F.col("p.digit")).alias("page"))
        else:
            open_ = rows.select("p.carry", "p.digest", "p.path", "above")
    lone = starts.filter("n = 1").drop("n").join(wanted.filter("n = 1").select("tree", "carry"), "tree").select("carry", "digest", "path", "above")
    return lone if open_ is None else open_.unionByName(lone)


def proofs(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """carry, leaf, subroot, root and proof of the ``wanted`` leaves (rows of ``manifest.leaves.nodes``; all by default).

    ``proof`` holds, from the leaf up to the root, the position in the run and the digests of the run's others.
    """
    leaves, groups, arity = manifest
    wanted = leaves.nodes if wanted is None else wanted
    start = groups.tops.select("tree", "n", "digest", F.array().cast(PATH).alias("path"), F.col("digest").alias("above"))
    # One row per group that is asked for, with the path from the root.
    asked = groups.nodes.select("*", F.col("carry.tree").alias("of")).join(wanted.select(F.col("tree").alias("of")).distinct(), "of", "left_semi")
    found = _descend(groups, start, asked, arity)
    path = scratch_path(wanted.sparkSession, "merkle-starts")
    found.select("carry.tree", "carry.n", "digest", "path", F.struct(F.col("above").alias("root"), F.col("digest").alias("subroot")).alias("above")).write.parquet(path)
    rows = _descend(leaves, wanted.sparkSession.read.parquet(path), wanted, arity)
    return rows.select("carry", F.col("digest").alias("leaf"), "above.subroot", "above.root", F.reverse("path").alias("proof"))


def proof_digest(proof: Column) -> Column:
    """The digest of the siblings, from the leaf's to the root's."""
    return _joined(F.flatten(F.transform(proof, lambda p: p["others"])))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf digest and a proof lead to."""
    whole = lambda acc, p: F.concat(F.slice(p["others"], F.lit(1), p["at"]), F.array(acc), F.slice(p["others"], p["at"] + 1, F.size(p["others"]) + 1))
    return F.aggregate(proof, leaf, lambda acc, p: _joined(whole(acc, p)))


def is_tampered(doc_id: Column) -> Column:
    """Whether 7 divides the CRC-32 of the decimal id (null: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 0


def verified(docs: DataFrame) -> DataFrame:
    """Every row's leaf, subroot, root and proof, and the root that its leaf folds to after tampering with ``n_chars``."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    altered = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields]
    other = F.when(is_tampered(F.col("doc_id")), digest(*altered))
    rows = proofs(build(docs, "lang", "doc_id", fields, carry=[F.col("doc_id").alias("doc_id"), other.alias("tampered")]))
    rows = rows.withColumn("folded_root", folded(F.coalesce("carry.tampered", "leaf"), F.col("proof")))
    return rows.select("carry.doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
