"""Manifests against a plain reading of their definition."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tideline.llm import manifest
from tideline.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def H(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(row, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def plain_tree(nodes, arity):
    """The top and, per leaf, the (left, right) siblings of every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            start = i - i % arity
            paths[k].append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + arity])))
        nodes = [H("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
        at = [i // arity for i in at]
    return nodes[0], paths


def plain(rows, arity=3):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((plain_leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[s] = plain_tree([x[0] for x in groups[s]], arity)
    root, above = plain_tree([trees[s][0] for s in names], arity)
    out = []
    for s, upper in zip(names, above):
        for (digest, r), lower in zip(groups[s], trees[s][1]):
            path = lower + upper
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = plain_leaf(r, text)
            for left, right in path:
                folded = H(left + folded + right)
            out.append((r[0], digest, trees[s][0], root, H("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


def corpus(n, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        source = draw.choice(["hot"] * 6 + ["a", "é", "Z", "", None])
        rows.append((i * 7 - 3, draw.choice(["one\ntwo", "three", "", None, "ü\n\n"]), draw.choice(["en", None]), source, draw.choice([None, i])))
    rows += [rows[0], rows[0], rows[1], (None, "x\ny", None, "hot", 1), (None, "x\ny", None, "hot", 1), (rows[2][0], "other", None, "a", 2)]
    return rows + [(10**6, "alone\n", "de", "single", 1), (10**6 + 1, "alone\n", "de", "other single", 1)]


@pytest.mark.parametrize("n", [0, 1, 2, 25, 90])
def test_query(spark, write_tables, n):
    rows = corpus(n) if n > 2 else [(i, "t\n", "en", "s", 2) for i in range(n)]
    path = write_tables(documents=spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = QUERIES["op12_merkle_manifest"](spark, path).collect()
    assert sorted(map(tuple, got), key=str) == (plain(rows) if rows else [])


@pytest.mark.parametrize("arity", [2, 5])
def test_other_arity_and_names(spark, limits, arity):
    rows = corpus(30)
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("tree"), F.lit("x").alias("left"), F.lit(2).alias("row"))
    leaves = df.withColumn("place", manifest.leaf([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]))
    built = manifest.build(leaves, "source", ["doc_id"], "place", arity)
    want = plain(rows, arity)
    assert built.root == want[0][3] and built.leaves.columns == [*leaves.columns, "path", "subroot"]
    got = built.leaves.select("doc_id", "tree", "left", "row", manifest.proof(F.col("path")), manifest.fold(F.col("place"), F.col("path"))).collect()
    assert sorted(str(r[4]) for r in got) == sorted(x[4] for x in want)
    assert all(r[1:4] == (1, "x", 2) and r[5] == built.root for r in got)
    names = [r["source"] for r in built.subroots.orderBy("place").collect()]
    assert names == sorted(names, key=lambda s: (s is not None, (s or "").encode()))
    assert {r["digest"] for r in built.subroots.collect()} == {x[2] for x in want}


def test_refuses(spark):
    with pytest.raises(ValueError):
        manifest.build(spark.createDataFrame([], "group string, key int, digest binary"), arity=1)
