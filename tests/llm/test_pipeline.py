"""The pipeline stage by stage against plain versions of each, and as a whole."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_chunks import plain_dedup
from test_mixing import plain_copies
from test_quality import plain_counts
from test_simhash import plain_print, plain_roots

from tideline.llm import bpe

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LIBRARY = tiktoken.Encoding(
    "own",
    pat_str=public_tokenizers.PATTERN,
    mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
    special_tokens={},
)


def corpus() -> list[tuple]:
    draw = random.Random(11)
    common = "the of and to in is that for with on a".split()

    def prose(n: int) -> str:
        words = [draw.choice(common) if draw.random() < 0.4 else "".join(draw.choices("abcdefghilmnorst", k=draw.randint(2, 8))) for _ in range(n)]
        return " ".join(w + ("." if draw.random() < 0.1 else "") for w in words)

    passage = prose(80)
    texts = [prose(draw.randint(60, 150)) for _ in range(20)]
    texts += [prose(70) + " " + passage + " " + prose(40) for _ in range(4)]
    texts += [texts[0], texts[0].upper(), texts[3], " ".join(f"q{i}%%% ### $$$" for i in range(80)), "too short", "say it again and again " * 30]
    rows = [(i, t, "en", f"s{i % 3 // 2}", len(t)) for i, t in enumerate(texts)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (None, prose(90), "xx", None, 5), rows[1], rows[1]]
    return rows


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into and comes out of every stage, as it is written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, "").write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out[name] = (before, docs.collect())
    return out


def test_quality(stages):
    before, after = stages["quality rules"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    for r in before:
        n, *_, repeated = plain_counts(r.text)
        assert r.doc_id in gone or not (n < 10 or 100 * repeated > 20 * n)
    # The short, the repetitive, the empty and the symbols go; prose stays.
    assert {27, 28, 29, 100, 101} <= gone and not gone & {*range(24), None}


def test_near_duplicates(stages):
    before, after = stages["near-duplicates"]
    prints = {r.text: plain_print(r.text) for r in before}
    roots = plain_roots(list(prints.values()), 3)
    least: dict[int, int] = {}
    for r in before:
        if r.doc_id is not None:
            root = roots[prints[r.text]]
            least[root] = min(r.doc_id, least.get(root, r.doc_id))
    want = sorted({str(least.get(roots[prints[r.text]])) for r in before})
    assert sorted(str(r.doc_id) for r in after) == want
    assert {24, 25, 26}.isdisjoint(r.doc_id for r in after)


def test_repeated_passages(stages):
    before, after = stages["repeated passages"]
    late = 10**12
    rows = [(late if r.doc_id is None else r.doc_id, r.text) for r in before]
    want = dict(zip([k for k, _ in rows], plain_dedup(rows)))
    assert {late if r.doc_id is None else r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)
    assert sum(r.n_chars for r in after) < sum(len(r.text) for r in before)


def test_mixture(stages):
    before, after = stages["source mixture"]
    sizes = Counter()
    for r in before:
        sizes[r.source] += len(r.text)
    weights = {s: n**0.5 for s, n in sizes.items()}
    rates = {s: weights[s] / sum(weights.values()) * sum(sizes.values()) / sizes[s] for s in sizes}
    want = Counter({tuple(r): plain_copies(17, str(r.doc_id) if r.doc_id is not None else "text:" + r.text, rates[r.source]) for r in before})
    assert Counter(map(tuple, after)) == +want


def test_tokens(stages):
    before, after = stages["token ids"]
    assert len(before) == len(after) and all(r.intact for r in after)
    want = Counter((r.doc_id, tuple(LIBRARY.encode_ordinary(r.text))) for r in before)
    assert Counter((r.doc_id, tuple(np.frombuffer(bytes(r.token_ids), "<u4").tolist())) for r in after) == want
    assert all(r.n_tokens * 4 == len(r.token_ids) for r in after)


def test_whole_run(spark, stages, write_tables):
    path = write_tables(documents=spark.createDataFrame(corpus(), SCHEMA))
    got = Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, path).collect())
    assert got == Counter((r.doc_id, r.n_tokens) for r in stages["token ids"][1])


def test_no_documents(spark, write_tables):
    path = write_tables(documents=spark.createDataFrame([], SCHEMA))
    assert corpus_pipeline.run(spark, path).collect() == []
