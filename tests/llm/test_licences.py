"""Licence hits against a plain scan."""

from __future__ import annotations

import random
import re

import pytest

from tideline.llm import licences, queries

SCHEMA = "doc_id bigint, text string, hits string, score double"


def plain_hits(text: str | None, threshold: float = 0.8):
    plain = re.sub(licences.GAP, " ", (text or "").lower())
    blocks = re.split("\n *\n[ \n]*", plain)
    units = [("line", i, u) for i, u in enumerate(plain.split("\n"), 1)]
    units += [("paragraph", i, u) for i, u in enumerate(blocks, 1) if "\n" in u]
    units += [("text", 1, plain)] if len(blocks) > 1 else []
    known = [(name, licences.bigrams(t)) for name, texts in licences.TEMPLATES.items() for t in texts]
    out = []
    for kind, number, unit in units:
        ours, best = licences.bigrams(unit), None
        for k, (name, theirs) in enumerate(known):
            score = 2 * (ours & theirs).total() / (ours.total() + theirs.total()) if ours else 0
            if score >= threshold and (best is None or (score, -k) > best[:2]):
                best = (score, -k, name)
        if best:
            out.append((kind, number, best[2], best[0]))
    return out


def texts() -> list[str | None]:
    mit, apache = licences.TEMPLATES["MIT"][3], licences.TEMPLATES["Apache-2.0"][1]
    words = mit.split()
    wrapped = "\n".join(" ".join(words[i : i + 11]) for i in range(0, len(words), 11))
    draw = random.Random(2)
    worn = " ".join(w for w in words if draw.random() > 0.08)
    return [
        "Some prose here.\nReleased under the MIT License.\nMore prose.",
        "licensed under cc by nc 4 0!",
        "Licensed under CC BY 4.0.\n\nAll rights reserved.",
        mit, wrapped, f"Copyright\n\n{wrapped}\n\nEnd of it.", worn, apache + "\n" + mit, "x\n \n" + apache,
        "the the the the " * 20, "reserved", "", " \n\n\n ", None, "ÄÖ İ all RIGHTS reserved", "a b " * 30_000,
        "Licensed under the Apache License, Version 2.0.\n" * 3,
    ]


@pytest.mark.parametrize("threshold", [0.8, 0.5, 1.0])
def test_hits(spark, threshold):
    rows = [(i, t, "x", 0.0) for i, t in enumerate(texts())]
    got = licences.scan(spark.createDataFrame(rows, SCHEMA), threshold=threshold)
    assert got.columns == ["doc_id", "text", "score", "hits"]
    for r in got.collect():
        assert [(h.kind, h.number, h.licence, h.score) for h in r.hits] == plain_hits(r.text, threshold), r.doc_id


def test_refused(spark):
    df = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(ValueError):
        licences.scan(df, threshold=0)
    with pytest.raises(ValueError):
        licences.scan(df, templates={"x": ["one"]})


def test_query(spark, write_tables):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "All rights reserved."), (0, texts()[0])]
    path = write_tables(documents=spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = queries.op9_licence_scan(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        hits = plain_hits("All rights reserved." if r.doc_id is None else texts()[r.doc_id])
        assert r.n_hits == len(hits)
        assert r.score == max((h[3] for h in hits), default=None)
    assert queries.op9_licence_scan(spark, path).limit(0).collect() == []


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_a_unit_without_anchor_words_stays_below(threshold):
    for name, own in licences.TEMPLATES.items():
        for text in own:
            counts = licences.bigrams(text)
            needed = licences.anchors(counts, threshold)
            # The best unit without these words has every bigram that does not touch them.
            shared = sum(c for g, c in counts.items() if needed.isdisjoint(g.split()))
            assert 2 * shared / (shared + counts.total()) < threshold, name
