"""The pipeline's stages against brute force, on the smallest documents and on odd rows."""

import corpus_pipeline
import pytest
from test_near_copies import brute_stays
from test_operators import brute_rules, texts_of

from cairn.llm import piece_codec, secret_scan
from cairn.llm.common import stored


def test_stages(spark, docs, sf):
    stage = dict(corpus_pipeline.STAGES)
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = stored(stage[names[0]](spark, docs, sf))
    assert kept.columns == docs.columns
    base_ok = {i for i, t in texts_of(docs) if not brute_rules(t)[-1]}
    assert {i for i, _ in texts_of(kept)} <= base_ok
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    assert base_ok & good <= {i for i, _ in texts_of(kept)}
    single = stored(stage[names[1]](spark, kept, sf))
    assert sorted(i for i, _ in texts_of(single)) == brute_stays(texts_of(kept))
    clean = stored(stage[names[2]](spark, single, sf))
    s = secret_scan.Scanner()
    assert dict(texts_of(clean)) == {i: secret_scan.redacted(t, s.spans(t)) for i, t in texts_of(single)}
    mixed = stored(stage[names[3]](spark, clean, sf))
    assert mixed.columns == docs.columns
    counts = {}
    for i, _ in texts_of(mixed):
        counts[i] = counts.get(i, 0) + 1
    assert max(counts.values()) <= 3 and set(counts) <= {i for i, _ in texts_of(clean)}
    last = stage[names[4]](spark, mixed, sf)
    p = piece_codec.Pieces.load()
    assert sorted((r.doc_id, p.decode(r.piece_ids)) for r in last.collect()) == sorted(texts_of(mixed))


@pytest.mark.parametrize("which", ["odd_docs", "no_docs"])
def test_odd_rows(request, spark, which, sf):
    docs = request.getfixturevalue(which)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf))
    assert docs.count() <= 10
