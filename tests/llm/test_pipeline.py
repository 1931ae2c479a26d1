"""Each stage of the pipeline against a brute-force version, on its own input."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from shelfcast.llm import quality
from shelfcast.llm.common import stored
from test_llm_operators import contaminated, encoded, jaccard_groups, words




@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    path = str(tmp_path_factory.mktemp("corpus"))
    long = [words(rng, 80, 3000) for _ in range(12)]
    item = words(rng, 20, 3000)
    rows = [(i, t, "en", f"s{i}", len(t), "x") for i, t in enumerate(long)]
    rows += [(20, long[0], "en", "s", len(long[0]), "x"), (21, long[1] + " tail", "en", "s", None, "x"),
             (22, None, None, None, None, None), (23, "", "en", "s", 0, "x"), (24, "too short", "en", "s", 9, "x"),
             (25, f"{words(rng, 40, 3000)} {item} {words(rng, 9, 3000)}", "en", "s", 1, "x"),
             (26, f"{words(rng, 60, 3000)} é token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" and "
                  "0123456789abcdef end", "en", "s", 1, "x"), (None, words(rng, 70, 3000), "en", "s", 1, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string"
                          ).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(
        f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stored(stage(spark, docs, folder), "stage")
        seen[name] = (before, out, docs)
        if name != "packing":
            assert out.columns == columns
        docs = out

    def texts(name):
        return sorted(((r.doc_id, r.text) for r in seen[name][1].collect()), key=str)

    before, _, first = seen["quality rules"]
    kept = {r.doc_id for r in quality.judge_quality(first).filter("kept").collect()}
    assert texts("quality rules") == sorted((r for r in before if r[0] in kept), key=str)
    assert not {22, 23, 24} & {d for d, _ in texts("quality rules")}

    before = seen["near-duplicates"][0]
    stays = [r for r, g in zip(before, jaccard_groups(before), strict=True) if g[3]]
    assert texts("near-duplicates") == sorted(stays, key=str)
    assert {d for d, _ in before} - {d for d, _ in stays} == {20, 21}

    before = seen["decontamination"][0]
    clean = [r for r, g in zip(before, contaminated(before, [(1, spark.read.parquet(
        f"{folder}/benchmark.parquet").filter("item_id = 1").first().text)]), strict=True) if not g[5]]
    assert texts("decontamination") == sorted(clean, key=str) and 25 not in {d for d, _ in clean}

    masked = dict(texts("secret scan"))
    want = dict(seen["secret scan"][0])
    want[26] = re.sub(r"token = \"[0-9a-f]{40}|0123456789abcdef", corpus_pipeline.MASK, want[26])
    assert masked == want
    assert all(r.n_chars == len(r.text) for r in seen["secret scan"][1].collect())

    whole = {}
    for r in sorted(seen["packing"][1].collect(), key=lambda r: r.start):
        whole.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u2").tolist())
    assert whole == {d: encoded(t) for d, t in seen["packing"][0]}


def test_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), "empty")
        assert docs.count() == 0
