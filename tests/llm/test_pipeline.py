from __future__ import annotations

from collections import Counter

import brute
import corpus_pipeline as pipeline
import edges
from test_decontamination import plain
from test_near_dedup import plain_classes
from test_packing import check


def test_stages_against_plain_readings(spark, tmp_path):
    """Each stage of the whole run on its own input, from what the plain readings say."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r for r in docs.collect()}
    for k, (_, stage) in enumerate(pipeline.STAGES):
        pairs = [(i, r["text"]) for i, r in sorted(rows.items())]
        result = stage(spark, docs, folder)
        path = str(tmp_path / str(k))
        result.write.parquet(path)
        docs = spark.read.parquet(path)
        found = docs.collect()
        if k == len(pipeline.STAGES) - 1:
            check(pairs, found, 4096)
            return
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r["doc_id"]: r for r in found}
        assert len(after) == len(found)
        if k == 0:
            assert set(after) == {i for i, f in brute.quality_figures(pairs).items() if not f[-1]}
        elif k == 1:
            expected = brute.line_dedup(pairs)
            assert {i: brute.sha(r["text"]) for i, r in after.items()} == {i: x[2] for i, x in expected.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in found)
        elif k == 2:
            assert set(after) == set(plain_classes(pairs).values())
        else:
            assert set(after) == {i for i, x in plain([p for p in pairs], items).items() if not x}
        if k != 1:
            assert all(after[i] == rows[i] for i in after)
        rows = after


def test_run_equals_its_stages_on_odd_rows(spark, tmp_path):
    folder = str(tmp_path)
    long_rows = [(i + 100, f"{t} " + "tail word here " * 0 + edges.sentence(__import__("random").Random(i), 70)) for i, t in edges.texts()]
    rows = edges.texts() + long_rows + [(None, long_rows[3][1]), (700, long_rows[5][1]), (700, long_rows[5][1])]
    edges.frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, long_rows[4][1][-300:])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    found = pipeline.run(spark, folder).collect()
    ids = Counter(r["doc_id"] for r in found if r["piece"] == 0)
    assert max(ids.values()) == 1 and None in ids and 104 not in ids and 0 not in ids
