import numpy as np
import pytest

import corpus_pipeline as cp
from concordis.llm.common import DOCUMENT_COLUMNS, saved


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(9)
    words = [f"{a}{b}" for a in ("ta", "ro", "mi", "ne", "su") for b in ("l", "n", "ra", "to", "ve", "s")]
    text = lambda: " ".join(rng.choice(words, 120)).capitalize() + "."
    rows = [(i, text(), "en", f"s{i % 4}") for i in range(300)]
    rows += [(1000 + i, rows[i][1].upper() if i % 2 else rows[i][1], "en", "s0") for i in range(20)]
    rows += [(2000 + i, rows[50 + i][1] + " end", "en", "s1") for i in range(20)]
    rows += [(3000 + i, "".join(chr(c) for c in rng.integers(33, 126, 400)), "en", "s2") for i in range(20)]
    rows += [(4000, None, None, None), (4001, "", "en", "s1")]
    documents(rows).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 300, 2)] + [(3000, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def least_of_near_copies(spark, folder, ids):
    """The least id of each group of texts with 5-word Jaccard similarity of 0.8 or more, by all pairs."""
    shingles = {}
    for r in cp.table(spark, folder, "documents").collect():
        words = (r.text or "").lower().split()
        if r.doc_id in ids and words:
            shingles[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    group = {i: i for i in shingles}
    for a in sorted(shingles):
        for b in sorted(shingles):
            if a < b and group[a] != group[b] and 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return {i for i in ids if group.get(i, i) == i}


def test_stages(spark, folder):
    docs, left = cp.table(spark, folder, "documents"), []
    for name, stage in cp.STAGES[:-1]:
        docs = saved(stage(spark, docs, folder), "pipeline")
        assert docs.columns == list(DOCUMENT_COLUMNS), name
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
    quality, exact, near, mixture = left
    assert not quality & set(range(3000, 3020)) and len(quality & set(range(300))) >= 295
    assert not exact & {i for i in range(0, 20, 2)} and 1000 in exact
    assert near == least_of_near_copies(spark, folder, exact)
    assert mixture <= near
    packed = cp.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == mixture


def test_run(spark, folder):
    rows = cp.run(spark, folder).collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].__fields__)
    assert max(r.offset + r.length for r in rows) <= 2048


def test_empty_tables(spark, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
