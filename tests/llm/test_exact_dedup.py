import hashlib
import re

import duckdb
import numpy as np
import pytest

from concordis.llm import exact_dedup as ed


def plain(rows):
    norm = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(norm(text), []).append(doc_id)
    low = lambda x: -1 if x is None else x
    return sorted(
        (low(i), low(max(ids, key=low)), len(ids), hashlib.sha256(body.encode()).hexdigest()) for body, ids in groups.items() for i in ids
    )


@pytest.mark.parametrize("options", [{}, {"capacity": 2}, {"capacity": 2, "key_bits": 2}, {"capacity": 1, "key_bits": 4, "max_depth": 3}])
def test_equals_plain_grouping(documents, odd_texts, options):
    """Splits, overflow pages and colliding keys (few key bits) all give the same groups."""
    rows = odd_texts + [(100 + i, f"copy {i % 3}") for i in range(40)] + [(200 + i, "HOT copy") for i in range(30)]
    found = ed.exact_dedup(documents(rows), **options).collect()
    low = lambda x: -1 if x is None else x
    assert sorted((low(r.doc_id), low(r.keep_id), r.group_size, r.text_sha256) for r in found) == plain(rows)
    assert sum(r.kept for r in found) == len({r.text_sha256 for r in found})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_directory_doubles_and_splits_only_overfull_buckets():
    counts = np.zeros(16, dtype=np.int64)
    counts[0], counts[1], counts[8] = 9, 3, 2
    depth, buckets, pages = ed.directory(counts, 4)
    assert depth == 4
    assert buckets[0] == 0 and buckets[1] == 1 and buckets[2] == buckets[3] == 2
    assert (buckets[8:] == 8).all()
    assert pages[0] == 3 and pages[1:].max() == 1
    assert ed.directory(np.array([1, 1, 0, 0]), 4)[0] == 0


def test_empty_table(documents):
    assert ed.exact_dedup(documents([])).collect() == []
    assert ed.kept_documents(documents([])).collect() == []


def test_kept_documents(documents, odd_texts):
    rows = ed.kept_documents(documents(odd_texts)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in rows) == [-1, 2, 4, 5, 7, 9, 10]
    assert rows[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]


def test_query_equals_sql(spark, tmp_path, documents, odd_texts):
    rows = [r for r in odd_texts if r[0] is not None and r[0] != 8]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = ed.op2_exact_dedup(spark, str(tmp_path)).collect()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = duck.execute(ed.OP2_SQL).fetchall()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found) == sorted(expected)
