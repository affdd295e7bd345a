import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from concordis.llm import line_dedup as ld


def plain(rows, min_sites):
    sites = {}
    for _, text, _, site in rows:
        for line in (text or "").split("\n"):
            sites.setdefault(line, set()).add(site)
    shared = {k for k, v in sites.items() if k and len(v) >= min_sites}
    out = []
    for doc_id, text, _, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if x not in shared]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.fixture
def rows():
    made = [(i, f"own {i}\nCookie notice\n\nshared by {i % 9}\nlast", "en", f"s{i % 12}") for i in range(90)]
    made += [(200 + i, f"nearly\nnearly\n{i}", "en", f"t{i}") for i in range(8)] + [(300 + i, "too few", "en", f"t{i}") for i in range(7)]
    return made + [(400, None, None, None), (401, "", "en", None), (402, "\n\n", "en", "s1"), (403, "last", "en", None)]


@pytest.mark.parametrize("min_sites", [2, 4, 8, 13])
def test_equals_plain_sets(documents, rows, min_sites):
    found = ld.remove_boilerplate(documents(rows), min_sites=min_sites).collect()
    assert sorted((r.doc_id, r.n_lines, r.removed_lines, r.text) for r in found) == plain(rows, min_sites)


def test_estimates_far_from_the_threshold_agree_with_exact_counts(documents, rows):
    """Rough sketches (16 registers) with a wide band still give the exact result."""
    keyed = ld._keyed(documents(rows), "source")
    exact = ld._lines(keyed).groupBy("line_hash").agg(F.countDistinct("site").alias("n")).where("n >= 8")
    rough = ld.boilerplate(ld._lines(keyed), 8, sketch_bits=4, band=0.9)
    assert {bytes(r.line_hash) for r in exact.collect()} == {bytes(r.line_hash) for r in rough.collect()}


def test_query_equals_sql(spark, documents, rows, tmp_path):
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = ld.op6_line_dedup(spark, str(tmp_path)).collect()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, found)) == sorted(duck.execute(ld.OP6_SQL).fetchall())


def test_odd_rows(documents, odd_texts):
    found = ld.remove_boilerplate(documents(odd_texts), min_sites=2).collect()
    assert len(found) == len(odd_texts)
    by_id = {r.doc_id: r for r in found}
    assert by_id[6].text == "" and by_id[7].removed_lines == 1  # one long line on two sites
    assert by_id[8].text == "" and by_id[10].text == ""
    assert hashlib.sha256(by_id[1].text.encode()).hexdigest()
    assert ld.remove_boilerplate(documents([])).collect() == []
