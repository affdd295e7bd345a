import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from concordis.llm import fingerprint as fg


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def edited(texts):
    out = []
    for i, text in enumerate(texts):
        k = len(text) // 4
        out.append(text[: len(text) - k] + texts[(i + 1) % len(texts)][:k])
    return out


def test_estimates_the_share_of_common_shingles(spark, documents):
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{rng.integers(5000)}" for _ in range(int(rng.integers(3, 900)))) for _ in range(120)]
    texts[40] = texts[41]
    rows = sorted(fg.fingerprints(documents(list(enumerate(texts)))).collect())
    changed = edited(texts)
    common = lambda a, b: len(a & b) / len(a | b)
    errors = [r.near_edited - common(shingles(t), shingles(c)) for r, t, c in zip(rows, texts, changed)]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05
    assert rows[40].near_next == 1.0 and rows[40].fingerprint == rows[41].fingerprint
    assert np.mean([r.near_next for r in rows if r.doc_id != 40]) < 0.03
    assert [r.edited_sha256 for r in rows] == [hashlib.sha256(c.encode()).hexdigest() for c in changed]
    assert {len(r.fingerprint) for r in rows} == {256}


def test_likeness_counts_equal_bins(spark):
    a, b = [0x0123456789ABCDEF] * 16, [0x0123456789ABCD00] * 16
    row = spark.range(1).select(fg.likeness(F.lit(a), F.lit(b)).alias("x"), fg.likeness(F.lit(a), F.lit(a)).alias("y")).first()
    assert abs(row.x - (14 / 16 - 1 / 16) / (15 / 16)) < 1e-12 and row.y == 1.0


def test_densification_fills_every_bin(spark):
    frame = spark.createDataFrame([("one two three four five",), ("one two three four five six seven",)], "text string")
    rows = fg.with_fingerprint(frame, "text", "fp").collect()
    digits = {f"{v & (2**64 - 1):016x}" for v in rows[0].fp}
    assert len(set("".join(digits))) == 1  # a single shingle fills all bins with its value
    assert all(len(r.fp) == 16 for r in rows)


def test_no_python_in_the_plan(documents):
    plan = fg.fingerprints(documents([(1, "a b c"), (2, "d")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(documents, odd_texts):
    rows = fg.fingerprints(documents(odd_texts)).collect()
    assert len(rows) == len(odd_texts)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].fingerprint == by_id[4].fingerprint == "0" * 256
    assert by_id[6].near_next == 1.0 and by_id[6].n_chars == len(odd_texts[5][1])
    one = fg.fingerprints(documents([(5, "abcdefgh")])).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_empty_table(documents):
    assert fg.fingerprints(documents([])).collect() == []
