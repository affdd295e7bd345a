import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from concordis.llm import secrets as sc

ODD = [
    'password="abc123XYZ" token: x secret=short1', "PassWord = AAAAAA api-key=zzzzzzzz apikey='q/w+e_r.t=-'", "aſecret=abcdefgh toKen=abcdefgh",
    "AKIA" + "A" * 15 + " AKIA" + "B9" * 10 + "c", "deadbeef" * 3 + "x" + "0" * 24 + " " + "f" * 23, "token=token=abcdefgh", None, "",
    "é\U0001f600 password:hunter22 end", "secret" + " " * 40 + "=" + " " * 9 + "'abcdef",
]


def plain_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans_equal_plain_patterns(documents, odd_texts):
    rows = list(enumerate(ODD)) + [(100 + i, r[1]) for i, r in enumerate(odd_texts)]
    texts = dict(rows)
    found = sc.scan(documents(rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        spans = plain_spans(texts[r.doc_id])
        line = ",".join(f"{sc.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if not s.startswith("crf")] == line.split(",")


def test_empty_table(documents):
    assert sc.scan(documents([])).collect() == []


def plain_best(emissions, moves):
    best = None
    for tags in itertools.product(range(3), repeat=len(emissions)):
        path = (0, *tags, 0)
        score = sum(moves[a, b] for a, b in zip(path, path[1:])) + sum(emissions[k, t] for k, t in enumerate(tags))
        if best is None or score > best[0]:
            best = (score, tags)
    return best


def score(tags, emissions, moves):
    path = (0, *tags, 0)
    return sum(moves[a, b] for a, b in zip(path, path[1:])) + sum(emissions[k, t] for k, t in enumerate(tags))


@pytest.mark.parametrize("seed", range(30))
def test_viterbi_and_bound(seed):
    rng = np.random.default_rng(seed)
    moves = rng.normal(size=(3, 3))
    moves[0, 2] = -1e4
    emissions = rng.normal(size=(6, 3)) - np.array([0, 1.5, 1.5]) * (seed % 3)
    tags = sc.viterbi(emissions, moves)
    assert score(tags, emissions, moves) == pytest.approx(plain_best(emissions, moves)[0])
    if not sc.may_leave(emissions, moves).any():
        assert score((0,) * 6, emissions, moves) == pytest.approx(plain_best(emissions, moves)[0])


def made_up(rng, secret, shortest=24, longest=40):
    prose = lambda: " ".join(rng.choice(["the", "sea", "under", "Harbour", "and,", "12", "boats"]) for _ in range(rng.randint(10, 60)))
    value = "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(shortest, longest)))
    return f"{prose()} {secret.format(value)} {prose()}"


@pytest.mark.parametrize("form", ["pwd: {}", "pwd: Zx{}Q"])
def test_field_finds_secrets_that_no_base_pattern_names(form):
    """Held-out accuracy: trained on assignments, tested on another credential word and on clean prose."""
    rng = random.Random(1)
    plain = ["", "pages 12: and more", "see the password page"]
    known = ["password={}", "token: {}"]
    texts = [made_up(rng, rng.choice(known if i % 4 == 0 else plain), 12) for i in range(300)]
    field = sc.train(texts)
    new = [made_up(rng, form, 16, 23) for _ in range(50)]
    clean = [made_up(rng, rng.choice(plain)) for _ in range(100)]
    assert sum(bool(s) for s in field.spans(new, sc.Tokens(new))) >= 45
    assert sum(bool(s) for s in field.spans(clean, sc.Tokens(clean))) <= 2
    rows = list(sc._scan_part(new, field))
    assert sum("crf:" in r[4] for r in rows) >= 45 and not any(r[0] + r[1] + r[2] for r in rows)


def test_training_is_repeatable_and_may_have_no_text():
    texts = ["token = abcdef0123456789abcdef01", "nothing here"]
    a, b = sc.train(texts, epochs=5), sc.train(texts, epochs=5)
    assert (a.weights == b.weights).all() and (a.moves == b.moves).all()
    assert sc.train([]).spans(["x"], sc.Tokens(["x"])) == [[]]


def test_masked_copies_hold_no_base_span_at_the_secret():
    rng = random.Random(3)
    text = 'a boat token = "' + "0a1b" * 10 + '" under AKIA' + "Q7" * 10 + " the sea " + "ab12" * 8
    copies = sc.masked(text, rng)
    assert [m for m, _, _ in copies] == [*sc.MASKS, "both", "both"]
    for _, piece, (start, end) in copies:
        assert not any(s < end and start < e for s, _, e in sc.base_spans(piece, True))
        assert piece[start:end].isascii() and " " not in piece[start:end]


def test_recall_of_masked_secrets_in_held_out_documents(spark):
    """Trained on documents of odd id; those of even id hold secrets that no base pattern names."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    field = sc.train(sorted(r.text or "" for r in rows if r.doc_id % 2))
    held_out = [r.text or "" for r in rows if r.doc_id % 2 == 0]
    rng, hits, copies = random.Random(5), 0, 0
    for text in held_out:
        for _, piece, (start, end) in sc.masked(text, rng):
            copies += 1
            hits += any(s <= start and end <= e for s, e in field.spans([piece], sc.Tokens([piece]))[0])
    assert copies >= 30 and hits >= 0.75 * copies
    clean = [t for t in held_out if not sc.base_spans(t, True)]
    assert not any(field.spans(clean, sc.Tokens(clean)))


def test_scan_adds_spans_to_those_of_the_base_patterns(documents):
    """End to end: the table holds secrets outside the base patterns, and rows without id."""
    rng = random.Random(7)
    rows = [(i, made_up(rng, 'token = "{}"' if i % 5 == 0 else "", 30)) for i in range(300)]
    new = {1000 + i: made_up(rng, "passphrase = Zx{}Q", 16, 20) for i in range(20)}
    table = documents(rows + list(new.items()) + [(None, t) for _, t in rows[:50]])
    found = sc.scan(table).collect()
    added = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("crf:")] for r in found if r.doc_id is not None}
    places = {d: (t.index("Zx"), t.index("Zx") + len(next(w for w in t.split() if w.startswith("Zx")))) for d, t in new.items()}
    whole = sum(any(int(s.split(":")[1]) <= a and b <= int(s.split(":")[2]) for s in added[d]) for d, (a, b) in places.items())
    assert whole >= 18
    assert sum(bool(added[d]) for d, t in rows if not sc.base_spans(t, True)) <= 2
    again = sc.scan(table.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_sample_ignores_order_and_missing_ids(documents):
    rows = [(None, f"text {i} token = abcdef0123456789 end") for i in range(40)] + [(i, f"line {i}") for i in range(40)]
    first, second = sc.fit(documents(rows), 5), sc.fit(documents(rows[::-1]).repartition(5), 5)
    assert (first.weights == second.weights).all() and (first.moves == second.moves).all()
