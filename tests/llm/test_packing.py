import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from concordis.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


TEXT = st.text(alphabet=st.sampled_from("ab é.,'s\n\t   1 9!?A<|>你\U0001f600"), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_ids_equal_the_tokenizer_file(tokenizer, text):
    ids = np.frombuffer(packing.encoder(packing.VOCABULARY).encode(text), dtype="<u4").tolist()
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def padding(length, window):
    return 0 if length & (length - 1) == 0 else window - length


def plain_cost(points, penalty, window):
    places, best = [0, *points], [0.0]
    for k in range(1, len(places)):
        best.append(
            penalty[k - 1]
            + min(best[i] + padding(places[k] - places[i], window) for i in range(k) if places[k] - places[i] <= window)
        )
    return best[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), min_size=1, max_size=60), st.integers(0, 1000))
def test_cuts_have_least_cost(gaps, seed):
    rng = random.Random(seed)
    points = np.cumsum(gaps)
    penalty = np.array([rng.choice([0.0, 2.0, 7.0]) for _ in gaps])
    cuts = packing.choose_cuts(points, penalty, 16)
    price = dict(zip(points.tolist(), penalty))
    cost, start = 0.0, 0
    for end in cuts:
        assert 0 < end - start <= 16
        cost += padding(end - start, 16) + price[end]
        start = end
    assert start == points[-1]
    assert cost == pytest.approx(plain_cost(points.tolist(), penalty, 16))


def test_cut_points_allow_cuts_in_long_sentences():
    ids, ends = np.zeros(5000, dtype=np.int64), np.array([10, 5000])
    points, penalty = packing.cut_points(ids, ends, np.zeros(1, bool), 2048)
    assert np.diff(np.concatenate(([0], points))).max() <= 2048
    assert penalty[points == 10] == 0 and penalty[points == 2058] == packing.FORCED_PENALTY


def check_pieces(rows, pieces, tokenizer):
    """Each id in exactly one piece, sequences without gaps, checksums of the tokenizer's ids."""
    ids = {}
    for doc_id, text, *_ in rows:
        ids.setdefault(doc_id, []).append(tokenizer.encode(text or "", add_special_tokens=False).ids + [1])
    sequences, covered = {}, {}
    for p in pieces:
        same = [x for x in ids[p.doc_id] if len(x) == p.doc_tokens]
        crcs = {zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) for x in same}
        assert p.ids_crc32 in crcs
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        covered[p.doc_id] = covered.get(p.doc_id, 0) + p.length
    assert covered == {k: sum(map(len, v)) for k, v in ids.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return [sum(n for _, n in parts) for parts in sequences.values()]


def test_pieces(documents, odd_texts, tokenizer):
    rows = odd_texts + [(500 + i, f"Line {i} of a text. And more! " * (i * 7 % 40 + 1)) for i in range(150)]
    lengths = check_pieces(rows, packing.pack(documents(rows)).collect(), tokenizer)
    assert sum(padding(n, 2048) for n in lengths) < 0.02 * sum(lengths)


def test_runs_end_with_a_document(documents, tokenizer, monkeypatch):
    rows = [(i, "word and word. " * 90) for i in range(60)]
    ids = [tokenizer.encode(t, add_special_tokens=False).ids + [1] for _, t in rows]
    bodies = [np.array(x, "<u4").tobytes() for x in ids]
    flags = packing.encoder(packing.VOCABULARY).sentence_end
    _, used = packing.pack_run([i for i, _ in rows], bodies, flags, 2048, 5)
    assert used >= sum(map(len, ids)) / 2048


def test_empty_table(documents):
    assert packing.pack(documents([])).collect() == []


PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.just("<|endoftext|>"), st.sampled_from(["<|endoftext", "|>", " ", "  ", "\n", "a", " b.", "é"])), max_size=12))
def test_added_tokens_equal_the_tokenizer_file(parts):
    text = "".join(parts)
    ids = np.frombuffer(packing.encoder(packing.VOCABULARY).encode(text), dtype="<u4").tolist()
    assert ids == PLAIN.encode(text, add_special_tokens=False).ids


def test_pieces_of_texts_with_added_tokens(documents):
    rows = [(1, "a<|endoftext|>b"), (2, "One. <|endoftext|> Two. " * 700), (3, "<|endoftext|>")]
    check_pieces(rows, packing.pack(documents(rows)).collect(), PLAIN)


def test_documents_without_sentences_fill_windows():
    """A run of documents of 2,100 tokens without any sentence end leaves little padding."""
    bodies = [np.zeros(2100, "<u4").tobytes()] * 200
    _, used = packing.pack_run(list(range(200)), bodies, np.zeros(1, bool), 2048, 0)
    assert used * 2048 < 1.05 * 200 * 2100
