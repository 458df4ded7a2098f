"""Operators 1 and 3: exact round trips against the tokenizer itself."""

import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomspark.llm import dac, packing, tokens
from loomspark.llm.tokens import Encoder, word_vocabulary


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(word_vocabulary())


@pytest.fixture(scope="module")
def fast():
    return Encoder(word_vocabulary())


PIECES = st.sampled_from(["a", "Bc", "don't", "'s", "'", "!!", "...", "12", "é", "e\u0301", "Ünï", "Σ", "日本", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\u00a0", "\u0338", "<", "=", "-", "_", "<|endoftext|>", "<|", "|>", "\u2028", "😀", "İ", "ﬁ"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=30).map("".join), max_size=8))
def test_encoder_equals_the_tokenizer(plain, fast, texts):
    assert [x.tolist() for x in fast(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.data())
def test_codes_give_any_id_and_any_range(ids, data):
    ids = np.array(ids, np.uint32)
    codes = dac.Codes(*dac.encode(ids))
    assert len(codes) == len(ids)
    assert codes.extract(0, len(ids)).tolist() == ids.tolist()
    for _ in range(min(5, len(ids))):
        i = data.draw(st.integers(0, len(ids) - 1))
        assert codes[i] == ids[i]
        j = data.draw(st.integers(i, len(ids)))
        assert codes.extract(i, j).tolist() == ids[i:j].tolist()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, plain, edge_documents, edge_rows, tmp_path):
    folder = str(tmp_path / "ids")
    dac.write_ids(edge_documents, folder, word_vocabulary(), target=1000)
    got = sorted(dac.read_documents(spark, folder).collect(), key=lambda r: r.start)
    want, start = [], 0
    for doc, text in sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert [tuple(r) for r in got] == want


def test_token_files_of_no_documents(spark, no_documents, tmp_path):
    dac.write_ids(no_documents, str(tmp_path / "none"), word_vocabulary())
    assert dac.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_packing(plain, edge_documents, edge_rows):
    got = packing.pack(edge_documents, word_vocabulary(), capacity=64).collect()
    want = []
    for doc, text in edge_rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(doc, p, s, len(ids[s : s + 64]), crc(ids[s : s + 64])) for p, s in enumerate(range(0, len(ids), 64))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    places: dict = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in places.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= -(-sum(r.length for r in got) // 64) + 1


def test_packing_of_no_documents(no_documents):
    assert packing.pack(no_documents, word_vocabulary()).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=8), st.integers(0, 40))
def test_fullest_is_the_best_sum(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + i * length for s in sums for i in range(n + 1) if s + i * length <= room}
    used = packing.fullest(room, counts)
    assert sum(k * v for k, v in used.items()) == max(sums)
    assert all(v <= counts[k] for k, v in used.items())


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_places_each_piece_once(counts):
    rows = packing.plan(counts, 64)
    filled: dict = {}
    for length in counts:
        own = rows[rows[:, 0] == length]
        assert own[0, 1] == 0
        for (_, first, sequence, uses, offset), stop in zip(own, [*own[1:, 1], counts[length]], strict=True):
            assert (stop - first) % uses == 0
            for turn in range(stop - first):
                filled.setdefault(int(sequence + turn // uses), []).append((int(offset + turn % uses * length), length))
    for inside in filled.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 64


def test_a_file_of_another_kind_is_encoded_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, fast = Tokenizer.from_file(path), tokens.Encoder(path)
    texts = ["Case Matters HERE", "two  spaces\tand\nlines", None, "", "don't a.b x1"]
    assert [x.tolist() for x in fast(texts)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_an_idle_encoder_is_dropped_and_opened_again(monkeypatch):
    monkeypatch.setattr(tokens, "IDLE", 0.2)
    tokens._open.clear()
    path = tokens.word_vocabulary()
    e = tokens.encoder(path)
    assert tokens.encoder(path) is e
    first = [x.tolist() for x in e(["some words", None])]
    time.sleep(1)
    assert not tokens._open
    assert [x.tolist() for x in e(["some words", None])] == first  # a task that holds it goes on
    assert [x.tolist() for x in tokens.encoder(path)(["some words", None])] == first
