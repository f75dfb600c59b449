import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cellweave.llm import packing, rank_queue, token_files, vocabulary
from cellweave.llm.queries import LIBRARY_VOCABULARY, RANK_VOCABULARY


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(LIBRARY_VOCABULARY)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANK_VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


texts = st.text(st.one_of(st.sampled_from(" \n\t,.'aAe1é \x00\x1c²"), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_both_encoders_match_their_libraries(library, plain, text):
    ids = np.frombuffer(vocabulary.library_encoder(LIBRARY_VOCABULARY).encode(text), "<u4").tolist()
    assert ids == library(text)
    encoder = rank_queue.rank_encoder(RANK_VOCABULARY)
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain.encode_ordinary(text)
    assert encoder.decode(encoder.encode(text)) == text.encode()


def test_long_pretokens(plain):
    rng = random.Random(1)
    encoder = rank_queue.rank_encoder(RANK_VOCABULARY)
    for text in ("a" * 3000, "".join(rng.choice("abcdeé") for _ in range(5000)), "=" * 777):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain.encode_ordinary(text)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("which", ["odd", "real"])
def test_packing(request, library, which):
    docs = request.getfixturevalue(which)
    ids = [(d, library(t) + [1]) for d, t in docs.select("doc_id", "text").collect()]
    got = packing.pack(docs, LIBRARY_VOCABULARY, group_pieces=100).collect()
    by_sequence, expected, found = defaultdict(list), defaultdict(int), defaultdict(int)
    for r in got:
        by_sequence[r.sequence_id].append(r)
    for d, x in ids:
        for s in range(0, len(x), 2048):
            expected[d, s, min(2048, len(x) - s), zlib.crc32(np.array(x[s : s + 2048], "<u4").tobytes()), len(x)] += 1
    for r in got:
        found[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    assert found == expected
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == members[0].sequence_tokens <= 2048


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_first_fit_is_the_leftmost_bin_with_room(lengths):
    lengths = sorted(lengths, reverse=True)
    free = [50] * len(lengths)
    for n, (bin_, offset) in zip(lengths, packing.first_fit_decreasing(lengths, 50), strict=True):
        first = next(i for i, f in enumerate(free) if f >= n)
        assert (bin_, offset) == (first, 50 - free[first])
        free[first] -= n


@pytest.mark.parametrize("which", ["odd", "real"])
def test_token_files(request, library, which):
    docs = request.getfixturevalue(which)
    got = token_files.token_files(docs, LIBRARY_VOCABULARY).orderBy("start").collect()
    ids = sorted((((d is not None, d), library(t) + [2]) for d, t in docs.select("doc_id", "text").collect()), key=lambda x: (x[0][0], x[0][1] or 0))
    assert [r.doc_id for r in got] == [d for (_, d), _ in ids]
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((d or -1, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (_, d), x in ids)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**44), max_size=700))
def test_elias_fano(values):
    values = sorted(values)
    told, data = token_files.EliasFano.of(np.array(values, np.uint64)).parts()
    back = token_files.EliasFano.read(told, data)
    assert [back.select(i) for i in range(0, len(values), 7)] == values[::7]
    for lo in range(0, len(values), 97):
        assert back.select(lo, len(values)).tolist() == values[lo:]
        assert back.select(lo, lo + 1).tolist() == values[lo : lo + 1]
    assert back.low.nbytes + back.high.nbytes <= len(values) * (3 + max(0, (values[-1] // len(values)).bit_length())) / 8 + 2 if values else True


def test_reading_takes_offsets_from_select(spark, odd, monkeypatch, tmp_path):
    """Without select there is no boundary, and the whole sequence is never unpacked at once."""
    manifest = token_files.write_tokens(odd, f"file://{tmp_path}", LIBRARY_VOCABULARY)
    files = [token_files.TokenFile(r.file) for r in manifest.orderBy("part").collect()]
    asked, select = [], token_files.EliasFano.select
    monkeypatch.setattr(token_files.EliasFano, "select", lambda self, *a: asked.append(a) or select(self, *a))
    told = [(name, ids.tolist()) for f in files for name, _, ids in f.documents()]
    assert asked and len(told) == odd.count()
    again = [token_files.TokenFile(r.file) for r in manifest.orderBy("part").collect()]
    assert [ids for _, ids in told] == [f.document(i).tolist() for f in again for i in range(f.ends.count)]


def test_ids_that_do_not_fit(tmp_path):
    writer = token_files.TokenWriter(f"file://{tmp_path}/x.tok", 2)
    with pytest.raises(ValueError):
        writer.add(1, np.array([70_000], "<u4"))


def test_rank_queue_documents(odd, plain):
    expected = []
    for d, t in odd.select("doc_id", "text").collect():
        x = np.array(plain.encode_ordinary(t or ""), "<u4").tobytes()
        expected.append((d, len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, rows(rank_queue.encode_documents(odd, RANK_VOCABULARY)))) == sorted(map(repr, expected))


def test_no_rows(nothing):
    assert packing.pack(nothing, LIBRARY_VOCABULARY).count() == 0
    assert token_files.token_files(nothing, LIBRARY_VOCABULARY).count() == 0
    assert rank_queue.encode_documents(nothing, RANK_VOCABULARY).count() == 0
