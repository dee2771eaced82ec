from __future__ import annotations

import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.conftest import odd_rows

from skyfold.llm import tokens
from skyfold.llm.common import documents
from skyfold.llm.queries import vocabulary
from skyfold.llm.seekable import Reader, Writer
from skyfold.session import scratch_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def plain(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [tokens.END_ID]


def expected(library, rows):
    out, start = [], 0
    for i, t in rows:
        ids = plain(library, t)
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"aAzZ'sßÉΣİſ.,<|>12é# \t\n", "\u0301", "\u00a0", "\u2028", "\x1c", "\x85", "<|endoftext|>", "<|EndOfText|>", "'ll", "fi", "H\u0331", "J\u030c", "I\u0307", "$$", "&.'", "K"]), max_size=30).map("".join))
def test_words_alone_encode_as_whole_texts(text):
    e = tokens.encoder(vocabulary())
    want = e.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(e.encode([text.encode()])[0], "<u4").tolist() == want


def test_small_store_of_words(library):
    e = tokens.WordEncoder(vocabulary(), kept=8)
    for text in ("one two three four five", "six seven eight nine", "one six ten", " ".join(f"x{i}" for i in range(50))):
        assert np.frombuffer(e.encode([text.encode()])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_file_round_trip(spark, library):
    docs = documents(spark, "/root/testdata/sf0.001")
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(docs, path, vocabulary(), files=3)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = sorted(tuple(r)[:4] for r in tokens.read_tokens(spark, path).collect())
    assert got == expected(library, rows)
    ids = {r.doc_id: r.ids for r in tokens.read_tokens(spark, path).collect()}
    assert all(ids[i] == plain(library, t) for i, t in rows)


def test_odd_rows(spark, odd, none, library):
    got = [tuple(r) for r in tokens.encode_and_read(odd, vocabulary()).collect()]
    rows = [(r[0], r[1]) for r in odd_rows()]
    order = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((order(r), r[2], r[3]) for r in got) == sorted((order(r), r[2], r[3]) for r in expected(library, rows))
    ends = 0
    for r in sorted(got, key=lambda r: r[1]):  # starts are gapless and ids ascend
        assert r[1] == ends
        ends += r[2]
    assert [order(r) for r in sorted(got, key=lambda r: r[1])] == sorted(order(r) for r in got)
    assert tokens.encode_and_read(none, vocabulary()).count() == 0


def written(docs, frame_bytes):
    out = io.BytesIO()
    w = Writer(out, frame_bytes)
    for i, raw in docs:
        w.add(i, raw)
    w.close()
    return out.getvalue()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 5)), st.lists(st.integers(0, 2**32 - 1), max_size=30)), max_size=12), st.sampled_from([4, 16, 64, 4096]))
def test_random_access(docs, frame):
    docs = [(i, np.array(ids, "<u4").tobytes()) for i, ids in docs]
    r = Reader(pa.BufferReader(written(docs, frame)))
    assert [(int(i) if k else None) for i, k in zip(r.ids, r.known, strict=True)] == [i for i, _ in docs]
    for n in reversed(range(len(docs))):
        assert r.tokens(n) == docs[n][1]


def test_frames_are_plain_zstandard_and_checked():
    docs = [(i, np.arange(i * 10, i * 10 + 500).astype("<u4").tobytes()) for i in range(9)]
    raw = written(docs, 1024)
    whole = b""
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True) as s:
        whole = s.read()
    assert whole == b"".join(d for _, d in docs)
    reader = Reader(pa.BufferReader(raw))
    asked = []
    original = reader._at
    reader._at = lambda start, length: asked.append(length) or original(start, length)
    reader.tokens(4)
    assert 0 < len(asked) <= 3  # only the frames of that document
    broken = bytearray(raw)
    broken[len(raw) // 6] ^= 0xFF
    with pytest.raises((ValueError, zstandard.ZstdError)):
        r = Reader(pa.BufferReader(bytes(broken)))
        [r.tokens(i) for i in range(9)]
