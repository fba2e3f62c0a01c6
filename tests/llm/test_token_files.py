import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kpiforge.llm import token_files
from kpiforge.llm.queries import tokenizer_path
from tests.llm.helpers import docs_frame, odd_documents, sentence


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2 ** 64 - 1)), max_size=3_000))
def test_codec_round_trip(ids):
    x = np.array(ids, dtype=np.uint64)
    words, blocks = token_files.encode_blocks(x)
    assert (token_files.decode_blocks(words, blocks, len(x)) == x).all() if len(x) else len(words) == 0


def test_packing_is_dense():
    words, _ = token_files.encode_blocks(np.zeros(1_024, dtype=np.uint64))
    assert len(words) == 5   # 240 zeros a word
    words, _ = token_files.encode_blocks(np.full(1_024, 2 ** 15 - 1, dtype=np.uint64))
    assert len(words) == 256
    words, _ = token_files.encode_blocks(np.full(10, 2 ** 64 - 1, dtype=np.uint64))
    assert len(words) == 20   # escapes


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def expected(rows, tokenizer):
    """(doc_id, n_tokens, crc) in id order, null first, and the running starts."""
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out, start


def test_files_give_the_librarys_ids(spark, tokenizer):
    rows = [(i * 3 % 101, f"doc {i}: " + sentence(i, tag="tok")) for i in range(101)]
    got = token_files.encode_documents(docs_frame(spark, rows), tokenizer_path()).orderBy("doc_id").collect()
    want, total = expected(rows, tokenizer)
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == want
    starts = np.cumsum([0, *[w[1] for w in want]])
    assert [r.start for r in got] == starts[:-1].tolist() and starts[-1] == total


def test_odd_rows_small_files_and_token_output(spark, tokenizer):
    rows = odd_documents()
    d = docs_frame(spark, rows).withColumns({"spread": F.lit(1), "start": F.lit("s")})
    manifest = token_files.write_token_files(d, tokenizer_path(), file_ids=64)
    got = token_files.read_token_files(manifest, tokens=True).orderBy("start").collect()
    want, _ = expected(rows, tokenizer)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(a), b, c) for a, b, c in want)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    assert all(r.ids[-1] == 0 and len(r.ids) == r.n_tokens for r in got)
    digests = token_files.read_token_files(manifest).orderBy("start").collect()
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in digests] == [(r.start, r.n_tokens, r.ids_crc32) for r in got]


def test_pieces_equal_whole_texts(tokenizer):
    tok = token_files.Tokens(tokenizer_path())
    texts = ["a  b", " a", "a ", "", " ", "\n a b", "a \n b", "x<|endoftext|>y z", "don't  it's 12 34", "a\tb c  ",
             "naïve café here 　 there", "tab\t tab", "end.\nNext (word) \"quoted\" it's"]
    plain = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert tok.encode(texts) == plain
    tok.MOST_PIECES = 1   # forgets its pieces and goes on
    assert tok.encode(texts) == plain and tok.encode(texts[::-1]) == plain[::-1]


def test_empty_table(spark):
    assert token_files.encode_documents(docs_frame(spark, []), tokenizer_path()).count() == 0


def test_pieces_that_are_given_up_are_encoded_again():
    from tokenizers import Tokenizer

    tok, tokenizer = token_files.Tokens(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    tok.MOST_PIECES = 60
    for batch in range(12):
        texts = [" ".join(f"common{k % 7} single{batch}x{k}" for k in range(batch % 5, 25)), f"Head{batch} of it ", " lead"]
        want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        assert tok.encode(texts) == want
    assert len(tok.size) <= 120
