import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import bpe, queries

from ..conftest import SF_SMALL

PATH = public_tokenizers.path(queries.BPE_RANKS)
VOCABULARY = bpe.Vocabulary.load(PATH)
ENCODER = bpe.Encoder(VOCABULARY, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
    mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("abdehinortu ÄéßÑ'sl  \n0123", max_size=80))
def test_as_the_library(text):
    ids = ENCODER.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert ENCODER.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=30), st.integers(0, 30), st.integers(0, 30), st.binary(max_size=8))
def test_appends_and_edits_match_a_fresh_table(data, a, b, new):
    a, b = sorted((min(a, len(data)), min(b, len(data))))
    table = bpe.PrefixTable(VOCABULARY, data[:a])
    table.append(data[a:])
    assert table.last == bpe.PrefixTable(VOCABULARY, data).last
    table.edit(a, b, new)
    edited = data[:a] + new + data[b:]
    assert table.tokens() == bpe.PrefixTable(VOCABULARY, edited).tokens()
    assert b"".join(VOCABULARY.token_bytes[t] for t in table.tokens()) == edited


def test_documents_with_nulls_empty_long_repeated_and_other_columns(spark, documents):
    rows = [(1, None), (2, ""), (3, "the of and " * 3000 + "=" * 5000), (4, "copy x"), (4, "copy x"), (None, "no id")]
    df = documents(rows).withColumnRenamed("lang", "ids").withColumnRenamed("source", "n_tokens")
    got = sorted(map(tuple, bpe.digests(df, PATH, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for i, text in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH)
    assert sorted((str(r.doc_id), bytes(r.bytes)) for r in back.collect()) == sorted((str(i), (t or "").encode()) for i, t in rows)
    kept = {str(r.doc_id): r.ids for r in bpe.digests(df, PATH, public_tokenizers.PATTERN, keep_ids=True).collect()}
    assert kept["3"] == LIBRARY.encode_ordinary(rows[2][1])


def test_empty_table(documents):
    assert bpe.digests(documents([]), PATH, public_tokenizers.PATTERN).collect() == []


@pytest.mark.parametrize("sf", [SF_SMALL])
def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op2_bpe(spark, sf).collect():
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
