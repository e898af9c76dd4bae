import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tests.llm.conftest import ODD, SF  # noqa: E402
from tidemark.llm import bpe, tokens  # noqa: E402

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}
OWN = {WORD: bpe.WordBpe(WORD), BYTE: tokens.ByteBpe(BYTE)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t aAbé'ßΣ1².,<|> \x1c"), st.characters(codec="utf-8")), max_size=60), max_size=5))
def test_ids_equal_the_library(texts):
    for path, own in OWN.items():
        want = [LIBRARY[path].encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in own.encode(texts)] == want


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_pack_round_trip(values):
    v = np.array(values, np.uint32)
    assert tokens.unpack(*tokens.pack(v), len(v)).tolist() == values


def test_special_tokens_and_decode():
    t = "<|startoftext|>Hi <|endoftext|> it's <|endoftext|"
    want = LIBRARY[WORD].encode(t, add_special_tokens=False).ids
    got = OWN[WORD].encode([t])[0]
    assert got.tolist() == want
    assert OWN[WORD].decode(got) == LIBRARY[WORD].decode(want, skip_special_tokens=False)


def test_bpe_on_odd_rows(odd, none):
    rows = bpe.encode_documents(odd, WORD).collect()
    assert len(rows) == len(ODD)
    want = sorted((i if i is not None else -1, len(LIBRARY[WORD].encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ODD)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in rows) == want
    assert bpe.encode_documents(none, WORD).count() == 0


def test_token_files_on_odd_rows(odd, none):
    blocks, ranked = tokens.write_tokens(odd, BYTE)
    rows = tokens.digest(tokens.decode_blocks(blocks, ranked), blocks).collect()
    want = []
    for i, t, _ in ODD:
        ids = np.array([*LIBRARY[BYTE].encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((-1 if i is None else i, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == sorted(want)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    blocks, ranked = tokens.write_tokens(none, BYTE)
    assert tokens.digest(tokens.decode_blocks(blocks, ranked), blocks).count() == 0


def test_op2_against_the_library_in_order(spark):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.op2_token_ids(spark, SF).collect()}
    at = 0
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = np.array([*LIBRARY[BYTE].encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert got[r.doc_id] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_rows_without_an_id_are_spread(spark):
    df = spark.createDataFrame([(None, f"text {i}") for i in range(500)], "doc_id long, text string")
    blocks, ranked = tokens.write_tokens(df, BYTE)
    assert blocks.select("part").distinct().count() > 1
    assert tokens.digest(tokens.decode_blocks(blocks, ranked), blocks).selectExpr("count(*) = 500 and max(start + n_tokens) = sum(n_tokens) fine").first().fine


def test_op6_against_the_library(spark):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op6_bpe(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = LIBRARY[WORD].encode(r.text or "", add_special_tokens=False).ids
        text = LIBRARY[WORD].decode(ids, skip_special_tokens=False)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_ids_without_places_equal_the_library():
    """The library is asked for ids alone, never for places in the text, on new chunks, first chunks and whole texts."""
    from tidemark.llm.bpe import tokenizer_path
    from tidemark.llm.tokens import ByteBpe

    class IdsOnly:
        def __init__(self, tok):
            self.encode_batch_fast = tok.encode_batch_fast

    texts = ["<|endoftext|> a  b ", "a <|endoftext|> b", "  x", "x \n y", "", "a  b", " ", "a b\t c", "über straße 𝒳 日本", "one two three two one", "tail "]
    bpe = ByteBpe(tokenizer_path("byte_bpe_50k.json"))
    want = [bpe.tok.encode(t, add_special_tokens=False).ids for t in texts]
    bpe.tok = IdsOnly(bpe.tok)
    assert [x.tolist() for x in bpe.encode(texts)] == want and [x.tolist() for x in bpe.encode(texts)] == want
