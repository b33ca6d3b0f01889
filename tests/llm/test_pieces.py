import hashlib
import struct

import public_tokenizers
import pytest
import sentencepiece

from plumbline.llm.pieces import MODEL, Encoder, encode_digests, encode_frame

TEXTS = ["", " ", "a", "  two  blanks ", "line\n\n feeds\t", "x" * 3000, "▁ already", "é <s>\x00 é", "日本語 テスト 🙂", "don't, a.b ,c", None, "a", "the of " * 5000]


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))


def test_heap_and_list_agendas_agree():
    enc = Encoder(public_tokenizers.path(MODEL))
    for unit in ("▁international", "ooooooooooooo", "▁▁▁▁▁x", "ñandú", "aaaaaaaab"):
        assert enc.long(unit) == enc.short(unit)


def test_ids_and_round_trip_equal_the_library(spark, lib):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    rows = encode_frame(df, public_tokenizers.path(MODEL)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        ids = lib.encode(TEXTS[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.ids == ids and r.decoded == lib.decode(ids) and r.n_disagreements == 0


def test_digests(spark, lib):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in encode_digests(df, public_tokenizers.path(MODEL)).collect():
        ids = lib.encode(TEXTS[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert encode_digests(df.limit(0), public_tokenizers.path(MODEL)).count() == 0


def test_query_equals_the_library_on_a_whole_table(spark):
    import hashlib

    import numpy as np
    import public_tokenizers
    import sentencepiece

    from plumbline.llm.pieces import MODEL, op7_sentencepiece

    small = "/root/testdata/sf0.01"
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    rows = op7_sentencepiece(spark, small).collect()
    assert len(rows) == len(text) and not any(r.n_disagreements for r in rows)
    for r in rows:
        ids = lib.encode(text[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_null_ids_are_kept(spark):
    import public_tokenizers

    from plumbline.llm.pieces import MODEL, encode_frame

    df = spark.createDataFrame([(None, "a b"), (None, None), (1, "a b")], "doc_id long, text string")
    rows = encode_frame(df, public_tokenizers.path(MODEL)).collect()
    assert sorted((r.doc_id is None, len(r.ids)) for r in rows)[-1][0] and len(rows) == 3
