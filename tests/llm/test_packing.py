import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm.packing import MODEL, fit, pack, patterns, plan, tokens

TEXTS = ["", None, " ", "a", "it's  the\n\n end. ", "x y " * 3000, "<|endoftext|> in <|endoftext|> it", "é́ 日本語 ½ x² don't\x1cgo　 on", "the of and " * 700, "a", "word " * 40, "Öl'll we'Ve 12,5 __ a_b"]


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once_and_fits(seed):
    rng = np.random.default_rng(seed)
    hist = np.zeros(129, "i8")
    for x in rng.integers(1, 129, 4000) if seed else rng.integers(1, 30, 900):
        hist[x] += 1
    found, used = plan(hist, 128), np.zeros(129, "i8")
    for own, n in found:
        assert n > 0 and sum(own) <= 128
        for x in own:
            used[x] += n
    assert (used == hist).all()
    need = -(-int((hist * np.arange(129)).sum()) // 128)
    assert sum(n for _, n in found) <= need * 1.02 + 2
    assert plan(np.zeros(129, "i8"), 128) == []


def test_fit_finds_an_exact_mixture():
    hist = np.zeros(17, "i8")
    hist[[10, 6, 16, 8, 4]] = [30, 30, 7, 20, 40]
    rows = patterns(16, hist > 0)
    x = fit(rows, hist, 2000)
    used = np.bincount(rows.ravel(), weights=np.repeat(x, 3), minlength=17)
    assert np.abs(used[1:] - hist[1:]).max() < 0.5 and (x >= 0).all()


def ids_of(tok, text):
    return tok.encode(text).tolist()


def test_ids_are_the_library_s():
    tok, lib = tokens(public_tokenizers.path(MODEL)), Tokenizer.from_file(public_tokenizers.path(MODEL))
    assert tok.fast is not None
    for t in [*TEXTS, " " * 300_000 + "a", "\t \n" * 100_000, "ab" * 50_000]:
        assert ids_of(tok, t or "") == lib.encode(t or "", add_special_tokens=False).ids


def test_ids_are_the_library_s_for_every_code_point():
    tok, lib = tokens(public_tokenizers.path(MODEL)), Tokenizer.from_file(public_tokenizers.path(MODEL))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 100_000):
        texts = [f"a{c}b {c} {c}{c}1 {c}x  {c}!'s{c}\n{c}" for c in points[at : at + 100_000]]
        for t, e in zip(texts, lib.encode_batch_fast(texts, add_special_tokens=False)):
            assert ids_of(tok, t) == e.ids


def test_ids_are_the_library_s_on_a_whole_table():
    import pyarrow.parquet as pq

    tok, lib = tokens(public_tokenizers.path(MODEL)), Tokenizer.from_file(public_tokenizers.path(MODEL))
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").to_pylist()]
    for t, e in zip(texts, lib.encode_batch_fast(texts, add_special_tokens=False)):
        assert ids_of(tok, t) == e.ids


@given(st.text(max_size=60) | st.lists(st.sampled_from(["the", " ", "th", "er", "'s", "\n", "  ", "1", "é", "ing", "INT", "日", "_", "-"]), max_size=40).map("".join))
@settings(max_examples=1500, deadline=None)
def test_ids_are_the_library_s_for_any_text(text):
    path = public_tokenizers.path(MODEL)
    assert ids_of(tokens(path), text) == tokens(path).lib.encode(text, add_special_tokens=False).ids


def test_files_that_ranks_do_not_describe_are_left_to_the_library(tmp_path):
    import json

    file = json.load(open(public_tokenizers.path(MODEL)))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        path = tmp_path / "own.json"
        path.write_text(json.dumps(file | change))
        tok = tokens(str(path))
        assert tok.fast is None and ids_of(tok, "Some Text") == Tokenizer.from_file(str(path)).encode("Some Text", add_special_tokens=False).ids
        from plumbline.llm import packing

        packing._tokens.clear()


def test_pack(spark):
    path, lib = public_tokenizers.path(MODEL), Tokenizer.from_file(public_tokenizers.path(MODEL))
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)] + [(3, "a", 5), (None, "b c", 5)], "doc_id long, text string, length int").repartition(3)
    rows = pack(df, path, 256, with_ids=True).collect()
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) <= 256 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        seqs[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.piece, r.start, r.ids))
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    for i, t in enumerate(TEXTS):
        want = lib.encode(t or "", add_special_tokens=False).ids + [0]
        got = sorted(docs[i])
        if i == 3:
            assert len(got) == 2
            continue
        assert [x for _, _, ids in got for x in ids] == want and [p for p, _, _ in got] == list(range(len(got)))
        assert [s for _, s, _ in got] == list(np.cumsum([0] + [len(x) for _, _, x in got])[:-1])
        assert all(len(x) == 256 for _, _, x in got[1:])
    assert Counter(r.doc_id for r in rows)[None] == 1
    assert pack(df.limit(0), path).count() == 0
