import zlib

from plumbline.llm.language import WINDOW, fold, identify, learn, op9_language_id, predict_texts, train, windows_of

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_fold(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op9_language_id(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(truth) and len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)


def test_whole_text_counts_and_edges(spark):
    model = train([("aaa bab abba " * 20, "x"), ("zzz yzy zyyz " * 20, "y")] * 30)
    long_tail = "aba " + "zyz yzz " * 3000
    got, scores = predict_texts(model, [None, "", "12 !? 345", "ab ab aab", long_tail, "ZYZ zzy"])
    assert got == ["und", "und", "und", "x", "y", "y"] and scores[:3] == [0.0] * 3
    assert predict_texts(model, ["ab"] * 3 + ["zy"])[0] == ["x"] * 3 + ["y"]
    assert predict_texts(None, ["text"]) == (["und"], [0.0])
    assert windows_of("é" * 1000).shape == (8, WINDOW)
    df = spark.createDataFrame([(None, "ab", "q", 1.0), (1, None, "q", 2.0), (1, "zyz zyy", None, 3.0)], "doc_id long, text string, lang string, score double")
    assert sorted((r.lang_pred for r in identify(df, model).collect())) == ["und", "x", "y"]
    assert identify(df.limit(0), model).count() == 0
    assert learn(df.limit(0)) is None and learn(df.where("lang is null")) is None
    assert df.where(fold("doc_id")).count() == sum(zlib.crc32(str(x).encode()) % 4 == 2 for x in (1, 1))


def test_probabilities_by_plain_loops():
    """The convolution, the maximum over places and the softmax, one filter and place at a time."""
    import math

    import numpy as np

    from plumbline.llm.language import EMBED, FILTERS, WIDTHS

    model = train([("aaa bab abba " * 20, "x"), ("zzz yzy zyyz " * 20, "y"), ("mnm nnm mm n " * 20, "z")] * 5)
    windows = np.concatenate([windows_of("abba zyz mn " * 30), windows_of("é" * 200), windows_of("q")])
    got = model.probabilities(windows)
    for w, p in zip(windows, got):
        h = []
        for k, width in enumerate(WIDTHS):
            for f in range(k * FILTERS, (k + 1) * FILTERS):
                best = -math.inf
                for at in range(WINDOW - max(WIDTHS) + 1):
                    z = sum(float(model.embed[w[at + i], e]) * float(model.filters[i * EMBED + e, f]) for i in range(width) for e in range(EMBED))
                    best = max(best, z)
                h.append(max(0.0, best + float(model.bias[f])))
        z = [sum(x * float(model.out[i, j]) for i, x in enumerate(h)) + float(model.out_bias[j]) for j in range(3)]
        e = [math.exp(x - max(z)) for x in z]
        assert np.allclose(p, [x / sum(e) for x in e], atol=1e-4)


def test_ties_go_to_the_first_language():
    model = train([("same text here " * 9, "b"), ("same text here " * 9, "a")])
    model.out[:, 1] = model.out[:, 0]
    model.out_bias[1] = model.out_bias[0]
    assert model.langs == ["a", "b"] and predict_texts(model, ["any text"])[0] == ["a"]
