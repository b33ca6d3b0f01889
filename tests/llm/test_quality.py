import re
from collections import Counter

from plumbline.llm.quality import MEASURES, RULES, judge, op6_quality_rules, ordered, prepared, with_measures

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n\t ", "a b c a b c d", "one\none\n\none\n two", "x " * 5000, "a b a b a", "né\x85né # $ <>|", "w1 w2 w3 w4 " * 3 + "z", "A\x0bB\x0cC\rD", "SHOUTING WORDS " * 40, "q" * 100_000]


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover)}


def test_measures_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    rows = with_measures(prepared(df), tuple(MEASURES)).collect()
    for r in rows:
        want = brute(TEXTS[r.doc_id])
        assert {k: r[k] for k in want} == want


def test_order_does_not_change_the_verdict(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = {r.doc_id: r.kept for r in judge(df).collect()}
    other = {r.doc_id: r.kept for r in judge(df, rules=list(RULES)[::-1]).collect()}
    assert whole == other and len(whole) == df.count() and 0 < sum(whole.values()) < len(whole)
    found = ordered(prepared(df), list(RULES))
    assert {r["rule"] for r in found} == set(RULES)
    rate = [r["rejects"] / r["cost"] for r in found]
    assert rate == sorted(rate, reverse=True)


def test_edges(spark):
    df = spark.createDataFrame([(None, None), (1, "a"), (1, "a"), (2, "good words of many kinds " + " ".join(f"w{i}x" for i in range(60)))], "doc_id long, text string")
    got = [(r.doc_id, r.kept) for r in judge(df).collect()]
    assert sorted(got, key=str) == sorted([(None, False), (1, False), (1, False), (2, True)], key=str)
    assert judge(df.limit(0)).count() == 0


def test_query_is_native(spark):
    plan = op6_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
