import re

import pytest

from plumbline.llm import licences as L


def windows(text, begins=lambda x, b: True):
    """The best coefficient of each longer template over all runs of as many words, one by one."""
    own = re.findall(r"[^\W_]+", text.lower())
    run, best = [f"{x} {y}" for x, y in zip(own, own[1:])], {}
    for name, t in L.TEMPLATES.items():
        b, m = set(L.bigrams(t)), L.n_words(t)
        if m >= L.WINDOW and len(b & set(run)) >= 0.6 * len(b):
            best[name] = max((2 * len(b & (a := set(run[i : i + m - 1]))) / (len(a) + len(b)) for i, x in enumerate(run) if begins(x, b)), default=0.0)
    return best


def brute(text):
    parts = {text, *text.split("\n"), *re.split(r"\n\s*\n", text), *re.split(r"[.!?]\s+", text)}
    found = []
    for p in parts:
        own = re.findall(r"[^\W_]+", p.lower())
        a = {f"{x} {y}" for x, y in zip(own, own[1:])}
        for name, t in L.TEMPLATES.items():
            b = set(L.bigrams(t))
            if a and 2 * len(a & b) / (len(a) + len(b)) >= L.LEAST:
                found.append((-2 * len(a & b) / (len(a) + len(b)), name))
    for name, dice in windows(text, lambda x, b: x in b).items():
        if dice >= L.LEAST:
            found.append((-dice, name))
    best = min(found) if found else (None, None)
    return best[1], None if best[0] is None else -best[0], ",".join(sorted({n for _, n in found}))


def test_every_match_holds_a_telling_word():
    import random

    rng = random.Random(2)
    for least in (0.5, 0.8, 0.95):
        words = L.telling(L.TEMPLATES, least)
        for text in L.TEMPLATES.values():
            own = re.findall("[a-z0-9]+", text.lower())
            for _ in range(60):  # parts that match, with the telling words taken out first
                kept = [w for w in own if w not in words or rng.random() < 0.1]
                a, b = {f"{x} {y}" for x, y in zip(kept, kept[1:])}, set(L.bigrams(text))
                if a and 2 * len(a & b) / (len(a) + len(b)) >= least:
                    assert set(kept) & set(words)


def test_each_template_matches_itself(spark):
    rows = [(name, text) for name, text in L.TEMPLATES.items()]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert all(name in got[name].licences.split(",") and got[name].dice == 1.0 for name in L.TEMPLATES)


def test_scan_equals_brute_force(spark):
    notice = L.TEMPLATES["mit-notice"]
    texts = ["", None, "plain prose only", "x\nreleased under the MIT license!\ny", "Licensed under the Apache License, Version 2.0", notice, "intro words here\n\n" + notice.replace("Software", "Work", 1) + "\n\nmore", "All rights reserved.\nReleased under the MIT License.", "word " * 30_000, "License", "All rights reserved. é", "Copyright 2020 Foo. All rights reserved. More words follow.", "a " + L.TEMPLATES["bsd-3-clause"].lower() + " b", L.TEMPLATES["unlicense"].replace("software", "work"), L.TEMPLATES["cc-by-nc-4.0"] + " x", "Some words first. Licensed under CC BY-NC 4.0. Then others."]
    df = spark.createDataFrame([(i, t, "q", 0.5) for i, t in enumerate(texts)] + [(None, texts[3], "q", 0.5), (3, texts[3], "q", 0.5)], "doc_id long, text string, licence string, dice double")
    got = L.scan(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        name, dice, names = brute(texts[3 if r.doc_id is None else r.doc_id] or "")
        assert (r.licence, r.licences) == (name, names) and r.dice == pytest.approx(dice)
    assert {r.doc_id: r.licence for r in got}[6] == "mit-notice"
    assert L.scan(df.limit(0)).count() == 0
    assert not re.search("Python|Pandas|Arrow", L.scan(df)._jdf.queryExecution().executedPlan().toString())


def header(text, mark="# ", width=75):
    lines, now = [], ""
    for w in text.split():
        if len(now) + len(w) > width:
            lines.append(now)
            now = ""
        now += f" {w}" if now else w
    return "\n".join(mark + x for x in [*lines, now])


@pytest.mark.parametrize("mark", ["# ", "// ", " * ", ";; "])
def test_headers_of_source_files_are_found(spark, mark):
    code = "\nimport os\nx = compute(1, 2)\nfor i in range(x):\n    print(i, 'all of it')\n" * 40
    rows = [(name, f"#!/usr/bin/env run\n{header(text, mark)}{code}") for name, text in L.TEMPLATES.items() if L.n_words(text) >= L.WINDOW]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert all(name in got[name].licences.split(",") and got[name].dice >= 0.97 for name, _ in rows) and len(rows) > 18
    assert len(L.scan(spark.createDataFrame([("code", code * 20)], "doc_id string, text string")).first().licences) == 0


def test_no_run_of_words_is_missed(spark):
    """Templates with words changed, put in and left out, somewhere in prose: what any run of words gives is found."""
    import random

    rng = random.Random(5)
    names, rows = [n for n, t in L.TEMPLATES.items() if L.n_words(t) >= L.WINDOW], []
    for k in range(60):
        own = L.TEMPLATES[rng.choice(names)].split()
        for _ in range(rng.randrange(0, max(2, len(own) // 8))):
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(2)] = [f"w{rng.randrange(99)}"] * rng.randrange(2)
        around = [" ".join(rng.choice(["the", "of", "software", "in", f"p{rng.randrange(50)}"]) for _ in range(rng.randrange(80))) for _ in range(2)]
        rows.append((k, f"{around[0]} {' '.join(own)} {around[1]}"))
    got = {r.doc_id: set(r.licences.split(",")) for r in L.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    sure = [(k, name) for k, text in rows for name, dice in windows(text).items() if dice >= L.LEAST]
    assert len(sure) > 40 and sum(name in got[k] for k, name in sure) >= 0.98 * len(sure)
