"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule is an expression that rejects a document. A sample of bounded size gives each rule's cost (the time an
aggregate over it takes beyond an empty one) and selectivity (the share of the sample that it rejects); the rules are
then put in order of rejections per cost, in one CASE expression that stops at the first rule that rejects. The order
decides only what is computed and which rule is named for a document that several reject, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import SPACES, cut, discard, documents, words

#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE = 2000
SYMBOLS = r"[#*$%&|<>]"

Measure = Callable[[Column, Column], Column]


def repeat_words(own: Column) -> Column:
    """Words in 3-word windows that are found twice or more. Windows are hashed, sorted with their places, and equal
    neighbours give the places whose words are counted once each."""
    n = F.greatest(F.size(own) - 2, F.lit(0))
    hashes = F.transform(F.slice(own, F.lit(1), n), lambda x, i: F.xxhash64(x, F.get(own, i + 1), F.get(own, i + 2)))

    def covered(places: Column) -> Column:
        new = F.transform(places, lambda v, q: F.when(q == 0, F.lit(3)).otherwise(F.least(F.lit(3), v - F.get(places, q - 1))).cast("bigint"))
        return F.aggregate(new, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def places(pairs: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        hit = F.filter(pairs, lambda s, i: same(s, F.get(pairs, i - 1)) | same(s, F.get(pairs, i + 1)))
        return F.sort_array(F.transform(hit, lambda s: s["i"]))

    # Bound once each: an array made in a lambda's argument is not made again for every element.
    bind = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    return bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(bind(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda pairs: bind(places(pairs), covered))))


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{SPACES}]"))
    bind = F.element_at(F.transform(F.array(lines), lambda own: F.size(own) - F.size(F.array_distinct(own))), 1)
    return bind.cast("bigint")


#: What rules are made of; each from a text (never null) and its words.
MEASURES: dict[str, Measure] = {
    "n_words": lambda text, own: F.size(own).cast("bigint"),
    "word_chars": lambda text, own: F.length(F.array_join(own, "")).cast("bigint"),
    "n_symbols": lambda text, own: F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint"),
    "n_dup_lines": lambda text, own: dup_lines(text),
    "n_repeat_words": lambda text, own: repeat_words(own),
    "n_lines": lambda text, own: F.regexp_count(text, F.lit("\n")).cast("bigint") + 1,
    "n_upper": lambda text, own: F.regexp_count(text, F.lit(r"\p{Lu}")).cast("bigint"),
    "n_lower": lambda text, own: F.regexp_count(text, F.lit(r"\p{Ll}")).cast("bigint"),
    "n_letters": lambda text, own: F.regexp_count(text, F.lit(r"\p{L}")).cast("bigint"),
    "n_distinct": lambda text, own: F.size(F.array_distinct(own)).cast("bigint"),
    "longest_word": lambda text, own: F.coalesce(F.array_max(F.transform(own, lambda w: F.length(w))), F.lit(0)).cast("bigint"),
}

#: A rule is true for what it rejects; it gets a function from a measure's name to its column.
RULES: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "few_words": lambda m: m("n_words") < 50,
    "repeats": lambda m: 100 * m("n_repeat_words") > 50 * m("n_words"),
    "symbols": lambda m: 4 * m("n_symbols") > m("n_words"),
    "dup_lines": lambda m: 2 * m("n_dup_lines") > m("n_lines"),
    "shouting": lambda m: m("n_upper") > m("n_lower"),
    "few_letters": lambda m: 2 * m("n_letters") < m("word_chars"),
    "few_kinds": lambda m: m("n_distinct") < F.sqrt(m("n_words").cast("double")),
    "word_length": lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 20 * m("n_words")),
}


def with_measures(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """df with columns of the given measures; df has _text and _words."""
    return df.withColumns({n: MEASURES[n](F.col("_text"), F.col("_words")) for n in names})


def lookup(df: DataFrame) -> Callable[[str], Column]:
    """A measure as the column that df has already, else as an expression."""
    return lambda n: F.col(n) if n in df.columns else MEASURES[n](F.col("_text"), F.col("_words"))


def ordered(df: DataFrame, rules: list[str], rows: int | None = None) -> list[dict]:
    """The rules in order of rejections per cost, with both figures, from a sample of about SAMPLE rows of df."""
    n = df.count() if rows is None else rows
    share = min(1.0, SAMPLE / max(n, 1))
    drawn = F.pmod(F.xxhash64(*[c for c in df.columns if c != "_words"][:2]), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = cut(df.where(drawn), "rule-sample")

    def timed(condition: Column) -> tuple[float, float]:
        best = 9e9
        for _ in range(2):
            began = time.perf_counter()
            rejected = sample.agg(F.coalesce(F.avg(condition.cast("double")), F.lit(0.0))).first()[0]
            best = min(best, time.perf_counter() - began)
        return best, rejected

    empty, _ = timed(F.lit(False))
    m, found = lookup(df), []
    for name in rules:
        cost, rejected = timed(RULES[name](m))
        cost = max(cost - empty, 1e-4)
        found.append({"rule": name, "cost": cost, "rejects": rejected})
    discard(sample)
    return sorted(found, key=lambda r: -r["rejects"] / r["cost"])


def cascade(df: DataFrame, order: list[str]) -> Column:
    """The first rule in this order that rejects a row of df, null if none does; later rules are not evaluated."""
    m, first, *rest = lookup(df), *order
    out = F.when(RULES[first](m), F.lit(first))
    for name in rest:
        out = out.when(RULES[name](m), F.lit(name))
    return out


def prepared(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    own = df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("_text"))
    return own.withColumn("_words", words(F.col("_text")))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[str] | None = None) -> DataFrame:
    """doc_id, kept and failed_rule (null where kept) for every row of df.

    A null or empty text has no words and is rejected by few_words; whole texts are measured, of any length; equal rows
    get equal verdicts; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    own = prepared(df, id_col, text_col)
    order = [r["rule"] for r in ordered(own, rules or list(RULES))]
    return own.select("doc_id", cascade(own, order).alias("failed_rule")).withColumn("kept", F.col("failed_rule").isNull())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prepared(documents(spark, sf_dir))
    measured = with_measures(own, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    order = [r["rule"] for r in ordered(measured, list(RULES), documents(spark, sf_dir).count())]
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & cascade(measured, order).isNull()).alias("kept"))


def rules_sql() -> str:
    """The rules over measures as DuckDB SQL, for the oracle."""
    return r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (SELECT doc_id, t, ws, len(ws) AS n FROM w),
grams AS (SELECT doc_id, unnest(range(1, n - 1)) AS p, ws FROM g WHERE n >= 3),
keyed AS (SELECT doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS k FROM grams),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT p + o) AS n_repeat_words FROM hit, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM g),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT g.doc_id, n AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(t) - length(replace(t, chr(10), '')) + 1 AS n_lines,
    length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper,
    length(t) - length(regexp_replace(t, '\p{Ll}', '', 'g')) AS n_lower,
    length(t) - length(regexp_replace(t, '\p{L}', '', 'g')) AS n_letters,
    len(list_distinct(ws)) AS n_distinct
  FROM g LEFT JOIN cover USING (doc_id) LEFT JOIN dups USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 4 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
    OR n_upper > n_lower OR 2 * n_letters < word_chars OR n_distinct < sqrt(n_words)
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM m"""
