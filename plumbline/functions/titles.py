"""Title mentions, bridges and verbatim redaction: text functions that need whole-string logic, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PLACEHOLDER = "[passage text redacted]"


def title_words(s: str | None) -> str:
    """NFKD, lower case, runs of [a-z0-9] joined by one blank; empty for null."""
    return " ".join(re.findall("[a-z0-9]+", unicodedata.normalize("NFKD", s or "").lower()))


@F.pandas_udf(StringType())
def norm_title(s: pd.Series) -> pd.Series:
    return s.map(title_words)


def mentioned(title: str, text: str) -> bool:
    """True if a normalised title is in a normalised text between word boundaries; an empty one is not."""
    return bool(title) and f" {title} " in f" {text} "


def nested(a: str, b: str) -> bool:
    """True if either normalised title contains the other, or one is empty."""
    return not a or not b or mentioned(a, b) or mentioned(b, a)


def eligible(title: str) -> bool:
    """Titles of two words and ten characters or more can be bridges."""
    return len(title.split()) >= 2 and len(title_words(title)) >= 10


def bridges_of(text: str | None, page: str, lookup: frozenset[str] | dict, most: int = 10) -> list[str]:
    """Titles of the lookup (normalised) that the text mentions, in order of first appearance, without the page's own and
    those nested in it."""
    words, own, out = title_words(text).split(), title_words(page), []
    for i in range(len(words)):
        for n in range(2, most + 1):
            name = " ".join(words[i : i + n])
            if i + n <= len(words) and name in lookup and name not in out and not nested(name, own):
                out.append(name)
    return out


def longest_common(a: str, b: str, least: int) -> tuple[int, int]:
    """(start in a, length) of the longest common substring of at least ``least`` characters, the first of equals; (0, 0)
    if there is none. A suffix automaton of a, read along b: time and memory in proportion to the lengths."""
    following: list[dict[str, int]] = [{}]
    shorter, length, ends = [-1], [0], [0]
    last = 0
    for at, c in enumerate(a):
        new = len(following)
        following.append({})
        shorter.append(0)
        length.append(length[last] + 1)
        ends.append(at + 1)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = shorter[p]
        if p >= 0:
            q = following[p][c]
            if length[q] == length[p] + 1:
                shorter[new] = q
            else:  # q is split: the shorter of its strings occur elsewhere, too
                copy = len(following)
                following.append(dict(following[q]))
                shorter.append(shorter[q])
                length.append(length[p] + 1)
                ends.append(ends[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = shorter[p]
                shorter[q] = shorter[new] = copy
        last = new
    state, size, best = 0, 0, (0, 0)
    for c in b:
        while state and c not in following[state]:
            state = shorter[state]
            size = length[state]
        if c in following[state]:
            state, size = following[state][c], size + 1
        if size >= least and size >= best[1]:
            start = ends[state] - size
            if size > best[1] or start < best[0]:
                best = (start, size)
    return best


def redact_verbatim(text: str | None, passages: str | None, least: int = 20, fold: bool = False) -> str | None:
    """The text with its longest stretches that passages have, too, replaced one after another by a placeholder; case counts
    unless ``fold`` is set."""
    if not text or not passages:
        return text
    # Lower case that keeps the length, so that places stay.
    lower = lambda s: "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
    source = lower(passages) if fold else passages
    parts = [text]
    while True:
        best, where = (0, 0), -1
        for k, part in enumerate(parts):
            if part != PLACEHOLDER:
                found = longest_common(lower(part) if fold else part, source, least)
                if found[1] > best[1]:
                    best, where = found, k
        if where < 0:
            return "".join(parts)
        part, (i, n) = parts[where], best
        parts[where : where + 1] = [x for x in (part[:i], PLACEHOLDER, part[i + n :]) if x]


@F.pandas_udf(StringType())
def redact(text: pd.Series, passages: pd.Series) -> pd.Series:
    return pd.Series([redact_verbatim(a, b) for a, b in zip(text, passages, strict=True)], dtype=object)


def bridges(passages: DataFrame, titles: DataFrame) -> DataFrame:
    """(id, bridges) of passages (id, page, text): the titles (title) that each text mentions, in order of first appearance,
    without the page's own and those nested in it; titles of two words and ten characters or more.

    Texts are normalised once and joined with the titles by each two words that follow one another, so that neither side
    travels whole; a candidate's other words are compared after the join. Passages without bridges are left out.
    """
    words = F.split("norm", " ")
    named = titles.select(norm_title("title").alias("norm"), "title").where((F.size(F.split("title", r"\s+")) >= 2) & (F.length("norm") >= 10))
    named = named.select("norm").distinct().where(F.size(words) >= 2).select("norm", F.concat_ws(" ", words[0], words[1]).alias("start"), F.size(words).alias("n"))
    own = passages.select("id", norm_title("page").alias("page"), norm_title("text").alias("norm")).withColumn("words", words)
    starts = F.transform(F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1)))
    places = own.select("id", "page", "words", F.posexplode(starts).alias("at", "start"))
    met = places.join(named, "start").where(F.array_join(F.slice("words", F.col("at") + 1, F.col("n")), " ") == F.col("norm"))
    inside = lambda a, b: F.contains(F.concat(F.lit(" "), b, F.lit(" ")), F.concat(F.lit(" "), a, F.lit(" ")))
    other = (F.col("page") != "") & ~inside(F.col("norm"), F.col("page")) & ~inside(F.col("page"), F.col("norm"))
    first = met.where(other).groupBy("id", "norm").agg(F.min("at").alias("at"), F.min("n").alias("n"))
    return first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n", "norm"))), lambda x: x["norm"]).alias("bridges"))
