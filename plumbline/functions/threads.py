"""Issue threads as nested Columns: bots, documents, file names, subsets of paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_bot(author: Column, deny: tuple[str, ...] = ()) -> Column:
    """By type or by a list of logins, case aside; an unknown author is none."""
    listed = F.lower(author["login"]).isin([d.lower() for d in deny]) if deny else F.lit(False)
    return F.coalesce((F.lower(author["type"]) == "bot") | listed, F.lit(False))


def without_bots(comments: Column, deny: tuple[str, ...] = ()) -> Column:
    """(kept, dropped): comments of people, and the number of the others."""
    kept = F.filter(comments, lambda c: ~is_bot(c["user"], deny))
    return F.struct(kept.alias("kept"), (F.size(comments) - F.size(kept)).alias("dropped"))


def document(thread: Column) -> Column:
    """A thread as text: heading, body, and comments in order; trailing blanks go, one line feed ends it."""
    comments = F.transform(F.coalesce(thread["comments"], F.array()), lambda c: F.concat(F.lit("## "), F.coalesce(c["user"]["login"], F.lit("unknown")), F.lit("\n\n"), F.coalesce(c["body"], F.lit(""))))
    parts = F.concat(F.array(F.concat(F.lit("# "), F.coalesce(thread["title"], F.lit(""))), F.coalesce(thread["body"], F.lit(""))), comments)
    return F.concat(F.regexp_replace(F.array_join(parts, "\n\n"), r"\s+$", ""), F.lit("\n"))


def file_name(repo: Column, number: Column) -> Column:
    """Numbers have four digits at least."""
    text = number.cast("string")
    return F.concat(F.regexp_replace(repo, "/", "_"), F.lit("__"), F.lpad(text, F.greatest(F.length(text), F.lit(4)), F.lit("0")), F.lit(".md"))


def in_subset(path: Column, include: tuple[str, ...], exclude: tuple[str, ...] = ()) -> Column:
    """By prefixes; without any, all paths are in."""
    starts = lambda prefixes: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(path, p))
    inside = starts(include) if include else F.lit(True)
    return inside & ~starts(exclude) if exclude else inside


def tier(path: Column, prefixes: tuple[str, ...]) -> Column:
    """Index of the first prefix that matches, their number if none does."""
    out = F.lit(len(prefixes))
    for i, p in reversed(list(enumerate(prefixes))):
        out = F.when(F.startswith(path, F.lit(p)), i).otherwise(out)
    return out


def visible(path: Column, extensions: tuple[str, ...], ignored: tuple[str, ...] = ("node_modules", "dist", "build", "target", "vendor")) -> Column:
    """Paths an indexer takes: no hidden or ignored folder, and a known extension."""
    parts = F.split(path, "/")
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | p.isin(*ignored))
    return ~hidden & F.lower(F.regexp_extract(F.element_at(parts, -1), r"\.([^.]+)$", 1)).isin(*extensions)
