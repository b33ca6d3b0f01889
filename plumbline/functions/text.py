"""Text functions of retrieval evaluation as Columns: answer normalisation, matching, references, paths and chunks."""

from __future__ import annotations

import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ARTICLES = r"\b(a|an|the)\b"
PUNCTUATION = "[" + "".join("\\" + c for c in string.punctuation) + "]"
#: Fixed value: the phrase that declines to answer, and no other.
DECLINE = "i don't know"
TEXT_EXTENSIONS = ("py", "md", "txt", "rst", "toml", "yaml", "yml", "json", "cfg", "ini", "html", "css", "js", "ts", "sh", "sql")


def collapse(s: Column) -> Column:
    """White space collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def normalise_answer(s: Column) -> Column:
    """Lower case, ASCII punctuation and articles removed, white space collapsed."""
    bare = F.regexp_replace(F.lower(s), PUNCTUATION, "")
    return collapse(F.regexp_replace(bare, ARTICLES, " "))


@F.pandas_udf(StringType())
def norm_text(s: pd.Series) -> pd.Series:
    """NFKD of the lower-cased text with every character outside [a-z0-9 ] as one blank; null stays null."""
    keep = set(string.ascii_lowercase + string.digits + " ")
    return s.map(lambda t: None if t is None else "".join(c if c in keep else " " for c in unicodedata.normalize("NFKD", t.lower())))


def exact_match(pred: Column, golds: Column) -> Column:
    """1 if the normalised prediction equals any normalised gold, else 0."""
    p = normalise_answer(pred)
    return F.coalesce(F.exists(golds, lambda g: normalise_answer(g) == p), F.lit(False)).cast("int")


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 over the token multisets of normalised strings; two empty ones are alike, one empty one is not."""
    toks = lambda s: F.filter(F.split(normalise_answer(s), " "), lambda w: w != "")
    a, b = toks(pred), toks(gold)
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    common = F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda acc, w: acc + F.least(count(a, w), count(b, w)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(2.0 * common / (F.size(a) + F.size(b)))


def f1(pred: Column, golds: Column) -> Column:
    """The best token F1 over the golds; 0 without golds."""
    return F.coalesce(F.array_max(F.transform(golds, lambda g: token_f1(pred, g))), F.lit(0.0))


def stripped(s: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def is_decline(pred: Column) -> Column:
    """True if the whole answer is the declining phrase; curly apostrophes and . or ! at the end do not matter."""
    folded = stripped(F.regexp_replace(F.translate(stripped(pred), "’", "'"), r"[.!]+$", ""))
    return F.coalesce(F.lower(folded) == DECLINE, F.lit(False))


def is_decline_prefix(pred: Column) -> Column:
    """True if the first line declines; null does not."""
    return is_decline(F.split(stripped(pred), "\n")[0])


def parse_golds(golds: Column) -> Column:
    """A JSON array of strings as an array, any other string as one gold."""
    parsed = F.from_json(golds, "array<string>")
    return F.when(golds.rlike(r"^\s*\[") & parsed.isNotNull(), parsed).otherwise(F.array(golds))


def answer_present(golds: Column, texts: Column) -> Column:
    """True if any gold is part of the texts joined by blanks, all normalised by norm_text() before; false without texts."""
    blob = F.array_join(texts, " ")
    return (F.size(texts) > 0) & F.exists(golds, lambda g: F.contains(blob, g))


#: Fixed value: an alias with fewer normalised characters cannot be told from other text.
MIN_ALIAS = 3


def alias_of(norm: Column) -> Column:
    """A gold normalised by norm_text() with its white space collapsed; may be empty."""
    return collapse(norm)


def alias_usable(norm: Column) -> Column:
    return F.length(alias_of(norm)) >= MIN_ALIAS


def degenerate_golds(norms: Column) -> Column:
    """True if no alias of the array is usable."""
    return ~F.exists(norms, alias_usable)


def answer_present_words(norms: Column, texts: Column) -> Column:
    """True if a usable alias occurs between word boundaries in the texts, all normalised; false without texts."""
    blob = F.concat(F.lit(" "), F.array_join(texts, " "), F.lit(" "))
    found = lambda g: alias_usable(g) & F.contains(blob, F.concat(F.lit(" "), alias_of(g), F.lit(" ")))
    return (F.size(texts) > 0) & F.exists(norms, found)


def in_primary(norms: Column, texts: Column, subset: Column) -> Column:
    """Whether a question can be scored by presence: of the main subset, with a usable gold that its reference texts have."""
    return F.coalesce((subset == "main") & ~degenerate_golds(norms) & answer_present_words(norms, texts), F.lit(False))


#: What a review of golds can say.
VERDICTS = ("keep", "augment", "replace", "unanswerable_from_corpus")


def verdict_problem(verdict: Column, old: Column, new: Column, new_norms: Column) -> Column:
    """Why a verdict and the golds it gives contradict one another, null if they do not. old and new are arrays of golds
    (null for none), new_norms the normalised new ones."""
    old_, new_ = F.array_sort(F.array_distinct(old)), F.array_sort(F.array_distinct(F.coalesce(new, F.array().cast("array<string>"))))
    none, same = F.size(new_) == 0, new_ == old_
    grows = (F.size(F.array_except(old_, new_)) == 0) & (F.size(new_) > F.size(old_))
    unmatched = degenerate_golds(F.coalesce(new_norms, F.array().cast("array<string>")))
    return (
        F.when(~F.coalesce(verdict.isin(*VERDICTS), F.lit(False)), F.concat(F.lit("unknown verdict "), F.coalesce(verdict, F.lit("null"))))
        .when(verdict == "keep", F.when(~none & ~same, "keep must not change the golds"))
        .when(verdict == "unanswerable_from_corpus", F.when(~none, "unanswerable_from_corpus must supply no golds"))
        .when((verdict == "augment") & ~grows, "augment must add at least one alias and drop none")
        .when((verdict == "replace") & none, "replace must supply a non-empty gold list")
        .when((verdict == "replace") & same, "replace must differ from the existing golds")
        .when(unmatched, "no proposed alias is long enough to be matchable")
    )


NO_PASSAGES = "(no passages were retrieved)"


def render_context(passages: Column) -> Column:
    """An array of (title, text) as numbered blocks parted by blank lines; a fixed sentence for none."""
    blocks = F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p["title"], F.lit("\n"), p["text"]))
    return F.when(F.size(passages) > 0, F.array_join(blocks, "\n\n")).otherwise(NO_PASSAGES)


def user_message(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Passages:\n\n"), context, F.lit("\n\nQuestion: "), question)


#: Words that say little in a title.
STOPWORDS = """a an the is are was were be been being do does did of
in on at to for with by from as it its this that these those and or but if then
than so what which who where when why how not no can could should would will
have has had i you he she we they them us me my your our there here all any
both each few more most other some such only own same too very just about into
over after before between under again further once during above below up down
out off""".split()
MIN_HEAD_WORDS = 4


def redact_references(text: Column) -> Column:
    """#n as #…, so that a question does not name the next thread."""
    return F.regexp_replace(text, r"(?<![\w/#])#\d+\b", "#…")


def degenerate_head(title: Column) -> Column:
    """Whether too few words that say something are left of a title whose references are redacted."""
    words = F.regexp_extract_all(F.lower(redact_references(first_sentence(F.coalesce(title, F.lit(""))))), F.lit(r"[a-z_][a-z0-9_]*"), F.lit(0))
    return F.size(F.filter(words, lambda w: ~w.isin(*STOPWORDS))) < MIN_HEAD_WORDS


def thread_question(repo: Column, title: Column) -> Column:
    """A question in the words of a thread's title; fails if it names another thread."""
    asked = F.concat(F.lit("In "), repo, F.lit(', someone reported: "'), redact_references(first_sentence(title)), F.lit('" What was this eventually traced to, and what resolved it?'))
    leaks = F.size(references(asked)) > 0
    return F.when(leaks, F.raise_error(F.concat(F.lit("question names a thread: "), asked)).cast("string")).otherwise(asked)


def is_pull_request(thread: Column) -> Column:
    """The flag if there is one, else whether the thread has a pull request."""
    return F.coalesce(thread["is_pull_request"], thread["pull_request"].isNotNull())


def hops_retrieved(gold_rows: Column, retrieved: Column, k: int = 10) -> Column:
    """Distinct gold rows among the first k retrieved ids; ids of -1 fill short lists."""
    top = F.filter(F.slice(retrieved, 1, k), lambda i: i >= 0)
    return F.size(F.array_intersect(F.array_distinct(gold_rows), top))


def padded(ids: Column, width: int) -> Column:
    """A list of ids cut or filled with -1 to the given width."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(-1).cast("bigint"), width)), 1, width)


def truthy(value: Column) -> Column:
    """Whether a flag written as text says yes: true or 1 in any case; blank and null say no."""
    return F.coalesce(F.lower(value.cast("string")).isin("true", "1"), F.lit(False))


def whole_words(needle: Column, haystack: Column) -> Column:
    """True if the needle occurs between word boundaries; an empty needle does not. Both are normalised text."""
    return (needle != "") & F.contains(F.concat(F.lit(" "), collapse(haystack), F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))


def collapsed_key(s: Column) -> Column:
    """Text to match by: white space collapsed, lower case."""
    return F.lower(collapse(s))


def split_field(value: Column, by: str = ";") -> Column:
    """A separated field as its trimmed parts that are not blank."""
    return F.filter(F.transform(F.split(value, by), lambda x: F.trim(x)), lambda x: x != "")


def strip_code(text: Column) -> Column:
    """Text without fenced blocks (an unclosed one runs to the end) and inline code."""
    text = F.regexp_replace(text, r"(?s)```.*?```", " ")
    return F.regexp_replace(F.regexp_replace(text, r"(?s)```.*", " "), r"`[^`\n]*`", " ")


def references(text: Column) -> Column:
    """Numbers n of #n in the text outside code and not after a word character, / or #, each once, in order of first use."""
    found = F.regexp_extract_all(strip_code(text), F.lit(r"(?<![\w/#])#(\d+)\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("bigint")))


def first_sentence(text: Column, most: int = 300) -> Column:
    """The first sentence of the lines that are not blank, quoted, headings or fences, cut to ``most`` characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("^(>|#|```)"))
    return F.substring(F.split(F.array_join(lines, " "), r"(?<=[.!?])\s")[0], 1, most)


def code_tokens(text: Column) -> Column:
    """Distinct lower-cased identifiers longer than two characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z_][a-z0-9_]*"), F.lit(0)), lambda w: F.length(w) > 2))


def chunks(text: Column, size: int = 1800, overlap: int = 200) -> Column:
    """Overlapping chunks of fixed width as an array; a text that fits is one chunk, an empty one too."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(size)))
    # The last cut is dropped if the one before reaches the end already.
    n = F.when(F.length(text) <= size, F.lit(1)).otherwise(F.ceil((F.length(text) - overlap) / step).cast("int"))
    return F.slice(cut, F.lit(1), n)


def chunk_count(text: Column, size: int = 1800, overlap: int = 200) -> Column:
    """Number of chunks without making them."""
    return F.when(F.length(text) <= size, F.lit(1)).otherwise(F.ceil((F.length(text) - overlap) / (size - overlap))).cast("bigint")


def normalise_path(path: Column) -> Column:
    """Quotes and backticks stripped, forward slashes, no leading ./ or /."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(path), "^[\"'`]+|[\"'`]+$", ""), r"\\", "/")
    return F.regexp_replace(bare, r"^(\./|/)+", "")


def path_hit(answer: Column, path: Column) -> Column:
    """True if an answer names a path between path boundaries."""
    blob = F.concat(F.lit(" "), F.regexp_replace(answer, r"[^\w./-]", " "), F.lit(" "))
    return F.contains(blob, F.concat(F.lit(" "), path, F.lit(" "))) | F.contains(blob, F.concat(F.lit("/"), path, F.lit(" ")))


def is_text_file(path: Column) -> Column:
    """By the extension after the last dot; a file that only begins with a dot has none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"[^.].*\.([^.]+)$", 1)).isin(*TEXT_EXTENSIONS)


def hop_class(length: Column) -> Column:
    """Stratum of a chain by its number of nodes."""
    return F.when(length <= 1, "hop1").when(length == 2, "hop2").otherwise("hop3plus")


def contains_answer(answer: Column, expected: Column) -> Column:
    """Case-insensitive containment; an empty expectation is never met."""
    return F.coalesce((expected != "") & F.contains(F.lower(answer), F.lower(expected)), F.lit(False))
