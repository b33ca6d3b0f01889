"""Best-fit packing of tokenised documents into sequences of bounded length.

Pattern packing: patterns of up to three lengths that fill a sequence exactly are enumerated, non-negative least squares
fits how often each should be used to the histogram of piece lengths, the counts are rounded so that no length is used
more often than it occurs, and what remains is packed best-fit in order of falling length, all pieces of one length at
a time. The driver sees the histogram (at most ``max_tokens`` counts) and the patterns, never documents. Pieces get
their places by their rank among the pieces of the same length, which is a count per input partition plus a rank
within it; no length is gathered in one task.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut, documents, mapped, texts

MAX_TOKENS = 2048
MODEL = "byte_bpe_50k.json"
#: Fixed value: how byte-level vocabularies cut a text before they merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in files of byte-level vocabularies: itself if it can be printed, else the
    next after the 256th code point."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ranked(path: str):
    """The vocabulary as ranks of byte strings, for a library that merges by rank and is several times as fast; None if
    the file asks for anything that ranks alone do not say."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, pre = file["model"], file["pre_tokenizer"] or {}
    asks = [file["normalizer"], model.get("dropout"), model.get("unk_token"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"), model.get("byte_fallback"), model.get("ignore_merges")]
    if model.get("type") != "BPE" or any(asks) or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in pairs]
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    letters = byte_letters()
    if any(a >= b for a, b in itertools.pairwise(order)) or any(c not in letters for w in model["vocab"] if w not in special for c in w):
        return None
    ranks = {bytes(letters[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Tokens:
    """The ids that the tokenizers library gives. Texts with a special token's string are given to it; all others go to the
    faster library over the same vocabulary, which gives equal ids, but for those that its pattern cannot take."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.fast = ranked(path)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # a run of very many blanks
                pass
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "u4")


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def tokenise(df: DataFrame, path: str, max_tokens: int = MAX_TOKENS, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, and part and nth, which number the pieces of
    one length within an input partition. A document is its ids and then end_id; one that is longer than max_tokens is
    cut into pieces of max_tokens of which the first may be shorter. with_ids adds the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, count = tokens(path), TaskContext.get().partitionId(), np.zeros(max_tokens + 1, "i8")
        for batch in batches:
            rows, own = [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(tok.encode(text), np.uint32(end_id)).astype("<u4")
                first = len(ids) % max_tokens or min(len(ids), max_tokens)
                a, b, piece = 0, first, 0
                while a < len(ids):
                    rows.append((at, piece, a, b - a, zlib.crc32(ids[a:b]), int(count[b - a])))
                    if with_ids:
                        own.append(ids[a:b].astype("i4"))
                    count[b - a] += 1
                    a, b, piece = b, b + max_tokens, piece + 1
            at, piece, start, length, crc, nth = zip(*rows, strict=True)
            out = [batch.column("doc_id").take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(rows), part, "i4")), pa.array(nth, pa.int64())]
            if with_ids:
                out.append(pa.array(own, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"][: len(out)])

    src = texts(df)
    kind = src.schema["doc_id"].dataType.simpleString()
    return mapped(src, run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint" + ", ids array<int>" * with_ids)


def patterns(max_tokens: int, present: np.ndarray) -> np.ndarray:
    """All multisets of one to three of the lengths that occur and that fill a sequence exactly, as rows padded with 0."""
    have = np.flatnonzero(present)
    found = [np.array([[max_tokens, 0, 0]])] if present[max_tokens] else []
    b = have[(2 * have <= max_tokens)]
    a = max_tokens - b
    ok = present[a]
    found.append(np.stack([a[ok], b[ok], 0 * b[ok]], 1))
    for c in have[3 * have <= max_tokens]:
        b = have[(have >= c) & (2 * have <= max_tokens - c)]
        a = max_tokens - c - b
        ok = present[a]
        found.append(np.stack([a[ok], b[ok], np.full(ok.sum(), c)], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), int)


def fit(rows: np.ndarray, histogram: np.ndarray, steps: int = 150) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared difference between used and present lengths, by accelerated
    projected gradient descent; the matrix has at most three entries a column and is never made."""
    m, size = len(rows), len(histogram)
    b = histogram.astype(float).copy()
    b[0] = 0
    scale = b.max() or 1.0
    used = lambda x: np.bincount(rows.ravel(), weights=np.repeat(x, 3), minlength=size) * (np.arange(size) > 0)
    back = lambda r: r[rows].sum(1)
    v = np.ones(m)
    for _ in range(12):  # the largest eigenvalue, for the step
        w = back(used(v))
        lip = np.linalg.norm(w)
        v = w / (lip or 1.0)
    x = y = np.zeros(m)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(np.where(np.arange(size) > 0, used(y) - b / scale, 0)) / max(lip, 1e-9))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x * scale


def plan(histogram: np.ndarray, max_tokens: int = MAX_TOKENS) -> list[tuple[list[int], int]]:
    """Sequences for a histogram of lengths (index = length): (lengths in a sequence, number of such sequences).
    Every length is used as often as it occurs. An empty histogram gives no sequences."""
    left = histogram.astype("i8").copy()
    out: list[tuple[list[int], int]] = []
    rows = patterns(max_tokens, left > 0)
    if len(rows):
        want = np.rint(fit(rows, left)).astype("i8")
        for i in np.argsort(-want, kind="stable"):
            if want[i] <= 0:
                break
            own = [int(x) for x in rows[i] if x]
            n = min([int(want[i]), *(int(left[x]) // own.count(x) for x in own)])
            if n:
                for x in own:
                    left[x] -= n
                out.append((own, n))
    room: dict[int, list[tuple[list[int], int]]] = {}  # open sequences by the room they have left
    spaces = np.zeros(max_tokens + 1, bool)
    for size in range(max_tokens, 0, -1):
        n = int(left[size])
        while n:
            fits = np.flatnonzero(spaces[size:])
            if len(fits):
                space = size + int(fits[0])
                own, count = room[space].pop()
                if not room[space]:
                    spaces[space] = False
            else:
                space, own, count = max_tokens, [], n
            each = min(space // size, n)
            full = min(count, n // each)
            if own and full < count:
                room.setdefault(space, []).append((own, count - full))
                spaces[space] = True
            n -= full * each
            after = space - each * size
            room.setdefault(after, []).append((own + [size] * each, full))
            spaces[after] = True
    return out + [x for group in room.values() for x in group]


def pack(df: DataFrame, path: str, max_tokens: int = MAX_TOKENS, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and
    ids on request).

    A null text counts as empty, a document of one end id; rows with equal doc_id or text are packed each; an empty
    table gives an empty result; other columns are ignored. Places tie-break by partition and order of reading.
    """
    pieces = cut(tokenise(df, path, max_tokens, end_id, with_ids), "pieces")
    counts = cut(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(max_tokens + 1, "i8")
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row a length, max_tokens at most
        histogram[r["length"]] = r["n"]
    slots: list[tuple[int, int, int, int]] = []  # (length, first rank, first sequence, offset)
    rank, base = np.zeros(max_tokens + 1, "i8"), 0
    for own, n in plan(histogram, max_tokens):
        offset = 0
        for x in own:
            slots.append((x, int(rank[x]), base, offset))
            rank[x] += n
            offset += x
        base += n
    slots.sort()
    table = np.array(slots, "i8").reshape(-1, 4)
    shared = df.sparkSession.sparkContext.broadcast((table[:, 0] * (1 << 44) + table[:, 1], table))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1
            seq = rows[at, 2] + rank - rows[at, 1]
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(seq, pa.int64()), pa.array(rows[at, 3], pa.int64())], [*keep, "sequence_id", "offset"])

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    # A merge join: the counts grow with the number of input partitions, and are not to be broadcast.
    numbered = pieces.join(offsets.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("nth") + F.col("before")).alias("rank"))
    kind = numbered.schema["doc_id"].dataType.simpleString()
    return mapped(numbered, place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids + ", sequence_id bigint, offset bigint", by=None)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path(MODEL))
