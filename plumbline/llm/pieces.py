"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

Each text is cut into units at boundaries that no piece of the vocabulary crosses, so that units can be encoded alone.
A unit is encoded with a score-ordered agenda: adjacent symbol pairs that form a piece wait in a heap, the best score
first and the leftmost of equal scores; a merge replaces the two symbols and offers the new neighbours. Symbols that
are no piece fall back to their bytes. Whatever the agenda returns for a new unit is checked against the sentencepiece
library, one call for each Arrow batch; where the two differ the library's ids are taken and counted in
``n_disagreements`` (none has been seen). Encoded units are kept in a table of bounded size in each Python worker.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import documents, mapped, texts

MODEL = "piece_bpe_32k.model"
#: Units kept in a worker's table, and the longest that is kept. Both only bound memory.
TABLE, LONGEST = 500_000, 48
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
MARKS = r",.!?;:&*$%#|"


class Encoder:
    """Encodes and decodes with one model file; made once in each worker."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        names = [self.lib.id_to_piece(i) for i in range(n)]
        self.bos, self.eos, self.unk = self.lib.bos_id(), self.lib.eos_id(), self.lib.unk_id()
        self.byte = [self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.ids = {p: i for i, p in enumerate(names) if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i))}
        self.rank = {p: -self.lib.get_score(i) for p, i in self.ids.items()}
        self.falls_back = all(self.lib.is_byte(i) for i in self.byte)
        if any("▁" in p.lstrip("▁") for p in self.rank) or any("\n" in p for p in self.rank) or not self.falls_back:
            raise ValueError("pieces of this vocabulary cross the boundaries at which texts are cut")
        inner = re.compile(f"[{LETTERS}][{MARKS}]")
        last = "" if any(inner.search(p) for p in self.rank) else f"▁?[{LETTERS}]+(?=[{MARKS}])|"
        self.unit = re.compile(last + "▁*[^▁\n]+|▁+|\n")
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.differing: set[str] = set()

    def agenda(self, unit: str) -> list[int]:
        symbols = self.short(unit) if len(unit) <= 24 else self.long(unit)
        ids, out = self.ids, []
        for s in symbols:
            if s in ids:
                out.append(ids[s])
            else:
                out.extend(self.byte[b] for b in s.encode())
        return out

    def short(self, unit: str) -> list[str]:
        """The agenda of a short unit as a plain list of waiting scores: min() finds the best, the leftmost of equals."""
        rank, none = self.rank.get, math.inf
        symbols = list(unit)
        wait = [rank(a + b, none) for a, b in itertools.pairwise(symbols)]
        while wait and (best := min(wait)) < none:
            i = wait.index(best)
            symbols[i : i + 2] = [merged := symbols[i] + symbols[i + 1]]
            del wait[i]
            if i:
                wait[i - 1] = rank(symbols[i - 1] + merged, none)
            if i < len(wait):
                wait[i] = rank(merged + symbols[i + 1], none)
        return symbols

    def long(self, unit: str) -> list[str]:
        """The agenda of a unit of any length as a heap over linked symbols."""
        rank, heap = self.rank.get, []
        symbols: list[str | None] = list(unit)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))

        def offer(i: int, j: int) -> None:
            if (r := rank(pair := symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (r, i, j, pair))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, pair = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or right[i] != j or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                offer(i, k)
            if left[i] >= 0:
                offer(left[i], i)
        return [s for s in symbols if s is not None]

    def learn(self, units: set[str]) -> dict[str, bytes]:
        """The given units encoded by the agenda and checked against the library."""
        own, order = {}, list(units)
        # A line feed is in no piece: it keeps the library's dummy prefix away from the unit.
        for u, checked in zip(order, self.lib.encode(["\n" + u for u in order], num_threads=1), strict=True):
            ids = self.agenda(u)
            if ids != checked[2:]:
                self.differing.add(u)
                ids = checked[2:]
            own[u] = struct.pack(f"<{len(ids)}I", *ids)
        return own

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[int]]:
        """For each text its ids as little-endian unsigned 32-bit integers, with begin and end ids; units the library disputed."""
        cut = [self.unit.findall("▁" + t.replace(" ", "▁")) if t else [] for t in texts]
        seen = set().union(*cut)
        held = {u: b for u in seen if (b := self.table.get(u) or self.older.get(u))}
        held.update(self.learn(seen - held.keys()))
        if len(self.table) > TABLE:  # what was not met since the last turn goes
            self.older, self.table = self.table, {}
        self.table.update((u, b) for u, b in held.items() if len(u) <= LONGEST)
        begin, end = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        out = [begin + b"".join(map(held.__getitem__, units)) + end for units in cut]
        return out, [sum(u in self.differing for u in units) if self.differing else 0 for units in cut]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_frame(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (string) and n_disagreements for every row of df.

    A null text counts as empty: its ids are begin and end, its decoded text is empty. Rows with equal ids or texts
    each give a row; an empty table gives none; other columns of df are ignored. Texts of any length are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            raw, differ = enc.encode(batch.column("text").to_pylist())
            ids = [np.frombuffer(b, dtype="<u4").astype("i4") for b in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.lib.decode(i.tolist()) for i in ids]), pa.array(differ, pa.int64())], ["doc_id", "ids", "decoded", "n_disagreements"])

    src = texts(df, id_col, text_col)
    return mapped(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string, n_disagreements bigint", most=4 << 20)


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_frame, but with the number of ids and digests of ids and decoded text, so that no ids leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            raw, differ = enc.encode(batch.column("text").to_pylist())
            decoded = enc.lib.decode([np.frombuffer(b, dtype="<u4").tolist() for b in raw])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(b) // 4 for b in raw], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in raw]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
                    pa.array(differ, pa.int64()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_disagreements"],
            )

    src = texts(df, id_col, text_col)
    return mapped(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_disagreements bigint", most=4 << 20)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir), public_tokenizers.path(MODEL))
