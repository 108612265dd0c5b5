"""Harmonic packing of documents into sequences of a fixed capacity C.

Classes are the reciprocal capacities C//1, C//2, ...; a class of size s fills
each of its bins with exactly C//s pieces. A document gives pieces of C while
it can; what remains is cut to the largest class that it holds, and the rest
likewise, so a document has few pieces and a full bin lacks fewer than C//s
tokens (at sizes up to SMALL each length is a class of its own, and lacks
fewer than SMALL). Every task fills its own bins; no task needs to know of
another, and nothing is shuffled. At its end a task joins the pieces of bins
that stayed open end to end, and cuts the last sequence at powers of two,
which are not padded.

A task holds at most one open bin for each class (under 200 KB of ids); ids
of sequences are the task's number in the upper bits and a count below.

Defined results: a null text is empty and has the end token only; rows with a
null or repeated doc_id are packed like others; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
END = 1
SMALL = 45
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_encoders: dict = {}


class Encoder:
    """Token ids of a byte-level BPE vocabulary, as the tokenizers library gives them.

    tiktoken runs the same merges about four times as fast. It is used if the file says
    what it takes for granted (byte-level split, no normalizer, pieces numbered in the
    order of their merges); texts that name an added token go through tokenizers, and so
    does the shortest text of each batch, as a control. A control that differs is an error:
    such a file needs exact=True, which uses tokenizers alone.
    """

    def __init__(self, path: str, exact: bool = False):
        import json

        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.exact = Tokenizer.from_file(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        names = self._byte_names(sorted(ByteLevel.alphabet()))
        ranks = {bytes(names[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.added}
        # The split that a byte-level pre-tokenizer makes; a fixed value.
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.trusted = not exact and self.expected(spec)

    @staticmethod
    def _byte_names(alphabet: list[str]) -> dict[str, int]:
        """Printable bytes stand for themselves, the others for the code points from 256 on, in order."""
        own = {chr(b): b for b in range(256) if chr(b) in alphabet}
        rest = [b for b in range(256) if chr(b) not in own]
        return own | {chr(256 + i): b for i, b in enumerate(rest)}

    @staticmethod
    def expected(spec: dict) -> bool:
        """Whether a file's settings are those of the split and the merges above."""
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        made = [model["vocab"].get(a + b, -1) for a, b in merges]
        plain = spec.get("normalizer") is None and model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        return plain and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and made == sorted(made) and (not made or made[0] >= 0)

    def __call__(self, texts: list[str]) -> Iterator[list[int]]:
        control = min(range(len(texts)), key=lambda i: (not texts[i], len(texts[i]))) if texts else 0
        for i, text in enumerate(texts):
            if not self.trusted or any(a in text for a in self.added):
                yield self.exact.encode(text, add_special_tokens=False).ids
                continue
            ids = self.fast.encode_ordinary(text)
            if i == control and ids != self.exact.encode(text, add_special_tokens=False).ids:
                raise ValueError("this vocabulary's merges give other ids by rank; use exact=True")
            yield ids


def encoder(path: str, exact: bool = False) -> Encoder:
    if (path, exact) not in _encoders:
        _encoders[path, exact] = Encoder(path, exact)
    return _encoders[path, exact]


def cuts(n: int, capacity: int = CAPACITY, small: int = SMALL) -> list[int]:
    """Piece lengths of a document with n tokens."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        size = n if n < small else capacity // -(-capacity // n)
        out.append(size)
        n -= size
    return out


class Bins:
    """The open bins of one task; put() and close() append rows."""

    def __init__(self, task: int, capacity: int = CAPACITY):
        self.capacity, self.next, self.open, self.rows = capacity, task << 40, {}, []

    def put(self, doc: int, ids: np.ndarray) -> None:
        start = 0
        for size in cuts(len(ids), self.capacity):
            bin_ = self.open.setdefault(size, [])
            bin_.append((doc, start, ids[start : start + size], len(ids)))
            start += size
            if len(bin_) == self.capacity // size:
                self._write(self.open.pop(size))

    def _write(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def close(self) -> None:
        left = [p for size in sorted(self.open, reverse=True) for p in self.open[size]]
        self.open = {}
        total = sum(len(p[2]) for p in left)
        room = [self.capacity] * (total // self.capacity) + [1 << b for b in reversed(range(self.capacity.bit_length())) if total % self.capacity >> b & 1]
        for size in room:
            pieces = []
            while size:
                doc, start, ids, n = left.pop(0)
                if len(ids) > size:
                    left.insert(0, (doc, start + size, ids[size:], n))
                    ids = ids[:size]
                pieces.append((doc, start, ids, n))
                size -= len(ids)
            self._write(pieces)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, exact: bool = False) -> DataFrame:
    """One row for each piece of a row of docs; tokenizer: a byte-level BPE file of the tokenizers library."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = encoder(tokenizer, exact), Bins(TaskContext.get().partitionId(), capacity)
        ids_of: dict = {}
        names = ["doc_id", *(x.split()[0] for x in PIECES.split(", "))]

        def rows(doc_type: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*bins.rows)) or [[]] * 7
            got = [pa.array([ids_of[d] for d in cols[0]], doc_type), *(pa.array(c, pa.int64()) for c in cols[1:])]
            bins.rows = []
            keep = {p[0] for b in bins.open.values() for p in b}
            for d in [d for d in ids_of if d not in keep]:
                del ids_of[d]
            return pa.RecordBatch.from_arrays(got, names)

        n, doc_type = 0, pa.int64()
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts)):
                ids_of[n] = doc_id
                bins.put(n, np.array([*ids, end], "<u4"))
                n += 1
            yield rows(doc_type)
        bins.close()
        yield rows(doc_type)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {PIECES}")
