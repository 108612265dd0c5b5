"""Word-piece counts by a linear longest-match automaton.

A word is a run of bytes without white space. It is cut, with a space before
it, into vocabulary pieces, always the longest that fits next; pieces that
begin with a space start words, the others continue them. The trie of the
vocabulary has failure links: where no edge goes on, the pieces that are
certain by then are popped, and their number is stored with the link, so each
byte is read once and no piece is ever built. All 256 single bytes are in the
vocabulary, so every word can be cut.

Each distinct word of a slice of texts is counted once; a task keeps the
counts of at most CACHE words.

Defined results: null and blank texts have no words and no pieces; rows alike
give rows alike; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.textvec import Words, slices, unlike

CACHE = 500_000


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0] = 255  # 0 marks separators; a NUL is a piece of its own, as 0xFF is
    t[list(b" \t\n\x0b\x0c\r")] = 0
    return t


RAW = _table()


class Automaton:
    """edges: node << 8 | byte -> node; per node its failure link, the pieces
    popped on the way, and those popped until the root at a word's end."""

    def __init__(self, pieces: Iterable[bytes]):
        edges: dict[int, int] = {}
        parent, byte, final = [0], [0], [False]
        for piece in pieces:
            node = 0
            for c in piece:
                key = node << 8 | c
                if key not in edges:
                    edges[key] = len(parent)
                    parent.append(node)
                    byte.append(c)
                    final.append(False)
                node = edges[key]
            final[node] = True
        missing = [c for c in range(256) if c not in edges or not final[edges[c]]]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        children: list[list[int]] = [[] for _ in parent]
        for v in range(1, len(parent)):
            children[parent[v]].append(v)
        link, popped, rest = ([0] * len(parent) for _ in range(3))
        queue = deque(children[0])
        while queue:  # by depth
            v = queue.popleft()
            queue.extend(children[v])
            if final[v]:
                popped[v] = 1
            else:
                at, count = link[parent[v]], popped[parent[v]]
                while (at << 8 | byte[v]) not in edges:
                    count += popped[at]
                    at = link[at]
                link[v], popped[v] = edges[at << 8 | byte[v]], count
            rest[v] = popped[v] + rest[link[v]]
        self.edges, self.link, self.popped, self.rest = edges, link, popped, rest

    def count(self, word: bytes) -> int:
        edges, link, popped = self.edges, self.link, self.popped
        node = total = 0
        for c in word:
            while (to := edges.get(node << 8 | c)) is None:
                total += popped[node]
                node = link[node]
            node = to
        return total + self.rest[node]


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a file of base64 pieces and ranks."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


_automata: dict[str, tuple[Automaton, dict[bytes, int]]] = {}


def automaton(path: str) -> tuple[Automaton, dict[bytes, int]]:
    if path not in _automata:
        _automata[path] = Automaton(vocabulary(path)), {}
    return _automata[path]


def token_counts(docs: DataFrame, vocab: str) -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens of each row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = automaton(vocab)
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for _, _, data, offs in slices(batch.column("text")):
                w = Words(data, offs, RAW)
                _, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
                odd = np.flatnonzero(unlike(w.bytes, w.start, w.end, at[back]))  # an equal hash by chance
                back[odd] = len(at) + np.arange(len(odd))
                at = np.concatenate([at, odd])
                if len(known) > CACHE:
                    known.clear()
                raw, counts = w.bytes.tobytes(), np.zeros(len(at), np.int64)
                for i, (a, b) in enumerate(zip(w.start[at].tolist(), w.end[at].tolist())):
                    word = raw[a:b]
                    n = known.get(word)
                    if n is None:
                        n = machine.count(b" " + word)
                        if b - a <= 64:
                            known[word] = n
                    counts[i] = n
                total = np.concatenate(([0], np.cumsum(counts[back])))
                for o, x in zip(out, (np.diff(offs), np.diff(w.first), total[w.first[1:]] - total[w.first[:-1]])):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.concatenate(o) if o else [], pa.int64()) for o in out)], ["doc_id", "n_bytes", "n_words", "n_tokens"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_words long, n_tokens long")
