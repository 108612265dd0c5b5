"""Around a model: gazetteer, chunks, token alignment, spans of tokens, their repair."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake import rules
from spanlake.functions.arrow import arrow
from spanlake.functions.spans import SPANS, byte_slice, lookup, no_spans, scan

def gazetteer(text: Column, entries: Sequence[tuple[str, str, float]] = rules.GAZETTEER) -> Column:
    """All occurrences of the entries as a model's spans, by start."""
    import re

    found = [scan(text, re.escape(name).replace(r"\ ", " "), kind, score, i, source="ner") for i, (name, kind, score) in enumerate(entries)]
    return F.array_sort(F.concat(*found)) if found else no_spans()


# ---- chunks

MAX_CHARS, OVERLAP, EARLIEST = 5000, 256, 0.6


def char_chunks(text: str, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Overlapping code point ranges of at most limit, ending at white space if there is
    some in their last part."""
    at, n = 0, len(text)
    while True:
        end = min(at + limit, n)
        if end < n:
            for i in range(end, at + int(limit * EARLIEST), -1):
                if text[i - 1].isspace():
                    end = i
                    break
        if end > at:
            yield at, end
        if end >= n:
            return
        at = max(end - overlap, at + 1)


def token_chunks(count: int, limit: int = 480, overlap: int = 64) -> Iterator[tuple[int, int]]:
    """Overlapping ranges of token numbers."""
    at = 0
    while at < count:
        end = min(at + limit, count)
        yield at, end
        if end == count:
            return
        at = end - overlap


def fitted(text: str, tokens, limit: int) -> list[tuple[int, int]]:
    """Halves of a range, and theirs, until each has at most limit tokens (a function of text)."""
    todo, out = [(0, len(text))], []
    while todo:
        a, b = todo.pop()
        if b - a <= 1 or tokens(text[a:b]) <= limit:
            out.append((a, b))
            continue
        mid = (a + b) // 2
        space = max(text.rfind(" ", a + 1, mid), text.rfind("\n", a + 1, mid))
        mid = space + 1 if space > a + (b - a) // 4 else mid
        todo += [(mid, b), (a, mid)]
    return [r for r in out if r[0] < r[1]]


def parts_count_alone(state: str) -> bool:
    """Whether a tokenizer (its JSON) cuts texts at words by the byte-level pattern and encodes each word by itself."""
    import json

    t = json.loads(state)
    pre = t.get("pre_tokenizer") or {}
    return t.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and t["model"].get("type") == "BPE" and not t["model"].get("dropout")


def counted(text: str, encoding, a: int, b: int, start: int, end: int, tokens) -> int:
    """Tokens of text[start:end], the place of the tokens a to b of the whole text: words within are
    the same as there, so only the first and the last are encoded again; or all, where that can't be told."""
    offsets, words = encoding
    i, j = a + 1, b - 1
    while i < b and words[i] == words[i - 1]:
        i += 1
    while j > i and (words[j] == words[j - 1] or text[offsets[j - 1][1] - 1].isspace()):
        j -= 1
    if i < j:
        q, p = offsets[i - 1][1], offsets[j - 1][1]
        if start < q and text[start:q].isalpha() and not text[q].isalpha():
            return tokens(text[start:q]) + j - i + tokens(text[p:end])
    return tokens(text[start:end])


class TokenChunks:
    """A table function: (text, tokenizer file, limit, overlap) -> a row for each chunk of at most limit tokens.

    Chunks begin at tokens and reach to where the next chunk's first new token begins, so
    they cover all characters; each is counted as encoded by itself, and one that has more tokens so is halved
    until its parts fit (one character at least).
    """

    def __init__(self) -> None:
        self.known: dict = {}

    def eval(self, text: str | None, path: str, limit: int, overlap: int) -> Iterator[tuple[int, int, int, int]]:
        if not text:
            return
        if path not in self.known:
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(path)
            self.known[path] = made, parts_count_alone(made.to_str())
        tokenizer, alone = self.known[path]
        encode = lambda t: tokenizer.encode(t, add_special_tokens=False)
        size = lambda t: len(encode(t).ids)
        whole = encode(text)
        offsets, words, n = whole.offsets, whole.word_ids, 0
        for a, b in token_chunks(len(offsets), limit, min(overlap, limit - 1)) if offsets else [(0, 0)]:
            start, end = offsets[a][0] if a else 0, offsets[b][0] if b < len(offsets) else len(text)
            if b < len(offsets) and offsets[b][0] < offsets[b - 1][1]:
                end = offsets[b - 1][1]  # the boundary is within a character
            if not offsets:
                count = 0
            elif len(offsets) <= limit:
                count = len(offsets)
            else:
                count = counted(text, (offsets, words), a, b, start, end, size) if alone else size(text[start:end])
            if count <= limit:
                yield n, start, end, count
                n += 1
                continue
            for x, y in fitted(text[start:end], size, limit):
                yield n, start + x, start + y, size(text[start + x : start + y])
                n += 1


def token_chunked(df: DataFrame, path: str, text: str = "text", limit: int = 480, overlap: int = 64) -> DataFrame:
    """df and a row for each token chunk of its text: chunk, start_char, end_char, tokens. Null and empty texts have none."""
    table = F.udtf(TokenChunks, returnType="chunk: int, start_char: int, end_char: int, tokens: int")
    return df.lateralJoin(table(F.col(text).outer(), F.lit(path), F.lit(limit), F.lit(overlap)))


RANGES = "array<struct<start_char:int,end_char:int,start_byte:int,end_byte:int>>"


def byte_chunks(text: str) -> list[dict]:
    """char_chunks() with their byte offsets."""
    own, byte, char = [], 0, 0
    for a, b in char_chunks(text):
        byte += len(text[char:a].encode()) if a >= char else -len(text[a:char].encode())
        char = a
        own.append({"start_char": a, "end_char": b, "start_byte": byte, "end_byte": byte + len(text[a:b].encode())})
    return own


def _chunk_ranges(text: Column) -> Column:
    """The chunks' places: texts are taken out of their Arrow batch one at a time, and no text is given back."""

    def places(texts: pa.Array) -> pa.Array:
        return pa.array([byte_chunks(t.as_py() or "") for t in texts], type=pa.list_(pa.struct([(n, pa.int32()) for n in ("start_char", "end_char", "start_byte", "end_byte")])))

    return F.arrow_udf(places, RANGES)(text)


def chunked(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key and one row for each chunk of its text; texts within the limit stay in the JVM, and all are cut there."""
    t = F.coalesce(F.col(text), F.lit(""))
    whole = F.array(F.struct(F.lit(0).alias("start_char"), F.length(t).alias("end_char"), F.lit(0).alias("start_byte"), F.octet_length(t).alias("end_byte"))).cast(RANGES)
    long = F.length(t) > MAX_CHARS
    chunks = F.when(long, _chunk_ranges(F.when(long, t).otherwise(F.lit("")))).when(t == "", F.array().cast(RANGES)).otherwise(whole)
    rows = df.select(key, t.alias("text__"), F.posexplode(chunks).alias("chunk", "c"))
    return rows.select(key, "chunk", "c.*", byte_slice(F.col("text__"), F.col("c.start_byte"), F.col("c.end_byte")).alias("text"))


def shifted(spans: Column, by: Column) -> Column:
    """Spans of a chunk as spans of the text."""
    return F.transform(spans, lambda s: s.withField("start", (s["start"] + by).cast("int")).withField("end", (s["end"] + by).cast("int")))


def merged_same_type(spans: DataFrame, key: str) -> DataFrame:
    """Of overlapping spans of one type (from overlapping chunks) the best: score, length,
    then place. Long form (key, start, end, entity_type, score, text). A fold over the
    spans of one text and type."""
    row = F.struct("start", "end", "score", "text")
    per = spans.groupBy(key, "entity_type").agg(F.array_sort(F.collect_set(row)).alias("s"))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        clash = F.coalesce((last["start"] < x["end"]) & (x["start"] < last["end"]), F.lit(False))
        size, before = x["end"] - x["start"], last["end"] - last["start"]
        better = (x["score"] > last["score"]) | ((x["score"] == last["score"]) & (size > before))
        return F.when(~clash, F.concat(acc, F.array(x))).when(better, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(x))).otherwise(acc)

    return per.select(key, "entity_type", F.explode(F.aggregate("s", F.slice("s", F.lit(1), F.lit(0)), step)).alias("m")).select(key, "m.start", "m.end", "entity_type", "m.score", "m.text")


# ---- labels

def model_label(raw: Column, kind: str = "general") -> Column:
    """The type of a model's label (without its position mark, words apart by _); null if unknown."""
    table = {label: t for t, labels in rules.MODEL_LABELS[kind].items() for label in labels.split()}
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), "^[BIbi]-", ""), r"^\[|\]$", "")
    for pattern, by in (("([a-z])([A-Z])", "$1_$2"), ("[^A-Za-z0-9]+", "_"), ("^_+|_+$", "")):
        clean = F.regexp_replace(clean, pattern, by)
    return lookup(table, F.upper(clean))


def gated(spans: Column, kind: str = "general") -> Column:
    """Spans that reach the least score of their type for a kind of model."""
    least = rules.MODEL_MINIMUM | rules.MODEL_GATE[kind]
    return F.filter(spans, lambda s: s["score"] >= F.coalesce(lookup(least, s["entity_type"]), F.lit(1.0)))


def with_raw_labels(spans: DataFrame, raw: DataFrame, key: str) -> DataFrame:
    """Spans with the raw label of the model's span that is the same."""
    return spans.join(raw.select(key, "start", "end", "entity_type", "raw_label"), [key, "start", "end", "entity_type"], "left")


# ---- tokens

META, BYTE_SPACE, PART = "▁", "Ġ", "##"
RESYNC, COVERED = 48, 0.8


class _Folds(dict):
    """What characters become when a text is folded, by code point; made as they are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = (unicodedata.normalize("NFD", c)[0].lower() or c)[:1]
        return self[code]


_FOLDS = _Folds()


def folded(text: str) -> str:
    """Lower case without accents, one character for each."""
    return text.lower() if text.isascii() else text.translate(_FOLDS)


def surface(piece: str) -> str:
    """A token's text without its marks of words' beginnings or parts."""
    return piece.replace(META, " ").replace(BYTE_SPACE, " ").removeprefix(PART).strip()


def aligned_tokens(text: str, pieces: Sequence[str]) -> list[tuple[int, int] | None] | None:
    """Code point ranges of a tokenizer's pieces, found in order; a piece that isn't within
    RESYNC characters has none. None if fewer than COVERED of the pieces are found."""
    low, at, out = folded(text), 0, []
    for piece in pieces:
        s = folded(surface(piece))
        if not s:
            out.append(None)
            continue
        i = low.find(s, at, at + RESYNC + len(s))
        out.append(None if i < 0 else (i, i + len(s)))
        at = at if i < 0 else i + len(s)
    solid = [r for r, p in zip(out, pieces) if surface(p)]
    return out if not solid or sum(r is not None for r in solid) >= COVERED * len(solid) else None


JOIN_GAP, LOOK_BACK, BRIDGE, CONFIDENT = 3, 3, 16, 0.9


def token_spans(text: str, tokens: Sequence[tuple[int, int, str | None, float]]) -> list[dict]:
    """Spans of tokens (start, end, type or None, score): neighbours of one type up to
    JOIN_GAP blank characters apart are one span; words are taken whole; the score is the
    mean over words of their first token's score."""
    out: list[dict] = []
    for a, b, kind, score in tokens:
        if kind is None:
            continue
        last = out[-1] if out else None
        new_word = not a or not (text[a - 1].isalnum() and a < len(text) and text[a].isalnum())
        if last and last["entity_type"] == kind and a - last["end"] <= JOIN_GAP and "\n" not in text[last["end"] : a] and not any(c.isalnum() for c in text[last["end"] : a]):
            last["end"] = b
            if new_word:
                last["scores"].append(score)
        else:
            out.append({"start": a, "end": b, "entity_type": kind, "scores": [score]})
    for s in out:
        while s["end"] < len(text) and text[s["end"]].isalnum() and text[s["end"] - 1].isalnum():
            s["end"] += 1
        while s["start"] and text[s["start"] - 1].isalnum() and text[s["start"]].isalnum():
            s["start"] -= 1
        scores = s.pop("scores")
        s["score"] = sum(scores) / len(scores)
    return out


def repaired(text: str, spans: Sequence[dict]) -> list[dict]:
    """Spans of one type with at most BRIDGE characters between them on one line are joined,
    unless a confident span of another type stands between."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        back = next((i for i in range(len(out) - 1, max(-1, len(out) - 1 - LOOK_BACK), -1) if out[i]["entity_type"] == s["entity_type"]), None)
        if back is not None:
            prior, between = out[back], out[back + 1 :]
            gap = text[prior["end"] : s["start"]]
            blocked = any(x["score"] >= CONFIDENT for x in between)
            if 0 <= s["start"] - prior["end"] <= BRIDGE and "\n" not in gap and not blocked and not any(c in ".;!?" for c in gap):
                prior["end"], prior["score"] = s["end"], max(prior["score"], s["score"])
                del out[back + 1 :]
                continue
        out.append(dict(s))
    return stitched(text, out)


def stitched(text: str, spans: list[dict]) -> list[dict]:
    """An address whose domain was cut off takes it in."""
    for s in spans:
        if s["entity_type"] == "EMAIL":
            while s["end"] < len(text) and (text[s["end"]].isalnum() or text[s["end"]] in "@.-_" and s["end"] + 1 < len(text) and text[s["end"] + 1].isalnum()):
                s["end"] += 1
    return spans


@arrow(SPANS)
def _spans_of_tokens(texts: pd.Series, words: pd.Series, kinds: pd.Series, scores: pd.Series) -> pd.Series:
    out = []
    for text, *items in zip(texts, words, kinds, scores):
        own = []
        if text is not None and items[0] is not None:
            ranges = aligned_tokens(text, items[0])
            if ranges is not None:
                rows = [(r[0], r[1], kind, float(score)) for r, kind, score in zip(ranges, items[1], items[2]) if r is not None]
                byte, char = 0, 0
                for i, s in enumerate(repaired(text, token_spans(text, rows))):
                    at = s["start"]
                    byte += len(text[char:at].encode()) if at >= char else -len(text[at:char].encode())
                    char = at
                    piece = text[at : s["end"]]
                    own.append({"start": byte, "end": byte + len(piece.encode()), "entity_type": s["entity_type"], "score": s["score"], "text": piece, "source": "ner", "ord": i})
        out.append(own)
    return pd.Series(out)


def spans_of_tokens(text: Column, tokens: Column) -> Column:
    """A model's spans from its token items: ARRAY<STRUCT<word, entity (a type or null), score>>."""
    return _spans_of_tokens(text, *(tokens.getField(k) for k in ("word", "entity", "score")))
