"""Exact encoding and decoding for merge-type SentencePiece vocabularies, by backtracking.

An Aho-Corasick automaton lists the pieces that start at each position. The encoder takes the longest one that may follow the
piece before it; two pieces may follow each other if merging their joined characters anew, best score first and leftmost on ties,
gives exactly these two. Where no piece fits, the position is marked in a bitfield and the encoder steps back. The encoding of a
prefix is unique, so a position that failed once always fails.

Text is cut where no piece spans: before each run of space marks, around characters that no longer piece holds, and between a
letter and what follows no letter in any piece. Such segments are encoded independently and remembered up to a bound.

Defined results: a null or empty text has no ids and decodes to an empty text; characters outside the vocabulary become byte
pieces; texts of any length are encoded whole; extra columns are carried along, columns named like the new ones are replaced.
"""

from __future__ import annotations

import functools
from array import array

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_arrow, small_batches, table

MARK = "▁"
MAX_MEMO, MAX_WORDS, MAX_PAIRS, MAX_KEPT = 60_000, 400_000, 200_000, 48


class Codec:
    """``encode`` and ``decode`` for one model file."""

    def __init__(self, path: str, words: int = MAX_WORDS):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.score, self.byte_id, self.byte_of, self.find = {}, {}, {}, ahocorasick.Automaton()
        self.id = {}
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.byte_of[i] = int(p[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[p] = i
                self.score[p] = sp.get_score(i)
                self.find.add_word(p, i)
        self.find.make_automaton()
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece holds a space mark after another character")
        # The next shorter piece that a piece begins with, or -1.
        self.shorter = [next((self.id[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id), -1) if p in self.id else -1 for p in self.pieces]
        if not all(c in self.id for p in self.id for c in p):
            raise ValueError("a character of a piece is no piece")
        inner = {c for p in self.id if len(p) > 1 for c in p} - {MARK}
        pairs = {(a, b) for p in self.id for a, b in zip(p, p[1:])}
        tail = {c for c in inner if c.isalpha()}
        while more := {b for a, b in pairs if a in tail and b not in tail}:
            tail |= more
        kind = lambda chars: "[" + "".join(map(regex.escape, sorted(chars))) + "]"
        head, tail = kind(inner - tail), kind(tail)
        self.segments = regex.compile(f"{MARK}+{head}*+{tail}*+|{head}++{tail}*+|{tail}++|(?s:.)").findall
        # What a piece decodes to; control pieces to nothing, the unknown piece to its surface.
        self.spaced = [p.replace(MARK, " ") if p in self.id else " \u2047 " if sp.is_unknown(i) else "" for i, p in enumerate(self.pieces)]
        self.length = list(map(len, self.pieces))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo = _Memo(self)
        self.words = _Words(self, words)

    def merged(self, text: str) -> list[str]:
        """The encoding of a few characters, by merging itself."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            x, y = self.pieces[a], self.pieces[b]
            known = self.pairs[a, b] = self.merged(x + y) == [x, y]
        return known

    def segment(self, text: str) -> list[int]:
        n = len(text)
        if n == 1:
            i = self.id.get(text)
            return [i] if i is not None else [self.byte_id[b] for b in text.encode("utf-8", "surrogatepass")]
        longest, length, shorter, known = self.find.iter_long, self.length, self.shorter, self.pairs
        greedy = [i for _, i in longest(text)]
        for pair in zip(greedy, greedy[1:]):
            if not (known[pair] if pair in known else self.may_follow(*pair)):
                break
        else:
            return greedy
        failed = 0  # a bit for each position from which no path reaches the end
        path: list[int] = []
        at, last, i = 0, -1, greedy[0]
        while at < n:
            while i >= 0:
                end = at + length[i]
                if not failed >> end & 1 and (last < 0 or (known[last, i] if (last, i) in known else self.may_follow(last, i))):
                    break
                i = shorter[i]
            if i >= 0:
                path.append(i)
                at, last = end, i
                if at < n:
                    i = next(longest(text, at))[1]
            else:
                failed |= 1 << at
                i = path.pop()
                at -= length[i]
                last, i = path[-1] if path else -1, shorter[i]
        return path

    def coded(self, text: str) -> list[tuple[bytes, str]]:
        """(ids in bytes, their text) of consecutive parts of a text. Words between single spaces are parts of their own, as no
        piece holds a mark after another character; other texts are cut into segments."""
        words = text.split(" ") if text else []
        if "" in words or MARK in text:
            return list(map(self.memo.__getitem__, self.cut(text)))
        return list(map(self.words.__getitem__, words))

    def cut(self, text: str) -> list[str]:
        return self.segments(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str | None) -> list[int]:
        return [i for s in self.cut(text or "") for i in self.segment(s)]

    def fragment(self, ids) -> str:
        """The text of whole segments, the leading mark kept as a space."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.spaced[i] for i in ids])
        out = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is None:
                out += self.spaced[i].encode("utf-8", "surrogatepass")
            else:
                out.append(b)
        return out.decode("utf-8", "replace")

    def decode(self, ids) -> str:
        text = self.fragment(ids)
        return text[1:] if text.startswith(" ") and len(ids) and self.pieces[ids[0]].startswith(MARK) else text


class _Memo(dict):
    """Segment -> (ids as 32-bit integers in bytes, their text)."""

    def __init__(self, codec):
        self.codec = codec

    def __missing__(self, text):
        ids = self.codec.segment(text)
        made = array("i", ids).tobytes(), self.codec.fragment(ids)
        if len(text) <= MAX_KEPT:
            if len(self) >= MAX_MEMO:
                self.clear()
            self[text] = made
        return made


class _Words(dict):
    """Word -> the same of the word with a mark before it."""

    def __init__(self, codec, most: int):
        self.codec, self.most = codec, most

    def __missing__(self, word):
        parts = list(map(self.codec.memo.__getitem__, self.codec.segments(MARK + word)))
        made = parts[0] if len(parts) == 1 else (b"".join([p[0] for p in parts]), "".join([p[1] for p in parts]))
        if len(word) <= MAX_KEPT:
            if len(self) >= self.most:
                self.clear()
            self[word] = made
        return made


@functools.lru_cache(maxsize=2)
def codec(path: str, words: int = MAX_WORDS) -> Codec:
    return Codec(path, words)


def encode_texts(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids", decoded: str = "decoded", words: int = MAX_WORDS) -> DataFrame:
    """``docs`` with the ids of each whole text under the model file at ``path`` (read on the executors), and those ids decoded. A
    Python worker remembers up to ``words`` words: fewer take less memory and more time."""
    small_batches(docs.sparkSession)

    def make(batch):
        import numpy as np
        import pyarrow as pa

        c = codec(path, words)
        flat, ends, texts = [], [0], []
        for x in batch.column(text).to_pylist():
            made = c.coded(x or "")
            flat.append(b"".join([m[0] for m in made]))
            ends.append(ends[-1] + len(flat[-1]) // 4)
            texts.append("".join([m[1] for m in made])[1:])  # without the mark that encoding put in front
        values = pa.array(np.frombuffer(b"".join(flat), dtype=np.int32))
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array(texts, pa.string())]

    return append_arrow(docs, f"{ids} array<int>, {decoded} string", make)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text"))


def digests(encoded: DataFrame) -> DataFrame:
    """The columns that the query returns, from ``ids`` and ``decoded``."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
