"""Token counts of byte-level BPE by a compiled finite-state transducer.

A transducer reads the bytes of one pre-token. Its state holds the longest suffix read that begins some token, and the last token
of the encoding at each position of that suffix: all that can matter for what follows, and so finitely many states. A transition
carries the change in the number of tokens that one more byte makes. The vocabulary has far more transitions than texts use, so they
are compiled when first taken and kept. Beyond ``MAX_STATES`` states the tables are started anew, in the middle of a pre-token too: what
outlives a reading holds a state's content, not its number.

The last token of an encoding that grew by a byte is the one token that ends there and that may follow the last token of what
stands before it; two tokens may follow each other if encoding their joined bytes gives them back.

Around it, a transducer over characters finds the borders of pre-tokens: its state is (kind of run, state within the pre-token,
characters that wait for what follows), so contractions and the last blank of a run need no look-ahead. ``step`` is its transition.
A pre-token that is read from its start to its end is one transition of its own, kept in a memo.

A long text is read in chunks. Each chunk becomes a map from the state before it to (state after it, tokens emitted). After the first
change of character class the state is the same for all states before, so a chunk is read once, and only its head once for each
state that reaches it. Maps compose associatively, and a prefix scan by doubling steps gives the count up to the end of each chunk.

Defined results: a null or empty text has no tokens; special strings in a text count as one token each; texts of any length are
read whole; extra columns are carried along, and columns named like the new ones are replaced.
"""

from __future__ import annotations

import functools
import json
import re

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_arrow, small_batches, table

# Fixed values of the byte-level format: white space, the pre-token pattern, the printable bytes that stand for themselves.
SPACE = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

CHUNK, MAX_STATES, MAX_MEMO = 1 << 16, 400_000, 400_000
# Fixed values of the pre-token format: how contractions go on after the apostrophe.
CONTRACTIONS = {"s", "t", "m", "d", "re", "ve", "ll"}
EMPTY = (b"", (-1,), (0,))
START = ("start", EMPTY, "")


class StateMap:
    """A map from states to (state, tokens), worked out for the states that reach it."""

    def __init__(self, of):
        self.of, self.known = of, {}

    def __call__(self, state):
        if (got := self.known.get(state)) is None:
            got = self.known[state] = self.of(state)
        return got

    def then(self, other: "StateMap") -> "StateMap":
        def both(state):
            middle, n = self(state)
            last, m = other(middle)
            return last, n + m

        return StateMap(both)


def prefix_scan(maps: list[StateMap]) -> list[StateMap]:
    """Each map composed with all before it: log n rounds, in each of which all compositions are independent."""
    d = 1
    while d < len(maps):
        maps = [maps[i - d].then(m) if i >= d else m for i, m in enumerate(maps)]
        d *= 2
    return maps


class Transducer:
    """Token counts of pre-tokens for the vocabulary in a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        others = iter(range(256, 512))
        byte = {chr(b if b in set(PRINTABLE) else next(others)): b for b in range(256)}
        self.token = {bytes(byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if all(c in byte for c in piece)}
        self.bytes = {i: t for t, i in self.token.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        name = spec["model"]["vocab"]
        self.rank = {(name[a], name[b]): (k, name[a + b]) for k, (a, b) in enumerate(pairs)}
        self.live = {t[:k] for t in self.token for k in range(1, len(t))} | {b""}
        self.specials = [x["content"] for x in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.pieces = regex.compile(PRE_TOKEN).findall
        # Where the state is the same whatever came before: class changes, but for blanks and what an apostrophe may begin.
        change = rf"(?<=\p{{L}})(?=\P{{L}})|(?<=\p{{N}})(?=\P{{N}})|(?<=[^{SPACE}\p{{L}}\p{{N}}'])(?=[{SPACE}\p{{L}}\p{{N}}])|(?<=')(?=[{SPACE}\p{{N}}])"
        self.border, self.last_border = regex.compile(change), regex.compile("(?r)" + change)
        self.is_kind = [(kind, regex.compile(f"[{chars}]").match) for kind, chars in (("space", SPACE), ("letters", r"\p{L}"), ("numbers", r"\p{N}"))]
        self.kinds: dict[str, str] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.memo = _Memo(self.run)
        self.reset()

    def reset(self):
        self.states, self.ids = [], {}
        self.steps: dict[int, int] = {}
        self.number(EMPTY)

    def number(self, key) -> int:
        if (known := self.ids.get(key)) is None:
            known = self.ids[key] = len(self.states)
            self.states.append(key)
        return known

    def merged(self, data: bytes) -> list[int]:
        """The encoding of a few bytes, by the merge rules themselves."""
        ids = [self.token[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            best = min((self.rank.get(p, (1 << 30, 0)) for p in zip(ids, ids[1:])), key=lambda x: x[0])
            if best[0] == 1 << 30:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.rank.get((ids[i], ids[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def may_follow(self, a: int, b: int) -> bool:
        known = self.follows.get((a, b))
        if known is None:
            if len(self.follows) > MAX_MEMO:
                self.follows.clear()
            known = self.follows[a, b] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def compile(self, state: int, byte: int) -> int:
        """The transition's next state and emitted count, packed as ``next << 16 | emitted + 128 << 8``."""
        suffix, last, count = self.states[state]
        read = suffix + bytes((byte,))
        for k in range(len(read)):
            t = self.token.get(read[k:])
            if t is not None and (last[k] < 0 or self.may_follow(last[k], t)):
                break
        emitted = count[k] + 1
        cut = next(k for k in range(len(read) + 1) if read[k:] in self.live)
        key = (read[cut:], (*last, t)[cut:], (*(c - emitted for c in count), 0)[cut:])
        new = self.number(key)
        if not -128 <= emitted < 128:
            raise OverflowError(f"a byte changes the count by {emitted}")
        step = self.steps[state << 8 | byte] = new << 16 | emitted + 128 << 8
        return step

    def run(self, piece: str) -> int:
        return self.feed(EMPTY, piece)[1]

    def feed(self, state: tuple, piece: str) -> tuple[tuple, int]:
        """(state, change of the count) after more characters of one pre-token."""
        n, at, steps = 0, self.number(state) << 8, self.steps
        for b in piece.encode("utf-8", "surrogatepass"):
            step = steps.get(at | b)
            if step is None:
                if len(self.states) >= MAX_STATES:
                    now = self.states[at >> 8]
                    self.reset()
                    at, steps = self.number(now) << 8, self.steps
                step = self.compile(at >> 8, b)
            n += (step >> 8 & 255) - 128
            at = step >> 16 << 8
        return self.states[at >> 8], n

    def kind(self, c: str) -> str:
        if (known := self.kinds.get(c)) is None:
            if len(self.kinds) > MAX_MEMO:
                self.kinds.clear()
            known = self.kinds[c] = next((k for k, fits in self.is_kind if fits(c)), "others")
        return known

    def step(self, state, c: str):
        """(state, tokens) after one more character of a text."""
        run, at, waiting = state
        kind = self.kind(c)
        if run == "apostrophe":
            said = waiting + c
            if said in CONTRACTIONS:
                return START, self.run("'" + said)
            if any(x.startswith(said) for x in CONTRACTIONS):
                return ("apostrophe", EMPTY, said), 0
            at, n = self.feed(EMPTY, "'")
            if not waiting:
                after, m = self.step(("others", at, ""), c)
                return after, n + m
            at, m = self.feed(EMPTY, waiting)
            after, k = self.step(("letters", at, ""), c)
            return after, n + m + k
        if run == "space":
            if kind == "space":
                at, n = self.feed(at, waiting)
                return ("space", at, c), n
            if waiting == " ":
                at, n = self.feed(EMPTY, waiting + c)
                return (kind, at, ""), n
            after, n = self.step(START, c)
            return after, n + self.run(waiting)
        if run == kind:
            at, n = self.feed(at, c)
            return (kind, at, ""), n
        if c == "'":
            return ("apostrophe", EMPTY, ""), 0
        if kind == "space":
            return ("space", EMPTY, c), 0
        at, n = self.feed(EMPTY, c)
        return (kind, at, ""), n

    def finish(self, state) -> int:
        """Tokens that the waiting characters make at a text's end, or before a border."""
        run, at, waiting = state
        if run == "apostrophe":
            return self.run("'") + (self.run(waiting) if waiting else 0)
        return self.feed(at, waiting)[1]

    def read(self, state, text: str):
        n = 0
        for c in text:
            state, m = self.step(state, c)
            n += m
        return state, n

    def tokens(self, text: str) -> int:
        return sum(map(self.memo.__getitem__, self.pieces(text)))

    def chunk_map(self, text: str) -> StateMap:
        first = self.border.search(text)
        if first is None:
            return StateMap(lambda state: self.read(state, text))
        first, last = first.start(), self.last_border.search(text).start()
        head = text[:first]
        after, rest = self.read(START, text[last:])
        rest += self.tokens(text[first:last])

        def of(state):
            state, n = self.read(state, head)
            return after, n + self.finish(state) + rest

        return StateMap(of)

    def plain(self, text: str) -> int:
        if len(text) <= CHUNK:
            return self.tokens(text)
        state, n = prefix_scan([self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)])[-1](START)
        return n + self.finish(state)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


class _Memo(dict):
    """Counts of pre-tokens seen, up to a number of them; long ones are not kept."""

    def __init__(self, run):
        self.run = run

    def __missing__(self, piece):
        n = self.run(piece)
        if len(piece) <= 32:
            if len(self) >= MAX_MEMO:
                self.clear()
            self[piece] = n
        return n


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(docs: DataFrame, path: str, *, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text under the tokenizer file at ``path`` (read on the executors)."""
    small_batches(docs.sparkSession)

    def make(batch):
        import pyarrow as pa

        count = transducer(path).count
        return [pa.array([count(x.as_py()) for x in batch.column(text)], pa.int64())]

    return append_arrow(docs, f"{out} long", make)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
