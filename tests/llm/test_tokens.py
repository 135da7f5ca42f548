import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from fixtures import documents, texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import sentencepiece_codec as spc
from tessella.llm import token_counts as tc

PARTS = ["a", "b", "the", " ", "  ", "\n", "'s", "'re", "é", "ß", "日", "1", "23", "!", "<|endoftext|>", "\t", "ing", "tion", "er", "▁", "<s>", "00", "--", "…", "\u0085", "\u2003", "😀"]


def fuzz(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def bpe():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_transducer_counts_as_the_library(bpe, monkeypatch):
    machine = tc.Transducer(bpe[0])
    for chunk in (1 << 16, 7):
        monkeypatch.setattr(tc, "CHUNK", chunk)
        for x in fuzz(800, chunk) + [t for t in texts() if t]:
            assert machine.count(x) == len(bpe[1].encode(x, add_special_tokens=False).ids), x
    assert machine.count(None) == machine.count("") == 0


def test_character_transducer_and_scan(bpe):
    machine = tc.Transducer(bpe[0])
    for x in fuzz(1500, 21) + ["'r", "'re", "'rx", "''s", " 's", "a'll", "'", "x'", " \n a", "\n\na", "  ", "5'd6", "日本。語a1!", "don't we've I'LL 'T"]:
        state, n = machine.read(tc.START, x)
        want = machine.tokens(x)
        assert n + machine.finish(state) == want, x
        maps = tc.prefix_scan([machine.chunk_map(x[i : i + 3]) for i in range(0, len(x), 3)])
        for k, m in enumerate(maps):
            state, n = m(tc.START)
            assert n + machine.finish(state) == machine.tokens(x[: 3 * k + 3]), (x, k)
    long = "ab" * 200_000
    assert machine.count(long) == len(bpe[1].encode(long).ids)


@pytest.mark.parametrize("chunk", [1 << 16, 40])
def test_states_stay_bounded_within_a_text(bpe, monkeypatch, chunk):
    monkeypatch.setattr(tc, "CHUNK", chunk)
    monkeypatch.setattr(tc, "MAX_STATES", 50)
    machine = tc.Transducer(bpe[0])
    most, number = 0, machine.number

    def watched(key):
        nonlocal most
        got = number(key)
        most = max(most, len(machine.states))
        return got

    machine.number = watched
    for x in [*fuzz(300, 77), "".join(chr(97 + i * i % 26) for i in range(5000)), "don't " * 300 + "xyz" * 2000, " ".join(f"w{i}q" for i in range(3000))]:
        assert machine.count(x) == len(bpe[1].encode(x, add_special_tokens=False).ids), x[:50]
    assert 25 < most <= 52


def test_count_tokens_frame(spark, bpe):
    docs = documents(spark)
    got = tc.count_tokens(docs, bpe[0]).collect()
    assert sorted((r.n_tokens for r in got)) == sorted(len(bpe[1].encode(t or "").ids) for t in texts())
    assert tc.count_tokens(docs.limit(0), bpe[0]).count() == 0


def test_pieces_as_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=path), spc.Codec(path)
    for x in fuzz(2000, 5) + [t for t in texts() if t]:
        ids = sp.encode(x)
        assert codec.encode(x) == ids and codec.decode(ids) == sp.decode(ids), x
    got = spc.digests(spc.encode_texts(documents(spark), path)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(len(i), sha(",".join(map(str, i))), sha(sp.decode(i))) for i in (sp.encode(t or "") for t in texts())]
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert spc.encode_texts(documents(spark, []), path).count() == 0


def test_clashing_columns_and_registered_queries(spark, small):
    path, model = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    odd = documents(spark).withColumn("n_tokens", F.lit("x")).withColumn("ids", F.lit("x"))
    assert dict(tc.count_tokens(odd, path).dtypes)["n_tokens"] == "bigint" and tc.count_tokens(odd, path).count() == odd.count()
    assert spc.encode_texts(odd, model).count() == odd.count()
    assert tc.op8_token_counts(spark, small).dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    assert spc.op9_sentencepiece(spark, small).dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
