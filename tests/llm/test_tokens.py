"""The token store against encoding each text by itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marginalia.llm import tokens
from tests.conftest import DATA

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(PATH, cache=300)


def test_bits():
    assert [tokens.width(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    rng = np.random.default_rng(2)
    for bits in (1, 3, 8, 13, 16, 17, 31, 32):
        ids = rng.integers(0, 2**bits, 1001, dtype=np.uint32)
        packed = tokens.pack(ids, bits)
        assert len(packed) == -(-1001 * bits // 8)
        for start, count in ((0, 1001), (7, 3), (1000, 1), (500, 0)):
            assert (tokens.unpack(packed, bits, start, count) == ids[start : start + count]).all()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Zé\n\t 1'!.　\x85\x1c日<|>"), max_size=25), max_size=6))
def test_pieces_give_what_whole_texts_give(encoder, plain, texts):
    assert [ids.tolist() for ids in encoder.encode(texts)] == [plain(t) for t in texts]


def test_pieces_of_one_hash_are_told_apart_by_their_bytes(plain, monkeypatch):
    """A hash by length alone: "ab" and "cd" meet, in one call and over calls."""
    monkeypatch.setattr(tokens.P, "hashes", lambda raw, starts, ends: (ends - starts).astype(np.uint64))
    made = tokens.Encoder(PATH)
    for texts in (["ab cd ef", "xy ab"], ["cd", "ab zz", "", "ab"], ["ab cd ef"]):
        assert [ids.tolist() for ids in made.encode(texts)] == [plain(t) for t in texts]


def test_memory_is_bounded_by_pieces_and_bytes(plain):
    made, rng = tokens.Encoder(PATH, cache=100), random.Random(8)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("abcdef") for _ in range(rng.choice([2, 5, 400]))) for _ in range(40))]
        assert made.encode(texts)[0].tolist() == plain(texts[0])
        assert len(made.keys) <= 100 + 40 and len(made.raw) <= 32 * 100 + 41 * 401
    assert len(made.uses) == len(made.rows) == len(made.raw_at) - 1 == len(made.ids_at) - 1


def test_a_text_longer_than_a_slice(plain):
    rng = random.Random(9)
    text = "".join(rng.choice([" word", "\n\nline", " é", "  two", "\t"]) for _ in range(400_000))
    for one in (text, "x" * 3000 + text + " "):
        assert len(one.encode()) > tokens.W.SLICE
        got = tokens.Encoder(PATH).encode(["before", one, "", "after"])
        assert [g.tolist() for g in got] == [plain(t) for t in ("before", one, "", "after")]


def test_special_strings_are_text(encoder, plain):
    text = "a <|endoftext|> b<|endoftext|>"
    assert encoder.encode([text])[0].tolist() == plain(text)
    assert 50256 not in plain(text)


def _want(rows, plain):
    key = lambda r: (r[0] is not None, r[0] or 0)
    out, at = [], 0
    for d, text in sorted(rows, key=key):
        ids = [*plain(text), 0]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def _got(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


def test_table(spark, plain):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert _got(tokens.encoded(docs, tokenizer=PATH)) == _want([(r.doc_id, r.text) for r in docs.collect()], plain)


def test_odd_rows(spark, plain):
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "beta", "x  y", "q\n", " "]) for _ in range(200_000))
    rows = [(5, "a b"), (5, "a b"), (None, "null id"), (1, None), (2, ""), (3, "   "), (-7, "é"), (9, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as start", "3 as n_tokens")
    assert _got(tokens.encoded(docs, tokenizer=PATH)) == _want(rows, plain)
    assert _got(tokens.encoded(docs.limit(0), tokenizer=PATH)) == []


def test_store_has_the_library_s_ids_of_special_names(spark):
    made = Tokenizer.from_file(PATH)
    default = lambda text: made.encode(text or "", add_special_tokens=False).ids
    assert default("end <|endoftext|> of") == [437, 220, 50256, 286]
    rng = random.Random(6)
    pieces = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "end", " of", "\n", "é"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))) for i in range(300)]
    rows += [(900, "end <|endoftext|> of"), (901, "a  <|endoftext|>  b"), (902, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _got(tokens.encoded(docs, tokenizer=PATH)) == _want(rows, default)


def test_random_access(spark, plain, tmp_path):
    rows = [(i, f"document number {i} " * (i % 7)) for i in range(200)]
    path = str(tmp_path / "store")
    tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, tokenizer=PATH, block_ids=100)
    blocks = {(r.shard, r.block): r for r in spark.read.parquet(path).collect()}
    assert len(blocks) > 10
    for r in tokens.read_tokens(spark, path).collect():
        block = blocks[r.shard, r.block]
        assert r.ids == [*plain(rows[r.doc_id][1]), 0]
        assert tokens.unpack(block.packed, block.bits, r.place, r.n_tokens).tolist() == r.ids
