"""Encoding, decoding and counting against the public libraries."""

import base64
import hashlib
import random

import pyarrow as pa
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from grainwise.llm import byte_bpe, chat, pretokens, token_counts
from grainwise.llm import textblocks as tb

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "abstmdrvle'' \n\t　é1²٣,.!-S中𐍈́"


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def texts() -> list[str]:
    random.seed(3)
    some = ["", "a", " ", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "a" * 3000, "=" * 2999, " " * 500, "ab" * 1500, "的一是不了人我在" * 400]
    some += ["".join(random.choices(ALPHABET, k=random.randint(1, 40))) for _ in range(300)]
    return some + ["".join(random.choices("abcdehtn", k=600)), "".join(random.choices("éèabcd", k=400))]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), min_size=1, max_size=5))
def test_pretokens_follow_the_pattern(found):
    data, offsets = tb.flat(pa.array(found))
    starts, ends, owner = pretokens.split(data, offsets)
    got = [[] for _ in found]
    for s, e, i in zip(starts, ends, owner, strict=True):
        got[i].append(data[s:e].tobytes().decode())
    assert got == [regex.findall(public_tokenizers.PATTERN, t) for t in found]


def test_encoding_equals_the_library_and_decodes(encoding):
    for text, (ids, decoded) in zip(texts(), byte_bpe.encode_texts(pa.array(texts()), RANKS), strict=True):
        assert ids.decode() == ",".join(map(str, encoding.encode_ordinary(text)))
        assert decoded == text.encode()


def test_counts_equal_the_library(library):
    size, tokens = token_counts.count_tokens(pa.array(texts()), JSON)
    assert tokens.tolist() == [len(e.ids) for e in library.encode_batch(texts(), add_special_tokens=False)]
    assert size.tolist() == [len(t.encode()) for t in texts()]


def test_counts_survive_a_fresh_compilation(library, monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_TRANSITIONS", 50)
    size, tokens = token_counts.count_tokens(pa.array(texts()[10:60]), JSON)
    assert tokens.tolist() == [len(e.ids) for e in library.encode_batch(texts()[10:60], add_special_tokens=False)]


def test_words_are_told_apart_by_their_bytes(encoding, library):
    bits = [bin(k).count("1") % 2 for k in range(2048)]  # polynomial hashes modulo powers of two collide on these
    both = ["".join("eq"[b] for b in bits), "".join("qe"[b] for b in bits)]
    for text, (ids, _) in zip(both, byte_bpe.encode_texts(pa.array(both), RANKS), strict=True):
        assert ids.decode() == ",".join(map(str, encoding.encode_ordinary(text)))
    assert token_counts.count_tokens(pa.array(both), JSON)[1].tolist() == [len(e.ids) for e in library.encode_batch(both, add_special_tokens=False)]


def test_transitions_stay_bounded_inside_a_word(library, monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_TRANSITIONS", 500)
    random.seed(6)
    word = "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=20_000))
    tool = token_counts.MergeTransducer(JSON)
    assert tool.count(word.encode()) == len(library.encode(word, add_special_tokens=False).ids)
    assert len(tool.step) <= 500


def test_token_queries_on_odd_rows(spark, encoding):
    rows = [(1, None, "n"), (None, "", "n"), (2, "same text", "n"), (2, "same text", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(byte_bpe.encoded(docs, ["doc_id"], RANKS, with_ids=True).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(1, 0), (2, len(encoding.encode_ordinary("same text"))), (2, len(encoding.encode_ordinary("same text"))), (None, 0)]
    assert got[0].ids_sha256 == got[0].decoded_sha256 == empty
    assert got[1].ids == encoding.encode_ordinary("same text")
    counted = token_counts.counted(docs, ["doc_id"], JSON, limit=1).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in counted) == [(0, 0, False), (0, 0, False), (9, 2, True), (9, 2, True)]
    none = docs.filter("false")
    assert byte_bpe.encoded(none, ["doc_id"], RANKS).count() == token_counts.counted(none, ["doc_id"], JSON).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="\\<|end>/s[INST]turnbody ", max_size=40))
def test_escaping_is_reversible_and_hides_control_strings(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)


def test_chat_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = [(1, 1, "assistant", "b<|end|>\\"), (1, 0, "user", "a"), (1, 1, "assistant", "c"), (2, 0, None, None), (None, 0, "assistant", "x" * 5000), (3, None, "user", "</s>[INST]")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.assembled(turns, path)
    got = {r.conv_id: r for r in chat.digests(chat.read_back(made, path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb<|end|>\\\nassistant\nc\n")
    assert (got[1].loss_chars, got[1].loss_sha256) == (10, sha("b<|end|>\\c"))
    assert (got[2].turns_sha256, got[2].loss_chars) == (sha("\n\n"), 0)
    assert got[None].loss_chars == 5000
    assert got[3].turns_sha256 == sha("user\n</s>[INST]\n")
    one = made.filter("conv_id = 1 and turn = 0").first()
    assert one.n_tokens == len(one.ids) and (one.loss_start, one.loss_stop) == (0, 0)
    assert chat.digests(chat.read_back(chat.assembled(turns.filter("false"), path), path)).count() == 0
