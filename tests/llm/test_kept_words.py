import public_tokenizers

from grainwise.llm import byte_bpe, caches


def test_kept_words_hold_their_ids_alone_and_another_owner_frees_them():
    bpe = byte_bpe.tool(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    words = [b" hello", b"", b"qzxqzxvv", b"\xff\xfe", b"x" * 100]
    first = bpe.words(words)
    assert [text for _, text in first] == words
    assert bpe.words(words) == first
    assert all(type(bpe.kept.get(w)) is bytes for w in words[:4])
    caches.claim("another")
    assert not byte_bpe._tools
