"""What a worker keeps after a task."""

from __future__ import annotations

from tidemark.llm import bpe


def test_a_tokenizer_at_rest_keeps_neither_cache_nor_the_whole_tokenizer():
    own = bpe.PieceCachedBpe(bpe.default_path())
    assert "whole" not in vars(own)
    texts = ["some words of a text, and more", own.special[0] + " a b", "a" + " " * 60_000 + "b"]
    before = [own.encode(t) for t in texts]
    assert own.cache and "whole" in vars(own)
    own.rest()
    assert not own.cache and own.cache.chars == 0 and "whole" not in vars(own)
    assert [own.encode(t) for t in texts] == before
