import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from maskwright.llm import bpe


@pytest.fixture(scope="module")
def both():
    return bpe.tokenizer(bpe.vocabulary()), Tokenizer.from_file(bpe.vocabulary())


def agree(both, texts):
    own, library = both
    for block in bpe.blocks(texts):
        for text, pieces in zip(block, own.encode_block(block), strict=True):
            ids = [int(i) for _, shown, _ in pieces for i in shown.split(",")]
            want = library.encode(text, add_special_tokens=False).ids
            assert ids == want, text[:80]
            assert own.decode(ids) == b"".join(raw for _, _, raw in pieces).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_odd_texts(both, odd):
    agree(both, [t or "" for t in odd] + ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "aaaa" * 50, "  a   b\n\n\tc ", "'s 'LL don't", "日本語テキスト", "12³½ _x_", "\x00\x85\u2003", "x" * 5000])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    agree(both, [text])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["ab", "abab", "the ", " theth", "aa", "ththe", "é"]), max_size=20))
def test_blocks_of_like_pieces(both, parts):
    agree(both, ["".join(parts), *parts])


def test_memory_is_bounded_and_results_are_not(both, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    agree(both, [f"word{i} and more{i}" for i in range(50)])


def test_unknown_ids_and_broken_bytes(both):
    own = both[0]
    assert own.decode([10**6]) == "" and own.decode([own.byte_ids[0xC3]]) == "\ufffd"


def test_frame(spark, make_docs, odd, both):
    docs = make_docs([*odd, (None, "no id")])
    rows = bpe.encoded(docs, bpe.vocabulary()).collect()
    assert len(rows) == len(odd) + 1 and bpe.encoded(docs.limit(0), bpe.vocabulary()).count() == 0
    for r in rows:
        text = (odd[r["doc_id"]] if r["doc_id"] is not None else "no id") or ""
        ids = both[1].encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_neighbours_of_a_symbol(both):
    """The pairs by their first and by their second symbol are those of the vocabulary; a symbol that is in no pair asks for nothing."""
    own = both[0]
    pairs = {(a, b): rank for rank, (a, b, _) in enumerate(own.merges)}
    assert {(a, b): r for a, bs in own.begun.items() for b, r in bs.items()} == {(a, b): r for b, xs in own.ended.items() for a, r in xs.items()} == pairs
    assert own.index_pieces(["a", "aaaa", " the", "é"]) == [own.encode(p) for p in ("a", "aaaa", " the", "é")]
