"""Byte-level BPE over a published vocabulary by a pair occurrence index.

Texts are split as the vocabulary's file says.  The pieces of a block of texts
that were not met before lie in one array of symbols with links to their
neighbours.  An index maps each pair's rank to all positions where the pair
stands; the active ranks are taken in ascending order from a heap, the pairs at
their positions are merged from left to right, and the lists of the pairs that
a merge makes are extended.  A merge only makes pairs of higher rank, so each
rank is done once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: How a byte-level pre-tokenizer splits (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text indexed at once, which bounds the index.
BLOCK = 2_000_000
#: Pieces that a worker remembers in each of two generations, and the longest that it does.
REMEMBERED, LONGEST = 200_000, 64
#: Stands between pieces; no byte of UTF-8.
WALL = b"\xff"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: the byte's own where it is printable Latin-1, else the next from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


Piece = tuple[int, str, bytes]


class Tokenizer:
    """Encodes and decodes with the vocabulary in ``path``, a tokenizers file of a byte-level BPE without normalizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"] or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("a byte-level BPE without normalizer or prefix space is needed")
        vocab, symbols = model["vocab"], byte_symbols()
        self.byte_ids = [vocab[c] for c in symbols]
        to_byte = {c: b for b, c in enumerate(symbols)}
        self.token_bytes: dict[int, bytes] = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items() if all(c in to_byte for c in t)}
        self.base = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        #: rank by pair, a pair (a, b) being a * base + b; and both symbols and the merged one by rank
        self.ranks: dict[int, int] = {}
        self.merges: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a] * self.base + vocab[b]] = rank
            self.merges.append((vocab[a], vocab[b], vocab[a + b]))
        #: ranks of the pairs that a symbol begins, by the second, and of those that it ends, by the first; symbols without any are left out
        self.begun: dict[int, dict[int, int]] = {}
        self.ended: dict[int, dict[int, int]] = {}
        for pair, rank in self.ranks.items():
            a, b = divmod(pair, self.base)
            self.begun.setdefault(a, {})[b] = rank
            self.ended.setdefault(b, {})[a] = rank
        #: rank by pair of bytes, -1 for none
        self.byte_ranks = np.full(65536, -1, np.int32)
        for i, a in enumerate(self.byte_ids):
            for j, b in enumerate(self.byte_ids):
                self.byte_ranks[i * 256 + j] = self.ranks.get(a * self.base + b, -1)
        self.byte_ranks.reshape(256, 256)[255, :] = self.byte_ranks.reshape(256, 256)[:, 255] = -1
        self.symbols = np.array([*self.byte_ids[:255], -1], np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take white space or whole words are not supported")
        self.token_bytes |= {i: t.encode() for t, i in self.added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if longest_first else lambda t: [t]
        self.find = regex.compile(PATTERN).findall
        self.young: dict[str, Piece] = {}
        self.old: dict[str, Piece] = {}

    def pieces(self, text: str) -> list[str]:
        """The pieces of ``text``; added tokens are pieces of their own."""
        out: list[str] = []
        for i, part in enumerate(self.split_added(text)):
            if i % 2:
                out.append(part)
            elif part:
                out += self.find(part)
        return out

    def index_pieces(self, pieces: list[str]) -> list[list[int]]:
        """The tokens of each piece, by the pair occurrence index."""
        if not pieces:
            return []
        parts = [p.encode("utf-8", "surrogatepass") for p in pieces]
        data = np.frombuffer(WALL.join(parts) + WALL, np.uint8)
        n = len(data)
        sym = self.symbols[data].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # the index of the pairs of bytes: places sorted by rank, ties from left to right
        first = self.byte_ranks[data[:-1].astype(np.int64) * 256 + data[1:]] if n > 1 else np.empty(0, np.int32)
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        starts = np.flatnonzero(np.diff(first[at], prepend=-1))
        heap = first[at[starts]].tolist()  # ascending, so a heap
        lists = dict(zip(heap, (x.tolist() for x in np.split(at, starts[1:])), strict=True)) if heap else {}

        merges, begun, ended, none = self.merges, self.begun, self.ended, {}
        push, pop, known = heapq.heappush, heapq.heappop, lists.get
        while heap:
            rank = pop(heap)
            a, b, new = merges[rank]
            places = lists.pop(rank)
            if a == b:  # those that overlap merge from left to right
                places.sort()
            right, left = begun.get(new, none), ended.get(new, none)
            for i in places:
                if sym[i] != a or sym[j := after[i]] != b:
                    continue  # merged meanwhile
                sym[i], sym[j] = new, -2
                after[i] = k = after[j]
                before[k] = i
                # a wall is in no pair; before the first symbol stands -1, the place of the last wall
                if right and (r := right.get(sym[k])) is not None:
                    if (there := known(r)) is None:
                        lists[r] = [i]
                        push(heap, r)
                    else:
                        there.append(i)
                if left and (r := left.get(sym[h := before[i]])) is not None:
                    if (there := known(r)) is None:
                        lists[r] = [h]
                        push(heap, r)
                    else:
                        there.append(h)
        whole = np.array(sym)
        ends = np.flatnonzero(whole == -1) + 1
        counts = np.add.reduceat(whole >= 0, np.concatenate([[0], ends[:-1]]), dtype=np.int64).cumsum().tolist()
        run = whole[whole >= 0].tolist()
        out = [run[start:end] for start, end in zip([0, *counts], counts, strict=False)]
        return out

    def encode_block(self, texts: list[str]) -> list[list[Piece]]:
        """Each text's pieces in order.

        Pieces met before are remembered in two generations: what is used again
        moves to the young one, and when that is full the old one is forgotten.
        """
        split = [self.pieces(t) for t in texts]
        needed = set().union(*split)
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        young.update((p, old[p]) for p in needed if p in old and p not in young)
        young.update((t, self.piece([i])) for t, i in self.added.items())
        new = [p for p in needed if p not in young]
        fresh = dict(zip(new, map(self.piece, self.index_pieces(new)), strict=True))
        young.update((p, x) for p, x in fresh.items() if len(p) <= LONGEST)
        get = {**young, **fresh}.__getitem__ if any(len(p) > LONGEST for p in new) else young.__getitem__
        return [list(map(get, ps)) for ps in split]

    def piece(self, ids: list[int]) -> Piece:
        """What is remembered of a piece: how many tokens, their ids as text, and the bytes that they decode to."""
        return len(ids), ",".join(map(str, ids)), b"".join([self.token_bytes[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.encode_block([text])[0] for i in ids.split(",")]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ``ids``; special tokens stay, unknown ids give nothing, broken UTF-8 becomes U+FFFD."""
        get = self.token_bytes.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One tokenizer per worker and path."""
    return Tokenizer(path)


def blocks(texts: Iterable[str], most: int = BLOCK) -> Iterator[list[str]]:
    """Texts in runs of up to about ``most`` characters; a longer text is a run of its own, whole."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row of ``docs(doc_id, text)``; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            rows: list[tuple[int, str, str]] = []
            for block in blocks(t.as_py() or "" for t in batch.column("text")):
                for pieces in tok.encode_block(block):
                    counts, ids, raw = zip(*pieces, strict=True) if pieces else ((), (), ())
                    decoded = b"".join(raw).decode("utf-8", "replace")
                    rows.append((sum(counts), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            counts, ids, texts = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> str:
    """The installed path of the vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts of every document."""
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
