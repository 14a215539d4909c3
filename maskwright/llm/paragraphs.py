"""Repeated paragraphs across documents by MinHash banding.

Paragraphs are lines of MIN_WORDS words or more.  Equal ones (in lower case,
white space folded) meet first, as one class.  Classes whose MinHash signatures
agree in a band are joined, verified by the exact Jaccard similarity of their
five-word shingles, and clustered by connected components; of each cluster the
first occurrence stays and the others are removals.

Members of a band value are not paired out.  Each carries an outline, the
parities of its shingles' counts by hash, and two outlines differ in no more bits
than their sets of shingles do in elements; so outlines and sizes tell exactly,
without the texts, that most members cannot be similar, and only pairs that pass
are verified.  Where very many pass, a value's members gather about a few leaders,
and only pairs across those are verified besides.  If a member turns out not to be
like its leader, or there are too many such pairs, all pairs across the components
found so far are compared once more, but for members that may be similar to none.
A value of any size is dealt out in chunks.  No link that decides a component is lost.

A passage may also stand inside paragraphs that differ otherwise.  Every run of
PASSAGE words that two documents share has a shingle of SHINGLE words that
winnowing selects in both, so shared selected shingles find all such passages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import components, keyed_join, small, staged

MIN_WORDS, WIDTH, SIMILARITY = 20, 5, 0.8
#: Passages of so many words that repeat are found for certain, by shingles of SHINGLE words.
PASSAGE, SHINGLE = 50, 25
#: The chance that a pair of just SIMILARITY agrees in no band is below this.
MISSED = 1e-3
#: Pairs that pass to 32 members of a group, up to which all of them are verified at once; beyond that its members gather about leaders first.
PAIRED = 64
#: The same by other marks than outlines, which let pairs pass that are far from similar, such as those of texts that share a passage.
MARKED = 8
#: Comparisons of outlines in a chunk of a group, at most; a group of more members than the root of this is dealt out in chunks.
FINISHED = 4_000_000
#: Bits of an outline, and the share of the allowed difference within which a member gathers about a leader, by outlines and by other marks.
OUTLINE, CLOSE, CLOSE_BITS = 512, 0.8, 0.5
#: Words of documents brought together at once.
BLOCK_WORDS = 1 << 17
#: Words whose hashes a worker remembers, at most.
REMEMBERED = 100_000
MIX, SEED = np.uint64(0x9E3779B97F4A7C15), 7


def tune(similarity: float = SIMILARITY, missed: float = MISSED) -> tuple[int, int]:
    """Bands and rows: of the choices that miss a pair of ``similarity`` with a chance below ``missed``, the one with least hashes whose pairs of half that similarity collide rarely (once in five at most)."""
    best = None
    for rows in range(1, 9):
        bands = 1
        while (1 - similarity**rows) ** bands >= missed:
            bands += 1
        if 1 - (1 - (similarity / 2) ** rows) ** bands <= 0.5 and (best is None or bands * rows < best[0] * best[1]):
            best = bands, rows
    return best


BANDS, ROWS = tune()
_rng = np.random.default_rng(SEED)
FACTORS = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


class _Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def shingles(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hash of every run of ``width`` word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * MIX + hashes[k : k + n]
    return _mixed(out)


def winnowed(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the selected shingles of a document: the last least one of every window of PASSAGE - SHINGLE + 1."""
    runs, window = shingles(hashes, SHINGLE), PASSAGE - SHINGLE + 1
    if len(runs) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    picked: list[np.ndarray] = []
    for at in range(0, len(runs) - window + 1, BLOCK_WORDS):
        part = runs[at : at + BLOCK_WORDS + window - 1]
        views = np.lib.stride_tricks.sliding_window_view(part, window)[:, ::-1]
        picked.append(np.unique(np.arange(len(views)) + window - 1 - views.argmin(axis=1)) + at)
    places = np.unique(np.concatenate(picked))
    return places, runs[places]


def banded(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Band values (rows: paragraphs) of paragraphs whose word hashes stand one after another, ``sizes`` words each, MIN_WORDS or more."""
    every = shingles(hashes)
    ends = np.cumsum(sizes)
    inside = np.ones(len(every), bool)
    for k in range(1, WIDTH):  # shingles that reach over an end
        cut = ends[:-1] - k
        inside[cut[cut < len(every)]] = False
    own = every[inside]
    starts = np.concatenate([[0], np.cumsum(sizes - WIDTH + 1)[:-1]])
    out = np.zeros((len(sizes), BANDS), np.uint64)
    for band in range(BANDS):
        for row in range(ROWS):
            i = band * ROWS + row
            out[:, band] = out[:, band] * MIX + np.minimum.reduceat(own * FACTORS[i] + ADDENDS[i], starts)
        out[:, band] = _mixed(out[:, band] + np.uint64(band))
    return out.view(np.int64)


def _lines(text: str | None) -> list[list[bytes]]:
    return [line.split() for line in (text or "").encode().lower().split(b"\n")]


ROW = "paragraphs array<struct<line:int,n_words:int,h:binary,bands:array<bigint>>>, prints array<bigint>"


def described(docs: DataFrame) -> DataFrame:
    """Each row of ``docs(doc_id, text)`` as doc_id, its paragraphs with their digests and band values, and its winnowed shingles.  Null and empty texts have neither."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            block, first, size = [], 0, 0
            for i, text in enumerate(texts):
                found = _lines(text.as_py())
                block.append(found)
                size += sum(map(len, found))
                if size >= BLOCK_WORDS or i == len(texts) - 1:
                    yield describe(ids.slice(first, len(block)), block, known)
                    block, first, size = [], i + 1, 0
                    if len(known) > REMEMBERED:
                        known.clear()

    def describe(ids: pa.Array, block: list[list[list[bytes]]], known: _Words) -> pa.RecordBatch:
        hash_of = known.__getitem__
        line_no, sizes, digests, parts, offsets = [], [], [], [], [0]
        prints, print_offsets = [], [0]
        for found in block:
            hashes = [np.fromiter(map(hash_of, ws), np.uint64, len(ws)) for ws in found]
            for k, ws in enumerate(found):
                if len(ws) >= MIN_WORDS:
                    line_no.append(k)
                    sizes.append(len(ws))
                    digests.append(xxhash.xxh3_128_digest(b" ".join(ws)))
                    parts.append(hashes[k])
            offsets.append(len(sizes))
            _, selected = winnowed(np.concatenate(hashes))
            prints.append(np.unique(selected))
            print_offsets.append(print_offsets[-1] + len(prints[-1]))
        bands = banded(np.concatenate(parts), np.array(sizes)) if sizes else np.empty((0, BANDS), np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel(), pa.int64()))
        each = pa.StructArray.from_arrays([pa.array(line_no, pa.int32()), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), lists], ["line", "n_words", "h", "bands"])
        paragraphs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each)
        marks = pa.ListArray.from_arrays(pa.array(print_offsets, pa.int32()), pa.array(np.concatenate(prints).view(np.int64), pa.int64()))
        return pa.RecordBatch.from_arrays([ids, paragraphs, marks], ["doc_id", "paragraphs", "prints"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {ROW}")


def jaccard(a: str, b: str) -> float:
    """Exact Jaccard similarity of the sets of five-word shingles."""
    return _jaccard(_shingle_set(a), _shingle_set(b))


def _shingle_set(paragraph: str) -> frozenset:
    ws = paragraph.encode().lower().split()
    return frozenset(zip(*(ws[k:] for k in range(WIDTH)), strict=False))


def _jaccard(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if both else 0.0


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with ``distance``, one less the exact similarity; ``texts(id, paragraph)``."""
    both = keyed_join(keyed_join(pairs, texts.toDF("a", "left"), "a"), texts.toDF("b", "right"), "b").select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sets = None, frozenset()
        for batch in batches:
            out = []
            for a, left, right in zip(batch.column("a").to_pylist(), batch.column("left"), batch.column("right"), strict=True):
                if a != last:
                    last, sets = a, _shingle_set(left.as_py())
                out.append(1 - _jaccard(sets, _shingle_set(right.as_py())))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "distance"])

    return both.mapInArrow(run, "a bigint, b bigint, distance double")


def outline(found: np.ndarray, bits: int) -> bytes:
    """For each of ``bits`` values of the different shingles ``found`` the parity of how many fall on it."""
    return np.packbits(np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def outlines(texts: DataFrame, bits: int = OUTLINE) -> DataFrame:
    """``id, size, outline`` of ``texts(id, paragraph)``: how many different shingles, and for each of ``bits`` values of their hashes the parity of how many fall on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            sizes, rows = [], []
            for text in batch.column("paragraph"):
                words = (text.as_py() or "").encode().lower().split()
                found = np.unique(shingles(np.fromiter(map(known.__getitem__, words), np.uint64, len(words))))
                sizes.append(len(found))
                rows.append(outline(found, bits))
                if len(known) > REMEMBERED:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int32()), pa.array(rows, pa.binary())], ["id", "size", "outline"])

    return texts.select("id", "paragraph").mapInArrow(run, "id bigint, size int, outline binary")


def _apart(marks: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """In how many bits the members of rows differ from those of columns."""
    out = np.zeros((len(rows), len(columns)), np.uint16)
    for word in range(marks.shape[1]):
        out += np.bitwise_count(marks[rows, word][:, None] ^ marks[columns, word][None, :])
    return out


def _room(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """In how many shingles similar members may differ."""
    return (1 - similarity) / (1 + similarity) * (sizes[a] + sizes[b]) + 1e-6


def passing(sizes: np.ndarray, marks: np.ndarray, similarity: float, most: int | None, apart: np.ndarray | None = None, limit: float = np.inf) -> tuple[np.ndarray, np.ndarray] | None:
    """Places (i, j) of the pairs of members that may be similar; with ``apart``, numbers of (class, chunk) in two rows, only pairs of different classes, and of different chunks if there are two.  None: more than ``limit``."""
    n = len(sizes)
    order, heads = np.arange(n), n
    if apart is not None:  # the largest class comes last, and is compared only with the others
        _, own, counts = np.unique(apart[0], return_inverse=True, return_counts=True)
        order = np.argsort(counts[own] * len(counts) + own, kind="stable")
        heads = n - counts.max()
    top = _room(sizes, np.argmax(sizes), np.argmax(sizes), similarity) if most is None else most
    left, right, found, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0, 0
    while at < heads:
        step = max(1, (1 << 17) // (n - at))
        rows, columns = order[at : min(at + step, heads)], order[at:]
        i, j = np.nonzero(_apart(marks, rows, columns) <= top)
        later = j > i
        x, y = rows[i[later]], columns[j[later]]
        room = _room(sizes, x, y, similarity)
        ok = np.abs(sizes[x] - sizes[y]) <= room
        if most is None:
            ok &= np.bitwise_count(marks[x] ^ marks[y]).sum(axis=1) <= room
        if apart is not None:
            ok &= apart[0][x] != apart[0][y]
            if apart[1].min() != apart[1].max():
                ok &= apart[1][x] != apart[1][y]
        left.append(x[ok])
        right.append(y[ok])
        found += len(left[-1])
        if found > limit:
            return None
        at += step
    return np.concatenate(left), np.concatenate(right)


def led(sizes: np.ndarray, marks: np.ndarray, similarity: float, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places (leader, member): each member once at most, about the first leader that it is close to."""
    rest, left, right = np.arange(len(sizes)), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(rest) > 1:
        first, others = rest[:1], rest[1:]
        room, apart = _room(sizes, first, others, similarity), _apart(marks, first, others)[0]
        near = (np.abs(sizes[first] - sizes[others]) <= CLOSE * room) & (apart <= (CLOSE * room if most is None else CLOSE_BITS * most))
        right.append(others[near])
        left.append(np.full(len(right[-1]), first[0]))
        rest = others[~near]
    return np.concatenate(left), np.concatenate(right)


def touching(sizes: np.ndarray, marks: np.ndarray, similarity: float, most: int | None) -> np.ndarray:
    """Whether each member may be similar to any other."""
    every, out = np.arange(len(sizes)), np.zeros(len(sizes), bool)
    step = max(1, (1 << 17) // max(1, len(sizes)))
    for at in range(0, len(sizes), step):
        rows = every[at : at + step]
        room = _room(sizes, rows[:, None], every[None, :], similarity)
        near = (np.abs(sizes[rows][:, None] - sizes[None, :]) <= room) & (_apart(marks, rows, every) <= (room if most is None else most))
        near[rows - at, rows] = False
        out[rows] = near.any(axis=1)
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, dict[str, np.ndarray]]]:
    """Each row of grouped members: its place in its batch, the batch, and the members' columns as arrays."""
    for batch in batches:
        lists = batch.column("m")
        flat, ends = lists.flatten(), np.cumsum(np.array(lists.value_lengths(), np.int64))
        if not len(flat):
            continue
        columns = {f.name: np.frombuffer(b"".join(flat.field(f.name).to_pylist()), np.uint64).reshape(len(flat), -1) if f.name == "outline" else flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
        for i, (start, end) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            yield i, batch, {name: values[start:end] for name, values in columns.items()}


def _pairs(parts: Iterator[tuple[int | None, np.ndarray, np.ndarray | None]]) -> Iterator[pa.RecordBatch]:
    """Batches of ``again, a, b``: pairs, the smaller id first, with a key or none; a key's members (no second ids) without b; a key without pairs is a row of its own."""
    again, a, b, n = [], [], [], 0

    def batch() -> pa.RecordBatch:
        if not a:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, ["again", "a", "b"])
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in (again, a, b)], ["again", "a", "b"])

    for key, x, y in parts:
        if y is None:
            again.append(pa.array([key] * len(x), pa.int64()))
            a.append(pa.array(x, pa.int64()))
            b.append(pa.nulls(len(x), pa.int64()))
            n += len(x)
            continue
        alone = key is not None and not len(x)
        again.append(pa.array([key] * (len(x) or alone), pa.int64()))
        a.append(pa.nulls(1, pa.int64()) if alone else pa.array(np.minimum(x, y), pa.int64()))
        b.append(pa.nulls(1, pa.int64()) if alone else pa.array(np.maximum(x, y), pa.int64()))
        n += len(x)
        if n > 1 << 16 or len(a) > 1 << 14:
            yield batch()
            again, a, b, n = [], [], [], 0
    yield batch()


def sieved(pairs: DataFrame, traits: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` that sizes and outlines in the staged ``traits(id, size, outline)`` do not rule out."""
    both = keyed_join(keyed_join(pairs, traits.toDF("a", "m", "left"), "a"), traits.toDF("b", "n", "right"), "b").select("a", "b", "m", "n", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("m", "n"))
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(len(m), -1) for c in ("left", "right"))
                room = (1 - similarity) / (1 + similarity) * (m + n) + 1e-6
                ok = pa.array((np.abs(m - n) <= room) & (np.bitwise_count(left ^ right).sum(axis=1) <= room))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def similar(members: DataFrame, texts: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY, most: int | None = None, traits: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Edges ``(a, b)`` that join just what the similar pairs within the groups of ``members(key, id, size, outline)`` join.

    ``texts`` gives ``id, paragraph`` of a staged table of ids.  The outlines are
    those of :func:`outlines`; or others, of which similar members differ in
    ``most`` bits at most, and then ``traits`` gives those of :func:`outlines` for
    a staged table of ids.
    """
    paired, side = PAIRED if most is None else MARKED, int(FINISHED**0.5)
    far = 1 - similarity + 1e-12

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for i, batch, m in _groups(batches):
                order = np.argsort(m["id"])  # so that groups of much the same members have the same leaders
                ids, sizes, marks = m["id"][order], m["size"][order].astype(np.int64), m["outline"][order]
                key, limit, none = batch.column("key")[i].as_py(), paired * len(ids) / 32, ids[:0]
                found = passing(sizes, marks, similarity, most, limit=limit)
                if found is None:  # about leaders; if those are like their members, only pairs across are left
                    x, y = led(sizes, marks, similarity, most)
                    yield key, ids[x], ids[y]
                    if most is None:  # by other marks too many would pass; the key is compared once more, by outlines
                        about = np.arange(len(ids))
                        about[y] = x
                        found = passing(sizes, marks, similarity, most, np.stack([about, about * 0]), limit)
                    yield key, ids if batch.column("dealt")[i].as_py() else ids[touching(sizes, marks, similarity, most)], None
                elif batch.column("dealt")[i].as_py():
                    yield key, ids, None
                if found is None or batch.column("dealt")[i].as_py():
                    yield key, none, none
                if found is not None:
                    yield None, ids[found[0]], ids[found[1]]

        yield from _pairs(parts())

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for _, _, m in _groups(batches):
                x, y = passing(m["size"].astype(np.int64), m["outline"], similarity, None, np.stack([m["root"], m["chunk"]]))
                yield None, m["id"][x], m["id"][y]

        yield from _pairs(parts())

    def ends(pairs: DataFrame) -> DataFrame:
        return staged(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")

    def checked(pairs: DataFrame, sieve: bool) -> DataFrame:
        once = staged(pairs.where("b is not null").select("a", "b").distinct(), "pairs")
        if sieve:
            once = staged(sieved(once, staged(traits(ends(once)), "outlines"), similarity), "sieved")
        ids = ends(once)
        return staged(verified(once, staged(texts(ids), "texts")).where(F.col("distance") <= far).select("a", "b"), "verified")

    kind, schema = ["id", "size", "outline"], "again bigint, a bigint, b bigint"
    large = staged(members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > side).select("key", F.ceil(F.col("n") / side).alias("chunks")), "large")
    chunk = F.pmod(F.xxhash64("id"), "chunks").cast("int")
    dealt = keyed_join(members, large, "key", "left").withColumn("chunk", F.coalesce(chunk, F.lit(0)))
    groups = dealt.groupBy("key", "chunk").agg(F.collect_list(F.struct(*kind)).alias("m"), F.max(F.col("chunks").isNotNull()).alias("dealt"))
    met = staged(groups.where((F.size("m") > 1) | F.col("dealt")).mapInArrow(first, schema), "met")
    links = checked(met, traits is not None)

    # keys that are not done: with too many pairs across, or a member that is not like its leader
    keys = met.where("again is not null")
    unlike = keys.where("b is not null").join(links, ["a", "b"], "left_anti")
    again = staged(keys.where("a is null").unionByName(unlike.select(*keys.columns)).select(F.col("again").alias("key")).distinct(), "again")
    if again.isEmpty():
        return links
    own = keys.where("a is not null and b is null").select(F.col("again").alias("key"), F.col("a").alias("id"))
    crowded = staged(keyed_join(own, again, "key"), "crowded")
    roots = components(links).withColumnsRenamed({"node": "id"})
    stars = roots.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b"))  # join what the links do, and are fewer
    ids = staged(crowded.select("id").distinct(), "ids")
    rooted = (outlines(texts(ids)) if traits is None else traits(ids)).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    rated = keyed_join(keyed_join(crowded, staged(rooted, "traits"), "id"), large, "key", "left").withColumn("chunk", F.coalesce(chunk, F.lit(0)))
    if not large.isEmpty():  # of keys that are dealt out those of one root are done; others cost nothing then
        shut = staged(rated.where("chunks is not null").groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x = y").select("key"), "shut")
        rated = rated.join(small(shut), "key", "left_anti")
    others = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)).cast("int") - 1)).alias("other")
    both = rated.select("*", others).groupBy("key", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"))
    blocks = both.agg(F.collect_list(F.struct(*kind, "root", "chunk")).alias("m")).where(F.size("m") > 1)
    return stars.unionByName(checked(blocks.mapInArrow(across, schema), False))


def clusters(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Digests of the repeated paragraphs: ``h, keep_doc, keep_line, component``, where the occurrence to keep is the first by doc_id and line of the whole cluster."""
    each = rows.select("doc_id", F.explode("paragraphs").alias("p"))
    classes = each.groupBy(F.col("p.h").alias("h")).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", F.col("p.line").alias("line"), F.col("p.bands").alias("bands"))).alias("first"))
    classes = staged(classes.select("h", "n", "first.*").withColumn("id", F.monotonically_increasing_id()), "classes")

    values = classes.select("id", F.explode("bands").alias("key"))
    crowded = values.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = staged(keyed_join(values, staged(crowded, "crowded"), "key"), "candidates")
    wanted = members.select("id").distinct().join(classes.select("id", "doc_id", "line"), "id")
    by_doc = wanted.where("doc_id is not null").groupBy("doc_id").agg(F.collect_list(F.struct("id", "line")).alias("wanted"))  # paragraphs of one document
    cut = docs.select("doc_id", "text").join(by_doc, "doc_id").select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
    texts = staged(cut.select(F.col("w.id").alias("id"), F.get("lines", F.col("w.line")).alias("paragraph")).dropDuplicates(["id"]), "paragraphs")
    outlined = staged(keyed_join(members, staged(outlines(texts), "outlines"), "id"), "outlined")
    roots = components(similar(outlined, lambda ids: keyed_join(texts, ids, "id"))).withColumnsRenamed({"node": "id"})
    rooted = staged(classes.join(roots, "id", "left").select("h", "n", "doc_id", "line", F.coalesce("root", "id").alias("root")), "rooted")
    whole = rooted.groupBy("root").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "line")).alias("keep")).where("n > 1")
    return keyed_join(rooted, staged(whole.select("root", "keep"), "whole"), "root").select("h", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.line").alias("keep_line"))


def repeated(docs: DataFrame) -> DataFrame:
    """One row per document of ``docs(doc_id, text)`` that holds a repeated paragraph or passage.

    Columns: doc_id; n_paragraphs; n_repeated, those in a cluster of two
    occurrences or more; removed, the lines (from 0) of those that are not the
    one to keep; paragraph_docs, the documents whose paragraphs are kept
    instead, or its own; n_passages, its selected shingles that another document
    has too; passage_docs, the first documents that have them.  Documents
    without repetition have no row.  Rows without an id are left out.
    """
    rows = staged(described(docs.where("doc_id is not null")), "described")
    found = staged(clusters(docs, rows), "clusters")
    each = rows.select("doc_id", F.explode("paragraphs").alias("p")).select("doc_id", F.col("p.line").alias("line"), F.col("p.h").alias("h"))
    met = keyed_join(each, found, "h")
    gone = (F.col("doc_id") != F.col("keep_doc")) | (F.col("line") != F.col("keep_line"))
    in_paragraphs = met.groupBy("doc_id").agg(F.count("*").alias("n_repeated"), F.array_sort(F.collect_set(F.when(gone, F.col("line")))).alias("removed"), F.array_sort(F.collect_set("keep_doc")).alias("paragraph_docs"))

    prints = rows.select("doc_id", F.explode("prints").alias("print"))
    shared = prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(F.col("first") != F.col("last")).select("print", "first")
    in_passages = keyed_join(prints, staged(shared, "shared"), "print").groupBy("doc_id").agg(F.count("*").alias("n_passages"), F.array_sort(F.collect_set("first")).alias("passage_docs"))
    both = in_paragraphs.join(in_passages, "doc_id", "full_outer")
    sizes = rows.groupBy("doc_id").agg(F.max(F.size("paragraphs")).cast("bigint").alias("n_paragraphs"))
    none, no_lines, no_docs = F.lit(0).cast("bigint"), F.array().cast("array<int>"), F.array().cast(f"array<{docs.schema['doc_id'].dataType.simpleString()}>")
    return both.join(sizes, "doc_id").select(
        "doc_id",
        "n_paragraphs",
        F.coalesce("n_repeated", none).alias("n_repeated"),
        F.coalesce("removed", no_lines).alias("removed"),
        F.coalesce("paragraph_docs", no_docs).alias("paragraph_docs"),
        F.coalesce("n_passages", none).alias("n_passages"),
        F.coalesce("passage_docs", no_docs).alias("passage_docs"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the removals of :func:`repeated` cut from their texts; documents without any stay as they are, and so do all other columns, whatever their names."""
    cuts = staged(repeated(docs.select("doc_id", "text")).where(F.size("removed") > 0).select("doc_id", "removed"), "cuts")
    joined = keyed_join(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"), cuts, "doc_id", "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("removed", i)), "\n")
    text = F.when(F.col("removed").isNotNull(), left).otherwise(F.col("text"))
    return joined.select(*((text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))


def op7_paragraphs(spark, sf_dir: str) -> DataFrame:
    """The documents that share paragraphs or passages, with what is removed from each."""
    return repeated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
