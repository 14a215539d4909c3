"""SimHash near-duplicates by the generalised pigeonhole principle.

Every text gets a 64-bit fingerprint.  Two fingerprints within ``max_bits`` bits
of each other are linked.  The 64 bits are cut into partitions of correlated
bits; a partition i gets a threshold t_i such that the t_i sum to
``max_bits - partitions + 1``, so any linked pair differs by at most t_i bits in
some partition i.  A dynamic programme chooses the thresholds, and thereby also
which partitions are not probed at all (t_i = -1), by the candidates that each
choice is expected to bring.  A fingerprint probes the values of a partition
within its threshold, and candidates are verified on all 64 bits.

A value that very many fingerprints share would bring the square of its group.
The members of such groups are linked in another exact way: two fingerprints
are within k bits if and only if some 64-bit value, a midpoint, is within k / 2
bits of one, rounded down, and k / 2 of the other, rounded up.  So each member is
dealt to all values that near, 65 for two bits, as many fingerprints meet at any
of them at most, and all that meet one of the closer ones are linked to it.
Nothing is capped or dropped, whatever the threshold; its cost grows with it.

All that is op8's.  The pipeline's stage, :func:`keep_one`, owes a similarity of
0.8 by five-word shingles.  Such texts differ in about 15 of 100 bits, too many
for thresholds that find all within a number of bits, so its fingerprints have as
many bits as it takes: they are cut into partitions of few bits and a threshold
of none, so many that similar texts differ in all of them with a chance below
MISSED.  Texts that meet are held together on 128 bits, and then on their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import components, discard, keyed_join, live_paths, staged
from maskwright.llm.paragraphs import REMEMBERED, SIMILARITY, _mixed, outline, shingles, similar, tune

BITS = 64
SEED = 42
#: Fingerprints in a partition's value beyond which its members go to midpoints, for two bits.
GROUP = 48
#: Shingles hashed at once, which bounds memory on very long texts.
SLAB = 1 << 16
#: The pipeline's stage: the chance that it misses a pair of just SIMILARITY, and the chance that such texts differ in a bit: 0.152 for many shingles, more for few, by all ways to part them.
MISSED, DIFFER = 1e-5, 0.1612
#: MinHash bands and rows of the same chance, to compare with; the stage does not use them.
BANDS, ROWS = tune(SIMILARITY, MISSED)
#: Texts of so many shingles and fewer, of which five and four differ in more bits (0.1875), meet at each shingle besides.
FEW = 5
#: Documents that meet in a value by chance, about; bits on which they are held together, and so many that similar ones differ in more with a chance below 1e-5.
BY_CHANCE, HELD, MOST = 256, 128, 40
#: Bits of the outline of a whole document.
OUTLINE = 2048


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint, unsigned: bit j is set if it is set in over half of the shingles' hashes.

    A-Z are lower-cased and words are parted by ASCII white space.  Shingles are
    ``width`` words; a shorter text is one shingle; a text without words, empty
    or null, has the fingerprint zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    count, sums = max(1, len(words) - width + 1), np.zeros(BITS, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, count, SLAB):
        rows = [digest(join(words[i : i + width]), SEED) for i in range(at, min(at + SLAB, count))]
        sums += np.unpackbits(np.array(rows, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(sums * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text") -> Column:
    """A column of the signed 64-bit fingerprints of ``docs[text]``."""

    @F.pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).astype(np.int64))

    return of(docs[text])


# --- partitions and thresholds -------------------------------------------------


def bit_moments(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints ``prints(fp)`` has and, for bits i and j, how many have both set; over all of them."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS))
        for pdf in batches:
            for at in range(0, len(pdf), SLAB):
                bits = np.unpackbits(pdf["fp"].to_numpy(np.int64)[at : at + SLAB].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
        yield pd.DataFrame({"cell": np.arange(BITS * BITS), "n": total.ravel().astype(np.int64)})

    cells = prints.select("fp").mapInPandas(sums, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS)
    for row in cells:
        both[row["cell"]] = row["n"]
    return prints.count(), both.reshape(BITS, BITS)


def correlated_partitions(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Cut the bits into ``parts`` equal groups, each grown from its most even bit by the bits that vary most with it."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, groups))) // (parts - k)
        group = [max(sorted(left), key=lambda b: sd[b])]
        left.discard(group[0])
        while len(group) < size:
            best = max(sorted(left), key=lambda b: corr[b, group].mean())
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def expected_share(n: int, both: np.ndarray, group: list[int], threshold: int) -> float:
    """The share of pairs expected to differ in at most ``threshold`` bits of ``group``: the bits' agreements, convolved, their number lessened by their correlation."""
    if threshold < 0:
        return 0.0
    p = np.diag(both)[group] / max(n, 1)
    cov = both[np.ix_(group, group)] / max(n, 1) - np.outer(p, p)
    values = np.maximum(np.linalg.eigvalsh(cov), 0)
    free = values.sum() ** 2 / max((values**2).sum(), 1e-12) / len(group)  # effective share of independent bits
    dist = np.array([1.0])
    for q in 2 * p * (1 - p) * free:
        dist = np.convolve(dist, [1 - q, q])
    return float(dist[: threshold + 1].sum())


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up, one a partition, that sum to ``budget`` at the least total cost; costs[i][t + 1] is that of t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t, c in enumerate(row, -1):
                if total + t not in step or cost + c < step[total + t][0]:
                    step[total + t] = (cost + c, [*chosen, t])
        best = step
    return best[budget]


def variants(bits: int, threshold: int) -> int:
    return sum(1 for k in range(threshold + 1) for _ in combinations(range(bits), k))


def plan(n: int, both: np.ndarray, max_bits: int = 2) -> list[tuple[list[int], int]]:
    """The partitions and thresholds of the least expected work: candidates to verify plus values to emit."""
    found = []
    for parts in range(2, max_bits + 3):
        groups = correlated_partitions(n, both, parts)
        costs = [[0.0] + [n * n / 2 * expected_share(n, both, g, t) + 4.0 * n * variants(len(g), t) for t in range(max_bits + 1)] for g in groups]
        cost, chosen = allocate(costs, max_bits - parts + 1)
        found.append((cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


@lru_cache(maxsize=64)
def _masks(group: tuple[int, ...], threshold: int) -> np.ndarray:
    """XOR masks of all changes of up to ``threshold`` bits of ``group``, none first."""
    return np.array([sum(1 << b for b in c) for k in range(threshold + 1) for c in combinations(group, k)], np.uint64)


def crowd(max_bits: int) -> int:
    """Members of a group from which midpoints cost less than its pairs: GROUP, as many times over as a fingerprint has more midpoints than for two bits."""
    return max(2, GROUP * variants(BITS, max_bits - max_bits // 2) // variants(BITS, 1))


# --- links ----------------------------------------------------------------------


def links(prints: DataFrame, chosen: list[tuple[list[int], int]], max_bits: int = 2) -> DataFrame:
    """Links ``(a, b)`` between the distinct fingerprints ``prints(fp)``.

    In groups of ordinary size every pair within ``max_bits`` bits appears.  The
    members of larger groups are each linked to the least of the closer ones at
    the same midpoint, which joins the same components.
    """
    close, far_off = max_bits // 2, max_bits - max_bits // 2
    most = crowd(max_bits)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                fps = pdf["fp"].to_numpy(np.int64)[at : at + 4096].view(np.uint64)
                for k, (group, t) in enumerate(chosen):
                    masks = _masks(tuple(group), t)
                    only = fps & np.uint64(sum(1 << b for b in group))
                    keys = (only[:, None] ^ masks[None, :]).view(np.int64)
                    yield pd.DataFrame({"part": np.int32(k), "key": keys.ravel(), "fp": np.repeat(fps.view(np.int64), len(masks)), "own": np.tile(np.arange(len(masks)) == 0, len(fps))})

    probes = staged(prints.select("fp").mapInPandas(probe, "part int, key bigint, fp bigint, own boolean"), "probes")
    sizes = probes.groupBy("part", "key").agg(F.count("*").alias("n"), F.max("own").alias("own")).where("n > 1 and own").select("part", "key", "n")
    met = staged(keyed_join(probes, staged(sizes, "sizes"), ["part", "key"]), "met")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for members, owns in zip(pdf["fps"], pdf["owns"], strict=True):
                fps, own = np.asarray(members, np.int64), np.asarray(owns, bool)
                i, j = np.nonzero(own[:, None] & (fps[:, None] != fps[None, :]) & (_popcount(fps[:, None] ^ fps[None, :]) <= max_bits))
                a.append(fps[i])
                b.append(fps[j])
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    groups = met.where(F.col("n") <= most).groupBy("part", "key").agg(F.collect_list(F.struct("fp", "own")).alias("m"))
    near = groups.select(F.col("m.fp").alias("fps"), F.col("m.own").alias("owns")).mapInPandas(verify, "a bigint, b bigint")

    def midpoints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flips = _masks(tuple(range(BITS)), far_off)
        near_by = np.arange(len(flips)) < variants(BITS, close)  # those of fewer bits come first
        step = max(1, (1 << 18) // len(flips))
        for pdf in batches:
            for at in range(0, len(pdf), step):
                fps = pdf["fp"].to_numpy(np.int64)[at : at + step]
                yield pd.DataFrame({"mid": (fps.view(np.uint64)[:, None] ^ flips[None, :]).ravel().view(np.int64), "fp": np.repeat(fps, len(flips)), "close": np.tile(near_by, len(fps))})

    mids = met.where(F.col("n") > most).select("fp").distinct().mapInPandas(midpoints, "mid bigint, fp bigint, close boolean")
    meet = mids.groupBy("mid").agg(F.collect_set("fp").alias("fps"), F.min(F.when(F.col("close"), F.col("fp"))).alias("a")).where((F.size("fps") > 1) & F.col("a").isNotNull())  # one fingerprint a change of bits at most
    far = meet.select("a", F.explode("fps").alias("b")).where("a <> b").distinct()
    return near.unionByName(far)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def near_duplicates(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Components of documents ``prints(doc_id, fp)`` as ``(fp, component_id)``, one row a distinct fingerprint.

    component_id is the smallest doc_id reachable over links of ``max_bits``
    bits.  Copies meet in one row before anything is compared, so a group of
    copies of any size costs one fingerprint.  Null doc_ids count as no id: a
    group that has only those gets a null component_id.
    """
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    n, both = bit_moments(classes)
    found = links(classes, plan(n, both, max_bits), max_bits)
    roots = components(found).withColumnsRenamed({"node": "fp"})
    rooted = staged(classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    return keyed_join(rooted, least, "root").select("fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component (``doc_id``, ``fingerprint`` as 16 hexadecimal digits, ``component_id``)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = staged(docs.select("doc_id", fingerprints(docs).alias("fp")), "prints")
    return keyed_join(prints, staged(near_duplicates(prints), "grouped"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- the pipeline's stage -----------------------------------------------------------


def cuts(documents: int) -> tuple[int, int]:
    """Partitions and bits of each, so many that BY_CHANCE of so many documents meet in a value."""
    bits = min(24, max(6, (documents // BY_CHANCE).bit_length()))
    parts = 1
    while (1 - (1 - DIFFER) ** bits) ** parts >= MISSED:
        parts += 1
    return parts, bits


@lru_cache(maxsize=8)
def _factors(words: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 2**63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, words, dtype=np.uint64)


def wide_bits(every: np.ndarray, words: int) -> np.ndarray:
    """The fingerprint of a text's different shingles, 64 bits a word, as an array of bits: each is set if it is set in over half of the shingles' hashes."""
    (factors, addends), sums = _factors(words), np.zeros(64 * words, np.int64)
    for at in range(0, len(every), 255):  # as many as a byte counts
        rows = _mixed(every[at : at + 255, None] * factors + addends)
        sums += np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return sums * 2 > len(every)


def _signed(docs: DataFrame, parts: int, bits: int) -> DataFrame:
    """Each row of ``docs(doc_id, text)`` as doc_id, the digest of its words, how many five-word shingles it has, HELD bits of its fingerprint, its partitions' values, its shingles if they are few, and its outline; a text of fewer words has no values."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    words_of = -(-max(parts * bits, HELD) // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        powers, numbers = 1 << np.arange(bits, dtype=np.int64), np.arange(parts, dtype=np.int64) << bits
        for batch in batches:
            digests, sizes, held, values, few, whole = [], [], [], [], [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode().lower().split()
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                for w in words:
                    if w not in known:
                        known[w] = xxhash.xxh3_64_intdigest(w)
                every = np.unique(shingles(np.fromiter(map(known.__getitem__, words), np.uint64, len(words))))
                found = wide_bits(every, words_of)
                sizes.append(len(every))
                held.append(np.packbits(found[:HELD]).tobytes())
                values.append(found[: parts * bits].reshape(parts, bits) @ powers + numbers if len(every) else [])
                few.append(every.view(np.int64) if len(every) <= FEW else [])
                whole.append(outline(every, OUTLINE))
                if len(known) > REMEMBERED:
                    known.clear()
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(held, pa.binary()), pa.array(values, lists), pa.array(few, lists), pa.array(whole, pa.binary())], ["doc_id", "h", "size", "outline", "keys", "few", "whole"])

    return docs.mapInArrow(run, f"doc_id {kind}, h binary, size int, outline binary, keys array<bigint>, few array<bigint>, whole binary")


def near_copies(docs: DataFrame) -> DataFrame:
    """The least doc_id of each component of ``docs(doc_id, text)``, one row a document: linked are texts of equal words and those whose five-word shingles have an exact Jaccard similarity of SIMILARITY or more.

    Candidates agree in a partition of their fingerprints and differ in MOST of
    HELD bits at most; partitions miss a pair of just SIMILARITY with a chance
    below MISSED.  Each is verified on its words.
    """
    columns = ["doc_id", "size", "outline", "keys", "few", "whole"]
    classes = _signed(docs, *cuts(docs.count())).groupBy("h").agg(F.min(F.struct(*columns)).alias("first")).select("first.*")
    classes = staged(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    members = classes.select(F.explode("keys").alias("key"), "id", "size", "outline")
    by_shingle = classes.select(F.explode("few").alias("key"), "id", "size", F.lit(bytes(HELD // 8)).alias("outline"))

    def texts(ids: DataFrame) -> DataFrame:
        wanted = staged(keyed_join(classes.select("id", "doc_id"), ids, "id"), "wanted")
        return keyed_join(docs, wanted, "doc_id").select("id", F.col("text").alias("paragraph"))

    def traits(ids: DataFrame) -> DataFrame:
        return keyed_join(classes.select("id", "size", F.col("whole").alias("outline")), ids, "id")

    roots = components(similar(members.unionByName(by_shingle), texts, most=MOST, traits=traits)).withColumnsRenamed({"node": "id"})
    rooted = classes.select("id", "doc_id").join(roots, "id", "left").select("doc_id", F.coalesce("root", "id").alias("root"))
    return rooted.groupBy("root").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each component of :func:`near_copies` the document of the smallest doc_id stays, with the columns it has.

    A repeated doc_id stays once.  Documents without an id cannot be told apart
    and stay as they are.
    """
    repeated = staged(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id", F.lit(True).alias("again")), "repeated")
    one = docs.where("doc_id is not null")
    if not repeated.isEmpty():
        marked = keyed_join(one.select(F.struct(*docs.columns).alias("row"), "doc_id"), repeated, "doc_id", "left")
        some = marked.where("again").select("row.*").dropDuplicates(["doc_id"])
        one = staged(marked.where("again is null").select("row.*").unionByName(some), "once")
    before = live_paths(docs.sparkSession)
    stay = staged(near_copies(one.select("doc_id", "text")), "stay")
    discard(docs.sparkSession, [p for p in live_paths(docs.sparkSession) if p not in before][:-1])  # the last one is stay
    gone = staged(one.select("doc_id").join(stay, "doc_id", "left_anti").withColumn("gone", F.lit(True)), "gone")  # fewer than those that stay
    kept = keyed_join(one.select(F.struct(*docs.columns).alias("row"), "doc_id"), gone, "doc_id", "left").where("gone is null").select("row.*")
    return kept.unionByName(docs.where("doc_id is null"))
