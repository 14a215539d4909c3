"""Document fingerprints: a canonical exact digest.

Only DataFrame functions are used.  The canonical form of a text is its NFKC
normalisation with case and white space folded; its digest is two independent
64-bit xxHash values.  Documents meet in buckets of equal digests, whose
canonical bytes are compared; in a bucket that holds different ones each digest
is drawn out by the SHA-256 of its canonical form, so equal fingerprints mean
equal canonical texts.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from maskwright.llm.common import keyed_join, let, scan, small, staged

# --- Unicode normalisation ------------------------------------------------------

HANGUL, L, V, T = 0xAC00, 0x1100, 0x1161, 0x11A7  # fixed values of the standard: the syllables' and jamos' first code points
V_COUNT, T_COUNT, HANGUL_COUNT = 21, 28, 11172


def _ranges(spans: list[tuple[int, int]]) -> str:
    """The inside of a regular expression's character class."""
    return "".join(rf"\x{{{a:X}}}" + (rf"-\x{{{b:X}}}" if b > a else "") for a, b in spans)


def _runs(points: Iterable[int]) -> list[tuple[int, int]]:
    """Sorted code points as first and last of each run."""
    out: list[list[int]] = []
    for cp in points:
        if out and cp == out[-1][1] + 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return [(a, b) for a, b in out]


def _number(binary: Column) -> Column:
    """Big-endian bytes as an int."""
    return F.conv(F.hex(binary), 16, 10).cast("int")


class _Table:
    """Strings by code point in three runs of bytes, which are added to ``data``: for each block of 256 code points its number among those that hold any; for each code point of these offset and length; and the UTF-8 of all strings."""

    def __init__(self, entries: dict[int, str], data: bytearray):
        used = sorted({cp >> 8 for cp in entries})
        number = {block: i + 1 for i, block in enumerate(used)}
        self.blocks = len(data)
        data += b"".join(number.get(b, 0).to_bytes(2) for b in range((sys.maxunicode >> 8) + 1))
        held, records = bytearray(), bytearray(4 * 256)  # the first block is empty
        for block in used:
            for cp in range(block * 256, block * 256 + 256):
                own = entries.get(cp, "").encode()
                records += len(held).to_bytes(3) + len(own).to_bytes(1)
                held += own
        self.records, self.held = len(data), len(data) + len(records)
        data += records + held

    def at(self, c: Column, data: Column) -> Column:
        """The entry of the first character of ``c`` in the bytes ``data``; empty if it has none."""
        cp = F.ascii(c)
        slice_of = lambda start, at, n: F.substring(data, (at + start).cast("int"), n)
        block = _number(slice_of(self.blocks, F.shiftright(cp, 8) * 2 + 1, F.lit(2)))
        record = slice_of(self.records, (block * 256 + cp.bitwiseAND(F.lit(255))) * 4 + 1, F.lit(4))
        return let(record, lambda r: slice_of(self.held, _number(F.substring(r, 1, 3)) + 1, _number(F.substring(r, 4, 1))).cast("string"))


#: How many of the longest runs of stable characters beyond Latin are looked for first.
LONG_RUNS = 8


@lru_cache(maxsize=1)
def _tables() -> dict:
    """What the installed Unicode version says: tables of decompositions, combining classes and compositions; character classes of what is surely stable and of what may join the character before it."""
    opened, classes, pairs, second = {}, {}, {}, set()
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if 0xD800 <= cp < 0xE000 or HANGUL <= cp < HANGUL + HANGUL_COUNT:
            continue
        if combining := unicodedata.combining(c):
            classes[cp] = str(combining)
        if (full := unicodedata.normalize("NFKD", c)) != c:
            opened[cp] = full
        one = unicodedata.decomposition(c)
        if one and one[0] != "<" and " " in one and unicodedata.normalize("NFC", c) == c:
            a, b = (int(x, 16) for x in one.split())
            pairs[a] = pairs.get(a, "") + chr(b) + c
            second.add(b)
    joining = classes.keys() | second | {*range(V, V + V_COUNT), *range(T + 1, T + T_COUNT)}
    stable = _runs(cp for cp in range(sys.maxunicode + 1) if not 0xD800 <= cp < 0xE000 and cp not in joining and unicodedata.normalize("NFKC", chr(cp)) == chr(cp))
    latin = [r for r in stable if r[0] < 0x250]
    data = bytearray()
    return {
        "opened": _Table(opened, data),
        "classes": _Table(classes, data),
        "pairs": _Table(pairs, data),
        "data": bytes(data),
        "quick": _ranges([(0, 0x7F), (0xC0, 0xFF)]),
        "stable": _ranges(latin + sorted(stable[len(latin) :], key=lambda r: r[0] - r[1])[:LONG_RUNS]),
        "joining": r"\p{M}" + _ranges(_runs(sorted(cp for cp in joining if unicodedata.category(chr(cp))[0] != "M"))),
    }


def _char(cp: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")


def _hangul_parts(c: Column) -> Column:
    s = F.ascii(c) - HANGUL
    tail = s % T_COUNT
    return F.concat(
        _char((F.lit(L) + F.floor(s / (V_COUNT * T_COUNT))).cast("int")),
        _char((F.lit(V) + F.floor((s % (V_COUNT * T_COUNT)) / T_COUNT)).cast("int")),
        F.when(tail > 0, _char((F.lit(T) + tail).cast("int"))).otherwise(""),
    )


def _class(c: Column, data: Column) -> Column:
    """The canonical combining class."""
    return F.coalesce(_tables()["classes"].at(c, data).try_cast("int"), F.lit(0))


def _composed(starter: Column, c: Column, data: Column) -> Column:
    """The primary composite of two characters, or null."""
    a, b = F.ascii(starter), F.ascii(c)
    lv = a.between(L, L + 18) & b.between(V, V + V_COUNT - 1)
    lvt = a.between(HANGUL, HANGUL + HANGUL_COUNT - 1) & ((a - HANGUL) % T_COUNT == 0) & b.between(T + 1, T + T_COUNT - 1)
    cp = F.when(lv, ((a - L) * V_COUNT + b - V) * T_COUNT + HANGUL).when(lvt, a + b - T)
    # characters that may follow, each before its composite
    known = let(_tables()["pairs"].at(starter, data), lambda k: let(F.instr(k, c), lambda place: F.when(place % 2 == 1, F.substring(k, place + 1, F.lit(1)))))
    return F.when(lv | lvt, _char(cp.cast("int"))).otherwise(known)


def _in_order(run: Column, data: Column) -> Column:
    """A run of marks in canonical order: each stretch between marks of class 0 sorted by class, equal classes as they stand."""
    classed = F.transform(F.split(run, ""), lambda c, i: F.struct(_class(c, data).alias("k"), i.alias("i"), c.alias("c")))
    begun = lambda stretch, m: F.when(m["k"] == 0, stretch + 1).otherwise(stretch)
    keyed = scan(classed, F.lit(0), begun, lambda stretch, m: F.struct(begun(stretch, m).alias("stretch"), m["k"].alias("k"), m["i"].alias("i"), m["c"].alias("c")), "struct<stretch:int,k:int,i:int,c:string>")
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["c"]), "")


def _compose_run(run: Column, data: Column) -> Column:
    """A starter and what may join it, composed as the standard says: a character joins the last starter unless one of its own class or a higher one stands between."""

    def joined(acc: Column, c: Column, klass: Column, whole: Column) -> Column:
        state = lambda out, starter, tail, last: F.struct(out.alias("out"), starter.alias("starter"), tail.alias("tail"), last.alias("last"))
        return (
            F.when(whole.isNotNull(), state(acc["out"], whole, acc["tail"], acc["last"]))
            .when(klass == 0, state(F.concat(acc["out"], acc["starter"], acc["tail"]), c, F.lit(""), F.lit(0)))
            .otherwise(state(acc["out"], acc["starter"], F.concat(acc["tail"], c), klass))
        )

    def step(acc: Column, c: Column) -> Column:
        free = lambda klass: (acc["starter"] != "") & ((acc["tail"] == "") | ((acc["last"] < klass) & (acc["last"] > 0)))
        return let(_class(c, data), lambda klass: let(F.when(free(klass), _composed(acc["starter"], c, data)), lambda whole: joined(acc, c, klass, whole)))

    start = F.struct(F.lit("").alias("out"), F.lit("").alias("starter"), F.lit("").alias("tail"), F.lit(0).alias("last"))
    return F.aggregate(F.split(run, ""), start, step, lambda acc: F.concat(acc["out"], acc["starter"], acc["tail"]))


def nfkc(text: Column, data: Column | None = None) -> Column:
    """``text`` in NFKC.  Texts of surely stable characters alone, nearly all, are only looked through.

    ``data`` are the tables' bytes, bound once by :func:`let`, as an array.  Plans
    do not write an array's bytes out; of bytes by themselves they show every
    digit, over a million in all, and the driver keeps the texts of plans.
    """
    if data is None:
        return let(F.lit(_tables()["data"]), lambda held: nfkc(text, held))
    t = _tables()
    pieces = lambda s, pattern: F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    stable, joining = t["stable"], t["joining"]

    def whole(s: Column) -> Column:
        one = lambda c: F.when(F.ascii(c).between(HANGUL, HANGUL + HANGUL_COUNT - 1), _hangul_parts(c)).otherwise(F.coalesce(F.nullif(t["opened"].at(c, data), F.lit("")), c))
        opened = F.array_join(F.transform(pieces(s, rf"[{stable}]+(?![{joining}])|[{stable}]|[^{stable}]"), lambda c: F.when(F.char_length(c) == 1, one(c)).otherwise(c)), "")
        ordered = F.array_join(F.transform(pieces(opened, r"\p{M}{2,}|\p{M}|\P{M}+"), lambda r: F.when(r.rlike(r"^\p{M}{2}"), _in_order(r, data)).otherwise(r)), "")
        runs = pieces(ordered, f"[^{joining}]+(?![{joining}])|[^{joining}]?[{joining}]+")
        return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"[{joining}]"), _compose_run(r, data)).otherwise(r)), "")

    # most characters are told by the two ranges that come first
    unstable = lambda s: (F.octet_length(s) > F.char_length(s)) & s.rlike(rf"[^{t['quick']}](?<=[^{stable}])")
    return let(text, lambda s: F.when(unstable(s), whole(s)).otherwise(s))


#: White space of ASCII other than the space, and beyond ASCII what NFKC does not make a space.
SPACES, WIDE_SPACES = "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f", r"\x{85}\x{1680}\x{2028}\x{2029}"


def canonical(text: Column) -> Column:
    """NFKC, then case folded by way of upper case, then NFKC where that has undone it; runs of white space become one space and none at the ends."""
    # the same steps twice, the second time on the folded text, so that the plan holds them once; the inner name keeps upper, which Catalyst would leave out before lower
    folded = let(F.lit(_tables()["data"]), lambda data: F.aggregate(F.array(F.lit(False), F.lit(True)), text, lambda s, fold: nfkc(F.when(fold, let(F.upper(s), F.lower)).otherwise(s), data)))
    for c in SPACES:
        folded = F.replace(folded, F.lit(c), F.lit(" "))
    spaced = let(folded, lambda s: F.when(F.octet_length(s) > F.char_length(s), F.regexp_replace(s, f"[{WIDE_SPACES}]", " ")).otherwise(s))
    return F.trim(let(spaced, lambda s: F.when(F.contains(s, F.lit("  ")), F.regexp_replace(s, " {2,}", " ")).otherwise(s)))


def digest(canon: Column) -> Column:
    """128 bits of xxHash as 32 hexadecimal digits."""
    wide = lambda c: F.concat(*(F.lpad(F.lower(F.hex(x)), 16, "0") for x in (F.xxhash64(c), F.xxhash64(F.lit("wide"), c))))
    return let(canon, wide)


# --- the next document ----------------------------------------------------------

#: Places in the order of documents that a window of their texts spans, and that one of their ids alone does.
SPAN, IDS = 256, 4096


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``at``, a whole number that grows with doc_id: an integral id itself, else its place in the sorted ids; none for rows without an id."""
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        return docs.withColumn("at", F.col("doc_id").cast("bigint"))
    ids = docs.where("doc_id is not null").select("doc_id").distinct()
    places = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("doc_id", F.monotonically_increasing_id().alias("at"))
    return keyed_join(docs, staged(places, "places"), "doc_id", "left")


def next_places(places: DataFrame) -> DataFrame:
    """``at, next_at`` for distinct ``places(at)``, the last followed by the first.

    Order is found in blocks of places; blocks are linked in the same way from
    their least places, level by level, so that no task sorts more than a block.
    """
    if places.limit(IDS + 1).count() <= IDS:
        w = Window.partitionBy(F.lit(0)).orderBy("at")
        first = F.min("at").over(Window.partitionBy(F.lit(0)))
        return places.select("at", F.coalesce(F.lead("at").over(w), first).alias("next_at"))
    blocked = places.select("at", F.floor(F.col("at") / IDS).cast("bigint").alias("block"))
    blocks = staged(blocked.groupBy("block").agg(F.min("at").alias("least")), "blocks")
    after = next_places(blocks.select(F.col("block").alias("at"))).toDF("block", "next_block")
    least = after.join(blocks.select(F.col("block").alias("next_block"), "least"), "next_block").select("block", "least")
    inner = blocked.withColumn("next_at", F.lead("at").over(Window.partitionBy("block").orderBy("at")))
    return inner.join(least, "block").select("at", F.coalesce("next_at", "least").alias("next_at"))


def order_of(docs: DataFrame) -> DataFrame:
    """:func:`next_places` of the documents ``docs(at)`` that have a place, as a staged table."""
    return staged(next_places(staged(docs.where("at is not null").select("at").distinct(), "ids")), "order")


def with_next(docs: DataFrame, order: DataFrame) -> DataFrame:
    """``docs(doc_id, at, text)`` with ``fp`` and ``next_text``, ``next_fp``, those of the next row by doc_id, then text; ``order`` is theirs.

    The texts are shuffled once, in blocks of SPAN places; a block also gets the
    first row of the next one.  Rows without an id have no next row.
    """
    block = F.floor(F.col("at") / SPAN).cast("bigint")
    across = staged(order.where(F.floor(F.col("next_at") / SPAN) != F.floor(F.col("at") / SPAN)).select(F.col("next_at").alias("at"), block.alias("block")), "across")
    if across.isEmpty():  # one block: its last row is followed by its own first one
        across = staged(order.groupBy().agg(F.min("at").alias("at"), F.min(block).alias("block")).where("at is not null"), "across")
    guests = docs.join(small(across), "at").select("block", "doc_id", "at", "text", F.lit(True).alias("guest"))
    rows = docs.where("at is not null").select(block.alias("block"), "doc_id", "at", "text", F.lit(False).alias("guest")).unionByName(guests)
    keyed = rows.withColumn("fp", digest(canonical(F.col("text"))))
    w = Window.partitionBy("block").orderBy("guest", "at", F.xxhash64("text"))
    ordered = keyed.withColumns({"next_text": F.lead("text").over(w), "next_fp": F.lead("fp").over(w)}).where("not guest").drop("block", "guest")
    none = F.lit(None).cast("string")
    lone = docs.where("at is null").select("doc_id", "at", "text", digest(canonical(F.col("text"))).alias("fp"), none.alias("next_text"), none.alias("next_fp"))
    return ordered.unionByName(lone)


def with_edited(rows: DataFrame) -> DataFrame:
    """The rows of :func:`with_next` with ``edited``: the last quarter replaced by the first as many code points of the next text."""
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    return rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter)))


# --- the operator ---------------------------------------------------------------


def collided(docs: DataFrame, order: DataFrame, out: DataFrame) -> DataFrame:
    """``fp`` of the buckets whose canonical bytes differ, of the texts of ``docs(doc_id, at, text)`` and of their edited texts; ``out`` has the digests of both.

    Only documents whose text, or edited text, shares a bucket are read again, with
    those that follow the latter.  A bucket is compared by its least and its
    greatest bytes, found before the shuffle, so one of any size sends a task's
    worth of two texts at most.  An edited text that is the text itself counts once.
    """
    kinds = F.array(F.struct(F.lit(False).alias("edit"), F.col("fp").alias("fp")), F.struct(F.lit(True).alias("edit"), F.col("edited_fp").alias("fp")))
    each = out.select("at", F.explode(F.when(F.col("same"), F.slice(kinds, 1, 1)).otherwise(kinds)).alias("x")).select("at", "x.*")
    shared = staged(each.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "shared")
    owners = staged(keyed_join(each, shared, "fp").where("at is not null").groupBy("at").agg(F.max(F.when(~F.col("edit"), True)).alias("text_too"), F.max(F.when(F.col("edit"), True)).alias("edit_too")), "owners")
    # rows without an id are few and always taken
    lone = docs.where("at is null")
    texts = keyed_join(docs, owners.where("text_too").select("at"), "at").unionByName(lone)
    edits = owners.where("edit_too").select("at")
    needed = staged(edits.unionByName(edits.join(order, "at").select(F.col("next_at").alias("at"))).distinct(), "needed")
    some = staged(keyed_join(docs, needed, "at").unionByName(lone), "some")
    edited = with_edited(with_next(some, order_of(some)))
    edited = keyed_join(edited.where("at is not null"), staged(edits, "edits"), "at").unionByName(edited.where("at is null"))
    both = texts.select(F.col("text").alias("t")).unionByName(edited.where("edited <> text").select(F.col("edited").alias("t")))
    made = both.select(let(canonical(F.col("t")), lambda c: F.struct(c.alias("c"), digest(c).alias("fp"))).alias("x")).select("x.*")
    return made.groupBy("fp").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("fp")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp`` of ``docs(doc_id, text)``, whose texts are not null; equal digests are those of equal canonical texts."""
    docs = placed(docs)
    order = order_of(docs)
    rows = with_edited(with_next(docs, order))
    facts = ("doc_id", "at", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), (F.col("edited") == F.col("text")).alias("same"))
    out = staged(rows.select(*facts, "fp", F.when(F.col("edited") == F.col("text"), F.col("fp")).otherwise(digest(canonical(F.col("edited")))).alias("edited_fp"), "next_fp"), "digests")
    bad = staged(collided(docs, order, out), "collided")
    return out if bad.isEmpty() else _drawn_out(rows, facts, bad)


def op6_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likenesses, which are 1 or 0 as the digest is exact."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    like = lambda c: F.when(F.col("fp") == F.col(c), 1.0).otherwise(0.0)
    return fingerprinted(docs).select("doc_id", "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), like("edited_fp").alias("near_edited"), like("next_fp").alias("near_next"))


def _drawn_out(rows: DataFrame, facts: tuple, bad: DataFrame) -> DataFrame:
    """The digests, those in ``bad`` drawn out by the SHA-256 of the canonical text."""
    longer = lambda c, text: F.when(F.col(f"bad_{c}"), F.concat(F.col(c), F.sha2(canonical(F.col(text)), 256))).otherwise(F.col(c)).alias(c)
    marked = rows.withColumn("edited_fp", digest(canonical(F.col("edited"))))
    for c in ("fp", "edited_fp", "next_fp"):
        marked = marked.join(bad.select(F.col("fp").alias(c), F.lit(True).alias(f"bad_{c}")), c, "left")
    return marked.select(*facts, longer("fp", "text"), longer("edited_fp", "edited"), longer("next_fp", "next_text"))
