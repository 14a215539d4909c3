"""Benchmark decontamination by a distributed positional inverted index.

Only DataFrame functions are used.  Words are counted over all documents, which
orders the terms of each window of a benchmark item from the rarest on.  One scan
of the documents writes the index: posting lists, a term's positions in a
document, for the terms of the benchmark, wherever the rarest term of a window
has its second rarest within reach.  A search begins with the postings of each
window's rarest term, joins the list of the second rarest and then those of the
others, and intersects the lists less each term's offset in the window: what is
left are the places of the phrase.  A window all of whose terms have a position
within reach of the rarest one's is a proximity match.

The scan asks two bit tables which words may begin a list; the tables grow with
the benchmark, up to 16 MB, and only sieve.  Documents are
known by id and text, so equal rows share their postings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import discard, keyed_join, live_paths, small, staged

#: Characters that part words, once A-Z are lower-cased.
PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of ``text`` in order; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), PARTING), lambda w: w != "")


def windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: ``words``, ``items`` (their ids as strings, sorted).  An item of fewer words is one window; one without words has none."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    each = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, width))).alias("words"))
    return each.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


@dataclass
class Index:
    """``documents``: doc_id, id_key, text_key, n_words, a row for each row of documents; ``postings``: id_key, text_key, term, positions; ``windows``: window_id, items, length, and ``terms``, structs (n, at, term) in order of rarity."""

    documents: DataFrame
    postings: DataFrame
    windows: DataFrame
    width: int


#: Bits of a sieve for each of its entries, and bits at least and at most; 64 to a long, so 16 MB at most.
BITS_EACH, BITS_LEAST, BITS_MOST = 32, 1 << 16, 1 << 27
DOCUMENT = ["id_key", "text_key"]


def _sieve(entries: DataFrame) -> tuple[Column, int]:
    """A bit table of the hashes ``entries(h)`` as a constant array of longs, and its size in bits.  It only sieves; matches are held against the words."""
    size = 1 << (BITS_EACH * max(1, entries.count()) - 1).bit_length()
    size = min(max(size, BITS_LEAST), BITS_MOST)
    slot = F.pmod("h", F.lit(size))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(slot, F.lit(64)).cast("int"))
    rows = entries.groupBy(F.shiftright(slot, 6).alias("i")).agg(F.bit_or(bit).alias("v")).collect()
    table = [0] * (size // 64)  # BITS_MOST / 64 longs at most, however many entries
    for r in rows:
        table[r["i"]] = r["v"]
    return F.expr(f"cast(split('{','.join(map(str, table))}', ',') as array<bigint>)"), size


def _bit(sieve: tuple[Column, int], h: Column) -> Column:
    """Whether the bit of hash ``h`` is set."""
    slot = F.pmod(h, F.lit(sieve[1]))
    word = F.get(sieve[0], F.shiftright(slot, 6).cast("int"))
    return F.call_function("shiftright", word, F.pmod(slot, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _document(docs: DataFrame) -> list[Column]:
    """doc_id and what a document is known by: its id as text, told apart from none, and a hash of its text."""
    key = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    return [F.col("doc_id"), key.alias("id_key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")]


def ordered_windows(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """The windows of ``benchmark`` with their terms in order of rarity: how often each stands in all of ``docs``, and its place."""
    wins = staged(windows(benchmark, width), "windows")
    terms = staged(wins.select(F.explode("words").alias("term")).distinct(), "terms")
    tokens = docs.select(F.explode(words(F.col("text"))).alias("term"))
    counted = tokens.join(small(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    freq = staged(terms.join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n")), "frequencies")
    placed = wins.withColumn("window_id", F.monotonically_increasing_id())
    placed = staged(placed, "numbered")
    each = keyed_join(placed.select("window_id", F.posexplode("words").alias("at", "term")), freq, "term")
    order = each.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("n", "at", "term"))).alias("terms"))
    return staged(order.join(placed, "window_id").select("window_id", "items", F.size("words").alias("length"), "terms"), "ordered")


def build_index(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> Index:
    """Count the windows' words over all of ``docs(doc_id, text)`` and store the posting lists that the windows may need."""
    wins = ordered_windows(docs, benchmark, width)
    rarest, second = F.col("terms")[0]["term"], F.coalesce(F.try_element_at("terms", F.lit(2)), F.col("terms")[0])["term"]
    pairs = _sieve(staged(wins.select(F.xxhash64(rarest, second).alias("h")).distinct(), "pairs"))
    anchors = _sieve(staged(wins.select(F.xxhash64(rarest).alias("h")).distinct(), "anchors"))
    vocabulary = _sieve(staged(wins.select(F.explode("terms.term").alias("t")).select(F.xxhash64("t").alias("h")).distinct(), "vocabulary"))

    n = F.size("w")
    word = lambda i: F.element_at("w", i + 1)
    reach = lambda i: F.sequence(F.greatest(i - width + 1, F.lit(0)), F.least(i + width - 1, n - 1))
    places = F.filter(F.sequence(F.lit(0), n - 1), lambda i: _bit(anchors, F.xxhash64(word(i))))
    likely = F.filter(places, lambda i: F.exists(reach(i), lambda o: _bit(pairs, F.xxhash64(word(i), word(o)))))
    around = F.array_distinct(F.flatten(F.transform(likely, reach)))
    posted = F.filter(F.transform(around, lambda i: F.struct(word(i).alias("term"), i.alias("pos"))), lambda p: _bit(vocabulary, F.xxhash64(p["term"])))
    posted = F.when(n > 0, posted).otherwise(F.array().cast("array<struct<term:string,pos:int>>"))
    texts = docs.select(*_document(docs), words(F.col("text")).alias("w"))
    stored = staged(texts.select("doc_id", *DOCUMENT, n.alias("n_words"), posted.alias("posted")), "index")
    lists = stored.select(*DOCUMENT, F.explode("posted").alias("p")).groupBy(*DOCUMENT, F.col("p.term").alias("term")).agg(F.array_sort(F.collect_set("p.pos")).alias("positions"))
    return Index(stored.select("doc_id", *DOCUMENT, "n_words"), staged(lists, "postings"), wins, width)


def search(index: Index) -> DataFrame:
    """Matches ``(id_key, text_key, window_id, starts, near)``: the places of the whole phrase in a document, if any, and whether all terms lie within reach of the rarest."""
    by_first = index.windows.groupBy(F.col("terms")[0]["term"].alias("term")).agg(F.collect_list(F.struct("window_id", F.col("terms")[0]["at"].alias("at"))).alias("windows"))
    first = keyed_join(index.postings, staged(by_first, "first"), "term").select(*DOCUMENT, F.col("positions").alias("own"), F.explode("windows").alias("x"))
    rest = staged(index.windows.select("window_id", F.slice("terms", 2, index.width).alias("others")), "rest")
    begun = keyed_join(first.select(*DOCUMENT, "own", "x.*"), rest, "window_id")
    within = lambda p, places: F.exists(places, lambda q: F.abs(q - p) < index.width)

    # the second rarest term: only rows with that within reach go on
    alone = begun.where(F.size("others") == 0).select(*DOCUMENT, "window_id", "at", "own", "others", F.array().cast("array<struct<at:int,positions:array<int>>>").alias("lists"))
    some = begun.where(F.size("others") > 0).withColumn("term", F.col("others")[0]["term"])
    met = some.join(index.postings, [*DOCUMENT, "term"]).withColumn("own", F.filter("own", lambda p: within(p, F.col("positions")))).where(F.size("own") > 0)
    two = staged(met.select(*DOCUMENT, "window_id", "at", "own", "others", F.array(F.struct(F.col("others")[0]["at"].alias("at"), "positions")).alias("lists")), "two")

    # the lists of all other terms
    more = two.where(F.size("others") > 1).select(*DOCUMENT, "window_id", F.explode(F.slice("others", 2, index.width)).alias("o")).select(*DOCUMENT, "window_id", F.col("o.at").alias("o_at"), F.col("o.term").alias("term"))
    found = more.join(index.postings, [*DOCUMENT, "term"]).groupBy(*DOCUMENT, "window_id").agg(F.collect_list(F.struct(F.col("o_at").alias("at"), "positions")).alias("more"))
    longer = two.where(F.size("others") > 1).join(found, [*DOCUMENT, "window_id"]).where(F.size("more") == F.size("others") - 1)
    whole = longer.select(*DOCUMENT, "window_id", "at", "own", F.concat("lists", "more").alias("lists"))
    whole = whole.unionByName(two.where(F.size("others") == 1).drop("others")).unionByName(alone.drop("others"))

    begin = F.transform("own", lambda p: p - F.col("at"))
    starts = F.aggregate("lists", begin, lambda acc, x: F.array_intersect(acc, F.transform(x["positions"], lambda q: q - x["at"])))
    near = F.exists("own", lambda p: F.forall("lists", lambda x: within(p, x["positions"])))
    return whole.select(*DOCUMENT, "window_id", starts.alias("starts"), near.alias("near")).where("near")  # a phrase lies within reach too


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per document of ``docs(doc_id, text)``: doc_id, id_key, text_key, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items.

    n_hit counts the words inside any exact occurrence of a window, n_items the
    items with one, n_near_items those with a proximity match, exact ones among
    them.  Null and empty texts have no words and are clean; an empty benchmark
    leaves all clean; repeated rows and ids have a row each.
    """
    index = build_index(docs, benchmark, width)
    found = staged(search(index), "matches")
    named = keyed_join(found, index.windows.select("window_id", "items", "length"), "window_id")
    hit = named.select(*DOCUMENT, "length", F.explode("starts").alias("s")).select(*DOCUMENT, F.explode(F.sequence(F.col("s"), F.col("s") + F.col("length") - 1)).alias("p")).distinct().groupBy(*DOCUMENT).agg(F.count("*").alias("n_hit"))
    item = named.select(*DOCUMENT, F.explode("items").alias("item"), (F.size("starts") > 0).alias("exact")).groupBy(*DOCUMENT, "item").agg(F.max("exact").alias("exact"))
    items = item.groupBy(*DOCUMENT).agg(F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("ids"), F.count("*").alias("n_near_items"))
    facts = staged(items.join(hit, DOCUMENT, "left"), "facts")
    out = keyed_join(index.documents, facts, DOCUMENT, "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)), F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        *DOCUMENT,
        F.col("n_words").cast("bigint").alias("n_words"),
        n_hit.cast("bigint").alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce("n_near_items", F.lit(0)).cast("bigint").alias("n_near_items"),
    )


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document by every benchmark item, windows of ten words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, benchmark).drop(*DOCUMENT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: documents with a hit go; the rest stays, columns as they are, whatever their names."""
    before = live_paths(docs.sparkSession)
    bad = staged(contamination(docs.select("doc_id", "text"), benchmark).where("contaminated").select(*DOCUMENT).distinct().withColumn("bad", F.lit(True)), "bad")
    discard(docs.sparkSession, [p for p in live_paths(docs.sparkSession) if p not in before][:-1])  # the last one is bad
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *_document(docs)[1:])
    return keyed_join(keyed, bad, DOCUMENT, "left").where("bad is null").select("row.*")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, w[i + 1 : i + 10] AS g FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT len(g) AS n FROM win
), places AS (
  SELECT doc_id, n, s, w[s + 1 : s + n] AS g FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n)
), hits AS (SELECT p.doc_id, p.s, p.n, item_id FROM places p JOIN win USING (g)
), pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS q FROM hits) GROUP BY doc_id
), it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id
), tokens AS (SELECT doc_id, w, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), freq AS (SELECT word, count(*) AS n FROM tokens GROUP BY word
), rare AS (SELECT g, arg_min(t, (coalesce(n, 0), i)) AS anchor FROM (SELECT g, unnest(g) AS t, generate_subscripts(g, 1) AS i FROM (SELECT DISTINCT g FROM win)) LEFT JOIN freq ON word = t GROUP BY g
), close AS (SELECT DISTINCT doc_id, g FROM tokens JOIN rare ON word = anchor WHERE list_has_all(w[greatest(p - 9, 1) : p + 9], g)
), nears AS (SELECT doc_id, count(DISTINCT item_id) AS n_near_items FROM close JOIN win USING (g) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nears USING (doc_id)
"""
