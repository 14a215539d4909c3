"""URL filters: rules, and gradient-boosted trees on lexical features.

Only DataFrame functions are used.  The trees are grown on all labelled URLs, or
on a bounded sample if one asks for it, from histograms: one grouped sum of gradients per level of a tree
gives every split, and only those sums, nodes x features x bins of them, reach
the driver.  The model is a plain expression, so URLs are judged within the
scan, without a shuffle.

Labels are the rules' own: URLs that a rule blocks are positive, those that a
rule allows negative, and URLs that no rule decides are background, negative too,
as a blocklist's complement is.  What the trees give is thus how much a URL looks
like a blocked one among all others.  Labelled URLs of a table can take the
place of these or join them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import keyed_join, staged

#: The rules of the query: verdict, host, path.  A rule holds for the host and all its subdomains, where the path begins with the rule's.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

FEATURES = ("length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "host_entropy", "hyphens", "parameters", "query_length", "longest_label", "suffix_blocked", "suffix_rows")
#: Labelled rows of a sample, at most, half of either class: those of the least hashes.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, SMOOTH = 12, 3, 16, 0.3, 5.0
#: A URL that no rule decides is blocked from the least score on, 0.5 or more, from which so many labelled ones are blocked; scores are told apart by hundredths.
PRECISION = 0.8
#: Folds of the labelled rows whose suffix statistics leave each other out.
FOLDS = 5


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and what follows it.  Null or no ``://``: all empty."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substring(rest, F.char_length(raw) + 1, F.char_length(rest))
    path = F.regexp_extract(after, "^[^?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, path, F.substring(after, F.char_length(path) + 1, F.char_length(after))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _entropy(text: Column) -> Column:
    n = F.char_length(text).cast("double")
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (F.char_length(text) - F.char_length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def lexical(urls: DataFrame) -> DataFrame:
    """``row``, all columns of ``urls`` (with column url), beside host, path, suffix and ``f``, an array of the lexical features but the suffix's."""
    url = F.coalesce("url", F.lit(""))
    host, path, tail = url_parts(url)
    parted = urls.select(F.struct(*urls.columns).alias("row"), url.alias("url"), host.alias("host"), path.alias("path"), tail.alias("tail"))
    digits = F.char_length(F.regexp_replace("url", "[^0-9]", ""))
    n, query = F.char_length("url"), F.regexp_extract("tail", r"^\?([^#]*)", 1)
    values = {
        "length": n,
        "host_length": F.char_length("host"),
        "path_length": F.char_length("path"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")),
        "host_labels": F.size(F.split("host", r"\.")),
        "digit_ratio": F.when(n > 0, digits / n).otherwise(0.0),
        "entropy": _entropy(F.col("url")),
        "host_entropy": _entropy(F.col("host")),
        "hyphens": F.char_length("host") - F.char_length(F.replace("host", F.lit("-"), F.lit(""))),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "query_length": F.char_length(query),
        "longest_label": F.array_max(F.transform(F.split("host", r"\."), lambda s: F.char_length(s))),
    }
    return parted.select("row", "host", "path", suffix(F.col("host")).alias("suffix"), F.array(*(v.cast("double") for v in values.values())).alias("f"))


@dataclass
class Model:
    """Edges of the bins of each feature, and trees as nested (feature, bin, left, right) with leaves as numbers."""

    edges: list[list[float]]
    base: float
    suffixes: DataFrame
    share: float
    trees: list = field(default_factory=list)
    #: Scores from here on block; beyond 1 none does.
    threshold: float = 2.0

    def binned(self, f: Column) -> Column:
        """The bin of each feature: how many edges lie below it."""
        return F.array(*(sum((F.get(f, i) > e).cast("int") for e in es) if es else F.lit(0) for i, es in enumerate(self.edges)))

    def margin(self, bins: Column) -> Column:
        def walk(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            feature, cut, left, right = tree
            return F.when(F.get(bins, feature) <= cut, walk(left)).otherwise(walk(right))

        return sum((walk(t) for t in self.trees), F.lit(self.base))


def _rated(blocked: Column, weight: Column, n: Column, share: float) -> Column:
    """The two statistics of a suffix: its share of blocked URLs, drawn to the share of all where it has few, and how many it has."""
    return F.array((F.coalesce(blocked, F.lit(0.0)) + SMOOTH * share) / (F.coalesce(weight, F.lit(0.0)) + SMOOTH), F.log1p(F.coalesce(n, F.lit(0)).cast("double")))


def with_suffixes(rows: DataFrame, suffixes: DataFrame, share: float) -> DataFrame:
    """``f`` completed by the suffix statistics; an unknown suffix has those of no rows.  There may be many suffixes, and one may have most rows."""
    joined = keyed_join(rows, suffixes, "suffix", "left")
    return joined.withColumn("f", F.concat("f", _rated(F.col("s_blocked"), F.col("s_weight"), F.col("s_rows"), share))).drop("s_blocked", "s_weight", "s_rows")


def suffix_sums(rows: DataFrame, *by: str) -> DataFrame:
    sums = (F.sum(F.col("blocked") * F.col("weight")).alias("s_blocked"), F.sum("weight").alias("s_weight"), F.count("*").alias("s_rows"))
    return staged(rows.groupBy("suffix", *by).agg(*sums), "suffixes")


def out_of_fold(rows: DataFrame, suffixes: DataFrame, share: float) -> DataFrame:
    """``f`` of labelled rows completed by the suffix statistics of the other folds: a row's own label must not come back as a feature."""
    own = suffix_sums(rows, "fold").withColumnsRenamed({"s_blocked": "o_blocked", "s_weight": "o_weight", "s_rows": "o_rows"})
    both = keyed_join(keyed_join(rows, suffixes, "suffix"), own, ["suffix", "fold"])
    rest = _rated(F.col("s_blocked") - F.col("o_blocked"), F.col("s_weight") - F.col("o_weight"), F.col("s_rows") - F.col("o_rows"), share)
    return both.select("f", "blocked", "weight", rest.alias("rest")).select(F.concat("f", "rest").alias("f"), F.col("blocked").cast("double").alias("y"), F.col("weight").cast("double").alias("w"))


def sampled(labelled: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Of ``labelled(url, blocked)`` at most half of ``most`` rows of either class, those of the least hashes, with the ``weight`` that brings each class back to its number, scaled to the sample's."""
    counts = {r["blocked"]: r["n"] for r in labelled.groupBy("blocked").agg(F.count("*").alias("n")).collect()}
    total, out = sum(counts.values()) or 1, None
    took = {c: min(counts.get(c, 0), most // 2) for c in (0, 1)}
    for c in (0, 1):
        part = labelled.where(F.col("blocked") == c).orderBy(F.xxhash64("url"), "url").limit(most // 2)
        part = part.select("url", "blocked", F.lit(counts.get(c, 0) / total * sum(took.values()) / max(took[c], 1)).alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out


def labelled_rows(labelled: DataFrame, most: int | None = None) -> DataFrame:
    """``labelled(url, blocked)``, all of it or a sample of at most ``most`` rows, with weights, features and folds."""
    chosen = sampled(labelled, most) if most else labelled.select("url", "blocked", F.lit(1.0).alias("weight"))
    rows = lexical(chosen).select(F.col("row.blocked").alias("blocked"), F.col("row.weight").alias("weight"), "suffix", "f", F.pmod(F.xxhash64("row.url"), F.lit(FOLDS)).cast("int").alias("fold"))
    return staged(rows, "labelled")


def train(labelled: DataFrame, most: int | None = None) -> Model:
    """Grow the trees on ``labelled(url, blocked)``, on all rows unless ``most`` bounds a sample."""
    rows = labelled_rows(labelled, most)
    total = rows.agg(F.sum(F.col("blocked") * F.col("weight")).alias("y"), F.sum("weight").alias("w")).first()
    share = min(max((total["y"] or 0.0) / (total["w"] or 1.0), 1e-3), 1 - 1e-3)
    suffixes = suffix_sums(rows)
    sample = staged(out_of_fold(rows, suffixes, share), "sample")
    quantiles = [i / BINS for i in range(1, BINS)]
    found = sample.agg(*(F.percentile_approx(F.get("f", i), quantiles, 1000).alias(f"q{i}") for i in range(len(FEATURES)))).first()
    model = Model([sorted(set(found[f"q{i}"] or [])) for i in range(len(FEATURES))], math.log(share / (1 - share)), suffixes, share)
    if not total["w"]:
        return model
    bins = staged(sample.select(model.binned(F.col("f")).alias("b"), "y", "w"), "bins")
    for _ in range(TREES):
        p = 1 / (1 + F.exp(-model.margin(F.col("b"))))
        model.trees.append(_grow(bins.select("b", (F.col("w") * (F.col("y") - p)).alias("g"), (F.col("w") * p * (1 - p)).alias("h"))))
    score = 1 / (1 + F.exp(-model.margin(F.col("b"))))
    steps = bins.groupBy(F.floor(score * 100).cast("int").alias("step")).agg(F.sum(F.col("y") * F.col("w")).alias("y"), F.sum("w").alias("w")).collect()  # hundredths
    blocked = total = 0.0
    for r in sorted(steps, key=lambda r: -r["step"]):
        blocked, total = blocked + r["y"], total + r["w"]
        if r["step"] >= 50 and blocked >= PRECISION * total:
            model.threshold = r["step"] / 100
    return model


def split_of(sums: list[tuple[int, int, float, float]]) -> tuple[tuple[int, int] | None, tuple[float, float], tuple[float, float]]:
    """The best split (feature, bin) of a node whose rows have gradients and curvatures ``sums(feature, bin, g, h)``, and the sums of both of its sides; none, and all on the left, where no split gains."""
    total = tuple(sum(r[c] for r in sums if r[0] == 0) for c in (2, 3))
    best = (1e-6, None, total, (0.0, 0.0))
    g = h = 0.0
    before = None
    for feature, cut, dg, dh in sorted(sums):
        g, h = (g + dg, h + dh) if feature == before else (dg, dh)
        before = feature
        rest = total[0] - g, total[1] - h
        if h > 1 and rest[1] > 1:
            gain = g * g / (h + 1) + rest[0] ** 2 / (rest[1] + 1) - total[0] ** 2 / (total[1] + 1)
            best = max(best, (gain, (feature, cut), (g, h), rest), key=lambda x: x[0])
    return best[1:]


def leaf(g: float, h: float) -> float:
    return RATE * g / (h + 1)


def _grow(rows: DataFrame):
    """One tree on gradients g and curvatures h, a level at a time; a split's own sums are those of its leaves, so the last level needs no pass."""
    splits: dict[int, tuple[int, int]] = {}
    leaves: dict[int, float] = {}
    open_nodes = {1}
    for level in range(DEPTH):
        node = F.lit(1)
        for n, (feature, cut) in sorted(splits.items()):
            node = F.when(node == n, F.when(F.get("b", feature) <= cut, 2 * n).otherwise(2 * n + 1)).otherwise(node)
        placed = rows.select(node.alias("node"), "g", "h", F.posexplode("b").alias("feature", "bin"))
        sums = placed.where(F.col("node").isin(*sorted(open_nodes))).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        for n in sorted(open_nodes):
            found, left, right = split_of([(r["feature"], r["bin"], r["g"], r["h"]) for r in sums if r["node"] == n])
            open_nodes.discard(n)
            if found is None:
                leaves[n] = leaf(*left)
                continue
            splits[n] = found
            leaves |= {2 * n: leaf(*left), 2 * n + 1: leaf(*right)}
            if level < DEPTH - 1:
                open_nodes |= {2 * n, 2 * n + 1}
        if not open_nodes:
            break

    def tree(n: int):
        return (*splits[n], tree(2 * n), tree(2 * n + 1)) if n in splits else float(leaves.get(n, 0.0))

    return tree(1)


def judged(pages: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """``pages`` (with column url) with host, path, rule, verdict and score, the trees' probability of a block; columns of those names are replaced."""
    rows = with_suffixes(lexical(pages), model.suffixes, model.share).withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).withColumn("bins", model.binned(F.col("f")))
    scored = rows.withColumn("score", 1 / (1 + F.exp(-model.margin(F.col("bins")))))
    verdict = F.coalesce("found.verdict", F.when(F.col("score") >= model.threshold, "block").otherwise("allow"))
    new = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("found.rule"), "verdict": verdict, "score": F.col("score")}
    return scored.select(*(F.col("row")[c].alias(c) for c in pages.columns if c not in new), *(v.alias(c) for c, v in new.items()))


def rule_labels(pages: DataFrame, rules=RULES) -> DataFrame:
    """Every URL once, as ``url, blocked``: 1 where a rule blocks it, else 0; rows without a url are none."""
    host, path, _ = url_parts(F.col("url"))
    blocked = F.coalesce((rule_of(host, path, rules)["verdict"] == "block").cast("int"), F.lit(0))
    return pages.where("url is not null").select("url", blocked.alias("blocked")).distinct()


def op2_urls(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL, and the trees' score."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judged(pages, train(rule_labels(pages))).select("page_id", "host", "path", "rule", "verdict", "score")


#: Host, path and rule of every page, and the rule's verdict where there is one, in DuckDB's SQL; the trees have no counterpart in it.
RULES_SQL = """
WITH r(verdict, rule_host, rule_path) AS (VALUES """ + ", ".join(str(r) for r in RULES) + """),
u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY ALL
"""
