"""Secrets in texts: fixed patterns, and a battery of randomness tests.

Only DataFrame functions are used.  Base spans come from three patterns.  The
battery looks at the other long strings of encoding characters.  For each it
infers the encoding (hexadecimal, base 32, letters and digits, base 64) and
tests the string against independent uniform symbols of that alphabet:

* chi-squared of the symbol counts, standardised by its exact moments, so that
  strings shorter than the alphabet can be tested too;
* runs above and below the middle of the alphabet;
* serial correlation of neighbouring symbols.

A string that fails none of them looks random.  That alone would flag short
strings, on which the tests have little power.  So the same three statistics are
also held against an ordinary string of that length over that alphabet, whose
symbols come at the frequencies of letters in words: how far each lies from its
mean there, towards randomness, weighted by how far random strings of that length
lie on average.  The combined score gives a p-value against "ordinary", which
grows stronger with length as the tests do, and Benjamini-Hochberg's procedure,
run over all candidates of the corpus within bands of length, controls the share
of false discoveries among strings that look random.

Every step takes time in proportion to the text: matches are walked once, and
what a lambda needs is computed before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import let, scan, staged

# The three base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
# Alphabets in the order in which they are tried, and the symbols' order for runs and correlation.
DIGITS, UPPERS, LOWERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+=*$", UPPERS + "234567"),
    ("alnum", "^[A-Za-z0-9]+$", DIGITS + UPPERS + LOWERS),
    ("base64url", "^[A-Za-z0-9_-]+$", DIGITS + UPPERS + LOWERS + "-_"),
    ("base64", "^.*$", DIGITS + UPPERS + LOWERS + "+/"),
)
# Letters of ordinary English words by frequency, in per cent.
LETTERS = {"a": 8.2, "b": 1.5, "c": 2.8, "d": 4.3, "e": 12.7, "f": 2.2, "g": 2.0, "h": 6.1, "i": 7.0, "j": 0.2, "k": 0.8, "l": 4.0, "m": 2.4, "n": 6.7, "o": 7.5, "p": 1.9, "q": 0.1, "r": 6.0, "s": 6.3, "t": 9.1, "u": 2.8, "v": 1.0, "w": 2.4, "x": 0.2, "y": 2.0, "z": 0.1}
#: Shares of other symbols in ordinary strings: capitals together, digits together, each sign.
CAPITAL, DIGIT, SIGN = 0.06, 0.02, 0.01

#: A string counts as random while no test of the battery, corrected for their number, falls below this.
UNIFORM_LEAST = 1e-4
#: How the three scores go together in ordinary strings, at most: counts with runs, counts with correlation, runs with correlation.
TOGETHER = (0.5, 0.5, 0.9)
#: Share of an ordinary word's letters that hexadecimal has, at most; words of such letters alone are the rarer the longer they are.
HEX_SHARE = 0.4
#: Share of false discoveries allowed among the strings found, per band of length.
FALSE_DISCOVERIES = 0.001
#: Bands of length begin here.
BANDS = (20, 32, 48, 96)
#: p-values are counted in steps of 1/20 of a power of ten, so that any corpus gives at most this many counts a band.
STEP, STEPS = 20, 1200


def _word_shares() -> dict[str, float]:
    lower = 1 - CAPITAL - DIGIT - 4 * SIGN
    shares = {c: lower * f / 100 for c, f in LETTERS.items()}
    shares |= {c.upper(): CAPITAL * f / 100 for c, f in LETTERS.items()}
    shares |= dict.fromkeys(DIGITS, DIGIT / 10)
    shares |= dict.fromkeys("+/-_", SIGN)
    total = sum(shares.values())
    return {c: s / total for c, s in shares.items()}


SHARES = _word_shares()


def _moments(symbols: str) -> dict[str, float]:
    """Of a symbol of ordinary strings over ``symbols``: the chances that two and that three are equal, that it is in the lower half, and its place's mean and variance, from the middle."""
    total = sum(SHARES[c] for c in symbols)
    p = [SHARES[c] / total for c in symbols]
    middle = (len(p) - 1) / 2
    mean = sum(x * (i - middle) for i, x in enumerate(p))
    return {"k": float(len(p)), "two": sum(x**2 for x in p), "three": sum(x**3 for x in p), "low": sum(p[: len(p) // 2]), "mean": mean, "variance": sum(x * (i - middle - mean) ** 2 for i, x in enumerate(p))}


MOMENTS = [_moments(symbols) for _, _, symbols in ALPHABETS]


SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _spans(text: Column, pattern: str, kind: int, least: tuple[int, int] | None = None) -> Column:
    """Matches of ``pattern``, leftmost and non-overlapping, as structs (start, kind, end, value) in code points.

    The text between matches comes from a split by the same pattern, so that the
    running lengths give the places.  ``least`` is a group and its least length.
    """
    group = least[0] if least else 0
    parts = F.struct(F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("inner"))

    def placed(x: Column) -> Column:
        sizes = F.transform(x["found"], lambda m, i: F.struct(F.char_length(F.get(x["gaps"], i)).alias("gap"), F.char_length(m).alias("size"), F.get(x["inner"], i).alias("value")))
        span = lambda at, m: F.struct((at + m["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + m["gap"] + m["size"]).alias("end"), m["value"].alias("value"))
        return scan(sizes, F.lit(0), lambda at, m: at + m["gap"] + m["size"], span, SPAN)

    walked = let(parts, placed)
    kept = F.filter(walked, lambda s: F.char_length(s["value"]) >= least[1]) if least else walked
    return F.when(F.rlike(text, F.lit(pattern)), kept).otherwise(F.array().cast(f"array<{SPAN}>"))


def _tail(z: Column) -> Column:
    """The two-sided tail of the standard normal beyond ``z``, by the asymptotic bound 2 phi(z) / (z + sqrt(z^2 + 8 / pi)) x 2, within 1 % of it."""
    a = F.abs(z)
    return F.least(F.lit(1.0), F.lit(4 / math.sqrt(2 * math.pi)) * F.exp(-a * a / 2) / (a + F.sqrt(a * a + 8 / math.pi)))


def _power(z: Column) -> Column:
    """The negative power of ten of the upper tail of the standard normal beyond ``z``, without underflow; 0 up to the middle."""
    return F.when(z <= 0, 0.0).otherwise((z * z / 2 + F.log((z + F.sqrt(z * z + 8 / math.pi)) / 2) + math.log(math.sqrt(2 * math.pi) / 1)) / math.log(10))


def _battery(value: Column) -> Column:
    """A struct (encoding, uniform, ordinary): the battery's least p-value, corrected, and the p-value against an ordinary string, as its negative power of ten."""
    which = F.lit(len(ALPHABETS) - 1)
    for i, (_, pattern, _) in reversed(list(enumerate(ALPHABETS[:-1]))):
        which = F.when(value.rlike(pattern), i).otherwise(which)
    # where signs of both base 64 alphabets occur, they stand for each other
    body = F.regexp_replace(value, "=", "")
    both = lambda w: F.when(w == len(ALPHABETS) - 1, F.translate(body, "-_", "+/")).otherwise(body)
    return let(which, lambda w: let(F.struct(w.alias("w"), F.get(F.lit([a for _, _, a in ALPHABETS]), w).alias("alphabet"), both(w).alias("body")), _tested))


def _tested(x: Column) -> Column:
    """The battery's struct for ``x(w, alphabet, body)``."""
    n, zero = F.char_length(x["body"]).cast("double"), F.lit(0.0)
    of = lambda name: F.get(F.lit([m[name] for m in MOMENTS]), x["w"])
    half, middle = F.floor(of("k") / 2).cast("int"), (of("k") - 1) / 2

    def step(acc: Column, code: Column) -> Column:
        first = acc["before"] < 0
        turned = F.when(first | ((acc["before"] < acc["half"]) == (code < acc["half"])), acc["turns"]).otherwise(acc["turns"] + 1)
        moved = F.when(first, acc["product"]).otherwise(acc["product"] + (acc["before"] - acc["middle"]) * (code - acc["middle"]))
        return F.struct(code.alias("before"), acc["half"].alias("half"), acc["middle"].alias("middle"), turned.alias("turns"), moved.alias("product"))

    def walked(symbols: Column) -> Column:
        counts = F.transform(F.array_distinct(symbols), lambda c: n - F.char_length(F.replace(x["body"], c, F.lit(""))))
        start = F.struct(F.lit(-1).alias("before"), half.alias("half"), middle.alias("middle"), zero.alias("turns"), zero.alias("product"))
        walk = F.aggregate(F.transform(symbols, lambda c: F.instr(x["alphabet"], c) - 1), start, step)
        return F.struct(F.aggregate(counts, zero, lambda acc, c: acc + c * c).alias("squares"), walk.alias("walk"))

    def judged(s: Column) -> Column:
        k, squares, turns, product = s["k"], s["squares"], s["turns"], s["product"]
        # against uniform symbols: counts, runs, neighbours
        chi = (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        runs = (turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        serial = product / ((k * k - 1) / 12 * F.sqrt(n - 1))
        uniform = F.least(F.lit(1.0), 3 * F.least(_tail(chi), _tail(runs), _tail(serial)))
        # against ordinary ones: scores towards randomness, and how far random strings lie
        pairs = n * (n - 1) / 2
        spread = 2 * F.sqrt(pairs * s["two"] * (1 - s["two"]) + n * (n - 1) * (n - 2) * (s["three"] - s["two"] * s["two"]))
        one = s["low"] * (1 - s["low"])
        spread_turns = F.sqrt((n - 1) * 2 * one * (1 - 2 * one) + 2 * (n - 2) * one * (1 - 4 * one))
        mean2, var = s["mean"] * s["mean"], s["variance"]
        spread_product = F.sqrt((n - 1) * ((var + mean2) * (var + mean2) - mean2 * mean2) + 2 * (n - 2) * mean2 * var)
        scores = ((n + 2 * pairs * s["two"] - squares) / spread, (turns - (n - 1) * 2 * one) / spread_turns, ((n - 1) * mean2 - product) / spread_product)
        far = [F.greatest(zero, f) for f in (2 * pairs * (s["two"] - 1 / k) / spread, (n - 1) * (0.5 - 2 * one) / spread_turns, (n - 1) * mean2 / spread_product)]
        a, b, c = far
        size = F.sqrt(a * a + b * b + c * c + 2 * (a * b * TOGETHER[0] + a * c * TOGETHER[1] + b * c * TOGETHER[2]))
        power = _power(F.try_divide(sum((f * z for f, z in zip(far, scores, strict=True)), zero), size)) + F.when(x["w"] < 2, n * -math.log10(HEX_SHARE)).otherwise(zero)
        return F.struct(F.get(F.lit([name for name, _, _ in ALPHABETS]), x["w"]).alias("encoding"), uniform.alias("uniform"), F.coalesce(power, zero).alias("ordinary"))

    def with_moments(s: Column) -> Column:
        return F.struct(s["squares"].alias("squares"), s["walk"]["turns"].alias("turns"), s["walk"]["product"].alias("product"), *(of(name).alias(name) for name in MOMENTS[0]))

    return let(F.split(x["body"], ""), lambda symbols: let(walked(symbols), lambda s: let(with_moments(s), judged)))


def base_spans(text: Column) -> Column:
    """The spans of the three base patterns in order of start, then kind."""
    return F.array_sort(F.concat(_spans(text, ASSIGN, 0, (2, ASSIGN_LEAST)), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def _touches(s: Column, starts: Column, ends: Column) -> Column:
    """Whether span ``s`` overlaps one of those that begin at ``starts``, in order; ``ends`` holds the greatest end so far.  By bisection."""
    steps = F.lit([1 << b for b in reversed(range(31))])
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when((step <= F.size(starts) - at) & (F.get(starts, at + step - 1) < s["end"]), at + step).otherwise(at))
    return let(place, lambda n: (n > 0) & (F.get(ends, n - 1) > s["start"]))


def candidate_spans(text: Column, base: Column) -> Column:
    """Other long strings of encoding characters, with the battery's results.  Strings of digits alone, of one case of letters alone, and those that touch a base span are none.  ``base`` is in order of start."""
    mixed = F.filter(_spans(text, CANDIDATE, 3), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    ends = lambda spans: scan(spans, F.lit(0), lambda top, b: F.greatest(top, b["end"]), lambda top, b: F.greatest(top, b["end"]), "int")
    apart = lambda found: let(F.struct(F.transform(base, lambda b: b["start"]).alias("starts"), ends(base).alias("ends")), lambda x: F.filter(found, lambda s: ~_touches(s, x["starts"], x["ends"])))
    free = let(mixed, lambda found: F.when((F.size(found) > 0) & (F.size(base) > 0), apart(found)).otherwise(found))
    return F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"), _battery(s["value"]).alias("test")))


def _band(s: Column) -> Column:
    length, band = s["end"] - s["start"], F.lit(0)
    for i, least in enumerate(BANDS[1:], 1):
        band = F.when(length >= least, i).otherwise(band)
    return band


def discovery_limits(candidates: DataFrame, column: str = "candidates") -> list[float]:
    """By band of length, the least power of ten that a discovery must reach: Benjamini-Hochberg over all strings of ``column`` that look random.

    p-values are rounded up to a step, so the limit is never too lax.  A band
    without discoveries gets infinity.
    """
    one = candidates.select(F.explode(column).alias("s"))
    step = F.least(F.floor(F.col("s.test.ordinary") * STEP), F.lit(STEPS)).cast("int")
    looks = F.col("s.test.uniform") >= UNIFORM_LEAST
    counts = one.groupBy(_band(F.col("s")).alias("band"), F.when(looks, step).otherwise(0).alias("step")).agg(F.count("*").alias("n")).collect()  # a bounded number of steps
    limits = []
    for band in range(len(BANDS)):
        by = {r["step"]: r["n"] for r in counts if r["band"] == band}
        total, so_far, limit = sum(by.values()), 0, math.inf
        for s in sorted(by, reverse=True):
            so_far += by[s]
            if s > 0 and 10 ** (-s / STEP) <= FALSE_DISCOVERIES * so_far / total:
                limit = s / STEP
        limits.append(limit)
    return limits


def discoveries(candidates: Column, limits: list[float]) -> Column:
    """Those of ``candidates`` that look random and reach the limit of their band."""
    bound = F.expr(f"array({','.join('double(' + repr(str(x)) + ')' for x in limits)})")
    kept = F.filter(candidates, lambda s: (s["test"]["uniform"] >= UNIFORM_LEAST) & (s["test"]["ordinary"] >= F.get(bound, _band(s))))
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def tested(docs: DataFrame, *keep: str) -> DataFrame:
    """``docs`` with columns ``base`` and ``candidates``; null texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    with_base = docs.select(*keep, text.alias("__text"), base_spans(text).alias("base"))
    return with_base.select(*keep, "base", candidate_spans(F.col("__text"), F.col("base")).alias("candidates"))


def shown(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    """The secrets of every document: counts by base kind, their digest, and all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = staged(tested(docs.select("doc_id", "text"), "doc_id"), "spans")
    limits = discovery_limits(found)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"),
        shown(F.array_sort(F.concat("base", discoveries(F.col("candidates"), limits)))).alias("spans"),
    )


REDACTED = "[SECRET]"


def redact(docs: DataFrame) -> DataFrame:
    """Pipeline stage: every span, overlapping ones as one, becomes ``[SECRET]``; n_chars follows.  Texts without secrets, null ones too, stay as they are, and so do all other columns, whatever their names."""
    calibrated = staged(tested(docs.select("text")).where(F.size("candidates") > 0).select("candidates"), "candidates")
    limits = discovery_limits(calibrated)
    text = F.coalesce(F.col("text"), F.lit(""))
    with_base = docs.select(F.struct(*docs.columns).alias("row"), text.alias("whole"), base_spans(text).alias("base"))
    found = F.array_sort(F.concat("base", discoveries(candidate_spans(F.col("whole"), F.col("base")), limits)))
    spanned = with_base.select("row", "whole", found.alias("spans"))

    def clean(chars: Column) -> Column:
        piece = lambda at, s: F.when(s["start"] >= at, F.concat(F.array_join(F.slice(chars, at + 1, s["start"] - at), ""), F.lit(REDACTED))).otherwise("")
        rest = lambda at: F.array_join(F.slice(chars, at + 1, F.greatest(F.size(chars) - at, F.lit(0))), "")
        end = F.aggregate("spans", F.lit(0), lambda at, s: F.greatest(at, s["end"]))
        return F.concat(F.array_join(scan(F.col("spans"), F.lit(0), lambda at, s: F.greatest(at, s["end"]), piece, "string"), ""), let(end, rest))

    has = F.size("spans") > 0
    done = spanned.select("row", has.alias("has"), F.when(has, let(F.regexp_extract_all("whole", F.lit("(?s)."), F.lit(0)), clean)).otherwise(F.col("row.text")).alias("cleaned"))
    out = {"text": F.col("cleaned")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("has"), F.char_length("cleaned").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return done.select(*(out.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
