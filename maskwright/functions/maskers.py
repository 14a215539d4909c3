"""Deterministic maskers as column expressions.

A masker maps a stripped value and its seed to a fake of the same kind.  Equal
originals get equal fakes in every table and column that uses the same masker,
seed and length, which keeps keys joinable.  Everything runs inside one
projection of the scan: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.errors import Code, MaskingError
from maskwright.functions.lengths import fit
from maskwright.functions.seeds import DEFAULT_SEED, seed_u32, strip

# Domains of masked addresses, and the alphabets of generic strings.
DOMAINS = ("example.com", "test.org", "demo.net", "sample.io", "fake.email", "masked.dev", "sanitized.app", "placeholder.co", "dummy.tech", "anon.site")
ALPHABETS = {
    "alphanumeric": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "alpha": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "numeric": "0123456789",
}
#: Our own pools for names and addresses.
FIRST = ("Ada", "Ben", "Cleo", "Dan", "Edda", "Finn", "Gala", "Hugo", "Iris", "Jonas", "Kira", "Leo", "Mina", "Nils", "Olga", "Paul", "Quinn", "Rosa", "Sven", "Tara", "Ugo", "Vera", "Wim", "Xenia", "Yann", "Zoe", "Anselm", "Beatrix", "Caspar", "Dorothea", "Emmerich", "Florentine")
LAST = ("Abel", "Boyd", "Cole", "Dorn", "Egan", "Falk", "Gray", "Hart", "Ives", "Jung", "Kern", "Lund", "Moss", "Nash", "Orth", "Penn", "Quast", "Reed", "Sand", "Todd", "Ulm", "Voss", "Ware", "Yates", "Zorn", "Ashworth", "Bellamy", "Castellan", "Dunmore", "Fairweather", "Goldsmith", "Hollander")
PREFIXES, SUFFIXES = ("Dr.", "Mr.", "Ms.", "Mx."), ("Jr.", "Sr.", "II", "III")
STREETS = ("Acorn Way", "Birch Lane", "Canal Street", "Dune Road", "Elder Close", "Fern Row", "Grove Avenue", "Heath Drive", "Inlet Quay", "Juniper Court")
CITIES = ("Ashby", "Brookfield", "Clayton", "Denholm", "Eastwick", "Farley", "Glenmore", "Hatton", "Ingleby", "Kelso")
STATES = ("AK", "CO", "DE", "HI", "IA", "KS", "ME", "NV", "OR", "UT")
# Words before and after names, as compared in lower case without full stops at the ends.
NAME_PREFIXES = ("dr", "mr", "ms", "mrs", "miss", "prof", "rev", "sir", "dame")
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v", "esq", "phd", "ph.d", "md", "m.d", "dds", "d.d.s")

#: The shortest column that a masker can fill.
LEAST = {"email": 6, "phone": 10, "ssn": 9, "name": 2, "generic": 1, "address": 10}
#: Declared lengths of MAX columns.
MAX_LENGTH = 10_000


def pick(pool: Sequence[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), (index % len(pool) + 1).cast("int"))


def div(a: Column, b: int) -> Column:
    """Whole quotient of non-negative numbers."""
    return F.call_function("div", a, F.lit(b))


def digits(value: Column, n: int) -> Column:
    return F.lpad(value.cast("string"), n, "0")


def mask_email(value: Column, s: Column, most: int, **_) -> Column:
    """``user_<8 hex>@domain``, else ``u_<6 hex>@domain``, else ``u_<6 hex>@y.co``, else ``x@y.co``, whichever fits first."""
    h, at = F.rpad(F.lower(F.hex(s)), 8, "0"), F.concat(F.lit("@"), pick(DOMAINS, s))
    long, short = F.concat(F.lit("user_"), h, at), F.concat(F.lit("u_"), F.left(h, F.lit(6)), at)
    tight = F.concat(F.lit("u_"), F.left(h, F.lit(6)), F.lit("@y.co"))
    rest = tight if most >= 13 else F.lit("x@y.co")
    return F.when(F.char_length(long) <= most, long).when(F.char_length(short) <= most, short).otherwise(rest)


def mask_phone(value: Column, s: Column, most: int, **_) -> Column:
    """A number of area 555, as ``(555) eee-ssss``, ``555-eee-ssss`` or digits alone, by length."""
    exchange, line = (div(s, 10_000) % 900 + 100).cast("string"), (s % 9_000 + 1_000).cast("string")
    if most >= 14:
        return F.concat(F.lit("(555) "), exchange, F.lit("-"), line)
    return F.concat_ws("-" if most >= 12 else "", F.lit("555"), exchange, line)


def mask_ssn(value: Column, s: Column, most: int, **_) -> Column:
    """A valid number (area 001-899 but 666, group 01-99, serial 0001-9999), dashed where 11 characters fit."""
    o = s % 898
    area = digits(F.when(o < 665, o + 1).otherwise(o + 2), 3)
    return F.concat_ws("-" if most >= 11 else "", area, digits(div(s, 898) % 99 + 1, 2), digits(div(s, 88_902) % 9_999 + 1, 4))


def mask_generic(value: Column, s: Column, most: int, character_class: str = "alphanumeric", **_) -> Column:
    """As many characters as the value has, ``most`` at most: the alphabet from the seed's place on, over and over."""
    if character_class not in ALPHABETS:
        raise MaskingError(f"no such character class: {character_class}", Code.MASKER_NOT_FOUND, action=f"use one of {', '.join(ALPHABETS)}")
    alphabet = ALPHABETS[character_class]
    n = F.least(F.char_length(value), F.lit(most))
    turns = (div(n, len(alphabet)) + 2).cast("int")
    return F.substring(F.repeat(F.lit(alphabet), turns), (s % len(alphabet) + 1).cast("int"), n.cast("int"))


def name_structure(value: Column) -> Column:
    """A struct of has_prefix, has_suffix, is_hyphenated and word_count."""
    ws = F.filter(F.split(strip(value), r"\s+"), lambda w: w != "")
    plain = lambda w: F.btrim(F.lower(w), F.lit("."))
    many = F.size(ws) > 1
    return F.struct(
        (many & F.coalesce(plain(F.try_element_at(ws, F.lit(1))).isin(*NAME_PREFIXES), F.lit(False))).alias("has_prefix"),
        (many & F.coalesce(plain(F.try_element_at(ws, F.lit(-1))).isin(*NAME_SUFFIXES), F.lit(False))).alias("has_suffix"),
        value.rlike("[A-Za-zÀ-ſ]+-[A-Za-zÀ-ſ]+").alias("is_hyphenated"),
        F.size(ws).alias("word_count"),
    )


def mask_name(value: Column, s: Column, most: int, **_) -> Column:
    """A name from the pools: full with the original's prefix, suffix and hyphen from 20 characters on, first and last from 10, first from 4, else initials."""
    nf, nl = len(FIRST), len(LAST)
    first, last = pick(FIRST, s), pick(LAST, div(s, nf))
    if most >= 20:
        st = name_structure(value)
        # one pick after another: the hyphenated name takes two more
        given = F.when(st["is_hyphenated"], F.concat(pick(FIRST, div(s, nf * nl)), F.lit("-"), pick(FIRST, div(s, nf * nl * nf)))).otherwise(first)
        full = F.concat(given, F.lit(" "), last)
        full = F.when(st["has_prefix"] & (F.char_length(full) + 4 <= most), F.concat(pick(PREFIXES, s), F.lit(" "), full)).otherwise(full)
        full = F.when(st["has_suffix"] & (F.char_length(full) + 4 <= most), F.concat(full, F.lit(" "), pick(SUFFIXES, s))).otherwise(full)
        return F.left(full, F.lit(most))
    tries = [(pick(FIRST, s + 7 * k), pick(LAST, div(s, nf) + 11 * k)) for k in range(6)]
    if most >= 10:
        names = [F.concat(a, F.lit(" "), b) for a, b in tries]
    elif most >= 4:
        names = [a for a, _ in tries]
    elif most == 3:
        return F.concat(F.left(first, F.lit(1)), F.left(last, F.lit(1)))
    else:
        return F.left(first, F.lit(1))
    return F.coalesce(*(F.when(F.char_length(x) <= most, x) for x in names), F.left(names[-1], F.lit(most)))


def mask_address(value: Column, s: Column, most: int, **_) -> Column:
    """House, street, city, state and code from the pools."""
    street = F.concat_ws(" ", (s % 9_900 + 100).cast("string"), pick(STREETS, div(s, 9_900)))
    place = F.concat_ws(" ", pick(STATES, div(s, 7)), digits(div(s, 97) % 90_000 + 10_000, 5))
    return F.left(F.concat_ws(", ", street, pick(CITIES, div(s, 99)), place), F.lit(most))


def mask_keep_ends(value: Column, s: Column, most: int, **_) -> Column:
    """First and last character kept, the middle from the alphabet; two characters or fewer are all replaced, nothing stays nothing."""
    n = F.char_length(value)
    inner = mask_generic(F.substring(value, F.lit(2), F.greatest(n - 2, F.lit(0))), s, most)
    whole = F.when(n <= 2, mask_generic(value, s, most)).otherwise(F.concat(F.left(value, F.lit(1)), inner, F.right(value, F.lit(1))))
    return F.left(whole, F.lit(most))


def mask_email_by_name(value: Column, s: Column, most: int, **_) -> Column:
    """A first name of the pools, a number of 100 to 9999 and a domain."""
    return F.left(F.concat(F.lower(pick(FIRST, s)), (div(s, len(FIRST)) % 9_900 + 100).cast("string"), F.lit("@"), pick(DOMAINS, div(s, 316_800))), F.lit(most))


def mask_phone_any_area(value: Column, s: Column, most: int, **_) -> Column:
    """``(aaa) eee-ssss`` of any area and exchange from 200 to 999."""
    area, exchange = (s % 800 + 200).cast("string"), (div(s, 800) % 800 + 200).cast("string")
    return F.left(F.concat(F.lit("("), area, F.lit(") "), exchange, F.lit("-"), (div(s, 77) % 9_000 + 1_000).cast("string")), F.lit(most))


def mask_ssn_any_area(value: Column, s: Column, most: int, **_) -> Column:
    """``aaa-gg-ssss`` without regard to which areas are given out."""
    return F.left(F.concat_ws("-", (s % 900 + 100).cast("string"), (div(s, 900) % 90 + 10).cast("string"), (div(s, 81_000) % 9_000 + 1_000).cast("string")), F.lit(most))


Masker = Callable[..., Column]
_registry: dict[str, Masker] = {"email": mask_email, "phone": mask_phone, "ssn": mask_ssn, "generic": mask_generic, "name": mask_name, "address": mask_address, "keep_ends": mask_keep_ends, "email_by_name": mask_email_by_name, "phone_any_area": mask_phone_any_area, "ssn_any_area": mask_ssn_any_area}


def register_masker(kind: str, masker: Masker) -> None:
    """Add a masker ``(value, seed, most, **params) -> Column``.  A Pandas UDF does where columns can't."""
    if not callable(masker):
        raise MaskingError(f"the masker of {kind} cannot be called", Code.MASKER_NOT_FOUND)
    _registry[kind.lower()] = masker


def registered_kinds() -> list[str]:
    return sorted(_registry)


@dataclass(frozen=True)
class MaskSpec:
    """How one column is masked: kind, declared length, and how its type counts and pads."""

    column: str
    kind: str
    most: int = 255
    seed: int = DEFAULT_SEED
    unicode: bool = True
    fixed: bool = False
    nullable: bool = True
    params: dict = field(default_factory=dict)
    output: str | None = None

    def __post_init__(self):
        if self.most == -1:
            object.__setattr__(self, "most", MAX_LENGTH)
        if self.kind.lower() not in _registry:
            raise MaskingError(f"no masker for {self.kind}", Code.MASKER_NOT_FOUND, action=f"use one of {', '.join(registered_kinds())}")
        if self.most < LEAST.get(self.kind.lower(), 1):
            raise MaskingError(f"{self.column} is too short for {self.kind}", Code.MASKING_LENGTH_EXCEEDED, most=self.most, least=LEAST[self.kind.lower()])


def masked(df: DataFrame, specs: Sequence[MaskSpec]) -> DataFrame:
    """``df`` with the columns of ``specs`` masked, in place or as their ``output``.

    Null stays null; in a column that is not nullable it ends the query with an
    error, as a value of white space alone does for a generic masker.  Each seed
    is computed once, in a projection of its own.
    """
    for s in specs:
        if s.column not in df.columns:
            raise MaskingError(f"no column {s.column}", Code.COLUMN_NOT_FOUND)
        if df.schema[s.column].dataType.typeName() not in ("string", "varchar", "char"):
            raise MaskingError(f"{s.column} is no text column", Code.MASKING_TYPE_MISMATCH)
    values = {f"__v{i}": strip(F.col(s.column)) for i, s in enumerate(specs)}
    seeds = {f"__s{i}": seed_u32(F.col(f"__v{i}"), s.seed) for i, s in enumerate(specs)}
    staged = df.withColumns(values).withColumns(seeds)
    out = {}
    for i, s in enumerate(specs):
        fake = _registry[s.kind.lower()](F.col(f"__v{i}"), F.col(f"__s{i}"), s.most, **s.params)
        if s.kind.lower() == "generic":
            fake = F.when(F.col(f"__v{i}") == "", F.raise_error(F.lit(f"{s.column}: nothing to mask in white space"))).otherwise(fake)
        fake = fit(fake, s.most, unicode=s.unicode, fixed=s.fixed)
        missing = F.lit(None).cast("string") if s.nullable else F.raise_error(F.lit(f"{s.column}: null in a column that is not nullable")).cast("string")
        out[s.output or s.column] = F.when(F.col(s.column).isNull(), missing).otherwise(fake)
    return staged.withColumns(out).drop(*values, *seeds)


def collisions(df: DataFrame, specs: Sequence[MaskSpec]) -> DataFrame:
    """Per column: distinct originals, distinct fakes, and how many fakes fewer, in one pass over the distinct pairs."""
    both = masked(df, [MaskSpec(s.column, s.kind, s.most, s.seed, s.unicode, s.fixed, s.nullable, s.params, f"__m_{s.column}") for s in specs])
    pairs = both.select(F.explode(F.array(*(F.struct(F.lit(s.column).alias("column_name"), F.col(s.column).alias("original"), F.col(f"__m_{s.column}").alias("fake")) for s in specs))).alias("x")).select("x.*").where("original is not null")
    one = pairs.groupBy("column_name").agg(F.countDistinct("original").alias("originals"), F.countDistinct("fake").alias("fakes"))
    return one.select("column_name", "originals", "fakes", (F.col("originals") - F.col("fakes")).alias("collisions"))
