"""Every operator of the engine as a query over the driver's tables, with the same in DuckDB's SQL.

The tables hold neither nulls nor orphans, so queries that need them make them
in the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import lengths, maskers, patterns
from maskwright.functions.maskers import MaskSpec, masked
from maskwright.functions.seeds import seed_u32
from maskwright.operators import configcheck, fkgraph, integrity, mapping, restore, sink
from maskwright.plans.sanitize import dry_run
from maskwright.sources import scan
from maskwright.sources.catalog import Catalog, ColumnInfo, ForeignKey
from maskwright.sources.config import Config, PiiColumn

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: A key for queries that decrypt what they encrypted; the store's real key comes from the environment.
QUERY_KEY = "00112233445566778899aabbccddeeff"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(items) -> str:
    return "[" + ", ".join(quoted(x) for x in items) + "]"


# --- maskers in SQL --------------------------------------------------------------


def sql_seed(value: str, seed: int = 42) -> str:
    text = f"CASE WHEN length({value}) > 10240 THEN substr({value}, 1, 1024) || '_len_' || length({value}) ELSE {value} END"
    return f"('0x' || substr(sha256('{seed}_' || {text}), 1, 8))::BIGINT"


def sql_pick(pool, index: str) -> str:
    return f"list_extract({names(pool)}, (({index}) % {len(pool)} + 1)::INTEGER)"


def sql_email(s: str, most: int) -> str:
    h = f"rpad(lower(hex({s})), 8, '0')"
    dom = sql_pick(maskers.DOMAINS, s)
    long, short = f"'user_' || {h} || '@' || {dom}", f"'u_' || left({h}, 6) || '@' || {dom}"
    rest = f"'u_' || left({h}, 6) || '@y.co'" if most >= 13 else "'x@y.co'"
    return f"CASE WHEN length({long}) <= {most} THEN {long} WHEN length({short}) <= {most} THEN {short} ELSE {rest} END"


def sql_phone(s: str, most: int) -> str:
    e, n = f"(({s}) // 10000 % 900 + 100)::VARCHAR", f"(({s}) % 9000 + 1000)::VARCHAR"
    if most >= 14:
        return f"'(555) ' || {e} || '-' || {n}"
    dash = "-" if most >= 12 else ""
    return f"'555{dash}' || {e} || '{dash}' || {n}"


def sql_ssn(s: str, most: int) -> str:
    dash = "-" if most >= 11 else ""
    area = f"lpad((CASE WHEN ({s}) % 898 < 665 THEN ({s}) % 898 + 1 ELSE ({s}) % 898 + 2 END)::VARCHAR, 3, '0')"
    return f"{area} || '{dash}' || lpad((({s}) // 898 % 99 + 1)::VARCHAR, 2, '0') || '{dash}' || lpad((({s}) // 88902 % 9999 + 1)::VARCHAR, 4, '0')"


def sql_generic(v: str, s: str, most: int, kind: str = "alphanumeric") -> str:
    a = maskers.ALPHABETS[kind]
    n = f"least(length({v}), {most})"
    return f"substr(repeat({quoted(a)}, ({n} // {len(a)} + 2)::INTEGER), (({s}) % {len(a)} + 1)::INTEGER, {n}::INTEGER)"


def one_mask(name: str, kind: str, most: int, table: str, key: str, column: str, sql: str, **params) -> None:
    @query(name, f"WITH t AS (SELECT {key}, {column}, {sql_seed(column)} AS s FROM {table}) SELECT {key}, {column}, {sql} AS masked FROM t")
    def run(spark, sf_dir):
        df = read(spark, sf_dir, table, key, column)
        return masked(df, [MaskSpec(column, kind, most, params=params, output="masked")])


CUSTOMER = ("customer", "c_custkey", "c_name")
for label, most in (("std", 255), ("compact", 24), ("short", 13), ("min", 6)):
    one_mask(f"mask_email_{label}", "email", most, *CUSTOMER, sql_email("s", most))
for most in (14, 12, 10):
    one_mask(f"mask_phone_{most}", "phone", most, *CUSTOMER, sql_phone("s", most))
for most in (11, 9):
    one_mask(f"mask_ssn_{most}", "ssn", most, *CUSTOMER, sql_ssn("s", most))
for kind, label in (("alphanumeric", "alnum"), ("alpha", "alpha"), ("numeric", "numeric")):
    one_mask(f"mask_generic_{label}", "generic", 12 if label == "alpha" else 255, "part", "p_partkey", "p_name", sql_generic("p_name", "s", 12 if label == "alpha" else 255, kind), character_class=kind)
one_mask("mask_keep_ends", "keep_ends", 255, "supplier", "s_suppkey", "s_name", f"left(s_name, 1) || {sql_generic('substr(s_name, 2, length(s_name) - 2)', 's', 255)} || right(s_name, 1)")


def _sql_name(most: int) -> str:
    nf, nl = len(maskers.FIRST), len(maskers.LAST)
    first, last = sql_pick(maskers.FIRST, "s"), sql_pick(maskers.LAST, f"s // {nf}")
    if most >= 20:
        return f"left({first} || ' ' || {last}, {most})"  # c_name has neither titles nor hyphens
    tries = [(sql_pick(maskers.FIRST, f"s + {7 * k}"), sql_pick(maskers.LAST, f"s // {nf} + {11 * k}")) for k in range(6)]
    whole = [f"{a} || ' ' || {b}" if most >= 10 else a for a, b in tries]
    del nl
    if most >= 4:
        return "coalesce(" + ", ".join(f"CASE WHEN length({x}) <= {most} THEN {x} END" for x in whole) + f", left({whole[-1]}, {most}))"
    return f"left({first}, 1) || left({last}, 1)" if most == 3 else f"left({first}, 1)"


for most in (40, 12, 5, 3, 2):
    one_mask(f"mask_name_{most}", "name", most, *CUSTOMER, _sql_name(most))

one_mask(
    "mask_address",
    "address",
    255,
    *CUSTOMER,
    f"(s % 9900 + 100)::VARCHAR || ' ' || {sql_pick(maskers.STREETS, 's // 9900')} || ', ' || {sql_pick(maskers.CITIES, 's // 99')} || ', ' || {sql_pick(maskers.STATES, 's // 7')} || ' ' || lpad((s // 97 % 90000 + 10000)::VARCHAR, 5, '0')",
)


@query("seed_long_value", f"SELECT doc_id, {sql_seed('text')} AS seed, length(text) > 10240 AS is_long FROM documents")
def seed_long_value(spark, sf_dir):
    df = read(spark, sf_dir, "documents", "doc_id", "text")
    return df.select("doc_id", seed_u32(F.col("text")).alias("seed"), (F.char_length("text") > 10240).alias("is_long"))


one_mask("mask_email_by_name", "email_by_name", 255, *CUSTOMER, f"lower({sql_pick(maskers.FIRST, 's')}) || (s // {len(maskers.FIRST)} % 9900 + 100)::VARCHAR || '@' || {sql_pick(maskers.DOMAINS, 's // 316800')}")
one_mask("mask_phone_any_area", "phone_any_area", 255, *CUSTOMER, "'(' || (s % 800 + 200)::VARCHAR || ') ' || (s // 800 % 800 + 200)::VARCHAR || '-' || (s // 77 % 9000 + 1000)::VARCHAR")
one_mask("mask_ssn_any_area", "ssn_any_area", 255, *CUSTOMER, "(s % 900 + 100)::VARCHAR || '-' || (s // 900 % 90 + 10)::VARCHAR || '-' || (s // 81000 % 9000 + 1000)::VARCHAR")

NAME_CASES = ("Dr. Jane Roe", "John Smith Jr.", "Mary-Jane Watson", "Prof. Ana Díaz-Ruiz Ph.D.", "Cher", "Sir  Ian   Holm")


@query(
    "name_structure",
    f"""WITH t AS (SELECT value, list_filter(regexp_split_to_array(value, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM (SELECT unnest({names(NAME_CASES)}) AS value UNION ALL SELECT c_name FROM customer))
    SELECT value, len(w) > 1 AND list_contains({names(maskers.NAME_PREFIXES)}, trim(lower(w[1]), '.')) AS has_prefix,
           len(w) > 1 AND list_contains({names(maskers.NAME_SUFFIXES)}, trim(lower(w[len(w)]), '.')) AS has_suffix,
           regexp_matches(value, '[A-Za-zÀ-ſ]+-[A-Za-zÀ-ſ]+') AS is_hyphenated, len(w)::INTEGER AS word_count FROM t""",
)
def name_structure(spark, sf_dir):
    cases = spark.createDataFrame([(n,) for n in NAME_CASES], "value string")
    own = read(spark, sf_dir, "customer", "c_name").select(F.col("c_name").alias("value"))
    return cases.unionByName(own).select("value", maskers.name_structure(F.col("value")).alias("x")).select("value", "x.*")


ORIGINALS = ("ann@example.com", "bad@", "x@[10.0.0.1]", "+1-555-111-2222", "12345", "987-65-4321", "123-45-6789", "123456789", "Ann O'Neil", "José Ñandú", "12 Main St")


@query(
    "format_validity",
    "WITH v AS (SELECT unnest("
    + names(ORIGINALS)
    + f") AS value UNION ALL SELECT {sql_email('s', 255)} FROM (SELECT {sql_seed('c_name')} AS s FROM customer) UNION ALL SELECT {sql_phone('s', 14)} FROM (SELECT {sql_seed('c_name')} AS s FROM customer) UNION ALL SELECT {sql_ssn('s', 11)} FROM (SELECT {sql_seed('c_name')} AS s FROM customer))"
    + f"""SELECT value, regexp_matches(value, {quoted(patterns.FORMATS['email'])}) OR regexp_matches(value, {quoted(patterns.FORMATS['email_ip'])}) AS is_email,
       regexp_matches(value, {quoted(patterns.FORMATS['phone_us'])}) OR regexp_matches(value, {quoted(patterns.FORMATS['phone_international'])}) OR length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 10 AND 15 AS is_phone,
       regexp_matches(value, {quoted(patterns.FORMATS['ssn'])}) AS is_ssn,
       CASE WHEN regexp_matches(value, '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$') THEN 'formatted' WHEN regexp_matches(value, '^[0-9]{{9}}$') THEN 'plain' ELSE 'unknown' END AS ssn_format,
       regexp_matches(value, {quoted(patterns.FORMATS['name'])}) AND NOT contains(value, '   ') AS is_name FROM v""",
)
def format_validity(spark, sf_dir):
    cases = spark.createDataFrame([(v,) for v in ORIGINALS], "value string")
    own = read(spark, sf_dir, "customer", "c_name")
    fakes = masked(own, [MaskSpec("c_name", k, m, output=k) for k, m in (("email", 255), ("phone", 14), ("ssn", 11))])
    values = cases.unionByName(fakes.select(F.explode(F.array("email", "phone", "ssn")).alias("value")))
    v = F.col("value")
    return values.select(v, *(patterns.valid_format(v, k).alias(f"is_{k}") for k in ("email", "phone", "ssn")), patterns.ssn_format(v).alias("ssn_format"), patterns.valid_format(v, "name").alias("is_name"))


@query("fit_length_char", "SELECT doc_id, left(text, 50) AS fitted FROM documents")
def fit_length_char(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", lengths.fit(F.col("text"), 50).alias("fitted"))


@query(
    "fit_length_byte",
    "SELECT doc_id, CASE WHEN strlen(text) <= 61 THEN text ELSE left(text, list_max(list_filter(range(0, 62), lambda i: strlen(left(text, i::INTEGER)) <= 61))::INTEGER) END AS fitted FROM documents",
)
def fit_length_byte(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", lengths.fit(F.col("text"), 61, unicode=False).alias("fitted"))


@query("fit_length_fixed", "SELECT s_suppkey, rpad(left(s_name, 30), 30, ' ') AS fitted FROM supplier")
def fit_length_fixed(spark, sf_dir):
    return read(spark, sf_dir, "supplier", "s_suppkey", "s_name").select("s_suppkey", lengths.fit(F.col("s_name"), 30, fixed=True).alias("fitted"))


# --- detection and redaction ------------------------------------------------------

SECRET_CASES = ("my ssn is 123-45-6789 ok", "iban DE89370400440532013000", "api_key: abcdefghijklmnop1234", "Bearer abc.def-123", "card 4111-1111-1111-1111", "call (555) 123-4567 or mail a.b@c.org", "from 10.0.0.1", "nothing here", "666-12-3456 is none")
TEXTS_SQL = f"(SELECT doc_id, text, lang, source FROM documents UNION ALL SELECT -row_number() OVER () AS doc_id, t AS text, 'xx' AS lang, 'case' AS source FROM (SELECT unnest({names(SECRET_CASES)}) AS t))"


def texts(spark, sf_dir) -> DataFrame:
    cases = spark.createDataFrame([(-i - 1, t, "xx", "case") for i, t in enumerate(SECRET_CASES)], "doc_id bigint, text string, lang string, source string")
    return read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source").unionByName(cases)


def sql_has(kind: str, column: str = "text") -> str:
    return f"regexp_matches({column}, {quoted(patterns.PATTERNS[kind])})"


@query("pii_scan_counts", f"SELECT lang, source, count(*)::BIGINT AS docs, {', '.join(f'count(*) FILTER ({sql_has(k)})::BIGINT AS n_{k}' for k in patterns.PATTERNS)} FROM {TEXTS_SQL} GROUP BY lang, source")
def pii_scan_counts(spark, sf_dir):
    hits = [F.count(F.when(patterns.has(F.col("text"), k), 1)).alias(f"n_{k}") for k in patterns.PATTERNS]
    return texts(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("docs"), *hits)


@query(
    "pii_scan_examples",
    "WITH h AS ("
    + " UNION ALL ".join(f"SELECT doc_id, {quoted(k)} AS kind, text FROM {TEXTS_SQL} WHERE {sql_has(k)}" for k in patterns.RESIDUAL)
    + ") SELECT 'documents' AS table_name, 'text' AS column_name, kind, left(text, 50) AS example FROM (SELECT *, row_number() OVER (ORDER BY doc_id, kind) AS r FROM h) WHERE r <= 10",
)
def pii_scan_examples(spark, sf_dir):
    return patterns.examples(texts(spark, sf_dir), "documents", ["text"], "doc_id")


def _sql_redact(column: str) -> str:
    for pattern, replacement in patterns.active_patterns().values():
        column = f"regexp_replace({column}, {quoted(pattern)}, {quoted(replacement)}, 'g')"
    return column


@query("pii_redact", f"SELECT doc_id, sha256({_sql_redact('text')}) AS redacted_sha256 FROM {TEXTS_SQL}")
def pii_redact(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.sha2(patterns.redact(F.col("text")), 256).alias("redacted_sha256"))


@query("pii_redact_nested", f"SELECT conv_id, list(struct_pack(turn := turn, said := {_sql_redact('text')}) ORDER BY turn)::VARCHAR AS turns FROM (SELECT conv_id, turn, text || ' 10.0.0.' || turn AS text FROM conversations) GROUP BY conv_id")
def pii_redact_nested(spark, sf_dir):
    df = read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    said = F.concat("text", F.lit(" 10.0.0."), F.col("turn").cast("string"))
    turns = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))).alias("turns"))
    clean = turns.select("conv_id", patterns.redact_nested(F.col("turns"), turns.schema["turns"].dataType).alias("turns"))
    return clean.select("conv_id", F.concat(F.lit("["), F.array_join(F.transform("turns", lambda t: F.concat(F.lit("{'turn': "), t["turn"].cast("string"), F.lit(", 'said': "), F.lit("\u0001"), t["said"], F.lit("\u0001}"))), ", "), F.lit("]")).alias("turns"))


ORACLES["pii_redact_nested"] = f"SELECT conv_id, '[' || string_agg('{{''turn'': ' || turn || ', ''said'': ' || chr(1) || {_sql_redact('text')} || chr(1) || '}}', ', ' ORDER BY turn) || ']' AS turns FROM (SELECT conv_id, turn, text || ' 10.0.0.' || turn AS text FROM conversations) GROUP BY conv_id"

WHITELIST = (r"mail[0-9]+\.example\.com",)


@query("pii_whitelist", f"SELECT doc_id, kind FROM (SELECT doc_id, text, unnest([{', '.join(f'CASE WHEN {sql_has(k)} THEN {quoted(k)} END' for k in patterns.RESIDUAL)}]) AS kind FROM {TEXTS_SQL}) WHERE kind IS NOT NULL AND NOT regexp_matches(text, '(?i)mail[0-9]+\\.example\\.com')")
def pii_whitelist(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.explode(patterns.found_kinds(F.col("text"), whitelist=WHITELIST)).alias("kind"))


_any = " OR ".join(sql_has(k, "{c}") for k in patterns.RESIDUAL)


@query("masking_effectiveness", " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(100 * (1 - avg(CASE WHEN {_any.replace('{c}', c)} THEN 1.0 ELSE 0.0 END)), 6)::DOUBLE AS effectiveness FROM documents" for c in ("text", "source")))
def masking_effectiveness(spark, sf_dir):
    return patterns.effectiveness(read(spark, sf_dir, "documents", "text", "source"), ["text", "source"]).select("column_name", F.round("effectiveness", 6).alias("effectiveness"))


# --- mapping and restoring -----------------------------------------------------------

CREATED = "2024-01-01 00:00:00"
NAMED = (("customer", "c_name", "c_custkey", "email"), ("supplier", "s_name", "s_suppkey", "phone"), ("part", "p_name", "p_partkey", "generic"))
_fake = {"email": sql_email("s", 255), "phone": sql_phone("s", 255), "generic": sql_generic("v", "s", 255)}
MAPPING_SQL = " UNION ALL ".join(
    f"SELECT 'op' AS operation_id, 'dbo' AS schema_name, '{t}' AS table_name, '{c}' AS column_name, sha256(coalesce(v, 'NULL')) AS original_hash, {_fake[k]} AS masked_value, v IS NULL AS is_null FROM (SELECT v, {sql_seed('v')} AS s FROM (SELECT DISTINCT CASE WHEN {key} % 7 = 0 THEN NULL ELSE {c} END AS v FROM {t}))"
    for t, c, key, k in NAMED
)


def named(spark, sf_dir, table: str, column: str, key: str) -> DataFrame:
    df = read(spark, sf_dir, table, key, column)
    return df.withColumn(column, F.when(F.col(key) % 7 != 0, F.col(column)))


def all_mappings(spark, sf_dir) -> DataFrame:
    out = None
    for table, column, key, kind in NAMED:
        one = mapping.build_mapping(named(spark, sf_dir, table, column, key), f"dbo.{table}", [MaskSpec(column, kind)], "op", QUERY_KEY, CREATED)
        out = one if out is None else out.unionByName(one)
    return out


def shown(entries: DataFrame) -> DataFrame:
    return entries.select("operation_id", "schema_name", "table_name", "column_name", F.lower(F.hex("original_value_hash")).alias("original_hash"), "masked_value", "is_null")


@query("mapping_build", MAPPING_SQL)
def mapping_build(spark, sf_dir):
    return shown(all_mappings(spark, sf_dir))


@query("mapping_stats", f"SELECT operation_id, count(*)::BIGINT AS entries, count(DISTINCT table_name)::BIGINT AS tables, count(DISTINCT table_name || column_name)::BIGINT AS columns, count(*)::DOUBLE / count(DISTINCT table_name) AS per_table, count(*)::DOUBLE / count(DISTINCT table_name || column_name) AS per_column, 0.0::DOUBLE AS seconds, count(*) FILTER (NOT is_null)::BIGINT AS encrypted FROM ({MAPPING_SQL}) GROUP BY operation_id")
def mapping_stats(spark, sf_dir):
    return mapping.stats(all_mappings(spark, sf_dir)).drop("started_at", "completed_at")


@query("mapping_table_info", f"SELECT schema_name, table_name, column_name, count(*)::BIGINT AS entries, count(DISTINCT original_hash)::BIGINT AS originals, count(*) FILTER (NOT is_null)::BIGINT AS encrypted, count(*) FILTER (is_null)::BIGINT AS nulls FROM ({MAPPING_SQL}) GROUP BY ALL")
def mapping_table_info(spark, sf_dir):
    return mapping.table_info(all_mappings(spark, sf_dir)).drop("latest")


@query("mapping_broken_entries", f"SELECT table_name, rule, count(*)::BIGINT AS entries FROM (SELECT table_name, CASE WHEN table_name = 'part' THEN 'NO_OPERATION' WHEN NOT is_null AND masked_value < 'M' THEN 'NO_FAKE' END AS rule FROM ({MAPPING_SQL})) WHERE rule IS NOT NULL GROUP BY ALL")
def mapping_broken_entries(spark, sf_dir):
    spoilt = all_mappings(spark, sf_dir).withColumn("operation_id", F.when(F.col("table_name") != "part", F.col("operation_id"))).withColumn("masked_value", F.when(F.col("masked_value") >= "M", F.col("masked_value")))
    return mapping.broken_entries(spoilt).groupBy("table_name", "rule").agg(F.count("*").alias("entries"))


@query("mapping_lookup", f"SELECT * FROM ({MAPPING_SQL}) WHERE table_name = 'customer' AND original_hash = sha256('Customer#000000001')")
def mapping_lookup(spark, sf_dir):
    return shown(mapping.lookup(all_mappings(spark, sf_dir), "op", "dbo", "customer", "c_name", "Customer#000000001"))


@query("restore_roundtrip", "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS c_name FROM customer")
def restore_roundtrip(spark, sf_dir):
    df = named(spark, sf_dir, "customer", "c_name", "c_custkey")
    specs = [MaskSpec("c_name", "email")]
    entries = mapping.build_mapping(df, "dbo.customer", specs, "op", QUERY_KEY, CREATED)
    return restore.restored(masked(df, specs), entries, ["c_name"], QUERY_KEY, marks=mapping.row_marks(df, specs, ["c_custkey"]))


@query("restore_partial", "SELECT c_name AS value, count(*)::BIGINT AS rows FROM customer WHERE c_custkey % 3 = 0 GROUP BY c_name")
def restore_partial(spark, sf_dir):
    """A mapping that lacks two originals in three: only the third comes back, the others stay masked."""
    df = read(spark, sf_dir, "customer", "c_custkey", "c_name")
    specs = [MaskSpec("c_name", "email")]
    entries = mapping.build_mapping(df.where("c_custkey % 3 = 0"), "dbo.customer", specs, "op", QUERY_KEY, CREATED)
    back = restore.restored(masked(df, specs), entries, ["c_name"], QUERY_KEY, marks=mapping.row_marks(df, specs, ["c_custkey"]))
    return back.where(~F.contains("c_name", F.lit("@"))).groupBy(F.col("c_name").alias("value")).agg(F.count("*").alias("rows"))


@query("restore_rates", "SELECT 'c_name' AS column_name, count(*)::BIGINT AS n_values, count(*) FILTER (c_custkey % 3 = 0)::BIGINT AS restored, round(100.0 * count(*) FILTER (c_custkey % 3 = 0) / count(*), 4)::DOUBLE AS percent FROM customer")
def restore_rates(spark, sf_dir):
    df = read(spark, sf_dir, "customer", "c_custkey", "c_name")
    specs = [MaskSpec("c_name", "email")]
    entries = mapping.build_mapping(df.where("c_custkey % 3 = 0"), "dbo.customer", specs, "op", QUERY_KEY, CREATED)
    return restore.rates(masked(df, specs), entries, ["c_name"], QUERY_KEY, mapping.row_marks(df, specs, ["c_custkey"])).select("column_name", "n_values", "restored", F.round("percent", 4).alias("percent"))


@query("restore_ambiguous", f"SELECT 'c_name' AS column_name, m AS masked_value, count(*)::BIGINT AS originals FROM (SELECT {sql_generic('c_name', 's', 3)} AS m FROM (SELECT DISTINCT c_name, {sql_seed('c_name')} AS s FROM customer)) GROUP BY m HAVING count(*) > 1")
def restore_ambiguous(spark, sf_dir):
    df = read(spark, sf_dir, "customer", "c_custkey", "c_name")
    return restore.ambiguous(mapping.build_mapping(df, "dbo.customer", [MaskSpec("c_name", "generic", 3)], "op", QUERY_KEY, CREATED))


@query("restore_differences", "SELECT 's_name' AS column_name, count(*)::BIGINT AS differing FROM supplier UNION ALL SELECT 's_nationkey', 0::BIGINT")
def restore_differences(spark, sf_dir):
    df = read(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    return restore.differences(df, masked(df, [MaskSpec("s_name", "generic")]), ["s_suppkey"], ["s_name", "s_nationkey"])


@query("mask_collisions", " UNION ALL ".join(f"SELECT '{k}' AS kind, count(DISTINCT c_name)::BIGINT AS originals, count(DISTINCT m)::BIGINT AS fakes, (count(DISTINCT c_name) - count(DISTINCT m))::BIGINT AS collisions FROM (SELECT c_name, {e} AS m FROM (SELECT c_name, {sql_seed('c_name')} AS s FROM customer))" for k, e in (("phone", sql_phone("s", 14)), ("generic", sql_generic("c_name", "s", 3)))))
def mask_collisions(spark, sf_dir):
    df = read(spark, sf_dir, "customer", "c_name")
    out = [maskers.collisions(df, [MaskSpec("c_name", k, m)]).withColumn("column_name", F.lit(k)).withColumnRenamed("column_name", "kind") for k, m in (("phone", 14), ("generic", 3))]
    return out[0].unionByName(out[1])


@query("leak_check", "SELECT c_name AS value, count(*)::BIGINT AS n FROM customer WHERE c_custkey % 50 = 0 GROUP BY c_name")
def leak_check(spark, sf_dir):
    df = read(spark, sf_dir, "customer", "c_custkey", "c_name")
    specs = [MaskSpec("c_name", "email", output="fake")]
    half = masked(df, specs).withColumn("c_name", F.when(F.col("c_custkey") % 50 == 0, F.col("c_name")).otherwise(F.col("fake")))
    return integrity.leaks(half, "c_name", mapping.build_mapping(df, "dbo.customer", [MaskSpec("c_name", "email")], "op", QUERY_KEY, CREATED))


# --- integrity ------------------------------------------------------------------------

FKS = (
    ForeignKey("fk_nation_region", "nation", ("n_regionkey",), "region", ("r_regionkey",)),
    ForeignKey("fk_customer_nation", "customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    ForeignKey("fk_supplier_nation", "supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    ForeignKey("fk_orders_customer", "orders", ("o_custkey",), "customer", ("c_custkey",)),
    ForeignKey("fk_lineitem_orders", "lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    ForeignKey("fk_lineitem_part", "lineitem", ("l_partkey",), "part", ("p_partkey",)),
    ForeignKey("fk_lineitem_supplier", "lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
)
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
KEYS = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",)}


@query("fk_orphans_single", "SELECT 'fk_orders_customer' AS constraint_name, 'orders' AS child_table, 'customer' AS parent_table, count(*) FILTER (o_custkey % 11 <> 0 AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 7 <> 0))::BIGINT AS orphans, count(*) FILTER (o_custkey % 11 <> 0)::BIGINT AS keyed_rows FROM orders")
def fk_orphans_single(spark, sf_dir):
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").withColumn("o_custkey", F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey")))
    return integrity.orphan_counts({"orders": orders, "customer": read(spark, sf_dir, "customer", "c_custkey").where("c_custkey % 7 <> 0")}, [FKS[3]])


@query("fk_orphans_composite", "SELECT conv_id, turn FROM conversations a WHERE turn % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM conversations b WHERE a.conv_id = b.conv_id AND a.turn = b.turn AND b.conv_id % 3 <> 0)")
def fk_orphans_composite(spark, sf_dir):
    df = read(spark, sf_dir, "conversations", "conv_id", "turn")
    child = df.withColumn("t", F.when(F.col("turn") % 5 != 0, F.col("turn")))
    return integrity.orphan_rows(child, df.where("conv_id % 3 <> 0"), ForeignKey("fk_turns", "turns", ("conv_id", "t"), "conversations", ("conv_id", "turn"))).select("conv_id", "turn")


@query("fk_orphans_self", "WITH e AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey * 2 END AS manager FROM customer) SELECT id, manager FROM e WHERE manager IS NOT NULL AND manager NOT IN (SELECT id FROM e)")
def fk_orphans_self(spark, sf_dir):
    df = read(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey") * 2).alias("manager"))
    return integrity.orphan_rows(df, df, ForeignKey("fk_manager", "e", ("manager",), "e", ("id",)))


def _sql_snapshot(column: str, source: str) -> str:
    one = f"SELECT count(*) AS n, count(*) - count({column}) AS nulls, max(length(rtrim({column}))) AS l, max(strlen({column})) AS b FROM {source}"
    parts = (("NULL", "row_count", "n", "NULL"), (f"'{column}'", "null_count", "nulls", "NULL"), (f"'{column}'", "max_length", "l", "NULL"), (f"'{column}'", "max_bytes", "b", "NULL"), (f"'{column}'", "data_type", "NULL", "'string'"))
    return " UNION ALL ".join(f"SELECT 'customer' AS table_name, {c}::VARCHAR AS column_name, '{m}' AS metric, {v}::BIGINT AS value, {t}::VARCHAR AS text_value FROM ({one})" for c, m, v, t in parts)


@query("snapshot_metrics", _sql_snapshot("c_name", "(SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS c_name FROM customer)"))
def snapshot_metrics(spark, sf_dir):
    return integrity.snapshot("customer", named(spark, sf_dir, "customer", "c_name", "c_custkey"), ["c_name"])


@query(
    "snapshot_compare",
    """WITH a AS (SELECT count(*) AS n, count(*) - count(CASE WHEN c_custkey % 7 <> 0 THEN 1 END) AS nulls, max(length(c_name)) AS l FROM customer),
    b AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 5 = 0) AS nulls, 25 AS l FROM customer WHERE c_custkey > 3)
    SELECT 'error' AS severity, 'ROW_COUNT_MISMATCH' AS code, 'customer' AS table_name, '' AS column_name, 'row_count: ' || a.n || ' to ' || b.n AS message, (b.n - a.n)::BIGINT AS delta FROM a, b
    UNION ALL SELECT 'warning', 'NULL_COUNT_MISMATCH', 'customer', 'c_name', 'null_count: ' || a.nulls || ' to ' || b.nulls, (b.nulls - a.nulls)::BIGINT FROM a, b
    UNION ALL SELECT 'info', 'LENGTH_GREW', 'customer', 'c_name', 'max_length: ' || a.l || ' to ' || b.l, (b.l - a.l)::BIGINT FROM a, b""",
)
def snapshot_compare(spark, sf_dir):
    before = integrity.snapshot("customer", named(spark, sf_dir, "customer", "c_name", "c_custkey"), ["c_name"])
    after = read(spark, sf_dir, "customer", "c_custkey", "c_name").where("c_custkey > 3").withColumn("c_name", F.when(F.col("c_custkey") % 5 != 0, F.rpad("c_name", 25, "x")))
    return integrity.compared(before, integrity.snapshot("customer", after, ["c_name"]))


@query("orphan_compare", "SELECT 'error' AS severity, 'FK_ORPHANS' AS code, 'orders' AS table_name, '' AS column_name, 'fk_orders_customer orphans: 0 to ' || n AS message, n::BIGINT AS delta FROM (SELECT count(*) AS n FROM orders WHERE o_custkey % 7 = 0)")
def orphan_compare(spark, sf_dir):
    orders, customer = read(spark, sf_dir, "orders", "o_custkey"), read(spark, sf_dir, "customer", "c_custkey")
    counts = lambda parent: integrity.orphan_counts({"orders": orders, "customer": parent}, [FKS[3]])
    return integrity.compared_orphans(counts(customer), counts(customer.where("c_custkey % 7 <> 0")))


@query("residual_scan", f"SELECT 'error' AS severity, 'PII_PATTERN_DETECTED' AS code, 'documents' AS table_name, 'text' AS column_name, kind || ' pattern in ' || count(*) || ' values' AS message, count(*)::BIGINT AS delta FROM (SELECT unnest([{', '.join(f'CASE WHEN {sql_has(k)} THEN {quoted(k)} END' for k in patterns.RESIDUAL)}]) AS kind FROM documents WHERE NOT regexp_matches(text, {quoted('(?i)' + integrity.MASKED[0])}) AND NOT regexp_matches(text, {quoted('(?i)' + integrity.MASKED[1])})) WHERE kind IS NOT NULL GROUP BY kind")
def residual_scan(spark, sf_dir):
    return integrity.residual("documents", read(spark, sf_dir, "documents", "text"), ["text"])


#: Two snapshots of supplier whose differences are of all severities.
_changed = """WITH a AS (SELECT count(*) AS n, count(*) FILTER (s_suppkey % 7 = 0) AS nulls, max(length(s_name)) AS l FROM supplier), b AS (SELECT count(*) FILTER (s_suppkey > 3) AS n, count(*) FILTER (s_suppkey > 3 AND s_suppkey % 5 = 0) AS nulls, 30 AS l FROM supplier)"""


def changed_supplier(spark, sf_dir) -> DataFrame:
    df = read(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    after = df.where("s_suppkey > 3").withColumn("s_name", F.when(F.col("s_suppkey") % 5 != 0, F.rpad("s_name", 30, "x")))
    return integrity.compared(integrity.snapshot("supplier", named(spark, sf_dir, "supplier", "s_name", "s_suppkey"), ["s_name"]), integrity.snapshot("supplier", after, ["s_name"]))


@query("severity_summary", _changed + " SELECT (a.n <> b.n)::BIGINT AS error, (a.nulls <> b.nulls)::BIGINT AS warning, (b.l > a.l)::BIGINT AS info FROM a, b")
def severity_summary(spark, sf_dir):
    return integrity.severity_summary(changed_supplier(spark, sf_dir))


@query("issues_by_column", _changed + " SELECT '' AS column_name, 'ROW_COUNT_MISMATCH' AS code, count(*)::BIGINT AS issues FROM a, b WHERE a.n <> b.n HAVING count(*) > 0 UNION ALL SELECT 's_name', 'NULL_COUNT_MISMATCH', count(*)::BIGINT FROM a, b WHERE a.nulls <> b.nulls HAVING count(*) > 0 UNION ALL SELECT 's_name', 'LENGTH_GREW', count(*)::BIGINT FROM a, b WHERE b.l > a.l HAVING count(*) > 0")
def issues_by_column(spark, sf_dir):
    return integrity.issues_by(changed_supplier(spark, sf_dir), "column_name", "code").select("column_name", "code", "issues")


@query("null_delta", "SELECT column_name, post - pre AS delta, round(100.0 * abs(post - pre) / pre, 6)::DOUBLE AS percent FROM (SELECT 'c_name' AS column_name, count(*) FILTER (c_custkey % 7 = 0)::BIGINT AS pre, count(*) FILTER (c_custkey % 5 = 0)::BIGINT AS post FROM customer)")
def null_delta(spark, sf_dir):
    before = integrity.snapshot("customer", named(spark, sf_dir, "customer", "c_name", "c_custkey"), ["c_name"])
    after = read(spark, sf_dir, "customer", "c_custkey", "c_name").withColumn("c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")))
    return integrity.null_deltas(before, integrity.snapshot("customer", after, ["c_name"])).select("column_name", "delta", F.round("percent", 6).alias("percent"))


@query("data_type_change", "SELECT 'error' AS severity, 'DATA_TYPE_CHANGED' AS code, 'customer' AS table_name, 'c_custkey' AS column_name, 'data_type: bigint to string' AS message, 0::BIGINT AS delta")
def data_type_change(spark, sf_dir):
    df = read(spark, sf_dir, "customer", "c_custkey")
    changed = integrity.compared(integrity.snapshot("customer", df, ["c_custkey"]), integrity.snapshot("customer", df.select(F.col("c_custkey").cast("string").alias("c_custkey")), ["c_custkey"]))
    return changed


@query("type_precision", "SELECT c_custkey, c_acctbal::DOUBLE AS c_acctbal FROM customer WHERE c_acctbal::DECIMAL(18,4) <> round(c_acctbal::DECIMAL(18,4), 1)")
def type_precision(spark, sf_dir):
    return integrity.precision_losses(read(spark, sf_dir, "customer", "c_custkey", "c_acctbal"), "c_acctbal", "decimal(18,1)").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))


@query("constraint_existence", "SELECT name AS constraint_name, there FROM (VALUES " + ", ".join(f"('{fk.name}', true)" for fk in FKS) + ", ('fk_gone', false), ('fk_no_column', false)) AS t(name, there)")
def constraint_existence(spark, sf_dir):
    frames = {t: read(spark, sf_dir, t) for t in TABLES}
    wanted = (*FKS, ForeignKey("fk_gone", "gone", ("x",), "region", ("r_regionkey",)), ForeignKey("fk_no_column", "nation", ("nope",), "region", ("r_regionkey",)))
    return integrity.constraints_there(spark, frames, wanted)


@query("length_preservation", "SELECT max(length(rtrim(p_name)))::BIGINT AS max_length, max(strlen(p_name))::BIGINT AS max_bytes, 55 AS declared FROM part")
def length_preservation(spark, sf_dir):
    s = integrity.snapshot("part", read(spark, sf_dir, "part", "p_name"), ["p_name"])
    take = lambda m: F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m)
    return s.agg(take("max_length"), take("max_bytes")).withColumn("declared", F.lit(55))


# --- scans and updates ------------------------------------------------------------------


@query("row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*)::BIGINT AS row_count FROM {t}" for t in TABLES))
def row_counts(spark, sf_dir):
    return scan.row_counts({t: read(spark, sf_dir, t) for t in TABLES})


@query("keyset_page", "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 100 ORDER BY c_custkey LIMIT 25")
def keyset_page(spark, sf_dir):
    return scan.keyset_page(read(spark, sf_dir, "customer"), ["c_custkey"], [100], 25, ["c_name"])


@query("composite_keyset_page", "SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) > (3, 1) ORDER BY conv_id, turn LIMIT 25")
def composite_keyset_page(spark, sf_dir):
    return scan.keyset_page(read(spark, sf_dir, "conversations"), ["conv_id", "turn"], [3, 1], 25, ["role"])


@query("offset_page", "SELECT n_name, n_regionkey, n_nationkey FROM nation ORDER BY n_name, n_nationkey OFFSET 10 LIMIT 7")
def offset_page(spark, sf_dir):
    return scan.offset_page(read(spark, sf_dir, "nation", "n_name", "n_regionkey", "n_nationkey"), ["n_name", "n_nationkey"], 10, 7)


@query("batch_numbers", "SELECT o_orderkey, ((r - 1) // 1000 + 1)::BIGINT AS batch_number, round(100.0 * least(((r - 1) // 1000 + 1) * 1000, n) / n, 2)::DOUBLE AS progress FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS n FROM orders)")
def batch_numbers(spark, sf_dir):
    return scan.batch_numbers(read(spark, sf_dir, "orders", "o_orderkey"), "o_orderkey", 1000)


@query("sample_deterministic", "SELECT c_custkey, c_name FROM customer ORDER BY sha256(c_custkey::VARCHAR) LIMIT 20")
def sample_deterministic(spark, sf_dir):
    return scan.sample_rows(read(spark, sf_dir, "customer", "c_custkey", "c_name"), ["c_name"], 20, by="c_custkey")


@query("update_by_key", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'new ' || s_suppkey ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier")
def update_by_key(spark, sf_dir):
    target = read(spark, sf_dir, "supplier")
    updates = target.where("s_suppkey % 3 = 0").select("s_suppkey", F.concat(F.lit("new "), F.col("s_suppkey").cast("string")).alias("s_name"))
    return sink.update_by_key(target, updates, ["s_suppkey"])


@query("update_composite_key", "SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'opening' ELSE role END AS role FROM conversations")
def update_composite_key(spark, sf_dir):
    target = read(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    return sink.update_by_key(target, target.where("turn = 0").select("conv_id", "turn", F.lit("opening").alias("role")), ["conv_id", "turn"])


@query("update_to_null", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_name END AS s_name, CASE WHEN s_suppkey % 4 = 0 THEN (s_suppkey % 25)::INTEGER ELSE s_nationkey END AS s_nationkey FROM supplier")
def update_to_null(spark, sf_dir):
    target = read(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    kind = target.schema["s_nationkey"].dataType
    updates = target.where("s_suppkey % 4 = 0").select("s_suppkey", F.lit(None).cast("string").alias("s_name"), (F.col("s_suppkey") % 25).cast(kind).alias("s_nationkey"))
    return sink.update_by_key(target, updates, ["s_suppkey"])


@query("update_repeated_key", "SELECT c_custkey, coalesce(k, c_name) AS c_name, coalesce(p, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, arg_max('order ' || o_orderkey, o_orderkey) AS k, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def update_repeated_key(spark, sf_dir):
    """Each customer takes the values of its last order, as one row."""
    updates = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("c_name"), F.col("o_orderpriority").alias("c_mktsegment"), "o_orderkey")
    return sink.update_by_key(read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment"), updates, ["c_custkey"], order="o_orderkey")


@query("update_text_key", "SELECT p_partkey, p_name, CASE WHEN p_name IN (SELECT min(p_name) FROM part) THEN 'changed' ELSE p_brand END AS p_brand FROM part")
def update_text_key(spark, sf_dir):
    target = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    return sink.update_by_key(target, target.agg(F.min("p_name").alias("p_name")).withColumn("p_brand", F.lit("changed")), ["p_name"])


@query("select_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def select_columns(spark, sf_dir):
    return scan.select_columns(read(spark, sf_dir, "orders"), ["o_orderkey"], ["o_custkey", "o_orderkey", "o_totalprice"])


@query("value_counts", "SELECT 'c_name' AS column_name, count(*)::BIGINT AS rows, count(*) FILTER (c_custkey % 7 <> 0)::BIGINT AS non_null FROM customer")
def value_counts(spark, sf_dir):
    return scan.value_counts(named(spark, sf_dir, "customer", "c_name", "c_custkey"), ["c_name"])


@query("parameterised_sql", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_orderkey > 10")
def parameterised_sql(spark, sf_dir):
    return scan.execute(spark, "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = :who AND o_orderkey > :least", {"who": 7, "least": 10}, {"orders": read(spark, sf_dir, "orders")})


@query("count_estimate", "SELECT 'orders' AS table_name, count(*)::BIGINT AS row_count, false AS estimated FROM orders")
def count_estimate(spark, sf_dir):
    return integrity.counted("orders", read(spark, sf_dir, "orders", "o_orderkey"))


@query("replace_values", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE n_regionkey::VARCHAR END AS label FROM nation")
def replace_values(spark, sf_dir):
    df = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("label"))
    return sink.replace_values(df, "label", spark.createDataFrame([("0", "first"), ("1", "second")], "original string, replacement string"))


# --- foreign keys, catalog, configuration ---------------------------------------------------

ORDER = ("part", "region", "nation", "customer", "orders", "supplier", "lineitem")
DEPTH = {"part": 0, "region": 0, "nation": 1, "customer": 2, "orders": 3, "supplier": 2, "lineitem": 3}


@query("fk_order", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', {DEPTH[t]})" for i, t in enumerate(ORDER)) + ") AS t(position, table_name, depth)")
def fk_order(spark, sf_dir):
    return fkgraph.FkGraph(FKS, TABLES).order_frame(spark)


@query("fk_depth", "WITH RECURSIVE e(p, c) AS (VALUES " + ", ".join(f"('{fk.parent}', '{fk.child}')" for fk in FKS) + "), w(root, t, d) AS (SELECT DISTINCT p, p, 0 FROM e WHERE p NOT IN (SELECT c FROM e) UNION SELECT root, e.c, d + 1 FROM w JOIN e ON w.t = e.p) SELECT t AS table_name, max(d)::INTEGER AS depth FROM (SELECT root, t, min(d) AS d FROM w GROUP BY root, t) GROUP BY t")
def fk_depth(spark, sf_dir):
    g = fkgraph.FkGraph(FKS)
    return spark.createDataFrame([(t, g.depth(t)) for t in g.nodes], "table_name string, depth int")


CIRCLE = (ForeignKey("a", "Products", ("CategoryID",), "Categories", ("CategoryID",)), ForeignKey("b", "Categories", ("SupplierID",), "Suppliers", ("SupplierID",)), ForeignKey("c", "Suppliers", ("ProductID",), "Products", ("ProductID",)), ForeignKey("d", "Employees", ("ManagerID",), "Employees", ("EmployeeID",)))


@query("fk_summary", "SELECT * FROM (VALUES ('tables', 4), ('edges', 3), ('self_referencing', 1), ('roots', 1), ('leaves', 1), ('max_depth', 0), ('cycles', 1)) AS t(measure, value)")
def fk_summary(spark, sf_dir):
    return fkgraph.FkGraph(CIRCLE).summary_frame(spark)


@query("fk_cycles", "SELECT 'Categories,Products,Suppliers' AS cycle")
def fk_cycles(spark, sf_dir):
    return spark.createDataFrame([(",".join(c),) for c in fkgraph.FkGraph(CIRCLE).cycles()], "cycle string")


def catalog_of(spark, sf_dir) -> Catalog:
    frames = {t: read(spark, sf_dir, t) for t in TABLES}
    declared = {"customer": {"c_name": ColumnInfo("c_name", "NVARCHAR", 40), "c_custkey": ColumnInfo("c_custkey", "BIGINT", nullable=False, identity=True)}, "supplier": {"s_name": ColumnInfo("s_name", "CHAR", 8, nullable=False)}}
    return Catalog.of(frames, KEYS, FKS, declared)


@query("catalog_keys", "SELECT * FROM (VALUES " + ", ".join(f"('dbo.{t}', '{k[0]}')" for t, k in KEYS.items()) + ") AS t(table_name, column_name)")
def catalog_keys(spark, sf_dir):
    return catalog_of(spark, sf_dir).columns_frame(spark).where("in_key").select("table_name", "column_name")


CONFIG = Config((PiiColumn("dbo", "customer", "c_name", "email"), PiiColumn("dbo", "supplier", "s_name", "ssn"), PiiColumn("dbo", "customer", "c_custkey", "generic", nullable=False), PiiColumn("dbo", "gone", "x", "name"), PiiColumn("dbo", "orders", "nope", "phone")))
_issues = (
    ("error", "TOO_SHORT", "dbo.supplier", "s_name"), ("error", "NULLABLE_MISMATCH", "dbo.supplier", "s_name"), ("warning", "FIXED_LENGTH", "dbo.supplier", "s_name"),
    ("error", "INCOMPATIBLE_TYPE", "dbo.customer", "c_custkey"), ("error", "IDENTITY_COLUMN", "dbo.customer", "c_custkey"), ("warning", "PRIMARY_KEY", "dbo.customer", "c_custkey"), ("warning", "REFERRED_TO", "dbo.customer", "c_custkey"),
    ("error", "TABLE_NOT_FOUND", "dbo.gone", "x"), ("error", "COLUMN_NOT_FOUND", "dbo.orders", "nope"),
)


@query("config_issues", "SELECT * FROM (VALUES " + ", ".join(str(i) for i in _issues) + ") AS t(severity, code, table_name, column_name)")
def config_issues(spark, sf_dir):
    return configcheck.issues_frame(spark, CONFIG, catalog_of(spark, sf_dir)).drop("message")


NAMES_OF_COLUMNS = {"EmailAddress": "email", "contact_phone": "phone", "FirstName": "name", "SSN": "ssn", "TaxID": "ssn", "ZipCode": "address", "City": "address", "CCNumber": "credit_card", "DOB": "date_of_birth", "c_name": "name", "EmailTemplateID": None, "PhoneTypeID": None, "CustomerID": None, "CreatedBy": None, "c_custkey": None, "StatusFlag": None}


@query("pii_column_classifier", "SELECT column_name, kind FROM (VALUES " + ", ".join(f"('{c}', '{k}')" for c, k in NAMES_OF_COLUMNS.items() if k) + ") AS t(column_name, kind)")
def pii_column_classifier(spark, sf_dir):
    columns = spark.createDataFrame([("t", c) for c in NAMES_OF_COLUMNS], "table_name string, column_name string")
    return configcheck.detected(columns).select("column_name", "kind")


@query("dry_run_preview", f"SELECT 'dbo.customer' AS table_name, 'c_name' AS column_name, c_name AS original, {sql_email('s', 40)} AS masked FROM (SELECT c_name, {sql_seed('c_name')} AS s FROM customer ORDER BY c_name LIMIT 3)")
def dry_run_preview(spark, sf_dir):
    frames = {f"dbo.{t}": read(spark, sf_dir, t) for t in ("customer",)}
    return dry_run(frames, Config((PiiColumn("dbo", "customer", "c_name", "email"),)), catalog_of(spark, sf_dir))


@query("sanitize_customer", f"WITH t AS (SELECT c_custkey, c_nationkey, {sql_seed('c_name')} AS s, c_name FROM customer) SELECT c_custkey, {sql_email('s', 255)} AS email, {sql_phone('s', 20)} AS phone, {sql_ssn('s', 11)} AS ssn, {sql_generic('c_name', 's', 50)} AS generic, c_nationkey FROM t")
def sanitize_customer(spark, sf_dir):
    """The flagship: four fakes of a name in one map-only stage."""
    df = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")
    out = masked(df, [MaskSpec("c_name", "email", 255, output="email"), MaskSpec("c_name", "phone", 20, output="phone"), MaskSpec("c_name", "ssn", 11, output="ssn"), MaskSpec("c_name", "generic", 50, output="generic")])
    return out.select("c_custkey", "email", "phone", "ssn", "generic", "c_nationkey")
