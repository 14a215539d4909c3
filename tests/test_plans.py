import json

import pytest
from pyspark.sql import functions as F

from maskwright.errors import CircularDependencyError, Code, ConfigError, MappingError, RestoreError, SourceError, UpdateError
from maskwright.functions.maskers import MaskSpec, masked
from maskwright.operators import integrity, mapping, restore, sink
from maskwright.operators.configcheck import issues
from maskwright.operators.fkgraph import FkGraph, constraints, same_masker
from maskwright.plans.sanitize import restore_tables, sanitize
from maskwright.sources import config as cfg
from maskwright.sources import scan
from maskwright.sources.catalog import Catalog, ColumnInfo, ForeignKey, normal_name
from maskwright.streaming.masking import mask_stream, redaction_counts, start_masking

FK = ForeignKey("fk", "dbo.orders", ("who",), "dbo.people", ("id",))


def people(spark):
    return spark.createDataFrame([(1, "ann@real.org", "Ann Lee"), (2, None, "Bob Roe"), (3, "ann@real.org", "Cy Dee")], "id bigint, mail string, name string")


def setup(spark, tmp_path, **more):
    frames = {"dbo.people": people(spark), "dbo.orders": spark.createDataFrame([(1, 1, "note"), (2, 3, None)], "id bigint, who bigint, note string")}
    catalog = Catalog.of(frames, {"dbo.people": ("id",), "dbo.orders": ("id",)}, [FK])
    config = cfg.Config((cfg.PiiColumn("dbo", "people", "mail", "email"), cfg.PiiColumn("dbo", "people", "name", "name"), cfg.PiiColumn("dbo", "orders", "note", "generic")), **more)
    return frames, catalog, config, str(tmp_path / "out")


def test_round_trip(spark, tmp_path):
    frames, catalog, config, out = setup(spark, tmp_path)
    key = mapping.new_key()
    report = sanitize(spark, frames, config, catalog, out, key=key, operation_id="op1")
    assert report.successful and [t.table for t in report.tables] == ["dbo.people", "dbo.orders"] and report.integrity.status == "PASS"
    after = {r["id"]: r for r in spark.read.parquet(f"{out}/op1/tables/dbo.people").collect()}
    assert after[1]["mail"] == after[3]["mail"] != "ann@real.org" and after[2]["mail"] is None
    back = restore_tables(spark, out, "op1", catalog, key, str(tmp_path / "back"))
    assert back.successful and [t.table for t in back.tables] == ["dbo.orders", "dbo.people"]
    assert sorted(spark.read.parquet(str(tmp_path / "back/dbo.people")).collect()) == sorted(people(spark).collect())
    assert not mapping.is_key_valid("zz")
    again = sanitize(spark, frames, config, catalog, out, key=key, operation_id="op1")
    assert again.successful  # complete tables are taken as they are
    with pytest.raises(ConfigError):
        sanitize(spark, frames, cfg.Config(config.columns[:1]), catalog, out, key=key, operation_id="op1")


def test_partial_restore_and_wrong_key(spark, tmp_path):
    frames, catalog, config, out = setup(spark, tmp_path)
    sanitize(spark, frames, config, catalog, out, key=mapping.new_key(), operation_id="op")
    report = restore_tables(spark, out, "op", catalog, mapping.new_key(), str(tmp_path / "b"), tables=["people"])
    assert not report.successful and Code.RESTORE_INCOMPLETE.value in report.errors[0]
    with pytest.raises(MappingError):
        restore_tables(spark, out, "nope", catalog, mapping.new_key(), str(tmp_path / "b"))


def test_dry_run_writes_nothing(spark, tmp_path):
    frames, catalog, config, out = setup(spark, tmp_path, dry_run=True)
    seen = []
    report = sanitize(spark, frames, config, catalog, out, progress=lambda t: seen.append(t.table))
    assert report.successful and not (tmp_path / "out").exists() and len(seen) == 2


def test_ambiguous_fakes_are_an_error_or_stay(spark):
    df = spark.createDataFrame([(i, f"value {i}") for i in range(300)], "id int, v string")
    key = mapping.new_key()
    entries = mapping.build_mapping(df, "t", [MaskSpec("v", "generic", 3)], "op", key)
    fake = masked(df, [MaskSpec("v", "generic", 3)])
    with pytest.raises(RestoreError):
        restore.restored(fake, entries, ["v"], key)
    assert restore.restored(fake, entries, ["v"], key, strict=False).count() == 300
    without = mapping.build_mapping(df.limit(1), "t", [MaskSpec("v", "email")], "op")
    with pytest.raises(RestoreError):
        restore.restored(masked(df.limit(1), [MaskSpec("v", "email")]), without, ["v"], key)


def test_mapping_store(spark, tmp_path):
    key = mapping.new_key()
    entries = mapping.build_mapping(people(spark), "dbo.people", [MaskSpec("mail", "email"), MaskSpec("name", "name", 40)], "op", key, "2024-01-01 00:00:00")
    mapping.store(entries, str(tmp_path / "m"))
    back = mapping.read_store(spark, str(tmp_path / "m"))
    assert back.count() == 5  # one mail, no mail, three names
    one = mapping.lookup(back, "op", "dbo", "people", "mail", "ann@real.org").collect()
    assert len(one) == 1 and back.where("is_null").count() == 1
    assert {r[0] for r in back.select(mapping.decrypted(F.col("original_value_encrypted"), key)).collect()} == {"ann@real.org", None, "Ann Lee", "Bob Roe", "Cy Dee"}
    assert mapping.stats(back).first()["encrypted"] == 4
    assert mapping.valid_identifier("a_1") and not mapping.valid_identifier("1a")
    with pytest.raises(MappingError):
        mapping.load_key("short")


def test_updates(spark, tmp_path):
    df = people(spark)
    out = sink.update_by_key(df, spark.createDataFrame([(2, "new"), (9, "none")], "id bigint, name string"), ["id"])
    assert {r["id"]: r["name"] for r in out.collect()} == {1: "Ann Lee", 2: "new", 3: "Cy Dee"}
    for bad in ({"key": []}, {"key": ["id"], "computed": ["name"]}):
        with pytest.raises(UpdateError):
            sink.update_by_key(df, spark.createDataFrame([(2, "new")], "id bigint, name string"), **bad)
    with pytest.raises(UpdateError):
        sink.update_by_key(df, spark.createDataFrame([(2, "new")], "id bigint, other string"), ["id"])
    path = str(tmp_path / "t")
    sink.staged_write(df, path)
    with pytest.raises(UpdateError):
        sink.staged_write(df, path)
    sink.staged_write(spark.read.parquet(path).limit(1), path, mode="overwrite")  # reads what it replaces
    assert sink.is_complete(spark, path) and spark.read.parquet(path).count() == 1


def test_updates_by_whole_rows(spark, tmp_path):
    """A repeated key takes one whole row, or is refused; null is a value."""
    df = spark.createDataFrame([(1, "a", "b"), (2, "c", "d"), (None, "n", "n")], "id bigint, x string, y string")
    two = spark.createDataFrame([(1, "z", "p", 1), (1, "c", "q", 2), (2, None, "r", 1), (None, "!", "!", 9)], "id bigint, x string, y string, at int")
    got = sorted(map(tuple, sink.update_by_key(df, two, ["id"], order="at").collect()), key=str)
    assert got == [(1, "c", "q"), (2, None, "r"), (None, "n", "n")]
    with pytest.raises(Exception, match="updates differ for key"):
        sink.update_by_key(df, two.drop("at"), ["id"]).collect()
    alike = spark.createDataFrame([(1, None, "q"), (1, None, "q")], "id bigint, x string, y string")
    assert (1, None, "q") in set(map(tuple, sink.update_by_key(df, alike, ["id"]).collect()))
    assert sink.update_by_key(df, alike.limit(0), ["id"]).count() == 3 and sink.update_by_key(df.limit(0), alike, ["id"]).count() == 0
    path = str(tmp_path / "t")
    sink.staged_write(df, path)
    assert sink.update_table(spark, path, alike.unionByName(alike.withColumn("id", F.lit(9))), ["id"]) == 1


def test_a_failed_table_does_not_end_the_run(spark, tmp_path):
    frames, catalog, config, out = setup(spark, tmp_path)
    bad = frames["dbo.people"].withColumn("name", F.when(F.col("id") == 2, F.raise_error(F.lit("cannot be read"))).otherwise(F.col("name")))
    report = sanitize(spark, {**frames, "dbo.people": bad}, config, catalog, out, key=mapping.new_key(), operation_id="op")
    by = {t.table: t.status for t in report.tables}
    assert by == {"dbo.people": "failed", "dbo.orders": "completed"} and not report.successful and len(report.errors) == 1
    assert not (tmp_path / "out/op/tables/dbo.people").exists()


def test_restore_is_verified_and_goes_on(spark, tmp_path):
    frames, catalog, config, out = setup(spark, tmp_path)
    key = mapping.new_key()
    sanitize(spark, frames, config, catalog, out, key=key, operation_id="op")
    other = frames["dbo.people"].withColumn("name", F.when(F.col("id") == 1, F.lit("Somebody")).otherwise(F.col("name")))
    report = restore_tables(spark, out, "op", catalog, key, str(tmp_path / "b"), verify={"dbo.people": other, "dbo.orders": frames["dbo.orders"]})
    assert report.successful and report.integrity.status == "FAIL"
    assert [(i["table_name"], i["column_name"], i["delta"]) for i in report.integrity.issues] == [("dbo.people", "name", 1)]


def test_orphans_of_the_run(spark, tmp_path):
    """A masked key column breaks its references, and the run's report says so."""
    frames = {"dbo.p": spark.createDataFrame([(1, "k1"), (2, "k2")], "id bigint, code string"), "dbo.c": spark.createDataFrame([(1, "k1")], "id bigint, code string")}
    catalog = Catalog.of(frames, {"dbo.p": ("id",), "dbo.c": ("id",)}, [ForeignKey("fk", "dbo.c", ("code",), "dbo.p", ("code",))])
    config = cfg.Config((cfg.PiiColumn("dbo", "p", "code", "generic"),), validate_after=True)
    report = sanitize(spark, frames, config, catalog, str(tmp_path / "o"), key=mapping.new_key(), operation_id="op")
    assert any(i["code"] == "FK_ORPHANS" for i in report.integrity.issues)


def test_pages_until_none_is_left(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(25)], "id bigint, v string")
    pages = [[r["id"] for r in p.collect()] for p in scan.extract_batches(df, ["id"], 10, ["v"])]
    assert pages == [list(range(10)), list(range(10, 20)), list(range(20, 25))]
    assert [r["id"] for p in scan.extract_batches(df, ["id"], 10, after=[21]) for r in p.collect()] == [22, 23, 24]
    assert list(scan.extract_batches(df.limit(0), ["id"], 10)) == []
    by_text = [r["v"] for p in scan.extract_batches(df, ["v"], 7) for r in p.collect()]
    assert by_text == sorted(by_text) and len(by_text) == 25


def test_counts_above_a_limit_are_estimates(spark, tmp_path):
    spark.range(20_000).write.parquet(str(tmp_path / "r"))
    spark.read.parquet(str(tmp_path / "r"))
    exact = integrity.counted("r", spark.range(5_000)).first()
    assert (exact["row_count"], exact["estimated"]) == (5_000, False)
    rough = integrity.counted("r", spark.range(200_000), limit=1000, fraction=0.1).first()
    assert rough["estimated"] and abs(rough["row_count"] - 200_000) < 10_000


def test_foreign_keys():
    rows = [{"constraint_name": "c", "parent_table": "p", "parent_column": f"k{i}", "child_table": "q", "child_column": f"f{i}", "ordinal_position": i} for i in (2, 1)]
    fk = constraints(rows)[0]
    assert fk.child_columns == ("f1", "f2") and FkGraph([fk], ["alone"]).order() == ["alone", "p", "q"]
    own = ForeignKey("s", "e", ("m",), "e", ("id",))
    assert FkGraph([own]).order() == ["e"] and FkGraph([own]).self_referencing == ["e"]
    circle = FkGraph([ForeignKey("1", "b", ("x",), "a", ("x",)), ForeignKey("2", "c", ("x",), "b", ("x",)), ForeignKey("3", "a", ("x",), "c", ("x",))])
    assert circle.cycles() == [["a", "b", "c"]] and circle.has_cycles()
    with pytest.raises(CircularDependencyError):
        circle.order()
    assert FkGraph([]).depth("none") == -1 and FkGraph([fk]).dependencies("q") == ["p"]
    assert same_masker([fk], {("p", "k1"): ("email",)}) == ["c: q.f1 and p.k1"]


def test_integrity(spark, tmp_path):
    df = people(spark)
    before = integrity.snapshot("people", df, ["mail"])
    gone = integrity.compared(before, before.limit(0))
    assert {r["code"] for r in gone.collect()} == {"TABLE_MISSING", "DATA_TYPE_CHANGED"}
    report = integrity.Report.of("op", integrity.compared(before, integrity.snapshot("people", df.withColumn("mail", F.lit(None).cast("string")), ["mail"])))
    assert report.status == "WARNING" and json.loads(report.to_json())["counts"]["warning"] == 1
    assert len(report.export(tmp_path)) == 2 and "<table>" in report.to_html()
    left = integrity.residual("people", df, ["mail", "name"]).collect()
    assert [(r["column_name"], r["severity"]) for r in left] == [("mail", "error")]
    fine = masked(df, [MaskSpec("mail", "email"), MaskSpec("name", "phone", 14)])
    assert integrity.residual("people", fine, ["mail", "name"]).isEmpty()
    composite = ForeignKey("c", "a", ("x", "y"), "b", ("x", "y"))
    a = spark.createDataFrame([(1, 1), (1, None), (2, 2)], "x int, y int")
    assert [tuple(r) for r in integrity.orphan_rows(a, a.where("x = 1"), composite).collect()] == [(2, 2)]
    with pytest.raises(Exception, match="percentages"):
        integrity.Limits(null_delta=101)


def test_configuration(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"database": {"batch_size": 500}, "pii_columns": [{"schema": "s", "table": "t", "column": "c", "pii_type": "Email"}]}))
    loaded = cfg.load(path, {"SANITIZATION_DATABASE_BATCH_SIZE": "1000", "SANITIZATION_MAPPING_ENCRYPTION_KEY": "secret", "OTHER": "1"})
    assert loaded.batch_size == 1000 and loaded.columns[0].kind == "email" and "mapping" not in loaded.options
    cfg.save(loaded, tmp_path / "d.json")
    assert cfg.load(tmp_path / "d.json", {}).columns == loaded.columns
    assert [cfg.coerce(x) for x in ("true", "1", "1.5", "no", "x")] == [True, 1, 1.5, False, "x"]
    with pytest.raises(ConfigError):
        cfg.Config((loaded.columns[0], loaded.columns[0]))
    with pytest.raises(ConfigError):
        cfg.load(tmp_path / "none.json", {})
    with pytest.raises(ConfigError):
        cfg.PiiColumn("s", "t", "c", "horoscope")
    a, b = loaded.columns[0], cfg.PiiColumn("s", "t", "d", "phone")
    assert cfg.apply_edits([a], [("add", b), ("modify", b.key, {"kind": "ssn"}), ("undo",), ("remove", a.key)]) == [b]
    assert cfg.merge_existing([a], [a, b]) == [a, b]


def test_configuration_against_catalog():
    t = ColumnInfo
    table = {"n": t("n", "NVARCHAR", -1), "v": t("v", "VARCHAR", 8), "d": t("d", "DATE")}
    catalog = Catalog([], [])
    catalog.tables["dbo.t"] = __import__("maskwright.sources.catalog", fromlist=["Table"]).Table("dbo.t", table, ("v", "d"))
    config = cfg.Config((cfg.PiiColumn("dbo", "t", "n", "email"), cfg.PiiColumn("dbo", "t", "v", "phone"), cfg.PiiColumn("dbo", "t", "d", "date_of_birth"), cfg.PiiColumn("sys", "#x", "d", "name")))
    found = [(i[1], i[3]) for i in issues(config, catalog)]
    assert ("MAX_LENGTH", "n") in found and ("TOO_SHORT", "v") in found and ("COMPOSITE_KEY", "v") in found and ("TEMPORARY_TABLE", "d") in found and ("SYSTEM_SCHEMA", "d") in found
    assert not any(i[0] == "error" and i[3] == "d" and i[2] == "dbo.t" for i in issues(config, catalog))
    assert normal_name("[a].[b]") == "a.b" and normal_name("b") == "dbo.b"
    with pytest.raises(SourceError):
        catalog.require_columns("t", ["nope"])


def test_scans(spark):
    df = people(spark)
    assert scan.paging_of(df, ["id"]) is scan.Paging.KEY and scan.paging_of(df, ["name"]) is scan.Paging.OFFSET and scan.paging_of(df, ["id", "name"]) is scan.Paging.COMPOSITE
    assert [r["id"] for r in scan.keyset_page(df, ["id"], None, 2).collect()] == [1, 2]
    assert scan.batch_numbers(df.limit(0), "id", 10).isEmpty() and scan.is_healthy(spark)
    sparse = spark.createDataFrame([(10**12,), (5,), (-3,), (None,)], "id bigint")
    assert sorted((r["id"], r["batch_number"]) for r in scan.batch_numbers(sparse, "id", 2).collect()) == [(-3, 1), (5, 1), (10**12, 2)]
    with pytest.raises(SourceError):
        scan.select_columns(df, ["id"], ["nope"])


def test_streams(spark, tmp_path):
    people(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(people(spark).schema).parquet(str(tmp_path / "in"))
    specs = [MaskSpec("mail", "email")]
    q = start_masking(stream, "dbo.people", specs, "op", mapping.new_key(), str(tmp_path / "out"), str(tmp_path / "map"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    want = sorted(map(str, masked(people(spark), specs).collect()))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).drop("batch").collect())) == want
    assert spark.read.parquet(str(tmp_path / "map")).count() == 2
    assert mask_stream(stream, specs).isStreaming
    events = spark.createDataFrame([("2024-01-01 00:05:00", "a@b.org"), ("2024-01-01 00:50:00", "c@d.org"), ("2024-01-01 02:00:00", "no")], "ts string, t string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "events"))
    counts = redaction_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), "ts", "t", ["email"])
    q = counts.writeStream.format("memory").queryName("found").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["kind"], r["findings"]) for r in spark.table("found").collect()] == [("email", 2)]
