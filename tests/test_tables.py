import csv
import datetime as dt
import random

from pyspark.sql import functions as F

from takeoff import schemas
from takeoff.operators import ordered, quality, training_set
from takeoff.sources import batches, files, tables


def ids(df, c="project_id"):
    return sorted(r[c] for r in df.collect())


def test_blank_rows_do_not_end_the_read(spark, tmp_path):
    path = tmp_path / "flat.csv"
    path.write_text("name,unit_price\nrow1,1000\n,\n,\nSENTINEL_LAST,2000\nbad,abc\n")
    df = files.read_flat(spark, str(path), schemas._schema("name string, unit_price double"))
    assert [(r.name, r.unit_price) for r in df.collect()] == [("row1", 1000.0), ("SENTINEL_LAST", 2000.0), ("bad", None)]


def test_export_round_trip_and_history(spark, tmp_path):
    df = spark.createDataFrame([("P1", "住宅", 1.5e8), ("P2", "办公", 3.6e8)], "project_id string, name string, total_cost double")
    for kind in ("csv", "parquet"):
        files.write_flat(df, str(tmp_path / kind), kind)
        assert sorted(files.read_flat(spark, str(tmp_path / kind), df.schema, kind).collect()) == sorted(df.collect())
    files.write_history(df.coalesce(1), str(tmp_path / "h"))
    assert sorted(files.read_history(spark, str(tmp_path / "h"), df.schema).collect()) == sorted(df.collect())
    (tmp_path / "array.json").write_text("[" + ",\n".join(df.toJSON().collect()) + "]")
    assert sorted(files.read_history(spark, str(tmp_path / "array.json"), df.schema, array=True).collect()) == sorted(df.collect())


def test_flat_cells_with_line_breaks_and_rows_without_a_name(spark, tmp_path):
    df = spark.createDataFrame([("a\n\"b\", c", 1.0), (None, 2.0), (None, None), ("d", None)], "name string, unit_price double").coalesce(1)
    files.write_flat(df, str(tmp_path / "x"))
    assert sorted(map(repr, files.read_flat(spark, str(tmp_path / "x"), df.schema).collect())) == sorted(map(repr, df.dropna("all").collect()))


def test_one_flat_file_is_read_by_many_tasks(spark, tmp_path):
    rng, want = random.Random(1), []
    for k, eol in enumerate(("\n", "\r\n")):
        with open(tmp_path / f"{k}.csv", "w", newline="") as f:
            w = csv.writer(f, lineterminator=eol)
            w.writerow(["a", "b"])
            for i in range(300):
                t = "".join(rng.choices(["x", ",", '"', "\n", "\r\n", "é", " y"], k=rng.randint(0, 30))).strip()
                w.writerow([t, i])
                want.append((t or None, float(i)))
    schema = schemas._schema("a string, b double")
    try:
        for size in ("128m", "2000", "300"):  # with 300 bytes a split, cells lie over several splits
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            df = files.read_flat(spark, str(tmp_path), schema)
            assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_bad_file_is_a_reason_and_read_files_are_known(spark, tmp_path):
    folder, where = tmp_path / "in", [str(tmp_path / x) for x in ("ledger", "out")]
    (folder / "sub").mkdir(parents=True)
    (folder / "a.json").write_text('[{"id": 1, "name": "甲"}, {"id": 2}]')
    (folder / "sub" / "b.json").write_text('[{"id": 3')
    (folder / "c.json").write_bytes(b'[{"id": 4, "name": "\xff\xfe"}]')
    (folder / "d.json").write_text("[]")
    (folder / "e.exe").write_text("[]")
    (folder / "f.json").write_text('[{"id": "no number", "name": "n"}]')
    schema = schemas.T.StructType.fromDDL("id bigint, name string")
    told = lambda df: {r["path"].rsplit("/", 1)[1]: (r["reason"], r["rows"]) for r in df.collect()}
    first = batches.load_batch(spark, str(folder), *where, schema)
    assert told(first) == {"a.json": (None, 2), "b.json": ("json", 0), "c.json": ("encoding", 0), "d.json": ("empty", 0), "e.exe": ("extension", 0), "f.json": (None, 1)}
    assert batches.load_batch(spark, str(folder), *where, schema).count() == 0
    (folder / "sub" / "b.json").write_text('[{"id": 3}]')
    assert told(batches.load_batch(spark, str(folder), *where, schema)) == {"b.json": (None, 1)}
    assert sorted(map(repr, spark.read.parquet(where[1]).collect())) == sorted(map(repr, spark.createDataFrame([(1, "甲"), (2, None), (3, None), (None, "n")], schema).collect()))


def test_flat_splits_are_worked_on_in_pieces(spark, tmp_path, monkeypatch):
    long = "\n".join(f'line {i}, "q"' for i in range(40))  # a cell over many pieces
    df = spark.createDataFrame([(long if i % 50 == 7 else f"a\n{i}" if i % 3 else f"b{i}", float(i)) for i in range(400)], "name string, unit_price double").coalesce(2)
    files.write_flat(df, str(tmp_path / "x"))
    want = sorted(df.collect())
    for bits in (0, 1, 4, files.PIECE_BITS):
        monkeypatch.setattr(files, "PIECE_BITS", bits)
        assert sorted(files.read_flat(spark, str(tmp_path / "x"), df.schema).collect()) == want


def test_large_flat_table_keeps_every_row(spark, tmp_path):
    df = spark.range(20000).select(F.format_string("proj%06d", "id").alias("name"), (1000 + F.col("id") % 50).cast("double").alias("unit_price"))
    files.write_flat(df, str(tmp_path / "big"))
    assert files.read_flat(spark, str(tmp_path / "big"), df.schema).count() == 20000


def test_tables_are_created_once_and_saved(spark, tmp_path):
    folder = str(tmp_path)
    assert sorted(tables.create_tables(spark, folder)) == sorted(schemas.TABLES)
    assert tables.create_tables(spark, folder) == []
    row = tables.conform_table(spark.createDataFrame([("P1", "a", "12.5")], "project_id string, name string, total_cost string"), "project_meta")
    tables.save(row, folder, "project_meta")
    got = tables.load(spark, folder, "project_meta").first()
    assert (got.total_cost, got.data_quality_grade, got.confidence, got.building_count, got.mixed_types) == (12.5, "C", 0.5, 1, False)
    tables.append(row, folder, "project_meta")
    assert tables.load(spark, folder, "project_meta").count() == 2


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("P1", "proj-1", 1), ("P2", "proj-2", 1)], "key string, name string, seq int")
    new = spark.createDataFrame([("P1", "proj-1-edit", 3), ("P1", "proj-1-draft", 2), ("P3", "proj-3", 1)], "key string, name string, seq int")
    once = tables.upsert(old, new, "key", F.desc("seq"))
    assert {r.key: r.name for r in once.collect()} == {"P1": "proj-1-edit", "P2": "proj-2", "P3": "proj-3"}
    assert sorted(tables.upsert(once, new, "key", F.desc("seq")).collect()) == sorted(once.collect())


def test_insert_missing_update_and_orphans(spark):
    have = spark.createDataFrame([(2020, 1.0)], "year int, v double")
    more = spark.createDataFrame([(2020, 9.0), (2021, 2.0)], "year int, v double")
    assert sorted(map(tuple, tables.insert_missing(have, more, "year").collect())) == [(2020, 1.0), (2021, 2.0)]
    upd = tables.update_where(more, F.col("v") > 5, {"v": F.lit(0.0)})
    assert sorted(map(tuple, upd.collect())) == [(2020, 0.0), (2021, 2.0)]
    child = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "id int, project_id string")
    parent = spark.createDataFrame([("a",)], "project_id string")
    assert ids(tables.orphans(child, parent, "project_id"), "id") == [2]
    assert ids(training_set.without_breakdown(child, parent), "id") == [2, 3]


def test_upload_lifecycle(spark):
    now = dt.datetime(2026, 1, 1, 12)
    rows = [("aaaa1111", now + dt.timedelta(hours=24)), ("bbbb2222", now - dt.timedelta(hours=2))]
    up = spark.createDataFrame(rows, "task_id string, expires_at timestamp")
    gone = tables.expired(up, F.lit(now), 200)
    assert ids(gone, "task_id") == ["bbbb2222"]
    assert ids(tables.keys_of(up, "task_id"), "task_id") == ["aaaa1111", "bbbb2222"]
    assert ids(tables.not_in(up, gone, "task_id"), "task_id") == ["aaaa1111"]
    stored = spark.createDataFrame([("aaaa1111.pdf",), ("cccc3333.pdf",), ("x.pdf",)], "file string")
    assert ids(tables.orphan_files(stored, F.col("file"), up), "task_id") == ["cccc3333"]


def test_snapshot_compare_and_evolution(spark):
    a = spark.createDataFrame([(1, "x")], "id int, t string")
    b = tables.add_columns(a, {"note": "string", "t": "string"})
    assert b.columns == ["id", "t", "note"] and tables.add_columns(b, {"note": "string"}).columns == b.columns
    diff = tables.compare_snapshots(tables.snapshot({"a": a, "same": a, "old": a}), tables.snapshot({"a": b, "same": a, "new": a}))
    assert {r.table_name: r.difference for r in diff.collect()} == {"a": "signature", "old": "removed", "new": "added"}
    assert tables.catalog(spark, {"a": a}).count() == 2


def test_numbering_is_dense_across_chunks(spark):
    df = spark.range(0, 1000, 7).select(F.col("id").alias("seq"))
    got = [r.n for r in ordered.number_rows(df, "seq", "n", chunk=50, start=11).orderBy("seq").collect()]
    assert got == list(range(11, 11 + df.count()))


def test_import_fixture(spark):
    rows = [("测试住宅", 12000.0, 5.4e7, 4500.0), ("测试办公", 8000.0, 4.96e7, 6200.0), ("异常项目", 0.0, 0.0, 300.0), ("缺失", None, None, None)]
    df = spark.createDataFrame(rows, "name string, area double, cost double, price double")
    args = (F.col("price"), F.col("area"), F.col("cost"))
    assert ids(quality.quality_gate(df, *args), "name") == sorted(["测试住宅", "测试办公", "缺失"])
    r = quality.drop_reasons(df, *args).first()
    assert (r.total, r.kept, r.dropped, r.bad_unit_price, r.bad_area, r.bad_cost) == (4, 3, 1, 1, 1, 1)
    assert quality.missing_fields(df, ["name", "area", "floors"]) == ["floors"]


def test_weights_and_sources(spark):
    df = spark.createDataFrame([("A", "high"), ("B", "medium"), ("C", "low"), ("A", "low"), (None, None)], "source_type string, data_confidence string")
    assert [r[0] for r in df.select(quality.sample_weight(df)).collect()] == [1.0, 0.7, 0.5, 0.7, 0.7]
    plain = spark.range(1)
    assert plain.select(quality.sample_weight(plain)).first()[0] == 0.3
    both = files.read_sources({"real_training": plain, "sample_training": plain.withColumn("_sample_weight", F.lit(0.9))})
    assert sorted((r._sample_weight, r.source_type) for r in both.collect()) == [(0.9, "B"), (1.0, "A")]


def test_admission(spark):
    df = spark.createDataFrame([("a.PDF", 1), ("b.exe", 1), ("c.xlsx", 60 * 1024 * 1024), (".pdf", 1)], "path string, size long")
    got = [r.rejected for r in files.admit_files(df, F.col("path"), F.col("size")).collect()]
    assert got == [None, "extension", "size", "extension"]
