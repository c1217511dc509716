"""Maintenance, incremental refresh, parsing of landed files, reports."""

import bz2
import gzip
import hashlib
import io
import json
import tarfile
import zlib
from datetime import datetime, timedelta

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pavesa.operators import canonical, lookup, merge, quality, raster, series
from pavesa.plans import ingest_queries, reports
from pavesa.session import scratch_path
from pavesa.sources import cap, landing
from pavesa.streaming import feed, refresh

T0 = datetime(2025, 7, 1, 12)
RECORD = (
    "source_record_id bigint, cap_identifier string, language string, phenomenon_code string, area_code string, area_name string, source_download_id int,"
    " level_label string, temperature_max_c double, onset_at timestamp, expires_at timestamp, sent_at timestamp, source_file_path string, request_elaboration_to timestamp"
)


def record(i, cap_id, area, file, level, onset_h, hours):
    onset = T0 + timedelta(hours=onset_h)
    return (i, cap_id, "es-ES", "AT", area, area, file, level, 30.0 + i, onset, onset + timedelta(hours=hours), T0 + timedelta(minutes=i), f"f{file}", T0 + timedelta(days=file))


BATCHES = [
    [record(1, "c1", "Z1", 1, "Rojo", 0, 30), record(2, "c2", "Z1", 1, "Amarillo", 0, 80), record(3, "c3", "Z2", 1, "Verde", 5, 3)],
    [record(4, "c1", "Z1", 2, "Naranja", 48, 10), record(5, "c4", "Z2", 2, "Rojo", 0, 60)],
    [record(6, "c2", "Z1", 3, "Rojo", 200, 5), record(7, "c5", "Z3", 3, "Verde", -900, 3)],
]


def full_rebuild(spark, rows):
    df = spark.createDataFrame(rows, RECORD)
    downloads = df.select("source_download_id", "source_file_path", "request_elaboration_to").distinct()
    core = canonical.canonical_warnings(df.drop("source_file_path", "request_elaboration_to"), downloads)
    return core, canonical.daily_features(canonical.explode_days(core))


def keyed(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_incremental_equals_full_rebuild_and_replay_is_harmless(spark):
    job = refresh.WarningRefresh(spark, scratch_path(spark, "t-refresh"), 4)
    seen = []
    for i, batch in enumerate(BATCHES):
        seen += batch
        frame = spark.createDataFrame(batch, RECORD)
        job.apply(frame, i)
        core, pub = full_rebuild(spark, seen)
        assert keyed(job.table("core"), "cap_identifier", "area_code", "warning_id", "duplicate_source_count") == keyed(core, "cap_identifier", "area_code", "warning_id", "duplicate_source_count")
        assert keyed(job.table("pub"), "feature_id", "warning_id", "source_version_count") == keyed(pub, "feature_id", "warning_id", "source_version_count")
    before = keyed(job.table("pub"), "feature_id", "warning_id", "source_version_count")
    job.apply(spark.createDataFrame(BATCHES[-1], RECORD), 2)
    assert keyed(job.table("pub"), "feature_id", "warning_id", "source_version_count") == before


def assert_rebuilt(spark, job, seen):
    core, pub = full_rebuild(spark, seen)
    assert keyed(job.table("core"), "cap_identifier", "area_code", "warning_id", "duplicate_source_count") == keyed(core, "cap_identifier", "area_code", "warning_id", "duplicate_source_count")
    assert keyed(job.table("pub"), "feature_id", "warning_id", "source_version_count") == keyed(pub, "feature_id", "warning_id", "source_version_count")


def test_refresh_goes_on_in_another_process(spark):
    root, seen = scratch_path(spark, "t-restart"), []
    for i, batch in enumerate(BATCHES):
        seen += batch
        refresh.WarningRefresh(spark, root, 4).apply(spark.createDataFrame(batch, RECORD), i)
        assert_rebuilt(spark, refresh.WarningRefresh(spark, root, 4), seen)


def moved():
    """A warning alone in its month, then moved to another one."""
    return [record(1, "m1", "Z9", 1, "Rojo", 0, 5)], [record(2, "m1", "Z9", 2, "Rojo", 24 * 200, 5)]


def test_emptied_month_is_cleared(spark):
    first, second = moved()
    root = scratch_path(spark, "t-moved")
    for i, batch in enumerate((first, second)):
        refresh.WarningRefresh(spark, root, 2).apply(spark.createDataFrame(batch, RECORD), i)
    job = refresh.WarningRefresh(spark, root, 2)
    assert_rebuilt(spark, job, first + second)
    assert job.table("core_day").select("month").distinct().count() == job.table("pub").select("month").distinct().count() == 1


def test_failed_batch_is_replayed(spark, monkeypatch):
    first, second = moved()
    root = scratch_path(spark, "t-failed")
    refresh.WarningRefresh(spark, root, 2).apply(spark.createDataFrame(first, RECORD), 0)
    broken = refresh.WarningRefresh(spark, root, 2)
    monkeypatch.setattr(broken, "_refresh_days", lambda *a: 1 / 0)
    try:
        broken.apply(spark.createDataFrame(second, RECORD), 1)
    except ZeroDivisionError:
        pass
    job = refresh.WarningRefresh(spark, root, 2)
    job.apply(spark.createDataFrame(second, RECORD), 1)
    assert_rebuilt(spark, job, first + second)


def test_refresh_reads_touched_partitions(spark):
    job = refresh.WarningRefresh(spark, scratch_path(spark, "t-prune"), 8)
    job.apply(spark.createDataFrame(BATCHES[0], RECORD), 0)
    plan = spark._jvm.PythonSQLUtils.explainString(job.table("core").filter(F.col("bucket").isin([1]))._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(", "").replace("(", "")


def test_batches_write_each_table_once(spark, monkeypatch):
    """Only the keys, versions and dates of a batch are stored aside. Days are the same, come they from core or from the old days."""
    staged, real = [], refresh.WarningRefresh._stage
    monkeypatch.setattr(refresh.WarningRefresh, "_stage", lambda self, rows, label: staged.append(label) or real(self, rows, label))
    days = []
    for buckets in (1, 64):  # all buckets are touched by each batch, or few
        job = refresh.WarningRefresh(spark, scratch_path(spark, "t-once"), buckets)
        for i, batch in enumerate([*BATCHES, *moved()]):
            job.apply(spark.createDataFrame(batch, RECORD), i)
        assert_rebuilt(spark, job, [row for batch in [*BATCHES, *moved()] for row in batch])
        days.append(keyed(job.table("core_day"), "cap_identifier", "area_code", "valid_date", "warning_id", "month"))
        queued = keyed(job.table("queue").filter("batch = 4"), "cap_identifier", "valid_date")
        assert [str(d) for _, d in queued] == ["2025-07-01", "2026-01-17"]  # of the version replaced and of the new one
    assert days[0] == days[1] and len(days[0]) > 8
    assert set(staged) == {"due", "fresh", "dates"}


def test_failed_write_leaves_the_table(spark):
    job = refresh.WarningRefresh(spark, scratch_path(spark, "t-kept"), 2)
    job.apply(spark.createDataFrame(BATCHES[0], RECORD), 0)
    before = keyed(job.table("core"), "cap_identifier", "warning_id")
    broken = job.table("core").withColumn("warning_id", F.when(F.col("cap_identifier") == "c2", F.raise_error(F.lit("broken")).cast("bigint")).otherwise(F.col("warning_id")))
    try:
        job._write("core", broken, "bucket", [0, 1])
        raise AssertionError("the write went on")
    except PySparkException:
        pass
    assert keyed(job.table("core"), "cap_identifier", "warning_id") == before and len(before) == 3


def test_best_per_key_equals_window(spark):
    rows = spark.createDataFrame([(i % 7, i % 3 or None, i) for i in range(200)], "k int, r int, id int")
    order = [F.col("r").asc_nulls_last(), F.col("id").desc()]
    rank = F.struct(F.col("r").isNull(), F.col("r"), -F.col("id"))
    assert keyed(canonical.best_per_key(rows, ["k"], rank), "k", "id") == keyed(canonical.first_per_key(rows, ["k"], order), "k", "id")


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = merge.upsert(old, new, ["k"])
    assert keyed(once, "k", "v") == keyed(merge.upsert(once, new, ["k"]), "k", "v") == [(1, "a"), (2, "c"), (3, "d")]


def test_preserving_upsert(spark):
    cols = "k int, status string, path string, note string"
    old = spark.createDataFrame([(1, "published", "/p", "x"), (2, "cataloged", None, "x")], cols)
    new = spark.createDataFrame([(1, "cataloged", "/n", "y"), (2, "cropped", "/n", "y"), (3, "cataloged", None, "y")], cols)
    out = keyed(merge.preserving_upsert(old, new, ["k"], ["path"], "status", "cataloged"), "k", "status", "path", "note")
    assert out == [(1, "published", "/p", "y"), (2, "cropped", "/n", "y"), (3, "cataloged", None, "y")]


def test_preserving_upsert_with_unknown_status(spark):
    cols = "k int, status string, path string, note string"
    old, new = spark.createDataFrame([(1, "published", "/p", "x")], cols), spark.createDataFrame([(1, None, None, "y")], cols)
    assert keyed(merge.preserving_upsert(old, new, ["k"], ["path"], "status", "cataloged"), "k", "status", "path", "note") == [(1, "published", "/p", "y")]


def test_published_versions(spark):
    path = scratch_path(spark, "t-publish")
    first = merge.publish(spark, spark.range(3), path)
    merge.publish(spark, spark.range(5), path)
    assert (first.count(), merge.published(spark, path).count()) == (3, 5)


def test_undated_alerts_when_any_state_is_asked_for(spark):
    rows = spark.createDataFrame([("a", "Calor", "Rojo", None, T0), ("b", "Calor", "Rojo", T0, T0 + timedelta(hours=1)), ("c", "Calor", "Rojo", T0 - timedelta(days=9), T0 - timedelta(days=8))], "id string, event string, level string, onset timestamp, expires timestamp")
    ids = lambda **k: {r["id"] for r in reports.query_alerts(rows, F.lit(T0), date_from="2025-07-01", date_to="2025-07-02", **k).collect()}
    assert ids(status="cualquiera") == {"a", "b"} and ids() == {"b"}


def test_partition_overwrite_leaves_others(spark):
    path = scratch_path(spark, "t-part")
    merge.overwrite_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, "p")
    merge.overwrite_partitions(spark.createDataFrame([(9, "b")], "v int, p string"), path, "p")
    assert keyed(spark.read.schema("v int, p string").parquet(path), "v", "p") == [(1, "a"), (9, "b")]


def test_running_totals_stay_null_until_first_value(spark):
    days = spark.createDataFrame(
        [("v4", "2025-05-01", None, None, False), ("v4", "2025-05-02", 100.0, 5, True), ("v4", "2025-05-03", None, None, False), ("v4", "2025-05-04", 50.0, 1, True)],
        "dataset_version string, nominal_date string, burned_area_ha double, burned_pixel_count bigint, has_local_tiles boolean",
    )
    out = series.running_totals(days, ["dataset_version"]).orderBy("nominal_date").collect()
    assert [r["cumulative_burned_area_ha"] for r in out] == [None, 100.0, 100.0, 150.0]
    assert [r["cumulative_tile_date_count"] for r in out] == [0, 1, 1, 2]


def test_burnt_area_summary(spark):
    schema = "nominal_date string, burned_area_ha double"
    rows = spark.createDataFrame([("2025-05-01", 100.0), ("2025-05-02", 250.0), ("2025-05-03", None), ("2025-05-04", 250.0), ("2025-05-05", 50.0)], schema)
    r = reports.burnt_area_summary(rows).first()
    assert (r["total_days"], r["total_burned_area_ha"], r["peak_day"]) == (5, 650.0, "2025-05-02")
    empty = reports.burnt_area_summary(spark.createDataFrame([], schema)).first()
    assert (empty["total_burned_area_ha"], empty["peak_day"]) == (0.0, None)


def test_warning_history(spark):
    cols = "nominal_date string, max_temperature_c double, warning_count bigint, red_count bigint, orange_count bigint, yellow_count bigint, green_count bigint"
    rows = spark.createDataFrame([("2025-07-17", 35.0, 10, 0, 2, 8, 1), ("2025-07-18", 41.0, 44, 12, 20, 12, 0), ("2025-07-19", 39.0, 22, 0, 2, 20, 3), ("2025-07-20", None, 0, 0, 0, 0, 0)], cols)
    r = reports.warning_history(rows).first()
    assert (r["peak_day"], r["total_warning_count"], r["total_red_count"]) == ("2025-07-18", 76, 12)


def test_alert_states_and_filters(spark):
    h = timedelta(hours=1)
    rows = [
        ("a1", "Calor", "Naranja", T0 - h, T0 + 6 * h), ("a2", "Calor", "Rojo", T0 - h, T0 + 6 * h), ("a3", "Viento", "Amarillo", T0 - h, T0 + 6 * h),
        ("a4", "Lluvia", "Verde", T0 - 9 * h, T0 - 2 * h), ("a5", "Viento", "Naranja", T0 + 24 * h, T0 + 30 * h), ("a6", "Viento", "Verde", None, None),
    ]
    df = spark.createDataFrame(rows, "id string, event string, level string, onset timestamp, expires timestamp")
    now = F.lit(T0)
    ids = lambda **kw: sorted(r["id"] for r in reports.query_alerts(df, now, **kw).collect())
    assert ids() == ["a1", "a2", "a3"]
    assert ids(phenomenon="VIENTO") == ["a3"] and ids(level="Rojo") == ["a2"]
    assert ids(status="proximo") == ["a5"] and ids(status="expirado") == ["a4"] and len(ids(status="cualquiera")) == 6
    assert tuple(reports.alert_state_counts(df, now).first()) == (3, 1, 1, 4)


def test_top_k_flags(spark):
    rows = spark.range(10)
    probe = series.top_with_probe(rows, [F.col("id").desc()], 3).collect()
    assert [r["id"] for r in probe] == [9, 8, 7] and probe[0]["truncated"] and probe[0]["total_matched"] == 4
    full = series.top_with_total(rows, [F.col("id")], 20).collect()
    assert len(full) == 10 and full[0]["total_matched"] == 10 and not full[0]["truncated"]


CAP_XML = (
    '<?xml version="1.0"?><alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>X{0}</identifier><sent>2025-07-01T10:00:00-00:00</sent>'
    "<info><language>es-ES</language><event>Aviso nivel rojo</event><eventCode><valueName>AEMET-Meteoalerta fenomeno</valueName><value>AT;Calor</value></eventCode>"
    "<onset>2025-07-01T13:00:00+02:00</onset><expires>2025-07-01T21:00:00+02:00</expires><description>hasta 41,5 C</description>"
    "<area><areaDesc>Uno</areaDesc><polygon>40,-3 41,-3 41,-2</polygon><geocode><valueName>AEMET-Meteoalerta zona</valueName><value>Z{0}</value></geocode></area>"
    "<area><areaDesc>Dos</areaDesc></area></info></alert>"
)


def tar_of(members):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as archive:
        for name, body in members:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            archive.addfile(info, io.BytesIO(body))
    return buffer.getvalue()


def test_nested_archives_and_cap_parsing(spark, tmp_path):
    inner = gzip.compress(tar_of([("a.xml", CAP_XML.format(1).encode()), ("b.xml", b"<?xml broken"), ("c.txt", b"no")]))
    (tmp_path / "day.tar").write_bytes(tar_of([("in.tar.gz", inner), ("d.xml", CAP_XML.format(2).encode())]))
    messages = cap.read_archives(spark, str(tmp_path))
    assert sorted(r["member_path"] for r in messages.collect()) == ["day.tar/d.xml", "day.tar/in.tar.gz/a.xml", "day.tar/in.tar.gz/b.xml"]
    rows = {(r["cap_identifier"], r["area_name"]): r for r in cap.parse(messages).collect()}
    assert set(rows) == {("X1", "Uno"), ("X1", "Dos"), ("X2", "Uno"), ("X2", "Dos")}
    first = rows[("X1", "Uno")]
    assert (first["level_label"], first["temperature_max_c"], first["area_code"], len(first["ring"])) == ("Rojo", 41.5, "Z1", 4)
    assert first["onset_at"].hour == 11
    live = cap.parse_live(messages).collect()
    assert {(r["id"], r["area_name"], r["onset"].hour) for r in live} == {("X1", "Uno", 13), ("X2", "Uno", 13)}


def test_broken_archive_is_a_row(spark):
    good = gzip.compress(b"  " * 600 + b"<?xml version='1.0'?><a/>")
    files = spark.createDataFrame([("x/good.gz", bytearray(good)), ("x/bad.gz", bytearray(good[:-9])), ("x/none", bytearray(b""))], "path string, content binary")
    rows = {r["path"]: r for r in cap.unpack(files).collect()}
    assert rows["x/good.gz"]["payload"].strip().startswith("<?xml") and rows["x/bad.gz"]["error"] and set(rows) == {"x/good.gz", "x/bad.gz"}


def test_small_archives_are_not_probed_member_by_member(spark, monkeypatch):
    inner = gzip.compress(tar_of([("m0.xml", b"<?xml a"), ("m1.xml", b"  <?xml b"), ("note.txt", b"no"), ("empty", b"")]))
    probed, real = [], tarfile.is_tarfile
    monkeypatch.setattr(tarfile, "is_tarfile", lambda stream: probed.append(1) or real(stream))
    found = list(cap.members("x", io.BytesIO(tar_of([("in.tar.gz", inner), ("none.tar", tar_of([]))]))))
    assert found == [("x/in.tar.gz/m0.xml", b"<?xml a"), ("x/in.tar.gz/m1.xml", b"  <?xml b")]
    assert len(probed) == 3  # the three tars, none of the members
    files = spark.createDataFrame([(f"a{i}", bytearray(inner)) for i in range(50)], "path string, content binary").coalesce(1)
    rows = cap.unpack(files).collect()
    assert sorted(r["path"] for r in rows) == sorted(f"a{i}" for i in range(50) for _ in range(2))


def odd_archives():
    """Archives that the short way must read as the long one does, or leave to it."""
    xml = [(f"m{i}.xml", f"<?xml {i}".encode() * 60) for i in range(3)]
    usual = tar_of([*xml, ("note.txt", b"no message"), ("empty", b""), ("blank.xml", b" " * 600 + b"<?xml z")])

    def written(kind, entries):
        buffer = io.BytesIO()
        with tarfile.open(fileobj=buffer, mode="w", format=kind) as archive:
            for name, body, change in entries:
                info = tarfile.TarInfo(name)
                info.size = len(body)
                for k, v in change.items():
                    setattr(info, k, v)
                archive.addfile(info, io.BytesIO(body))
        return buffer.getvalue()

    mixed = [("folder", b"", {"type": tarfile.DIRTYPE, "mtime": 1.7e9}), ("folder/a.xml", b"<?xml a", {"mtime": 1.7e9, "uname": "me", "uid": 1000}), ("link.xml", b"", {"type": tarfile.SYMTYPE, "linkname": "folder/a.xml"}), ("b.xml", b"<?xml \xff\xfe", {})]
    deep = b"<?xml deep"
    for _ in range(12):
        deep = gzip.compress(deep)
    nested = tar_of([("in.tar.gz", gzip.compress(usual)), ("in.tar", usual), ("x.xml.gz", gzip.compress(b"<?xml x")), ("x.bz2", bz2.compress(b"<?xml no"))])
    wrong = bytearray(usual)
    wrong[1024 + 5] ^= 1  # the name in the second header
    cut_size = bytearray(tar_of([("a.xml", b"<?xml a")]))
    cut_size[124:136] = b"00000zzzzzz\0"
    found = {
        "usual": usual, "gz": gzip.compress(usual), "nested": nested, "deep": deep, "gnu": written(tarfile.GNU_FORMAT, mixed), "pax": written(tarfile.PAX_FORMAT, [*mixed, ("n" * 150 + ".xml", b"<?xml long", {}), ("ñ.xml", b"<?xml n", {})]),
        "ustar": written(tarfile.USTAR_FORMAT, [*mixed[:3], ("d" * 80 + "/" + "n" * 50 + ".xml", b"<?xml long", {})]), "wrong": bytes(wrong), "size": bytes(cut_size), "cut": usual[:1500], "cut header": usual[:1100], "no end": usual[:3072],
        "bad gz": gzip.compress(usual)[:-9], "two gz": gzip.compress(b"<?xml 1") + gzip.compress(b" more"), "after gz": gzip.compress(b"<?xml 1") + b"zzz", "gz zeros": gzip.compress(b"<?xml 1") + bytes(9), "xml": b"  <?xml plain", "text": b"no", "none": b"", "no members": tar_of([]), "zeros": bytes(700), "zeros inside": tar_of([xml[0], ("zeros", bytes(1024))]),
        "folders": written(tarfile.GNU_FORMAT, mixed[:2]),
    }
    return found


def long_way(name, content):
    rows = []
    try:
        rows += [(n, b.decode("utf-8", "replace"), None) for n, b in cap.members(name, io.BytesIO(content))]
    except (OSError, EOFError, zlib.error, tarfile.TarError) as broken:
        rows.append((None, None, f"{type(broken).__name__}: {broken}"))
    return rows


def test_plain_archives_are_read_the_short_way(spark, monkeypatch):
    archives = odd_archives()
    want = {(f"p/{name}", *row) for name, content in archives.items() for row in long_way(name, content)}
    rows = cap.unpack(spark.createDataFrame([(f"p/{n}", bytearray(b)) for n, b in archives.items()], "path string, content binary")).collect()
    assert len(rows) == len(want) > 25 and {tuple(r) for r in rows} == want
    exact = {name: list(cap.members(name, io.BytesIO(content))) for name, content in archives.items() if name in ("usual", "gz", "folders", "size", "xml", "text", "none")}
    inside = tar_of([("in.tar.gz", gzip.compress(tar_of([("a.xml", b"<?xml a"), ("note.txt", b"no")])))])
    monkeypatch.setattr(tarfile, "open", lambda *a, **k: 1 / 0)
    monkeypatch.setattr(gzip, "GzipFile", lambda *a, **k: 1 / 0)
    short = {name: cap.plain_members(name, content) for name, content in archives.items()}
    assert {name: short[name] for name in exact} == exact and len(exact["usual"]) == 4
    assert cap.plain_members("p", inside) == [("p/in.tar.gz/a.xml", b"<?xml a")]
    assert all(short[name] is None for name in ("deep", "pax", "wrong", "cut", "bad gz", "two gz", "after gz", "gz zeros", "zeros", "zeros inside"))


def test_large_archives_take_the_long_way(spark, monkeypatch):
    monkeypatch.setattr(cap, "PLAIN_BYTES", 5000)
    tar = tar_of([("a.xml", b"<?xml a"), ("b.xml", b"<?xml b" + bytes(9000))])
    assert cap.plain_members("p", tar) is None and cap.plain_members("p", gzip.compress(tar)) is None
    assert cap.plain_members("p", gzip.compress(b"<?xml a")) == [("p", b"<?xml a")]


def test_messages_are_written_behind_the_shuffle(spark):
    """Records of one identifier make one archive, whose messages were never shuffled; a record that gives no message counts for nothing."""
    t0 = datetime(2025, 7, 1)
    records = [(i, f"C{i % 3}", "AT", f"Z{i % 2}", "Zona", "Rojo", None if i == 7 else 30.0, t0, t0, t0) for i in range(12)]

    class Landing:
        def warning_src(self):
            return spark.createDataFrame(records, "source_record_id bigint, cap_identifier string, phenomenon_code string, area_code string, area_name string, level_label string, temperature_max_c double, onset_at timestamp, expires_at timestamp, sent_at timestamp")

        def zone(self):
            return spark.createDataFrame([(f"Z{i}", [(0.0, 1.0), (2.0, 3.0)]) for i in range(2)], "area_code string, ring array<struct<x:double,y:double>>")

    made = ingest_queries.packed(Landing())
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan
    messages = cap.unpack(made).collect()
    assert sorted((r["path"], r["member_path"]) for r in messages) == sorted((f"C{k}.tar", f"C{k}.tar/inner.tar.gz/m{i}.xml") for k in range(3) for i in range(3 if k == 1 else 4))
    wanted = ingest_queries.cap_messages(Landing()).filter("payload IS NOT NULL").collect()
    assert sorted(r["payload"] for r in messages) == sorted(r["payload"] for r in wanted) and "".join(r["payload"] for r in wanted).count("<polygon>1.0,0.0 3.0,2.0<") == 22


def test_alert_text_is_parsed_once(spark):
    messages = spark.createDataFrame([(1, CAP_XML.format(1)), (2, "<?xml broken")], "n int, payload string")
    for parse in (cap.parse, cap.parse_live):
        plan = parse(messages)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("from_xml(") + plan.lower().count("xmltostructs(") == 1
        assert parse(messages).count() == (2 if parse is cap.parse else 1)


def test_csv_row_numbers_cover_split_files(spark, tmp_path):
    lines = ["latitude,longitude,acq_date,satellite"] + [f"40.{i},-3.{i},2024-01-01,N" for i in range(500)]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        raw = landing.read_hotspot_csv(spark, str(tmp_path))
        rows = raw.select("source_row_number", "latitude").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r[0], r[1]) for r in rows) == [(i + 1, f"40.{i}") for i in range(500)]


def test_csv_columns_are_bound_by_name(spark, tmp_path):
    (tmp_path / "good.csv").write_text('latitude,longitude,satellite,confidence\n40.5,-3.5,"N, 20",h\n')
    (tmp_path / "swapped.csv").write_text('\ufeffLongitude, LATITUDE,extra\n-4.5,41.5,zzz\n\n')
    (tmp_path / "lost.csv").write_text("acq_date,satellite\n2024-01-01,N\n")
    (tmp_path / "empty.csv").write_text("")
    rows = landing.read_hotspot_csv(spark, str(tmp_path)).select("latitude", "longitude", "satellite", "confidence", "frp", "source_row_number").collect()
    assert sorted(map(tuple, rows)) == [("40.5", "-3.5", "N, 20", "h", None, 1), ("41.5", "-4.5", None, None, None, 1)]


def test_boundaries_of_all_kinds(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    feature = lambda code, kind, coordinates: {"type": "Feature", "properties": {"code": code}, "geometry": {"type": kind, "coordinates": coordinates}}
    collection = {"type": "FeatureCollection", "features": [feature("a", "Polygon", [ring, ring]), feature("b", "MultiPolygon", [[ring], [ring, ring]]), feature("c", "Point", [1, 2])]}
    (tmp_path / "many.json").write_text(json.dumps(collection))
    (tmp_path / "one.json").write_text(json.dumps(feature("d", "MultiPolygon", [[ring]])))
    edges = landing.read_boundary_edges(spark, str(tmp_path), "code").groupBy("part").count().collect()
    assert {tuple(r) for r in edges} == {("a", 6), ("b", 9), ("d", 3)}
    kinds = landing.read_boundary_features(spark, str(tmp_path), "code").filter("polygons IS NULL").collect()
    assert [(r["part"], r["geometry_type"]) for r in kinds] == [("c", "Point")]


def test_raster_grids(spark):
    pixels = spark.createDataFrame([("2024-05-01", 500, 500, 900), ("2024-05-01", 0, 0, 500)], "nominal_date string, prow int, pcol int, bf int")
    grid = raster.Grid(-9.0, 44.0, 0.003, 0.002, 501, 1000)
    got = raster.dilate(pixels, grid).groupBy("is_core").count().collect()
    assert {tuple(r) for r in got} == {(True, 2), (False, 8)}  # five neighbours of the last row, three of the corner
    fine, coarse = (spark.range(1).select(g.area_ha(F.lit(0)).alias("a")).first()["a"] for g in (grid, raster.Grid(-9.0, 44.0, 0.03, 0.02, 400, 400)))
    assert abs(coarse / fine - 100) < 0.1


def test_late_warnings_are_kept(spark):
    rows = [record(i, f"c{i % 4}", "Z1", 1, "Rojo", 0, 3) for i in range(8)]
    path = scratch_path(spark, "t-late")
    for i in (7, 6, 5, 4, 3, 2, 1, 0):  # newest first, a file and a trigger each
        day = timedelta(days=10 * i)
        late = [(*rows[i][:11], rows[i][11] + day, *rows[i][12:])]
        spark.createDataFrame(late, RECORD).coalesce(1).write.mode("append").parquet(path)
    stream = feed.late_warnings(spark, path, spark.createDataFrame(rows, RECORD).schema, ["cap_identifier", "area_code"], files_per_batch=1)
    assert feed.drain(stream, "t-late-out").count() == 4


def test_lookups(spark):
    names = spark.createDataFrame([("castilla",), ("Córdoba",), ("pueblo",), ("",), ("qqq",)], "name string")
    towns = spark.createDataFrame([(1, "Pueblo Chico", 10, (0.0, 1.0, 2.0, 3.0)), (2, "Gran pueblo", 99, (5.0, 6.0, 7.0, 8.0))], "settlement_id int, nombre string, habitantes int, bbox struct<minx:double,miny:double,maxx:double,maxy:double>")
    got = {r["asked"]: (r["place"], r["kind"], r["minx"]) for r in lookup.resolve_places(names, towns).collect()}
    assert got == {"castilla": ("Castilla y Leon", "ccaa", -7.07), "Córdoba": ("Cordoba", "provincia", -5.61), "pueblo": ("Gran pueblo", "municipio", 5.0), "": (None, None, None), "qqq": (None, None, None)}
    terms = spark.createDataFrame([("frp",), ("drought",), ("zzz",)], "term string")
    assert {r["term"]: r["key"] for r in lookup.explain_terms(terms).collect()} == {"frp": "FRP", "drought": "DC", "zzz": None}


def test_glossary_of_a_file(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"AB": {"name": "A b", "long_name": "Alpha Beta", "unit": "m", "description": "d"}, "X": {"name": "x", "context_of_map": "c"}}))
    terms = spark.createDataFrame([("a b",), ("beta",), ("none",), (None,)], "term string")
    rows = {r["term"]: r for r in lookup.explain_terms(terms, landing.read_glossary(spark, str(tmp_path))).collect()}
    assert (rows["a b"]["key"], rows["a b"]["unit"], rows["a b"]["description"], rows["a b"]["available_terms"]) == ("AB", "m", "d", None)
    assert lookup.explain_terms(spark.createDataFrame([("x",)], "term string"), landing.read_glossary(spark, str(tmp_path))).first()["context"] == "c"
    assert rows["beta"]["key"] == "AB" and not rows["none"]["found"] and rows["none"]["available_terms"] == ["AB", "X"]


def test_quality(spark):
    rows = spark.createDataFrame([(1, 91.0, "x"), (2, 10.0, "ok"), (2, None, "ok")], "id int, lat double, s string")
    assert keyed(quality.duplicate_keys(rows, ["id"]), "id", "n") == [(2, 2)]
    assert keyed(quality.violations(rows, {"lat": F.col("lat").between(-90, 90)}, "id"), "id", "rule") == [(1, "lat")]
    assert keyed(quality.outside_set(rows, "s", ["ok"]), "id") == [(1,)]
    files = spark.createDataFrame([("a", bytearray(b"hi")), ("b", bytearray(b"yo"))], "path string, content binary")
    want = spark.createDataFrame([("a", hashlib.sha256(b"hi").hexdigest()), ("b", "0")], "path string, sha256 string")
    assert keyed(quality.file_hash_mismatches(files, want), "path") == [("b",)]


def test_csv_columns_of_a_wide_header(spark, tmp_path):
    extra = ",".join(f"x{i}" for i in range(60))
    (tmp_path / "wide.csv").write_text(f"{extra},latitude,longitude,frp\n" + "0," * 60 + "40.5,-3.5,7\n")
    (tmp_path / "narrow.csv").write_text("latitude,longitude\n41,-4\n")
    rows = landing.read_hotspot_csv(spark, str(tmp_path)).select("latitude", "longitude", "frp").collect()
    assert sorted(map(tuple, rows), key=str) == [("40.5", "-3.5", "7"), ("41", "-4", None)]


def test_settlement_landing_and_pages(spark, tmp_path):
    """Absent fields, empty texts and bad numbers are NULL; pages without features, geometry or people give no rows."""
    box = [[[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]]]
    rows = spark.createDataFrame([(1, "", "x", 7, box[0]), (2, " ", "12.5", None, None)], "source_objectid bigint, nombre string, fecha_ine string, extra int, shape array<array<array<struct<x:double,y:double>>>>")
    rows.write.parquet(str(tmp_path / "landing"))
    got = {r["source_objectid"]: r for r in landing.read_settlement_landing(spark, str(tmp_path / "landing")).collect()}
    assert len(got[1]) == 16 and got[1]["nombre"] is None and got[2]["nombre"] == " " and got[1]["fecha_ine"] is None and got[2]["fecha_ine"] == 12.5 and got[2]["shape"] is None
    assert landing.read_settlement_landing(spark, str(tmp_path / "landing"), 1).count() == 1
    point = '"geometry":{"type":"Point","coordinates":[1,2]}'
    pages = [
        '{"features":[]}',
        "{}",
        '{"features":[{"properties":{"nombre":"A","habitantes":500},' + point + '},{"properties":{"nombre":"B","habitantes":499},' + point + '},{"properties":{"habitantes":900},"geometry":null}]}',
        '{"features":[{"properties":{"nombre":null,"habitantes":501,"cpro":"x"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"properties":null,' + point + "}]}",
    ]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "p.json").write_text("\n".join(pages))
    found = {r["habitantes"]: r for r in landing.read_settlement_pages(spark, str(tmp_path / "pages")).collect()}
    assert set(found) == {500, 501}
    assert (found[500]["nombre"], found[500]["codine"], found[500]["cpro"], found[500]["polygons"]) == ("A", "", 0, None)
    assert found[501]["nombre"] is None and found[501]["cpro"] is None and len(found[501]["polygons"]) == 1


def small_orders(spark, tmp_path):
    """Forty orders of two lines on forty days, as tables of their own."""
    from pavesa.sources.bridge import Tables

    days = "timestampadd(DAY, cast(id as int), timestamp'1997-01-01')"
    spark.range(40).selectExpr("id AS o_orderkey", "id AS o_custkey", f"{days} AS o_orderdate", "concat(cast(id % 5 + 1 as string), '-X') AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(80).selectExpr("id div 2 AS l_orderkey", "cast(id % 2 + 1 as int) AS l_linenumber", "id % 7 AS l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    return Tables(spark, str(tmp_path))


def test_records_of_a_part_land_by_many_tasks(spark, tmp_path):
    from pavesa.plans import ingest_queries

    t = small_orders(spark, tmp_path)
    path, schema = ingest_queries.record_files(t, 1)
    landed = spark.read.schema(schema).parquet(path)
    assert landed.select("_metadata.file_path").distinct().count() > 4
    assert landed.count() == 80


def test_features_of_a_day_are_those_of_all_days(spark, tmp_path):
    from pavesa.plans import pipeline

    t = small_orders(spark, tmp_path)
    whole = pipeline.features(t).filter("valid_date = date'1997-01-20'")
    day = pipeline.features_of_day(t, "1997-01-20").select(*whole.columns)
    assert whole.count() > 0
    assert sorted(map(str, whole.collect())) == sorted(map(str, day.collect()))


def test_names_of_one_fragment_are_dealt(spark):
    from pyspark.sql import functions as F

    from pavesa.operators import lookup

    names = spark.range(200).selectExpr("concat('Villa ', cast(id as string)) AS name", "id AS people")
    needles = spark.createDataFrame([("villa",), ("LLA 19",), ("zz",)], "needle string")
    found = lookup.find_containing(needles, names, ["people"], F.struct(-F.col("people")))
    assert {r["needle"]: r["name"] for r in found.collect()} == {"villa": "Villa 199", "LLA 19": "Villa 199"}
    assert "salt" in found._jdf.queryExecution().analyzed().toString()


def test_repeated_pixels_become_one_before_the_halo(spark):
    from pavesa.operators import raster

    rows = [("2020-01-01", 5, 5, 10), ("2020-01-01", 5, 5, 30), ("2020-01-01", 5, 6, 20)]
    pixels = spark.createDataFrame(rows * 3, "d string, prow int, pcol int, bf int").selectExpr("cast(d as date) AS nominal_date", "prow", "pcol", "bf")
    halo = raster.dilate(pixels, raster.Grid(0.0, 0.0, 1.0, 1.0, 20, 20))
    assert halo._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
    got = {(r["prow"], r["pcol"]): (r["is_core"], r["bf"]) for r in halo.collect()}
    assert len(got) == 12 and got[(5, 5)] == (True, 30) and got[(5, 6)] == (True, 20) and got[(4, 4)] == (False, None)


def test_roads_that_cannot_win_stay_behind(spark):
    """Few rows beside the winners reach the shuffle of whole rows; the winners are those of all rows, with nulls and repeated rows too."""
    rows = [(i % 60, i // 2, None if i % 7 == 0 else i % 9, None if i % 11 == 0 else T0 + timedelta(days=i % 13)) for i in range(3000)] * 2
    src = spark.createDataFrame(rows, "id_tramo bigint, source_fid bigint, clase_raw int, imported_at timestamp").selectExpr(
        "*", "source_fid AS id_vial", "'Urbano' AS clased", "concat('V', source_fid) AS nombre", "'2' AS ncarriles", "'RT_MADRID_gpkg.zip' AS source_zip_name",
        "array(named_struct('x', 1D, 'y', 2D), named_struct('x', 3D, 'y', 4D)) AS line",
    )
    as_rows = lambda df: sorted(map(repr, df.collect()))
    assert as_rows(canonical.roads(src)) == as_rows(canonical.roads(src, few=True)) and canonical.roads(src).count() == 60
    order = [F.col("clase_raw").asc_nulls_last(), F.col("imported_at").desc_nulls_last(), F.col("source_fid").asc()]
    kept = canonical.may_be_first(src, ["id_tramo"], order, ["clase_raw", "imported_at", "source_fid"])
    assert 60 <= kept.count() <= 240
    first = canonical.first_per_key(src, ["id_tramo"], order).select("id_tramo", "clase_raw", "imported_at", "source_fid")
    assert as_rows(first.join(kept.select("id_tramo", "source_fid").distinct(), ["id_tramo", "source_fid"]).select(*first.columns)) == as_rows(first)
