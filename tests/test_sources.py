"""File sources, the paged source and the partition sink."""

from tesserae.sources import readers, sinks


def pages(root, cursor):
    k = cursor or 0
    return [f'{{"root": "{root}", "k": {k}}}'], (k + 1 if k < 2 else None)


def test_paged_source_has_a_partition_per_root(spark):
    spark.dataSource.register(readers.PagedSource)
    rows = spark.read.format("paged").option("roots", "a,b").option("client", "tests.test_sources:pages").load()
    assert rows.count() == 6 and rows.rdd.getNumPartitions() == 2


def test_scan_skips_directories_and_reads_formats(spark, tmp_path):
    (tmp_path / "keep").mkdir()
    (tmp_path / "skip").mkdir()
    (tmp_path / "keep/a.txt").write_text("plain")
    (tmp_path / "keep/b.html").write_text("<p>seen</p><script>no</script>")
    (tmp_path / "keep/c.pdf").write_bytes(b"%PDF-broken")
    (tmp_path / "skip/d.txt").write_text("hidden")
    files = readers.scan_files(spark, f"file://{tmp_path}", skip_dirs=("skip",))
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in readers.by_format(files, lambda raw: ["page one"]).collect()}
    assert got == {"a.txt": "plain", "b.html": "seen", "c.pdf": "page one"}
    kinds = {r["path"].rsplit("/", 1)[1]: r["k"] for r in files.select("path", readers.magic_kind("content").alias("k")).collect()}
    assert kinds["c.pdf"] == "pdf" and kinds["a.txt"] == "other"
    assert readers.scan_texts(spark, f"file://{tmp_path}/keep", least=6).count() == 2


def test_overwrite_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "course int, v string").write.partitionBy("course").parquet(path)
    sinks.overwrite_partition(spark.createDataFrame([(1, "z")], "course int, v string"), path, "course")
    assert sorted((r["course"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "z"), (2, "b")]


def test_shared_tables_are_removed_when_asked(spark):
    import os

    from tesserae import shared

    kept = shared.written(spark.range(3))
    folder = shared._MADE[spark.sparkContext.applicationId][-1].removeprefix("file://")
    assert kept.count() == 3 and os.path.isdir(folder)
    shared.clean(spark)
    assert not os.path.exists(folder)


def test_scans_are_dealt_only_where_tasks_are_few(spark):
    from tesserae.shared import spread

    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == cores
    assert spread(spark.range(0, 100, 1, cores + 3)).rdd.getNumPartitions() == cores + 3


def test_listing_does_not_enter_skipped_folders(spark, tmp_path):
    for name in ("a/x.pdf", "a/skip/y.pdf", "b/z.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("12")
    got = {(r["path"].rsplit("/", 1)[1], r["size"]) for r in readers.list_files(spark, f"file://{tmp_path}", "*.pdf", ("skip",)).collect()}
    assert got == {("x.pdf", 2)}
