"""The stored index: racing writers, pruned reads, files that fail, forced and repeated runs, clearing."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarry.sources import store
from quarry.streaming import incremental


@pytest.fixture(autouse=True)
def small_plans(spark):
    """Batches are many small jobs here: nothing is worth compiling."""
    given = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k, None) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows(spark, *documents):
    return spark.createDataFrame([(d, k, i, f"body {d}", "m", "h", "p", "1", "c", 0) for i, (d, k) in enumerate(documents)], "document_id string, document_key string, row_id long, body string, model_id string, content_hash string, parser_name string, parser_version string, chunker_version string, dim int")


def parsed(spark, *files):
    return spark.createDataFrame([(p, t, h, "p", "1", datetime(2024, 1, 1 + day)) for p, t, h, day in files], incremental.INCOMING)


def bodies(spark, root):
    return sorted((r["relative_path"], r["body"]) for r in store.read_index(spark, root)["chunks"].collect())


@pytest.mark.parametrize("way", [store._link_if_absent, store._rename_if_absent])
def test_a_pointer_is_created_once(spark, tmp_path, monkeypatch, way):
    monkeypatch.setattr(store, "_link_if_absent", way)
    path = f"{tmp_path}/current/{1:020d}.json"
    assert store.put_if_absent(spark, path, "first") and not store.put_if_absent(spark, path, "second")
    assert (tmp_path / "current" / f"{1:020d}.json").read_text() == "first" and len([p for p in (tmp_path / "current").iterdir() if not p.name.endswith(".crc")]) == 1


def test_racing_writers_of_other_buckets_both_land(spark, tmp_path, monkeypatch):
    """The second writer commits between the first one's reading and its commit."""
    root = str(tmp_path / "index")
    at = {r["d"]: r["b"] for r in spark.range(40).select(F.concat(F.lit("h"), "id").alias("d")).withColumn("b", store.bucket_of("d")).collect()}
    first, second = sorted(at, key=at.get)[0], sorted(at, key=at.get)[-1]
    incremental.apply_batch(spark, parsed(spark, ("x.txt", "start", "h-start", 0)), root)
    plain, raced = store.write_tables, []

    def slowly(spark_, root_, base, tables, *more):
        if not raced:
            raced.append(base.number)
            incremental.apply_batch(spark, parsed(spark, ("two.txt", "second text", second, 0)), root)
        return plain(spark_, root_, base, tables, *more)

    monkeypatch.setattr(store, "write_tables", slowly)
    incremental.apply_batch(spark, parsed(spark, ("one.txt", "first text", first, 0)), root)
    assert raced == [1] and store.current_version(spark, root) == 3
    assert bodies(spark, root) == [("one.txt", "first text"), ("two.txt", "second text"), ("x.txt", "start")]
    assert store.read_index(spark, root)["keys"].count() == 3 and store.read_index(spark, root)["generations"].count() == 3


def test_racing_writers_of_one_bucket_start_anew(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    incremental.apply_batch(spark, parsed(spark, ("a.txt", "start", "h0", 0)), root)
    plain, raced = store.write_tables, []

    def slowly(spark_, root_, base, tables, *more):
        raced.append(base.number)
        if len(raced) == 1:
            incremental.apply_batch(spark, parsed(spark, ("a.txt", "theirs", "h1", 1)), root)
        return plain(spark_, root_, base, tables, *more)

    monkeypatch.setattr(store, "write_tables", slowly)
    incremental.apply_batch(spark, parsed(spark, ("a.txt", "ours", "h2", 2)), root)
    assert raced == [1, 1, 2] and bodies(spark, root) == [("a.txt", "ours")]
    base = store.latest(spark, root)
    store.commit(spark, root, base, {"keys/1"}, {"keys/1": "x"}, {})
    with pytest.raises(store.Conflict):
        store.commit(spark, root, base, {"keys/1"}, {"keys/1": "y"}, {})


def test_pointers_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "POINTERS_KEPT", 3)
    for i in range(6):
        store.commit(spark, str(tmp_path), store.latest(spark, str(tmp_path)), {f"keys/{i}"}, {f"keys/{i}": "f"}, {})
    assert store._pointers(spark, str(tmp_path)) == [6, 5, 4] and len(store.latest(spark, str(tmp_path)).held) == 6


def test_a_batch_of_one_file_reads_two_buckets_at_most(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    incremental.apply_batch(spark, parsed(spark, *[(f"f{i}.txt", f"text {i}", f"h{i}", 0) for i in range(200)]), root)
    read, plain = [], store.read_tables

    def noted(spark_, root_, of, wanted):
        tables = plain(spark_, root_, of, wanted)
        read.extend((name, {re.search(r"bucket=(\d+)", f)[1] for f in df.inputFiles()}) for name, df in tables.items())
        return tables

    monkeypatch.setattr(store, "read_tables", noted)
    incremental.apply_batch(spark, parsed(spark, ("f7.txt", "new text", "new", 1)), root)
    assert {name for name, _ in read} >= {"chunks", "generations", "keys"}
    for name in store.TABLES:
        assert len(set().union(*[b for n, b in read if n == name])) <= 2, name
    monkeypatch.undo()
    held = dict(bodies(spark, root))
    assert held["f7.txt"] == "new text" and len(held) == 200
    found = store.read_documents(spark, root, ["new"])
    assert [r["body"] for r in found.collect()] == ["new text"] and len(found.inputFiles()) == 1


def caps():
    """A parser that fails on a zero byte."""

    def parse(content):
        if b"\0" in content:
            raise ValueError("bad file")
        return content.decode().upper()

    return incremental.Parser("caps", "1", parse)


OPTIONS = incremental.Options(parsers={".doc": caps()})


def put(folder, name, content):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(content)


def test_a_bad_file_stops_no_other(spark, tmp_path):
    """A stream over files: one cannot be parsed, one has no text; the others are indexed, and a second run takes up what is new or mended."""
    files, root, progress = tmp_path / "files", str(tmp_path / "index"), str(tmp_path / "progress")
    for name, content in {"a.txt": b"alpha", "sub/b.doc": b"beta", "bad.doc": b"x\0", "empty.txt": b" \n", "copy.txt": b"alpha", "no.exe": b"?"}.items():
        put(files, name, content)
    incremental.index_files_stream(spark, str(files), root, progress, OPTIONS).awaitTermination()
    assert bodies(spark, root) == [("a.txt", "alpha"), ("sub/b.doc", "BETA")]
    failures = lambda: sorted((r["relative_path"], r["failure_kind"], r["error_message"]) for r in store.read_index(spark, root)["failures"].collect())
    assert failures() == [("bad.doc", "corruptedInput", "ValueError: bad file"), ("empty.txt", "noChunks", "noChunks")]
    now = store.latest(spark, root)
    assert (now.number, now.report) == (1, {"documents": 4, "written": 2, "reused": 0, "failed": 2, "chunks_written": 2})
    put(files, "c.txt", b"gamma")
    incremental.index_files_stream(spark, str(files), root, progress, OPTIONS).awaitTermination()
    assert store.latest(spark, root).report == {"documents": 1, "written": 1, "reused": 0, "failed": 0, "chunks_written": 1}
    # A run over the whole folder: what is unchanged is reused, the mended file is taken up, what still fails keeps its row.
    put(files, "bad.doc", b"mended")
    put(files, "a.txt", b"\xff\xfea\x00")
    report = incremental.index_directory(spark, str(files), root, OPTIONS)
    assert report == {"documents": 6, "written": 3, "reused": 2, "failed": 1, "chunks_written": 3}
    assert bodies(spark, root) == [("a.txt", "a"), ("bad.doc", "MENDED"), ("c.txt", "gamma"), ("copy.txt", "alpha"), ("sub/b.doc", "BETA")]
    assert [f[0] for f in failures()] == ["empty.txt"]
    forced = incremental.index_directory(spark, str(files), root, incremental.Options(OPTIONS.parsers, force=True))
    assert (forced["written"], forced["reused"], forced["failed"]) == (5, 0, 1) and len(bodies(spark, root)) == 5


def test_what_fails_later_keeps_what_is_held(spark, tmp_path):
    files, root = tmp_path / "files", str(tmp_path / "index")
    put(files, "a.doc", b"one")
    put(files, "b.doc", b"two")
    incremental.index_directory(spark, str(files), root, OPTIONS)
    put(files, "a.doc", b"broken\0")
    put(files, "b.doc", b"changed")
    assert incremental.index_directory(spark, str(files), root, OPTIONS)["failed"] == 1
    assert bodies(spark, root) == [("a.doc", "ONE"), ("b.doc", "CHANGED")]


def test_vectors_and_whole_documents(spark, tmp_path):
    """A document of which one chunk has no vector is not written at all."""
    files, root = tmp_path / "files", str(tmp_path / "index")
    put(files, "a.txt", b"good\nfine")
    put(files, "b.txt", b"good\nwrong")
    numbers = F.array(F.char_length("body").cast("float"), F.lit(1.0).cast("float"))
    options = incremental.Options(embed=lambda df: df.withColumn("vec", F.when(F.col("body") != "wrong", numbers)), dim=2)
    assert incremental.index_directory(spark, str(files), root, options) == {"documents": 2, "written": 1, "reused": 0, "failed": 1, "chunks_written": 2}
    tables = store.read_index(spark, root)
    assert sorted((r["body"], r["vec"], r["dim"]) for r in tables["chunks"].collect()) == [("fine", [4.0, 1.0], 2), ("good", [4.0, 1.0], 2)]
    assert [r["failure_kind"] for r in tables["failures"].collect()] == ["badOutput"] and tables["generations"].first()["vector_dim"] == 2
    number = store.current_version(spark, root)
    assert incremental.index_directory(spark, str(files), root, options)["reused"] == 1 and store.current_version(spark, root) == number  # nothing changed, the failure neither


def test_a_batch_of_a_stream_is_taken_once(spark, tmp_path):
    root = str(tmp_path / "index")
    incremental.apply_batch(spark, parsed(spark, ("a.txt", "x", "h", 0)), root, stream=("s", 4))
    again = incremental.apply_batch(spark, parsed(spark, ("a.txt", "y", "h2", 1)), root, stream=("s", 4))
    assert again["written"] == 1 and bodies(spark, root) == [("a.txt", "x")]
    incremental.apply_batch(spark, parsed(spark, ("a.txt", "y", "h2", 1)), root, stream=("s", 5))
    assert bodies(spark, root) == [("a.txt", "y")]


def test_clear_and_rebuild(spark, tmp_path):
    root = str(tmp_path / "index")
    assert store.clear_index(spark, root) is None
    store.write_index(spark, root, rows(spark, ("d1", "k1"), ("d2", "k2")))
    assert store.read_index(spark, root)["keys"].count() == 2
    store.clear_index(spark, root)
    tables = store.read_index(spark, root)
    assert all(df.count() == 0 for df in tables.values()) and "body" in tables["chunks"].columns
    store.write_index(spark, root, rows(spark, ("d3", "k3")))
    assert [r["document_id"] for r in store.read_index(spark, root)["chunks"].collect()] == ["d3"]
    assert store.vacuum(spark, root, keep=1, min_age_s=-1) > 0 and store.read_index(spark, root)["chunks"].count() == 1


def test_the_data_source_reads_the_buckets_of_its_filter(spark, tmp_path):
    from quarry.sources import datasource

    root = str(tmp_path / "index")
    names = [f"d{i}" for i in range(60)] + ["é", ""]
    store.write_index(spark, root, rows(spark, *[(n, f"k{n}") for n in names]))
    buckets = {r["d"]: r["b"] for r in spark.createDataFrame([(n,) for n in names], "d string").withColumn("b", store.bucket_of("d")).collect()}
    assert {n: datasource.spark_bucket(n, store.BUCKETS) for n in names} == buckets
    datasource.register(spark)
    load = lambda **options: spark.read.format("quarry_index").options(**options).load(root)
    assert sorted(r["document_id"] for r in load().collect()) == sorted(names)
    one = load().where("document_id = 'd7'")
    assert [r["body"] for r in one.collect()] == ["body d7"] and one.rdd.getNumPartitions() == 1
    assert [r["document_id"] for r in load(table="keys").where("document_key in ('kd3', 'kd4')").orderBy("document_id").collect()] == ["d3", "d4"]
    assert load().where("document_id = 'd7' and document_id = 'd8'").count() == 0 and load(table="failures").count() == 0


def test_a_path_filter_reads_the_files_that_meet_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FILE_ROWS", 5)
    root = str(tmp_path / "index")
    table = spark.range(400).select(F.concat(F.lit("d"), F.col("id") % 3).alias("document_id"), F.concat(F.lit("k"), "id").alias("document_key"), F.col("id").alias("row_id"), F.lit("b").alias("body"), F.format_string("folder%02d/%03d.txt", F.floor(F.col("id") / 10), F.col("id")).alias("relative_path"))
    table = table.select("*", *[F.lit("x").alias(c) for c in ("model_id", "content_hash", "parser_name", "parser_version", "chunker_version")], F.lit(0).alias("dim"))
    store.write_index(spark, root, table)
    found = store.read_below(spark, root, "folder07/")
    assert sorted(r["row_id"] for r in found.collect()) == list(range(70, 80))
    assert 1 <= len(found.inputFiles()) <= 6 < len(store.read_index(spark, root)["chunks"].inputFiles())
    assert store.read_below(spark, root, "folder07/073.txt").count() == 1 and store.read_below(spark, root, "none").count() == 0
