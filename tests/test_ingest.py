import pytest

from quarry.operators import ingest
from quarry.sources import files, records, store


def decoded(spark, data, limit=1 << 20):
    r = ingest.decode_text(spark.createDataFrame([(bytearray(data),)], "content binary"), limit).first()
    return r["body"], r["warnings"], r["outcome"]


@pytest.mark.parametrize(
    ("data", "limit", "want"),
    [
        ("a\r\nb\rc".encode(), 99, ("a\nb\nc", [], "ok")),
        (b"\xef\xbb\xbfhi", 99, ("hi", [], "ok")),
        (b"\xff\xfe" + "héé".encode("utf-16-le") + b"\x01", 99, ("héé", [], "ok")),
        (b"\xfe\xff" + "hé".encode("utf-16-be"), 99, ("hé", [], "ok")),
        ("中文".encode("gbk"), 99, ("中文", ["encoding-fallback:gbk"], "ok")),
        (b"", 99, ("", [], "ok")),
        ("ab中".encode(), 4, ("ab", ["truncated:4"], "partial")),
        (b"\x81\xff\x80", 99, ("��", ["encoding-fallback:gbk"], "ok")),
    ],
)
def test_decode(spark, data, limit, want):
    assert decoded(spark, data, limit) == want


def test_scan(spark, tmp_path):
    for name in ("a.txt", "B.TXT", ".hidden.txt", "~$x.docx", "sub/c.pdf", "sub/deep/d.png", "no.exe", ".git/e.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    got = {r["relative_path"] for r in files.scan_files(spark, str(tmp_path), max_depth=1).collect()}
    assert got == {"a.txt", "B.TXT", "sub/c.pdf"}


def test_duplicates_and_outcomes(spark):
    rows = spark.createDataFrame([("b.txt", "h"), ("a.txt", "h"), ("c.txt", None), ("d.txt", None)], "relative_path string, content_hash string")
    got = {r["relative_path"]: r["error_message"] for r in ingest.mark_duplicate_content(rows).collect()}
    assert got == {"a.txt": None, "b.txt": "Duplicate content of a.txt.", "c.txt": None, "d.txt": None}


def test_xhtml_pages(spark):
    html = '<html><div class="page"><p>A &amp; B</p>x<br/>y</div><div class="the page"><p>&#67;&#x44;</p></div><div class="pages">z</div></html>'
    rows = ingest.split_xhtml_pages(spark.createDataFrame([(html,), ("<p>only</p>",), (None,)], "html string"), "html").collect()
    assert [(r["page_number"], r["text"]) for r in rows] == [(1, "A & B\nx\ny"), (2, "CD\nz"), (1, "only"), (1, "")]


def test_records(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"question":"q","answers":["a"]}\n\n{"question":"","answers":["a"]}\n{"question":"q","answers":[""]}\n')
    good, bad = records.read_pairs(spark, str(p))
    assert good.count() == 1 and bad.count() == 2


def test_run_label(spark):
    rows = spark.createDataFrame([("a", "ok", True, None), ("b", "partial", True, None), ("c", "skipped", False, "permissionDenied")], "relative_path string, status string, indexable boolean, failure_kind string")
    outcomes = spark.createDataFrame([("a", "indexed")], "relative_path string, outcome string")
    got, one = ingest.library_run_rollup(rows, outcomes, cancelled=True)
    assert {r["relative_path"]: r["status"] for r in got.collect()} == {"a": "indexed", "b": "cancelled", "c": "failed"}
    assert one.first()["label"] == "cancelled"


def test_stream_reuses_and_replaces(spark, tmp_path):
    from datetime import datetime

    from quarry.streaming import incremental

    root = str(tmp_path / "index")

    def put(*rows):
        rows = [(*r[:3], "p", "1", datetime(2024, 1, r[3] if len(r) > 3 else 1)) for r in rows]
        spark.createDataFrame(rows, incremental.INCOMING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.incremental_index_stream(spark, str(tmp_path / "in"), root, str(tmp_path / "cp")).awaitTermination()
        return store.read_index(spark, root)

    def paths(tables):
        return sorted((r["relative_path"], r["body"]) for r in tables["chunks"].collect())

    first = put(("a.txt", "one two", "h1"), ("b.txt", "离线检索", "h2"), ("c.txt", "one two", "h1"))
    assert paths(first) == [("a.txt", "one two"), ("b.txt", "离线检索")] and first["postings"].count() == 3  # c repeats a
    assert first["chunks"].count() == first["chunks"].select("row_id").distinct().count()
    version = store.current_version(spark, root)
    put(("a.txt", "one two", "h1"))
    assert store.current_version(spark, root) == version
    last = put(("b.txt", "new text", "h3", 3), ("b.txt", "older text", "h9", 2))
    assert paths(last) == [("a.txt", "one two"), ("b.txt", "new text")]
    assert {r["content_hash"] for r in last["generations"].collect()} == {"h1", "h3"} and last["postings"].count() == 0
    first_version, last_version = (store.version(spark, root, n) for n in (1, store.current_version(spark, root)))
    assert any(last_version.held.get(k) == folder for k, folder in first_version.held.items() if k.startswith("chunks/"))  # a's bucket was not written again
    moved = put(("b.txt", "one two", "h1", 4))
    assert paths(moved) == [("a.txt", "one two")]  # b now repeats a document of the index
    before = moved["chunks"].count()
    assert store.vacuum(spark, root, keep=1) == 0 < store.vacuum(spark, root, keep=1, min_age_s=-1) and store.read_index(spark, root)["chunks"].count() == before
