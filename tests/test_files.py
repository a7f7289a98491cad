"""A folder of files of several kinds: rows of the readable ones, a reason for each of the others."""

import json

import pytest

from ledgerloom.sources import files, spans


@pytest.fixture
def folder(tmp_path):
    page = {"number": 1, "spans": [{"text": "PAN", "bbox": {"x1": 0, "y1": 0, "x2": 9, "y2": 9}, "order": 0}]}
    (tmp_path / "a.json").write_text(json.dumps({"packet_id": "p1", "documents": [{"path": "x.pdf", "pages": [page]}, {"path": "y.pdf", "pages": [page, page | {"number": 2}]}]}))
    (tmp_path / "b.TXT").write_bytes("Legal Name: Acme\r\n\r\n  GSTIN\f\fPAN é".encode())
    (tmp_path / "broken.json").write_text('{"packet_id": "p2", "documents": [{"path"')
    (tmp_path / "other.json").write_text('{"n": 1}')
    (tmp_path / "latin.txt").write_bytes(b"\xff\xfe\xe9")
    (tmp_path / "scan.xyz").write_bytes(b"x")
    (tmp_path / "plain").write_bytes(b"x")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "c.txt").write_text("deep")
    return str(tmp_path)


def names(df):
    return {r["path"].rsplit("/", 1)[-1]: r for r in df.collect()}


def test_rows_and_reasons(spark, folder):
    got = files.load(spark, folder)
    assert {n: (r["reason"], r["detail"]) for n, r in names(got.errors).items()} == {
        "broken.json": ("broken", "not a document set"), "other.json": ("broken", "not a document set"), "latin.txt": ("broken", "not UTF-8"),
        "scan.xyz": ("unsupported", "no reader for .xyz"), "plain": ("unsupported", "no reader for a file without suffix"),
    }
    read = names(got.sets)
    assert read.keys() == {"a.json", "b.TXT"} and read["a.json"]["packet_id"] == "p1" and [d["path"] for d in read["a.json"]["documents"]] == ["x.pdf", "y.pdf"]
    flat = [(r["page"], r["order"], r["text"], r["source"], r["synthetic_bbox"]) for r in spans.spans(got.sets.where("path like '%b.TXT'")).orderBy("span_id").collect()]
    assert flat == [(1, 0, "Legal Name: Acme", "text", True), (1, 2, "  GSTIN", "text", True), (3, 0, "PAN é", "text", True)]
    assert spans.spans(got.sets.where("path like '%a.json'")).count() == 3
    box = spans.spans(got.sets.where("path like '%b.TXT'")).where("order = 2").first()
    assert (box["x1"], box["y1"], box["x2"], box["y2"]) == (150.0, 150.0 + 88.0, 150.0 + 15.0 * 7, 150.0 + 132.0)


def test_wanted_files(spark, folder):
    wanted = spark.createDataFrame([("b.TXT",), ("gone.json",), ("below/c.txt",), ("b.TXT",)], "name string")
    flat = files.load(spark, folder, wanted)
    assert {n: r["reason"] for n, r in names(flat.errors).items()} == {"gone.json": "missing", "c.txt": "missing"} and names(flat.sets).keys() == {"b.TXT"}
    deep = files.load(spark, folder, wanted, recursive=True)
    assert names(deep.sets).keys() == {"b.TXT", "c.txt"} and names(deep.errors).keys() == {"gone.json"}


def test_unsupported_files_can_be_refused(spark, folder):
    with pytest.raises(ValueError, match="unsupported files"):
        files.load(spark, folder, skip_unsupported=False)
