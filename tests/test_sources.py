import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import fingerprints, jsonl, lines, small_files, tables, text_files


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "a root+x"
    for name, text in {
        "b.txt": " second \n", "a/z.txt": "third", "a.txt": "\xa0first\n", "blank.txt": " \n", "note.md": "no", "a-b/y é.txt": "fourth\nline",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    return root


def test_flat_folder_and_single_file(spark, tree):
    rows = {r["title"]: (r["text"], r["source"]) for r in text_files.read_text_sources(spark, str(tree)).collect()}
    assert rows == {"a": ("first", str(tree / "a.txt")), "b": ("second", str(tree / "b.txt"))}
    assert text_files.read_text_sources(spark, str(tree / "a.txt")).count() == 1
    with pytest.raises(ValueError, match="no .txt"):
        text_files.read_text_sources(spark, str(tree / "none")) if (tree / "none").mkdir() is None else None


def test_tree_order_ids_and_metadata(spark, tree):
    rows = text_files.read_text_tree(spark, str(tree)).orderBy("position").collect()
    paths = ["a/z.txt", "a-b/y é.txt", "a.txt", "b.txt"]  # by path component: "a" before "a-b"
    assert [r["source"] for r in rows] == paths and [r["position"] for r in rows] == [0, 1, 2, 3]
    key = f"{tree}:a/z.txt\nthird"
    assert rows[0]["document_id"] == "doc-" + hashlib.sha256(key.encode()).hexdigest()[:16]
    assert json.loads(rows[1]["metadata"]) == {"relative_path": "a-b/y é.txt"} and rows[1]["title"] == "y é"
    assert rows[0]["content_digest"] == hashlib.sha256(b"third").hexdigest()


def test_source_paths_stay_inside():
    assert text_files.check_source_path("/data", "x/y.txt") == "/data/x/y.txt"
    assert text_files.check_source_path("/data", "/data/x") == "/data/x"
    for path in ("../up.txt", "/etc/passwd", "x/../../y", " ", "a.pdf"):
        with pytest.raises(ValueError):
            text_files.check_source_path("/data", path)


def test_line_numbers_over_splits(spark, tmp_path):
    files = {name: [f"{name} {i}" + "x" * (i % 70) if i % 7 else "" for i in range(n)] for name, n in (("one", 3000), ("two", 1), ("three", 777))}
    for name, rows in files.items():
        (tmp_path / f"{name}.txt").write_bytes(("\r\n" if name == "three" else "\n").join(rows).encode() + b"\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        read = lines.read_lines(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 8
        found = {}
        for row in lines.number_lines(read).collect():
            found.setdefault(row["path"].rsplit("/", 1)[1][:-4], {})[row["line"]] = row["value"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {name: dict(enumerate(rows, 1)) for name, rows in files.items()}


CORPUS = """{"id":"a 1","title":"One","text":" first "}

{"content":"second","source":"s","url":"http://u","metadata":{"k":[1,null]}}
{"text":5,"title":true,"id":null}
{"text":"  "}
not json
[1]
{"title":"no text"}
{"text":null,"content":"unused"}
"""


def test_corpus_jsonl(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text(CORPUS)
    docs, bad = jsonl.read_corpus_jsonl(spark, str(path))
    rows = docs.orderBy("position").collect()
    assert [(r["title"], r["text"], r["source"]) for r in rows] == [
        ("One", "first", f"{path}:1"), ("line-3", "second", "s"), ("True", "5", f"{path}:4"), ("line-9", "None", f"{path}:9"),
    ]
    assert [r["position"] for r in rows] == [0, 1, 2, 3]
    key = f"{path}:3:s\nsecond"
    assert [r["document_id"] for r in rows[:2]] == ["a_1", "doc-" + hashlib.sha256(key.encode()).hexdigest()[:16]]
    assert json.loads(rows[1]["metadata"]) == {"url": "http://u", "metadata": {"k": [1, None]}, "record_source": "s"}
    assert rows[0]["metadata"] is None
    assert {(r["line"], r["error"]) for r in bad.collect()} == {(6, "malformed_json"), (7, "not_an_object"), (8, "missing_text")}
    with pytest.raises(ValueError, match=f"malformed_json on line 6 of {path}"):
        jsonl.fail_on_errors(bad)
    assert jsonl.estimate_records(spark.read.text(str(path))).first()[0] == 4


def test_values_are_spoken_as_the_source_wrote_them(spark, tmp_path):
    values = [1.0, 1.50, 1e5, 1e16, -0.0, 12345678901234567890123, ["a", 1, None], {"k": [True, 2.50], "b": "é"}, True, None, "plain", [], {}]
    given = [json.dumps({"title": v, "text": v, "source": v, "id": v, "url": v}) for v in values]
    given += ['{"text": "first", "text": "last", "title": "t"}', '{"text": NaN, "title": 1}', "[1, 2]", "5", "{broken", '{"title": 3}', '{"text": "x", "metadata": {"b": 1.0, "a": [2]}}']
    path = tmp_path / "v.jsonl"
    path.write_text("\n".join(given) + "\n")
    docs, bad = jsonl.read_corpus_jsonl(spark, str(path))
    expected = []
    for line in given:
        try:
            data = json.loads(line)
        except ValueError:
            continue
        if isinstance(data, dict) and "text" in data:
            expected.append((str(data.get("title", f"line-{given.index(line) + 1}")), str(data["text"]), data.get("id")))
    found = docs.orderBy("position").collect()
    assert [(r["title"], r["text"]) for r in found] == [(t, x) for t, x, _ in expected]
    assert [r["document_id"].startswith("doc-") for r in found] == [i is None for *_, i in expected]
    packed = {r["text"]: json.loads(r["metadata"]) for r in found if r["metadata"]}
    assert packed["1.5"] == {"url": 1.5, "record_source": 1.5} and packed["x"] == {"metadata": {"b": 1.0, "a": [2]}}
    assert sorted((r["line"], r["error"]) for r in bad.collect()) == [(16, "not_an_object"), (17, "not_an_object"), (18, "malformed_json"), (19, "missing_text")]
    good, bad = jsonl.read_simple_jsonl(spark, str(path))
    assert {r["title"] for r in good.collect()} >= {"1.0", "['a', 1, None]", "{'k': [True, 2.5], 'b': 'é'}", "1e+16"}


def test_simple_jsonl(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    path.write_text('{"title":"T","text":"x"}\n{"title":"no"}\n\n{"title":"U","text":"y","source":"z"}\n{"title":"a b","text":"c"}\n', encoding="utf-8")
    good, bad = jsonl.read_simple_jsonl(spark, str(path))
    assert {tuple(r) for r in good.collect()} == {("T", "x", str(path)), ("U", "y", "z"), ("a b", "c", str(path))}
    assert [(r["line"], r["error"]) for r in bad.collect()] == [(2, "missing_title_or_text")]
    path.write_text('{"title":"a b","text":"c"}\n', encoding="utf-8")  # a raw line separator ends the line
    good, bad = jsonl.read_simple_jsonl(spark, str(path))
    assert good.count() == 0 and {r["error"] for r in bad.collect()} == {"malformed_json"}


def test_chunk_table_check(spark, tmp_path):
    path = tmp_path / "chunks.jsonl"
    row = {"id": "i", "title": "t", "source": "s", "chunk_index": 0, "text": "x", "sha256": "h"}
    path.write_text("\n".join(json.dumps(r) for r in (row, {**row, "id": "j", "extra": 1}, {"id": "k", "title": "t"})))
    good, bad = tables.read_chunks(spark, str(path))
    assert {r["id"] for r in good.collect()} == {"i", "j"}
    assert [(r["id"], r["missing"]) for r in bad.collect()] == [("k", ["source", "chunk_index", "text", "sha256"])]


def summed(rows):
    """The table digest, by hand."""
    digests = [hashlib.sha256("".join(hashlib.sha256(str(x).encode()).hexdigest() for x in row).encode()).hexdigest() for row in rows]
    sums = [sum(int(d[15 * p : 15 * p + 15], 16) for d in digests) for p in range(4)]
    return hashlib.sha256(":".join(map(str, [len(rows), *sums])).encode()).hexdigest()


def test_text_tree_fingerprint(spark, tree):
    entries = [(p.relative_to(tree).as_posix(), p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tree.rglob("*.txt")]
    row = fingerprints.text_tree_fingerprint(spark, str(tree)).first()
    assert (row["fingerprint"], row["file_count"], row["total_bytes"]) == (summed(entries), len(entries), sum(e[1] for e in entries))


def test_line_file_fingerprint_sees_order_and_line_ends(spark, tmp_path):
    found = set()
    for text in ("a\nb\n", "b\na\n", "a\r\nb\r\n", "a\nb\n\n", "a\nc\n"):
        path = tmp_path / "x.jsonl"
        path.write_bytes(text.encode())
        found.add(fingerprints.source_file_fingerprint(spark, str(path)))
    assert len(found) == 5
    path.write_bytes(b"a\nb\n")
    assert fingerprints.source_file_fingerprint(spark, str(path)) == summed([("x.jsonl", 1, "a"), ("x.jsonl", 2, "b")])


def test_stream_digest(spark, tmp_path, monkeypatch):
    path = tmp_path / "dump bytes.bin"
    path.write_bytes(b"0123456789" * 2_000_000)
    for name in (str(path), f"file://{path}".replace(" ", "%20")):
        row = fingerprints.stream_digest(spark, name).first()
        assert (row["size"], row["sha256"], row["sha1"]) == (20_000_000, hashlib.sha256(path.read_bytes()).hexdigest(), hashlib.sha1(path.read_bytes()).hexdigest())


def test_table_fingerprint_ignores_layout_but_not_content(spark):
    rows = [(i % 7, f"t{i % 5}") for i in range(100)] + [(None, "n")]
    first = spark.createDataFrame(rows, "a int, b string")
    again = spark.createDataFrame(rows[::-1], "a int, b string").repartition(7)
    other = spark.createDataFrame(rows[:-1] + [(0, "n")], "a int, b string")
    digest = [fingerprints.table_fingerprint(t, ["a", "b"]).first()["fingerprint"] for t in (first, again, other)]
    assert digest[0] == digest[1] != digest[2]


def test_checksums(spark, tmp_path):
    (tmp_path / "d.xml").write_bytes(b"dump")
    (tmp_path / "e.xml").write_bytes(b"other")
    files = fingerprints.file_digests(spark, str(tmp_path))
    expected = spark.createDataFrame([("d.xml", "sha1", hashlib.sha1(b"dump").hexdigest().upper()), ("e.xml", "sha256", "00")], "name string, algorithm string, checksum string")
    assert {r["name"]: r["verdict"] for r in fingerprints.verify_checksums(files, expected).collect()} == {"d.xml": "ok", "e.xml": "mismatch"}


def test_text_files_are_written_by_the_tasks(spark, tmp_path):
    rows = [("a/x.txt", "one\ntwo"), ("a/x.txt", None), ("b/é.txt", "ü"), ("c.txt", "")]
    table = spark.createDataFrame(rows, "file string, value string").coalesce(1)
    for root in (str(tmp_path / "plain"), f"file:{tmp_path}/uri"):
        text_files.write_text_files(table, root)
        text_files.write_text_files(table, root)  # a repeated task overwrites its files
    for name in ("plain", "uri"):
        found = {str(p.relative_to(tmp_path / name)): p.read_bytes() for p in (tmp_path / name).rglob("*") if p.is_file()}
        assert found.pop("a/x.txt") in (b"one\ntwo\n\n", b"\none\ntwo\n")
        assert found == {"b/é.txt": "ü\n".encode(), "c.txt": b"\n"}  # and no file of Spark's


@pytest.fixture
def odd_tree(tmp_path):
    """Files with all kinds of names and line ends, large and compressed ones, and what Spark does not list."""
    root = tmp_path / "odd"
    files = {
        "plain.txt": b"one\ntwo\n", "no end.txt": b"one\r\ntwo\rthree", "100% + #1?.txt": b"\n\nx\n\n", "[a]{b}.txt": b"y" * 300 + b"\nz",
        "é ü.txt": b"\xef\xbb\xbfmark\n", "bytes.txt": b"a\xff\xfeb\n", "empty.txt": b"", ".hidden.txt": b"h", "_hidden.txt": b"h",
        "large[1].txt": b"line of a large file\r\n" * 40, "other.dat": b"d\n", "k=1/in.txt": b"p1\np2", "k=2/in.txt": b"p3",
        "k=2/_x/in.txt": b"never", "mark.txt": b"\xef\xbb\xbf",
    }
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "packed.txt.gz").write_bytes(gzip.compress(b"g1\ng2\n"))
    return root


def _both_ways(monkeypatch, read):
    found = []
    for many in (1, 1 << 40):
        monkeypatch.setattr(small_files, "MANY_FILES", many)
        monkeypatch.setattr(small_files, "WHOLE_FILE_BYTES", 200)
        found.append(sorted(map(tuple, read().collect())))
    return found


@pytest.mark.parametrize("line_sep", [None, "\n"])
def test_small_files_are_read_as_spark_reads_them(spark, odd_tree, monkeypatch, line_sep):
    for folder in ("k=1", "k=2"):  # Spark does not read a folder of files and of key=value folders
        (odd_tree / folder).rename(odd_tree.parent / folder)

    def numbered():
        rows = lines.number_lines(lines.read_lines(spark, str(odd_tree), line_sep))
        return rows.select(small_files.one_form(F.col("path")), "line", F.hex(F.col("value").cast("binary")))

    ours, theirs = _both_ways(monkeypatch, numbered)
    assert ours == theirs and len(ours) > 50
    parts = _both_ways(monkeypatch, lambda: lines.place_lines(lines.read_lines(spark, str(odd_tree), line_sep))[0].select("place", small_files.one_form(F.col("path"))))
    assert parts[0] == parts[1]


@pytest.mark.parametrize("recursive", [False, True])
@pytest.mark.parametrize("pattern", ["", "/*"])
def test_small_whole_files_are_read_as_spark_reads_them(spark, odd_tree, monkeypatch, recursive, pattern):
    if not recursive and not pattern:
        (odd_tree / "k=1").rename(odd_tree.parent / "k=1")
        (odd_tree / "k=2").rename(odd_tree.parent / "k=2")

    def texts():
        return text_files._whole_files(spark, f"{odd_tree}{pattern}", recursive).select(small_files.one_form(F.col("uri")), F.hex(F.col("text").cast("binary")))

    ours, theirs = _both_ways(monkeypatch, texts)
    visible = [row for row in theirs if "hidden" not in row[0]]  # a pattern's own matches may be hidden files, for Spark
    assert ours == visible and len(ours) >= 8


def test_many_small_files_are_not_listed_by_the_driver(spark, tmp_path, monkeypatch):
    for i in range(20):
        (tmp_path / f"d={i}").mkdir()
        (tmp_path / f"d={i}" / "a.txt").write_text(f"text {i}\nmore")
    monkeypatch.setattr(small_files, "MANY_FILES", 10)
    for frame in (lines.read_lines(spark, str(tmp_path)), text_files.read_text_sources(spark, f"{tmp_path}/*")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "FileScan text" not in plan and "MapInArrow" in plan
    assert spark.read.text(str(tmp_path / "d=3")).count() == 2 and lines.read_lines(spark, str(tmp_path)).count() == 40
