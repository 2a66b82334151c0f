import io
import random
import struct
import zipfile
import zlib
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.operators.catalog import Catalog, described
from tessera.operators.index import load_index
from tessera.operators.patterns import counts_by_type
from tessera.sources import archive, extract, files
from tessera.sources.lines import large_documents, line_chunks, splits
from tessera.sources.slices import slices
from tessera.streaming import index as st


def deflated(data):
    d = zlib.compressobj(wbits=-15)
    return d.compress(data) + d.flush()


def pdf(content, raw=True):
    return b"%PDF-1.0\n1 0 obj /Filter\nstream\r\n" + (deflated(content) if raw else zlib.compress(content)) + b"\nendstream"


def docx(xml):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", xml)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {
        "a.txt": b"plain text",
        "latin.txt": b"A \xe5",
        "empty.txt": b"",
        "sub/p.pdf": pdf(b"BT (Hello \\134PDF) Tj <0041> Tj ET"),
        "sub/d.docx": docx("<w:p><w:t>hello</w:t><w:binData>AAAA</w:binData></w:p>"),
        "bad.docx": b"PK\x03\x04 not a document",
    }.items():
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_documents(spark, folder):
    rows = {r["path"].rsplit("/", 1)[1]: (bytes(r["body"]).decode(), r["kind"], r["extract_status"]) for r in files.documents(spark, folder).collect()}
    assert rows == {
        "a.txt": ("plain text", "text", "ok"),
        "latin.txt": ("A å", "unknown", "ok"),
        "p.pdf": ("Hello \\PDF \0A ", "pdf", "ok"),
        "d.docx": ("hello", "docx", "ok"),
        "bad.docx": ("", "docx", "empty"),
    }


def test_exclude_and_outputs(spark, folder):
    names = lambda **o: sorted(r["path"].rsplit("/", 1)[1] for r in files.files(spark, folder, **o).collect())
    assert names(exclude=["*.docx"], outputs=[f"{folder}/sub"]) == ["a.txt", "latin.txt"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.files(spark, f"{folder}/none").collect()


def test_pdf_streams():
    assert extract.pdf_text(pdf(b"plain words", raw=False)) == "plain words "
    assert extract.pdf_text(pdf("(å)".encode("latin-1"))) == "å "
    assert extract.pdf_text(b"%PDF stream never ends") == ""
    assert extract.inflated(zlib.compress(b"x" * 100), 50) is None


def test_counts_by_type(spark, folder):
    found = files.files(spark, folder)
    assert {tuple(r) for r in counts_by_type(found, ["l", "<w:t>"]).collect()} == {("compressedStreams", 1), ("l", 3), ("<w:t>", 1)}


def test_stdin_and_ndjson(spark, tmp_path):
    docs = files.documents_from(files.from_stdin(spark, io.BytesIO("{é}  ".encode())))
    files.write_ndjson(docs, f"{tmp_path}/out")
    assert [tuple(r) for r in spark.read.json(f"{tmp_path}/out").collect()] == [("stdin", "{é}  ")]
    assert files.from_stdin(spark, io.BytesIO(b"")).collect() == []


def test_archives(spark, tmp_path):
    rows = [("a/å.txt", bytearray(b"one")), ("b", bytearray(b"")), ("c", bytearray(b"\x02\x03" * 9))]
    archive.write_archives(spark.createDataFrame(rows, "path string, body binary").repartition(2), f"{tmp_path}/r")
    assert sorted((r["path"], bytes(r["body"])) for r in archive.read_archives(spark, f"{tmp_path}/r").collect()) == sorted((p, bytes(b)) for p, b in rows)


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in kept:
        spark.conf.set(k, "400")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_archives_in_many_splits(spark, tmp_path, small_splits):
    """Bodies that hold the bytes between records, lengths that do, archives in archives, and damage of all kinds."""
    rng = random.Random(6)
    pieces = [b"\x03\x02", b"\x02", b"\x03", b"word ", b"\x00\x00\x00\x01a", b"\xff"]
    for n in range(7):
        records = [(f"p{i}" * rng.choice([1, 1, 40]), b"".join(rng.choices(pieces, k=rng.randint(0, 60)))) for i in range(25)]
        records[3] = ("inner", archive.MAGIC + archive.VERSION + b"".join(archive.packed(p, b) for p, b in records[5:15]))
        records[17] = ("sized", b"x" * 770)  # this length has them
        data = bytearray(archive.MAGIC + archive.VERSION + b"".join(archive.packed(p, b) for p, b in records))
        if n >= 4:
            for _ in range(rng.randint(1, 6)):
                at = rng.randrange(6, len(data))
                if rng.random() < 0.5:
                    data[at] = rng.choice([0, 2, 3, 255])
                else:
                    del data[at : at + rng.randint(1, 30)]
        if n == 5:
            data += b"\x03\x02"
        (tmp_path / f"{n}.records").write_bytes(data)
    want = [list(archive.unpacked((tmp_path / f"{n}.records").read_bytes())) for n in range(7)]
    assert [len(w) for w in want[:4]] == [25] * 4 and splits(spark, f"{tmp_path}/1.records", end="\x03\x02").select("split").distinct().count() > 5
    # all files at once, and one by itself
    assert sorted((r["path"], bytes(r["body"])) for r in archive.read_archives(spark, str(tmp_path)).collect()) == sorted(x for w in want for x in w)
    assert sorted((r["path"], bytes(r["body"])) for r in archive.read_archives(spark, f"{tmp_path}/5.records").collect()) == sorted(want[5])
    (tmp_path / "other").write_bytes(b"JUNK")
    with pytest.raises(Exception, match="not an archive"):
        archive.read_archives(spark, f"{tmp_path}/other").collect()


def test_written_archives_are_the_format(spark, tmp_path):
    rows = [(f"é{i}", bytearray(bytes(range(256)) * (i % 3))) for i in range(50)] + [(None, None)]
    archive.write_archives(spark.createDataFrame(rows, "path string, body binary").repartition(3), f"{tmp_path}/a")
    found = [r for f in (tmp_path / "a").glob("part-*") for r in archive.unpacked(f.read_bytes())]
    assert sorted(found) == sorted((p or "", bytes(b or b"")) for p, b in rows)
    assert all(f.read_bytes().endswith(b"\x03") for f in (tmp_path / "a").glob("part-*"))
    archive.write_archives(spark.createDataFrame([], "path string, body binary"), f"{tmp_path}/none")
    assert archive.read_archives(spark, f"{tmp_path}/none").count() == 0


def test_lines_of_split_files(spark, tmp_path, small_splits):
    rng = random.Random(7)
    for n in range(5):
        lines = ["é" * rng.randint(0, 90) + rng.choice(["", "\r"]) for _ in range(60)]
        (tmp_path / f"{n}.txt").write_bytes("\n".join(lines).encode() + rng.choice([b"", b"\n"]))
    chunks = line_chunks(spark, str(tmp_path), chunk_bytes=64).collect()
    assert len({(r["path"], r["split"], r["part"]) for r in chunks}) == len(chunks) > 50
    for n in range(5):
        mine = sorted((r["split"], r["part"], bytes(r["body"])) for r in chunks if r["path"].endswith(f"/{n}.txt"))
        assert b"\n".join(b for _, _, b in mine) == (tmp_path / f"{n}.txt").read_bytes().removesuffix(b"\n")
    docs = large_documents(spark, str(tmp_path), chunk_bytes=64)
    assert docs.count() == docs.select("doc_id").distinct().count() == len(chunks)


def test_a_file_of_more_than_two_gigabytes(spark, tmp_path):
    """Sparse, a line in each 16 MB of it; read as Spark reads its lines."""
    path, step = tmp_path / "large.txt", 16 << 20
    with path.open("wb") as f:
        for i in range(140):
            f.seek(i * step)
            f.write(b"line %d\n" % i)
        f.truncate(140 * step)
    chunks = line_chunks(spark, str(path), chunk_bytes=1).select("split", F.octet_length("body").alias("n"), F.crc32("body").alias("c"))
    lines = spark.read.option("lineSep", "\n").text(str(path)).select(F.octet_length("value").alias("n"), F.crc32(F.col("value").cast("binary")).alias("c"))
    found = chunks.collect()
    assert path.stat().st_size > 2 << 30 and len({r["split"] for r in found}) > 10
    assert sorted((r["n"], r["c"]) for r in found) == sorted(map(tuple, lines.collect()))


def test_damaged_archives():
    good, bad = archive.packed("a", b"x"), b"\x02" + struct.pack(">I", 1 << 30)
    data = archive.MAGIC + archive.VERSION
    assert list(archive.unpacked(data + good + bad + archive.packed("b", b"y"))) == [("a", b"x"), ("b", b"y")]
    assert list(archive.unpacked(data)) == [] and list(archive.unpacked(data + good[:-1])) == []
    with pytest.raises(ValueError, match="archive"):
        list(archive.unpacked(b"JUNK"))


def test_catalog(spark, tmp_path):
    catalog = Catalog(spark, f"{tmp_path}/catalog")
    assert catalog.list().collect() == []
    now = datetime(2026, 1, 2)
    row = lambda i, name: spark.createDataFrame([(i, name, f"/data/{i}", f"{tmp_path}/ix{i}", now, datetime(2026, 1, 1), ["*.tmp"])], catalog.list().schema)
    catalog.put(row("1", "old"))
    catalog.put(row("2", ""))
    catalog.put(row("1", "new"))
    (tmp_path / "ix2").mkdir()
    stats = spark.createDataFrame([("1", 2048), ("1", 1)], "id string, body_len long")
    shown = {r["id"]: tuple(r)[1:] for r in described(catalog.list(), stats, now).collect()}
    assert shown == {"1": ("new", "2", "2.0 KB", "1d ago"), "2": ("2", "0", "0.0 B", "1d ago")}
    catalog.delete("2")
    assert [r["name"] for r in catalog.list().collect()] == ["new"] and not (tmp_path / "ix2").exists()


def test_index_stream(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")
    for name in ("more.txt", None):
        st.index_stream(st.stream_files(spark, folder), f"{out}/index", f"{out}/checkpoint").awaitTermination()
        if name:
            open(f"{folder}/{name}", "w").write("plain more")
    posts = spark.read.parquet(f"{out}/index/postings")
    assert posts.where("term = 'plain'").count() == 2 and posts.where("term = 'more'").count() == 1
    assert spark.read.parquet(f"{out}/index/stats").count() == 6
    found = search.search(load_index(spark, f"{out}/index"), "plain", k=5).collect()
    assert len(found) == 2 and all("plain" in r["snippet"] for r in found)


def test_level_stream(spark, tmp_path):
    rows = [(datetime(2026, 1, 1, 10, m), f'{{"level": "{level}"}}') for m, level in ((1, "info"), (5, "warn"), (9, "info"))]
    spark.createDataFrame(rows, "ts timestamp, value string").write.parquet(f"{tmp_path}/lines")
    lines = spark.readStream.schema("ts timestamp, value string").parquet(f"{tmp_path}/lines")
    query = st.level_stream(lines).writeStream.format("memory").queryName("levels").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination()
    assert sorted((r["label"], r["n"]) for r in spark.table("levels").collect()) == [("info", 2), ("warn", 1)]


def test_config(spark, tmp_path):
    from tessera.sources import config

    path = f"{tmp_path}/settings.json"
    assert config.load(spark, path) == config.Config()
    mine = config.Config("a.rec", "i", 9000, config.ModelConfig("ollama", None, "small", "Be brief."))
    config.save(spark, path, mine)
    assert config.load(spark, path) == mine
    for odd in ("", "{", "[1]", "null", '{"port": "no", "index_path": 3, "model": 7, "more": 1}'):
        (tmp_path / "odd.json").write_text(odd)
        assert config.load(spark, f"{tmp_path}/odd.json") == config.Config()


def test_page_text_of_short_octal_escapes_and_control_characters():
    from tessera.sources.extract import page_text

    assert page_text(rb"(a\101\53\4b) Tj") == "aA+\x04b"
    assert page_text(b"one\x01two\x7fthree") == "one two three"


def test_a_split_of_an_archive_is_held_once():
    """Its pieces, the whole of them and a copy of that made four times its size."""
    import tracemalloc

    import pyarrow as pa

    size, n = 1 << 20, 24
    batch = pa.record_batch([pa.array(["f"] * n), pa.array([0] * n, pa.int64()), pa.array([b"x" * size] * n, pa.binary())], names=["path", "split", "piece"])
    tracemalloc.start()
    for _, data in archive._whole(iter([batch])):
        assert len(data) == n * size + 2 * (n - 1) + 1
        assert bytes(archive._view(data, len(data), b"")[:4]) == b"xxxx"
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1.6 * n * size


def test_files_are_read_in_slices():
    """A reading task holds a slice of a batch at once, however many rows Spark puts in one (`counts_by_type`, `extraction`)."""
    column = pa.array([b"x" * 300] * 10 + [None, b"", b"y" * 2000])
    cut = list(slices([column, column.slice(0, 0)], 1000))
    assert pa.concat_arrays(cut).equals(column) and [len(c) for c in cut] == [4, 3, 3, 3, 0]


def test_counts_by_type_reads_docx_files_where_it_counts(spark, folder):
    """One Python step for both, so that a task has one worker; case, unread files and other types as before."""
    found = files.files(spark, folder).select("path", "content").union(spark.createDataFrame([("broken.docx", bytearray(b"PK\x03\x04 the L")), ("none", None)], "path string, content binary"))
    out = counts_by_type(found, ["L", "<W:T>"], ignore_case=True)
    assert {tuple(r) for r in out.collect()} == {("compressedStreams", 1), ("L", 3), ("<W:T>", 1)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
