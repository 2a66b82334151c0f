import random
import re
import time
import zlib

import pytest

from tessera.plans import queries
from tessera.sources import extract, limits, pdf
from tessera.sources.files import documents_from


class Builder:
    """Writes a PDF object by object: pages out of order in the file, fonts of a few glyphs with codes of their own."""

    def __init__(self, seed=0, compressed=False):
        self.rng, self.objects, self.compressed = random.Random(seed), {}, compressed

    def add(self, body, stream=None, number=None):
        number = number or len(self.objects) + 1
        while number in self.objects and self.objects[number] is not None:
            number += 1
        if stream is not None:
            data = zlib.compress(stream)
            body = body[:-2] + b"/Filter /FlateDecode /Length %d >>\nstream\n" % len(data) + data + b"\nendstream"
        self.objects[number] = body
        return number

    def font(self, text):
        chars = sorted(set(text))
        codes = self.rng.sample(range(1, 60_000), len(chars))
        pairs = b"\n".join(b"<%04X> <%s>" % (c, ch.encode("utf-16-be").hex().encode()) for ch, c in zip(chars, codes, strict=True))
        cmap = self.add(b"<< >>", b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange %d beginbfchar\n%s\nendbfchar endcmap" % (len(chars), pairs))
        font = self.add(b"<< /Type /Font /Subtype /Type0 /BaseFont /ABCDEF+Sub /Encoding /Identity-H /ToUnicode %d 0 R >>" % cmap)
        table = dict(zip(chars, codes, strict=True))
        return font, lambda s: b"<" + b"".join(b"%04X" % table[c] for c in s) + b">"

    def document(self, texts):
        pages = []
        for text in self.rng.sample(list(enumerate(texts)), len(texts)):
            font, code = self.font(text[1])
            words = text[1].split(" ")
            shown = b" ".join(b"[%s] TJ 0 -12 Td" % b" -20 ".join(code(w[i : i + 2]) for i in range(0, len(w), 2)) for w in words if w)
            content = self.add(b"<< >>", b"q BT /F1 9 Tf 1 0 0 1 50 700 Tm " + shown + b" ET Q")
            pages.append((text[0], self.add(b"<< /Type /Page /Contents [%d 0 R] /Resources << /Font << /F1 %d 0 R >> >> >>" % (content, font))))
        order = [n for _, n in sorted(pages)]
        half = len(order) // 2
        inner = [self.add(b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % n for n in part), len(part))) for part in (order[:half], order[half:])]
        tree = self.add(b"<< /Type /Pages /Kids [%d 0 R %d 0 R] /Count %d >>" % (*inner, len(order)))
        root = self.add(b"<< /Type /Catalog /Pages %d 0 R >>" % tree)
        return self.with_streams(root) if self.compressed else self.with_table(root)

    def with_table(self, root):
        out, places = bytearray(b"%PDF-1.4\n"), {}
        for n, body in self.objects.items():
            places[n] = len(out)
            out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
        table = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1) + b"".join(b"%010d 00000 n \n" % places[n] for n in sorted(places))
        return bytes(out + b"trailer << /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(places) + 1, root, table))

    def with_streams(self, root):
        plain = {n: b for n, b in self.objects.items() if b"stream" not in b}
        out, places = bytearray(b"%PDF-1.5\n"), {}
        head, bodies = b"", b""
        for n, body in plain.items():
            head += b"%d %d " % (n, len(bodies))
            bodies += body + b" "
        pack = self.add(b"<< /Type /ObjStm /N %d /First %d >>" % (len(plain), len(head)), head + bodies)
        for n, body in self.objects.items():
            if n not in plain:
                places[n] = len(out)
                out += b"%d 0 obj %s endobj\n" % (n, body)
        table, number = len(out), len(self.objects) + 1
        at = {n: i for i, n in enumerate(plain)}
        rows = [bytes([0, 0, 0, 0, 0])] + [(b"\x02" + pack.to_bytes(3) + bytes([at[n] & 255])) if n in plain else (b"\x01" + places[n].to_bytes(3) + b"\0") for n in range(1, number)] + [b"\x01" + table.to_bytes(3) + b"\0"]
        above, data = bytes(5), b""
        for r in rows:  # PNG's "up"
            data += b"\x02" + bytes((x - y) & 255 for x, y in zip(r, above, strict=True))
            above = r
        packed = zlib.compress(data)
        out += b"%d 0 obj << /Type /XRef /Size %d /W [1 3 1] /Root %d 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 5 >> /Length %d >>\nstream\n" % (number, number + 1, root, len(packed)) + packed + b"\nendstream endobj\n"
        return bytes(out + b"startxref\n%d\n%%%%EOF" % table)


TEXTS = ["first page of words", "zweite Seite größer", "third € 日本 page", "one", "the last of them"]


@pytest.mark.parametrize("compressed", [False, True])
def test_pages_in_order(compressed):
    data = Builder(3, compressed).document(TEXTS)
    assert pdf.page_texts(data) == TEXTS
    broken = re.sub(rb"startxref\n\d+", b"startxref\n7", data)
    assert pdf.page_texts(broken) == TEXTS
    with pytest.raises(pdf.Damaged):
        pdf.page_texts(b"%PDF-1.4 nothing else")


def test_objects():
    value, _ = pdf.parsed(rb"<< /A#20b [1 -2.5 (a\(b\)\101(c)\n) <4a4B5> true null 3 0 R] % comment" + b"\n /N /M >>")
    assert value == {"A b": [1, -2.5, b"a(b)A(c)\n", b"JKP", True, None, 3], "N": "M"} and isinstance(value["A b"][-1], pdf.Ref)
    with pytest.raises(pdf.Damaged):
        pdf.parsed(b"<< /A (open")


def test_simple_fonts_forms_and_shifts():
    b = Builder()
    form = b.add(b"<< /Type /XObject /Subtype /Form >>", b"BT /F1 9 Tf (in the form) Tj ET")
    font = b.add(b"<< /Type /Font /Subtype /Type1 /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /A /eacute /uni4E2D 200 /nothing] >> >>")
    content = b.add(b"<< >>", b"BT /F1 9 Tf [(Hel) -20 (lo) -300 (w\xf6rld)] TJ T* (\x01\x02\x03) ' ET /X1 Do /X1 Do")
    page = b.add(b"<< /Type /Page /Contents %d 0 R >>" % content)
    tree = b.add(b"<< /Type /Pages /Kids [%d 0 R %d 0 R] /Resources << /Font << /F1 %d 0 R >> /XObject << /X1 %d 0 R >> >> >>" % (page, page, font, form))
    root = b.add(b"<< /Type /Catalog /Pages %d 0 R >>" % tree)
    assert pdf.page_texts(b.with_table(root)) == ["Hello wörld Aé中 in the form in the form"]


def test_files(spark, tmp_path):
    rows = [("a", Builder(1).document(TEXTS)), ("b", Builder(2, True).document(TEXTS)), ("c", b"%PDF-1.0 stream\n" + zlib.compress(b"(only a stream) Tj") + b"\nendstream"), ("d", b"%PDF encrypted"), ("e", None)]
    files = spark.createDataFrame([(p, bytearray(c) if c else None) for p, c in rows], "path string, content binary")
    got = {r["path"]: (bytes(r["body"]).decode(), r["extract_status"]) for r in documents_from(files).collect()}
    assert got["a"] == got["b"] == ("\n".join(TEXTS), "ok") and got["c"] == ("only a stream ", "ok") and got["d"] == ("", "empty")


def test_a_file_that_hangs_is_left_behind(spark, monkeypatch):
    """The others of its batch are read; a process that dies counts as failed."""

    def slow(data):
        if data == b"hang":
            time.sleep(600)
        if data == b"die":
            import os

            os._exit(3)
        if data == b"bad":
            raise ValueError
        return data.decode()

    with limits.Limited(slow, 0.5) as run:
        began = time.monotonic()
        assert [run(x) for x in (b"a", b"hang", b"b", b"die", b"bad", b"c")] == [("ok", "a"), ("timed_out", None), ("ok", "b"), ("failed", None), ("failed", None), ("ok", "c")]
        assert time.monotonic() - began < 5
    read = extract._limited((slow, 0.5), kind="string")
    rows = spark.createDataFrame([(x,) for x in (b"x", b"hang", b"y")], "content binary").coalesce(1)
    assert [tuple(r["v"]) for r in rows.select(read("content").alias("v")).collect()] == [("x", "ok"), (None, "timed_out"), ("y", "ok")]


def test_a_file_isnt_given_up_because_the_machine_is_busy(tmp_path):
    """Waiting for a CPU doesn't count, and a process that was ended from outside is replaced once."""

    def waits(data):
        for _ in range(10):
            until = time.process_time() + 0.03
            while time.process_time() < until:
                pass
            time.sleep(0.1)
        return data.decode()

    def dies_once(data):
        import os

        if not (tmp_path / "died").exists():
            (tmp_path / "died").touch()
            os._exit(9)
        return data.decode()

    def works_on(data):
        while True:
            pass

    with limits.Limited(waits, 0.6) as run:
        assert run(b"a") == ("ok", "a")
    with limits.Limited(dies_once, 5) as run:
        assert run(b"b") == ("ok", "b")
    with limits.Limited(works_on, 0.5) as run:
        assert run(b"c") == ("timed_out", None)


def test_pages_that_show_nothing_give_nothing(spark):
    """`pdf_pages` and `extraction` on documents without words: not the operators of the pages' streams (F1)."""
    empty, built = queries._as_pages(""), Builder()
    page = built.add(b"<< /Type /Page /Contents %d 0 R >>" % built.add(b"<< >>", b"q 9 0 0 9 0 0 cm Q"))
    scanned = built.with_table(built.add(b"<< /Type /Catalog /Pages %d 0 R >>" % built.add(b"<< /Type /Pages /Kids [%d 0 R] >>" % page)))
    rows = [("a", empty), ("b", scanned), ("c", queries._as_pdf("")), ("d", queries._as_pages("a bc def")), ("e", queries._as_pdf("a bc"))]
    found = extract.extracted(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary"))
    assert {r["path"]: (r["text"].split(), r["extract_status"]) for r in found.collect()} == {"a": ([], "empty"), "b": ([], "empty"), "c": ([], "empty"), "d": (["a", "bc", "def"], "ok"), "e": (["a", "bc"], "ok")}


def test_a_process_that_stands_still_is_replaced(tmp_path):
    """And what a file's objects say doesn't give way to its streams for it (F1)."""

    def stops_once(data):
        if not (tmp_path / "stopped").exists():
            (tmp_path / "stopped").touch()
            time.sleep(600)
        return data.decode()

    with limits.Limited(stops_once, 0.5) as run:
        assert run(b"a") == ("ok", "a")


def test_large_files_get_more_seconds(monkeypatch):
    """So many for each MB of a file (F1)."""
    monkeypatch.setattr(limits, "MB", 1000)

    def works(data):
        until = time.process_time() + 1.2
        while time.process_time() < until:
            pass
        return len(data)

    with limits.Limited(works, 0.3) as run:
        assert run(b"x" * 5000) == ("ok", 5000) and run(b"x") == ("timed_out", None)


def test_codes_of_runs_are_read_as_one_by_one():
    """Runs of hexadecimal strings, decoded at once, give what single operators give: odd digits, codes that look like surrogates, numbers
    in arrays, fonts of one, two and three bytes."""
    rng = random.Random(5)
    for width in (1, 2, 3):
        b = Builder()
        top = 256**width - 1
        ranges = b"3 beginbfrange <%0*X> <%0*X> <0041> <%0*X> <%0*X> <D83DDE00> <%0*X> <%0*X> [<0061> <00620063>] endbfrange 1 beginbfchar <%0*X> <> endbfchar"
        codes = [(0x41, 0x5A), (0xD8 if width == 1 else 0xD800, 0xDF if width == 1 else 0xDC05), (0x61, 0x62)]
        cmap = b.add(b"<< >>", b"1 begincodespacerange <%0*X> <%0*X> endcodespacerange " % (2 * width, 0, 2 * width, top) + ranges % (*[x for low, high in codes for x in (2 * width, low, 2 * width, high)], 2 * width, 0x62))
        font = b.add(b"<< /Type /Font /Subtype /Type0 /ToUnicode %d 0 R >>" % cmap)
        for _ in range(40):
            ops = []
            for _ in range(12):
                strings = [b"".join(b"%0*X" % (2 * width, rng.choice([0x41, 0x45, 0x61, 0x62, *codes[1], 0x70])) for _ in range(rng.randint(0, 4))) + rng.choice([b"", b"", b"", b"4"]) for _ in range(3)]
                ops.append(rng.choice([b"[<%s> -20 <%s>-250<%s>] TJ", b"<%s> Tj <%s> Tj 0 -12.5 Td <%s> Tj", b"<%s> Tj T* [<%s>] TJ\n[ 3 ] TJ <%s>Tj 1 0 0 1 5 .5 Tm"]) % tuple(strings))
            contents = [b.add(b"<< >>", b"BT /F1 9 Tf " + sep.join(ops)) for sep in (b" ", b" %\n 1 w ")]  # a comment and another operator end a run
            pages = [b.add(b"<< /Type /Page /Contents %d 0 R >>" % c) for c in contents]
            tree = b.add(b"<< /Type /Pages /Kids [%d 0 R %d 0 R] /Resources << /Font << /F1 %d 0 R >> >> >>" % (*pages, font))
            data = b.with_table(b.add(b"<< /Type /Catalog /Pages %d 0 R >>" % tree))
            runs = pdf.page_texts(data)
            with pytest.MonkeyPatch.context() as single:
                single.setattr(pdf, "_RUN", re.compile(b"(?!)"))
                assert pdf.page_texts(data) == runs and runs[0] == runs[1]
                single.undo()
                single.setattr(pdf, "KINDS", 1)
                assert pdf.page_texts(data) == runs


def test_streams_of_any_size_and_any_bytes(spark):
    """`extraction` reads streams beyond 10 MB, those whose bytes hold the word that ends streams, and files that break off (F4)."""
    words = random.Random(1).randbytes(3 << 20).hex(" ", 2)
    long = queries._as_pdf(words)
    text = b"BT (one endstream two) Tj (three) Tj ET"
    stored = b"%PDF-1.4\n1 0 obj << >> stream\n" + zlib.compress(text, 0) + b"\nendstream endobj 2 0 obj << >> stream\n" + zlib.compress(b"(after) Tj") + b"\nendstream endobj"
    raw = stored.replace(zlib.compress(text, 0), zlib.compress(text, 0)[2:-4])
    cut = stored[: stored.rindex(b"\nendstream")]
    rows = [("long", long), ("stored", stored), ("raw", raw), ("cut", cut), ("damaged", b"%PDF stream\n" + zlib.compress(text)[:20] + b"\nendstream stream\n" + zlib.compress(b"(next) Tj") + b"\nendstream")]
    files = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    got = {r["path"]: (r["text"].strip(), r["extract_status"]) for r in extract.extracted(files).collect()}
    assert len(words) > 7 << 20 and len(list(extract.pdf_streams(queries._as_pdf(words * 2)))[0]) > 14 << 20
    assert got["long"] == (words, "ok") and extract.pdf_text(queries._as_pdf(words * 2)).strip() == words * 2
    assert got["stored"] == got["raw"] == got["cut"] == ("one endstream two three after", "ok") and got["damaged"][0].endswith("next")


def test_pages_of_any_number_and_size():
    """More than 400 pages, pages beyond 10 MB, and forms within more than six forms (F4)."""
    texts = [f"page {i}" for i in range(450)]
    assert pdf.page_texts(Builder(4).document(texts)) == texts
    words = random.Random(2).randbytes(900_000).hex(" ", 2)
    assert " ".join(extract.pdf_pages(queries._as_pages(words * 4)).split()) == words * 4
    b = Builder()
    form = b.add(b"<< /Type /XObject /Subtype /Form >>", b"BT (the innermost) Tj ET")
    for _ in range(9):
        form = b.add(b"<< /Type /XObject /Subtype /Form /Resources << /XObject << /X1 %d 0 R >> >> >>" % form, b"/X1 Do")
    page = b.add(b"<< /Type /Page /Resources << /XObject << /X1 %d 0 R >> >> /Contents %d 0 R >>" % (form, b.add(b"<< >>", b"/X1 Do")))
    root = b.add(b"<< /Type /Catalog /Pages %d 0 R >>" % b.add(b"<< /Type /Pages /Kids [%d 0 R] >>" % page))
    assert pdf.page_texts(b.with_table(root)) == ["the innermost"]


def test_files_are_made_and_read_once(spark):
    """`pdf_pages` makes a file in one step and reads it in another; it made each three times (F3)."""
    plan = queries.pdf_pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2


@pytest.mark.parametrize("long", [0, 1 << 30])
def test_long_runs_are_looked_up_in_a_table(monkeypatch, long):
    """And give the same, with codes that the font doesn't have and such that look like surrogates (F3)."""
    monkeypatch.setattr(pdf, "LONG", long)
    assert pdf.page_texts(Builder(7).document(TEXTS)) == TEXTS
    font = pdf.Font(pdf.File(queries._as_pages("a b")), {"Subtype": "Type0"})
    font.map.update({0x41: "a", 0x42: "é", 0x8000: "\U0001F600"})
    assert font.texts(b"[<0041 >] TJ".replace(b" ", b"") + b" 0 -9 Td [<00424444> -20 <FFFF8000>] TJ", pdf._Gaps()) == ["", "a", "é\U0001F600"][1:]
    assert font.texts(b"<0041DBFFDFFF0042> Tj T* <DBFF>Tj", pdf._Gaps()) == ["aé", ""]


def test_many_files_at_once():
    """A file that hangs or ends its process takes no other of its batch with it (F3)."""

    def odd(data):
        if data == b"hang":
            time.sleep(600)
        if data == b"die":
            import os

            os._exit(3)
        if data == b"bad":
            raise ValueError
        return data.decode()

    with limits.Limited(odd, 0.4) as run:
        assert run.many([b"a", b"bad", b"b"]) == [("ok", "a"), ("failed", None), ("ok", "b")] and run.many([]) == []
        assert run.many([b"a", b"hang", b"die", b"bad", b"c"]) == [("ok", "a"), ("timed_out", None), ("failed", None), ("failed", None), ("ok", "c")]
