import hashlib
import random

import duckdb
import pytest

from tessera.llm.infill import OP13_SQL, Infill, filled, op13_fill_in_middle

SCHEMA = "doc_id long, text string, n string, infill string, output string"


def texts():
    rng = random.Random(5)
    pieces = ["the ", "é", "日本", "🙂", "<", "P>", "S", ">", "\n", "\u0000", "á", "<M"]
    out = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    return [*out, None, "", "<P>", "has <M> mark", "x", "🙂" * 70_000, "same", "same"]


def table(spark, values):
    rows = [(i, t, "clash", "clash", "clash") for i, t in enumerate(values)]
    return spark.createDataFrame([*rows, rows[0], (None, "no id", "c", "c", "c")], SCHEMA)


def slow(row_id, text, seed=1):
    """By the contract's words, code points one by one."""
    t = list(text or "")
    d = hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    whole = "".join(t)
    if not t or any(m in whole for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(t), "plain", None, None, whole
    pre, mid, suf = ("".join(x) for x in (t[:a], t[a:b], t[b:]))
    if h4 % 100 < 20:
        return len(t), "spm", a, b - a, "<S>" + suf + "<P>" + pre + "<M>" + mid
    return len(t), "psm", a, b - a, "<P>" + pre + "<S>" + suf + "<M>" + mid


def test_like_slow(spark):
    values = texts()
    out = filled(table(spark, values))
    assert out.columns == ["doc_id", "text", "infill", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"]
    rows = out.collect()
    assert len(rows) == len(values) + 2 and {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        n, form, a, m, made = slow(r["doc_id"], r["text"])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == (n, form, a, m, made)
        assert r["output_sha256"] == hashlib.sha256(made.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_other_units_come_back():
    how = Infill(unit=r"\w+\s*", rate=100, seed=9)
    for i, t in enumerate(texts()):
        n, form, pre, mid, out = how.transformed(i, t or "")
        assert how.restored(out, form) == (t or "") and out.count("<M>") <= 1 + (t or "").count("<M>")
        assert form == "plain" or (t or "").startswith(pre + mid)
    words = how.transformed(1, "one two  three")
    assert words[0] == 3 and words[2] in ("", "one ", "one two  ", "one two  three")


def test_marks_must_differ():
    with pytest.raises(ValueError):
        Infill(prefix="<S>")


def test_sql(spark, tmp_path):
    table(spark, texts()).where("text is null or text not like '%\u0000%'").select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = op13_fill_in_middle(spark, str(tmp_path))
    want = con.sql(OP13_SQL)
    assert sorted(map(str, map(tuple, found.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
