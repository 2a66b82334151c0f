"""Fill-in-middle transformation of texts.

A text is cut into units, the matches of a pattern from left to right. The regex library's `finditer` walks them once and only
their end offsets are kept, four bytes a unit, in a compact array; two lookups in it cut the text into prefix, middle and suffix.
Where to cut, and in which form the parts are put together, follows from a hash of the row's id, so that reruns and other
partitionings agree.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, release

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Infill:
    """How texts are cut and put together.

    unit: the pattern of a unit; what no match covers belongs to the unit that follows it, or to the last part.
    rate, spm_rate: of 100 texts those that are transformed, and of 100 of these those in suffix-prefix-middle order.
    prefix, suffix, middle: the marks; a text that holds one of them stays plain, so that every output can be undone.
    """

    unit: str = r"(?s)."
    seed: int = 1
    rate: int = 90
    spm_rate: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        if not (self.prefix and self.suffix and self.middle) or len({self.prefix, self.suffix, self.middle}) < 3:
            raise ValueError("three different marks are needed")

    def seeds(self, row_id: object) -> tuple[int, ...]:
        digest = hashlib.sha256(f"{self.seed}:{'' if row_id is None else row_id}".encode()).hexdigest()
        return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))

    def parts(self, text: str, ends: array, h: tuple[int, ...]) -> tuple[str, str, str]:
        """Prefix, middle and suffix: cut after two numbers of units, each from none to all."""
        n = len(ends)
        first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        a, b = (ends[i - 1] if i else 0 for i in (first, second))
        return text[:a], text[a:b], text[b:]

    def transformed(self, row_id: object, text: str) -> tuple[int, str, str, str, str]:
        """Number of units, form, prefix, middle, and the output."""
        ends = array("I", (m.end() for m in regex.finditer(self.unit, text)))
        h = self.seeds(row_id)
        if not text or h[2] % 100 >= self.rate or any(m in text for m in (self.prefix, self.suffix, self.middle)):
            return len(ends), PLAIN, "", "", text
        pre, mid, suf = self.parts(text, ends, h)
        if h[3] % 100 < self.spm_rate:
            form, out = SPM, f"{self.suffix}{suf}{self.prefix}{pre}{self.middle}{mid}"
        else:
            form, out = PSM, f"{self.prefix}{pre}{self.suffix}{suf}{self.middle}{mid}"
        if self.restored(out, form) != text:  # a part and a mark that overlap with another mark
            return len(ends), PLAIN, "", "", text
        return len(ends), form, pre, mid, out

    def restored(self, output: str, form: str) -> str:
        """The text that `output` was made of, from it and its form alone: no part holds a mark."""
        if form == PLAIN:
            return output
        first, second = (self.prefix, self.suffix) if form == PSM else (self.suffix, self.prefix)
        rest = output.removeprefix(first)
        one, _, rest = rest.partition(second)
        two, _, mid = rest.partition(self.middle)
        return one + mid + two if form == PSM else two + mid + one


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def filled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, how: Infill | None = None, with_output: bool = True) -> DataFrame:
    """`docs` with n (units of the text), form (plain, psm or spm), prefix_chars and middle_chars (code points; null if
    plain), output (the transformed text, if asked for), output_sha256 and restored_sha256 (of the text that was rebuilt
    from the output and its form), both of UTF-8. Columns of these names that are there already are replaced.

    A null text counts as empty; empty texts, and those that hold a mark, stay plain. A null id has the seed of an empty one.
    Rows that are repeated have equal results, and those that share an id the same seeds. Long texts are cut whole: beside
    the text an array of four bytes a unit is held. An empty table gives an empty one.
    """
    how = how or Infill()
    text_type = ["output string"] if with_output else []
    schema = ", ".join(["n long", "form string", "prefix_chars long", "middle_chars long", *text_type, "output_sha256 string", "restored_sha256 string"])

    @F.pandas_udf(schema)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(", ")]
        for ids, texts in batches:
            rows = []
            for i, t in zip(ids, texts, strict=True):
                text = t if isinstance(t, str) else ""
                n, form, pre, mid, out = how.transformed(i, text)
                sizes = (None, None) if form == PLAIN else (len(pre), len(mid))
                rows.append((n, form, *sizes, *([out] if with_output else []), _digest(out), _digest(how.restored(out, form))))
            made = pd.DataFrame(rows, columns=names)
            yield made.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})
            del rows, made
            release()

    new = fresh(docs, "infill")
    names = [f.split()[0] for f in schema.split(", ")]
    source = docs.withColumn(new, run(F.col(id_col).cast("string"), F.col(text_col)))
    kept = [F.col(c) for c in docs.columns if c.lower() not in names]
    return source.select(*kept, *[_of(new, n) for n in names])


def _of(struct: str, name: str) -> Column:
    return F.col(f"`{struct}`")[name].alias(name)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole, cut by code points."""
    made = filled(documents(spark, sf_dir).select("doc_id", "text"), with_output=False)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


#: n in SQL is the length in code points; the parts are cut by the same hashes.
OP13_SQL = """
WITH seeded AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), hashed AS (
    SELECT *, ('0x' || d[1:8])::BIGINT % (n + 1) AS a, ('0x' || d[9:16])::BIGINT % (n + 1) AS b,
           ('0x' || d[17:24])::BIGINT % 100 AS h3, ('0x' || d[25:32])::BIGINT % 100 AS h4 FROM seeded
), formed AS (
    SELECT doc_id, t, n, least(a, b) AS i, greatest(a, b) AS j,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM hashed
), parts AS (
    SELECT *, substring(t, 1, i) AS pre, substring(t, i + 1, j - i) AS mid, substring(t, j + 1) AS suf FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
