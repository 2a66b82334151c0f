"""The engine's operators as named queries over the driver's tables: each takes (spark, sf_dir)."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as fn
from tessera.operators import boolean, fuzzy, packed, phrases
from tessera.operators import index as ix
from tessera.operators import patterns as pt
from tessera.operators import search as se
from tessera.operators import shaping as sh
from tessera.operators.catalog import Catalog
from tessera.sources import archive, files
from tessera.sources import lines as lines_of
from tessera.sources.extract import extracted
from tessera.sources.scratch import new_folder
from tessera.sources.slices import slices
from tessera.streaming import index as stream_index

#: Queries that the search queries ask: common and rare terms, a repeated one, an unknown one, and one without tokens.
ASKED = [(0, "only thenor"), (1, "the hain, ORDER"), (2, "of of tion"), (3, "nosuchterm and"), (4, "é!")]
PATTERNS = ("the", "nn", "aa", "token", "é", "\n")
NOW = datetime(2026, 1, 1)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.documents_of(_table(spark, sf_dir, "documents"))


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id int, query string")


#: The folders of the indexes that sessions have built, by application and folder of tables.
_indexes: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, sf_dir: str, *, anew: bool = False) -> ix.Index:
    """The index of the documents: built and saved once in a session, then loaded, as searches do."""
    docs, key = _docs(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir)
    if anew or key not in _indexes:
        path = new_folder(spark, "index")
        ix.build_index(docs).save(path, with_documents=True)
        _indexes[key] = path
    return ix.load_index(spark, _indexes[key])


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def tokens(spark, sf_dir):
    return ix.tokens(_docs(spark, sf_dir))


def postings(spark, sf_dir):
    rows = ix.postings(_docs(spark, sf_dir))
    return rows.select("term", "doc_id", "tf", F.array_join(F.col("offsets").cast("array<string>"), ",").alias("offsets"))


def term_df(spark, sf_dir):
    return ix.term_stats(_docs(spark, sf_dir))


def doc_stats(spark, sf_dir):
    return ix.doc_stats(_docs(spark, sf_dir))


def corpus_stats(spark, sf_dir):
    return _rounded(ix.corpus_stats(ix.doc_stats(_docs(spark, sf_dir))), "avg_len")


def index_build(spark, sf_dir):
    """An index built and saved, and what it then holds."""
    index = _index(spark, sf_dir, anew=True)
    of_term = packed.unpacked(index.blocks, with_offsets=False).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tf"))
    found = of_term.agg(F.sum("n").alias("n_postings"), F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_tokens"))
    return found.withColumn("n_docs", F.lit(index.stats.count()))


def _ranked(spark, sf_dir, queries=None, **options) -> DataFrame:
    found = se.ranked(_index(spark, sf_dir), _asked(spark) if queries is None else queries, **options)
    return _rounded(found.drop("terms"), "base_score", "score")


def bm25_search(spark, sf_dir):
    return _ranked(spark, sf_dir)


def bm25_pruned(spark, sf_dir):
    """The same rows from those blocks only that can hold one of the ten best."""
    return _ranked(spark, sf_dir, prune=True)


def bm25_batch_pruned(spark, sf_dir):
    """The three best documents of every benchmark passage, whole: of few postings from the blocks that can hold them; passages that
    share most of their postings are scored together."""
    passages = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return _ranked(spark, sf_dir, passages, k=3, prune=True)


def packed_blocks(spark, sf_dir):
    """The packed postings: of each term its blocks, their documents, and the first and last of them."""
    return _index(spark, sf_dir).blocks.groupBy("term").agg(F.sum("n").cast("long").alias("df"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"))


def tfidf_search(spark, sf_dir):
    return _ranked(spark, sf_dir, use_bm25=False)


def boosted_rerank(spark, sf_dir):
    return _ranked(spark, sf_dir, rerank=True)


def bm25_batch(spark, sf_dir):
    """Every benchmark passage, whole, as a query: all in one job."""
    return _ranked(spark, sf_dir, _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


def raw_search(spark, sf_dir):
    return se.raw_ranked(_docs(spark, sf_dir), _asked(spark))


def raw_search_conversations(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return se.raw_ranked(ix.documents_of(turns), _asked(spark))


def _hits(spark, sf_dir, window: int) -> DataFrame:
    return se.search(_index(spark, sf_dir), _asked(spark), window=window)


def snippets(spark, sf_dir):
    return _hits(spark, sf_dir, 120).select("query_id", "rank", "doc_id", "match_offset", "snippet")


def _range_text(ranges: Column) -> Column:
    return F.array_join(F.transform(ranges, lambda r: F.format_string("%d-%d:%s", r["start"], r["end"], r["term"])), " ")


def match_ranges(spark, sf_dir):
    hits = _hits(spark, sf_dir, 60)
    return hits.select("query_id", "rank", "doc_id", _range_text(F.col("match_ranges")).alias("ranges"), F.array_join("matched_terms", " ").alias("matched"))


def _merged(spark, sf_dir, name: str, *keys: str) -> DataFrame:
    found = pt.merged_matches(_table(spark, sf_dir, name), keys, ("the", "he", "en", "ti"))
    return found.withColumn("merged", F.array_join(F.transform("merged", lambda r: F.format_string("%d-%d", r["start"], r["end"])), " "))


def highlight_merge_documents(spark, sf_dir):
    """Merged ranges of overlapping terms over the whole text of each document."""
    return _merged(spark, sf_dir, "documents", "doc_id")


def highlight_merge_conversations(spark, sf_dir):
    """The same over the whole text of each conversation turn."""
    return _merged(spark, sf_dir, "conversations", "conv_id", "turn")


def pattern_counts(spark, sf_dir):
    return pt.pattern_counts(_docs(spark, sf_dir), PATTERNS)


def pattern_counts_any_case(spark, sf_dir):
    return pt.pattern_counts(_docs(spark, sf_dir), ("the", "an"), ignore_case=True)


def level_counts(spark, sf_dir):
    """Events as JSON lines, their types as levels."""
    line = F.concat(F.lit('{"level": "'), "event_type", F.lit('", "user": '), F.col("user_id").cast("string"), F.lit("}"))
    lines = _table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), line.alias("text"))
    return pt.level_counts(ix.documents_of(lines))


def sniff_types(spark, sf_dir):
    """Types by first bytes of pages, of documents, and of pages' texts with a heading or a bracket put before."""
    page, text = (fn.utf8_bytes(F.col(c)) for c in ("html", "text"))
    pages, docs = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents")
    heads = F.array(*[F.encode(F.concat(F.lit(h), "html"), "UTF-8") for h in ("# ", " \n{", "%PDF-1.4", "PK\x03\x04")])
    bodies = pages.select(page.alias("b")).union(docs.select(text)).union(pages.select(F.explode(heads)))
    return bodies.select(fn.file_type(F.col("b")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def file_type_stats(spark, sf_dir):
    """Pages by the extension of their addresses' paths."""
    path = F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "")
    return _rounded(sh.file_type_stats(_table(spark, sf_dir, "pages").select(path.alias("path"))), "share")


def clean_markup(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", fn.without_markup(F.col("html")).alias("text"))


def rag_bundle(spark, sf_dir):
    return sh.bundle(_hits(spark, sf_dir, 40), path_col="doc_id")


def search_payloads(spark, sf_dir):
    """The lists of results, as rows of document and rank, that a server would send."""
    asked = _asked(spark)
    made = sh.payloads(se.search(_index(spark, sf_dir), asked, window=40), asked)
    back = F.from_json("payload", "query string, results array<struct<doc_id:bigint,snippet:string>>")
    return made.select("query_id", back.alias("p")).select("query_id", F.col("p.query").alias("query"), F.size("p.results").cast("long").alias("n_results"))


def catalog_labels(spark, sf_dir):
    """Sizes, counts and ages as people read them, of customers' orders."""
    orders = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last"), F.sum("o_totalprice").alias("total"))
    return orders.select("id", fn.count_label(F.col("n") * 997).alias("files"), fn.size_label(F.floor("total") * 37).alias("size"), fn.age_label(F.col("last"), F.lit(NOW)).alias("age"))


def _made(file_of: Callable[[str], bytes]):
    """A column function that makes files of words, a slice of a batch at a time."""

    @F.arrow_udf(T.BinaryType())
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in slices(columns):
            yield pa.array([file_of(x.as_py()) for x in some], pa.binary())

    return run


def _as_pdf(text: str) -> bytes:
    page = zlib.compress(b"BT (" + text.encode() + b") Tj ET")
    return b"%PDF-1.4\n1 0 obj << /Filter /FlateDecode >> stream\n" + page + b"\nendstream endobj\n%%EOF"


def _as_docx(text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:p><w:t>{text}</w:t><w:binData>QUJD</w:binData></w:p>")
    return out.getvalue()


def _files(spark, sf_dir) -> DataFrame:
    """The documents as files: by turns UTF-8, Latin-1, and their words as a PDF and a DOCX file."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_join(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), " ")
    latin = F.encode(F.regexp_replace(text, "[^\\x00-\\xFF]", "?"), "ISO-8859-1")
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), (F.col("doc_id") % 4).alias("kind"), text.alias("text"), words.alias("words"), latin.alias("latin"))
    pdf, docx = (rows.where(F.col("kind") == k).select("path", _made(f)(F.col("words")).alias("content")) for k, f in ((2, _as_pdf), (3, _as_docx)))
    plain = rows.where("kind < 2").select("path", F.when(F.col("kind") == 0, fn.utf8_bytes(F.col("text"))).otherwise(F.col("latin")).alias("content"))
    return plain.unionByName(pdf).unionByName(docx)


def extraction(spark, sf_dir):
    """Texts out of files of four kinds."""
    return extracted(_files(spark, sf_dir)).select(F.col("path").cast("long").alias("doc_id"), F.trim("text").alias("text"), "extract_status")


def counts_by_type(spark, sf_dir):
    return pt.counts_by_type(_files(spark, sf_dir), ("the", "token"))


def counts_by_type_levels(spark, sf_dir):
    """Levels where no patterns are given: events as JSON lines, beside PDF files."""
    line = F.concat(F.lit('{"level": "'), "event_type", F.lit('"}'))
    lines = _table(spark, sf_dir, "events").select(fn.utf8_bytes(line).alias("content"))
    return pt.counts_by_type(lines.unionByName(_files(spark, sf_dir).where(fn.file_type(F.col("content")) == "pdf").select("content")))


def _records(spark, sf_dir) -> DataFrame:
    return _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), "body")


def archive_round_trip(spark, sf_dir):
    """Documents written as record archives and read again."""
    folder = new_folder(spark, "archive")
    archive.write_archives(_records(spark, sf_dir), folder)
    back = archive.read_archives(spark, folder)
    return back.select(F.col("path").cast("long").alias("doc_id"), F.octet_length("body").cast("long").alias("n_bytes"), F.md5("body").alias("md5"))


def ndjson_export(spark, sf_dir):
    """Documents written as JSON lines and read again."""
    folder = new_folder(spark, "ndjson")
    files.write_ndjson(_records(spark, sf_dir), folder)
    return spark.read.schema("path string, text string").json(folder).select(F.col("path").cast("long").alias("doc_id"), F.md5("text").alias("md5"))


def plain_listing(spark, sf_dir):
    return sh.listing(_hits(spark, sf_dir, 40), path_col="doc_id")


def prompts(spark, sf_dir):
    return sh.prompts(_hits(spark, sf_dir, 40), _asked(spark))


def answers(spark, sf_dir):
    """Prompts answered by a callable: here their length."""
    return sh.answered(prompts(spark, sf_dir), lambda p: str(len(p)))


def search_payload_results(spark, sf_dir):
    """The results in the payloads, in their order."""
    asked = _asked(spark)
    made = sh.payloads(se.search(_index(spark, sf_dir), asked, window=40), asked)
    back = F.from_json("payload", "query string, results array<struct<doc_id:bigint,score:double,snippet:string,match_offset:bigint>>")
    rows = made.select("query_id", F.posexplode(back["results"]).alias("place", "r"))
    return rows.select("query_id", "place", "r.doc_id", F.round("r.score", 6).alias("score"), "r.snippet", "r.match_offset")


def preview_positions(spark, sf_dir):
    """How far into its document each hit lies."""
    hits = se.ranked(_index(spark, sf_dir), _asked(spark)).join(_docs(spark, sf_dir), "doc_id")
    return _rounded(hits.select("query_id", "rank", fn.preview_fraction(F.col("match_offset"), F.col("body")).alias("fraction")), "fraction")


def range_validation(spark, sf_dir):
    """Ranges made of line items, a few of them empty, reversed or negative: how many hold, and merged."""
    made = F.struct((F.col("l_linenumber") - 3).cast("int").alias("start"), F.when(F.col("l_quantity") < 45, (F.col("l_quantity") / 5).cast("int")).alias("end"))
    lists = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(made).alias("ranges"))
    merged = F.array_join(F.transform(fn.merged_ranges(F.col("ranges")), lambda r: F.format_string("%d-%d", r["start"], r["end"])), " ")
    return lists.select("l_orderkey", F.size(fn.valid_ranges(F.col("ranges"))).cast("long").alias("n_valid"), merged.alias("merged"))


def plain_texts(spark, sf_dir):
    """Turns with colours and asterisks put in, and without them again."""
    marked = F.concat(F.lit("\x1b[1;31m**"), F.col("role"), F.lit("**\x1b[0m: "), "text")
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.plain_snippet(marked).alias("text"))


def titles(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", fn.title(F.col("url")).alias("title"))


def top_types(spark, sf_dir):
    path = F.concat(F.lit("f."), (F.col("l_linenumber") + F.col("l_suppkey") % 3).cast("string"))
    return _rounded(sh.file_type_stats(_table(spark, sf_dir, "lineitem").select(path.alias("path")), top=4), "share")


def fallback_highlights(spark, sf_dir):
    """What to mark in each turn for the words of a query, overlapping places included."""
    words = fn.highlight_terms(F.lit("ti  TH\tnn ti ana"))
    ranges = fn.fallback_ranges(F.col("text"), words)
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.transform(ranges, lambda r: F.format_string("%d-%d", r["start"], r["end"])), " ").alias("merged"))


#: Phrases: of frequent words, a repeated one, with marks between, an unknown word, and none.
PHRASES = [(0, "of the"), (1, "the the"), (2, "The, and"), (3, "nosuchterm the"), (4, "é!"), (5, "in the on")]
#: Words whose terms nearby are looked for.
SPELLED = ["hain", "onlx", "thenor", "token", "qwertyuiop", "a"]

_positions: dict[tuple[str, str], str] = {}


def phrase_search(spark, sf_dir):
    """The documents that have a query's tokens one after the other most often."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _positions:
        path = new_folder(spark, "positions")
        phrases.build_positions(_docs(spark, sf_dir)).save(path)
        _positions[key] = path
    positions = phrases.load_positions(spark, _positions[key], _docs(spark, sf_dir))
    return phrases.phrase_search(positions, spark.createDataFrame(PHRASES, "query_id int, query string"))


def conditional_search(spark, sf_dir):
    """All documents that fulfil conditions on their terms and fields."""
    asked = {
        "both": boolean.term("of") & boolean.term("tion"),
        "nested": (boolean.term("hain") | boolean.prefix("thea")) & ~(boolean.term("the") & ~boolean.term("only")),
        "none": ~boolean.term("the") & ~boolean.term("and"),
        "long": boolean.term("and") & boolean.field(F.col("token_count") > 500) & ~boolean.field(F.col("body_len") % 2 == 0),
    }
    return boolean.matches(_index(spark, sf_dir), asked)


def fuzzy_terms(spark, sf_dir):
    """The terms within two edits of some words."""
    words = spark.createDataFrame([(w,) for w in SPELLED], "word string")
    return fuzzy.fuzzy_terms(_index(spark, sf_dir), words, distance=2)


def raw_search_passages(spark, sf_dir):
    """Substrings of all tokens of each benchmark passage, all passages in one walk over the texts."""
    passages = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return se.raw_ranked(_docs(spark, sf_dir), passages, k=3)


def pattern_counts_many(spark, sf_dir):
    """How often each token of the benchmark passages occurs in all documents, in one walk over the texts."""
    words = ix.term_stats(ix.documents_of(_table(spark, sf_dir, "benchmark"), "item_id")).where(~F.col("term").rlike(r"^(.+).*\1$")).select("term")
    return pt.pattern_counts(_docs(spark, sf_dir), [r["term"] for r in words.toLocalIterator()])


def line_chunks(spark, sf_dir):
    """The documents as text files, read again in chunks of whole lines: each line and how often it stands there."""
    folder = new_folder(spark, "lines")
    _table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.option("lineSep", "\n").text(folder)
    lines = lines_of.line_chunks(spark, folder, chunk_bytes=1 << 16).select(F.explode(F.split(F.col("body").cast("string"), "\n", -1)).alias("line"))
    return lines.groupBy(F.md5("line").alias("md5")).agg(F.count(F.lit(1)).alias("n"))


@lru_cache
def _codes(shift: int) -> list[bytes]:
    """What stands for each byte of words; a blank ends a string and begins the next one."""
    return [b">] TJ 0 -9 Td [<" if c == 32 else b"%04X" % (c + shift) for c in range(128)]


def _as_pages(text: str) -> bytes:
    """A PDF of three pages, the last one first in the file, whose font has codes of its own."""
    listed = text.split()
    third = -(-len(listed) // 3) or 1
    shift = 64 + len(text) % 100
    codes = _codes(shift)

    def shown(part: list[str]) -> bytes:
        return b"[<" + b"".join([codes[c] for c in " ".join(part).encode()]) + b">] TJ 0 -9 Td" if part else b""

    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <%04X> <%04X> <0020> endbfrange" % (32 + shift, 126 + shift)
    bodies = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [5 0 R 6 0 R 7 0 R] /Resources << /Font << /F1 3 0 R >> >> >>", 3: b"<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>", 4: (b"<< ", cmap)}
    for i in range(3):
        bodies[5 + i] = b"<< /Type /Page /Contents %d 0 R >>" % (8 + i)
        bodies[8 + i] = (b"<< ", b"BT /F1 9 Tf 9 9 Td " + shown(listed[i * third : (i + 1) * third]) + b" ET")
    out, places = bytearray(b"%PDF-1.4\n"), {}
    for n in sorted(bodies, reverse=True):
        places[n] = len(out)
        body = bodies[n]
        if isinstance(body, tuple):
            data = zlib.compress(body[1])
            body = body[0] + b"/Filter /FlateDecode /Length %d >> stream\n" % len(data) + data + b"\nendstream"
        out += b"%d 0 obj %s endobj\n" % (n, body)
    table = b"".join(b"%010d 00000 n \n" % places[n] for n in range(1, 11))
    return bytes(out + b"xref\n0 11\n0000000000 65535 f \n" + table + b"trailer << /Size 11 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % len(out))


def pdf_pages(spark, sf_dir):
    """The documents' words as PDF files with pages and fonts, and read again, page by page."""
    words = F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0)), " ")
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), _made(_as_pages)(words).alias("content"))
    found = extracted(rows)
    return found.select(F.col("path").cast("long").alias("doc_id"), "kind", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"), "extract_status")


def search_modes(spark, sf_dir):
    """By an index, and where there is none by scanning."""
    docs, asked = _docs(spark, sf_dir), _asked(spark)
    columns = ["query_id", "rank", "doc_id", "match_offset"]
    by_index = se.search_any(docs, asked, _index(spark, sf_dir)).select(F.lit("index").alias("mode"), *columns)
    return by_index.unionByName(se.search_any(docs, asked).select(F.lit("scan").alias("mode"), *columns))


def index_changes(spark, sf_dir):
    """An index that a stream keeps up: all documents come, then a third of them change and a third go."""
    docs, folder = _docs(spark, sf_dir), new_folder(spark, "changing")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("body", T.BinaryType()), T.StructField("removed", T.BooleanType()), T.StructField("changed_at", T.TimestampType())])
    first = docs.select("doc_id", "body", F.lit(False).alias("removed"), F.timestamp_seconds(F.lit(1)).alias("changed_at"))
    again = docs.where("doc_id % 3 < 2").select("doc_id", F.encode(F.concat(F.lit("changed "), F.col("body").cast("string")), "UTF-8").alias("body"), (F.col("doc_id") % 3 == 0).alias("removed"), F.timestamp_seconds(F.lit(2)).alias("changed_at"))
    for events in (first, again):
        events.write.mode("append").parquet(f"{folder}/events")
        stream_index.index_changes(spark.readStream.schema(schema).parquet(f"{folder}/events"), f"{folder}/index", f"{folder}/checkpoint").awaitTermination()
    index = stream_index.load_changing(spark, f"{folder}/index")
    return index.postings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_tokens"), F.max("token_count").alias("token_count"))


def catalog_entries(spark, sf_dir):
    """Entries put into a catalog, some of them again, and one taken out."""
    entries = Catalog(spark, new_folder(spark, "catalog"))
    time = F.lit(NOW).cast("timestamp")
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.lit("/in").alias("source_path"), F.lit(None).cast("string").alias("index_path"), time.alias("created_at"), time.alias("last_indexed_at"), F.array(F.col("n_regionkey").cast("string")).alias("exclude_patterns"), "n_regionkey")
    entries.put(rows.drop("n_regionkey"))
    entries.put(rows.where("n_regionkey = 1").withColumn("name", F.concat(F.lit("new "), "name")).drop("n_regionkey"))
    entries.delete("3")
    return entries.list().select("id", "name", F.array_join("exclude_patterns", ",").alias("patterns"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_search, bm25_pruned, bm25_batch_pruned, packed_blocks, index_build, tokens, postings, term_df, doc_stats, corpus_stats, tfidf_search, boosted_rerank, bm25_batch, raw_search, raw_search_conversations, snippets,
        match_ranges, highlight_merge_documents, highlight_merge_conversations, pattern_counts, pattern_counts_any_case, level_counts, sniff_types, file_type_stats, clean_markup, rag_bundle, search_payloads, catalog_labels,
        extraction, counts_by_type, counts_by_type_levels, archive_round_trip, ndjson_export, plain_listing, prompts, answers, search_payload_results, preview_positions, range_validation, plain_texts, titles, top_types, fallback_highlights,
        phrase_search, conditional_search, fuzzy_terms, raw_search_passages, pattern_counts_many, line_chunks, pdf_pages, search_modes, index_changes, catalog_entries,
    )
}
