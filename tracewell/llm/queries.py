"""One registered query per operator, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.column_suffixes import suffix_dedup
from tracewell.llm.cover_tree import near_vectors
from tracewell.llm.extendible_dedup import exact_dedup
from tracewell.llm.factorisation import is_held_out, score, train
from tracewell.llm.fill_middle import fill_in_middle, restored
from tracewell.llm.gray_simhash import fingerprints, simhash_dedup
from tracewell.llm.jump_shards import shard
from tracewell.llm.line_chunks import line_dedup
from tracewell.llm.order_packing import pack
from tracewell.llm.prefix_bpe import decoder, encode
from tracewell.llm.site_style import main_text
from tracewell.llm.spelling_blocks import spelling_groups
from tracewell.llm.zip_warc import read_archives, write_archives

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SHARDS = 8


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_cover_tree(spark, sf):
    """Links and component of every vector, over pairs of equal label with cosine 0.98 or more."""
    return near_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding", "label"), least=0.98).select(
        "vec_id", "n_links", "component_id", "kept")


ORACLES["op1_cover_tree"] = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (
  SELECT vec_id AS pt, vec_id AS low FROM embeddings
  UNION
  SELECT l.b AS pt, r.low FROM reach r JOIN links l ON l.a = r.pt),
lowest AS (SELECT pt, min(low) AS low FROM reach GROUP BY pt),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, low AS component_id, e.vec_id = low AS kept
FROM embeddings e LEFT JOIN counted ON a = e.vec_id LEFT JOIN lowest ON pt = e.vec_id
"""


@query
def op2_zip_warc(spark, sf):
    """Every page as a WARC record in ZIP packages, read back by range."""
    records = read_archives(write_archives(table(spark, sf, "pages"), least_bytes=0))
    return records.select(F.col("id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to").cast("bigint").alias("refers_to"))


ORACLES["op2_zip_warc"] = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages)
SELECT page_id, strlen(payload) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM hashed
"""


@query
def op3_gray_simhash(spark, sf):
    """Fingerprint of every document and the smallest id reachable over links of at most 3 bits."""
    printed = fingerprints(table(spark, sf, "documents").select("doc_id", "text"), width=3).drop("text")
    return simhash_dedup(printed, most=3).select("doc_id", "fingerprint", "component_id")


@query
def op4_jump_shards(spark, sf):
    """Shard, slot and the shard after growth of every document."""
    return shard(table(spark, sf, "documents").select("doc_id", "text"), SHARDS).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query
def op5_extendible_dedup(spark, sf):
    """The row that stays for every document, texts compared without white space."""
    return exact_dedup(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op5_extendible_dedup"] = r"""
WITH normed AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM normed WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""


@query
def op6_prefix_bpe(spark, sf):
    """Ids of every whole text and the bytes they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made: list = []

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(arrays: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(decoder(path))
        ids = [np.asarray(a) for a in arrays]
        return pd.DataFrame({
            "n_tokens": [len(a) for a in ids],
            "ids_sha256": [hashlib.sha256(a.astype("<u4").tobytes()).hexdigest() for a in ids],
            "decoded_sha256": [hashlib.sha256(made[0](a)).hexdigest() for a in ids]},
            columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    tokens = encode(table(spark, sf, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return tokens.select("doc_id", digests("ids").alias("d")).select("doc_id", "d.*")


@query
def op7_factorisation(spark, sf):
    """Quality score of every whole text, by a model fitted on labelled rows that are not held out."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    scored = score(docs, train(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", "predicted")


@query
def op8_column_suffixes(spark, sf):
    """Bytes of every whole text without the 400-byte strings that start anywhere else too."""
    return suffix_dedup(table(spark, sf, "documents").select("doc_id", "text"), length=400).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_order_packing(spark, sf):
    """The pieces of all documents in sequences of at most 2048 tokens."""
    pieces = pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op9_line_chunks(spark, sf):
    """Lines and chunks of every document, what is removed and what is left."""
    return line_dedup(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op9_line_chunks"] = """
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line, len(lines) AS n FROM cut),
hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT % 2147483647 AS h FROM lines),
rolled AS (
  SELECT *, ((coalesce(lag(h, 2) OVER w, 0) * 16807 + coalesce(lag(h) OVER w, 0)) % 2147483647 * 16807 + h) % 2147483647 AS r
  FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
numbered AS (
  SELECT *, coalesce(sum((r % 4 = 0)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no
  FROM rolled),
chunked AS (
  SELECT doc_id, no, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY pos) AS body FROM numbered GROUP BY doc_id, no),
judged AS (
  SELECT *, n_lines < 2 OR row_number() OVER (PARTITION BY n_lines >= 2, body ORDER BY doc_id, no) = 1 AS stays FROM chunked)
SELECT doc_id, sum(n_lines)::BIGINT AS n_lines, count(*) AS n_chunks, count(*) FILTER (NOT stays) AS removed_chunks,
       coalesce(sum(n_lines) FILTER (NOT stays), 0)::BIGINT AS removed_lines,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY no) FILTER (stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query
def op11_fill_middle(spark, sf):
    """Fill-in-middle output of every whole text and the text rebuilt from it, as digests."""
    made = fill_in_middle(table(spark, sf, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLES["op11_fill_middle"] = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents),
drawn AS (
  SELECT *, len(u) AS n, list_transform(range(4), lambda i: ('0x' || substr(digest, 8 * i + 1, 8))::BIGINT) AS h FROM units),
cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
              WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
pieces AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle,
         array_to_string(u[b + 1:n], '') AS suffix
  FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256
FROM pieces
"""


@query
def op12_spelling_blocks(spark, sf):
    """Frequent words, their most frequent near word and the root of their forms."""
    return spelling_groups(table(spark, sf, "documents").select("doc_id", "text")).select(
        "word", "form", "root", "n", "n_near", "form_n")


ORACLES["op12_spelling_blocks"] = """
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) AS run
  FROM documents),
coded AS (SELECT run, hex(encode(id || ':' || run)) AS code FROM runs),
bits AS (
  SELECT run, list_transform(range(4 * length(code)), lambda k:
           ((('0x' || substr(code, 2 * (k // 8) + 1, 2))::BIGINT >> (k % 8)::BIGINT) & 1)) AS bits
  FROM coded),
hashed AS (
  SELECT run, xor(list_reduce(list_concat([4294967295::BIGINT], bits), lambda c, b:
           CASE WHEN (c & 1) = b THEN c >> 1 ELSE xor(c >> 1, 3988292384) END), 4294967295) AS h
  FROM bits),
damaged AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word
  FROM hashed),
words AS (SELECT word, count(*) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
shorter AS (
  SELECT DISTINCT word, substr(word, 1, k - 1) || substr(word, k + 1) AS cut
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM words)),
replaced AS (
  SELECT word, unnest(range(1, length(word) + 1)) AS k FROM words),
holed AS (SELECT word, k, substr(word, 1, k - 1) || '.' || substr(word, k + 1) AS hole FROM replaced),
near AS (
  SELECT s.word AS a, w.word AS b FROM shorter s JOIN words w ON w.word = s.cut
  UNION ALL SELECT w.word, s.word FROM shorter s JOIN words w ON w.word = s.cut
  UNION ALL SELECT x.word, y.word FROM holed x JOIN holed y ON x.hole = y.hole AND x.word <> y.word),
ranked AS (
  SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b COLLATE "C") AS r
  FROM near JOIN words ON word = b),
judged AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 10 * w.n THEN r.b END AS form,
         CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.a = w.word AND r.r = 1),
walk AS (
  SELECT word, word AS at, form AS next FROM judged
  UNION ALL SELECT w.word, j.word, j.form FROM walk w JOIN judged j ON j.word = w.next)
SELECT j.word, j.form, w.at AS root, j.n, j.n_near, j.form_n FROM judged j JOIN walk w ON w.word = j.word AND w.next IS NULL
"""


@query
def op13_site_style(spark, sf):
    """Main text of every page."""
    return main_text(table(spark, sf, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


ORACLES["op13_site_style"] = r"""
WITH articles AS (
  SELECT page_id, url, coalesce(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '') AS article FROM pages),
blocks AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(article, '</?(?:p|h1|br)>'), lambda b:
           trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]+>', '', 'g'),
             '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) AS blocks
  FROM articles),
texts AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda b: b <> ''), chr(10)) AS text FROM blocks)
SELECT page_id, url, text, length(text) AS n_chars FROM texts
"""
