"""Registered queries of the training-data operators: thin digests over their real outputs."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import BREAK, DECIMAL, DIGITS, MEASURE, NAME, NAMED, NUMBERS, SURNAME, THIRD, decontaminate
from .elias_fano import token_shards
from .language_id import fit as fit_languages
from .language_id import identify, in_fold
from .line_dedup import line_dedup
from .ngram_join import ngram_jaccard_join
from .packing import best_fit_pack
from .suffix_dedup import suffix_dedup
from .tiff import pages, text_media
from .token_prefix import token_prefixes
from .toxicity import fit as fit_toxicity
from .toxicity import score as score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents", "doc_id", "text"), width=4, percent=85)


ORACLE_SQL["op2_ngram_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
items AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sets sx ON sx.doc_id = x JOIN sets sy ON sy.doc_id = y
  WHERE 100 * n >= 85 * (len(sx.s) + len(sy.s) - n)),
twoway AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT reach.x, twoway.y FROM reach JOIN twoway ON reach.y = twoway.x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, CAST((SELECT min(y) FROM reach WHERE reach.x = doc_id) AS BIGINT) AS component_id,
  CAST((SELECT count(*) FROM twoway WHERE twoway.x = doc_id) AS BIGINT) AS n_links
FROM sets"""


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup(table(spark, sf_dir, "documents", "doc_id", "text"), length=400, with_text=True)
    # a span may end inside a character; what is left of it is replaced in the text, not in the hash
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


@query
def op10_prefix_token_counts(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    import public_tokenizers

    counted = token_prefixes(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.length("prefix").cast("long").alias("prefix_bytes"))


@query
def op6_elias_fano_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = token_shards(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _media_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per file from its pages, which follow one another in a task."""
    held: list = []

    def row() -> tuple:
        head, sha, tail, size, total, pages_ = held
        return (head[0], head[1], size, sha.hexdigest(), zlib.crc32(tail), head[2], head[3], f"pages={pages_};rows={size // 64};mean={total / size:.6f}")

    for batch in batches:
        out = []
        for id_, n_bytes, media_bytes, media_sha, page, error, pixels in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "error")), batch.column("pixels"), strict=True):
            if error is not None:
                raise ValueError(f"document {id_}: {error}")
            raw = pixels.as_buffer()
            if page == 0:
                if held:
                    out.append(row())
                held = [(id_, n_bytes, media_bytes, media_sha), hashlib.sha256(), b"", 0, 0, 0]
            held[1].update(raw)
            held[2] = raw.slice(max(0, raw.size - 64)).to_pybytes()
            held[3] += raw.size
            held[4] += int(np.frombuffer(raw, np.uint8).sum(dtype=np.int64))
            held[5] += 1
        if out:
            yield _digests(out)
    if held:
        yield _digests([row()])


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), DIGEST, strict=True)], schema=DIGEST)


@query
def op5_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = text_media(table(spark, sf_dir, "documents", "doc_id", "text"))
    media = media.withColumn("media_bytes", F.length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    read = pages(media).select("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "error", "pixels")
    return read.mapInArrow(_media_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


@query
def op7_compression_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = table(spark, sf_dir, "documents", "doc_id", "text", "lang").where(~in_fold("doc_id"))
    return identify(table(spark, sf_dir, "documents", "doc_id", "text"), fit_languages(train))


@query
def op8_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic").where(~in_fold("doc_id"))))


@query
def op3_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def _sql_rewritten(text: str, *steps: tuple[str, str]) -> str:
    for pattern, new in steps:
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


_JOINED = _sql_rewritten("text", DECIMAL, SURNAME, THIRD)
_WORDS = _sql_rewritten(f"lower(trim({_sql_rewritten(_JOINED, NAMED, BREAK)}))", DIGITS, MEASURE)
_TEMPLATE = f"list_transform(string_split({_WORDS}, ' '), lambda x: CASE WHEN x IN ({', '.join(repr(n) for n in NUMBERS)}) THEN '#' ELSE x END)"
_RAW = f"string_split(trim({_sql_rewritten(_JOINED, BREAK)}), ' ')"
_SLOT = f"(contains(x, '#') OR x = '@' OR contains(x, '{NAME.lower()}'))"
_SLOT_AT = f"(contains(win[i], '#') OR win[i] = '@' OR contains(win[i], '{NAME.lower()}'))"
ORACLE_SQL["op9_template_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_TEMPLATE} AS w, {_RAW} AS r FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, {_TEMPLATE} AS w, {_RAW} AS r FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT doc_id, r, w, unnest(range(0, greatest(len(w) - 8, 0) + 1)) AS p FROM d WHERE w[1] <> ''),
bw AS (SELECT item_id, r, w, unnest(range(0, greatest(len(w) - 8, 0) + 1)) AS p FROM b WHERE w[1] <> ''),
bk AS (SELECT DISTINCT item_id, p AS item_at, len(w) AS item_words, w[p + 1:p + 8] AS win, r[p + 1:p + 8] AS br FROM bw
  WHERE len(list_filter(w[p + 1:p + 8], lambda x: NOT {_SLOT})) >= least(5, len(w))),
f AS (SELECT DISTINCT doc_id, item_id, item_words, p - item_at AS shift, item_at, win, br, dw.r[p + 1:p + 8] AS dr FROM bk JOIN dw ON dw.w[p + 1:p + 8] = bk.win),
c AS (SELECT doc_id, item_id, item_words, shift, item_at, unnest(range(1, len(win) + 1)) AS i, win, br, dr FROM f),
l AS (SELECT doc_id, item_id, item_words, shift, count(DISTINCT item_at) AS n_windows, count(DISTINCT item_at + i) AS covered,
    count(DISTINCT CASE WHEN {_SLOT_AT} THEN lower(br[i]) END) AS nb,
    count(DISTINCT CASE WHEN {_SLOT_AT} THEN lower(dr[i]) END) AS nd,
    count(DISTINCT CASE WHEN {_SLOT_AT} THEN lower(br[i]) || chr(10) || lower(dr[i]) END) AS np,
    bool_and(lower(br[i]) = lower(dr[i]) OR NOT {_SLOT_AT}) AS same FROM c GROUP BY ALL),
k AS (SELECT *, CASE WHEN same THEN 0 WHEN nb = np AND nd = np THEN 1 END AS kind FROM l)
SELECT doc_id, item_id, CAST(sum(n_windows) AS BIGINT) AS n_windows, CAST(max(covered) AS BIGINT) AS covered, CAST(max(item_words) AS BIGINT) AS item_words,
  CASE min(kind) WHEN 0 THEN 'exact' ELSE 're-parameterised' END AS kind
FROM k WHERE kind IS NOT NULL AND (covered >= 10 OR covered >= 0.5 * item_words) GROUP BY doc_id, item_id"""


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
