"""Language identification by compression.

Each language has a zstandard raw-content dictionary of its own labelled texts.  A text is
cut into blocks, each block is compressed with every dictionary, and the language with the
smallest sum is chosen.  Blocks keep a long text from becoming its own dictionary.

Text is lower-cased, and all that is not a letter counts as a blank.  The score is the
chosen language's share of 2^-bytes over all languages; ``rejected`` marks a narrow margin:
the runner-up needs less than ``margin`` more than the winner.

The fit reads a bounded sample: the ``per_language`` labelled rows of least id hash of each
language (``languages`` distinct labels are read at most), ``sample_chars`` characters of
each, ``dictionary`` bytes in all, or a language's share of ``total`` bytes if that is less;
these go to the driver.  Of rows with one id and language the least text is read.  Predictions use whole texts.

Defined results: null text or text without a letter is "und" with score 0, and so is every
text where nothing is labelled.  Equal texts get equal predictions; ties go to the
language that is labelled more often.  Rows with a null id or language are predicted, not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048
LEVEL = 5

#: ASCII that isn't a letter becomes a blank; other bytes stay.
_BLANKS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def canonical(text: str | None) -> bytes:
    """Lower-case words without marks and digits."""
    if not text:
        return b""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANKS).split())


def has_letter(text: str | None, flat: bytes) -> bool:
    return flat.isascii() and bool(flat) or bool(text) and any(c.isalpha() for c in text)


class CompressionClassifier:
    """The fitted model: language -> raw dictionary bytes."""

    def __init__(self, dictionaries: dict[str, bytes], margin: float = 0.01):
        self.dictionaries, self.margin, self._ready = dict(dictionaries), margin, None

    def __getstate__(self) -> dict:
        return {"dictionaries": self.dictionaries, "margin": self.margin, "_ready": None}

    def sizes(self, flat: bytes) -> np.ndarray:
        import zstandard

        if self._ready is None:
            self._ready = []
            for raw in self.dictionaries.values():
                known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(level=LEVEL)
                self._ready.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        blocks = [flat[i : i + BLOCK] for i in range(0, len(flat), BLOCK)]
        return np.array([sum(len(squeeze(b)) for b in blocks) for squeeze in self._ready])

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        flat = canonical(text)
        if not self.dictionaries or not has_letter(text, flat):
            return "und", 0.0, True
        size = self.sizes(flat)
        best = int(size.argmin())
        score = float(1 / np.exp2(np.maximum(-1000.0, (size[best] - size).astype(float))).sum())
        rest = np.delete(size, best)
        return list(self.dictionaries)[best], score, bool(len(rest) and rest.min() - size[best] < self.margin * size[best])


def in_fold(id_col: str, fold: int = 0, folds: int = 5) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id is in none."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 200, sample_chars: int = 4000, dictionary: int = 1 << 17, languages: int = 4096, total: int = 32 << 20, margin: float = 0.01) -> CompressionClassifier:
    """Learn from rows of train with an id, a text and a language."""
    rows = train.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull())
    usual = [r[0] for r in rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(languages).collect()]
    order = Window.partitionBy(lang_col).orderBy(F.xxhash64(id_col), id_col)
    picked = rows.select(id_col, lang_col).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language)
    ids = sorted({r[0] for r in picked.collect()})
    texts = rows.where(F.col(id_col).isin(ids)).select(lang_col, F.xxhash64(id_col).alias("h"), F.substring(text_col, 1, sample_chars).alias("t")).groupBy(lang_col, "h").agg(F.min("t").alias("t")).collect() if ids else []
    dictionary = min(dictionary, total // max(1, len(usual)))
    out: dict[str, bytes] = {}
    by_lang: dict[str, list[tuple[int, str]]] = {}
    for r in texts:
        by_lang.setdefault(r[lang_col], []).append((r["h"], r["t"] or ""))
    for lang in usual:
        raw = b" ".join(canonical(t) for _, t in sorted(by_lang.get(lang, [])))[-dictionary:]
        if len(raw) >= 8:
            out[lang] = raw
    return CompressionClassifier(out, margin)


def _predict_stage(model: CompressionClassifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            lang, score, rejected = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    return run


def identify(df: DataFrame, model: CompressionClassifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, rejected), from the text alone."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), in_fold(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predict_stage(model), "id long, held_out boolean, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
