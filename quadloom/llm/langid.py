"""Language ID by compression with per-language zstandard raw-content dictionaries."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.common import map_arrow, remainder

OTHER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """Documents that one language's dictionary is built from, bytes of a dictionary and of a coded chunk."""

    documents: int = 96
    dictionary: int = 64 * 1024
    chunk: int = 2048
    level: int = 12
    #: A prediction is rejected if the second language needs less than this share more bytes.
    margin: float = 0.01


def normalised(text: str | None) -> str:
    """Lower case, every run of other characters than letters a space."""
    return OTHER.sub(" ", (text or "").lower()).strip()


def dictionary_text(texts: list[str], settings: Settings) -> bytes:
    """Equal shares of all texts, taken as slices spread over the whole of each; zstandard favours the end."""
    clean = [n for n in map(normalised, texts) if n]
    share = max(64, settings.dictionary // max(1, len(clean)))
    out = []
    for text in clean:
        data = text.encode()
        pieces = min(4, max(1, len(data) // 256))
        if len(data) <= share:
            out.append(data)
        else:
            out += [data[at : at + share // pieces] for at in (i * len(data) // pieces for i in range(pieces))]
    return b" ".join(out)[-settings.dictionary :]


@dataclass(frozen=True)
class Model:
    dictionaries: dict[str, bytes]
    settings: Settings

    def compressors(self) -> dict:
        out = {}
        for lang, data in sorted(self.dictionaries.items()):
            told = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            told.precompute_compress(level=self.settings.level)
            out[lang] = zstandard.ZstdCompressor(dict_data=told, write_content_size=False, write_checksum=False, write_dict_id=False).compress
        return out

    def predict(self, text: str | None, compressors: dict) -> tuple[str, float, bool]:
        """Language, score, rejected."""
        clean = normalised(text)
        if not any(map(str.isalpha, clean)) or not compressors:
            return "und", 0.0, True
        data, width = f" {clean} ".encode(), self.settings.chunk
        chunks = [data[at : at + width] for at in range(0, len(data), width)]
        sizes = sorted((sum(len(f(c)) for c in chunks), lang) for lang, f in compressors.items())
        best, second = sizes[0][0], sizes[1][0] if len(sizes) > 1 else 2 * sizes[0][0]
        weights = np.exp(-np.minimum(50.0, np.array([s - best for s, _ in sizes]) / 4))
        return sizes[0][1], float(1 / weights.sum()), second < best * (1 + self.settings.margin)


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Dictionaries from at most settings.documents training texts of each language, chosen by a hash of doc_id.

    The rank limit is applied per task before the shuffle, so a language with most rows costs no more
    than another. What reaches the driver is bounded by the languages times a dictionary. Rows that repeat
    a doc_id and language share its place and count one after the other; null ids, languages and texts
    without a letter teach nothing. An empty table: a model without languages. Other columns are ignored.
    """
    train = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (remainder(F.col("doc_id"), 5) != 0))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("long"), F.lit(11)), "doc_id")
    chosen = train.select("lang", "doc_id").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= settings.documents).select("lang", "doc_id", "nth")
    texts = train.select("lang", "doc_id", "text").join(F.broadcast(chosen), ["lang", "doc_id"])
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("nth", T.IntegerType()), T.StructField("piece", T.BinaryType())])
    # the share of a full dictionary; a language of fewer documents fills its dictionary with longer slices
    counts = chosen.groupBy("lang").agg(F.count("*").alias("n"))
    told = {r.lang: r.n for r in counts.collect()}

    def each(batch):
        lang, text = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        one = [Settings(dictionary=settings.dictionary // max(1, told.get(k, 1))) for k in lang]
        return {"lang": batch.column(0), "nth": batch.column(1), "piece": [dictionary_text([t], s) for t, s in zip(text, one, strict=True)]}

    pieces: dict[str, list] = {}
    for r in map_arrow(texts.select("lang", F.col("nth").cast("int"), "text"), each, schema).collect():
        pieces.setdefault(r.lang, []).append((r.nth, bytes(r.piece)))
    return Model({lang: b" ".join(p for _, p in sorted(ps))[-settings.dictionary :] for lang, ps in pieces.items()}, settings)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; one row per input row.

    Texts are coded whole, in chunks, so that a long text does not become its own dictionary. Null texts
    and texts without a letter: 'und', score 0. Ties go to the smaller language code. score is the best
    language's share if 4 bytes count for a factor e. Without training data all are 'und'. Repeated rows
    are predicted alike; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    ready: list = []

    def each(batch):
        if not ready:
            ready.append(model.compressors())
        got = [model.predict(t.as_py(), ready[0]) for t in batch.column(2)]
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "rejected": [g[2] for g in got]}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), remainder(F.col("doc_id"), 5) == 0, "text"), each, schema)
