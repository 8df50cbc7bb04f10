"""Language identification by compression.

Each language has a raw-content zstandard dictionary, made of the whole texts of a bounded sample of labelled rows. A text is encoded
whole, in pieces, with every dictionary; the language of the smallest encoding wins. A text is rejected when the best
two encodings are too near each other.

Texts are lower-cased and everything but letters becomes a space first, so that layout and symbols cost the same in
every language. Ties go to the language with more sampled text, then by name.

Edge cases: null texts and texts without letters are ``und``, score 0, rejected; without any labelled text all are;
labels may be any string; the label, source and id of a row are never read when it is predicted; repeated rows are
predicted alike; extra columns are kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.tokens import free_memory

UNKNOWN = "und"
#: Texts that are Python strings at once.
PYTHON_TEXTS = 256
RESULT = "lang_pred string, score double, margin double, rejected boolean"


@dataclass(frozen=True)
class Options:
    """``sample_docs`` labelled rows of each language are learned from at most: their whole texts make up the dictionary,
    in the order of the sample, until it has ``dictionary_bytes``. Texts are encoded in pieces of ``piece_bytes``. A
    text is rejected when the best encoding is smaller than the second best by less than ``min_margin`` of the latter."""

    sample_docs: int = 128
    dictionary_bytes: int = 65536
    piece_bytes: int = 4096
    level: int = 6
    min_margin: float = 0.002


def normalised(text: str) -> bytes:
    """The letters (``str.isalpha``), lower-cased, with one space for whatever stands between them."""
    text = re.sub(r"[\W\d_]+", " ", text.lower())
    if odd := [c for c in set(text) if c != " " and not c.isalpha()]:  # signs that count as numbers but are no digits
        text = re.sub(f"[{re.escape(''.join(odd))} ]+", " ", text)
    return text.strip().encode()


def learn(labelled: DataFrame, options: Options = Options()) -> list[tuple[str, bytes]]:
    """Dictionaries by language, most sampled text first, from rows with doc_id, text and lang.

    The sample is the rows with the smallest hash of doc_id, found with a limit inside each task before anything is
    shuffled; only then are their texts read.
    """
    known = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= options.sample_docs)
    chosen = F.broadcast(ids.select("doc_id", "lang").distinct())  # at most sample_docs rows a language
    rows = (
        known.select("doc_id", "lang", "text")
        .join(chosen, ["doc_id", "lang"], "left_semi")
        .distinct()
        .collect()
    )
    parts: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"])):
        own = parts.setdefault(r["lang"], [])
        if (body := normalised(r["text"])) and sum(map(len, own)) < options.dictionary_bytes:
            own.append(body)
    models = [(lang, b" ".join(bodies)) for lang, bodies in parts.items() if bodies]
    return sorted(models, key=lambda m: (-len(m[1]), m[0]))


class Classifier:
    def __init__(self, models: list[tuple[str, bytes]], options: Options) -> None:
        self.options, self.encoders = options, []
        for lang, content in models:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=options.level)
            c = zstandard.ZstdCompressor(level=options.level, dict_data=d, write_content_size=False, write_dict_id=False)
            self.encoders.append((lang, c))

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        body = normalised(text) if text else b""
        if not body or not self.encoders:
            return UNKNOWN, 0.0, 0.0, True
        step = self.options.piece_bytes
        pieces = [body[i : i + step] for i in range(0, len(body), step)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for _, c in self.encoders]
        best = min(sizes)
        at = sizes.index(best)
        rest = sizes[:at] + sizes[at + 1 :]
        margin = (min(rest) - best) / min(rest) if rest else 1.0
        score = 1.0 / sum(2.0 ** -min(60, s - best) for s in sizes)
        return self.encoders[at][0], score, margin, margin < self.options.min_margin


def identify(docs: DataFrame, models: list[tuple[str, bytes]], options: Options = Options()) -> DataFrame:
    """``docs`` with lang_pred, score, margin and rejected. Texts are read where they lie; nothing is shuffled."""

    @F.arrow_udf(RESULT)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classify = Classifier(models, options)
        for texts in batches:
            told: list[tuple] = []
            for start in range(0, len(texts), PYTHON_TEXTS):
                told += [classify(t) for t in texts.slice(start, PYTHON_TEXTS).to_pylist()]
            columns = list(zip(*told, strict=True)) or [()] * 4
            arrays = [pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.StructArray.from_arrays(arrays, ["lang_pred", "score", "margin", "rejected"])
        free_memory()

    names = ["lang_pred", "score", "margin", "rejected"]
    kept = [c for c in docs.columns if c not in names]
    predict = predict.asNondeterministic()  # or else a filter on the result would have every text encoded twice
    return docs.select(*kept, predict("text").alias("__p")).select(*kept, *[f"__p.{n}" for n in names])


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id, as text, leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
