"""Language identification by compression.

Each learned language has a raw-content zstandard dictionary made of excerpts of its labelled texts. A text is
reduced to lower-case letters and spaces, cut into blocks
of equal size, each block is compressed with every dictionary, and the language of the smallest sum of sizes wins. A text
is rejected where the runner-up is nearly as small, and where no language can be told.

The model is fitted on a bounded sample: at most LANGUAGES languages (those with most rows), each with one excerpt of
EXCERPT characters from each of EXCERPTS buckets of text hashes, so that copies of one text fill one bucket. Prediction reads
whole texts. Null texts and texts without a letter are `und` with score 0. Ties go to the language with more rows, then to
the first by code point. With no learned language everything is `und`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, quoted

LANGUAGES, EXCERPTS, EXCERPT = 256, 128, 2048
BLOCK, LEVEL = 4096, 6
#: Narrowest margin, as a share of the runner-up's size, and the bytes that the winner must be ahead by.
MARGIN, AHEAD = 0.01, 2
UNKNOWN = "und"
_LETTER, _OTHER = re.compile(r"[^\W\d_]"), re.compile(r"[\W\d_]+")


def _plain(text: str) -> bytes:
    """Lower-case letters with single spaces between words."""
    return _OTHER.sub(" ", text.lower()).encode()


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that training never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, languages: int = LANGUAGES, excerpts: int = EXCERPTS, excerpt: int = EXCERPT) -> list[tuple[str, bytes]]:
    """(language, dictionary) in order of rows; labelled has text and lang."""
    labelled = labelled.filter("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = [r.lang for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()]
    rows = labelled.filter(F.col("lang").isin(known)).withColumn("h", F.xxhash64("text")).withColumn("bucket", F.pmod("h", F.lit(excerpts)))
    chosen = rows.groupBy("lang", "bucket").agg(F.min("h").alias("h"))  # languages * excerpts rows at most
    start = (F.pmod("h", F.greatest(F.length("text") - excerpt, F.lit(0)) + 1) + 1).cast("int")
    found = rows.join(F.broadcast(chosen), ["lang", "bucket", "h"]).select("lang", "bucket", F.substring("text", start, F.lit(excerpt)).alias("part"))
    found = found.groupBy("lang", "bucket").agg(F.min("part").alias("part")).collect()
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in found:
        parts.setdefault(r.lang, []).append((r.bucket, r.part))
    return [(k, b"\n".join(_plain(p) for _, p in sorted(parts[k]))) for k in known if k in parts]


class Classifier:
    """Sizes of a text under each dictionary."""

    def __init__(self, model: list[tuple[str, bytes]], block: int = BLOCK, level: int = LEVEL):
        self.block, self.languages, self.packers = block, [k for k, _ in model], []
        for _, content in model:
            own = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=level)
            self.packers.append(zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.empty = [len(p.compress(b"")) for p in self.packers]

    def sizes(self, raw: bytes) -> np.ndarray:
        out = np.zeros(len(self.packers))
        for i in range(0, len(raw), self.block):
            piece = raw[i : i + self.block]
            out += [len(p.compress(piece)) - e for p, e in zip(self.packers, self.empty, strict=True)]
        return out

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected); the score is the margin as a share of the runner-up's size."""
        if text is None or not self.packers or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(_plain(text))
        if len(sizes) == 1:
            return self.languages[0], 1.0, False
        best = int(sizes.argmin())
        second = float(np.partition(sizes, 1)[1])
        score = min(1.0, max(0.0, (second - float(sizes[best])) / max(second, 1.0)))
        return self.languages[best], score, score < MARGIN or second - sizes[best] < AHEAD


def predict(docs: DataFrame, model: list[tuple[str, bytes]], keep: list[str], only_accepted: bool = False) -> DataFrame:
    """The columns in `keep`, then lang_pred, score and rejected; or only accepted rows, without these."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    extra = [] if only_accepted else ["lang_pred string", "score double", "rejected boolean"]
    columns = keep if "text" in keep else [*keep, "text"]
    docs = docs.select(*[quoted(c) for c in columns])
    schema = ", ".join([*(f"{quoted(c)} {t}" for c, t in docs.dtypes if c in keep), *extra])

    def run(batches):
        own = Classifier(shared.value)
        for batch in batches:
            found = [own.predict(x.as_py()) for x in batch.column("text")]
            own_columns = [batch.column(c) for c in keep]
            out = pa.RecordBatch.from_arrays(own_columns, keep)
            if only_accepted:
                yield out.filter(pa.array([not x[2] for x in found], pa.bool_()))
            else:
                kinds = zip(zip(*found, strict=True) if found else ([], [], []), (pa.string(), pa.float64(), pa.bool_()), strict=True)
                yield pa.RecordBatch.from_arrays([*own_columns, *(pa.array(x, t) for x, t in kinds)], [*keep, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, schema)
