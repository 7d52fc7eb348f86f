"""Quality by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are trained from a bounded sample of labelled text.  A text is
compressed piece by piece with each, so that what the dictionaries know counts
along the whole of it.  The difference of the compressed sizes over their sum is
its normalised difference; logistic regression on the sample's other half turns
the differences into a calibrated probability of good.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satledger.llm.common import arrow_text, small_batches, store, with_text
from satledger.llm.toxicity import labelled_sample

#: Bound on the labelled rows that dictionaries and calibration see.
SAMPLE_ROWS = 12_000
#: Bound on the bytes of a row's text that a dictionary learns from: pieces spread over all of it.
LEARN_BYTES = 4096
#: Bytes of a piece that is compressed on its own.
PIECE = 2048
DICTIONARY = 64 << 10
LEVEL = 3


def _pieces(text: bytes) -> list[bytes]:
    return [text[i:i + PIECE] for i in range(0, len(text), PIECE)]


def _spread(text: bytes) -> list[bytes]:
    """At most ``LEARN_BYTES`` of a text, in pieces from all over it."""
    parts = [text[i:i + PIECE // 4] for i in range(0, len(text), PIECE // 4)]
    most = LEARN_BYTES // (PIECE // 4)
    return parts if len(parts) <= most else [parts[i * len(parts) // most] for i in range(most)]


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary of the samples; where they are too few to train one, themselves."""
    samples = [p for p in samples if len(p) >= 8]
    total = sum(map(len, samples))
    while size >= 1024:
        if total >= 4 * size and len(samples) >= 16:
            try:
                return zstandard.train_dictionary(size, samples).as_bytes()
            except zstandard.ZstdError:
                pass
        size //= 2
    return b"".join(samples)[-DICTIONARY:]


class Sizes:
    """Compressed sizes of a text with each dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.makers = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False) if d else
                       zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
                       for d in (zstandard.ZstdCompressionDict(x) if x else None for x in (good, bad))]

    def features(self, text: bytes) -> list[float]:
        """Normalised difference, the same for short texts, both ratios, log length."""
        g = b = 0
        for piece in _pieces(text):
            g += len(self.makers[0].compress(piece))
            b += len(self.makers[1].compress(piece))
        n = max(1, len(text))
        diff = (b - g) / max(1, b + g)
        return [diff, diff * min(1.0, n / 200), g / n, b / n, math.log1p(n) / 10]


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps; scales, means and weights in one array."""
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(5), np.ones(5))
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    w[-1] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * len(y) * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * len(y) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.max(np.abs(step)) < 1e-8:
            break
    return np.stack([np.append(mean, 0), np.append(scale, 1), w])


def probability(model: np.ndarray, x: np.ndarray) -> np.ndarray:
    z = np.column_stack([(x - model[0, :-1]) / model[1, :-1], np.ones(len(x))])
    return 1 / (1 + np.exp(-np.clip(z @ model[2], -30, 30)))


def _measure(dictionaries, model, out: pa.Schema, text_at: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(*dictionaries.value)
        for batch in batches:
            raw, at = arrow_text(batch.column(text_at))
            x = np.array([sizes.features(raw[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]).reshape(len(batch), 5)
            more = pa.array(probability(model.value, x)) if model else pa.array(x.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, more], schema=out)

    return run


def _learn(out: pa.Schema):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = arrow_text(batch.column(1))
            pieces = [_spread(raw[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, out.types[1])], schema=out)

    return run


def scored(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, parts: int = 4, held_out: int = 2,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc`` (a struct of the other columns), ``text`` and ``quality`` (0 to 1) of every row.

    Labels come from ``labels`` (doc_id, quality), but not of rows whose
    crc32(doc_id) modulo ``parts`` is ``held_out``.  The dictionaries learn at most
    ``LEARN_BYTES`` of each sampled text, in pieces from all over it; calibration and
    scores read whole texts.  Null and empty texts compress to
    nothing and get what the calibration says of length 0; with no labels every
    score is a half.  Repeated rows get equal scores, ids may be null or repeat.  An empty
    table gives no rows.  Columns of any names (dots, clashes) travel in ``doc``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    sample = store(labelled_sample(docs, labels, "quality", parts, held_out, sample_rows, id_col, text_col)
                   .withColumn("learns", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(2)) == 0), "quality-sample")
    ddl = "label int, pieces array<binary>"
    learn = (sample.where("learns").select("label", "text").mapInArrow(_learn(to_arrow_schema(StructType.fromDDL(ddl))), ddl)
             .collect())  # sample_rows * LEARN_BYTES at most
    by_label = [[bytes(p) for r in learn if r["label"] == y for p in r["pieces"]] for y in (1, 0)]
    dictionaries = sc.broadcast(tuple(dictionary(t) for t in by_label))

    schema = StructType.fromDDL("label int, text string, features array<double>")
    rest = sample.where("not learns").select("label", "text")
    measured = rest.mapInArrow(_measure(dictionaries, None, to_arrow_schema(schema), 1), schema).select("label", "features").collect()
    x = np.array([r["features"] for r in measured]).reshape(len(measured), 5)
    model = sc.broadcast(calibrate(x, np.array([r["label"] for r in measured], float)))

    whole = with_text(docs, text_col)
    out = StructType([*whole.schema.fields, *StructType.fromDDL("quality double").fields])
    return whole.mapInArrow(_measure(dictionaries, model, to_arrow_schema(out), 1), out)
