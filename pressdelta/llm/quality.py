"""Quality scores from compression with dictionaries of good and of bad text.

Two zstandard dictionaries are built from labelled documents, one for each label. A
text is cut into blocks so that every part of it, not only its start, is compressed
against the dictionaries rather than against itself. The difference of the two
compressed sizes, divided by the text's length, tells the labels apart. Text that both
dictionaries compress to almost nothing (one phrase over and over) has no difference to
show, so the calibration also sees the size with the good dictionary over the length
and its square. A logistic curve over these, fitted on documents that built neither
dictionary, gives the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import required

#: Labelled documents drawn for each label, and the part of them kept for calibration.
PER_LABEL, CALIBRATION = 1200, 0.4
#: Bytes taken of one document into a dictionary, of a dictionary, and of a block.
EXCERPT, DICTIONARY, BLOCK = 1 << 13, 112 << 10, 1 << 11
#: Bytes of one piece of an excerpt.
PIECE = 1 << 9
LEVEL, THRESHOLD = 3, 0.3
#: Added to every length, so that a few bytes prove little.
PRIOR_BYTES = 32


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


class Compressors:
    """The two dictionaries, ready to measure texts."""

    def __init__(self, good: bytes, bad: bytes):
        kind = zstandard.DICT_TYPE_AUTO
        self.good, self.bad = (zstandard.ZstdCompressionDict(d, dict_type=kind) if d else None for d in (good, bad))
        params = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        for d in (self.good, self.bad):
            if d:
                d.precompute_compress(level=LEVEL)
        self.engines = [zstandard.ZstdCompressor(dict_data=d, **params) if d else zstandard.ZstdCompressor(**params) for d in (self.good, self.bad)]
        self.floor = len(self.engines[0].compress(b""))

    def values(self, text: str | None) -> tuple[float, float, float]:
        """(bad - good) / length, good / length and its square; all 0 for an empty text."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        sizes = [0, 0]
        for at in range(0, len(raw), BLOCK):
            block = raw[at : at + BLOCK]
            for k, engine in enumerate(self.engines):
                sizes[k] += len(engine.compress(block)) - self.floor
        over = len(raw) + PRIOR_BYTES
        share = sizes[0] / over
        return (sizes[1] - sizes[0]) / over, share, share * share


class Model:
    """Dictionaries as bytes and the calibration curve; compressors are made where used."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray):
        self.good, self.bad, self.weights = good, bad, weights

    def score(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(values @ self.weights[:-1] + self.weights[-1], -60, 60)))


def spread(raw: bytes, bound: int, piece: int = PIECE) -> bytes:
    """At most ``bound`` bytes: pieces at even distances from the first byte to the last."""
    if len(raw) <= bound:
        return raw
    count = bound // piece
    return b"".join(raw[at : at + piece] for at in (i * (len(raw) - piece) // (count - 1) for i in range(count)))


def _excerpts(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, quality, text)`` with an excerpt drawn over the whole of each text."""

    def run(batches):
        for batch in batches:
            out = [spread(t.as_py().encode("utf-8", "surrogatepass"), EXCERPT) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], ["doc_id", "quality", "excerpt"])

    return docs.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in docs.dtypes[:2]) + ", excerpt binary")


def _dictionary(texts: list[bytes]) -> bytes:
    samples = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their bytes themselves
        return spread(b"".join(samples), DICTIONARY)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights and offset by Newton's method; columns are scaled for the ridge."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, pull = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + pull
        w += np.linalg.solve(h, a.T @ (y - p) - pull @ w)
    slopes = w[:-1] / scale
    return np.append(slopes, w[-1] - slopes @ mean)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Train on labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    About ``per_label`` documents of each label are used, chosen by a hash of doc_id, one row
    of those that repeat it;
    of each the dictionary takes an excerpt of at most ``EXCERPT`` bytes, drawn in pieces
    from its whole length. Without labels the score is 0.5 everywhere.
    """
    known = required(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id"))).distinct()
    sizes = {r.quality: r.n for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model(b"", b"", np.zeros(4))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    share = F.create_map(*[F.lit(v) for q, n in sizes.items() for v in (q, min(1.0, per_label / n))])
    chosen = known.where(drawn < share[F.col("quality")])  # about 2 * per_label ids: bounded
    texts = required(docs, "doc_id", "text").where("text IS NOT NULL")
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(1000)) < int(1000 * CALIBRATION)
    build = rows.where(~part)
    excerpts = sorted((r.doc_id, r.quality, bytes(r.excerpt)) for r in _excerpts(build.select("doc_id", "quality", "text")).collect())
    good, bad = (_dictionary([e for _, q, e in excerpts if q == label]) for label in (1, 0))
    measured = _measured(rows.where(part).select("quality", "text"), Model(good, bad, np.zeros(4)), raw=True).collect()
    if not measured:
        return Model(good, bad, np.zeros(4))
    measured.sort()
    return Model(good, bad, _logistic(np.array([r[1:] for r in measured]), np.array([float(r.quality) for r in measured])))


def _measured(docs: DataFrame, model: Model, raw: bool = False) -> DataFrame:
    """All columns but text, which comes last in ``docs``, with the score or the values."""
    keys = docs.columns[:-1]
    out = ["difference", "share", "square"] if raw else ["score"]

    def run(batches):
        tools = Compressors(model.good, model.bad)
        for batch in batches:
            values = np.array([tools.values(t.as_py()) for t in batch.column(len(keys))]).reshape(-1, 3)
            columns = values.T if raw else [model.score(values)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, pa.float64()) for c in columns]], [*keys, *out])

    return docs.mapInArrow(run, ", ".join([f"`{n}` {t}" for n, t in docs.dtypes[:-1]] + [f"{n} double" for n in out]))


def quality(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs(doc_id, text)``.

    Null and empty texts measure 0 and get the curve's value there. Repeated rows
    are each scored; empty tables give empty results. labels, lang, source and doc_id
    are no inputs of a score; other columns are ignored.
    """
    rows = required(docs, "doc_id", "text").select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    out = _measured(rows, fit(docs, labels, per_label))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
