"""Language identification by hierarchical discrimination.

A first layer of linear support vector machines, one against the rest, predicts the
language family. Inside a family, one machine for each pair of languages votes, and the
votes' margins name the language. All machines read hashed byte trigrams of the whole
lower-cased text. They are trained by dual coordinate descent on a bounded sample:
about ``PER_LANG`` documents of each language, chosen by a hash of doc_id.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import required

#: Feature space, training documents a language, passes over them, and the loss weight.
DIM, PER_LANG, EPOCHS, C = 4096, 600, 12, 1.0
#: Rows and bytes of texts that are featurised together; one longer text is alone.
ROWS, BYTES = 256, 1 << 21
#: Characters of a text looked at together.
WINDOW = 1 << 16
#: Margin to probability.
SLOPE = 4.0
UNKNOWN = "und"
#: Documents below this score are rejected by ``keep_identified``.
MIN_SCORE = 0.2

# Language codes by family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sk", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "sinitic": ("zh",),
    "japonic": ("ja",),
    "koreanic": ("ko",),
    "semitic": ("ar", "he"),
    "indic": ("hi", "bn", "ur", "mr"),
    "turkic": ("tr", "az", "kk"),
}


def family(lang: str) -> str:
    """The family of a code; a code not listed is a family of its own."""
    return next((f for f, members in FAMILIES.items() if lang.lower().split("-")[0] in members), lang)


def _stretches(text: str):
    """The lower-cased text in bytes, each run of white space one space, also before and after.

    It comes in stretches of bounded size, each led by the last two bytes before it.
    """
    before, open_ = b" ", False  # whether the bytes so far end inside a word
    for at in range(0, len(text), WINDOW):
        part = text[at : at + WINDOW]
        words = " ".join(part.lower().split())
        lead = " " if open_ and part[0].isspace() else ""
        if words:
            open_ = not part[-1].isspace()
            whole = before + f"{lead}{words}{'' if open_ else ' '}".encode("utf-8", "surrogatepass")
        else:
            open_, whole = False, before + lead.encode()
        yield whole
        before = whole[-2:]
    if open_:
        yield before + b" "


def featurize(text: str, dim: int = DIM) -> np.ndarray:
    """Unit vector of square-rooted, hashed trigram counts; each white-space run is one space."""
    out = np.zeros(dim)
    for raw in _stretches(text):
        part = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
        if len(part) > 2:
            codes = part[:-2] | part[1:-1] << np.uint32(8) | part[2:] << np.uint32(16)
            out += np.bincount((codes * np.uint32(2654435761)) >> np.uint32(32 - dim.bit_length() + 1), minlength=dim)
    out = np.sqrt(out)
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, c: float = C, seed: int = 7) -> np.ndarray:
    """Linear L1-loss machine by dual coordinate descent, classes weighted to balance.

    The bias is the last weight, over a constant feature.
    """
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64)
    sign = np.where(y, 1.0, -1.0)
    n = len(x)
    upper = np.where(y, c * n / (2 * max(y.sum(), 1)), c * n / (2 * max((~y).sum(), 1)))
    norms = (x * x).sum(axis=1)
    alpha, w = np.zeros(n), np.zeros(x.shape[1])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(n):
            gradient = sign[i] * (x[i] @ w) - 1
            fresh = min(max(alpha[i] - gradient / norms[i], 0.0), upper[i])
            if fresh != alpha[i]:
                w += (fresh - alpha[i]) * sign[i] * x[i]
                alpha[i] = fresh
    return w.astype(np.float32)


class Model:
    """Family machines, and for each family its languages and pairwise machines."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        self.groups: dict[str, list[str]] = {}
        for lang in sorted(langs):
            self.groups.setdefault(family(lang), []).append(lang)
        self.families = sorted(self.groups)
        of = np.array([family(v) for v in y], dtype=object)
        self.top = [train_svm(x, of == f) for f in self.families] if len(self.families) > 1 else []
        self.pairs = {}
        for f in self.families:
            for a, b in itertools.combinations(self.groups[f], 2):
                rows = (y == a) | (y == b)
                self.pairs[a, b] = train_svm(x[rows], y[rows] == a)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        sigmoid = lambda z: 1 / (1 + np.exp(-SLOPE * z))
        apply = lambda w: x @ w[:-1] + w[-1]
        n = len(x)
        if self.top:
            p = np.stack([sigmoid(apply(w)) for w in self.top], axis=1)
            p /= p.sum(axis=1, keepdims=True)
        else:
            p = np.ones((n, 1))
        best, langs, score = p.argmax(axis=1), [""] * n, np.zeros(n)
        for k, f in enumerate(self.families):
            own = self.groups[f]
            q = np.ones((n, len(own)))
            for i, j in itertools.combinations(range(len(own)), 2):
                win = sigmoid(apply(self.pairs[own[i], own[j]]))
                q[:, i] *= win
                q[:, j] *= 1 - win
            q /= np.clip(q.sum(axis=1, keepdims=True), 1e-300, None)
            for r in np.flatnonzero(best == k):
                m = int(q[r].argmax())
                langs[r], score[r] = own[m], p[r, k] * q[r, m]
        return langs, np.clip(score, 0.0, 1.0)


def held_out(doc_id) -> F.col:
    return (F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1)


def fit(docs: DataFrame, per_lang: int = PER_LANG, dim: int = DIM) -> Model | None:
    """Train on rows whose crc32(doc_id as text) mod 3 is not 1; None if there is no label.

    About ``per_lang`` documents of each language are used; the choice depends on doc_id
    alone, and of rows that repeat a doc_id and lang one is used, so the sample is bounded.
    Rows with null doc_id, text or lang are not used.
    """
    known = required(docs, "doc_id", "text", "lang").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id"))).where(F.col("text").rlike(r"\p{L}"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, per_lang / n))])
    drawn_ = known.where(drawn < share[F.col("lang")])
    sample = drawn_.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches):
        for batch in batches:
            rows = [featurize(t, dim).astype(np.float16).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["doc_id", "lang", "x"])

    rows = sorted(sample.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, x binary").collect(), key=lambda r: (r.doc_id, r.lang, r.x))
    if not rows:
        return None
    x = np.frombuffer(b"".join(r.x for r in rows), dtype=np.float16).reshape(len(rows), dim).astype(np.float32)
    y = np.array([r.lang for r in rows], dtype=object)
    return Model(sorted(set(y)), x, y)


def annotate(docs: DataFrame, model: Model | None, dim: int = DIM) -> DataFrame:
    """(row, lang_pred, score): each input row as a struct with its prediction.

    ``und`` with score 0 where text is null or has no letters, or nothing was learned.
    """
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), letters.alias("letters"))
    place = docs.columns.index("text")
    if model is None:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches):
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0).field(place)), 0).to_numpy(zero_copy_only=False))
            to = 0
            for at in iter(lambda: to, batch.num_rows):
                before = ends[at - 1] if at else 0
                to = min(max(int(np.searchsorted(ends, before + BYTES, side="right")), at + 1), at + ROWS, batch.num_rows)
                part = batch.slice(at, to - at)
                known = part.column(1).to_pylist()
                texts = part.column(0).field(place)
                langs, score = model.predict(np.stack([featurize(t.as_py() if k else "", dim) for t, k in zip(texts, known, strict=True)]))
                langs = [v if k else UNKNOWN for k, v in zip(known, langs, strict=True)]
                score = [float(s) if k else 0.0 for k, s in zip(known, score, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs), pa.array(score, pa.float64())], ["row", "lang_pred", "score"])

    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """Fit on the labelled part of ``docs(doc_id, text, lang)`` and predict every row.

    Null, empty and letterless texts are ``und`` with score 0. Repeated rows are each
    predicted; an empty table gives an empty result, and a table without any usable
    label predicts ``und``. lang, source and doc_id are no inputs of a prediction.
    """
    model = fit(docs, per_lang)
    rows = required(docs, "doc_id", "text").select("text", "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    out = annotate(rows, model)
    return out.select("row.doc_id", "row.held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE, per_lang: int = PER_LANG) -> DataFrame:
    """Rows of ``docs`` whose language is recognised with at least ``min_score``; all columns.

    Null, empty and letterless texts go. Repeated rows and null ids are each judged by their
    text; an empty table gives an empty result. Columns of any name may stand beside.
    """
    out = annotate(docs, fit(docs, per_lang))
    return out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("row.*")
