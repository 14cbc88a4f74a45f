"""Language identification with error-correcting output codes over hashed byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, texts

#: Hash buckets of the n-grams and their lengths in bytes.
BUCKETS, LENGTHS = 1 << 12, (2, 3, 4)
#: Bits of a codeword beyond the number that tells the languages apart.
EXTRA_BITS = 12
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: ASCII letters in lower case, bytes of other characters as they are, everything else a blank.
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def _grams(text: bytes) -> np.ndarray:
    """Counts of hashed n-grams; those that begin with a run of blanks are left out."""
    folded = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    folded = folded[np.r_[True, (folded[1:] != 32) | (folded[:-1] != 32)]]
    letters, counts = folded.astype(np.uint32), np.zeros(BUCKETS, np.int64)
    for n in LENGTHS:
        if len(letters) >= n:
            gram = letters[: len(letters) - n + 1].copy()
            for i in range(1, n):
                gram = (gram << np.uint32(8)) | letters[i : len(letters) - n + 1 + i]
            gram = (gram + np.uint32(n)) * np.uint32(2654435761)
            counts += np.bincount(gram >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    return counts


def _pieces(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A long text in pieces that together hold the whole of it; memory stays bounded."""
    for i in range(0, max(len(text), 1), size):
        yield text[i : i + size]


def grams(text: bytes) -> np.ndarray:
    """N-gram counts of the whole text."""
    return sum(_grams(p) for p in _pieces(text))


def codewords(classes: int, seed: int = 1) -> np.ndarray:
    """A row of +1 and -1 per class: of many seeded draws the one whose closest rows differ most.

    Bits that do not part the classes are drawn again. The draw depends on the number of classes only.
    """
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(np.log2(max(classes, 2)))) + EXTRA_BITS
    best, apart = None, -1
    for _ in range(32):
        code = rng.choice([-1, 1], size=(classes, bits))
        for b in range(bits):
            while classes > 1 and abs(code[:, b].sum()) == classes:
                code[:, b] = rng.choice([-1, 1], size=classes)
        differ = (bits - code @ code.T) // 2 + bits * np.eye(classes, dtype=int)
        if differ.min() > apart:
            best, apart = code, differ.min()
    return best


@dataclass
class Model:
    """Languages, their codewords, one weight vector per bit and 1 for each bit that parts the classes, else 0."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language the n-gram counts of a task's rows, as one row per language and bucket."""
    sums: dict[str, np.ndarray] = {}
    for batch in slices(batches, 1):
        for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            got = grams(text)
            if lang in sums:
                sums[lang] += got
            else:
                sums[lang] = got
    for lang, got in sums.items():
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(got[at])],
                                         names=["lang", "bucket", "n"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """One binary classifier per codeword bit, from all rows with a language.

    The n-gram counts of the languages are summed in Spark; what reaches the driver is one number per
    language and bucket (``BUCKETS`` of them), whatever the number of rows. A bit's classifier weighs
    an n-gram by the log odds between the languages whose codeword has the bit and the others. Rows
    without text or language are not learned from.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sums = rows.mapInArrow(_counts, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toPandas()
    langs = sorted(got["lang"].unique())
    if not langs:
        return Model([], np.ones((0, 1), int), np.zeros((BUCKETS, 1)), np.zeros(1))
    counts = np.zeros((len(langs), BUCKETS))
    counts[np.searchsorted(langs, got["lang"].to_numpy(dtype=object)), got["bucket"]] = got["n"]
    code = codewords(len(langs))
    shares = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    weights = np.zeros((BUCKETS, code.shape[1]))
    scale = np.zeros(code.shape[1])
    for b in range(code.shape[1]):
        on, off = shares[code[:, b] > 0], shares[code[:, b] < 0]
        if len(on) and len(off):
            weights[:, b] = np.log(on.mean(axis=0) / off.mean(axis=0))
            margins = shares @ weights[:, b] * code[:, b]
            scale[b] = 1 / max(abs(margins).mean(), 1e-9)  # how far the bit holds its classes apart
    return Model(langs, code, weights * scale, (scale > 0).astype(float))


def decode(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss-based decoding with equal weights: index of the language with the smallest loss, its score and the gap.

    The loss of a language is the sum over bits of log(1 + exp(-2 c m)) for its codeword bit c and the
    classifier's margin m. ``score`` is the share of exp(-loss); ``gap`` is the distance to the runner-up
    per bit.
    """
    signed = margins[:, None, :] * model.code[None, :, :]
    loss = (np.logaddexp(0, -2 * signed) * model.scale).sum(axis=2)
    best = loss.argmin(axis=1)
    low = loss[np.arange(len(loss)), best]
    score = 1 / np.exp(low[:, None] - loss).sum(axis=1)
    if loss.shape[1] > 1:
        gap = (np.partition(loss, 1, axis=1)[:, 1] - low) / max(model.scale.sum(), 1)
    else:
        gap = np.ones(len(loss))
    return best, np.clip(score, 0, 1), gap


def identify(docs: DataFrame, model: Model, text: str = "text", ambiguous_below: float = 0.05) -> DataFrame:
    """Every row with all its columns and ``_lang_pred``, ``_score`` (0 to 1) and ``_ambiguous``.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned. A text is
    ambiguous if two languages lie within ``ambiguous_below`` of each other. Only the text plays a
    part; repeated rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages times buckets, whatever the number of rows
    known = len(model.langs) > 0
    at_text = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches, at_text):
            raw = texts(batch.column(at_text))
            lettered = np.array([bool(_LETTER.search(t.decode("utf-8", "replace"))) for t in raw], bool)
            pred = np.full(len(raw), UNKNOWN, dtype=object)
            score, unsure = np.zeros(len(raw)), np.ones(len(raw), bool)
            at = np.flatnonzero(lettered) if known else []
            for i in range(0, len(at), 64):
                some = at[i : i + 64]
                counts = np.stack([grams(raw[k]) for k in some]).astype(float)
                best, s, gap = decode(counts @ m.weights / counts.sum(axis=1, keepdims=True), m)
                pred[some], score[some], unsure[some] = np.array(m.langs, dtype=object)[best], s, gap < ambiguous_below
            new = [pa.array(pred, pa.string()), pa.array(score), pa.array(unsure)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "_lang_pred", "_score", "_ambiguous"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_lang_pred", T.StringType()),
                           T.StructField("_score", T.DoubleType()), T.StructField("_ambiguous", T.BooleanType())])
    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text", ambiguous_below: float = 0.05) -> DataFrame:
    """``doc``, ``lang_pred``, ``score`` and ``ambiguous`` of every row; see ``identify``."""
    slim = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    found = identify(slim, model, "text", ambiguous_below)
    return found.select("doc", F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"), F.col("_ambiguous").alias("ambiguous"))


def held_out(doc: Column) -> Column:
    """Rows kept from learning: CRC-32 of the id as text leaves 1 when divided by 3; none without an id."""
    return F.coalesce(F.pmod(F.crc32(doc.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
