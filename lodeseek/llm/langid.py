"""Language identification by error-correcting output codes.

Each language has a codeword. A bit's classifier weighs byte trigrams of the text (UTF-8, A-Z lower-cased, whatever is no
letter as a space) by the log ratio of their balanced frequencies among the languages with that bit set and those
without. A text's margins are its mean weights, scaled so that short texts have small ones; decoding adds the logistic
losses of a codeword's bits, weighted by how well the bit separates its closest languages, and takes the smallest sum.
``score`` is the share of the best codeword in the softmax of the negative sums; a lead of less than ``clear`` over the
next flags the text as ambiguous.

Fitting counts trigrams on executors, over at most about ``max_docs`` labelled documents a language, chosen by a hash of
their ids, and sends the driver at most languages * 2**16 counts, as columns of numbers. Every label is learned, however
many there are; a caller whose driver holds only so many may give ``max_languages``, beyond which fitting raises. The model
is 2**16 floats a bit, and is broadcast.

Prediction reads every whole text once and shuffles nothing. A text is weighed CHUNK trigrams at a time, so that what a
task holds besides the text doesn't grow with it.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without any labelled document all are
``und``; one language alone is predicted with score 1; null labels are not learned; a document without an id is neither
held out nor learned; repeated rows are predicted each alone; columns of other names are ignored; equal sums go to the
language first by code point.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import bytes_of, map_batches, smaller_batches, worker_cache

BITS = 16
NONE = 1 << BITS
UND = "und"
ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_()), ("margins", pa.list_(pa.float64()))])
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean, margins array<double>"
#: Byte to symbol: letters in lower case, bytes of other characters than ASCII as they are, the rest a space.
FOLD = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))
#: Trigrams by which a long text's margin is multiplied; a text of so many has half of it.
SCALE = 40.0
#: Trigrams whose weights are gathered at a time.
CHUNK = 1 << 14

_ascii_letter = re.compile(rb"[A-Za-z]").search


def has_letter(text: bytes) -> bool:
    return bool(_ascii_letter(text)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram, NONE for those with two spaces or more, and where each text's begin (and the last ends)."""
    joined = b"  ".join([b" " + t for t in texts]) + b"    "
    b = np.frombuffer(joined.translate(FOLD), np.uint8)
    ends = np.cumsum([0, *(len(t) + 3 for t in texts)])
    wide = b.astype(np.uint32)
    h = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    h >>= np.uint32(32 - BITS)
    space = (b == 32).view(np.uint8)
    h[space[:-2] + space[1:-1] + space[2:] >= 2] = NONE
    return h, ends


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # 2**BITS + 1 x bits; the last row is 0
    importance: np.ndarray  # of each bit

    def margins(self, texts: list[bytes]) -> np.ndarray:
        h, ends = trigrams(texts)
        out = np.zeros((len(texts), self.code.shape[1]))
        for i in range(len(texts)):
            own = h[ends[i] : ends[i + 1]]
            for at in range(0, len(own), CHUNK):
                out[i] += self.weights.take(own[at : at + CHUNK], axis=0).sum(axis=0)
            out[i] *= SCALE / (SCALE + np.count_nonzero(own != NONE))
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score and its lead over the next."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.importance
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        top = share[np.arange(len(share)), best]
        share[np.arange(len(share)), best] = 0
        return best, top, top - share.max(axis=1)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """Exhaustive codes up to seven languages; beyond, the best by least distance of some random ones."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 7:
        return np.array([[1.0] + [1.0 if (j >> i) & 1 else -1.0 for i in range(n - 1)] for j in range(2 ** (n - 1) - 1)]).T
    rng, most, best = np.random.default_rng(seed), -1.0, np.zeros(0)
    for _ in range(40):
        code = rng.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        code[0, np.abs(code.sum(axis=0)) == n] *= -1
        least = float((code.shape[1] - code @ code.T - 2 * code.shape[1] * np.eye(n) * -1).min())
        if least > most:
            most, best = least, code
    return best


def build(counts: dict[str, np.ndarray]) -> Model:
    languages = sorted(counts)
    code = codewords(len(languages))
    p = np.array([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * NONE) for x in languages]).reshape(len(languages), NONE)
    up, down = (code > 0).astype(float), (code < 0).astype(float)
    w = np.log((up / np.maximum(up.sum(axis=0), 1)).T @ p) - np.log((down / np.maximum(down.sum(axis=0), 1)).T @ p) if code.size else np.zeros((0, NONE))
    apart = (code * (p @ w.T)).min(axis=0) if code.size else np.zeros(0)
    importance = np.maximum(apart, 1e-3)
    return Model(languages, code, np.vstack([w.T, np.zeros(len(w))]).astype(np.float32), importance / importance.mean() if len(importance) else importance)


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, max_docs: int = 3000, max_languages: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from text and non-null lang of the documents that aren't held out."""
    train = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull())
    sizes = train.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n"))
    sizes = (sizes if max_languages is None else sizes.limit(max_languages + 1)).collect()
    if max_languages is not None and len(sizes) > max_languages:
        raise ValueError(f"more than max_languages={max_languages} labels: none is left out, so raise max_languages")
    share = {r["lang"]: min(1.0, max_docs / r["n"]) for r in sizes}
    if not share:
        return build({})
    shares = docs.sparkSession.createDataFrame(list(share.items()), "_lang string, _share double")
    place = F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col)), F.lit(1 << 24)) / F.lit(float(1 << 24))
    train = train.select(F.col(lang_col).cast("string").alias("lang"), bytes_of(text_col).alias("text"), place.alias("place"))
    # One row a label, as many as the model has languages.
    chosen = train.join(F.broadcast(shares), F.col("lang") == F.col("_lang")).filter("place < _share").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("none")
        own: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    h = trigrams([text])[0]
                    own.setdefault(lang, np.zeros(NONE, np.int64))[:] += np.bincount(h, minlength=NONE + 1)[:NONE]
        for lang, n in own.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "gram": at.astype(np.int32), "n": n[at]})

    grams = chosen.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = grams.toArrow()
    counts = {x: np.zeros(NONE) for x in share}
    lang = found["lang"].combine_chunks().dictionary_encode()
    codes, gram, n = lang.indices.to_numpy(zero_copy_only=False), found["gram"].to_numpy(), found["n"].to_numpy()
    for k, name in enumerate(lang.dictionary.to_pylist()):
        counts[name][gram[codes == k]] = n[codes == k]
    return build(counts)


def identify(model: Model, texts: list[bytes | None], clear: float) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, whether ambiguous, and margins of each text."""
    plain = [t or b"" for t in texts]
    margins = model.margins(plain)
    names = [UND] * len(plain)
    score, lead = np.zeros(len(plain)), np.zeros(len(plain))
    if model.languages:
        best, score, lead = model.decode(margins)
        names = [model.languages[i] for i in best]
    for i, t in enumerate(plain):
        if not has_letter(t):
            names[i], score[i], lead[i] = UND, 0.0, 0.0
    return names, score, lead < clear, margins


def annotated(docs: DataFrame, model: Model, clear: float = 0.2, text_col: str = "text", into: str = "_language") -> DataFrame:
    """docs with a struct of lang, score and ambiguous; all columns kept, nothing joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    smaller_batches(docs.sparkSession)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def run(texts: pa.Array) -> pa.Array:
        worker_cache("none")
        out, step = [], max(1, int(len(texts) * min(1.0, (2 << 20) / max(1, texts.nbytes))))
        for at in range(0, len(texts), step):
            names, score, doubt, _ = identify(shared.value, texts.slice(at, step).to_pylist(), clear)
            out += [{"lang": a, "score": float(b), "ambiguous": bool(c)} for a, b, c in zip(names, score, doubt)]
        return pa.array(out, kind)

    # Not deterministic, for the planner: else a filter on the result runs it once more.
    udf = F.arrow_udf(run, "struct<lang:string,score:double,ambiguous:boolean>").asNondeterministic()
    return docs.withColumn(into, udf(bytes_of(text_col)))


def predict(docs: DataFrame, model: Model, clear: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA's columns for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), bytes_of(text_col).alias("text"))

    def run(rows: dict[str, list]) -> dict[str, list]:
        names, score, doubt, margins = identify(shared.value, rows["text"], clear)
        return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "lang_pred": names, "score": score, "ambiguous": doubt, "margins": margins.tolist()}

    return map_batches(src, run, SCHEMA, ARROW, max_bytes=2 << 20)
