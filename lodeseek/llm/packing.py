"""Best-fit packing by fitting length patterns to the histogram with non-negative least squares.

1. One Arrow pass tokenises every whole text and cuts only documents longer than a sequence (``pieces``).
2. The histogram of lengths, in ``levels`` steps, goes to the driver: ``levels`` numbers, however many rows there are.
   The driver enumerates the patterns of at most ``depth`` steps that fill a sequence, and solves
   ``min ||A x - h||, x >= 0`` by Lawson-Hanson; the solution has at most ``levels`` patterns.
3. Pieces are hashed into shards of about ``per_shard`` pieces, by their place in the stored table, so that repeated rows
   and rows without ids spread as any others. A shard takes ``share`` of its part of each pattern's repeat count, rounded
   down, and packs what is left, longest first, by best fit into the gaps that the patterns left, or into new sequences.
   Where that needs more sequences than best fit alone, the shard takes best fit alone. A shard wastes at most its last
   few sequences, so the loss falls as 1 / per_shard.

Few long steps waste what rounding up adds to a length, and many leave few pieces to a step; patterns of two pieces of
512 steps, half of them used, came closest to the bound on the test tables (the README has figures).

Defined results: a null or empty text is the end token alone; repeated rows are packed each on its own; columns beyond
the id and text are ignored, whatever their names; an empty table gives no rows; equal lengths are taken by id, then piece.
"""

from __future__ import annotations

import gc
import struct
import unicodedata
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import Scratch, bytes_of, map_batches, shards_for, worker_cache

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PACKED = PIECES + ", sequence_id long, offset long"
#: Characters at which Python's and the tokeniser's white space differ, or may.
ODD_SPACE = "\x1c\x1d\x1e\x1f\x85"


class PartIds(dict):
    """Little-endian ids of words in lower case; kept are runs of letters, single marks, and words that hold anything else."""

    def __init__(self, tokenize: Callable, most: int):
        import regex

        self.tokenize, self.most = tokenize, most
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = dict(zip(kept, map(chr, kept))) | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in kept)}

    def __missing__(self, word: str) -> bytes:
        # Most words with a mark have one at their end: their letters are kept without it.
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return self[word[:-1]] + self[word[-1]]
        if word.isalpha() or len(word) == 1 or len(parts := self.split(word)) == 1:
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
            few = [x.id for x in self.tokenize(shown)]
            ids = struct.pack(f"<{len(few)}I", *few)
        else:
            ids = b"".join(map(self.__getitem__, parts))
        if len(word) <= 40:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids


class WordIds:
    """Little-endian ids of a text: it is normalised and split as the tokeniser does, and its parts, kept from text to text,
    go to the tokeniser's model. Nothing joins across white space, so texts are taken some thousand words at a time.

    The whole tokeniser is asked only for words where Python and it could differ: its special tokens, and the two letters
    that become lower case by context or in two characters.
    """

    def __init__(self, file: str, most: int = 500_000, at_a_time: int = 10_000):
        """file: the text of the tokeniser's file."""
        from tokenizers import Tokenizer

        self.tokenizer, self.at_a_time = Tokenizer.from_str(file), at_a_time
        self.parts = PartIds(self.tokenizer.model.tokenize, most)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of_words(self, words: list[str]) -> bytes:
        text = " ".join(words)
        if "<|" in text or "\u03a3" in text or "\u0130" in text or not text.isprintable():
            if len(words) == 1:
                return self.encode(text)
            half = len(words) // 2
            return self.of_words(words[:half]) + self.of_words(words[half:])
        low = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
        return b"".join(map(self.parts.__getitem__, low.split(" ")))

    def of(self, text: str) -> bytes:
        if any(map(text.__contains__, ODD_SPACE)):
            return self.encode(text)
        words = text.split()
        return b"".join(self.of_words(words[at : at + self.at_a_time]) for at in range(0, len(words), self.at_a_time))


def word_ids(path: str, text: str) -> WordIds:
    """Of the tokeniser of that name; text is its file."""
    cache = worker_cache("word_ids")
    if path not in cache:
        cache[path] = WordIds(text)
        gc.set_threshold(200_000, 50, 1000)  # hundreds of thousands of kept words, and no cycles
    return cache[path]


def cut(tokenizer_path: str, file: Broadcast, most: int, end_id: int) -> Callable[[dict], dict]:
    def run(rows: dict[str, list]) -> dict[str, list]:
        ids, end, step = word_ids(tokenizer_path, file.value), np.array([end_id], "<u4").tobytes(), 4 * most
        out: dict[str, list] = {f.name: [] for f in PIECES_ARROW}
        add = [out[f.name].append for f in PIECES_ARROW]
        for doc_id, text in zip(rows["doc_id"], rows["text"]):
            data = (ids.of(text.decode("utf-8", "replace")) if text else b"") + end
            for piece, at in enumerate(range(0, len(data), step)):
                part = data[at : at + step]
                for f, x in zip(add, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                    f(x)
        return out

    return run


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, most: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces, the end token included.

    The tokeniser's file, some megabytes, is read by the driver and sent to the workers."""
    with open(tokenizer_path, encoding="utf-8") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), bytes_of(text_col).alias("text"))
    return map_batches(src, cut(tokenizer_path, file, most, end_id), PIECES, PIECES_ARROW, owner="word_ids")


def patterns(levels: int, depth: int) -> list[tuple[int, ...]]:
    """The ways to write ``levels`` as at most ``depth`` steps from 1 to levels, largest first."""
    out: list[tuple[int, ...]] = []

    def grow(rest: int, most: int, taken: tuple[int, ...]) -> None:
        if not rest:
            out.append(taken)
        elif len(taken) < depth:
            for x in range(min(rest, most), 0, -1):
                if x * (depth - len(taken)) < rest:
                    break
                grow(rest - x, x, (*taken, x))

    grow(levels, levels, ())
    return out


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 3000) -> np.ndarray:
    """Lawson and Hanson's active sets for min ||a x - b||, x >= 0."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    ata, atb = a.T @ a, a.T @ b
    tol = 1e-9 * max(1.0, float(np.abs(atb).max(initial=0)))
    for _ in range(steps):
        w = atb - ata @ x
        w[active] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tol:
            break
        active[j] = True
        while True:
            on = np.flatnonzero(active)
            s = np.linalg.lstsq(ata[np.ix_(on, on)], atb[on], rcond=None)[0]
            if s.min() > 1e-12:
                x[:] = 0
                x[on] = s
                break
            bad = s <= 1e-12
            ratio = float(np.min(x[on][bad] / np.maximum(x[on][bad] - s[bad], 1e-300)))
            x[on] += ratio * (s - x[on])
            drop = on[bad & (x[on] <= 1e-9)]
            if not len(drop):
                drop = on[[int(np.argmin(np.where(bad, x[on], np.inf)))]]
            x[drop] = 0
            active[drop] = False
            if not active.any():
                break
    return x


def fit(histogram: np.ndarray, depth: int = 2) -> list[tuple[tuple[int, ...], float]]:
    """Patterns and repeat counts for a histogram of steps (index 0 is step 1). Long pieces weigh more: short ones fill gaps."""
    levels = len(histogram)
    every = patterns(levels, depth)
    a = np.zeros((levels, len(every)))
    for j, p in enumerate(every):
        for x in p:
            a[x - 1, j] += 1
    weight = np.where(np.arange(1, levels + 1) * 8 < levels, 0.09, 1.0)
    x = nnls(a * weight[:, None], histogram * weight)
    return [(every[j], float(x[j])) for j in np.flatnonzero(x > 1e-9)]


def pack_lengths(lengths: np.ndarray, most: int, fitted: list[tuple[tuple[int, ...], float]], levels: int, total: float) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length, for one shard. fitted: patterns and their repeat counts for total pieces."""
    n = len(lengths)
    sequence, offset = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    step = -(-lengths * levels // most)
    order = np.argsort(-lengths, kind="stable")
    queue = {int(s): order[step[order] == s] for s in np.unique(step)}
    taken = dict.fromkeys(queue, 0)
    fill: list[np.ndarray] = []
    made = 0
    for pattern, count in sorted(fitted, key=lambda x: -x[1]):
        need: dict[int, int] = {}
        for s in pattern:
            need[s] = need.get(s, 0) + 1
        times = int(count * n / max(total, 1))
        times = min([times, *((len(queue[s]) - taken[s]) // k if s in queue else 0 for s, k in need.items())])
        if times <= 0:
            continue
        here, seq = np.zeros(times, np.int64), made + np.arange(times)
        for s in pattern:
            at = queue[s][taken[s] : taken[s] + times]
            taken[s] += times
            sequence[at], offset[at] = seq, here
            here += lengths[at]
        fill.append(here)
        made += times
    used = list(np.concatenate(fill)) if fill else []
    gaps: list[list[int]] = [[] for _ in range(most + 1)]
    free = 0  # bit g: some sequence has a gap of g
    for i, u in enumerate(used):
        if u < most:
            gaps[most - u].append(i)
            free |= 1 << int(most - u)
    for i in order[sequence[order] < 0]:
        length = int(lengths[i])
        if fits := free >> length:
            gap = length + (fits & -fits).bit_length() - 1
            seq = gaps[gap].pop()
            if not gaps[gap]:
                free ^= 1 << gap
            sequence[i], offset[i] = seq, used[seq]
            used[seq] += length
        else:
            seq, gap = len(used), most
            used.append(length)
            sequence[i] = seq
        if left := gap - length:
            gaps[left].append(seq)
            free |= 1 << left
    return sequence, offset


def best_of(lengths: np.ndarray, most: int, fitted: list, levels: int, total: float) -> tuple[np.ndarray, np.ndarray]:
    """pack_lengths, with the fitted patterns unless best fit alone needs fewer sequences."""
    with_patterns, alone = pack_lengths(lengths, most, fitted, levels, total), pack_lengths(lengths, most, [], levels, total)
    return with_patterns if with_patterns[0].max(initial=-1) <= alone[0].max(initial=-1) else alone


def shard_packer(most: int, levels: int, fitted: list, total: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece"], kind="stable", na_position="last", ignore_index=True)
        sequence, offset = best_of(rows["length"].to_numpy(np.int64), most, fitted, levels, total)
        rows["sequence_id"], rows["offset"] = sequence + (rows["shard"].to_numpy(np.int64) << 40), offset
        return rows[[x.split()[0] for x in PACKED.split(", ")]]

    return run


def best_fit_pack(docs: DataFrame, tokenizer_path: str, most: int = 4096, end_id: int = 1, levels: int = 512, depth: int = 2, share: float = 0.5, per_shard: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents: PACKED's columns, one row for each piece; see the module for the method and edge cases."""
    spark = docs.sparkSession
    pieces = Scratch(spark, "pack").save(tokenized_pieces(docs, tokenizer_path, most, end_id, id_col, text_col), "pieces")
    step = F.ceil(F.col("length") * levels / most).cast("int")
    counted = {r["step"]: r["n"] for r in pieces.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}
    histogram = np.array([counted.get(i + 1, 0) for i in range(levels)], float)
    total = float(histogram.sum())
    fitted = [(p, x * share) for p, x in fit(histogram, depth)] if total else []
    shard = F.pmod(F.xxhash64(F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1), F.col("_metadata.row_index")), F.lit(shards_for(int(total), per_shard))).cast("long")
    return pieces.withColumn("shard", shard).groupBy("shard").applyInPandas(shard_packer(most, levels, fitted, total), PACKED)
