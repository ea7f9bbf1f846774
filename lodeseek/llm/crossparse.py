"""Language-model scores by Ziv-Merhav cross-parsing: how well reference text predicts a document.

Symbols are words, A-Z lower-cased. From each place in a document on, the longest phrase that the reference holds is
sought; the document is cut greedily into such phrases (a word that the reference lacks is a phrase of its own). With c
phrases of n words, and N words of reference, ``cross_bits`` = c log2(N) / n estimates the cross entropy per word. The
document's own LZ78 phrases give its entropy, ``self_bits`` = s log2(s) / n, and ``relative_entropy`` is the difference:
lower means closer to the reference.

The reference is all rows, or those that a flag chooses, less the row's own text. A ``SuffixAutomaton`` of it answers
whether a sequence of words occurs in it; one automaton of a corpus fits no task, and a document that meets each shard's
makes the work a product of corpus and corpus. So the automaton's paths of GRAMS words are spread over tasks by their hash:

1. One Arrow pass turns texts into blocks of about ``block_words`` words: numbers of words, and the words' hashes.
2. A block asks for its distinct paths of 1 and 2 words, then of 3, of 4, of 5, then of the longer lengths, each only where
   all shorter paths within it were found in two rows or more. What it asks for, it also holds: with each path it says whether
   one or several of its rows have it, and whether none, one or several of its reference rows do. A block sends a path
   once, however often its rows repeat it, so no path is hot.
3. A task that gets a range of hashes adds that up over blocks, and answers each block. One reference row alone is
   another one than the asking row unless the block itself has it and it is that row.
4. A phrase is the longest stretch of which every window of each length in GRAMS occurs in the reference. Up to eight
   words that is the automaton's longest match itself; a longer stretch could be pieced together from texts that overlap
   in long windows (all but one word, from 32 words on), which the README counts against the automaton.

The work is in proportion to the words of the corpus, and a hash has 24 bits more than the corpus needs to count its
words, so that the chance of a wrong answer is 2**-24 at any size.

Defined results: a null or wordless text has 0 words and null scores; without any reference each word is a phrase, and N
counts as 2; rows with equal ids, or without one, are documents of their own, and each other's reference; phrases never
span two reference rows; a null flag is false; columns of other names are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import Scratch, bytes_of, filesystem, shards_for, smaller_batches, worker_cache

SCORES = "doc_id long, n_words long, n_phrases long, reference_words long, cross_bits double, self_bits double, relative_entropy double"
SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_phrases", pa.int64()), ("reference_words", pa.int64()), ("cross_bits", pa.float64()), ("self_bits", pa.float64()), ("relative_entropy", pa.float64())])
#: Lengths of the paths that are looked up, rising from 1.
GRAMS = (1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 32)
#: Places in GRAMS at which a round of questions begins: the fewer words, the more paths are shared by chance.
FIRST_OF_ROUND = (0, 2, 3, 4, 5)
#: Hashes that a task adds up at a time.
PER_PART = 2_000_000
BLOCKS = "shard int, block int, words long, reference_words long, ids array<bigint>, sizes array<int>, held binary, codes binary, vocabulary binary"
BLOCKS_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("words", pa.int64()), ("reference_words", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("held", pa.binary()), ("codes", pa.binary()), ("vocabulary", pa.binary())])
ASKED = "part int, shard int, block int, gram int, n long, low binary, high binary, rows binary"
ASKED_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("block", pa.int32()), ("gram", pa.int32()), ("n", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("rows", pa.binary())])
ANSWERS = "part int, shard int, block int, gram int, n long, rows binary"
STATES = "shard int, block int, state binary"
STATES_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("state", pa.binary())])


class SuffixAutomaton:
    """Of sequences of words; ``next[state][word]``, from state 0. What the spread paths stand for, on one machine."""

    def __init__(self, texts: list[list[bytes]]):
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.words = sum(map(len, texts))
        link, length = [-1], [0]
        nxt, number = self.next, self.number
        for text in texts:
            last = 0
            for word in text:
                c = number.setdefault(word, len(number))
                # The next text starts from the root, so a state may be there already.
                if (q := nxt[last].get(c)) is not None:
                    last = q if length[q] == length[last] + 1 else self._clone(q, last, c, link, length)
                    continue
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[cur] = q if length[p] + 1 == length[q] else self._clone(q, p, c, link, length)
                last = cur

    def _clone(self, q: int, p: int, c: int, link: list[int], length: list[int]) -> int:
        new = len(self.next)
        self.next.append(self.next[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = link[p]
        return new

    def phrases(self, words: list[bytes]) -> int:
        """Phrases of the greedy cross-parsing."""
        nxt, root, state, n = self.next, self.next[0], 0, 0
        for c in map(self.number.get, words):
            if state:
                if (to := nxt[state].get(c)) is not None:
                    state = to
                    continue
                n += 1
            state = root.get(c, 0)
            n += not state
        return n + (state > 0)


def own_phrases(words: Iterable) -> int:
    """Phrases of the LZ78 parsing of words by themselves."""
    seen: dict[tuple, int] = {}
    get, state, n = seen.get, 0, 0
    for w in words:
        key = (state, w)
        if (state := get(key, 0)) == 0:
            n += 1
            seen[key] = n
    return n + (state > 0)


def figures(words: Sequence, phrases: int, reference_words: int) -> tuple:
    n = len(words)
    if not n:
        return 0, 0, reference_words, None, None, None
    s = own_phrases(words)
    cross, own = phrases * log2(max(reference_words, 2)) / n, s * log2(max(s, 1)) / n
    return n, phrases, reference_words, cross, own, cross - own


def scores(words: list[bytes], automaton: SuffixAutomaton) -> tuple:
    return figures(words, automaton.phrases(words), automaton.words)


def packed(numbers: np.ndarray) -> bytes:
    """Bytes of equal weight together, compressed."""
    import zstandard

    wide = np.ascontiguousarray(numbers)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(wide.view(np.uint8).reshape(len(wide), wide.itemsize).T).tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    plain = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(plain.reshape(size, len(plain) // size).T).view(kind).ravel()


class Codes(dict):
    """Numbers of words, in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def as_blocks(block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("none")
        shard, block = TaskContext.get().partitionId(), 0
        ids, held, codes, number = [], [], [], Codes()
        words = 0

        def row() -> pa.RecordBatch:
            sizes = np.array([len(c) for c in codes], np.int32)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
            own = np.array(held, np.uint8)
            values = (shard, block, int(sizes.sum(dtype=np.int64)), int(sizes[own > 0].sum(dtype=np.int64)), ids, sizes.tolist(), own.tobytes(), packed(np.concatenate(codes)), hashes.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, BLOCKS_ARROW)], schema=BLOCKS_ARROW)

        for batch in batches:
            for i, text, flag in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                own = (text.as_py() or b"").lower().split()
                ids.append(i)
                held.append(bool(flag))
                codes.append(np.fromiter(map(number.__getitem__, own), np.uint32, len(own)))
                words += len(own)
                if words >= block_words:
                    yield row()
                    ids, held, codes, number = [], [], [], Codes()
                    words, block = 0, block + 1
        if ids:
            yield row()

    return run


class Block:
    """A block's words, and the hash of every path that starts at each."""

    def __init__(self, row: dict):
        self.codes = unpacked(row["codes"], "<u4")
        self.sizes = np.array(row["sizes"], np.int64)
        self.held = np.frombuffer(row["held"], np.uint8) > 0
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        ends = np.cumsum(self.sizes)
        self.room = (np.repeat(ends, self.sizes) - np.arange(len(self.codes))).astype(np.int32)
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        self.hash = {1: self.vocabulary[self.codes]}

    def hashes(self, n: int) -> np.ndarray:
        """Of the n words from each place on; past a row's end they mean nothing."""
        if n not in self.hash:
            a, b = self.hashes(n - n // 2), self.hashes(n // 2)
            h = a ^ (a >> np.uint64(29))
            h *= np.uint64(0xBF58476D1CE4E5B9)
            at = n - n // 2
            h[: max(0, len(h) - at)] += b[at:]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
            self.hash[n] = h
        return self.hash[n]

    def paths(self, n: int, state: np.ndarray, grams: tuple[int, ...], known: int, bits: int):
        """The distinct hashes of the paths of n words to ask for, where shorter ones (grams[:known]) were all shared; the
        places that they start at, and each place's path; how many reference rows hold a path (0, 1 or 2, for several), 3
        more where several rows of any kind do; and one reference row of each."""
        if n == 1:
            return self.words(bits)
        good = self.room >= n
        if known:
            good &= stretch(state % 16 >= known) >= n - grams[known - 1] + 1
        at = np.flatnonzero(good)
        if not len(at):
            return np.zeros(0, np.uint64), at, at, np.zeros(0, np.uint8), np.zeros(0, np.int32)
        h = self.hashes(n)[at]
        if bits < 64:
            h >>= np.uint64(64 - bits)
        order = np.argsort(h)
        h, at = h[order], at[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        starts = np.flatnonzero(new)
        doc = self.doc[at]
        held = self.held[doc]
        least = np.minimum.reduceat(np.where(held, doc, np.int32(2**31 - 1)), starts)
        most = np.maximum.reduceat(np.where(held, doc, np.int32(-1)), starts)
        several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
        return h[starts], at, np.cumsum(new) - 1, (np.where(most < 0, 0, np.where(least == most, 1, 2)) + 3 * several).astype(np.uint8), most

    def words(self, bits: int):
        """paths of single words. Places are in order of rows, so a word's first and last place tell whether several hold it."""
        h, own = np.unique(self.vocabulary >> np.uint64(max(0, 64 - bits)), return_inverse=True)
        path = own[self.codes]

        def ends(of: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            first, last = np.full(len(h), 2**31 - 1, np.int32), np.full(len(h), -1, np.int32)
            first[of[::-1]], last[of] = doc[::-1], doc  # of equal places the last that is written stays
            return first, last

        any_first, any_last = ends(path, self.doc)
        held = self.held[self.doc]
        least, most = (any_first, any_last) if held.all() else ends(path[held], self.doc[held])
        rows = np.where(most < 0, 0, np.where(least == most, 1, 2)) + 3 * (any_first != any_last)
        return h, np.arange(len(self.codes)), path, rows.astype(np.uint8), most

    def found(self, n: int, answer: np.ndarray, state: np.ndarray, grams: tuple[int, ...], known: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether another row of the reference, or any other row, holds the path of n words from each place on."""
        _, at, path, rows, one = self.paths(n, state, grams, known, bits)
        out, shared = np.zeros(len(self.codes), bool), np.zeros(len(self.codes), bool)
        total, mine = answer[path], rows[path] % 3
        shared[at] = total >= 3
        total = total % 3
        out[at] = (total == 2) | ((total == 1) & ((mine == 0) | (one[path] != self.doc[at])))
        return out, shared


def stretch(good: np.ndarray) -> np.ndarray:
    """How many good places follow from each place on, itself included."""
    n = len(good)
    at = np.arange(n, dtype=np.int32)
    bad = np.where(good, np.int32(n), at)
    return np.minimum.accumulate(bad[::-1])[::-1] - at


def phrase_ends(passed: np.ndarray, room: np.ndarray, grams: tuple[int, ...]) -> np.ndarray:
    """Where the phrase from each place on ends: every window of it, of each length in grams, was found."""
    at = np.arange(len(passed), dtype=np.int32)
    end = at + 1
    alive = passed > 0
    last = np.where(alive, at + room, end)
    for k, n in enumerate(grams):
        # Windows of n words are found up to there, so that a longer phrase ends before the next one's end.
        reach = at + stretch(passed > k) + (n - 1)
        alive = alive & (passed > k)
        last = np.where(alive, np.minimum(last, reach), np.where(passed == k, np.minimum(last, at + n - 1), last))
        if not alive.any():
            break
    return np.maximum(last, end)


def asked_of(grams: tuple[int, ...], first: int, upto: int, bits: int, parts: int, states: str | None):
    """A block's questions for the paths of grams[first:upto]. A state is 16 times the number of grams that the reference
    has from a place on, and the number that any other row has."""
    bounds = np.array([-(-(k << bits) // parts) for k in range(1, parts)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("none")
        for row in rows_of(batches):
            block = Block(row)
            state = state_of(states, row) if states else np.zeros(len(block.codes), np.uint8)
            for n in grams[first:upto]:
                hashes, _, _, rows, _ = block.paths(n, state, grams, first, bits)
                cuts = [0, *np.searchsorted(hashes, bounds).tolist(), len(hashes)]
                out = []
                for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if a < b:
                        high = (hashes[a:b] >> np.uint64(32)).astype(np.uint32)
                        out.append((part, row["shard"], row["block"], n, b - a, hashes[a:b].astype(np.uint32).tobytes(), packed(np.diff(high, prepend=np.uint32(0))), packed(rows[a:b])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), ASKED_ARROW)], schema=ASKED_ARROW)

    return run


def answers_to(rows: pd.DataFrame) -> pd.DataFrame:
    """For each path that a block asked for, the same code over all blocks."""
    hashes = np.concatenate([(np.cumsum(unpacked(high, "<u4"), dtype=np.uint32).astype(np.uint64) << np.uint64(32)) | np.frombuffer(low, np.uint32) for low, high in zip(rows["low"], rows["high"])])
    held = np.concatenate([unpacked(x, "u1") for x in rows["rows"]])
    _, path = np.unique(hashes, return_inverse=True)
    del hashes
    total = np.minimum(np.bincount(path, weights=held % 3), 2).astype(np.uint8)
    total += 3 * (np.bincount(path, weights=1 + held // 3) >= 2).astype(np.uint8)
    total = total[path]
    cuts = np.cumsum(rows["n"].to_numpy())[:-1]
    out = rows[["part", "shard", "block", "gram", "n"]].copy()
    out["rows"] = [packed(x) for x in np.split(total, cuts)]
    return out


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def shard_rows(folder: str, row: dict) -> list[dict]:
    """The row's block's rows of a table that is partitioned by shard."""
    fs, at = filesystem(folder)
    files = [f.path for f in fs.get_file_info(pa.fs.FileSelector(f"{at}/shard={row['shard']}", allow_not_found=True)) if f.path.endswith(".parquet")]
    tables = (pq.ParquetFile(fs.open_input_file(f)).read() for f in files)
    return [r for t in tables for r in t.filter(pa.compute.equal(t["block"], row["block"])).to_pylist()]


def state_of(folder: str, row: dict) -> np.ndarray:
    return unpacked(shard_rows(folder, row)[0]["state"], "u1")


def after(block: Block, row: dict, grams: tuple[int, ...], first: int, upto: int, bits: int, states: str | None, answers: str) -> np.ndarray:
    """The state after the answers on grams[first:upto]."""
    state = state_of(states, row) if states else np.zeros(len(block.codes), np.uint8)
    by_gram: dict[int, list[tuple[int, np.ndarray]]] = {}
    for r in shard_rows(answers, row):
        by_gram.setdefault(r["gram"], []).append((r["part"], unpacked(r["rows"], "u1")))
    out = state.copy()
    for k in range(first, upto):
        parts = [x for _, x in sorted(by_gram.get(grams[k], []), key=lambda t: t[0])]
        found, shared = block.found(grams[k], np.concatenate(parts) if parts else np.zeros(0, np.uint8), state, grams, first, bits)
        out += 16 * (found & (out // 16 == k)).astype(np.uint8) + (shared & (out % 16 == k)).astype(np.uint8)
    return out


def cross_parsed(docs: DataFrame, reference: Column | None = None, grams: tuple[int, ...] = GRAMS, block_words: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCORES' columns for each row of docs. reference: a flag of the rows whose texts are the reference; all without it."""
    if list(grams) != sorted(set(grams)) or grams[:1] != (1,) or len(grams) > 15:
        raise ValueError("grams are at most 15 lengths, rising from 1")
    spark = docs.sparkSession
    smaller_batches(spark)
    scratch = Scratch(spark, "crossparse")
    flag = F.lit(True) if reference is None else F.coalesce(reference.cast("boolean"), F.lit(False))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), bytes_of(text_col).alias("text"), flag.alias("held"))
    blocks = scratch.save(src.mapInArrow(as_blocks(block_words), BLOCKS), "blocks")
    words, reference_words = blocks.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("reference_words"), F.lit(0))).first()
    bits, parts = min(64, int(words).bit_length() + 24), shards_for(int(words), PER_PART)
    states = answers = None
    cuts = [k for k in FIRST_OF_ROUND if k < len(grams)] + [len(grams)]
    rounds = list(zip(cuts, cuts[1:]))
    for k, (a, b) in enumerate(rounds):
        if k:
            before = rounds[k - 1]

            def step(batches: Iterator[pa.RecordBatch], before=before, states=states, answers=answers) -> Iterator[pa.RecordBatch]:
                for row in rows_of(batches):
                    state = after(Block(row), row, grams, *before, bits, states, answers)
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((row["shard"], row["block"], packed(state)), STATES_ARROW)], schema=STATES_ARROW)

            blocks.mapInArrow(step, STATES).write.partitionBy("shard").parquet(folder := scratch.path(f"states{k}"))
            states = folder
            scratch.drop(f"answers{k - 1}")
        asked = blocks.mapInArrow(asked_of(grams, a, b, bits, parts, states), ASKED)
        replies = asked.groupBy("part", "gram").applyInPandas(answers_to, ANSWERS)
        replies.repartition("shard").write.partitionBy("shard").parquet(folder := scratch.path(f"answers{k}"))
        answers = folder
    last = rounds[-1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            block = Block(row)
            passed = after(block, row, grams, *last, bits, states, answers) // 16
            block.hash.clear()
            ends = phrase_ends(passed, block.room, grams)
            out, at = [], 0
            for i, size, held in zip(row["ids"], block.sizes.tolist(), block.held.tolist()):
                own, to, n, place = block.codes[at : at + size].tolist(), (ends[at : at + size] - at).tolist(), 0, 0
                while place < size:
                    place = to[place]
                    n += 1
                out.append((i, *figures(own, n, reference_words - size * held)))
                at += size
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), SCORES_ARROW)], schema=SCORES_ARROW)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), SCORES_ARROW)], schema=SCORES_ARROW)

    return blocks.mapInArrow(score, SCORES)
