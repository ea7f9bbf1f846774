"""Scores of many queries in one task, with numpy: the k best documents of each query, whatever the number of documents.

A task holds scores of some documents by all queries at once, CELLS of them, and k rows a query; nothing else grows.
"""

from __future__ import annotations

import numpy as np

from lodeseek.schema import K1, B

#: Scores held at once, 16 MB, and products made at once.
CELLS = 2_000_000
#: Terms that are multiplied as a dense matrix, at most; a term is if that many of a thousand of its cells are filled.
DENSE_TERMS, DENSE_PER_MILLE = 512, 5


class Scorer:
    """The k best of each query by rounded score, then the smaller id, of documents that share a term with it.

    term, query, qtf: a row for each term of each query, by number; doc_freq: of each term."""

    def __init__(self, term: np.ndarray, query: np.ndarray, qtf: np.ndarray, doc_freq: np.ndarray, n_docs: int, avg_doc_len: float, k: int, decimals: int):
        order = np.argsort(term, kind="stable")
        self.query, self.qtf = query[order], qtf[order].astype(float)
        self.count = np.bincount(term, minlength=len(doc_freq))
        self.start = np.cumsum(self.count) - self.count
        self.idf = np.log((n_docs - doc_freq + 0.5) / (doc_freq + 0.5) + 1.0)
        self.avg, self.k, self.scale = avg_doc_len, k, 10.0**decimals
        self.n = int(query.max()) + 1 if len(query) else 0
        filled = self.count * doc_freq
        dense = np.argsort(-filled, kind="stable")[:DENSE_TERMS]
        dense = dense[filled[dense] * 1000 > DENSE_PER_MILLE * n_docs * self.n]
        self.slot = np.full(len(doc_freq), -1)
        self.slot[dense] = np.arange(len(dense))
        self.dense = np.zeros((len(dense), self.n))
        for at, t in enumerate(dense):
            rows = slice(self.start[t], self.start[t] + self.count[t])
            self.dense[at, self.query[rows]] = self.qtf[rows]
        self.least = np.zeros(self.n)  # the k-th best rounded score of each query; 0 while there are fewer
        self.best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        self.found, self.waiting = [], 0

    def add(self, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Documents by id and length, each with ``sizes`` of the rows of term, tf."""
        if not self.n or self.k < 1:
            return
        ends = np.concatenate([[0], np.cumsum(sizes)])
        step = max(1, CELLS // self.n)
        for at in range(0, len(ids), step):
            to = min(at + step, len(ids))
            rows = slice(ends[at], ends[to])
            self._slice(ids[at:to], np.repeat(np.arange(to - at), sizes[at:to]), lengths[at:to], term[rows], tf[rows])

    def _slice(self, ids: np.ndarray, doc: np.ndarray, lengths: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        norm = (1.0 - B) + B * lengths[doc] / self.avg if len(doc) else np.zeros(0)
        weight = self.idf[term] * (tf * (K1 + 1.0)) / (tf + K1 * norm)
        slot = self.slot[term]
        thick = slot >= 0
        left = np.zeros((len(ids), len(self.dense)))
        left[doc[thick], slot[thick]] = weight[thick]
        scores = (left @ self.dense).ravel()
        doc, term, weight = doc[~thick], term[~thick], weight[~thick]
        ends = np.cumsum(self.count[term])
        at = 0
        while at < len(term):  # CELLS products, or those of one row
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, side="right")))
            count = self.count[term[at:to]]
            first = np.cumsum(count) - count
            pair = np.repeat(self.start[term[at:to]] - first, count) + np.arange(count.sum())
            cell = np.repeat(doc[at:to] * self.n, count) + self.query[pair]
            low = int(doc[at]) * self.n if len(doc) else 0  # rows are in order of documents
            part = np.bincount(cell - low, weights=np.repeat(weight[at:to], count) * self.qtf[pair])
            scores[low : low + len(part)] += part
            at = to
        scores = scores.reshape(len(ids), self.n)
        bar = self.least - 1 / self.scale
        if len(ids) > self.k and not self.least.all():
            bar = np.maximum(bar, np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k] - 1 / self.scale)
        row, query = np.nonzero((scores > 0) & (scores >= bar))
        self.found.append((query, np.floor(scores[row, query] * self.scale + 0.5) / self.scale, ids[row]))
        self.waiting += len(row)
        if self.waiting > max(self.n * self.k, 100_000) or not self.least.any():
            self._merge()

    def _merge(self) -> None:
        query, score, ids = (np.concatenate(x) for x in zip(self.best, *self.found))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        count = np.bincount(query, minlength=self.n)
        place = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
        self.least[query[place == self.k - 1]] = score[place == self.k - 1]
        keep = place < self.k
        self.best, self.found, self.waiting = (query[keep], score[keep], ids[keep]), [], 0

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, score, id."""
        if self.found:
            self._merge()
        return self.best
