"""How many pieces a unigram tokenizer cuts a text into, without making the pieces.

A word is cut into vocabulary pieces so that the sum of their scores is largest. An
Aho-Corasick automaton over the vocabulary's bytes reports every piece that ends at a
place; dynamic programming carries the best score and its number of pieces. Many
different words walk the automaton side by side, as arrays; a task remembers the words
it has seen.

Ties follow the tokenizer: of equal scores the piece that starts first, the longest, stays.
A character that is no piece by itself also counts as its UTF-8 bytes, at the lowest
score less ten.

* Words are runs of other than blank, tab and line ends; each begins with the mark U+2581,
  and pieces never cross words. Null, empty and blank texts have 0 pieces and score 0.
* Repeated rows repeat their result; an empty table gives an empty result; other columns
  are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, absent, words_of

MARK = "▁".encode()
MOST_KNOWN = 2_000_000  # words a task remembers at once
_CELLS = 1 << 21  # table cells of words that are cut side by side


def load_vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces and scores of a sentencepiece model: ordinary pieces only."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [sp.id_to_piece(i).encode() for i in plain], np.array([sp.get_score(i) for i in plain], np.float64)


class Automaton:
    """``go``: next state by state and byte class; ``out``: the longest piece that ends in a
    state, as a state; ``shorter``: the next shorter one; ``size`` and ``score`` of a piece."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray):
        used = sorted(set(b"".join(pieces)))
        self.classes = np.zeros(256, np.int64)  # class 0: bytes of no piece
        self.classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        child: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for k, piece in enumerate(pieces):
            node = 0
            for c in piece:
                nxt = child[node].get(c)
                if nxt is None:
                    nxt = child[node][c] = len(child)
                    child.append({})
                node = nxt
            if piece:
                ends[node] = k
        n = len(child)
        self.go = np.zeros((n, width), np.int32)
        fail, self.out, self.shorter = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.size, self.score = np.zeros(n, np.int64), np.zeros(n)
        layer = [0]
        while layer:
            below = []
            for s in layer:
                # The failure state lies higher up, so its row is complete.
                if s:
                    self.go[s] = self.go[fail[s]]
                    self.shorter[s] = self.out[fail[s]]
                    self.out[s] = s if s in ends else self.shorter[s]
                    if s in ends:
                        self.size[s], self.score[s] = len(pieces[ends[s]]), scores[ends[s]]
                for c, t in child[s].items():
                    fail[t] = self.go[s, self.classes[c]] if s else 0
                    self.go[s, self.classes[c]] = t
                    below.append(t)
            layer = below
        self.unknown = float(scores.min()) - 10.0 if len(scores) else -10.0

    def cut(self, grid: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and best score of every row of ``grid``, bytes of words of ``length``."""
        rows, width = grid.shape
        best, count = np.full((rows, width + 1), -np.inf), np.zeros((rows, width + 1), np.int64)
        best[:, 0] = 0.0
        state, first = np.zeros(rows, np.int64), np.zeros(rows, np.int64)  # first: where the current character starts
        classes = self.classes[grid]
        for t in range(1, width + 1):
            live = np.flatnonzero(length >= t)
            if not len(live):
                break
            byte = grid[live, t - 1]
            first[live] = np.where((byte & 0xC0) != 0x80, t - 1, first[live])
            state[live] = self.go[state[live], classes[live, t - 1]]
            piece, at = self.out[state[live]], live
            single = np.zeros(rows, bool)
            while True:
                some = piece > 0
                at, piece = at[some], piece[some]
                if not len(at):
                    break
                start = t - self.size[piece]
                value = best[at, start] + self.score[piece]
                better = value > best[at, t]
                w, s = at[better], start[better]
                best[w, t], count[w, t] = value[better], count[w, s] + 1
                single[at[start == first[at]]] = True
                piece = self.shorter[piece]
            # The whole character stands for itself only if no piece does.
            whole = live[(~single[live]) & ((length[live] == t) | ((grid[live, np.minimum(t, width - 1)] & 0xC0) != 0x80))]
            value = best[whole, first[whole]] + self.unknown
            better = value > best[whole, t]
            w = whole[better]
            best[w, t], count[w, t] = value[better], count[w, first[w]] + t - first[w]
        every = np.arange(rows)
        return count[every, length], best[every, length]

    def words(self, w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and score of the words ``at``, the mark before each."""
        size = w.end[at] - w.start[at] + len(MARK)
        order = np.argsort(size, kind="stable")
        count, score = np.zeros(len(at), np.int64), np.zeros(len(at))
        a = 0
        while a < len(order):
            # Words of like length share a grid.
            widest = max(16, int(size[order[a]]) * 5 // 4)
            b = min(int(np.searchsorted(size[order], widest, "right")), a + max(1, _CELLS // widest))
            mine = order[a:b]
            length, start = size[mine], w.start[at[mine]]
            grid = np.zeros((len(mine), int(length.max())), np.uint8)
            grid[:, : len(MARK)] = np.frombuffer(MARK, np.uint8)
            col = np.arange(grid.shape[1] - len(MARK))
            inside = col < (length - len(MARK))[:, None]
            grid[:, len(MARK) :][inside] = w.data[(start[:, None] + col)[inside]]
            count[mine], score[mine] = self.cut(grid, length)
            a = b
        return count, score


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens, score. ``vocabulary``: path of a
    sentencepiece model that the driver can open."""
    pieces, scores = load_vocabulary(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(pieces, scores)
        known, counts, values = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for a, b, w in words_of(batch.column(1)):
                hashes, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
                fresh = np.flatnonzero(absent(hashes, known))
                if len(known) + len(fresh) > MOST_KNOWN:
                    known, counts, values, fresh = known[:0], counts[:0], values[:0], np.arange(len(hashes))
                if len(fresh):
                    n, s = automaton.words(w, first[fresh])
                    known, counts, values = (np.concatenate(p) for p in ((known, hashes[fresh]), (counts, n), (values, s)))
                    order = np.argsort(known, kind="stable")
                    known, counts, values = known[order], counts[order], values[order]
                spot = np.searchsorted(known, hashes)
                n_row, row = b - a, w.row
                total = np.bincount(row, weights=counts[spot][back], minlength=n_row).astype(np.int64)
                out.append((np.diff(w.at), total, np.bincount(row, weights=values[spot][back], minlength=n_row)))
            cols = [np.concatenate(c) for c in zip(*out)] or [np.zeros(0)] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:]))], schema=schema
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, score double")
