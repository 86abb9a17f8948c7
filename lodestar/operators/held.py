"""The rows of a task that may be among the first k of each question, in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: cells of the score matrix of a slice of rows
CELLS = 1 << 20
#: entries of question, row and score beyond twice k a question, at which a task drops those that can't be among the first
SLACK = 1 << 18
#: rows that a task holds besides those with entries, at which it lets go of the ones without
SPARE_ROWS = 1 << 14
#: steps that a range of scores is cut into to compare them roughly
STEPS = 1 << 40
#: rows of a result batch
OUT_ROWS = 1 << 16


class Held:
    """Scores of questions and rows, of which those are kept that may be among a question's first k by rounded score and then position.

    Rounding moves a score by less than `margin`, so of two scores further apart the higher
    one stays first, and of equal ones the earlier position does. An entry goes once k others
    are before it for certain; so copies of a row don't pile up either. A row goes once it
    has no entry left, so what is held is bounded by k and the questions, not by the rows put.
    Scores that aren't above `least` are none.
    """

    def __init__(self, k: int, questions: int, margin: float, least: float = -np.inf) -> None:
        self.k, self.margin, self.least, self.n_rows, self.n = k, margin, least, 0, 0
        self.floor = np.full(questions, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows: list[pa.RecordBatch] = []
        self.place: list[np.ndarray] = []
        self.limit, self.spare = 2 * k * questions + SLACK, SPARE_ROWS

    def put(self, scores: np.ndarray, rows: pa.RecordBatch, place: np.ndarray) -> None:
        """Scores of (rows, questions), -inf for none; `place` (see places) is what decides ties."""
        for at in range(0, len(scores), step := max(1, self.limit // max(1, scores.shape[1]))):
            part = scores[at : at + step]
            i, q = np.divmod(np.flatnonzero(part >= self.floor - self.margin), part.shape[1])
            score = part[i, q]
            if not (there := score > self.least).all():
                i, q, score = i[there], q[there], score[there]
            if len(i):
                self.parts.append((q.astype(np.int32), (i + at + self.n_rows).astype(np.int32), score))
                self.n += len(i)
            if self.n > self.limit:
                self._thin()
                if self.n > self.limit * 3 // 4:
                    self._drop(np.concatenate([*self.place, place]))
        # a copy: a slice would keep the whole batch in memory
        self.rows.append(rows.take(pa.array(np.arange(rows.num_rows))))
        self.place.append(np.array(place))
        self.n_rows += rows.num_rows
        if self.n_rows > self.spare:
            self._compact()

    def _compact(self) -> None:
        """Rows without an entry go, the others are numbered anew."""
        place = np.concatenate(self.place)
        if self.parts:
            self._drop(place)
            q, row, score = self.parts[0]
            used, row = np.unique(row, return_inverse=True)
            self.parts = [(q, row.astype(np.int32), score)]
        else:
            used = np.zeros(0, np.int64)
        self.rows = [pa.Table.from_batches(self.rows).take(pa.array(used)).combine_chunks().to_batches()[0]] if len(used) else []
        self.place, self.n_rows = ([place[used]] if len(used) else []), len(used)
        self.spare = SPARE_ROWS + 2 * self.n_rows

    def _thin(self) -> None:
        """Entries well below the k-th of their question go, by scores as 40-bit steps: one plain sort, but equal scores all stay."""
        q, row, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        low, width = score.min(), np.ptp(score)
        steps = ((score - low) * (STEPS / width)).astype(np.int64) if width > 0 else np.zeros(len(q), np.int64)
        keys = np.sort((q.astype(np.int64) << 41) | steps)
        ends = np.searchsorted(keys, np.arange(1, len(self.floor) + 1, dtype=np.int64) << 41)
        full = np.diff(ends, prepend=0) >= self.k
        kth = np.zeros(len(self.floor), np.int64)
        kth[full] = keys[ends[full] - self.k] & ((1 << 41) - 1)
        if width > 0:
            # steps are rounded, so two of them are left as room
            self.floor[full] = np.maximum(self.floor[full], low + (kth[full] - 2) * (width / STEPS))
            kth -= int(np.ceil(self.margin * (STEPS / width))) + 2
        stays = steps >= kth[q]
        self.parts = [(q[stays], row[stays], score[stays])]
        self.n = int(stays.sum())

    def _drop(self, place: np.ndarray) -> None:
        q, row, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((place[row], -score, q))
        q, row, score = q[order], row[order], score[order]
        at = np.arange(len(q))
        start = lambda new: np.maximum.accumulate(np.where(new, at, 0))
        new = np.r_[True, q[1:] != q[:-1]]
        of_question, of_score = start(new), start(new | np.r_[True, score[1:] != score[:-1]])
        kth = np.full(len(self.floor), -np.inf)
        is_kth = at - of_question == self.k - 1
        kth[q[is_kth]] = score[is_kth]
        # below the k-th by more than the margin, or after k rows of the very same score
        stays = (score >= kth[q] - self.margin) & ((at - of_score < self.k) | np.isnan(place[row]))
        self.floor = np.maximum(self.floor, kth)
        self.parts = [(q[stays], row[stays], score[stays])]
        self.n = int(stays.sum())
        self.limit = max(self.limit, 2 * self.n)

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
        """Questions, scores and rows, a batch at a time."""
        if not self.parts:
            return
        self._drop(np.concatenate(self.place))
        q, row, score = self.parts[0]
        rows = pa.Table.from_batches(self.rows).combine_chunks().to_batches()[0]
        for at in range(0, len(q), OUT_ROWS):
            on = slice(at, at + OUT_ROWS)
            yield q[on], score[on], rows.take(pa.array(row[on]))


def places(column: pa.Array) -> np.ndarray:
    """A column of numbers as positions, nulls first; of others none is known (NaN), so all of a tie are kept."""
    if not pa.types.is_integer(column.type):
        return np.full(len(column), np.nan)
    if not column.null_count:
        return column.to_numpy()
    return np.nan_to_num(column.to_numpy(zero_copy_only=False), nan=-np.inf)


def runs(cost: np.ndarray, limit: int, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of consecutive rows whose costs sum to at most `limit`, of at most `most` rows; a costlier row is alone."""
    total, at = np.concatenate([[0], np.cumsum(cost)]), 0
    while at < len(cost):
        end = int(np.searchsorted(total, total[at] + limit, "right")) - 1
        end = min(max(end, at + 1), at + most, len(cost))
        yield at, end - at
        at = end
