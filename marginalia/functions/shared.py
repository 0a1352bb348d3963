"""Tables in the shared folder that tasks read for themselves, a block at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

#: Hits that are kept for a group of questions before they are pruned.
KEPT_ROWS = 500_000
TINY = 1e-37  # positive scores in short floats are not less
#: Parquet in row groups that are small enough to be skipped by tasks that do not need them.
SMALL_GROUPS = {"parquet.block.size": str(8 << 20)}


def read_blocks(path: str, rows: int, column: str | None = None, values: list | None = None, *, part: int | None = None) -> Iterator[pd.DataFrame]:
    """A Parquet table in blocks of at most ``rows`` rows, from any store that the path names; see ``read_batches``."""
    for batch in read_batches(path, rows, column, values, part=part):
        yield batch.to_pandas()


def read_batches(path: str, rows: int, column: str | None = None, values: list | None = None, *, part: int | None = None) -> Iterator:
    """The same as Arrow batches, whose lists need not become an object a row.

    With ``column`` only the rows whose value is among ``values``, with ``part`` only those of that part; sorted
    tables skip the other row groups.
    """
    import pyarrow.dataset as ds
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        store, inside = fs.FileSystem.from_uri(path)
    else:
        store, inside = fs.LocalFileSystem(), path
    wanted = None if column is None else ds.field(column).isin(values)
    if part is not None:
        of = ds.field("part") == part
        wanted = of if wanted is None else wanted & of
    table = ds.dataset(inside, filesystem=store, format="parquet", partitioning="hive")
    for batch in table.to_batches(filter=wanted, batch_size=rows, batch_readahead=2, fragment_readahead=1):
        if batch.num_rows:
            yield batch


def spread_of(questions: int, stored: int, cores: int, block: int, part: int) -> tuple[int, int]:
    """(blocks of questions, parts of what is searched): a task for each pair of them.

    A block has at most ``block`` questions. Few questions do not keep all cores busy, so then what is searched is
    parted as well, into parts of ``part`` rows at least.
    """
    blocks = max(1, -(-questions // block), min(3 * cores, -(-questions // max(1, block // 32))))
    return blocks, max(1, min(-(-cores // blocks), stored // part))


def gathered(batches: Iterator[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    """The rows of a partition, some ``block`` at a time; rows of different ``part`` are not mixed."""
    held: list[pd.DataFrame] = []

    def rows() -> Iterator[pd.DataFrame]:
        if held:
            yield from (rows for _, rows in pd.concat(held).groupby("part"))
        held.clear()

    for batch in batches:
        for at in range(0, len(batch), block):
            held.append(batch.iloc[at:at + block])
            if sum(map(len, held)) >= block:
                yield from rows()
    yield from rows()


class TopHits:
    """The best ``k`` of all rows of scores offered for ``n`` questions; what cannot be among them is not kept.

    Scores count as rounded to ``digits``; among equal ones the smaller id stays. Scores below ``least`` are none.
    """

    def __init__(self, n: int, k: int, digits: int, least: float):
        self.k, self.digits, self.edge = k, digits, 10.0 ** -digits
        self.least = np.full(n, least)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows, self.most = 0, min(3 * n * k, KEPT_ROWS)

    def expect(self, scores: np.ndarray, error: float) -> None:
        """Of rows that will be offered, positive scores that may be off by a share of ``error``."""
        if len(scores) >= self.k:
            self.least = np.maximum(self.least, self._last(scores, error))

    def _last(self, scores: np.ndarray, error: float = 0.0) -> np.ndarray:
        return np.partition(scores.T, -self.k, axis=1)[:, -self.k] * (1.0 - error) - self.edge

    def offer(self, scores: np.ndarray, ids: np.ndarray, full: Callable | None = None, error: float = 0.0) -> None:
        """A row for each of ``ids``, a column a question.

        Positive scores may be off by a share of ``error``; then ``full`` gives those of some (rows, columns).
        """
        least = self.least
        if not self.parts and len(scores) > self.k:
            least = np.maximum(least, self._last(scores, error))
        low = least if full is None else np.maximum(least * (1 - 2 * error), TINY).astype(scores.dtype)
        c, q = np.divmod(np.flatnonzero(scores >= low), scores.shape[1])
        found = scores[c, q] if full is None else full(c, q)
        if full is not None:
            c, q, found = (x[found >= least[q]] for x in (c, q, found))
        self.parts.append((q, ids[c], np.round(found, self.digits)))
        self.rows += len(q)
        if self.rows > self.most:
            self._prune()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, id, score) of what is kept."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self._prune()
        return self.parts[0]

    def _prune(self) -> None:
        q, ids, score = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, -score, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], score[order][last] - self.edge)
        kept = place < self.k
        self.parts = [(q[kept], ids[order][kept], score[order][kept])]
        self.rows = int(kept.sum())
