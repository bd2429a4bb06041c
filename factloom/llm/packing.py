"""Filling containers of fixed capacity with neighbouring documents along a Hilbert curve.

Token ids are hashed into a vector, projected to a few dimensions and turned into a key on
a Hilbert curve, so documents with like words have near keys. Documents are range-sorted by
key and packed in that order, each task on its own with a bounded set of open containers.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.tokens import TOKENIZER, token_ids
from factloom.session import reliable_checkpoint

HASHED = 4096
DIMENSIONS = 3
BITS = 16
OPEN_CONTAINERS = 64
CONTAINERS_PER_TASK = 2048


def projection(seed: int = 11) -> np.ndarray:
    """A fixed random projection of hashed token vectors, one row per slot."""
    return np.random.default_rng(seed).standard_normal((HASHED, DIMENSIONS))


def hilbert_key(coordinates: np.ndarray) -> np.ndarray:
    """Place on the Hilbert curve of points in the unit cube, one row each."""
    x = np.clip(coordinates * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (BITS - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) != 0
            x[0] = np.where(high, x[0] ^ (q - 1), x[0])
            t = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= t
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (BITS - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(BITS - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def document_points(ids: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
    """Points in the unit cube: distinct tokens hashed, projected, and squashed; the origin's image for empty ones."""
    points = np.zeros((len(ids), DIMENSIONS))
    for i, own in enumerate(ids):
        if len(own):
            slots = np.unique(own * 2654435761 % HASHED)
            points[i] = matrix[slots].sum(axis=0) / np.sqrt(len(slots))
    return 1 / (1 + np.exp(-1.7 * points))


def sized_and_keyed(documents: DataFrame, id_col: str, text_col: str, path: str = TOKENIZER) -> DataFrame:
    """(id_col, tokens, key) of every document."""
    kind = dict(documents.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix = projection()
        for batch in batches:
            ids = [token_ids(t, path) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "tokens": [len(x) for x in ids], "key": hilbert_key(document_points(ids, matrix))})

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, tokens long, key long").withColumnRenamed("id", id_col)


class Packer:
    """Best fit into a bounded number of open containers, without looking back further."""

    def __init__(self, capacity: int, limit: int = OPEN_CONTAINERS) -> None:
        self.capacity, self.limit = capacity, limit
        self.open: list[tuple[int, int]] = []
        self.used = 0

    def place(self, size: int) -> int:
        """Number of the container that an item of at most the capacity goes into.

        It is the open one with the least room that still holds it; if none does, a new
        one is opened, for which the fullest is closed once too many are open.
        """
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, number = self.open.pop(at)
        else:
            room, number = self.capacity, self.used
            self.used += 1
        if room > size:
            insort(self.open, (room - size, number))
            if len(self.open) > self.limit:
                self.open.pop(0)
        return number


def pack(sized: DataFrame, id_col: str, capacity: int) -> DataFrame:
    """One row per piece: id_col, piece_no, n_pieces, token_start, tokens, container_id.

    `sized` has id_col, tokens and key and can be read twice at little cost. A document of
    more than `capacity` tokens is cut into full pieces and a rest, any other stays whole;
    one without tokens takes no room but gets a container. Equal keys, as of repeated
    texts, are parted by the hash of the id, so no task gets a whole group of copies.
    Container ids are unique over all tasks. The bounds between tasks come from a sample
    that Spark draws, so with several tasks a repeated run may part them elsewhere.
    """
    if capacity < 1:
        raise ValueError("a container must hold at least one token")
    kind = dict(sized.dtypes)[id_col]
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    tasks = max(1, -(-total // (capacity * CONTAINERS_PER_TASK)))
    order = ["key", F.xxhash64("id"), "id"]
    ordered = sized.select(F.col(id_col).alias("id"), "tokens", "key").repartitionByRange(tasks, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(capacity)
        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = []
            for i, tokens in zip(batch["id"], batch["tokens"].tolist(), strict=True):
                n = max(1, -(-tokens // capacity))
                for k in range(n):
                    size = min(capacity, tokens - k * capacity)
                    rows.append((i, k, n, k * capacity, size, first + packer.place(size)))
            yield pd.DataFrame(rows, columns=["id", "piece_no", "n_pieces", "token_start", "tokens", "container_id"])

    packed = ordered.select("id", "tokens").mapInPandas(run, f"id {kind}, piece_no int, n_pieces int, token_start long, tokens long, container_id long")
    return packed.withColumnRenamed("id", id_col)


def pack_documents(documents: DataFrame, id_col: str, text_col: str, capacity: int, path: str = TOKENIZER) -> DataFrame:
    """`pack` of documents sized and keyed once; NULL and empty texts have no tokens."""
    return pack(reliable_checkpoint(sized_and_keyed(documents, id_col, text_col, path)), id_col, capacity)
