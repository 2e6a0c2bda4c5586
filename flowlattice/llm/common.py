"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlattice.functions.materialise import shared_dir, written  # noqa: F401

#: One row in FOLDS is held out of every fit; the remainder of crc32(doc_id as text) says which.
FOLDS = 5
#: A side of at most this many rows may be broadcast, if its rows have a fixed small width.
BROADCAST_ROWS = 50_000
BATCH_ROWS = 2_000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, BATCH_ROWS at once at most: texts are held several times over while they are worked on."""
    for b in batches:
        for lo in range(0, b.num_rows, BATCH_ROWS):
            yield b.slice(lo, BATCH_ROWS)


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; a null id counts as the empty text (0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def hash_share(key: Column, share: float) -> Column:
    """True for about ``share`` of the keys, the same ones on every run."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null and empty have different keys."""
    return F.when(text.isNotNull(), F.md5(text.cast("binary")))
