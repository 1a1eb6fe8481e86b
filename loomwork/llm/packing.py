"""Packing token ids into sequences of fixed length by concatenating and cutting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokenizer
from ._shared import row_slices, written

OUT = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def _encode(args, end_id: int):
    """Adds to each row its partition, the ids before it there, its number of ids, and the ids."""

    def run(batches):
        bpe, before = tokenizer.load(*args), 0
        small = bpe.whole.get_vocab_size() <= 1 << 16 and 0 <= end_id < 1 << 16
        part = TaskContext.get().partitionId()
        for batch in batches:
            for rows in row_slices(batch, batch.num_columns - 1):
                texts = rows.column(rows.num_columns - 1).to_pylist()
                ids = [np.array([*bpe.ids(t), end_id], "<u2" if small else "<u4") for t in texts]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                ends = before + np.cumsum(sizes)
                new = [pa.array(np.full(len(ids), part, np.int64)), pa.array(ends - sizes), pa.array(sizes), pa.array([x.tobytes() for x in ids], pa.binary())]
                before = int(ends[-1])
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *new], [*rows.schema.names[:-1], "lw_part", "lw_before", "lw_n", "lw_ids"])

    return run


def _cut(length: int):
    """A row for each piece of each document: fixed windows over the global offsets."""

    def run(batches):
        for batch in batches:
            for rows in row_slices(batch, batch.num_columns - 1):
                n, start, raw = (rows.column(rows.num_columns - k) for k in (3, 2, 1))
                n, start = n.to_numpy(), start.to_numpy()
                first, last = start // length, (start + n - 1) // length
                pieces = last - first + 1
                row = np.repeat(np.arange(len(n)), pieces)
                seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                lo = np.maximum(seq * length, start[row])
                hi = np.minimum((seq + 1) * length, (start + n)[row])
                kinds = [np.frombuffer(x, "<u2" if len(x) == 2 * k else "<u4") for x, k in zip(raw.to_pylist(), n)]
                ids = [kinds[r][a:b].astype("<u4").tobytes() for r, a, b in zip(row, lo - start[row], hi - start[row])]
                kept = [c.take(pa.array(row)) for c in rows.columns[:-3]]
                new = [pa.array(lo - start[row]), pa.array(hi - lo), pa.array(ids, pa.binary()), pa.array(n[row]), pa.array(seq), pa.array(lo - seq * length)]
                yield pa.RecordBatch.from_arrays([*kept, *new], [*rows.schema.names[:-3], *OUT])

    return run


def pack(docs: DataFrame, text: str = "text", keep: list[str] | None = None, length: int = 1024, end_id: int = 0, bpe=None) -> DataFrame:
    """All documents, each followed by ``end_id``, as pieces of sequences of ``length`` ids.

    First pass: every partition encodes its documents, writes the ids with the number of ids that
    come before them in the partition, and the partitions' totals are summed up into the place
    where each one begins (one number a partition passes the driver, none a document). Second
    pass: fixed windows over these global offsets cut the documents, each piece is a boundary
    record with its ``start`` in the document, its ``sequence_id`` and its ``offset`` there. Only
    the last sequence can be shorter than ``length``. The order is that of the stored table.

    Returns the columns ``keep`` (None: all but the text; an ``OUT`` name is replaced) and ``OUT``;
    ``ids`` are little-endian unsigned 32-bit. A null or empty text is ``end_id`` alone, repeated
    rows are packed each, and no rows give no rows.
    """
    bpe = bpe or tokenizer.public()
    keep = [c for c in (docs.columns if keep is None else keep) if c not in OUT and (keep is not None or c != text)]
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("lw_text"))
    own = [docs.schema[c] for c in keep]
    encoded = T.StructType([*own, *(T.StructField(c, T.LongType()) for c in ("lw_part", "lw_before", "lw_n")), T.StructField("lw_ids", T.BinaryType())])
    stored = written(rows.mapInArrow(_encode(bpe, end_id), encoded), "packing-ids")
    totals = {r.lw_part: r.n for r in stored.groupBy("lw_part").agg(F.sum("lw_n").alias("n")).collect()}
    begins, at = [], 0
    for p in sorted(totals):
        begins.append((p, at))
        at += totals[p]
    base = docs.sparkSession.createDataFrame(begins, "lw_part long, lw_base long")
    placed = stored.join(F.broadcast(base), "lw_part").select(*(F.col(f"`{c}`") for c in keep), "lw_n", (F.col("lw_base") + F.col("lw_before")).alias("lw_start"), "lw_ids")
    out = T.StructType([*own, *(T.StructField(c, T.BinaryType() if c == "ids" else T.LongType()) for c in OUT)])
    return placed.mapInArrow(_cut(length), out)
