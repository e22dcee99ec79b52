"""Vector bin packing of token sequences.

Every example has a demand vector (tokens, segments, loss-bearing tokens) and every sequence a limit
vector. The dot-product heuristic fills one sequence at a time: of the examples that fit, it takes
the one whose demand has the largest weighted dot product with what is left. Packing runs in every
task over groups of examples as they are read, so it needs no shuffle and bounded memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lumenscape.llm.tokenizers import default_path, encoder

END_ID = 1
#: Examples that are packed together; a task holds one group at a time.
GROUP = 512


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most: tokens, pieces, and tokens that bear loss."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 1920


def pack_group(tokens: np.ndarray, loss: np.ndarray, limits: Limits, cut: bool) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (example, start, length).

    The last `loss` tokens of an example bear loss, those in front (its context) do not. A sequence takes the example
    that fits whole and whose demand has the largest dot product with the room left, both as shares of the limits.
    cut: where none fits, the one of which most can be placed is cut; the context and the rest of an example over
    the limits are placed apart. Without cut an example must fit the limits whole.
    """
    over = (tokens > limits.tokens) | (loss > limits.loss)
    if over.any() and not cut:
        raise ValueError("an example exceeds the limits; allow cuts")
    context = tokens - loss
    # parts to place: example, next token, tokens left, and how many of these bear no loss
    owner = np.concatenate([np.arange(len(tokens)), np.flatnonzero(over)])
    start = np.concatenate([np.zeros(len(tokens), np.int64), context[over]])
    left = np.concatenate([np.where(over, context, tokens), loss[over]]).astype(np.int64)
    bare = np.concatenate([context, np.zeros(over.sum(), np.int64)])
    cap = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
    sequences: list[list[tuple[int, int, int]]] = []
    open_ = np.flatnonzero(left > 0)
    while open_.size:
        room, pieces = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.int64), []
        while open_.size and room[0] > 0 and room[1] > 0:
            need, need_loss = left[open_], left[open_] - bare[open_]
            fits = (need <= room[0]) & (need_loss <= room[2])
            if cut and room[1] == 1:  # the last piece has to fill the sequence
                fits &= need == room[0]
            if fits.any():
                gain = need[fits] * (room[0] / cap[0] ** 2) + need_loss[fits] * (room[2] / cap[2] ** 2)  # every piece takes one segment
                at = np.flatnonzero(fits)[np.argmax(gain)]
                length = int(need[at])
            elif cut:
                most = np.minimum(np.minimum(need, room[0]), bare[open_] + room[2])
                at = int(np.argmax(most))
                length = int(most[at])
                if length <= 0:
                    break
            else:
                break
            i = open_[at]
            pieces.append((int(owner[i]), int(start[i]), length))
            room -= (length, 1, max(0, length - bare[i]))
            bare[i] -= min(bare[i], length)
            start[i] += length
            left[i] -= length
            if left[i] == 0:
                open_ = np.delete(open_, at)
        sequences.append(pieces)
    return sequences


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cut a short sequence into sequences whose lengths are powers of two, which need no padding."""
    out: list[list[tuple[int, int, int]]] = []
    todo, total = list(pieces), sum(p[2] for p in pieces)
    for bit in reversed(range(total.bit_length())):
        size = total & (1 << bit)
        if size:
            out.append([])
        while size:
            i, start, length = todo.pop(0)
            take = min(size, length)
            out[-1].append((i, start, take))
            if take < length:
                todo.insert(0, (i, start + take, length - take))
            size -= take
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


#: Documents have no roles: this part of their tokens, in front, counts as context that bears no loss.
CONTEXT_SHARE = 8


def pack_documents(docs: DataFrame, limits: Limits = Limits(), tokenizer: str | None = None, group: int = GROUP, with_ids: bool = False, context_share: int = CONTEXT_SHARE) -> DataFrame:
    """Tokenise whole texts, end each with END_ID, cut freely and pack; one row per piece.

    A sequence below limits.tokens (no part fits its limits, or it is a task's last) is cut on into powers of two,
    so none needs padding. sequence_id is the task's partition over a running number: the same again if a lost task
    is repeated. loss_tokens: those of the piece that bear loss, all but the first n // context_share of a document.
    Defined cases: a null or empty text is the single token END_ID; a very long text is cut into as many sequences as
    it takes; of documents that tie in the dot product the first read goes first; repeated rows are packed once
    each; a null doc_id stays null; an empty table gives an empty result; other columns are ignored. with_ids
    adds the piece's ids.
    """
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base, count = encoder(path), TaskContext.get().partitionId() << 33, 0

        def packed(keys: list, ids: list[np.ndarray], last: bool) -> tuple[pa.RecordBatch, list]:
            nonlocal count
            n = np.array([len(x) for x in ids], dtype=np.int64)
            rows, kept = [], []
            prompt = n // context_share
            for pieces in pack_group(n, n - prompt, limits, cut=True):
                whole = sum(p[2] for p in pieces) == limits.tokens
                if not whole and not last and all(start == 0 and length == n[i] for i, start, length in pieces):
                    kept += [(keys[i], ids[i]) for i, _, _ in pieces]  # not full yet: goes on into the next group
                    continue
                for part in [pieces] if whole else powers_of_two(pieces):
                    offset = 0
                    for i, start, length in part:
                        piece = ids[i][start : start + length]
                        rows.append((keys[i], start, length, zlib.crc32(piece.astype("<u4").tobytes()), int(n[i]), base + count, offset, max(0, start + length - max(start, int(prompt[i]))), *([piece] if with_ids else [])))
                        offset += length
                    count += 1
            return table(rows), kept

        def table(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * (8 + with_ids)
            arrays = [pa.array(c, pa.int64()) for c in columns[:8]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in columns[8]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        keys: list = []
        ids: list[np.ndarray] = []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(key)
                ids.append(np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype(np.uint32))
                if len(keys) >= group:
                    out, kept = packed(keys, ids, False)
                    keys, ids = [k for k, _ in kept], [x for _, x in kept]
                    if len(kept) >= group // 2:  # many tiny documents: close what there is
                        more, kept = packed(keys, ids, True)
                        keys, ids = [], []
                        yield more
                    yield out
        if keys:
            yield packed(keys, ids, True)[0]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def pack_examples(examples: DataFrame, id_col: str, tokens_col: str, loss_col: str, limits: Limits = Limits(), group: int = GROUP) -> DataFrame:
    """Whole examples (never cut) with known counts -> (id, tokens, loss, sequence_id, offset).

    Defined cases: null counts are 0; examples without tokens share one sequence of their group; an example over a
    limit raises ValueError; of ties the first read goes first; repeated rows are packed once each, null ids too;
    an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for at in range(0, batch.num_rows, group):
                part = batch.slice(at, group)
                keys, n, loss = (part.column(j).to_pylist() for j in range(3))
                n_, loss_ = np.array(n, np.int64), np.array(loss, np.int64)
                rows = [(keys[i], 0, 0, base + count, 0) for i in np.flatnonzero(n_ <= 0)]
                count += bool(rows)
                for pieces in pack_group(n_, loss_, limits, cut=False):
                    offset = 0
                    for i, _, length in pieces:
                        rows.append((keys[i], length, loss[i], base + count, offset))
                        offset += length
                    count += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["id", "tokens", "loss", "sequence_id", "offset"])

    zero = F.lit(0).cast("long")
    rows = examples.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(tokens_col).cast("long"), zero).alias("tokens"), F.coalesce(F.col(loss_col).cast("long"), zero).alias("loss"))
    return rows.mapInArrow(run, "id long, tokens long, loss long, sequence_id long, offset long")
