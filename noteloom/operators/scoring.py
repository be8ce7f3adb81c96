"""Score a batch of questions against a large chunk table without emitting all pairs.

Every pair has to be looked at once, but only the best ``k`` per question and task
leave a task. Two plans give the same result:

* The usual one keeps the chunk table where it is. The question batch, whose size is
  checked first, goes to all tasks, and the chunk scan keeps a running top-k. Nothing
  but ``questions x k`` rows per task is shuffled.
* A batch above the bound is cut into slices and the chunk table into stripes. Each
  (slice, stripe) cell is one bounded unit of work. A row is sent once for each slice or stripe
  of the other side, so both are as large as a task can hold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_BROADCAST_QUESTIONS = 2048
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
STRIPE_ROWS = 65_536
#: A slice of the grid holds so many batches of the usual plan: it is read in one task, not sent to all.
_SLICE_BATCHES = 16
_SLICE_BYTES = 32 * 1024 * 1024

SCORE_SCHEMA = "question_id bigint, chunk_id bigint, score double"
_ARROW_SCHEMA = pa.schema(
    [("question_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())]
)

# Built from a question table; takes chunk batches and yields kept rows.
Kernel = Callable[[pa.Table, Iterator[pa.RecordBatch]], Iterator[tuple]]


def _as_batch(question_ids, chunk_ids, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(question_ids, pa.int64()), pa.array(chunk_ids, pa.int64()), pa.array(scores, pa.float64())],
        schema=_ARROW_SCHEMA,
    )


def score_all(
    questions: DataFrame,
    chunks: DataFrame,
    kernel: Kernel,
    max_questions: int = MAX_BROADCAST_QUESTIONS,
    stripe_rows: int = STRIPE_ROWS,
) -> DataFrame:
    """Per-task best rows as (question_id, chunk_id, score); not yet merged over tasks."""
    head = questions.limit(max_questions + 1).toArrow()
    if head.num_rows <= max_questions and head.nbytes <= MAX_BROADCAST_BYTES:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, head.schema) as writer:
            writer.write_table(head)
        shared = chunks.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.ipc.open_stream(shared.value).read_all()
            for found in kernel(table, batches):
                yield _as_batch(*found)

        return chunks.mapInArrow(scan, SCORE_SCHEMA)

    per_slice = max(1, min(_SLICE_BATCHES * max_questions, int(head.num_rows * _SLICE_BYTES / max(head.nbytes, 1))))
    slices = math.ceil(questions.count() / per_slice)
    stripes = max(1, math.ceil(chunks.count() / stripe_rows))
    # Few cells leave cores idle; more stripes of a small table cost little.
    stripes = max(stripes, math.ceil(2 * chunks.sparkSession.sparkContext.defaultParallelism / slices))
    q = questions.withColumn("_slice", F.pmod(F.xxhash64("question_id"), F.lit(slices))).withColumn(
        "_stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)).cast("array<bigint>"))
    )
    c = chunks.withColumn("_stripe", F.pmod(F.xxhash64("chunk_id"), F.lit(stripes))).withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<bigint>"))
    )

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return _ARROW_SCHEMA.empty_table()
        found = [_as_batch(*f) for f in kernel(left, iter(right.to_batches()))]
        return pa.Table.from_batches(found, schema=_ARROW_SCHEMA)

    return (
        q.groupBy("_slice", "_stripe")
        .cogroup(c.groupBy("_slice", "_stripe"))
        .applyInArrow(cell, SCORE_SCHEMA)
    )


def merge_top(scored: DataFrame, k: int, rank_name: str = "rank") -> DataFrame:
    """Best ``k`` per question over all tasks: score descending, chunk id ascending."""
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    return (
        scored.withColumn(rank_name, F.row_number().over(w).cast("bigint")).filter(F.col(rank_name) <= k)
    )
