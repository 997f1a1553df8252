"""Labelling by an outside backend, without asking twice.

A backend is any object with ``answer(texts) -> list[str]``; it is given to the executors,
so it has to pickle. Calls are retried with linear delays, but not where the answer was
refused for safety; a refused text is labelled as sensitive. A batch whose answer can't be
parsed is asked again one by one. Texts are shortened only where they share the call of
a labelling batch; asked for alone they are sent whole.

A task may have several calls in flight and a time limit for each (see :mod:`.calls`); a
limit of calls a minute holds for all tasks together, without squeezing what comes before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmark.functions.text import TAIL
from siftmark.operators.calls import Exhausted, Refused, Slots, fan_out, retried
from siftmark.operators.matching import Lexicon
from siftmark.operators.seen import without_known

#: What the message of a refusal holds.
REFUSALS = ("安全", "违规", "阻止")
#: Tasks that share a limit of calls.
LIMITED = 4


class LabelBackend(Protocol):
    def answer(self, texts: list[str]) -> list[str]: ...


class RuleBackend:
    """Answers by a lexicon, the same each time: "1" if a word occurs, else "0"; for subtypes the categories' names."""

    def __init__(self, lexicon: Lexicon, subtypes: bool = False):
        self.lexicon, self.subtypes = lexicon, subtypes

    def answer(self, texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            hit = [c for c, words in self.lexicon.items() if any(w in t.lower() for w in words)]
            out.append(", ".join(hit) or "other" if self.subtypes else str(int(bool(hit))))
        return out


@dataclass(frozen=True)
class LabelTask:
    """What is asked for, and the column expression that reads the answer."""

    name: str
    parse: Callable
    batch_size: int = 10
    max_retries: int = 3
    delay_s: float = 0.0
    #: Calls of all tasks together, repeated ones too.
    calls_per_minute: int | None = None
    #: Characters of a text in a batch of several; None for whole texts.
    batch_chars: int | None = 1000
    #: Calls of one task that may be in flight at once.
    calls_at_once: int = 1
    #: Seconds after which a call counts as failed; it isn't repeated.
    call_limit_s: float | None = None


def pending(rows: DataFrame, done: DataFrame | None, key: str = "id") -> DataFrame:
    """Rows that aren't labelled yet and have text. Texts stay where they are: what meets the labelled rows is keys."""
    rows = rows.filter(F.length(F.coalesce("text", F.lit(""))) > 0)
    return rows if done is None else without_known(rows, done, key)


def asked(todo: DataFrame, backend: LabelBackend, task: LabelTask) -> DataFrame:
    """``todo`` with __answer and __status: answered, blocked (refused for safety), failed, or unasked (the backend had given up before)."""
    at = todo.columns.index("text")
    schema = T.StructType([*todo.schema.fields, T.StructField("__answer", T.StringType()), T.StructField("__status", T.StringType())])
    size, most = task.batch_size, task.batch_chars if task.batch_size > 1 else None
    tasks = 0
    if task.calls_per_minute:
        # behind a shuffle of what is to be asked, so that scans and joins before it keep their own tasks
        tasks = LIMITED
        todo = todo.repartition(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(60.0 / task.calls_per_minute, TaskContext.get().partitionId(), tasks) if tasks else None
        call = retried(backend.answer, task.max_retries, task.delay_s, slots)

        def ask(parts: list[list[str]]) -> list:
            return list(fan_out(call, parts, task.calls_at_once, task.call_limit_s))

        def read(outcome) -> tuple[str | None, str]:
            if isinstance(outcome, Refused):
                return f"[BLOCKED: {outcome}]", "blocked"
            if isinstance(outcome, Exhausted):
                return None, "unasked"
            return (outcome[0], "answered") if isinstance(outcome, list) and len(outcome) == 1 else (None, "failed")

        for batch in batches:
            texts = batch.column(at).to_pylist()
            parts = [texts[k : k + size] for k in range(0, len(texts), size)]
            found = ask([[t if most is None or len(t) <= most else t[:most] + TAIL for t in p] for p in parts])
            # what a batch didn't answer is asked for one by one
            alone = [] if size == 1 else [k for k, (o, p) in enumerate(zip(found, parts, strict=True)) if not (isinstance(o, list) and len(o) == len(p))]
            single = iter(ask([[t] for k in alone for t in parts[k]]))
            answers: list[tuple[str | None, str]] = []
            again = set(alone)
            for k, (o, p) in enumerate(zip(found, parts, strict=True)):
                if size == 1:
                    answers.append(read(o))
                else:
                    answers += [read(next(single)) for _ in p] if k in again else [(a, "answered") for a in o]
            a, b = [x[0] for x in answers], [x[1] for x in answers]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a, pa.string()), pa.array(b, pa.string())], [*batch.schema.names, "__answer", "__status"])

    return todo.mapInArrow(run, schema)


def read_answers(answers: DataFrame, task: LabelTask) -> DataFrame:
    """Rows of :func:`asked` with ``<name>_response`` and ``<name>_label``; __status stays."""
    label = task.parse(F.col("__answer"))
    if task.name == "coarse":
        label = F.when(F.col("__status") == "blocked", 1).otherwise(label)
    return answers.withColumn(f"{task.name}_label", label).withColumnRenamed("__answer", f"{task.name}_response")


def run_task(rows: DataFrame, backend: LabelBackend, task: LabelTask, done: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Rows still to do with ``<name>_response`` and ``<name>_label``; a label is null where no answer could be read."""
    return read_answers(asked(pending(rows, done, key), backend, task), task).drop("__status")


def task_stats(rows: DataFrame, labelled: DataFrame, done: DataFrame | None, name: str, key: str = "id") -> DataFrame:
    """One row: total, skipped (done before), success (answered), failed."""
    skipped = rows.join(done.select(F.col(key).alias("__done")), F.col(key) == F.col("__done"), "left_semi").count() if done is not None else 0
    total = rows.count()
    return labelled.agg(
        F.lit(total).cast("long").alias("total"), F.lit(skipped).cast("long").alias("skipped"),
        F.count_if(F.col(f"{name}_response").isNotNull()).alias("success"), F.count_if(F.col(f"{name}_response").isNull()).alias("failed"),
    )


def sensitive(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("coarse_label") == 1)


def merge_subtypes(rows: DataFrame, labelled: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with subtype_label and subtype_response: of positive rows by id, empty ones for negative rows, others as they are (null)."""
    s = labelled.select(F.col(key).alias("__k"), F.col("subtype_label").alias("__l"), F.col("subtype_response").alias("__r"))
    x = rows.join(s, F.col(key) == F.col("__k"), "left")
    y = F.col("coarse_label")
    old_l = F.col("subtype_label") if "subtype_label" in rows.columns else F.lit(None).cast("array<string>")
    old_r = F.col("subtype_response") if "subtype_response" in rows.columns else F.lit(None).cast("string")
    none = F.array().cast("array<string>")
    x = x.withColumns({
        "subtype_label": F.when(y == 0, none).when(y == 1, F.coalesce("__l", old_l)).otherwise(old_l),
        "subtype_response": F.when(y == 0, "").when(y == 1, F.coalesce("__r", old_r)).otherwise(old_r),
    })
    return x.drop("__k", "__l", "__r")
