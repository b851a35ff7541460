"""Model map (O43): run prompts through a pluggable backend.

* identity of a prompt is ``sha2(prompt, 256)``; equal prompts run once;
* an append-only ``responses`` table (partitioned by backend) makes a job
  resumable: prompts already answered ``ok`` are removed by an anti join, and
  the answers of a Python backend are committed partition by partition as
  tasks end, so that a job that dies loses those of the running tasks only;
* a backend is either a native Column expression (stays in the JVM) or a
  Python function over a batch of prompts, run with ``mapInPandas`` in
  Arrow batches, with bounded retries and a status per row instead of an
  exception;
* results of a Python backend are materialised (table or checkpoint) before
  use, so a nondeterministic model is never evaluated twice.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.prompts import payload_of
from ..functions.text import strip
from ..schemas import RESPONSES
from ..session import ensure_checkpoint_dir


class Backend:
    name: str = "backend"

    def native(self, prompt: Column) -> Column | None:
        """A Column expression computing the answer, or None for Python backends."""
        return None

    def frame(self, prompts: DataFrame) -> DataFrame | None:
        """(prompt_id, response) of distinct (prompt_id, prompt) by DataFrame operations, or None for other backends."""
        return None

    def call_batch(self, prompts: list[str]) -> list[str]:
        raise NotImplementedError


class LeadBackend(Backend):
    """Deterministic stand-in model: the first ``k`` sentences of the payload
    (text after the first blank line), stripped; the whole payload when it
    has no sentence end."""

    def __init__(self, k: int = 2):
        self.k = k
        self.name = f"lead{k}"

    def native(self, prompt: Column) -> Column:
        body = payload_of(prompt)
        # The first k sentence pieces, matched once from the start (the same
        # text as joining the first k pieces of ``functions.text.sentences``).
        head = F.regexp_extract(body, r"^(?:[^.!?]*[.!?]+){1,%d}" % self.k, 0)
        return strip(F.when(head != "", head).otherwise(body))


# Fixed value: a rate-limit message advertises its wait like "Please try again in 20s.";
# the retry waits that long plus RATE_LIMIT_EXTRA_S.
RATE_LIMIT_RE = re.compile(r"Please try again in (\d+)s\.")
RATE_LIMIT_EXTRA_S = 5.0


class CallableBackend(Backend):
    """Wraps ``fn(list_of_prompts) -> list_of_answers`` (an HTTP client, a local
    model).  A call is tried up to ``max_attempts`` times: after a rate-limit
    error that advertises a wait, after that wait plus ``rate_limit_extra_s``;
    otherwise with exponential backoff.  A batch that fails (or gives another
    number of answers than prompts) is sent again prompt by prompt, so only the
    prompts that fail themselves get ``status='error'`` and the message.

    ``shared_limit``: all tasks call one service with one limit.  They then run
    as a barrier stage (``run_together``), and a limit that one of them meets
    stops all."""

    def __init__(self, name: str, fn: Callable[[list[str]], list[str]], max_attempts: int = 3,
                 backoff_s: float = 5.0, batch_size: int = 16, rate_limit_extra_s: float = RATE_LIMIT_EXTRA_S,
                 shared_limit: bool = False, round_s: float = 10.0):
        self.name = name
        self.fn = fn
        self.max_attempts = max_attempts
        self.backoff_s = backoff_s
        self.batch_size = batch_size
        self.rate_limit_extra_s = rate_limit_extra_s
        self.shared_limit = shared_limit
        self.round_s = round_s

    def wait_seconds(self, exc: Exception, attempt: int) -> float:
        m = RATE_LIMIT_RE.search(str(exc))
        return int(m.group(1)) + self.rate_limit_extra_s if m else self.backoff_s * (2 ** (attempt - 1))

    def checked(self, prompts: list[str]) -> list[str | None]:
        """One call; as many answers as prompts."""
        answers = list(self.fn(prompts))
        if len(answers) != len(prompts):
            raise ValueError(f"{len(answers)} answers for {len(prompts)} prompts")
        return [None if a is None else str(a).strip() for a in answers]

    def call(self, prompts: list[str]) -> tuple[list[str | None] | None, str | None, int]:
        """(answers or None, error, attempts) of one call with its retries."""
        error, attempts = None, 0
        while attempts < self.max_attempts:
            attempts += 1
            try:
                return self.checked(prompts), None, attempts
            except Exception as exc:  # noqa: BLE001 - reported per row
                error = f"{type(exc).__name__}: {exc}"
                if attempts < self.max_attempts:
                    time.sleep(self.wait_seconds(exc, attempts))
        return None, error, attempts

    def rows(self, prompts: list[str]) -> list[tuple[str | None, str, str | None, int]]:
        """(response, status, error, attempts) of each prompt."""
        answers, error, attempts = self.call(prompts)
        if answers is not None:
            return [(a, "ok", None, attempts) for a in answers]
        if len(prompts) == 1:
            return [(None, "error", error, attempts)]
        out = []
        for p in prompts:
            (response, status, error, more), = self.rows([p])
            out.append((response, status, error, attempts + more))
        return out

    def frame_of(self, part: pd.DataFrame, rows: list[tuple]) -> pd.DataFrame:
        response, status, error, attempts = zip(*rows, strict=True)
        return pd.DataFrame({"prompt_id": part["prompt_id"].values, "backend": self.name, "response": response,
                             "status": status, "error": error, "attempts": attempts})

    def parts(self, it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for start in range(0, len(pdf), self.batch_size):
                yield pdf.iloc[start:start + self.batch_size]

    def run_batches(self, it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in self.parts(it):
            yield self.frame_of(part, self.rows(part["prompt"].tolist()))

    def run_together(self, it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """``run_batches`` for the tasks of a barrier stage, which share one rate limit.

        Every task calls the model until a round ends: after ``round_s``, at a
        rate limit, or with its last prompt.  Then all tasks tell each other
        the waits they were given, and all pause for the longest.  A call that
        met the limit is sent again after the pause; pauses count as attempts.
        """
        from pyspark import BarrierTaskContext

        context, parts = BarrierTaskContext.get(), self.parts(it)
        part, attempts, ended = None, 0, False
        while True:
            wait, until = 0.0, time.monotonic() + self.round_s
            while not ended and not wait and time.monotonic() < until:
                if part is None:
                    part, attempts = next(parts, None), 0
                    ended = part is None
                    continue
                try:
                    answers = self.checked(part["prompt"].tolist())
                    rows = [(a, "ok", None, attempts + 1) for a in answers]
                except Exception as exc:  # noqa: BLE001 - reported per row
                    attempts += 1
                    if RATE_LIMIT_RE.search(str(exc)) and attempts < self.max_attempts:
                        wait = self.wait_seconds(exc, attempts)
                        continue
                    rows = self.rows(part["prompt"].tolist())
                yield self.frame_of(part, rows)
                part = None
            told = [x.split() for x in context.allGather(f"{wait} {int(ended)}")]
            longest = max(float(w) for w, _ in told)
            if not longest and all(int(e) for _, e in told):
                return
            time.sleep(longest)


PROMPT_BATCH_ROWS = 256
#: Moves the files of a task into the table when that task ends, not when all have.
COMMIT_BY_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def prompt_id(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def read_responses(spark: SparkSession, path: str, backend: str, prompts: DataFrame, ok_only: bool = True) -> DataFrame | None:
    """The stored ``ok`` answer of each of the prompts that has one (of several, the
    one with the fewest attempts, then the smallest text); None if there is no table.

    Without ``ok_only`` also the errors of prompts that have no such answer."""
    try:
        r = spark.read.schema(RESPONSES).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    r = r.filter(F.col("backend") == backend)
    if ok_only:
        r = r.filter(F.col("status") == "ok")
    r = r.join(prompts.select("prompt_id"), "prompt_id", "left_semi")
    failed = (F.col("status") != "ok").alias("failed")
    best = r.groupBy("prompt_id").agg(F.min(F.struct(failed, "attempts", "response", "backend", "status", "error")).alias("a"))
    return best.select("prompt_id", *(F.col(f"a.{c}").alias(c) for c in RESPONSES.fieldNames() if c != "prompt_id"))


def answer(prompts: DataFrame, backend: Backend, responses_path: str | None = None,
           parallelism: int | None = None) -> DataFrame:
    """Distinct (prompt_id, prompt) -> responses (F10 schema) for every prompt.

    With a responses table a Python backend's answers are appended in one pass;
    what a task has answered stays when the job dies later (in a barrier stage
    the tasks end together).  Prompts whose call failed are in the result with
    their error, and are sent again by the next run.
    """
    spark = prompts.sparkSession
    todo = prompts.dropDuplicates(["prompt_id"])
    done = read_responses(spark, responses_path, backend.name, prompts) if responses_path else None
    if done is not None:
        todo = todo.join(done.select("prompt_id"), "prompt_id", "left_anti")
    expr = backend.native(F.col("prompt"))
    made = todo.select("prompt_id", expr.alias("response")) if expr is not None else backend.frame(todo)
    if made is not None:
        new = made.select("prompt_id", F.lit(backend.name).alias("backend"), "response",
                          F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"),
                          F.lit(1).alias("attempts"))
        if responses_path:
            new.write.mode("append").partitionBy("backend").parquet(responses_path)
            return read_responses(spark, responses_path, backend.name, prompts)
        return new
    n = parallelism or int(spark.conf.get("spark.sql.shuffle.partitions"))
    together = getattr(backend, "shared_limit", False)
    if together:  # all tasks of a barrier stage run at once
        n = min(n, spark.sparkContext.defaultParallelism)
    call = backend.run_together if together else backend.run_batches
    asked = todo.repartition(n, "prompt_id").mapInPandas(call, RESPONSES, barrier=together)

    # Prompts can be ~100 KB each: keep Arrow batches to the Python worker
    # small while this stage is materialised (the setting is read at run time).
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(PROMPT_BATCH_ROWS))
    try:
        if not responses_path:
            ensure_checkpoint_dir(spark)
            return asked.checkpoint(eager=True)
        asked.write.mode("append").options(**COMMIT_BY_TASK).partitionBy("backend").parquet(responses_path)
        return read_responses(spark, responses_path, backend.name, prompts, ok_only=False)
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def infer(df: DataFrame, prompt_col: str, backend: Backend, out_col: str = "response",
          responses_path: str | None = None, parallelism: int | None = None,
          skip_empty: bool = True, keep_prompt: bool = False) -> DataFrame:
    """Adds ``out_col`` (the answer), ``<out_col>_status`` and ``<out_col>_error`` to ``df``.

    NULL (and, with ``skip_empty``, empty) prompts are not sent; their status
    is 'skipped'.  A native backend is a projection (deterministic, cheap:
    no dedupe, no join).  Otherwise equal prompts are answered once, the
    answers are materialised, and they are joined back on the prompt hash;
    the prompt text itself is dropped before that join unless ``keep_prompt``.
    Rows that are not sent join on a hash of their other columns, which no
    prompt has: they spread over the tasks instead of meeting as NULL keys.
    """
    p = F.col(prompt_col)
    send = p.isNotNull() & (F.length(p) > 0) if skip_empty else p.isNotNull()
    expr = backend.native(p)
    if expr is not None and responses_path is None:
        out = df.withColumn(out_col, F.when(send, expr)).withColumn(
            f"{out_col}_status", F.when(send, F.lit("ok")).otherwise(F.lit("skipped"))).withColumn(
            f"{out_col}_error", F.lit(None).cast("string"))
        return out if keep_prompt else out.drop(prompt_col)
    plain = [f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]
    spread = F.concat(F.lit("-"), F.xxhash64(*(F.col(f"`{c}`") for c in plain)).cast("string"))
    d = df.withColumn("_sent", send).withColumn("_pid", F.when(send, prompt_id(p)).otherwise(spread))
    prompts = d.filter("_sent").select(F.col("_pid").alias("prompt_id"), p.alias("prompt"))
    r = answer(prompts, backend, responses_path, parallelism).select(
        F.col("prompt_id").alias("_pid"), F.col("response").alias(out_col), F.col("status").alias("_st"),
        F.col("error").alias(f"{out_col}_error"))
    if not keep_prompt:
        d = d.drop(prompt_col)
    j = d.join(r, "_pid", "left")
    status = F.when(~F.col("_sent"), F.lit("skipped")).otherwise(F.coalesce(F.col("_st"), F.lit("error")))
    return j.withColumn(f"{out_col}_status", status).drop("_pid", "_st", "_sent")


def python_lead(k: int = 2) -> CallableBackend:
    """The ``LeadBackend`` rule run through the Python path (dedupe, Arrow
    batches, responses table); used to check that path against SQL."""
    head_re = re.compile(r"^(?:[^.!?]*[.!?]+){1,%d}" % k)
    ws = " \t\n\r\f\v"

    def answer_all(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            i = p.find("\n\n")
            body = p[i + 2:] if i >= 0 else p
            m = head_re.match(body)
            out.append((m.group(0) if m and m.group(0) else body).strip(ws))
        return out

    return CallableBackend(f"pylead{k}", answer_all, max_attempts=1, backoff_s=0.0, batch_size=256)
