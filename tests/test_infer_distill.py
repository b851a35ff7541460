"""Model map (O43): dedupe, resume, status; distill (O44) rounds."""

import os

import pytest

from pyspark.sql import functions as F

from annolens.operators.distill import distill, distill_rows
from annolens.operators.infer import CallableBackend, LeadBackend, infer


def counting_backend(log_path, fail_on=None):
    def fn(prompts):
        with open(log_path, "a") as f:
            for p in prompts:
                f.write(p.replace("\n", " ") + "\n")
        if fail_on and any(fail_on in p for p in prompts):
            raise RuntimeError("model unavailable")
        return [p.upper() for p in prompts]
    return CallableBackend("upper", fn, max_attempts=2, backoff_s=0.0)


def calls(log_path):
    return len(open(log_path).read().splitlines()) if os.path.exists(log_path) else 0


def test_resume_calls_each_prompt_once(spark, tmp_path):
    log, store = str(tmp_path / "calls.log"), str(tmp_path / "responses")
    df = spark.createDataFrame([(1, "same prompt"), (2, "same prompt"), (3, None)], "id int, p string")
    out = infer(df, "p", counting_backend(log), "r", responses_path=store).orderBy("id").collect()
    assert [r.r for r in out] == ["SAME PROMPT", "SAME PROMPT", None]
    assert [r.r_status for r in out] == ["ok", "ok", "skipped"]
    assert calls(log) == 1
    again = infer(df, "p", counting_backend(log), "r", responses_path=store).collect()
    assert calls(log) == 1 and len(again) == 3


def test_failures_become_status(spark, tmp_path):
    log = str(tmp_path / "calls.log")
    df = spark.createDataFrame([(1, "bad prompt")], "id int, p string")
    r = infer(df, "p", counting_backend(log, fail_on="bad"), "r").first()
    assert r.r is None and r.r_status == "error"
    assert calls(log) == 2          # bounded retries


def test_lead_backend(spark):
    df = spark.createDataFrame([("Do this.\n\nOne. Two! Three? Four.",), ("no blank line here",)], "p string")
    got = [r.r for r in infer(df, "p", LeadBackend(2), "r").collect()]
    assert got == ["One. Two!", "no blank line here"]


def test_distill_rounds(spark):
    # 12 texts of 5 tokens; budget 20 tokens, chunks of ~10 after the prompt prefix.
    from annolens.operators.chunking import prefix_tokens
    size = 10 + prefix_tokens()
    rows = [(1, i, f"Sentence {i} is here now.") for i in range(12)] + [(2, 0, "Short one."), (None, 0, "No key.")]
    df = spark.createDataFrame(rows, "g int, o bigint, t string")
    res = {r.g: r for r in distill(df, ["g"], "o", "t", LeadBackend(1), 20, size, max_rounds=3).collect()}
    assert set(res) == {1, 2, None} and res[None].distilled == "No key."
    assert res[2].kind == "pass" and res[2].distilled == "Short one." and res[2].rounds == 0
    assert res[1].kind == "chunk" and res[1].rounds == 2 and res[1].status == "ok"
    assert len(res[1].distilled.split()) <= 20


def test_distill_ends_on_text_that_does_not_shrink(spark):
    from annolens.operators.chunking import prefix_tokens
    df = spark.createDataFrame([(1, 0, " ".join(["word"] * 100))], "g int, o bigint, t string")
    for rows in (False, True):
        size = 10 + prefix_tokens()
        d = distill_rows(df, ["g"], "t", LeadBackend(2), 40, size, max_rounds=9) if rows else distill(df, ["g"], "o", "t", LeadBackend(2), 40, size, max_rounds=9)
        r = d.first()
        assert r.status == "over_budget" and r.rounds == 1 and len(r.distilled.split()) == 100


def test_a_failed_chunk_fails_its_key(spark, tmp_path):
    """Nothing is answered from a part of the texts; the other keys are not touched."""
    from annolens.operators.chunking import prefix_tokens
    from annolens.plans import jobs as J
    size = 6 + prefix_tokens()
    texts = {1: " ".join(f"Word{i}." for i in range(30)), 2: " ".join(f"Name{i}." for i in range(30)), 3: "tiny."}

    def fn(prompts):
        if any("Word7." in p for p in prompts):
            raise RuntimeError("boom")
        return [p.split("\n\n", 1)[1].split(" ")[0] for p in prompts]

    bad = CallableBackend("bad", fn, max_attempts=1, backoff_s=0.0)
    df = spark.createDataFrame([(k, 0, t) for k, t in texts.items()], "g bigint, o bigint, t string")
    for d in (distill(df, ["g"], "o", "t", bad, 12, size), distill_rows(df, ["g"], "t", bad, 12, size),
              distill(df, ["g"], "o", "t", bad, 12, size, responses_path=str(tmp_path / "r"))):
        got = {r.g: r for r in d.collect()}
        assert got[1].status == "error" and got[1].distilled is None and "boom" in got[1].error
        assert got[2].status == got[3].status == "ok" and got[2].distilled.startswith("Name0. ") and got[3].distilled == "tiny."
    sent = str(tmp_path / "sent")

    def final(prompts):
        with open(sent, "a") as f:
            f.writelines("x\n" for _ in prompts)
        return ["A sentence." for _ in prompts]

    ann = df.select(F.lit(9606).alias("tax_id"), F.col("g").alias("gene_id"), F.col("g").alias("row_ord"), F.col("t").alias("text"))
    genes = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "gene_id bigint, symbol string")
    members = spark.createDataFrame([(0, "1"), (1, "2"), (2, "nope")], "pos bigint, token string")
    al = genes.withColumn("is_official", F.lit(True))
    s = {r.token: r for r in J.summarize_genes(members, ann, al, genes, CallableBackend("final", final, max_attempts=1), "p", 12, size, chunk_backend=bad).collect()}
    assert s["1"].status == "error" and s["1"].summary is None and "boom" in s["1"].error
    assert s["2"].status == "ok" and s["nope"].status == "unresolved"
    assert calls(sent) == 1  # no final prompt for the failed gene


def test_batch_failure_is_retried_by_prompt(spark):
    def fn(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("x" * 5000)
        return [p.upper() for p in prompts]

    rows = [(i, "bad one" if i == 3 else f"prompt {i}") for i in range(8)]
    df = spark.createDataFrame(rows, "id int, p string").coalesce(1)
    got = {r.id: r for r in infer(df, "p", CallableBackend("b", fn, max_attempts=1, backoff_s=0.0), "r", parallelism=1).collect()}
    assert got[3].r_status == "error" and got[3].r_error.endswith("x" * 5000)
    assert all(got[i].r == f"PROMPT {i}" and got[i].r_status == "ok" for i in range(8) if i != 3)
    few = CallableBackend("few", lambda prompts: ["only one"] if len(prompts) > 1 else ["fine"], max_attempts=1, backoff_s=0.0)
    assert {r.r for r in infer(df, "p", few, "r", parallelism=1).collect()} == {"fine"}


def test_a_broken_job_keeps_what_was_answered(spark, tmp_path):
    """The job dies half-way; the next run sends only the prompts without an answer."""
    log, store, stop = str(tmp_path / "calls.log"), str(tmp_path / "responses"), str(tmp_path / "stop")

    class Dying(CallableBackend):
        def run_batches(self, it):
            for pdf in it:
                with open(log, "a") as f:
                    f.writelines("x\n" for _ in range(len(pdf)))
                with open(log) as f:
                    n = len(f.readlines())
                if n > 30 and os.path.exists(stop):
                    raise MemoryError("lost")
                yield from super().run_batches(iter([pdf]))

    open(stop, "w").close()
    df = spark.createDataFrame([(i, f"prompt {i}") for i in range(60)], "id int, p string")
    b = Dying("d", lambda prompts: [p.upper() for p in prompts], max_attempts=1, backoff_s=0.0)
    with pytest.raises(Exception):  # noqa: B017
        infer(df, "p", b, "r", responses_path=store, parallelism=12).collect()
    kept = spark.read.parquet(store).count()
    assert 0 < kept < 60
    os.rename(log, log + ".first")
    os.rename(stop, stop + ".no")
    out = infer(df, "p", b, "r", responses_path=store, parallelism=12).collect()
    assert len(out) == 60 and all(r.r == f"PROMPT {r.id}" for r in out)
    assert calls(log) == 60 - kept


def test_a_limit_met_by_one_task_stops_all(spark, tmp_path):
    """One prompt meets the limit: while its task waits, no other task sends anything."""
    import time

    log = str(tmp_path / "calls.log")

    def fn(prompts):
        time.sleep(0.02)
        limited = "limited" in prompts[0] and not os.path.exists(log + ".met")
        with open(log, "a") as f:
            f.write(f"{time.time()} {int(limited)}\n")
        if limited:
            open(log + ".met", "w").close()
            raise RuntimeError("Rate limit. Please try again in 1s.")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(i, f"prompt {i}" if i != 5 else "limited") for i in range(200)], "id int, p string")
    b = CallableBackend("together", fn, batch_size=1, rate_limit_extra_s=0.5, shared_limit=True, round_s=0.1)
    out = {r.id: r for r in infer(df, "p", b, "r", parallelism=4).collect()}
    assert len(out) == 200 and all(r.r_status == "ok" for r in out.values()) and out[5].r == "LIMITED"
    times = [(float(t), int(x)) for t, x in (line.split() for line in open(log))]
    met = next(t for t, limited in times if limited)
    assert not [t for t, _ in times if met + 0.4 < t < met + 1.4]  # 0.4: the others end their round
    assert len(times) == 201


def test_a_limit_that_does_not_end_is_an_error(spark):
    def fn(prompts):
        raise RuntimeError("Please try again in 0s.")

    df = spark.createDataFrame([(i, f"prompt {i}") for i in range(3)], "id int, p string")
    b = CallableBackend("never", fn, max_attempts=2, rate_limit_extra_s=0.05, shared_limit=True, round_s=0.1)
    rows = infer(df, "p", b, "r", parallelism=2).collect()
    assert [r.r_status for r in rows] == ["error"] * 3 and "try again" in rows[0].r_error


def test_distill_rows_matches_distill(spark):
    from annolens.operators.chunking import prefix_tokens
    size = 6 + prefix_tokens()
    text = " ".join(f"Word{i}." for i in range(30))
    df = spark.createDataFrame([(1, text), (2, "tiny."), (3, None)], "k int, t string")
    a = {r.k: r.distilled for r in distill_rows(df, ["k"], "t", LeadBackend(1), 12, size).collect()}
    b = {r.k: r.distilled for r in distill(df.filter("t is not null").withColumn("o", F.lit(0)),
                                           ["k"], "o", "t", LeadBackend(1), 12, size).collect()}
    assert a[1] == b[1] and a[2] == b[2] == "tiny." and a[3] is None


def test_rate_limit_wait():
    b = CallableBackend("x", lambda p: p, backoff_s=1.0, rate_limit_extra_s=5.0)
    assert b.wait_seconds(RuntimeError("Rate limit. Please try again in 20s. Thanks"), 1) == 25.0
    assert b.wait_seconds(RuntimeError("boom"), 3) == 4.0
    assert b.wait_seconds(RuntimeError("Please try again in 999s."), 1) == 1004.0


def test_distill_one_round_like_the_reference(spark):
    """max_rounds=1: chunk answers are joined with a space even when the result
    is still over budget (the reference's one-level distill)."""
    from annolens.functions.prompts import chunk_prompt
    from annolens.operators.chunking import chunk_by_key, prefix_tokens
    size = 4 + prefix_tokens()
    rows = [(1, i, f"S{i}a. S{i}b. S{i}c.") for i in range(10)]
    df = spark.createDataFrame(rows, "g int, o bigint, t string")
    one = distill(df, ["g"], "o", "t", LeadBackend(2), 8, size, max_rounds=1).first()
    chunks = chunk_by_key(df, ["g"], "o", "t", 8, size, prefix_tokens()).withColumn("p", chunk_prompt(F.col("chunk_text")))
    answers = infer(chunks, "p", LeadBackend(2), "a").orderBy("chunk_idx").collect()
    assert one.rounds == 1 and one.kind == "chunk"
    assert one.distilled == " ".join(r.a for r in answers)
    assert len(one.distilled.split()) > 8          # still over budget, as the reference allows
    assert distill(df, ["g"], "o", "t", LeadBackend(2), 8, size).first() == one  # the default
