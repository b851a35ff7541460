"""Chat formatting: round trip over awkward texts, digests, loss mask."""

import hashlib
import itertools
import random

from pyspark.sql import functions as F

from annolens.llm import chat
from annolens.llm.queries import op3_chat

AWKWARD = ["</turn>", "### ", "\\", ":", " ", "\n", "#", "<", "/turn>", "user", "##\\# ", "<\\/turn>", "<\\.>", "é🙂", ""]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escapes_are_reversible(spark):
    texts = ["".join(x) for n in range(4) for x in itertools.product(AWKWARD, repeat=n)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    bad = df.where(~chat.read_body(chat.render_body(F.col("t"))).eqNullSafe(F.col("t")) | ~chat.unescape_role(chat.escape_role(F.col("t"))).eqNullSafe(F.col("t")))
    assert bad.count() == 0
    assert df.where(chat.escape_role(F.col("t")).contains(":")).count() == 0
    plain = df.where(~F.col("t").contains("</turn>") & ~F.col("t").contains("### ") & (chat.unescape(F.col("t")) == F.col("t")))
    assert plain.where(chat.render_body(F.col("t")) != F.col("t")).count() == 0  # only conflicts are escaped


def test_conversations(spark):
    rnd = random.Random(2)
    rows = []
    for c in range(40):
        for t in range(rnd.randint(1, 7)):
            rows.append((c, t, rnd.choice(["user", "assistant", "system", "a:b", "", "x\\", "### r</turn>"]), "".join(rnd.choices(AWKWARD, k=rnd.randint(0, 6)))))
    rows += [(50, 0, None, None), (50, 0, None, None), (50, None, "assistant", "first"), (None, 1, "assistant", "x" * 200000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df)
    shown = {r["conv_id"]: r for r in chat.digest(out).collect()}
    text = {r["conv_id"]: r for r in out.collect()}
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(shown) == set(groups)
    for c, g in groups.items():
        g.sort()
        loss = "".join(x for _, r, x in g if r == "assistant")
        d = shown[c]
        assert (d["n_turns"], d["turns_sha256"]) == (len(g), sha("".join(f"{r}\n{x}\n" for _, r, x in g)))
        assert (d["loss_chars"], d["loss_sha256"]) == (len(loss), sha(loss))
        assert d["formatted_chars"] == len(text[c]["formatted"])
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_given_conversation(spark):
    one = {r["conv_id"]: r for r in op3_chat(spark, "/root/testdata/sf0.001").collect()}[-7]
    body = "\\### Assistant: </turn> ok"
    assert (one["n_turns"], one["loss_chars"], one["loss_sha256"]) == (2, len(body), sha(body))
    assert one["turns_sha256"] == sha(f"user\n{body}\nassistant\n{body}\n")
