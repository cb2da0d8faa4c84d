import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import chat

TEXT = st.text(alphabet=st.sampled_from(list("ab\\e<|>s/[]INT \n")), max_size=25)


@settings(max_examples=12, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=30))
def test_escaping_is_reversible(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t"), chat.DEFAULT).alias("e"))
    for r in rows.select("t", "e", chat.unescape(F.col("e")).alias("back")).collect():
        assert r.back == r.t
        assert not any(c in r.e for c in chat.DEFAULT.controls)


def test_digest(spark):
    rows = [(1, 1, "assistant", "B</s>"), (1, 0, "user", "<|user|>\nA"), (2, 0, "system", "S"), (2, 1, "user", None), (2, 2, "assistant", "é\\b"), (2, 3, "user", "q"), (3, 0, "assistant", "first"), (4, None, None, None), (None, 0, "user", "x"), (5, 0, "user", "u"), (5, 0, "user", "u"), (5, 1, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(turns)).collect()}
    for conv, r in got.items():
        own = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == conv))
        said = "".join(f"{x[2]}\n{x[3]}\n" for x in own)
        learned = "".join(x[3] for x in own if x[2] == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: True, 3: False, 4: False, None: True, 5: False}
    assert chat.digest(chat.format_chats(turns.limit(0))).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    from tallyforge.llm.queries import op4_chat

    plan = op4_chat(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
