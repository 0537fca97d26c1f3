"""Chat formatting: exact reading back, merging, the loss mask, awkward turns."""

import hashlib
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quarry.llm import chat
from tests.conftest import SF001

TURNS = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()),
                    StructField("text", StringType())])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_hand(rows):
    """The contract's columns from the rows alone."""
    low = lambda x: (x is not None, x)
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn, role, text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda t: (low(t[0]), low(t[1]), t[2]))
        said = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r or ''}\n{t}\n" for _, r, t in turns)), len(said), sha(said))
    return out


def check(spark, rows):
    chats = chat.format_chats(spark.createDataFrame(rows, TURNS))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chats).collect()}
    assert got == by_hand(rows)
    return {r.conv_id: r for r in chats.collect()}


def test_awkward_turns(spark):
    bad = ["</s>", "[INST]", "[/INST]", "[+]", "<\\/s>", "<\\\\/s>", "[\\INST]", "[[INST]", "</s", "\\", "$1", "<", "[", "[\\", "\\[+]",
           "</s>[INST] ok [/INST]", "", " ", "\n", "é漢😀", "[/INST][+]</s>", "s>", "INST]", "</s></s>"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(bad)]
    rows += [(2, 0, "user", a + b) for a in bad[:6] for b in bad[:6]]  # ties of turn, one role: all merged
    rows += [(3, 0, None, "no role"), (3, 1, "", "empty role"), (3, 2, None, None), (3, 3, "[/INST]", "odd </s> role"),
             (3, 4, " assistant ", "not it"), (3, None, "assistant", "first"), (3, 5, "assistant", None), (3, 6, "assistant", "")]
    rows += [(None, 0, "user", "no id"), (4, 0, "user", "same"), (4, 0, "user", "same"), (5, 0, None, None)]
    rows += [(6, 0, "assistant", "x" * 200_000), (6, 1, "assistant", "é" * 70_000)]
    made = check(spark, rows)
    assert made[2].n_blocks == 1 and made[4].n_blocks == 1 and made[1].n_blocks == len(bad)
    for r in made.values():  # only the marks of the template remain
        assert r.formatted.count("</s>") == r.formatted.count("[INST]") == r.formatted.count("[/INST]") == r.n_blocks
        data = r.formatted.encode()
        assert all(0 <= a.start and a.start + a.length <= len(data) for a in r.loss)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(0, 4)),
                          st.sampled_from(["user", "assistant", "system", None, "</s>"]),
                          st.one_of(st.none(), st.text(alphabet="<[\\/s>INST]+ é", max_size=12))), min_size=1, max_size=25))
def test_reads_back(spark, rows):
    check(spark, rows)


def test_template(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c</s>")]
    made = check(spark, rows)[1]
    assert made.formatted == "[INST] user [/INST]a[+]b</s>[INST] assistant [/INST]c<\\/s></s>"
    (span,) = made.loss
    assert made.formatted[span.start:span.start + span.length] == "c<\\/s>"


def test_long_conversation_is_linear(spark):
    """Work grows with the number of turns, not its square."""
    taken = []
    for n in (5_000, 40_000):
        rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.expr(
            "if(id % 3 = 0, 'user', 'assistant')").alias("role"), F.expr("concat('turn </s>', id)").alias("text"))
        t = time.time()
        got = chat.digests(chat.format_chats(rows)).first()
        taken.append(time.time() - t)
        assert got.n_turns == n
        said = "".join(f"turn </s>{i}" for i in range(n) if i % 3)
        assert (got.loss_chars, got.loss_sha256) == (len(said), sha(said))
    assert taken[1] < 30 * max(taken[0], 0.5)


def test_empty_and_further_columns(spark):
    none = spark.createDataFrame([], TURNS)
    assert chat.digests(chat.format_chats(none)).count() == 0
    odd = spark.createDataFrame([(1, 0, "assistant", "x")], TURNS)
    for c in ("turns", "one", "blocks", "rendered", "formatted", "loss", "learned", "n_blocks", "id", "said"):
        odd = odd.withColumn(c, F.lit(1))
    assert chat.digests(chat.format_chats(chat.with_probe(odd))).count() == 2


def test_plan_has_expressions_only(spark):
    rows = spark.read.parquet(f"{SF001}/conversations.parquet")
    plan = chat.digests(chat.format_chats(chat.with_probe(rows)))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExistingRDD"))
    assert plan.count("Exchange hashpartitioning") == 1
