import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import chat as C

T = C.Template()
NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[", "<", "<s>", "[/INST]\\", "a\\</s>", "", "é\n\n[ROLE]x[TEXT]", "[INS"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "[INST]"]), st.one_of(st.text(max_size=30), st.sampled_from(NASTY)))))
def test_round_trip(turns):
    formatted = T.begin + "".join(s for role, text in turns for s, _ in T.segments(role, text))
    assert list(T.parse(formatted)) == turns


def test_text_out_of_place_is_an_error():
    for broken in ["<s>[INST]a", "<s>[INST]a[INST]", "</s>", "<s>x[/INST]"]:
        with pytest.raises(ValueError):
            list(T.parse(broken))


def rows():
    rnd = random.Random(1)
    out = []
    for conv in range(60):
        for turn in range(rnd.randrange(1, 9)):
            role = rnd.choice(["user", "assistant", "system"]) if conv % 3 else ["user", "assistant"][turn % 2]
            out.append((conv, turn, role, rnd.choice([*NASTY, None, "plain text é 🚀"])))
    out += [(900, t, ["user", "assistant"][t % 2], "long " * 50) for t in range(5000)]
    out += [(901, 0, "user", "x" * 300_000), (902, None, None, None), (902, 1, "assistant", "a"), (903, 0, "user", "b"), (903, 0, "user", "a"), (903, 0, "user", "a")]
    out += [(None, 0, "user", "q"), (None, 1, "assistant", "r")]
    return out


def expected(conversation):
    ordered = sorted(conversation, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in ordered)
    loss = "".join(r[3] or "" for r in ordered if r[2] == "assistant")
    return len(ordered), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_query(spark, tmp_path):
    data = rows()
    spark.createDataFrame([(*r, "extra") for r in data], "conv_id long, turn long, role string, text string, segment string").repartition(5).write.parquet(
        f"{tmp_path}/conversations.parquet"
    )
    got = {r.conv_id: r for r in C.op9(spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    data += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    assert set(got) == {r[0] for r in data}
    for conv, r in got.items():
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected([x for x in data if x[0] == conv])
    assert got[900].in_order and got[-7].in_order and not got[903].in_order and got[None].in_order


def test_segments(spark):
    frame = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "[u"), (1, 2, "assistant", "a")], "conv_id long, turn long, role string, text string")
    got = C.format_conversations(frame).orderBy("seq").collect()
    assert "".join(r.segment for r in got) == "<s>[SYS]s[/SYS][INST]\\[u[/INST][ANSWER]a</s>"
    assert [r.segment for r in got if r.loss] == ["a"]
    assert [r.ended for r in got] == [False] * (len(got) - 1) + [True]
    assert C.format_conversations(frame.limit(0)).count() == 0
