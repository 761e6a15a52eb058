import re

from buslens.llm import chat
from buslens.llm.chat import perspectives
from tests.llm.helpers import ordered, with_clashes

TURNS = "conv_id long, turn long, role string, text string"
ODD = [
    (1, 0, "system", "be nice"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "bye é😀"), (1, 3, "ann", "bye é😀"), (1, None, "cy", "first"),
    (2, 0, "system", "alone"), (None, 0, None, "who"), (None, 1, "user", ""), (3, 5, "assistant", "x" * 100_000),
]


def brute(rows):
    out = []
    named = [(c, t, r or "unknown", x or "") for c, t, r, x in rows]
    for conv, speaker in {(c, r) for c, _, r, _ in named if r != "system"}:
        turns = sorted((x[1:] for x in named if x[0] == conv), key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))
        at = 0
        for n, (turn, role, text) in enumerate(turns):
            own = role == speaker
            shown = "system" if role == "system" else "assistant" if own else "user"
            head = f"<|im_start|>{shown}" + (f" name={role}" if shown == "user" else "") + "\n"
            segment = f"{head}{text}<|im_end|>\n"
            bounds = (at + len(head), at + len(segment)) if own else (None, None)
            out.append((conv, speaker, turn, n, shown, role if shown == "user" else None, segment, at, *bounds, own))
            at += len(segment)
    return out


def test_equals_brute_force(spark):
    found = perspectives(with_clashes(spark.createDataFrame(ODD, TURNS)))
    assert found.columns == chat.COLUMNS
    assert ordered(found.collect()) == ordered(brute(ODD))


def test_one_conversation_over_many_slices(spark):
    rows = [(1, k // 2, ["ann", "bob", "cy"][k % 3], f"text {k}") for k in range(600)] + [(2, 0, "ann", "other")]
    assert ordered(perspectives(spark.createDataFrame(rows, TURNS).repartition(4)).collect()) == ordered(brute(rows))


def test_segments_make_the_masked_text(spark):
    rows = sorted((r for r in perspectives(spark.createDataFrame(ODD, TURNS)).collect() if (r.conv_id, r.speaker) == (1, "ann")), key=lambda r: r.position)
    text = "".join(r.segment for r in rows)
    assert all(text[r.start :].startswith(r.segment) for r in rows)
    assert [text[r.mask_start : r.mask_end] for r in rows if r.in_loss] == ["hi<|im_end|>\n"] + ["bye é😀<|im_end|>\n"] * 2


def test_empty_and_native(spark, sf_dir):
    assert perspectives(spark.createDataFrame([], TURNS)).collect() == []
    plan = perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)
