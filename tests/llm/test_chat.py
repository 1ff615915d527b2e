"""Chat formatting: outputs rebuilt from pieces equal whole renderings, spans hold the texts, rewrites are seen, reading back is exact."""

import hashlib
import random

import pyspark.sql.functions as F
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hodoscope.llm import chat

BITS = ["<|im_end|>", "<|im_start|>", "<", "|", "\\", "<\\|", "assistant", "\n", "é", "", "<think>x</think>", "</s>", "<s>", "0", "1", "\U0001f600"]


def talks(seed, n, longest=9):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(BITS) for _ in range(rng.randrange(6)))
    return [[(rng.choice(["system", "user", "assistant", "a\nb\\n", "<|im_end|>", ""]), text()) for _ in range(rng.randrange(1, longest))] for _ in range(n)]


@given(st.text(alphabet="<|\\ai\n", max_size=12))
@settings(max_examples=400)
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.role_of(chat.role_line(text)) == text and "\n" not in chat.role_line(text) and "<|" not in chat.role_line(text)


@pytest.mark.parametrize("template", ["marked", "headed", "last_thoughts"])
@pytest.mark.parametrize("window", [2, 5, 64])
def test_pieces_rebuild_every_prefix(template, window):
    render = chat.TEMPLATES[template]
    if template == "last_thoughts" and window < 64:
        window = 64  # thoughts further back than the window change nothing any more, but their removal isn't seen
    for turns in talks(window, 60, 30):
        one, out = chat.Renderer(render, frozenset(["assistant"]), window), ""
        for k, (role, text) in enumerate(turns):
            row = one.add(role, text)
            before, out = out, out[: row["keep"]] + row["piece"]
            assert out == render(turns[: k + 1])
            assert row["rewrites"] == (not out.startswith(before))
            assert (row["loss_start"] is not None) == (role == "assistant")
            if role == "assistant":
                assert out[row["loss_start"] : row["loss_end"]] == chat.escape(text)


def test_template_that_trims_and_one_that_looks_ahead():
    trim = lambda turns: "".join(f"({r}:{t.strip()})" for r, t in turns)
    one = chat.Renderer(trim, frozenset(["assistant"]))
    row = one.add("assistant", "  ok ")
    assert row["piece"][row["loss_start"] : row["loss_end"]] == "ok"
    count = lambda turns: f"{len(turns)} turns;" + "".join(t for _, t in turns)
    one = chat.Renderer(count, frozenset())
    assert [one.add("user", "x")["rewrites"], one.add("user", "y")["rewrites"]] == [False, True]


def test_query_on_odd_rows(spark, folder):
    rng = random.Random(2)
    rows = [(c, i, r, t) for c, turns in enumerate(talks(8, 50)) for i, (r, t) in enumerate(turns)]
    rows += [(777, i, rng.choice(["user", "assistant"]), rng.choice(BITS) * 5) for i in range(2500)]  # a conversation far over the window
    rows += [(None, 1, "user", "null id"), (None, None, "assistant", None), (5000, 3, None, "x"), (5000, 3, None, "x"), (5000, 3, "assistant", None), (5001, None, "assistant", "y" * 300_000), (-1, 9, "user", "own row of -1")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"piece": F.lit("clash"), "seq": F.lit(-1), "keep": F.lit("z")})
    df.repartition(7).write.parquet(f"{folder}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op13_chat_format(spark, folder).collect()}
    groups = {}
    for c, i, r, t in [*rows, (-1, 0, "user", chat.SAID), (-1, 1, "assistant", chat.SAID)]:
        groups.setdefault(c, []).append((i is not None, i or 0, (r or "").encode(), (t or "").encode()))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns = [(r.decode(), t.decode()) for _, _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].formatted_chars, got[c].rewrites) == (len(turns), len(loss), len(chat.marked(turns)), 0)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_operator_rows_and_empty_table(spark, folder):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "<think>b</think>c"), (1, 2, "user", "d")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df, "last_thoughts").collect()
    assert [r.rewrites for r in out] == [False, False, True] and [r.seq for r in out] == [0, 1, 2]
    assert out[2].piece.startswith("c<|im_end|>")  # what stood after the dropped thought is put out again
    assert chat.format_conversations(df.limit(0)).count() == 0
    df.limit(0).write.parquet(f"{folder}/conversations.parquet")
    assert [r.conv_id for r in chat.op13_chat_format(spark, folder).collect()] == [-1]


def test_reading_back_refuses_text_outside_of_turns():
    with pytest.raises(ValueError):
        chat.read_back("x" + chat.marked([("user", "a")]))


def _rebuilt(rows, render, turns):
    out = ""
    for k, r in enumerate(rows):
        before, out = out, out[: r.keep] + r.piece
        assert out == render(turns[: k + 1]) and r.rewrites == (not out.startswith(before))


def test_rewrites_far_back_are_seen(spark):
    turns = [("assistant" if k % 2 else "user", f"t{k}<think>{k}</think>") for k in range(100)]
    df = spark.createDataFrame([(1, k, *t) for k, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    every_tenth = lambda turns: "".join(t.upper() if len(turns) % 10 == 0 and k == 0 else t for k, (_, t) in enumerate(turns))
    for template in (every_tenth, "last_thoughts", "marked"):
        rows = chat.format_conversations(df, template).collect()
        _rebuilt(rows, chat.TEMPLATES.get(template, template) if isinstance(template, str) else template, turns)
    assert chat.safe_window(every_tenth) is None and chat.safe_window(chat.marked) == chat.WINDOW and chat.safe_window(every_tenth, 40) == 82
