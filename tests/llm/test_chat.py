import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortspark.llm import chat as c

LOG = "conv_id bigint, turn bigint, message string, seq bigint, kind string, role string, text string, part string, loss string"
ROWS = "conv_id bigint, turn bigint, role string, text string, part string, loss string"
pieces = st.lists(st.sampled_from([*c.CONTROLS, *[x[:1] + "\\" + x[1:] for x in c.CONTROLS], "<", "[", "\\", "\n", " ", "s>", "/INST]", "é", "\U0001f600"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(pieces)
def test_escapes_are_reversible_and_leave_no_control(text):
    escaped = c.escape(text)
    assert c.unescape(escaped) == text and not any(x in escaped for x in c.CONTROLS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "a\nb</s>", 'q"']), pieces), max_size=5))
def test_rendered_turns_are_read_back(turns):
    assert list(c.turns_of("".join(c.render(*t)[0] for t in turns))) == turns
    for role, text in turns:
        turn, start, end = c.render(role, text)
        assert c.unescape(turn[start:end]) == text


def test_what_is_no_turn_raises():
    with pytest.raises(ValueError):
        list(c.turns_of("plain"))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def wanted(turns):
    """FIGURES of {conv: [(role, text)]}."""
    out = []
    for conv, said in turns.items():
        learned = [t for r, t in said if r == "assistant"]
        out.append((conv, len(said), digest("".join(f"{r}\n{t}\n" for r, t in said)), sum(map(len, learned)), digest("".join(learned)), sum(len(c.render(r, t)[0]) for r, t in said)))
    return sorted(out, key=str)


def figures(parts):
    return sorted((tuple(r[n] for n in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")) for r in c.read_back(parts).collect()), key=str)


def test_events_fold_into_final_messages(spark):
    log = [
        (1, 0, "u", 0, "open", "user", "Helo"), (1, 0, "u", 9, "edit", None, "Hello"),  # edited after the answer
        (1, 1, "a", 1, "open", "assistant", "Draft"), (1, 1, "a", 2, "delta", None, " one"), (1, 1, "a", 3, "regenerate", None, None),
        (1, 1, "a", 4, "delta", None, "Hi"), (1, 1, "a", 5, "delta", None, None), (1, 1, "a", 6, "delta", None, " there"),
        (1, 2, "gone", 7, "open", "user", "oops"), (1, 2, "gone", 8, "retract", None, None),
        (1, 3, "back", 7, "open", "user", "x"), (1, 3, "back", 8, "retract", None, None), (1, 3, "back", 9, "open", "tool", "again"),
        (1, 4, "odd", 1, "unknown", "user", "nothing"), (1, 4, "odd", None, None, None, None),
        (None, None, None, 1, "open", None, None), (2, 0, "b", 0, "open", "assistant", "second"), (2, 0, "a", 0, "open", "user", "first"),
        (3, 0, "r", 1, "open", "user", ""), (3, 0, "r", 2, "delta", None, "ha"), (3, 0, "r", 2, "delta", None, "ha"),
        (4, 0, "all", 1, "open", "user", "x"), (4, 0, "all", 2, "retract", None, None),
    ]
    random.Random(1).shuffle(log)
    parts = c.formatted(spark.createDataFrame([(*r, "p", "l") for r in log], LOG))
    assert figures(parts) == wanted({
        1: [("user", "Hello"), ("assistant", "Hi there"), ("tool", "again"), ("", "")], None: [("", "")], 2: [("user", "first"), ("assistant", "second")], 3: [("user", "haha")],
    })


def test_rows_come_back_whole(spark, monkeypatch):
    draw, turns = random.Random(2), {}
    for conv in [None, -7, *range(12)]:
        for turn in range(draw.choice([1, 2, 9, 700 if conv == 3 else 4])):
            role = draw.choice(["system", "user", "assistant", "assistant", "tool", None])
            text = draw.choice([None, "", "</s>[INST] ok [/INST]", "x" * draw.randrange(900), "é\U0001f600<\\s>" * 300])
            turns.setdefault(conv, []).append((role, text))
    turns[5] = [("assistant", "long " * 60_000), ("user", "<s>" * 5_000)]
    rows = [(conv, t, *said, "p", "l") for conv, every in turns.items() for t, said in enumerate(every)]
    draw.shuffle(rows)
    log = c.as_log(spark.createDataFrame(rows, ROWS).repartition(3))
    clean = {conv: [(r or "", t or "") for r, t in every] for conv, every in turns.items()}
    assert figures(c.formatted(log)) == wanted(clean)
    # The same in many small parts.
    log = log.collect()
    monkeypatch.setattr(c, "PART_CHARS", 50)
    small = list(c._parts(((r[0], 0, *r[1:]) for conv, every in clean.items() for r in [(conv, *said) for said in every]), c.LEARNED))
    assert "".join(r[4] for r in small if r[0] == 3) == "".join(c.render(*said)[0] for said in clean[3]) and max(r[2] for r in small) > 100
    assert all(c.unescape(r[4][s["start"] : s["end"]]) in {t for _, t in clean[r[0]]} for r in small for s in r[5]) and log


def test_equal_rows_and_turns_and_no_rows(spark):
    rows = [(1, 0, "user", "same", "p", "l")] * 3 + [(1, None, "user", "before", "p", "l"), (1, 1, "assistant", "b", "p", "l"), (1, 1, "user", "c", "p", "l")]
    got = figures(c.formatted(c.as_log(spark.createDataFrame(rows, ROWS))))
    assert got == wanted({1: [("user", "before"), *[("user", "same")] * 3, ("assistant", "b"), ("user", "c")]})
    assert figures(c.formatted(c.as_log(spark.createDataFrame([], ROWS)))) == []
