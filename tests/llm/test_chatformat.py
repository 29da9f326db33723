"""Chat formatting: exact round trips."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dossier.llm import chatformat as chat

pieces = st.lists(st.sampled_from([*chat.CONTROL, "<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "x", "\n", "é", "😀"]), max_size=12).map("".join)
roles = st.sampled_from(["system", "user", "assistant", "tool", "", "[AS]", "a\nb"])


@settings(max_examples=300, deadline=None)
@given(pieces)
def test_escaping_is_undone_and_hides_every_control_string(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not chat.MARK.search(chat.escape(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(roles, pieces), max_size=6))
def test_conversations_parse_back(turns):
    rendered = [chat.render_turn(r, t) for r, t in turns]
    parser = chat.Parser()
    whole = chat.BEGIN + "".join(r[0] for r in rendered)
    back = list(parser.feed(whole))
    parser.close()
    assert [(r, t) for r, t, _, _ in back] == turns
    assert all(start > 0 and length >= len(t) for (_, start, length), (_, t) in zip(rendered, turns, strict=True))
    assert [chat.unescape(whole[s : s + n]) for _, _, s, n in back] == [t for _, t in turns]


def test_plain_text_stays_plain():
    assert chat.render_turn("user", "hello [world] <b>")[0] == "[INST]hello [world] <b>[/INST]"
    assert chat.render_turn("assistant", "</s>[INST] ok [/INST]")[0] == "[REPLY]<\\/s>[\\INST] ok [\\/INST]</s>"


@pytest.mark.parametrize("bad", ["x", "<s>x", "<s>[INST]a", "<s>[INST]a[REPLY]", "<s></s>", "<s>[ROLE]a[/AS]", "<s>[INST]a[/INST]x[INST]b[/INST]"])
def test_the_grammar_is_strict(bad):
    parser = chat.Parser()
    with pytest.raises(chat.GrammarError):
        list(parser.feed(bad))
        parser.close()


ROWS = [
    (1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (2, 0, None, None), (2, 0, "user", "tie b"), (2, 0, "user", "tie a"), (2, None, "system", ""),
    (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (None, 5, "user", "no id"), (4, 0, "assistant", "long " * 40_000),
]


def test_table(spark):
    given = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "conv_id long, turn long, role string, text string, rendered string, loss_start int")
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_turns(given)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv in got:
        turns = sorted(((t is not None, t, r or "", x or "") for c, t, r, x in ROWS if c == conv), key=lambda k: (k[0], k[1] or 0, k[2], k[3]))
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        row = got[conv]
        assert (row["n_turns"], row["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert row["formatted_chars"] == 3 + sum(len(chat.render_turn(r, x)[0]) for _, _, r, x in turns)
    assert chat.conversation_digests(chat.format_turns(given.limit(0))).collect() == []
