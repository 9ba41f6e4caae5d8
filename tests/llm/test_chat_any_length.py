"""What a template does is found at any length of a conversation, and a template of single turns keeps nothing of it."""

import pytest

from evidentia.llm import chat


class LateChange:
    """Declares that no turn changes another, which holds up to 36 turns."""

    memory = 0

    def render(self, turns):
        return "".join(f"<{r}>{t}" for r, t in turns) if len(turns) <= 36 else "!" + "".join(f"<{r}>{t}" for r, t in turns)


def test_a_wrong_declaration_is_found_beyond_sixteen_million_characters():
    state, text = chat.Incremental(LateChange(), frozenset()), "x" * 500_000
    with pytest.raises(chat.HistoryRewritten):
        for _ in range(40):
            state.add("user", text)
        state.close()


def test_single_turns_are_streamed():
    state = chat.Incremental(chat.MarkedTurns())
    out = [state.add(*t)[0] for t in [("user", "a [INST]"), ("assistant", "b</s>")] * 50]
    state.close()
    assert len(state.turns) == 1 and not state.pieces
    assert "".join(out) == chat.MarkedTurns().render([("user", "a [INST]"), ("assistant", "b</s>")] * 50)


def test_a_subclass_is_not_taken_as_single_turns():
    class Numbered(chat.MarkedTurns):
        def turn(self, role, text):
            return super().turn(role, text)

    assert chat.Incremental(Numbered()).whole
