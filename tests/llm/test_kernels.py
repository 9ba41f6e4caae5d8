"""Models, formats and codecs without Spark."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidentia.llm import chat, gru, shard, tiff, toxicity
from evidentia.llm.bpe import BPE
from evidentia.llm.pieces import Memo, flattened
from evidentia.llm.tokenfile import Library

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model():
    return BPE(PATH)


def texts():
    rng = random.Random(5)
    parts = list("abetrs'ldm THE  \n\t\r\x0b\x0c\x1c\x85\xa0 　 123½²ßé漢字🙂_.,-") + ["<|endoftext|>", " the", "ing", "'re", "   ", "\n\n", "tionandthe"]
    return ["", " ", "x" * 5000] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]


def test_bpe_equals_the_library(model):
    library = Tokenizer.from_file(PATH)
    own, joined = Memo(lambda pieces: flattened(model.pieces(pieces))), Memo(Library(PATH))
    for text, a, b in zip(texts(), own.texts(texts()), joined.texts(texts()), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert ids == a.tolist() == b.tolist(), text
        assert model.decode(a) == library.decode(ids, skip_special_tokens=False) == text
    assert 0 < model.failed < model.tested


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(compression, predictor):
    rng = random.Random(1)
    for payload in (bytes(64), bytes(rng.randrange(256) for _ in range(64 * 300)), b"the cat sat on the mat. "[:16] * (4 * 900)):
        assert b"".join(p["pixels"] for p in tiff.pages(tiff.write(payload, compression, predictor))) == payload
    many = list(tiff.pages(tiff.write(b"ab" * (32 * 33000), tiff.DEFLATE, predictor)))
    assert [p["height"] for p in many] == [16384, 16384, 232]


def test_chat_spans_and_history():
    rng, template = random.Random(2), chat.MarkedTurns()
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "system", "", "o[:]d\\"]), "".join(rng.choice(["<s>", "</s>", "[INST]", "[/INST]", "\\", "[:]", "a", "[", "<", "/", "\n"]) for _ in range(rng.randint(0, 8)))) for _ in range(40)]
        state, out = chat.Incremental(template), ""
        for role, text in turns:
            piece, a, b = state.add(role, text)
            out += piece
            assert (a is not None) == (role == "assistant")
            assert a is None or template.unescape(piece[a:b]) == text
        assert out == template.render(turns) and template.parse(out) == turns

    class Rewriting(chat.MarkedTurns):
        memory = None

        def render(self, turns):
            return f"{len(turns)}:" + super().render(turns)

    state = chat.Incremental(Rewriting())
    state.add("user", "a")
    with pytest.raises(chat.HistoryRewritten):
        state.add("assistant", "b")


def test_gru_gradients():
    net, rng = gru.AttentiveBiGRU(3, 2, 2, dtype=np.float64), np.random.default_rng(0)
    x, mask = rng.standard_normal((4, 5, 3)), np.arange(5) < np.array([5, 3, 5, 1])[:, None]
    y, w = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 1])
    _, gradient = net.gradients(x, mask, y, w)
    for name, values in net.p.items():
        for i in np.ndindex(values.shape):
            old, step = values[i], 1e-6
            values[i] = old + step
            high = net.gradients(x, mask, y, w)[0]
            values[i] = old - step
            low = net.gradients(x, mask, y, w)[0]
            values[i] = old
            assert abs((high - low) / (2 * step) - gradient[name][i]) < 1e-7


def test_packing_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(50):
        sizes = sorted((float(rng.randint(1, 60)) for _ in range(80)), reverse=True)
        left: list[float] = []
        for s in sizes:
            fits = [(r, b) for b, r in enumerate(left) if r >= s]
            if fits:
                left[min(fits)[1]] -= s
            else:
                left.append(100.0 - s)
        assert shard.bins_needed([(s, 1) for s in sizes], 100.0) == len(left)


def test_rewriting_is_found_late_and_behind_a_declared_memory():
    class Late(chat.MarkedTurns):
        """Says that no turn changes another, but the hundredth one does."""

        def render(self, turns):
            return "?" * (len(turns) >= 100) + super().render(turns)

    state = chat.Incremental(Late())
    with pytest.raises(chat.HistoryRewritten):
        for k in range(200):
            state.add("user", f"turn {k}")
        state.close()


def test_long_conversations_are_let_go_piece_by_piece():
    class Begun(chat.MarkedTurns):
        memory = 0

        def render(self, turns):
            return "^" + super().render(turns) if turns else ""

    state, whole = chat.Incremental(Begun(), kept_chars=200), []
    for k in range(300):
        whole.append(state.add("user" if k % 2 else "assistant", f"turn {k}")[0])
    state.close()
    assert "".join(whole) == Begun().render([("user" if k % 2 else "assistant", f"turn {k}") for k in range(300)])
    assert len(state.turns) < 60


def test_history_that_is_rewritten_and_put_right_again_is_found():
    class Healing(chat.MarkedTurns):
        """Declares nothing itself, and changes the whole at five turns only."""

        def render(self, turns):
            return "!" * (len(turns) == 5) + super().render(turns)

    class Declared(Healing):
        memory = 0

    for template in (Healing(), Declared()):
        state = chat.Incremental(template)
        with pytest.raises(chat.HistoryRewritten):
            for k in range(8):
                state.add("user", f"turn {k}")
        assert state.seen in (4, 5)


def test_an_undeclared_template_is_held_whole_at_any_length():
    class Far(chat.MarkedTurns):
        def render(self, turns):
            return "!" * (len(turns) > 90) + super().render(turns)

    state = chat.Incremental(Far(), kept_chars=100)
    with pytest.raises(chat.HistoryRewritten):
        for k in range(120):
            state.add("assistant", f"turn {k}")
    assert state.seen == 90


def test_vectors_are_learned():
    """Words that no count tells apart are told apart by their learned vectors."""
    model = toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), np.zeros(1 << toxicity.BITS, np.float32), gru.AttentiveBiGRU(toxicity.WIDTH))
    texts = [f"{'bad' if k % 2 else 'good'}{'' if k % 3 else 'ly'} word number {k}".encode() for k in range(200)]
    y = np.array([k % 2 for k in range(200)], dtype=np.float32)
    vectors = toxicity.Vectors(model, texts)
    model.net.train(vectors, vectors.mask, y, np.ones(200, np.float32), epochs=12)
    vectors.put(model)
    got = model.logits([b"this is bad", b"this is good", b"badness"])
    assert got[0] > got[1] and got[2] > got[1]
    x, firsts = model.inputs(texts[:3])
    for k in range(3):
        n = firsts[k + 1] - firsts[k]
        assert np.allclose(x[firsts[k] : firsts[k + 1]], vectors.of(np.array([k]))[0, :n], atol=1e-6)
