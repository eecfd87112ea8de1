"""Answers kept with a model: the same as without, each found once."""

from __future__ import annotations

import random

from tests.test_segment import toy
from textloom.operators import segment as S


def test_kept_answers(monkeypatch):
    rng = random.Random(3)
    texts = ["，".join("".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 6))) for _ in range(4)) for _ in range(60)]
    want = [S.tokenize(toy(), t) for t in texts]  # a model of its own for each text
    model, asked = toy(), []
    decode = S.decode
    monkeypatch.setattr(S, "decode", lambda m, x: asked.append(x) or decode(m, x))
    assert [S.tokenize(model, t) for t in texts * 2] == want * 2
    assert len(asked) == len(set(asked)) > 4
    S.decode.__name__ = "bounded"
    monkeypatch.setattr(S, "KEPT", 3)
    assert [S.tokenize(model, t) for t in texts] == want and max(len(v) for k, v in model.__dict__.items() if k == "_kept_bounded") <= 3
