"""The first epoch learns from every window."""

from __future__ import annotations

import random

import numpy as np

from tidemark.llm import toxicity


def test_first_epoch_takes_all_windows(monkeypatch, prose_of):
    rng = random.Random(4)
    texts = [prose_of(rng, 16 * 40) for _ in range(6)]
    taken, plain = [], np.add.at
    real = toxicity.np

    class Counting:
        def __getattr__(self, name):
            return getattr(real, name)

    class Add:
        reduceat, __call__ = np.add.reduceat, staticmethod(np.add)

        @staticmethod
        def at(mean, which, values):
            taken.append(len(mean))
            plain(mean, which, values)

    counting = Counting()
    counting.add = Add()
    monkeypatch.setattr(toxicity, "np", counting)
    toxicity.fit(texts, real.array([True, False] * 3), buckets=1 << 12, epochs=1)
    assert sum(taken) == 6 * 40
