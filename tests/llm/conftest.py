import random

import pytest
from brute import DOCS


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) or (id, text, lang, source) rows."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def corpus():
    """Random texts with exact copies, near copies and shared passages."""

    def make(n, seed, vocabulary=400, longest=60):
        rng = random.Random(seed)
        vocab = [f"w{i}" for i in range(vocabulary)]
        out = []
        while len(out) < n:
            kind = rng.random()
            if out and kind < 0.15:
                out.append(rng.choice(out))
            elif out and kind < 0.55:
                w = rng.choice(out).split()
                for _ in range(rng.randrange(0, 4)):
                    if w:
                        w[rng.randrange(len(w))] = rng.choice(vocab)
                out.append(" ".join(w))
            elif out and kind < 0.65:
                a = rng.choice(out).split()
                cut = rng.randrange(0, max(1, len(a)))
                out.append(" ".join([rng.choice(vocab) for _ in range(rng.randrange(5))] + a[cut:] + [rng.choice(vocab)]))
            else:
                out.append(" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, longest))))
        return out

    return make
