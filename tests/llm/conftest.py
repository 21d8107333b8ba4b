import pytest


@pytest.fixture(scope="session")
def words():
    """Deterministic invented words."""
    import random

    def make(n, seed=1, vocabulary=5000):
        rnd = random.Random(seed)
        return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]

    return make
