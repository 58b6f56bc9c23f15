import numpy as np

from acctlens.llm import gru


def test_training_reads_every_token_with_the_state_carried_on(monkeypatch):
    rng = np.random.default_rng(2)
    sizes = np.array([1, 5, gru.WINDOW, gru.WINDOW + 1, 500, 3])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    tokens = np.arange(starts[-1]) % gru.IDS
    seen, states, plain = [], [], gru.gradient

    def gradient(flat, ids, target, mask, state):
        grad, after = plain(flat, ids, target, mask, state)
        seen.append((ids[mask], target[mask]))
        states.append((state, after))
        return grad, after

    monkeypatch.setattr(gru, "gradient", gradient)
    gru.Trainer(gru.initial(rng.integers(1, 100, gru.IDS).astype(float))).texts(tokens, starts, 7, 4, 0)
    before, target = (np.concatenate(x) for x in zip(*seen))
    assert sorted(target) == sorted(tokens)
    wanted = {int(t): 7 if t in starts[:-1] else int(t) - 1 for t in tokens}
    assert all(wanted[int(t)] == b for b, t in zip(before, target))
    # A state is new, or that of the same texts after the window before.
    assert sum(not s.any() for s, _ in states) == 2
    for (_, last), (state, _) in zip(states, states[1:]):
        assert not state.any() or (state == last[: len(state)]).all()
