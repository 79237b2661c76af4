import numpy as np

from asofia.llm import lm


def test_gradient_adds_up_over_blocks_and_any_order():
    """A class of more than ROWS positions is worked out in blocks; what they add up to doesn't hang on their order, and the network that training starts from stays."""
    rng = np.random.default_rng(9)
    net = lm.Network.start(rng.integers(0, 50, lm.VOCABULARY))
    ids, around = rng.integers(0, 100, 250).astype(np.int32), rng.integers(0, 60, (4, 250)).astype(np.int32)
    once = {k: v.copy() for k, v in lm.Trainer(net).gradient(ids, around).items()}
    order, before = rng.permutation(250 * 12), net.flat()
    many, wide = np.tile(ids, 12)[order], np.tile(around, 12)[:, order]
    assert np.bincount(many // lm.PLACES).max() > lm.ROWS
    trainer = lm.Trainer(net)
    for name, found in trainer.gradient(many, wide).items():
        assert np.allclose(found, 12 * once[name], rtol=1e-3, atol=1e-3), name
    trainer.step(many, wide, lm.RATE)
    assert (net.flat() == before).all() and (trainer.net.flat() == trainer.flat).all() and (trainer.flat != before).any()
    assert np.allclose(lm.log_probs(net, many, wide), np.tile(lm.log_probs(net, ids, around), 12)[order], atol=1e-4)
