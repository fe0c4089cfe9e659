"""Training from all counted triples."""

from __future__ import annotations

import numpy as np

from strataspark.llm import log_bilinear as lb


def test_rare_triples_teach():
    cube = np.zeros((lb.CLASSES,) * 3)
    cube[1, 2, 3] = 4e9
    cube[4, 5, 6] = cube[4, 5, 7] = 1e9
    cube[10, 11, 12] = cube[20, 21, 13] = 400
    table = lb.train(cube).table()
    assert np.allclose((10**table).sum(axis=2), 1)
    # Draws by count would hardly ever meet a rare triple: 0.13 are expected of each.
    there = table[10, 11, 12] - table[10, 11, 13]
    elsewhere = table[20, 21, 12] - table[20, 21, 13]
    assert there - elsewhere > 1

