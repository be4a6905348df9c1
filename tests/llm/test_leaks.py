"""Copies edited as much as allowed, set in other words, are found whatever the item's length."""

import numpy as np
import pytest

from loamgraph.llm import decontamination


@pytest.mark.parametrize("lengths", [(15, 17, 19, *range(20, 60)), (4, 5, 6, 9, 12, 40)])
def test_every_length_is_found(lengths):
    rng = np.random.default_rng(11)
    items = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n)) for n in lengths for _ in range(6)]
    index = decontamination.Index.build(list(range(len(items))), items, **decontamination.DEFAULTS)
    found = {}
    for _ in range(40):
        texts = []
        for item, edits in zip(index.items, index.edits, strict=True):
            around = rng.integers(1, 1 << 62, 60, dtype=np.uint64)
            texts.append(np.concatenate([around[:30], decontamination.edited(item, edits, rng), around[30:]]))
        hits = {(d, i) for d, i, *_ in index.search(np.concatenate(texts), np.cumsum([0] + [len(t) for t in texts]))}
        for k, item in enumerate(index.items):
            found.setdefault(len(item), []).append((k, k) in hits)
    assert index.recall >= decontamination.DEFAULTS["target_recall"]
    assert min(np.mean(v) for v in found.values()) >= 0.96, {n: np.mean(v) for n, v in found.items()}
