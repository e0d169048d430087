"""Chunks of a batch are cut a bounded number of characters at a time, with the same result."""

import pandas as pd
from quarry.operators import retrieval


def test_batches_are_cut_in_bounded_groups(monkeypatch):
    made, sizes, cut = [], [], retrieval.windows
    monkeypatch.setattr(retrieval.F, "pandas_udf", lambda f, kind: made.append(f) or (lambda x: None))
    monkeypatch.setattr(retrieval, "windows", lambda texts: sizes.append(sum(map(len, texts))) or cut(texts))
    retrieval.chunk_array("text")
    texts = [None, "", *("some words " * (i * 37 % 900) for i in range(500)), "long " * 500_000, None, "end"]
    assert made[0](pd.Series(texts, dtype=object)).tolist() == cut([x or "" for x in texts])
    longest = max(len(x or "") for x in texts)
    assert len(sizes) > 2 and max(sizes) <= retrieval.CHARACTERS_AT_ONCE + longest
    assert made[0](pd.Series([], dtype=object)).tolist() == []
