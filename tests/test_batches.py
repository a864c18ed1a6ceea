"""Whole groups of sorted Arrow batches."""

from __future__ import annotations

import pyarrow as pa

from skylattice.functions.batches import whole_groups


def test_groups_stay_whole_over_batches():
    rows = [(g, i) for g, n in ((None, 3), (1, 1), (2, 17), (3, 2), (4, 9)) for i in range(n)]
    batches = [pa.RecordBatch.from_pydict({"g": [r[0] for r in rows[i:i + 4]], "i": [r[1] for r in rows[i:i + 4]]}) for i in range(0, len(rows), 4)]
    tables = list(whole_groups(iter(batches), ("g",), 5))
    assert len(tables) > 2
    assert [tuple(r.values()) for t in tables for r in t.to_pylist()] == rows
    seen = [set(t["g"].to_pylist()) for t in tables]
    assert all(not a & b for n, a in enumerate(seen) for b in seen[n + 1:])
    assert list(whole_groups(iter([]), ("g",))) == []
