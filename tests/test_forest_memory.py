"""What a partition holds while it drops edges that no forest can have."""

import numpy as np
import pyarrow as pa

from edgeloom.operators import forest as T


def test_a_partition_holds_a_bounded_number_of_edges(monkeypatch):
    monkeypatch.setattr(T, "HELD_EDGES", 60)
    rng = np.random.default_rng(5)
    for nodes in (20, 1000):  # a forest far below the bound is held on, one near it is handed over
        a, b = rng.integers(0, nodes, (2, 600))
        rank = rng.permutation(600)
        batches = [pa.RecordBatch.from_arrays([pa.array(x[k : k + 30]) for x in (a, b, rank)], ["a", "b", "rank"]) for k in range(0, 600, 30)]
        most, reduced = [0], T._reduced
        monkeypatch.setattr(T, "_reduced", lambda held: most.append(sum(map(len, held))) or reduced(held))
        out = list(T._local(iter(batches)))
        assert 60 <= max(most) < 60 + 30 + 30
        monkeypatch.setattr(T, "_reduced", reduced)
        want = set(rank[T.smallest_forest(a, b, rank)].tolist())
        assert set(pa.Table.from_batches(list(T._whole(iter(out)))).column("rank").to_pylist()) == want
    assert not list(T._local(iter([]))) and not list(T._whole(iter(batches[:0])))
