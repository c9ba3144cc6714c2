"""Embedding near-dedup: filters go along with a vector, so that tasks that verify decode nothing."""

import numpy as np
import pyarrow as pa

from textloom.llm import vector_dedup as V


def test_verifying_decodes_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 24))
    vectors = np.concatenate([base + rng.normal(scale=s, size=base.shape) for s in (0, 0.1, 0.15, 0.2, 0.3)])
    n, words = len(vectors), V.codewords_for(len(vectors))
    ids = pa.array(np.arange(n))
    given = pa.RecordBatch.from_arrays([ids, ids, pa.array(vectors.tolist()), pa.array(np.full(n, 1))], ["rep", "vh", "vec", "copies"])
    rows = [r for b in V._filters(words)(iter([given])) for r in b.to_pylist()]
    monkeypatch.setattr(V, "list_decode", None)
    width = V.packed_as(words).itemsize
    dealt = sorted(((f, r["rep"], r["vec"], r["packed"][: at * width]) for r in rows for at, f in enumerate(r["filters"])), key=lambda x: x[:2])
    filters, reps, vecs, earlier = zip(*dealt, strict=True)
    zero, one = pa.array(np.zeros(len(dealt), int)), pa.array(np.ones(len(dealt), int))
    names = ["filter", "b1", "b2", "rep", "vh", "copies", "vec", "block", "earlier"]
    batch = pa.RecordBatch.from_arrays([pa.array(filters), zero, zero, pa.array(reps), pa.array(reps), one, pa.array(vecs), zero, pa.array(earlier, pa.binary())], names)
    links = np.zeros(n)
    for b in V._verify(0.95, words)(iter([batch])):
        np.add.at(links, np.asarray(b.column("rep")), np.asarray(b.column("links")))
    unit = V.unit_rows(vectors)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert want.sum() > 20 and links.tolist() == want.tolist()
