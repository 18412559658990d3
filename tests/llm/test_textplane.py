import numpy as np
import pyarrow as pa

from waymill.llm import textplane
from waymill.llm.textplane import HashIndex, Plane, run_hashes, slices


def test_hashes_depend_on_content_only(monkeypatch):
    rng = np.random.default_rng(1)
    points = rng.integers(0, 4, 5000).astype(np.uint32)
    starts = np.sort(rng.integers(0, 4990, 3000))
    ends = np.minimum(starts + rng.integers(0, 9, 3000), 5000)
    whole = run_hashes(points, starts, ends)
    seen = {}
    for h, a, b in zip(whole.tolist(), starts, ends):
        assert seen.setdefault(tuple(points[a:b].tolist()), h) == h
    assert len(set(seen.values())) == len(seen)
    monkeypatch.setattr(textplane, "BLOCK", 100)
    assert (run_hashes(points, starts, ends) == whole).all()


def test_index():
    index = HashIndex()
    hashes = np.random.default_rng(2).integers(1, 2**64, 5000, dtype=np.uint64)
    hashes[1::2] = hashes[::2] + np.uint64(1)  # share a slot of the front
    assert (index.get(hashes) == -1).all()
    index.add(hashes[:2000]), index.add(hashes[2000:])
    assert (index.get(hashes) == np.arange(5000)).all() and index.get(np.array([7], np.uint64))[0] == -1


def test_slices_and_planes():
    texts = pa.array(["ab", None, "", "x" * 50, "é🙂"])
    assert [(b, len(t)) for b, t in slices(texts, 10)] == [(0, 3), (3, 1), (4, 1)]
    assert list(slices(texts.slice(0, 0))) == []
    plane = Plane.of(texts)
    assert plane.bounds.tolist() == [0, 2, 2, 2, 52, 54] and len(plane) == 54
    assert np.flatnonzero(plane.first()).tolist() == [0, 2, 52] and np.flatnonzero(plane.last()).tolist() == [1, 51, 53]
    assert len(Plane([])) == 0 and Plane([]).first().tolist() == []
