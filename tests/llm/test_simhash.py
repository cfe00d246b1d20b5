import numpy as np
import pytest
from tables import no_docs, odd_docs

from lettermill.llm import simhash
from lettermill.llm.components import connected_components
from lettermill.llm.simhash import fingerprint, grid_cells, keep_one, near_copies, near_links, view_plan


def plain_components(fps, bits):
    roots = list(range(len(fps)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(int(fps[i]) ^ int(fps[j])).count("1") <= bits:
                a, b = find(i), find(j)
                roots[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_views_never_miss():
    rng = np.random.default_rng(2)
    for bits in range(9):
        assert sum(r + 1 for _, r in view_plan(bits)) >= bits + 1
        a = rng.integers(0, 2**64, 60, np.uint64)
        b = a.copy()
        for _ in range(bits):
            b ^= np.uint64(1) << rng.integers(0, 64, 60, np.uint64)
        cells = [{} for _ in range(2)]
        for side, fps in enumerate((a, b)):
            where = [set() for _ in fps]
            at = {int(f): k for k, f in enumerate(fps)}
            for cell, fp in grid_cells(fps, bits):
                for c, f in zip(cell.tolist(), fp.tolist()):
                    where[at[f]].add(c)
            cells[side] = where
        assert all(x & y for x, y in zip(*cells)), bits


def test_fingerprint_in_parts(monkeypatch):
    text = " ".join(f"w{k % 97}x{k % 13}" for k in range(3000)).encode()
    whole = fingerprint(text)
    monkeypatch.setattr(simhash, "_TEXT_PART", 500)
    assert fingerprint(text) == whole
    assert fingerprint(b"") == fingerprint(None) == fingerprint(b" \n") == 0
    assert fingerprint(b"ONE two") == fingerprint(b"one\ttwo ") != fingerprint("ÖNE two".encode())


@pytest.mark.parametrize("limit", [20_000, 40])
def test_components_against_all_pairs(spark, limit):
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 2**64, 12, np.uint64)
    crowd = centre[0] ^ (np.uint64(1) << rng.integers(0, 64, 150, np.uint64))
    chain = [centre[1]]
    for k in range(40):
        chain.append(chain[-1] ^ np.uint64(0b1111 << (k % 15 * 4)))
    fps = np.unique(np.r_[centre, crowd, np.array(chain, np.uint64), rng.integers(0, 2**64, 200, np.uint64)])
    table = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    links = near_links(table, cell_limit=limit)
    got = {r.node: r.root for r in connected_components(links).collect()}
    groups = {}
    for f, root in zip(fps.view(np.int64).tolist(), plain_components(fps, 4)):
        groups.setdefault(root, set()).add(f)
    for members in groups.values():
        assert {got.get(f, f) for f in members} == {min(members)}
    pairs = links.collect()
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 4 for r in pairs)


def test_stars_on_paths_and_loops(spark):
    path = [(k, k + 1) for k in range(60)] + [(100, 100), (200, 201), (201, 202), (202, 200)]
    links = spark.createDataFrame(path + path[:5], "a long, b long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {**{k: 0 for k in range(61)}, 200: 200, 201: 200, 202: 200}
    assert connected_components(links.limit(0)).count() == 0


def test_odd_tables(spark):
    docs = odd_docs(spark, ["some words that stand here twice over"] * 3)
    got = near_copies(docs)
    assert got.count() == docs.count()
    rows = {(r.doc_id, r.content): r.component_id for r in got.collect()}
    by_id = {i: c for (i, _), c in rows.items() if i != 7}
    assert by_id[2] == by_id[1] == 1 and by_id[100] == by_id[102] == 100
    assert by_id[3] == by_id[4] == by_id[5] == 3  # no words: fingerprint zero, linked like others
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    assert ids == sorted([(False, 1, "one two three four five six"), (False, 3, ""), (True, 0, "a text without an id"),
                          (False, 7, "repeated row"), (False, 7, "another text of the same id"), (False, 9, "x"),
                          (False, 8, "é ü ß Ünïcode 😀 <|endoftext|> don't"),
                          (False, 100, "some words that stand here twice over")])
    assert near_copies(no_docs(spark)).count() == keep_one(no_docs(spark)).count() == 0
