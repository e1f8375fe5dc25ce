import hashlib

import numpy as np
import pytest

from tests.compare import differences, views
from tests.llm.conftest import ODD
from vellumspark.llm import exact_dedup, golay, queries, simhash

UPPER = {c: c + 32 for c in range(65, 91)}


def test_exact_odd_rows(make):
    got = exact_dedup.exact_dedup(make(ODD)).collect()
    assert len(got) == len(ODD)
    groups = {}
    for i, t in ODD:
        groups.setdefault(hashlib.sha256((t or "").translate(UPPER).encode()).hexdigest(), []).append(i)
    for r in got:
        own = groups[r.text_sha256]
        assert r.group_size == len(own)
        assert r.keep_id == max((x for x in own if x is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)


@pytest.mark.parametrize("heavy_min", [1, 2, 1000])
def test_exact_heavy_and_light_agree(make, heavy_min):
    rows = [(i, f"text {i % 7 if i % 2 else i}") for i in range(200)]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(make(rows), heavy_min=heavy_min).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    assert got == {(i, max(groups[t]), len(groups[t]), i == max(groups[t])) for i, t in rows}


def test_empty_tables(make):
    empty = make([])
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op8_topk", "op9_license_scan"])
def test_oracles(spark, name):
    folder = "/root/testdata/sf0.01"
    assert differences(spark, views(folder), name, queries.QUERIES[name], queries.ORACLES[name], folder) is None


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 23, 4000)
    for flips in (0, 1, 2):
        b = a.copy()
        for _ in range(flips):
            b ^= 1 << rng.integers(0, 23, len(a))
        assert all(set(x) & set(y) for x, y in zip(golay.keys(a).tolist(), golay.keys(b).tolist()))


def _components(fps):
    roots = {f: f for f in fps}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 2:
                roots[find(max(a, b))] = find(min(a, b)) if find(a) != find(b) else roots[find(max(a, b))]
    out = {}
    for f in fps:
        out.setdefault(find(f), set()).add(f)
    return {frozenset(x) for x in out.values()}


@pytest.mark.parametrize("bucket_pairs", [1, 64])
def test_links_connect_all_within_two_bits(spark, bucket_pairs):
    rng = np.random.default_rng(9)
    fps = set()
    for _ in range(12):
        base = int(rng.integers(0, 1 << 62))
        for _ in range(8):
            base ^= 1 << int(rng.integers(0, 62))
            if rng.random() < 0.5:
                base ^= 1 << int(rng.integers(0, 62))
            fps.add(base)
            fps.add(base ^ 0b111)
    from vellumspark.operators.graph import connected_components

    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = connected_components(simhash.links(df, bucket_pairs=bucket_pairs)).collect()
    got = {}
    for r in roots:
        got.setdefault(r.root, set()).add(r.node)
    assert all(k == min(v) for k, v in got.items())
    linked = {frozenset(x) for x in got.values()} | {frozenset([f]) for f in fps - {r.node for r in roots}}
    assert linked == _components(sorted(fps))


def test_fingerprint_by_definition():
    import xxhash

    text = "The CAT sat on\tthe mat\nÉ é the cat sat on the mat"
    words = text.translate(UPPER).split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("Two words") == xxhash.xxh64_intdigest("two words", 42)
    assert simhash.fingerprint(" \n ") == 0


def test_near_odd_rows(make):
    got = simhash.near_duplicates(make(ODD)).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r.fingerprint, set()).add(r.component_id)
    assert all(len(c) == 1 for c in by.values())
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    kept = simhash.keep_one_of_each_group(make(ODD))
    assert kept.columns == make([]).columns and kept.count() == len({r.component_id for r in got})


def test_documents_without_an_id_stay(make):
    kept = simhash.keep_one_of_each_group(make([(None, "one text here"), (None, "quite another text"), (4, "one text here"), (3, "one text here")]))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "one text here"), (0, "quite another text"), (3, "one text here")]


#: Nulls, empties, repeated rows, ids shared by different texts, near copies, long texts.
SHARED = [
    (1, None), (1, ""), (1, "alpha beta gamma delta"), (1, "ALPHA beta gamma delta"), (2, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (3, "other words are here"), (3, "other words are here"),
    (4, "quite " * 4000 + "long"), (5, "quite " * 4000 + "LONG"), (6, "another text of its own"), (6, "another text of its own"), (6, "a third text that stands alone"), (None, "other words are here"), (None, "nobody's words"), (None, "nobody's words"),
]


@pytest.mark.parametrize("rows", [SHARED, ODD, SHARED * 3, []])
def test_exact_stage_by_brute_force(make, rows):
    best = {}
    for i, t in rows:
        key = (t or "").translate(UPPER)
        best[key] = max(best.get(key, -1), -1 if i is None else i)
    kept = exact_dedup.keep_first_copies(make(rows)).collect()
    got = sorted(((r.text or "").translate(UPPER), -1 if r.doc_id is None else r.doc_id) for r in kept)
    assert got == sorted(best.items())


def near_stage_by_brute_force(rows):
    """Number of rows to stay, and the ids, for each component; rows without an id all stay."""
    prints = [simhash.fingerprint(t or "") for _, t in rows]
    parts = _components(sorted({f for f, (i, _) in zip(prints, rows) if i is not None}))
    best = []
    for part in parts:
        best.append(min((i, hashlib.sha256((t or "").encode()).digest()) for f, (i, t) in zip(prints, rows) if f in part and i is not None))
    return sorted(best) + [(None, hashlib.sha256((t or "").encode()).digest()) for i, t in sorted(rows, key=str) if i is None]


@pytest.mark.parametrize("rows", [SHARED, ODD, SHARED * 3, []])
def test_near_stage_by_brute_force(make, rows):
    kept = simhash.keep_one_of_each_group(make(rows)).collect()
    got = [(r.doc_id, hashlib.sha256((r.text or "").encode()).digest()) for r in kept]
    assert sorted(map(str, got)) == sorted(map(str, near_stage_by_brute_force(rows)))


def test_near_duplicates_by_brute_force(make):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(60):
        own = list(rng.choice(words, 30))
        rows.append((2 * i, " ".join(own)))
        own[int(rng.integers(0, 30))] = "changed"
        rows += [(2 * i + 1, " ".join(own))] * (1 + i % 2)
    rows += ODD
    got = simhash.near_duplicates(make(rows), bucket_pairs=4).collect()
    prints = [simhash.fingerprint(t or "") for _, t in rows]
    smallest = {}
    for part in _components(sorted(set(prints))):
        least = min((i for f, (i, _) in zip(prints, rows) if f in part and i is not None), default=None)
        smallest |= dict.fromkeys(part, least)
    want = sorted(str((i, f"{f:016x}", smallest[f])) for f, (i, _) in zip(prints, rows))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want


def test_exact_groups_past_the_heavy_list(make):
    """More frequent digests than the heavy list holds: the rest go the ordinary way, with the same result."""
    rows = [(i, f"text {i % 20}") for i in range(2000)]
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(make(rows), tracked=16, heavy_limit=4).collect()}
    assert got == {(i, 1980 + i % 20, 100) for i in range(2000)}
