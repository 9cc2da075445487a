import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliospark.llm import components, exact, simhash

DOC = "doc_id long, text string"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=3):
    prints = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= radius:
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    first = {}
    for (doc_id, _), g in zip(rows, group, strict=True):
        if doc_id is not None:
            first[g] = min(doc_id, first.get(g, doc_id))
    return [(doc_id, p, first.get(g)) for (doc_id, _), p, g in zip(rows, prints, group, strict=True)]


def near_copies(n, seed=0):
    random.seed(seed)
    words = [f"w{i}" for i in range(200)]
    base = [random.choice(words) for _ in range(400)]
    out = []
    for i in range(n):
        own = list(base) if i % 3 else [random.choice(words) for _ in range(60)]
        for _ in range(i % 5):
            own[random.randrange(len(own))] = random.choice(words)
        out.append((i + 10, " ".join(own)))
    return out


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_near_duplicates_match_brute_force(spark):
    rows = near_copies(90) + [(1, None), (2, ""), (3, " \n"), (4, "Two words"), (5, "two WORDS"), (None, "two words"), (7, "ÄÖ x y"), (7, "ÄÖ x y")]
    df = spark.createDataFrame(rows, DOC).select("doc_id", "text", F.lit("z").alias("fp"), F.lit(1).alias("component_id"))
    got = [(r.doc_id, r.fp & simhash.FULL, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert key(got) == key(brute_components(rows))
    hexed = simhash.near_duplicates(df.where("doc_id = 1")).select(simhash.as_hex("fp").alias("h")).first().h
    assert hexed == "0" * 16


def test_hot_patterns_are_refined(spark):
    """A capacity of 8 sends nearly all patterns through every level; the links stay the same."""
    random.seed(5)
    prints = {0xABCD << 48 | random.getrandbits(6) << 20 | random.getrandbits(5) for _ in range(300)} | {random.getrandbits(64) for _ in range(200)}
    df = spark.createDataFrame([(0, simhash._signed(p)) for p in prints], "space int, fp long")
    for capacity in (8, 50_000):
        stars = {r.a & simhash.FULL: r.b for r in components.stars(simhash.link(df, 3, capacity).select("a", "b")).collect()}
        group = {p: i for i, p in enumerate(sorted(prints))}
        for a, b in itertools.combinations(sorted(prints), 2):
            if bin(a ^ b).count("1") <= 3 and group[a] != group[b]:
                x, y = group[a], group[b]
                group = {p: min(x, y) if g in (x, y) else g for p, g in group.items()}
        roots = {}
        for p, g in group.items():
            roots.setdefault(g, set()).add(stars.get(p, simhash._signed(p)))
        assert all(len(r) == 1 for r in roots.values()) and len({next(iter(r)) for r in roots.values()}) == len(roots)


def test_gray_index_finds_all_pairs():
    random.seed(2)
    prints = np.array(sorted({random.getrandbits(20) for _ in range(500)}), dtype=np.uint64)
    index = simhash.GrayIndex(prints)
    got = {(int(index.prints[a]), int(index.prints[b])) for x, y in index.links(3) for a, b in zip(x, y, strict=True)}
    want = {(int(a), int(b)) for a, b in itertools.combinations(prints, 2) if bin(int(a) ^ int(b)).count("1") <= 3}
    assert {tuple(sorted(p)) for p in got} == want
    ranks = simhash.gray_rank(np.arange(16, dtype=np.uint64) ^ (np.arange(16, dtype=np.uint64) >> np.uint64(1)))
    assert ranks.tolist() == list(range(16))


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(100, 100 + i) for i in range(1, 30)]
    got = {r.a: r.b for r in components.stars(spark.createDataFrame(chain + hub + [(7, 7)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}
    assert components.stars(spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard(a, b):
    def sets(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_resembling_pairs_are_exact_and_span_their_groups(spark):
    rows = near_copies(120, 4) + [(1, ""), (2, None), (None, "x y z")]
    got = [(r.a, r.b) for r in simhash.resembling(spark.createDataFrame(rows, DOC)).collect()]
    text = dict(rows)
    assert all(a > b and jaccard(text[a], text[b]) >= 0.8 for a, b in got)
    near = {(a, b) for a in text for b in text if a is not None and b is not None and a > b and jaccard(text[a], text[b]) >= 0.8}
    root = {i: i for i in text}
    for a, b in got:
        root = {i: min(root[a], root[b]) if r in (root[a], root[b]) else r for i, r in root.items()}
    assert sum(root[a] == root[b] for a, b in near) >= 0.97 * len(near) > 100 and len(got) < 20 * len(rows)


def test_variants_of_one_text_are_found_beside_failed_links(spark):
    """300 variants resemble the original, but not each other; a forest of the links runs mostly between variants."""
    random.seed(11)
    base = [f"w{random.randrange(500)}" for _ in range(400)]
    rows = [(500, " ".join(base))]
    for i in range(300):
        own = list(base)
        for at in random.sample(range(3, 397), 8):
            own[at] = f"x{random.randrange(5000)}"
        rows.append((i, " ".join(own)))
    text, ids = dict(rows), [i for i, _ in rows]
    prints = np.array([simhash._majority(t.encode().split(), 2, 42, 19) for _, t in rows], dtype=np.uint64)
    links = {(a, b) for (x, a), (y, b) in itertools.combinations(enumerate(ids), 2) if (np.bitwise_count(prints[x] ^ prints[y]) <= 3).any()}
    true = {(a, b) for a, b in links if jaccard(text[a], text[b]) >= 0.8}
    root = {i: i for i in text}
    got = [(r.a, r.b) for r in simhash.resembling(spark.createDataFrame(rows, DOC)).collect()]
    assert all(a > b and jaccard(text[a], text[b]) >= 0.8 for a, b in got)
    for a, b in got:
        root = {i: min(root[a], root[b]) if r in (root[a], root[b]) else r for i, r in root.items()}
    assert len(true) > 200 and len(links) > 5 * len(true) and all(root[a] == root[b] for a, b in true)


def test_a_large_group_at_the_edge_is_put_together(spark):
    """One template with a few edits each, so that about one pair in a hundred is similar enough: recall against all pairs."""
    random.seed(21)
    base = [f"w{random.randrange(400)}" for _ in range(200)]
    rows = []
    for i in range(400):
        own = list(base)
        for at in random.sample(range(200), random.randint(3, 5)):
            own[at] = f"x{random.randrange(9000)}"
        rows.append((i, " ".join(own)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    true = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = [(r.a, r.b) for r in simhash.resembling(spark.createDataFrame(rows, DOC)).collect()]
    root = list(range(len(rows)))
    for a, b in got:
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert len(true) > 100 and sum(root[a] == root[b] for a, b in true) >= 0.97 * len(true) and all(jaccard(rows[a][1], rows[b][1]) >= 0.8 for a, b in got)


def test_near_dedup_takes_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, long), (4, long + " end"), (5, "alone here"), (5, "alone here"), (None, long), (None, None)]
    df = spark.createDataFrame(rows, DOC).withColumn("salt", F.lit("clash")).withColumn("key", F.lit(1))
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "5", "None", "None"]


def test_drop_near_duplicates_keeps_one_of_each(spark):
    rows = near_copies(60)
    df = spark.createDataFrame(rows, DOC).withColumn("row", F.lit(3)).withColumn("key", F.lit("k"))
    got = simhash.drop_near_duplicates(df, similarity=None)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({c for _, _, c in brute_components(rows)})
    more = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    text = dict(rows)
    assert more < {r.doc_id for r in got.collect()} and all(i in more or any(jaccard(text[i], text[k]) > 0.6 for k in more) for i in text)


@pytest.mark.parametrize("capacity", [1, 1000])
def test_exact_duplicates(spark, capacity):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, "a b "), (2, None), (4, ""), (6, "x" * 100_000), (8, "x" * 100_000), (None, "a b"), (7, "only"), (7, "twice"), (11, "twice"), (7, "twice"), (None, "null id")]
    df = spark.createDataFrame(rows, DOC).withColumn("h", F.lit(1)).withColumn("norm", F.lit(2))
    got = exact.exact_duplicates(df, capacity=capacity, max_depth=4).collect()
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    assert len(got) == len(rows) and len(by) == 7
    for group in by.values():
        ids = [r.doc_id for r in group if r.doc_id is not None]
        assert sum(r.kept for r in group) == 1 and {r.group_size for r in group} == {len(group)} and {r.keep_id for r in group} == {min(ids) if ids else None}
    kept = exact.drop_exact_duplicates(df, capacity=capacity, max_depth=4)
    assert kept.columns == df.columns and sorted((r.doc_id is not None, r.doc_id) for r in kept.collect()) == sorted((r.doc_id is not None, r.doc_id) for r in got if r.kept)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOC)
    assert exact.exact_duplicates(empty).count() == 0 and exact.drop_exact_duplicates(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_directory_doubles():
    depth, entries = exact.directory({0: 100, 1: 1, 15: 5}, 10, 4)
    assert depth == 4 and len(entries) == 16 and entries[0] != entries[1] and entries[15] == entries[8] and len(set(entries)) == 5
    assert exact.directory({3: 2}, 10, 4) == (0, [0])


def test_colliding_keys_chain():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 1, 2]), pa.array([b"x", b"y", b"x", b"x"]), pa.array([5, 6, 3, 9]), pa.array([1, 1, 2, 1])], names=["h", "norm", "first_id", "n"])
    got = [r for b in exact._chain([batch.slice(0, 2), batch.slice(2)]) for r in b.to_pylist()]
    assert [(r["h"], r["keep_id"], r["group_size"]) for r in got] == [(1, 3, 3), (1, 6, 1), (2, 9, 1)]
