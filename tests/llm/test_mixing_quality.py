import math
import random

import pytest
from pyspark.sql import functions as F

from foliospark.llm import mixing, quality_rules, site_quality

DOC = "doc_id long, text string, source string"


def water_fill(sizes):
    """Shares handed out by weight again and again, as the contract tells it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, full, left = dict.fromkeys(order, 0.0), set(), float(sum(sizes.values()))
    while left > 1e-9:
        open_ = [s for s in order if s not in full]
        if not open_:
            break
        total, rest = sum(weight[s] for s in open_), 0.0
        for s in open_:
            target[s] += left * weight[s] / total
        for s in open_:
            if target[s] >= 3 * sizes[s]:
                rest += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                full.add(s)
        left = rest
    return target


def corpus(seed=0, n=600):
    random.seed(seed)
    pick = ["a"] * 300 + ["b"] * 20 + ["c"] * 200 + ["D"] * 60 + [None] * 20
    return [(i, " ".join(["w"] * random.randint(1, 80)), pick[i % len(pick)]) for i in range(n)]


def test_mix(spark):
    rows = corpus() + [(None, "x y", "a"), (7000, None, "b"), (7001, "  ", "b"), (7002, "q r", "zero"), (8000, "dup row", "c"), (8000, "dup row", "c")]
    df = spark.createDataFrame(rows, DOC).withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))
    got = mixing.mixed(df).collect()
    again = mixing.mixed(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water_fill(sizes)
    source = {i: s for i, _, s in rows}
    taken = {}
    for r in got:
        s = source[r.doc_id] if r.doc_id is not None else "a"
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(80, 0.02 * t)


def test_mix_rows(spark):
    df = spark.createDataFrame(corpus(1), DOC).withColumn("row", F.lit(1))
    copies = {r.doc_id: r.copies for r in mixing.mixed(df).collect()}
    out = mixing.mix(df)
    seen = {}
    for r in out.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert out.columns == df.columns and seen == {k: v for k, v in copies.items() if v}
    twice = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (2, "d", "t")], DOC)
    assert mixing.mix(twice).count() == sum(r.copies for r in mixing.mixed(twice).collect())


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], DOC)
    assert mixing.mixed(empty).count() == 0 and mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "s")], DOC)
    assert all(r.target == 0 and r.taken == 0 for r in mixing.mixed(blank).collect())


def brute_counts(text):
    words = (text or "").split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.split()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    random.seed(4)
    texts = [None, "", " \n\t ", "one", "a b c d e a b c d e", "x " * 40, "l1 ##\nl1 ##\n\nl1 ##\n |<>", "é ü 日本 🙂 a", "a b c d e f\n" * 9]
    texts += [" ".join(random.choice("abcd") + random.choice(["", "*", "&"]) for _ in range(random.randint(1, 120))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = {r.doc_id: r for r in quality_rules.judged(df).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], brute_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.kept and r.base_failed)


def prose(rng, n):
    return ". ".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(8)).capitalize() for _ in range(n)) + "."


def labelled(n=300):
    rng = random.Random(9)
    out = []
    for i in range(n):
        text = prose(rng, 6)
        if i % 6 == 0:
            text = " ".join(f"{w} ***" for w in text.split())
        elif i % 6 == 1:
            text = text.upper().replace(" ", "!! ")
        out.append((i, text, int(i % 6 > 1), f"s{i % 4}", "en" if i % 3 else None))
    return out


def test_the_label_model_finds_the_bad_ones(spark):
    rows = labelled()
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("row", F.lit(1))
    kept = {r.doc_id: r.kept for r in quality_rules.judged(df).collect()}
    good = [kept[i] for i, _, q, _, _ in rows if q]
    bad = [kept[i] for i, _, q, _, _ in rows if not q]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)
    stage = quality_rules.keep_good(df)
    assert stage.columns == df.columns and {r.doc_id for r in stage.collect()} == {i for i, k in kept.items() if k}
    empty = df.limit(0)
    assert quality_rules.judged(empty).count() == 0 and quality_rules.keep_good(empty).count() == 0


def brute_em(votes, rounds=50, tolerance=1e-4):
    """Each document by itself, no patterns: the share that is good, and how often each rule casts each vote."""
    rules = range(len(votes[0]))
    good = [(v.count("+") + 1) / (v.count("+") + 1 + 4 * v.count("-")) for v in votes]
    before = None
    for _ in range(rounds):
        prior, table = (sum(good) + 1) / (len(votes) + 2), {}
        for k in rules:
            yes = {c: sum(g for g, v in zip(good, votes, strict=True) if v[k] == c) + 1 for c in "+-"}
            no = {c: sum(1 - g for g, v in zip(good, votes, strict=True) if v[k] == c) + 1 for c in "+-"}
            table |= {(k, c): (yes[c] / (yes["+"] + yes["-"]), no[c] / (no["+"] + no["-"])) for c in "+-"}
        now = [prior, *(p for k in rules for c in "+-" for p in table[k, c])]
        posterior = []
        for v in votes:
            a, b = prior, 1 - prior
            for k in rules:
                if v[k] in "+-":
                    a, b = a * table[k, v[k]][0], b * table[k, v[k]][1]
            posterior.append(a / (a + b))
        if before and max(abs(x - y) for x, y in zip(before, now, strict=True)) < tolerance:
            return posterior
        before, good = now, posterior
    return posterior


def test_em_matches_a_plain_version(spark):
    rows = labelled()
    df = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, "few words")], "doc_id long, text string")
    votes = {r.keep_0: r.votes for r in quality_rules.with_votes(quality_rules.features(df, df["text"], [df["doc_id"]])).select("keep_0", "votes").collect()}
    want = dict(zip(votes, brute_em(list(votes.values())), strict=True))
    got = {r.doc_id: r.p_good for r in quality_rules.judged(df).collect()}
    assert got == pytest.approx(want, abs=1e-9) and 0.2 < sum(p < 0.5 for p in want.values()) / len(want) < 0.5


def test_the_stage_takes_odd_rows(spark):
    text = prose(random.Random(1), 6)
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, ""), (4, text + " " + prose(random.Random(2), 3000))], "doc_id long, text string").withColumn("votes", F.lit("clash")).withColumn("n_words", F.lit(5))
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "4", "None"]


def test_repeats_in_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(40_000)) + " " + " ".join(f"w{i}" for i in range(100))
    r = quality_rules.judged(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert r.n_words == 40_100 and r.n_repeat_words == 200


def test_site_quality(spark):
    rows = labelled(600)
    docs = spark.createDataFrame([(i, t, s, lang) for i, t, _, s, lang in rows] + [(None, None, None, None), (1000, "", "new", "xx"), (3, "twice", "s1", "en")], "doc_id long, text string, source string, lang string").withColumn("host", F.lit(1))
    labels = spark.createDataFrame([(i, q) for i, _, q, _, _ in rows if i % 5] + [(None, 1), (7, None), (8, 0)], "doc_id long, quality int")
    got = site_quality.judged(docs, labels)
    held = {r.doc_id: r for r in got.collect() if r.doc_id is not None and r.doc_id < 600 and r.doc_id != 3}
    right = [held[i].kept == bool(q) for i, _, q, _, _ in rows if i % 5 == 0 and i in held]
    assert got.count() == len(rows) + 3 and sum(right) >= 0.98 * len(right)
    assert all(0 <= r.p_quality <= 1 and 0 <= r.p_host <= 1 and 0 <= r.p_path <= 1 for r in held.values())
    assert site_quality.judged(docs.limit(0), labels).count() == 0
    assert {r.p_document for r in site_quality.judged(docs, labels.limit(0)).collect()} == {0.5}


def test_site_shares_match_a_plain_version(spark):
    """From each document's own evidence: strengths by moments, shares of hosts and paths without the document, and odds."""
    rows = labelled(300)
    docs = spark.createDataFrame([(i, t, s, lang) for i, t, _, s, lang in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, q) for i, _, q, _, _ in rows if i % 3], "doc_id long, quality int")
    got = site_quality.judged(docs, labels).collect()

    def gather(key):
        out = {}
        for r in got:
            out.setdefault(key(r), []).append(r.p_document)
        return out

    def strength(groups):
        n, g = sum(map(len, groups)), len(groups)
        means = [sum(x) / len(x) for x in groups]
        within = max(sum((p - m) ** 2 for x, m in zip(groups, means, strict=True) for p in x), 1e-9) / (n - g)
        mean = sum(map(sum, groups)) / n
        between = (sum(len(x) * (m - mean) ** 2 for x, m in zip(groups, means, strict=True)) - (g - 1) * within) / (n - sum(len(x) ** 2 for x in groups) / n)
        return min(max(within / max(between, 1e-12), 1.0), 1e6)

    hosts, paths = gather(lambda r: r.host), gather(lambda r: (r.host, r.path))
    k_host, k_path = strength(list(hosts.values())), strength(list(paths.values()))
    mean = sum(r.p_document for r in got) / len(got)
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for r in got:
        h, p = hosts[r.host], paths[r.host, r.path]
        p_host = (sum(h) - r.p_document + k_host * mean) / (len(h) - 1 + k_host)
        p_path = (sum(p) - r.p_document + k_path * p_host) / (len(p) - 1 + k_path)
        odds = logit(r.p_document) + logit(p_path) - logit(mean)
        assert (r.p_host, r.p_path, r.p_quality) == pytest.approx((p_host, p_path, 1 / (1 + math.exp(-odds))), rel=1e-4, abs=1e-6) and r.kept == (r.p_quality >= 0.5)


def test_samples_of_labels_take_a_row_of_an_id(spark):
    rows = labelled(300)
    docs = spark.createDataFrame([(i, t, s, lang) for i, t, _, s, lang in rows for _ in range(1 + 3 * (i == 5))], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, q) for i, _, q, _, _ in rows], "doc_id long, quality int")
    got = site_quality.judged(docs, labels, sample_rows=100).collect()
    assert len(got) == 303 and sum(r.kept == bool(rows[r.doc_id][2]) for r in got) >= 0.95 * len(got)


def test_sparse_sites_shrink_toward_all(spark):
    frame = spark.createDataFrame([(h, 1.0 * n, s, q) for h, n, s, q in (("a", 500, 450.0, 420.0), ("b", 400, 80.0, 40.0), ("c", 300, 240.0, 200.0))], "h string, n double, s double, q double")
    strong = site_quality._strength(frame)
    alike = spark.createDataFrame([(100.0, 50.0, 30.0), (100.0, 50.0, 30.0)], "n double, s double, q double")
    assert 1 <= strong < 20 and site_quality._strength(alike) == 1e6
