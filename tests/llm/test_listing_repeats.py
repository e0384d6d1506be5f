"""Phrases, runs of words and MinHash groups: edge rows, brute force on random and given texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm import phrases, postings, queries, runs

CLASHES = ("row", "id", "body", "group", "window", "n", "part", "words", "phrase", "name", "at", "value", "size", "runs", "text", "key", "t1")
OBSERVATION = T.StructType([T.StructField("observation_id", T.LongType()), T.StructField("store_slug", T.StringType()),
                            T.StructField("description", T.StringType())] + [T.StructField(c, T.StringType()) for c in CLASHES])
FOLDER = "/root/testdata/sf0.001"
BLANKS = "[^\x20\x09-\x0D]+"


def observations(spark, rows):
    return spark.createDataFrame([(i, s, t) + ("x",) * len(CLASHES) for i, s, t in rows], OBSERVATION)


LONG = " ".join(f"word{i % 977}" for i in range(60_000))
EDGE = [(1, "a", "Red phone 64 GB"), (1, "a", "Red phone 64 GB"), (2, None, "red  PHONE\n64\tgb"), (None, "b", "x"), (None, "b", "x"),
        (3, "b", None), (4, "b", ""), (5, "", " \t\n"), (6, "c", LONG), (7, "c", LONG + " end"), (8, "a", "é\U0001f600 ü é\U0001f600"),
        (9, "a", "a\x00b, a\x01 a a!? a;a"), (10, "a\x00", "go " * 50), (11, "a", "é")]


@pytest.fixture(scope="module")
def edge(spark):
    return observations(spark, EDGE).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return observations(spark, [])


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "source", "text").collect()]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- phrases

def slow_phrases(rows, longest=5, least=100, top=2000):
    times, total = defaultdict(Counter), Counter()
    for _, store, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            words = re.findall("[^\x20\x09]+", piece)
            total[store] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    times[store][tuple(words[i:i + k])] += 1
    out = []
    for store, f in times.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        listed = []
        for p, a in candidates.items():
            inside = any(a <= b and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                         for q, b in candidates.items() if len(q) > len(p))
            if not inside:
                score, k = min((1000 * a * total[store] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                listed.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(listed)[:top], 1):
            out.append((store, rank, phrase.decode(), -a, l, r, total[store], -score))
    return sorted(out, key=repr)


def mined(df, **more):
    return sorted(map(tuple, phrases.mine_phrases(df, **more).collect()), key=repr)


def test_phrases_of_edge_rows(spark, edge, nothing):
    assert mined(nothing) == []
    assert mined(edge, least=2) == slow_phrases(EDGE, least=2)
    assert mined(edge, least=1, top=50, longest=3) == slow_phrases(EDGE, least=1, top=50, longest=3)


def test_phrases_against_counting_all(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(("s", "t", None)), "".join(rng.choice(("a ", "b ", "c ", "aa ", "B ", ". ", "\n", "\td\x01 ")) for _ in range(rng.randint(0, 60))))
            for i in range(300)]
    for least, top in ((1, 10**6), (7, 10**6), (30, 5)):
        assert mined(observations(spark, rows), least=least, top=top) == slow_phrases(rows, least=least, top=top)
    rows = documents(spark)
    assert mined(observations(spark, rows), least=8) == slow_phrases(rows, least=8)


def test_phrases_in_many_partitions_and_parts(spark, monkeypatch):
    """Runs of one prefix cross partitions and chunks: one hot word in tiny partitions, long texts in tiny parts."""
    from pyspark import cloudpickle
    monkeypatch.setattr(phrases, "_PARTITION", 40)
    monkeypatch.setattr(phrases, "_SAMPLE_STEP", 2)
    monkeypatch.setattr(phrases, "_CHUNK", 32)
    cloudpickle.register_pickle_by_value(phrases)
    try:
        rng = random.Random(6)
        rows = [(i, "s", " ".join(rng.choice(("hot",) * 9 + ("b", "c,", "d")) for _ in range(rng.randint(0, 120)))) for i in range(60)]
        assert mined(observations(spark, rows), least=3) == slow_phrases(rows, least=3)
    finally:
        cloudpickle.unregister_pickle_by_value(phrases)


def test_scores_past_64_bits(spark):
    rng = random.Random(8)
    rows = [(a, rng.randint(a, 10**13), rng.randint(a, 10**12), rng.randint(a, 10**12)) for a in [rng.randint(100, 10**12) for _ in range(200)]]
    rows.append((10**13, 10**15, 10**13, 10**13))
    out = spark.createDataFrame(rows, "a long, n long, l long, r long").select(
        "*", phrases.cut_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(x.s == 1000 * x.a * x.n // (x.l * x.r) for x in out)


# -- runs

def slow_runs(words, least=6, exponent=4):
    found, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, exponent * q) and not any(s <= i and i + length <= s + m and q % p == 0 for s, m, p in found):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def run_row(key, text):
    words = re.findall(BLANKS, text or "")
    own = slow_runs(words)
    dropped = {i for s, n, p in own for i in range(s + p, s + n)}
    best = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if own else (None,) * 3
    return (key, len(own), *best, 1000 * best[1] // best[2] if own else None, own, " ".join(w for i, w in enumerate(words) if i not in dropped))


def got_runs(df):
    return Counter(repr((r.observation_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, [tuple(x) for x in r.runs], r.collapsed))
                   for r in runs.repeated_runs(df).collect())


def test_runs_of_edge_rows(spark, edge, nothing):
    assert runs.repeated_runs(nothing).count() == 0
    short = [r for r in EDGE if len(r[2] or "") < 1000]
    assert got_runs(edge.filter("coalesce(length(description), 0) < 1000")) == Counter(repr(run_row(i, t)) for i, _, t in short)
    long = [r for r in runs.repeated_runs(edge).collect() if r.observation_id in (6, 7)]
    for r in long:
        assert [tuple(x) for x in r.runs] == [(0, 60_000, 977)] and r.exponent_milli == 61412
        assert r.collapsed == " ".join(f"word{i}" for i in range(977)) + (" end" if r.observation_id == 7 else "")
    with pytest.raises(ValueError):
        runs.repeated_runs(edge, exponent=2)


def test_runs_against_all_periods(spark):
    rng = random.Random(9)
    rows = []
    for i in range(1200):
        words = []
        while len(words) < rng.randint(0, 60):
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 7))]
            words += unit * rng.choice((1, 1, 2, 4, 5, 9)) + unit[:rng.randint(0, 3)]
        rows.append((i, "s", " ".join(words)))
    rows += [(2000 + i, "s", " ".join(rng.choice("ab") for _ in range(rng.randint(0, 80)))) for i in range(800)]
    assert got_runs(observations(spark, rows)) == Counter(repr(run_row(i, t)) for i, _, t in rows)


def test_suffix_intervals_against_sorting():
    rng = np.random.default_rng(3)
    for grams in (1, 2, 5):
        for _ in range(60):
            sizes = rng.integers(0, 40, 4)
            codes = np.concatenate([np.r_[rng.integers(1, 3, n), 0] for n in sizes]).astype(np.int64)
            doc = np.repeat(np.arange(4), sizes + 1)
            sa, common = runs.suffix_intervals(codes, doc, grams)
            ends = np.cumsum(sizes + 1) - 1
            word = lambda p: tuple(codes[p:ends[doc[p]]])
            assert all((doc[a], word(a)) <= (doc[b], word(b)) for a, b in zip(sa[:-1], sa[1:]) if common[list(sa).index(b)])
            for a, b, c in zip(sa[:-1], sa[1:], common[1:]):
                shared = 0
                if doc[a] == doc[b]:
                    shared = next((k for k, (x, y) in enumerate(zip(word(a), word(b))) if x != y), min(len(word(a)), len(word(b))))
                assert c == (shared if shared >= grams else 0)


def test_planted_periods_and_digests(spark):
    rows = documents(spark)
    want = {}
    for key, _, text in rows:
        words = re.findall(BLANKS, text or "")
        h = zlib.crc32(str(key).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        row = run_row(key, " ".join(words))
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want[key] = row[:6] + (digest("".join(f"{s},{n},{p}\n" for s, n, p in row[6])), digest(row[7]))
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, FOLDER).collect()}
    assert got == want and any(r[1] for r in want.values())


# -- MinHash groups

def shingles(text):
    words = re.findall(BLANKS, lowered(text))
    if 0 < len(words) < 3:
        return frozenset([tuple(words)])
    return frozenset(zip(words, words[1:], words[2:]))


def slow_groups(rows, percent=85):
    sets = [shingles(t) for _, _, t in rows]
    distinct = sorted(set(s for s in sets if s), key=len)
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, x in enumerate(distinct):
        for y in distinct[i + 1:]:
            if 100 * len(x) < percent * len(y):
                break
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                root[find(x)] = find(y)
    least = {}
    for (key, _, _), s in zip(rows, sets):
        if s and key is not None:
            least[find(s)] = min(key, least.get(find(s), key))
    return Counter((key, len(s), least.get(find(s)) if s else key, (least.get(find(s)) if s else key) == key)
                   for (key, _, _), s in zip(rows, sets))


def got_groups(df, **more):
    return Counter(map(tuple, postings.near_listing_groups(df, **more).collect()))


def test_groups_of_edge_rows(spark, edge, nothing):
    assert postings.near_listing_groups(nothing).count() == 0
    assert got_groups(edge) == slow_groups(EDGE)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
    return words


def near_family(rng, first, size, words, edits):
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    return [(first + i, "s", " ".join(edited(rng, base, rng.randint(0, edits)))) for i in range(size)]


def test_groups_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [r for k in range(40) for r in near_family(rng, 100 * k, rng.randint(2, 12), rng.randint(3, 300), rng.randint(1, 12))]
    # Chains, a passage that many share, and sizes on both sides of the threshold.
    passage = [f"p{i}" for i in range(60)]
    rows += [(10_000 + i, "s", " ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(rng.randint(0, 40))])) for i in range(150)]
    chain = [f"c{i}" for i in range(200)]
    rows += [(20_000 + i, "s", " ".join(chain[4 * i:] + [f"d{j}" for j in range(4 * i)])) for i in range(30)]
    rng.shuffle(rows)
    assert got_groups(observations(spark, rows)) == slow_groups(rows)


def test_one_large_group_and_its_outsiders(spark):
    """A third of all rows near one another, and rows that share its lists without belonging to it."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, "s", " ".join(edited(rng, base, rng.randint(0, 6)))) for i in range(200)]
    rows += [(1000 + i, "s", " ".join(edited(rng, base[:100], 2) + [f"y{i}_{j}" for j in range(40)])) for i in range(80)]
    rows += near_family(rng, 5000, 60, 120, 4)
    rows += [(7000 + i, "s", " ".join(base[i:] + base[:i] + [f"z{j}" for j in range(i % 23)])) for i in range(0, 40, 3)]
    assert got_groups(observations(spark, rows), matches=12) == slow_groups(rows)


def test_groups_of_given_texts(spark):
    rows = documents(spark)
    assert got_groups(observations(spark, rows)) == slow_groups(rows)
    assert got_groups(observations(spark, rows).repartition(7)) == slow_groups(rows)


def test_signatures_agree_as_often_as_sets(spark):
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(200):
        both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (170, 15, 15))
        x, y = np.sort(np.r_[both, a]), np.sort(np.r_[both, b])
        s = postings.signatures(np.r_[x, y], np.array([len(x), len(y)]), 32)
        agree.append((s[0] == s[1]).sum())
    assert abs(np.mean(agree) / 32 - 0.85) < 0.01 and 1.4 < np.std(agree) < 2.7 and min(agree) >= postings.MATCHES
