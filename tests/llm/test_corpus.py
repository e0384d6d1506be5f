"""Corpus operators: edge rows, brute-force comparisons, round trips, held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm import chat, decontaminate, exact, mixing, paragraphs, personal_data, quality, repeats, simhash, suffixes, toxicity

CLASHES = ("row", "id", "body", "kept", "words", "spans", "at", "print", "label", "n", "found", "text", "group", "name", "place")
OBSERVATION = T.StructType([T.StructField("observation_id", T.LongType()), T.StructField("store_slug", T.StringType()),
                            T.StructField("description", T.StringType())] + [T.StructField(c, T.StringType()) for c in CLASHES])
LABELS = "observation_id long, toxic int, quality int"
FOLDER = "/root/testdata/sf0.001"


def observations(spark, rows):
    return spark.createDataFrame([(i, s, t) + ("x",) * len(CLASHES) for i, s, t in rows], OBSERVATION)


LONG = " ".join(f"word{i % 977}" for i in range(60_000))
EDGE = [(1, "a", "Red phone 64 GB"), (1, "a", "Red phone 64 GB"), (2, None, "Red  phone\n64GB"), (None, "b", "x"), (None, "b", "x"),
        (3, "b", None), (4, "b", ""), (5, "", " \t\n"), (6, "c", LONG), (7, "c", LONG + " end"), (8, "a", "é\U0001f600 ü")]


@pytest.fixture(scope="module")
def edge(spark):
    return observations(spark, EDGE).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return observations(spark, [])


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select(
        F.col("doc_id").alias("observation_id"), F.col("source").alias("store_slug"), F.col("text").alias("description"))


# -- exact copies

def copies(rows):
    groups = defaultdict(list)
    for place, (i, _, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, place))
    out = Counter()
    for body, members in groups.items():
        best = min(members)
        for m in members:
            out[(rows[m[3]][0], rows[best[3]][0], len(members), m == best, hashlib.sha256(body.encode()).hexdigest())] += 1
    return out


def test_exact_copies(spark, edge, nothing):
    got = Counter(map(tuple, exact.deduplicate_texts(edge).collect()))
    assert got == copies(EDGE)
    assert exact.deduplicate_texts(nothing).count() == 0
    rng = random.Random(3)
    rows = [(i, "s", "".join(rng.choice("ab ") for _ in range(rng.randint(0, 14)))) for i in range(200)]
    assert Counter(map(tuple, exact.deduplicate_texts(observations(spark, rows), block_bytes=2).collect())) == copies(rows)


def test_exact_copies_survive_digest_collisions(spark):
    rows = [(i, "s", t) for i, t in enumerate(("aa", "bb", "cc", "aa", "aabb", "bbaa"))]
    weak = lambda block, seed: F.length(block).cast("long") if seed == 0 else F.xxhash64(block, F.lit(seed))
    got = exact.deduplicate_texts(observations(spark, rows), block_bytes=2, digest=weak)
    assert Counter(map(tuple, got.collect())) == copies(rows)


# -- mixing

def apportion(votes, seats):
    quota = [0] * len(votes)
    for _ in range(seats):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * quota[i] + 1), -i))
        quota[k] += 1
    return quota


def test_sainte_lague_against_one_seat_at_a_time(spark):
    rng = random.Random(1)
    for seats in (0, 1, 7, 100):
        votes = [float(rng.choice((0, 1, 5, 5, 40, 900, rng.randint(1, 50)))) for _ in range(12)] + [0.5]
        table = spark.createDataFrame([(0, i, v, seats) for i, v in enumerate(votes)], "g int, party long, votes double, seats long")
        got = {r.party: r.quota for r in mixing.sainte_lague(table, "g", "party", "votes", "seats").collect()}
        assert [got[i] for i in range(len(votes))] == apportion(votes, seats)


def test_mix(spark, edge, nothing):
    assert mixing.mix_stores(nothing).count() == 0
    out = mixing.mix_stores(edge).collect()
    assert Counter((r.observation_id, r.store_slug, r.words) for r in out) == Counter(
        (i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t in EDGE)
    assert all(0 <= r.taken <= 3 * r.words for r in out)
    rows = mixing.mix_stores(documents(spark)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_stores(documents(spark).repartition(5)).collect()))
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        size[r.store_slug] += r.words
        taken[r.store_slug] += r.taken
        target[r.store_slug] = r.target
    names = sorted(size)
    weights = {n: (1, 2, 3)[i % 3] for i, n in enumerate(names)}
    total, open_, want = sum(size.values()), set(names), {}
    while True:
        left = total - sum(want.values())
        share = {n: left * weights[n] / sum(weights[m] for m in open_) for n in open_}
        over = [n for n in open_ if share[n] > 3 * size[n]]
        if not over:
            break
        want |= {n: 3 * size[n] for n in over}
        open_ -= set(over)
    want |= share
    assert all(abs(target[n] - want[n]) < 1e-6 and abs(taken[n] - want[n]) <= 16 for n in names)


def test_capped_shares_reshare_the_excess(spark):
    table = spark.createDataFrame([(10, 1), (10, 5), (1000, 1), (0, 3)], "size long, weight int")
    got = [r.target for r in mixing.capped_shares(table, "size", "weight", 3).collect()]
    assert got == pytest.approx([30, 30, 960, 0])


# -- SimHash

def slow_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    found = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in found) > len(found))


def roots(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def test_simhash_groups(spark, edge, nothing):
    assert simhash.near_duplicate_texts(nothing).count() == 0
    out = simhash.near_duplicate_texts(edge).collect()
    prints = [slow_simhash(t) for _, _, t in EDGE]
    assert Counter(r.fingerprint for r in out) == Counter(f"{p:016x}" for p in prints)
    group = roots(len(EDGE), [(i, j) for i in range(len(EDGE)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    assert sum(r.kept for r in out) == len(set(group))
    first = {g: min((EDGE[i][0] for i in range(len(EDGE)) if group[i] == g and EDGE[i][0] is not None), default=None) for g in group}
    assert Counter((r.observation_id, r.group) for r in out) == Counter((EDGE[i][0], first[group[i]]) for i in range(len(EDGE)))


def test_fingerprint_links_against_all_pairs(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    prints = {s ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (1 << 64) - 1 for s in seeds for _ in range(30)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {frozenset((r.a, r.b)) for r in simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "f long"), "f").collect()}
    mask = (1 << 64) - 1
    assert got == {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 2}


# -- repeated bytes

def slow_repeats(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        yield len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()


def test_suffix_array_and_prefixes():
    rng = random.Random(5)
    for turn in range(300):
        s = np.array([rng.randrange(rng.choice((1, 2, 3, 200))) for _ in range(rng.randint(1, 60))])
        sa = suffixes.suffix_array(s, 256 if turn % 2 else 2000)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        lcp = suffixes.permuted_lcp(s, sa)
        for before, at in zip(sa, sa[1:]):
            n = 0
            while max(before, at) + n < len(s) and s[before + n] == s[at + n]:
                n += 1
            assert lcp[at] == n


@pytest.mark.parametrize("crowd", [4096, 2])
def test_repeated_bytes(spark, crowd):
    rng = random.Random(2)
    base = "".join(rng.choice("abcé") for _ in range(300))
    texts = [None, "", base, base[50:200] + "x" + base[100:260], "a" * 500, base, "q" + base[:120]]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(0, 200))) for _ in range(40)]
    out = repeats.remove_repeats(observations(spark, [(i, "s", t) for i, t in enumerate(texts)]), length=20, gram=6, crowd=crowd)
    got = {r.observation_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == list(slow_repeats([(t or "").encode() for t in texts], 20))


def test_repeated_bytes_edges(spark, edge, nothing):
    assert repeats.remove_repeats(nothing).count() == 0
    out = repeats.remove_repeats(edge)
    assert Counter(r.observation_id for r in out.collect()) == Counter(i for i, _, _ in EDGE)
    removed = {r.observation_id: r.n_removed for r in out.collect()}
    # word0..word976 come round again, so both long texts repeat; only the new end is not covered.
    assert removed[6] == len(LONG) and removed[1] == 0 and len(LONG) <= removed[7] < len(LONG) + 4


# -- repeated paragraphs

def test_paragraphs(spark, edge, nothing):
    assert paragraphs.repeated_paragraphs(nothing).count() == 0
    assert {r.observation_id for r in paragraphs.repeated_paragraphs(edge).collect()} >= {6, 7}
    rng = random.Random(1)
    vocabulary = [f"{chr(97 + i % 26)}{i}" for i in range(4000)]
    rows, planted = [], set()
    for n in range(60):
        passage = rng.choices(vocabulary, k=rng.randint(51, 90))
        for copy in range(2):
            own = list(passage)
            if n % 3 == 0 and copy:
                own[rng.randrange(len(own))] = "edited"
            around = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(2)]
            glue = rng.choice((" ", "\n"))
            rows.append((len(rows), "s", around[0] + glue + " ".join(own) + glue + around[1]))
            planted.add(len(rows) - 1)
    rows += [(1000 + i, "s", " ".join(rng.choices(vocabulary, k=100))) for i in range(60)]
    got = paragraphs.repeated_paragraphs(observations(spark, rows)).collect()
    caught = {r.observation_id for r in got}
    assert len(caught & planted) >= 0.97 * len(planted) and not caught - planted
    assert Counter(r.cluster for r in got if not r.removed) == Counter({r.cluster for r in got})


def test_paragraph_checks():
    assert paragraphs.bands_for(0.95, 0.8) == 2
    words = [str(i) for i in range(20)]
    assert paragraphs.similar(words, words[:9] + ["x"] + words[10:]) and paragraphs.similar(words, words[2:])
    assert not paragraphs.similar(words, words[:10] + [f"y{i}" for i in range(10)])


def test_near_copies_that_share_a_phrase_are_linked(spark):
    rng = random.Random(3)
    phrase = "all rights reserved under the open terms of this licence"
    rows = []
    for n in range(300):
        own = [f"w{rng.randrange(10**6)}" for _ in range(20)]
        for line in (own, own[:-1] + ["edited"]):
            rows.append((len(rows), "s", " ".join(line[:10]) + " " + phrase + " " + " ".join(line[10:])))
    got = defaultdict(set)
    for r in paragraphs.repeated_paragraphs(observations(spark, rows)).collect():
        got[r.cluster].add(r.observation_id)
    together = sum(any({2 * n, 2 * n + 1} <= ids for ids in got.values()) for n in range(300))
    assert together >= 297 and max(map(len, got.values())) < 600


def test_removed_word_ranges(spark):
    rng = random.Random(4)

    def words(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    long, near, short, pattern, alone = words(60), words(45), words(3), ["buy", "now"] * 30, words(34)
    lines = {0: [long, words(9)], 1: [words(9), long], 2: [near], 3: [near[:22] + ["edited"] + near[23:]],
             4: [short, words(12)], 5: [words(12), short], 6: [pattern], 7: [pattern], 8: [alone], 9: [words(20) + long + words(20)]}
    rows = [(i, "s", "\n".join(" ".join(w) for w in own)) for i, own in lines.items()]
    got = paragraphs.repeated_paragraphs(observations(spark, rows).repartition(1).sortWithinPartitions("observation_id")).collect()
    removed = defaultdict(set)
    for r in got:
        if r.removed:
            removed[r.observation_id] |= set(range(r.first_word, r.last_word + 1))
    assert removed[1] == set(range(9, 69)) and removed[3] == set(range(45)) and removed[5] == {12, 13, 14} and removed[7] == set(range(60))
    assert not {0, 2, 4, 6, 8} & set(removed) and len(removed[9]) >= 30 and removed[9] <= set(range(20, 80))
    assert 8 not in {r.observation_id for r in got}
    assert Counter(r.cluster for r in got if not r.removed) == Counter({r.cluster for r in got})


def word_digests(lines):
    names = paragraphs._Names()
    size = np.array([len(line) for line in lines])
    return np.concatenate([names.of(line) for line in lines]), np.cumsum(size) - size, np.cumsum(size)


def test_similar_paragraphs_across_parts_against_all_pairs():
    rng = random.Random(6)
    lines, group = [], []
    for g in range(25):
        vocabulary = [f"{g % 5}v{i}" for i in range(rng.choice((3, 30, 300)))]
        base = rng.choices(vocabulary, k=rng.randint(5, 70))
        for _ in range(rng.randint(2, 20)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 4))):
                i = rng.randrange(len(own))
                own[i:i + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0 if len(own) > 5 else 1, 1))
            half = len(own) // 2
            lines.append(rng.choice((own, own, own, own[half:] + own[:half], own * 2)))
            group.append(g)
    words, start, end = word_digests(lines)
    part = np.array([rng.randrange(4) + 10 * g for g in group])
    loose = part % 10 != 0
    pairs = [(i, j) for j in range(len(lines)) for i in range(j) if group[i] == group[j]]
    expected = [paragraphs.similar(lines[i], lines[j]) for i, j in pairs]
    a, b = np.array(pairs).T
    assert paragraphs.similar_stretches(words, start[a], end[a], start[b], end[b]).tolist() == expected
    x, y = paragraphs.similar_across(words, start, end, np.array(group), part, loose)
    assert set(zip(x.tolist(), y.tolist())) == {
        (i, j) for (i, j), good in zip(pairs, expected) if good and part[i] != part[j] and (loose[i] or loose[j])}


def test_paragraphs_around_one_passage_are_not_all_compared(monkeypatch):
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(60)]
    lines = [[f"w{rng.randrange(5000)}" for _ in range(25)] + passage for _ in range(1000)]
    lines += [line[:3] + ["edited"] + line[4:] for line in lines[:50]]
    words, start, end = word_digests(lines)
    checked, every = [], paragraphs.similar_stretches
    monkeypatch.setattr(paragraphs, "similar_stretches", lambda words, a, *more: checked.append(len(a)) or every(words, a, *more))
    alone = np.arange(len(lines))
    x, y = paragraphs.similar_across(words, start, end, np.zeros(len(lines), np.int64), alone, alone >= 0)
    assert {(i, 1000 + i) for i in range(50)} <= set(zip(x.tolist(), y.tolist()))
    assert sum(checked) < 0.1 * len(lines) ** 2 / 2


def test_word_edits_against_dynamic_programming():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 12))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, v in enumerate(a, 1):
            left, row[0] = row[0], i
            for j, w in enumerate(b, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (v != w))
        assert paragraphs._edits(a, b) == row[-1]


# -- benchmark passages

def test_benchmark_passages(spark, edge, nothing):
    rng = random.Random(7)
    vocabulary = [f"{chr(97 + i % 26)}{i % 300}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice((5, 9, 14, 30, 60))))) for i in range(80)] + [(80, None), (81, "too short"), (82, "")]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, row string")
    rows, edited = [], {}
    for i, t in items[:80]:
        words = t.split()
        around = [rng.choices(vocabulary, k=40) for _ in range(2)]
        rows.append((i, "s", " ".join(around[0] + [w.upper() + "," for w in words] + around[1])))
        for _ in range(len(words) // 10):
            words[rng.randrange(len(words))] = "changed"
        rows.append((100 + i, "s", " ".join(around[1] + words + around[0])))
    rows += [(1000 + i, "s", " ".join(rng.choices(vocabulary, k=300))) for i in range(40)]
    for block in (decontaminate.BLOCK_ITEMS, 30):
        hits, numbered = decontaminate.benchmark_hits(spark, benchmark, F.col("description"), "item_id", "text", block)
        assert numbered.count() == len(items)
    got = {(r.observation_id, r.item_id): r.edits for r in decontaminate.benchmark_passages(observations(spark, rows), benchmark).collect()}
    assert all(got.get((i, i)) == 0 for i in range(80))
    assert sum((100 + i, i) in got for i in range(80)) >= 0.95 * 80
    assert all(i % 100 == item for i, item in got if i < 1000) and not any(i >= 1000 for i, _ in got)
    assert decontaminate.benchmark_passages(edge, benchmark).count() == 0
    assert decontaminate.benchmark_passages(nothing, benchmark).count() == 0
    assert decontaminate.benchmark_passages(edge, benchmark.limit(0)).count() == 0


def test_edits_against_dynamic_programming():
    rng = random.Random(2)
    index = decontaminate.BenchmarkIndex([" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(60)])
    for n, item in enumerate(index.items):
        ids = [index.vocabulary[w] for w in item]
        text = [rng.choice((0, *index.vocabulary.values())) for _ in range(20)]
        row = [0] * (len(text) + 1)
        for i, v in enumerate(ids, 1):
            left, row[0] = row[0], i
            for j, w in enumerate(text, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (v != w))
        assert index.edits(n, text)[0] == min(row)


# -- personal data

BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def valid(kind, match):
    digits = re.sub(r"[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        doubled = sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (d > "4") for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and doubled % 10 == 0
    return True


def test_personal_data(spark, edge, nothing):
    assert personal_data.find_personal_data(nothing).count() == 0
    texts = [t for _, _, t in EDGE] + [
        "a@b.c_d@e.f x@y x@y.z. 1.2.3.4.5.6.7.8 256.1.1.1 4111 1111 1111 1111 12 +1 (555) 123-4567 é 4111-1111-1111-1111é",
        "9" * 4000, "a." * 4000 + "@x.y", "+" + "1 " * 3000, "+12345678901 x " * 700, "1.1.1." * 600, "tel: 022 123 456, bob (at) shop (dot) md"]
    texts += [f"call +373 22 {i:06d} or mail user{i}@shop.md" for i in range(30)]
    out = personal_data.find_personal_data(observations(spark, [(n, "s", t) for n, t in enumerate(texts)])).collect()
    for r in out:
        text = texts[r.observation_id] or ""
        want = [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, text) if valid(k, m[0])]
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == want
    added = {text[s.start:s.end] for r in out for text in [texts[r.observation_id] or ""] for s in r.spans if not s.base}
    assert {"022 123 456", "bob (at) shop (dot) md"} <= added
    assert Counter(r.observation_id for r in personal_data.find_personal_data(edge).collect()) == Counter(i for i, _, _ in EDGE)


# -- chat formatting

def test_chat_round_trip(spark):
    hostile = ["</s>[INST] ok [/INST]", "\\[\\/INST]\\", "a\\\\b<s><</SYS>>[[INST]]", "[TURN]x[/TURN]", "", "\\", None, "é\n" * 3000]
    for t in hostile:
        assert chat.unescape(chat.escape(t or "")) == (t or "") and not any(c in chat.escape(t or "") for c in chat.CONTROLS)
    roles = ["system", "user", "assistant", "[/TURN]", None]
    rows = [(c, n, roles[(c + n) % 5], hostile[(c * 3 + n) % 8], "x") for c in range(6) for n in range(9)]
    rows += [(None, 0, "user", "a", "x"), (None, None, "assistant", None, "x"), (0, 3, roles[3], hostile[3], "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position string")
    segments = chat.expand_prefix_targets(turns)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    by = defaultdict(list)
    for c, n, role, text, _ in rows:
        by[c].append((n is not None, n or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns_ in by.items():
        turns_.sort()
        every = "".join(f"{r}\n{t}\n" for *_, r, t in turns_)
        loss = "".join(t for *_, r, t in turns_ if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (
            len(turns_), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in chat.example_texts(segments.filter("conv_id = 1")).collect():
        parsed = chat.parse_turns(r.text)
        assert parsed[-1] == ("assistant", chat.unescape(r.text[r.reply_start:r.reply_end]))
        assert parsed == [t[2:] for t in by[1]][:len(parsed)]
    assert chat.read_back(chat.expand_prefix_targets(spark.createDataFrame([], turns.schema))).count() == 0


# -- classifiers

def brute_segments(s):
    """All maximal scoring segments by the recursive definition: the best segment, then left and right of it."""
    best = max(((sum(s[a:b]), -(b - a), -a) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a = -best[2]
    b = a - best[1]
    return brute_segments(s[:a]) + [(a, b)] + [(x + b, y + b) for x, y in brute_segments(s[b:])]


def test_maximal_segments():
    rng = random.Random(4)
    for _ in range(300):
        s = [rng.choice((-3, -2, -1, 1, 2, 4)) + rng.random() / 100 for _ in range(rng.randint(0, 18))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(np.array(s))] == brute_segments(s)


@pytest.mark.parametrize("score, column", [(toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")])
def test_classifiers_take_any_rows(spark, edge, nothing, score, column):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (6, 0, 1), (7, 1, 0), (8, 0, 1), (None, 1, 1), (3, None, None), (1, 0, 0)], LABELS)
    out = score(edge, labels).collect()
    assert Counter(r.observation_id for r in out) == Counter(i for i, _, _ in EDGE) and all(0 <= r.score <= 1 for r in out)
    assert score(nothing, labels).count() == 0
    assert len({r.score for r in score(edge, labels.limit(0)).collect()}) == 1


@pytest.mark.parametrize("query, column, modulus, rest, least", [
    ("op4_toxic_passages", "toxic", 3, 1, 0.93), ("op7_passage_quality", "quality", 5, 0, 0.95)])
def test_held_out_accuracy(spark, query, column, modulus, rest, least):
    from shelfspark.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in QUERIES[query](spark, folder).collect() if r.doc_id in labels]
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= least * len(held)


def test_toxicity_weighs_every_sample_word_and_passage(spark):
    # More words of toxic texts than any cap had room for, and one word that only clean texts hold.
    words = [f"{n:06d}" for n in range(110_000)]
    rows = [(i, "s", " ".join(words)) for i in range(8)] + [(100 + i, "s", " ".join(["calm"] * 3)) for i in range(40)]
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _, _ in rows], LABELS)
    model = toxicity.fit_toxicity(observations(spark, rows), labels)
    assert model.weights["calm"] < 0 and set(words) <= set(model.weights)


# -- pipeline

def test_pipeline(spark):
    import corpus_pipeline
    from shelfspark.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    first = docs.limit(1).collect()[0]
    extra = [(None, first.text, "en", None, 5), (None, None, None, "s", None), (5, "", "en", "s", 0), (5, "", "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("row", F.lit("x")).checkpoint()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        out = out.checkpoint()
        assert 0 < out.count() <= docs.count() and out.exceptAll(docs).isEmpty(), name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0, name
        docs = out
    bodies = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in docs.collect()]
    assert len(bodies) == len(set(bodies))
    mixed = corpus_pipeline.mix(spark, docs, FOLDER).collect()
    assert len(mixed) == docs.count() and all(r.taken <= 3 * r.size for r in mixed)
