"""Ball k-means, the prefix trie and SimHash against brute force, on small tables with every edge case."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from loam.llm import ball_kmeans, prefix_trie, simhash

DOCS = "doc_id long, text string, f long, fingerprint string, root string, part int, bucket long"


def docs_of(spark, rows):
    """Documents with further columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, t, 1, "x", "r", 2, 3) for i, t in rows], DOCS).repartition(3)


# --- SimHash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, radius=3):
    """The smallest member of each one's component."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def near_corpus(seed=3):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéßXY") for _ in range(r.randint(1, 6))) for _ in range(500)]
    rows = [(10, None), (11, ""), (12, " \t\n"), (13, "One"), (14, "oNE"), (15, "one two"), (16, " ".join(r.choice(words) for _ in range(70_000)))]
    base = " ".join(r.choice(words) for _ in range(400)).split(" ")
    for i in range(17, 90):
        if i % 3:
            w = list(base)
            for _ in range(i % 4):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((i, "  ".join(w)))
        else:
            rows.append((i, " ".join(r.choice(words) for _ in range(r.randint(1, 60)))))
    rows += [(40, rows[5][1]), (None, rows[20][1]), (None, "alone in the world without an id"), (17, rows[7][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_simhash(spark, hot):
    rows = near_corpus()
    prints = [brute_print(t) for _, t in rows]
    groups = defaultdict(list)
    for (i, _), g in zip(rows, brute_groups(prints)):
        groups[g].append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    want = sorted([(i, f"{f:016x}", least[g]) for (i, _), f, g in zip(rows, prints, brute_groups(prints))], key=str)
    got = sorted([tuple(x) for x in simhash.classes(docs_of(spark, rows), hot=hot).collect()], key=str)
    assert got == want and len({g for g in least}) > 10 and max(map(len, groups.values())) > 10


@pytest.mark.parametrize("hot", [simhash.HOT, 20])
def test_simhash_dense_groups(spark, hot, monkeypatch):
    """Near copies whose fingerprints fill a small part of the space, and links of every distance between groups."""
    monkeypatch.setattr(simhash, "CELL", 64)
    r = random.Random(8)
    prints = set()
    for _ in range(4):
        centre, loose = r.getrandbits(64), r.sample(range(64), 9)
        for _ in range(150):
            prints.add(centre ^ sum(1 << b for b in loose if r.random() < 0.4))
        for _ in range(40):  # some three to six bits off
            prints.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(3, 6))))
    prints = sorted(prints | {r.getrandbits(64) for _ in range(100)})
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    found = simhash.links(spark.createDataFrame([(x, 0) for x in signed], "f long, least long"), hot=hot)
    at = {x: i for i, x in enumerate(signed)}
    pairs = [(at[x["a"]], at[x["b"]]) for x in found.collect()]
    forest = simhash.Forest(len(prints))
    forest.link(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert forest.root.tolist() == brute_groups(prints)


def test_simhash_thresholds():
    """The thresholds keep to the principle's sum, and a frequent value is avoided."""
    r = np.random.default_rng(1)
    values = r.integers(0, 1 << 16, (4, 300))
    values[2] = 77
    none = (np.zeros(0, np.int64), np.zeros(0))
    t = simhash.allocate(values, [16] * 4, [10.0] * 4, [none, none, (np.array([77]), np.array([1e6])), none])
    assert (t.sum(0) == 3 - 4 + 1).all() and (t[2] == -1).all() and t.max() <= 3
    assert [simhash.partition_count(n) for n in (1_000, 100_000, 10**6, 10**9)] == [4, 4, 3, 2]
    assert [len(simhash.masks(16, t)) for t in range(4)] == [simhash.variants(16, t) for t in range(4)] == [1, 17, 137, 697]


def test_simhash_empty_and_dedup(spark):
    assert simhash.classes(docs_of(spark, [])).collect() == []
    kept = simhash.dedup(docs_of(spark, [(3, "A b C d"), (1, "a b c d"), (2, "quite another text"), (None, "a b c d")]))
    assert sorted((r["doc_id"] or 0, r["bucket"]) for r in kept.collect()) == [(0, 3), (1, 3), (2, 3)]


# --- ball k-means


def brute_kmeans(rows, k, rounds):
    rows = sorted(rows, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for i, v in rows if i is not None][:k]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, o)), j) for j, o in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in rows]
        for j in range(len(c)):
            own = [v for (_, v), a in zip(rows, at) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    got = [(i, *near(v)) for i, v in rows]
    inertia = defaultdict(int)
    for _, d, j in got:
        inertia[j] += d
    return sorted([(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in got], key=str)


def vector_rows(n, seed, spread=1.0):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(9)]
    rows = [(i, [c + r.gauss(0, 0.2) * spread for c in r.choice(centres)]) for i in range(n)]
    return rows + [(n + i, rows[0][1]) for i in range(n // 3)] + [(5, rows[1][1]), (None, rows[2][1])]


@pytest.mark.parametrize(("n", "k", "spread"), [(150, 16, 1.0), (90, 16, 0.02), (4, 16, 1.0)])
def test_ball_kmeans(spark, n, k, spread):
    rows = vector_rows(n, n, spread)
    bad = [(9001, None), (9002, [1.0] * 63), (9003, [1.0] * 63 + [None]), (9004, [float("nan")] + [1.0] * 63), (9005, [float("inf")] * 64), (9006, []), (9007, [1e30] * 64)]
    df = spark.createDataFrame([(i, v, 7, "c", 1) for i, v in rows + bad], "vec_id long, embedding array<double>, cluster int, v string, distance int").repartition(5)
    ints = [(i, [int(np.floor(x * 64)) for x in v]) for i, v in rows]
    got = sorted([tuple(r) for r in ball_kmeans.cluster(ball_kmeans.integer_vectors(df), k).collect()], key=str)
    assert got == brute_kmeans(ints, k, 3)


def test_ball_kmeans_ties(spark):
    """Points at equal distances from several centroids, equal centroids, and clusters that stay empty."""
    r = random.Random(2)
    rows = [(i, [r.choice([0, 2]), r.choice([0, 2])]) for i in range(40)]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, v array<int>").repartition(4)
    for k in (3, 8):
        got = sorted([tuple(x) for x in ball_kmeans.cluster(df, k, 3, 2).collect()], key=str)
        assert got == brute_kmeans(rows, k, 3)
    assert ball_kmeans.cluster(df.limit(0), 3, 3, 2).collect() == []


def test_balls_spare_distances():
    """Tight clusters keep their cores, and no comparison that could matter is spared."""
    r = np.random.default_rng(5)
    centres = r.integers(-400, 400, (16, 64))
    x = centres[r.integers(0, 16, 3000)] + r.integers(-20, 20, (3000, 64))
    every = ((x[:, None] - centres[None]) ** 2).sum(2)
    at = every.argmin(1)
    balls = ball_kmeans.Balls(centres.tolist(), [int(np.sqrt(every[at == j, j].max(initial=0))) + 1 for j in range(16)])
    cluster, distance, taken = balls.assign(x, at)
    assert (cluster == at).all() and (distance == every.min(1)).all() and taken < 1.2 * len(x)
    cluster, distance, taken = ball_kmeans.Balls(centres.tolist(), [None] * 16).assign(x, np.zeros(len(x), np.int64))
    assert (cluster == at).all() and (distance == every.min(1)).all()


# --- the prefix trie


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    nodes = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p, members in nodes.items():
        if p:
            kids[p[:-1]] += 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * words(p[-1][1]) if p else 0
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def conversation_rows(seed, n=130):
    """Conversations that share first turns, copies, single turns, null turns, roles and texts, and a long one."""
    r = random.Random(seed)
    says = ["hello", "hello there", "A b  c", "", None, "ünïcode\tword", "x" * 3000, "again and again"]
    rows = []
    for c in [*range(-25, 0), *range(n)]:
        if c % 20 == 7:
            continue
        for turn in range(r.choice([1, 2, 2, 3, 4, 6, 9])):
            rows.append((c, turn, r.choice(["user", "user", None]) if turn % 2 else "user", r.choice(says[: 2 + turn])))
    rows += [(40, t, "user", "long %d" % (t % 5)) for t in range(3, 300)] + [(60, t, "user", "long %d" % (t % 5)) for t in range(3, 290)]
    rows += [(c, None, "user", "no turn") for c in (3, 3, 8, 60)] + [(None, 1, "user", "no id")] + [(501, 1, "user", "twice")] * 3
    rows = [x for x in rows if x[0] != 100]  # a base that is absent
    r.shuffle(rows)
    return rows


TURNS = "conv_id long, turn long, role string, text string, owner long, depth int, length string, id string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*x, 1, 2, "l", "i") for x in rows], TURNS).repartition(3)


@pytest.mark.parametrize(("seed", "hot", "block"), [(1, prefix_trie.HOT_SHARE, prefix_trie.BLOCK), (2, 10, 16)])
def test_prefix_trie(spark, monkeypatch, seed, hot, block):
    monkeypatch.setattr(prefix_trie, "HOT_SHARE", hot)
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "BROADCAST_ROWS", 10 if hot == 10 else 200_000)
    rows = conversation_rows(seed)
    got = sorted(tuple(r) for r in prefix_trie.trie(turns_of(spark, rows)).collect())
    assert got == brute_trie(rows)


def test_prefix_trie_one_long_conversation(spark):
    """One conversation has most of the rows and spans all tasks; another is its copy up to a point."""
    rows = [(20, t, "user", "w " * (t % 4)) for t in range(4000)] + [(c, t, "user", "w " * (t % 4)) for c in (25, 26, 27, 28) for t in range(40)]
    got = sorted(tuple(r) for r in prefix_trie.trie(turns_of(spark, rows)).collect())
    want = brute_trie(rows[:900] + rows[4000:])  # the brute force is quadratic: a shorter one, and the rest is a line
    assert len(got) == len(want) + 3100
    places = prefix_trie.positions(prefix_trie.turn_rows(turns_of(spark, rows))).where("conv_id = 20")
    assert sorted(r["pos"] for r in places.collect()) == list(range(1, 4001)) and places.select("p0", "p1").distinct().count() == 4000


def test_prefix_trie_empty_and_many_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    assert prefix_trie.trie(turns_of(spark, [])).collect() == []
    assert prefix_trie.trie(turns_of(spark, [(None, 1, "user", "x")])).collect() == []
    rows = [(c, 0, "user", "same") for c in range(200)]
    got = sorted(tuple(r) for r in prefix_trie.trie(turns_of(spark, rows)).collect())
    assert got == brute_trie(rows)
