"""The prefix trie against sequences spelled out."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from spanloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, f string"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole = tuple(convs.get(base, [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1]) if node else 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    key = lambda x: tuple((v is None, v or 0) for v in x[:3]) + x[3:]
    return sorted(((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), children[n], leaves[n], saved[n], digest(ends[n])) for n, who in members.items()), key=key), key


def conversations(seed):
    r = random.Random(seed)
    out = []
    for c in [*range(0, 40), *range(100, 190, 3), *range(305, 330), -7, -150, -100, 100_000]:
        if c in (0, 100, -100, 3, 9) or r.random() < 0.9:
            for t in range(r.choice([0, 1, 2, 3, 5, 6, 8, 12])):
                text = r.choice(["hello", "", None, "a longer answer of some words", "été 日本 𝕏", "x" * 3000]) if r.random() < 0.7 else "hi"
                out.append((c, r.choice([t, t, t, None, 3]), r.choice(["user", "assistant", None]) if r.random() < 0.3 else "user", text, 1, "f"))
    out += [(900 + k, t, "user", f"copy {t}", 1, "f") for k in range(60) for t in range(7)]  # copies whose base has the same turns
    out += [(2000, t, "user", f"turn {t % 5}", 1, "f") for t in range(700)]  # long ones, with a base and without
    out += [(2050, t, "user", f"turn {t % 5}", 1, "f") for t in range(650)]
    out += [(None, 1, "user", "nobody", 1, "f")]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_prefix_trie(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", [4096, 7, 64][seed - 1])
    monkeypatch.setattr(prefix_trie, "PIECE", [4096, 3, 10][seed - 1])
    rows = conversations(seed)
    want, key = brute(rows)
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert [f"{c} {t}" for c, t in got.dtypes] == ["conv_id bigint", "depth bigint", "parent_conv_id bigint", "n_convs bigint", "n_children bigint", "n_leaves bigint", "saved_tokens bigint", "ends_sha256 string"]
    assert sorted((tuple(x) for x in got.collect()), key=key) == want


def test_prefix_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", 1, "f")], SCHEMA)).count() == 0


def test_keys_that_meet_are_found(spark, monkeypatch):
    """With keys of one bit, turns of different texts meet, and the seeds go on until all is right or (here) until the test stops it."""
    from pyspark.sql import functions as F

    real, seeds = F.xxhash64, []

    def narrow(*cols):
        return F.pmod(real(*cols), F.lit(1 if len(seeds) < 3 else 1 << 62))

    monkeypatch.setattr(prefix_trie.F, "xxhash64", narrow)
    exact = prefix_trie._keys_are_exact
    monkeypatch.setattr(prefix_trie, "_keys_are_exact", lambda t, seed: seeds.append(seed) or exact(t, seed))
    rows = conversations(4)
    want, key = brute(rows)
    assert sorted((tuple(x) for x in prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=key) == want
    assert seeds == [0, 2, 4]


def test_elements_compose(spark):
    from pyspark.sql import functions as F

    r = random.Random(1)
    p, b = prefix_trie.PRIME, prefix_trie.BASE
    of = lambda values: (pow(b, len(values), p), sum(v * pow(b, len(values) - 1 - i, p) for i, v in enumerate(values)) % p)
    rows = []
    for _ in range(50):
        x, y = ([r.randrange(p) for _ in range(r.randrange(6))] for _ in range(2))
        rows.append((*of(x), *of(y), *of(x + y)))
    got = spark.createDataFrame(rows, "am long, af long, bm long, bf long, cm long, cf long").select(prefix_trie.then(F.struct(F.col("am").alias("m"), F.col("af").alias("f")), F.struct(F.col("bm").alias("m"), F.col("bf").alias("f"))).alias("x"), "cm", "cf")
    assert all((x.x.m, x.x.f) == (x.cm, x.cf) for x in got.collect())
