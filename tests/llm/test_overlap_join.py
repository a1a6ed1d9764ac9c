"""The T-occurrence join against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest

from spanloom.llm import overlap_join

from .test_operators import SCHEMA, components_of, none, rows, sentence, shingles  # noqa: F401


def brute(texts, size, percent):
    sets = defaultdict(list)
    for i, t in texts:
        sets[i].append(shingles(t, size))
    ids = sorted(sets)
    near = lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if any(near(x, y) for x in sets[a] for y in sets[b])]
    return components_of(sets, links)


def family(seed):
    """Copies that have drifted apart, a long passage in many of them, chains, short texts, and an id with two texts."""
    r = random.Random(seed)
    base = [r.choice("abcdefghij") + str(r.randrange(500)) for _ in range(160)]
    texts = []
    for k in range(240):
        words = list(base)
        for _ in range(r.choice([1, 1, 2, 2, 3, 4, 5, 7])):
            words[r.randrange(160)] = f"n{r.randrange(10**6)}"
        texts.append((k, " ".join(words)))
    texts += [(300 + k, " ".join(base[:110] + [f"o{k}x{j}" for j in range(r.randint(2, 60))])) for k in range(60)]
    chain = [f"c{j}" for j in range(80)]
    for k in range(30):  # each is near the one before and few others
        chain = [*chain[1:], f"d{k}"]
        texts.append((400 + (7 * k) % 30, " ".join(chain)))
    texts += [(500 + k, " ".join(f"e{k // 3}w{j}" for j in range(3 + k // 3 + (k % 3 == 2)))) for k in range(45)]
    return texts + [(900, texts[3][1]), (901, "alone on its own here"), (901, texts[200][1] + " and more"), (902, None), (903, " \t"), (904, "Two Words"), (905, "two\nwords"), (906, "x y " * 3000)]


@pytest.mark.parametrize("seed, blocks, size, percent", [(1, 512, 4, 85), (2, 16, 4, 85), (3, 5, 4, 70), (4, 16, 5, 80), (5, 16, 1, 60)])
def test_overlap_join(spark, monkeypatch, seed, blocks, size, percent):
    monkeypatch.setattr(overlap_join, "BLOCK_DOCS", blocks)
    texts = family(seed)
    want = brute(texts, size, percent)
    assert 1 < len(set(want.values())) < len(want)
    out = overlap_join.overlap_join(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), size, percent)
    assert out.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    got = out.collect()
    assert len(got) == len(texts)
    assert [x for x in got if x.component_id != want[x.doc_id]] == []
    assert sorted(x.n_shingles for x in got) == sorted(len(shingles(t, size)) for _, t in texts)


def test_edge_rows(spark, none):  # noqa: F811
    mine = rows()
    want = brute([(d[0], d[1]) for d in mine if d[0] is not None], 4, 85)
    got = overlap_join.overlap_join(spark.createDataFrame(mine, SCHEMA), 4, 85).collect()
    assert len(got) == len(mine)
    assert all(x.component_id == (7 if x.doc_id is None else want[x.doc_id]) for x in got)  # the row without an id has the text of document 7
    assert overlap_join.overlap_join(none).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_search_in_a_block(seed):
    r = np.random.default_rng(seed)
    base, percent = np.arange(60), [60, 75, 85, 95][seed % 4]
    values = [np.unique(np.concatenate([base[r.random(60) < r.choice([0.5, 0.95, 0.99])], r.integers(100, 400, r.integers(0, 8))])) for _ in range(70)]
    query = np.zeros(70, bool) if seed < 4 else r.random(70) < 0.4
    label = np.arange(70)
    label[5:9] = 5
    near = lambda i, j: 100 * len(np.intersect1d(values[i], values[j])) >= percent * len(np.union1d(values[i], values[j]))
    known = [(5, k) for k in range(6, 9)]
    want = components_of(range(70), known + [(i, j) for i in range(70) for j in range(i) if (seed < 4 or query[i] != query[j]) and near(i, j)])
    links = overlap_join.overlap_links(values, query, label, percent)
    assert all(near(i, j) for i, j in links)
    assert components_of(range(70), known + links) == want and len(links) <= 66


def test_drop_is_what_both_can_spare():
    for percent in (50, 60, 80, 85, 99, 100):
        n = np.arange(1, 3000)
        spare = overlap_join.extra(n, percent)
        assert (np.diff(spare) >= 0).all()
        assert (n - overlap_join.least(n, percent) + 1 + spare <= n).all()
