"""The divergence audit against all pairs of groups and terms, and the quadtree against the dense matrix."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, g int, value long"


def brute(rows, least=3, top=200):
    docs = [(d[2] or "", d[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in d[1] or ""))) for d in rows]
    within, total, count = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        within[lang].update(set(terms))
        total[lang].update(terms)
        count[lang, source].update(terms)
    out = []
    for lang, source in count:
        kept = [t for t in total[lang] if within[lang][t] >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        far = lambda p, q: (p - q) ** 2 // q
        own = share(count[lang, source])
        pairs = [(s, sum(far(own[t], q[t]) for t in kept)) for l, s in count if l == lang and s != source for q in [share(count[l, s])]]
        whole = share(total[lang])
        terms = [(t, far(own[t], whole[t])) for t in kept if count[lang, source][t] and own[t] > whole[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            order = sorted(found, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(order, 1) if part == "pair" or k <= top]
    return sorted(out)


def documents(seed, sources):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß日") for _ in range(r.randint(1, 4))) for _ in range(300)]
    out = []
    for i in range(160):
        text = r.choice([" ", ", ", "1", "\n"]).join(r.choice([str.upper, str])(w) if w.isascii() else w for w in (r.choice(vocabulary[: r.choice([5, 60, 300])]) for _ in range(r.randint(0, 60))))
        lang = r.choice(["en", "en", "en", "de", None, ""])
        out.append((i, r.choice([text] * 9 + [None]), lang, r.choice([f"s{k}" for k in range(sources)] + [None, ""]), "x", 1, 2))
    out += [(500, "only one document 77", "xx", "a", "x", 1, 2), (501, None, "xx", "b", "x", 1, 2), (None, "word " * 9000, "en", "s1", "x", 1, 2), (None, "word", "en", "s2", "x", 1, 2)]
    return out + out[:5]


@pytest.mark.parametrize("sources, rows, block, top", [(5, 32, 512, 200), (12, 4, 16, 7), (3, 1, 64, 200)])
def test_divergence(spark, monkeypatch, sources, rows, block, top):
    for name, value in (("ROWS", rows), ("BLOCK", block), ("TOP", top)):
        monkeypatch.setattr(divergence, name, value)
    docs = documents(sources, sources)
    out = divergence.divergence(spark.createDataFrame(docs, SCHEMA).repartition(4))
    assert [f"{c} {t}" for c, t in out.dtypes] == ["lang string", "source string", "part string", "item string", "value bigint", "rank int"]
    assert sorted(tuple(x) for x in out.collect()) == brute(docs, top=top)


def test_nothing_to_compare(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    one = divergence.divergence(spark.createDataFrame([(1, None, None, None, "x", 1, 2)], SCHEMA))
    assert one.count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_tree_against_dense(seed):
    r = np.random.default_rng(seed)
    rows, columns = int(r.integers(1, 40)), int(r.integers(1, 90))
    dense = r.integers(1, 10**9, (rows, columns)) * (r.random((rows, columns)) < [0, 0.03, 0.3, 1, 0.1, 0.1][seed])
    if seed == 4:
        dense[:, : columns // 2] = 0
    empty = r.integers(1, 10**6, rows)
    at = np.nonzero(dense)
    full = np.where(dense > 0, dense, empty[:, None])
    want = np.array([[((p - q) ** 2 // q).sum() for q in full] for p in full])
    one, other = r.random(rows) < 0.7, r.random(rows) < 0.7
    got = divergence.pair_sums(*at, dense[at], empty, columns, one, other)
    assert (got == want)[np.ix_(one, other)].all()


def test_shares_are_exact_at_any_count(spark):
    rows = [(10**12 + 7, 3 * 10**15, 10**9), (0, 0, 1), (5 * 10**9, 5 * 10**9, 1)]
    got = spark.createDataFrame(rows, "n long, size long, kinds long").select(divergence._share("n", "size").alias("p")).collect()
    assert [x.p for x in got] == [1 + 10**9 * (n + 1) // (size + kinds) for n, size, kinds in rows]


def test_each_pair_of_rows_is_walked_once():
    r = np.random.default_rng(3)
    rows, columns = 9, 40
    row, column = np.nonzero(r.random((rows, columns)) < 0.6)
    *_, (a, b, x, y) = divergence.Tree(row, column, 6).joint(rows, columns, np.ones(rows, bool), np.ones(rows, bool))
    assert (a < b).all() and ((x >= 0) | (y >= 0)).all()
    filled = np.zeros((rows, columns), bool)
    filled[row, column] = True
    assert len(a) == sum((filled[i] | filled[j]).sum() for i in range(rows) for j in range(i + 1, rows))


def test_terms_end_with_their_text():
    import pyarrow as pa

    texts = ["skipped", "", "Ab", "cD ", " ", "", "eÉß\x00日\x7f日 1a`b", "x" * 9, "x", "\x80q[Q"]
    for kind in (pa.string(), pa.large_string()):
        words, counts = divergence._tokens(pa.array(texts, kind).slice(1, 8))
        want = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t)) for t in texts[1:9]]
        assert words.to_pylist() == [w for x in want for w in x] and counts.tolist() == [len(x) for x in want]
    assert [len(x) for x in divergence._tokens(pa.array(["", ""], pa.string()))] == [0, 2]


def test_terms_are_shuffled_once(spark):
    """Sums over all groups of a term's language need no shuffle after that of the counts."""
    docs = spark.createDataFrame([("en", 0, "a b a"), ("en", 1, "a c"), ("de", 0, "a")], "lang string, g long, text string")
    counts = divergence.term_counts(docs)
    total = counts.selectExpr("*", "xxhash64(term) as h").selectExpr("*", "sum(n) over (partition by h, lang, term) as total")
    rows = {(x.lang, x.term, x.g, x.n, x.docs, x.total) for x in total.collect()}
    assert rows == {("en", "a", 0, 2, 1, 3), ("en", "a", 1, 1, 1, 3), ("en", "b", 0, 1, 1, 1), ("en", "c", 1, 1, 1, 1), ("de", "a", 0, 1, 1, 1)}
    plan = total._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange hashpartitioning", plan.split("== Initial Plan ==")[-1])) == 1


def test_pieces_and_batches_cut_anywhere(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 300)
    monkeypatch.setattr(divergence, "ROWS", 4)
    docs = documents(8, 14)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # terms go on in the next batch
    try:
        got = divergence.divergence(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(tuple(x) for x in got) == brute(docs)


def test_shares_of_a_tile_are_exact_at_any_count():
    rows = [(10**12 + 7, 3 * 10**15 + 10**9), (0, 1), (5 * 10**9, 5 * 10**9 + 1), (9223372035, 9223372037), (9223372036, 9223372037)]
    for some in (rows, rows[1:2] + rows[3:4], rows[1:2]):
        n, of = (np.array(c, np.int64) for c in zip(*some, strict=True))
        assert divergence._shares(n, of).tolist() == [1 + 10**9 * (a + 1) // b for a, b in some]
