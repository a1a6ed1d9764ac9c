"""Each operator against a brute-force version, on documents with nulls, copies, ties and extra columns, and on none."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanloom.llm import anchors, brown, bpe, bwt, classifier, common, components, exact_dedup, language, line_dedup, minhash, mixing, quality_rules, repeats
from spanloom.llm.queries import tokenizers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean"


def sentence(r, n):
    return " ".join(r.choice(["the", "of", "and", "house", "river", "stone", "Über", "été", "wind", "calm", "red", "sea", "night", "walks", "slow"]) + r.choice(["", "", "ing", "s", "er"]) for _ in range(n))


def rows():
    r = random.Random(3)
    texts = [sentence(r, r.randint(60, 130)) for _ in range(12)]
    texts += [texts[0], texts[0].replace("house", "mouse", 1), texts[1] + "\n" + texts[2], texts[3].replace(" ", "  \n", 3), None, "", " \t\n ", "a", "one two three", "a" * 5000, "x y " * 4000, "日本語 テキスト " * 30, "ABC " * 60 + "\n" + texts[4]]
    texts += [texts[5] + "\nA line that is long enough to be compared here\n" + sentence(r, 60), texts[6] + "\nA line that is long enough to be compared there", "\n".join(["same line of some words"] * 20)]
    out = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None, "c"][i % 4], len(t or ""), 7, True) for i, t in enumerate(texts)]
    return out + [out[3], out[16], (None, texts[7], "en", "a", 1, 1, None)]  # repeated rows, and one without an id


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def got(df):
    return sorted(df.collect(), key=lambda x: (x.doc_id is None, x.doc_id or 0))


def test_exact_dedup(docs, none):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for d in rows():
        groups[norm(d[1])].append(d[0])
    out = got(exact_dedup.exact_dedup(docs))
    assert len(out) == len(rows())
    text = {}
    for d in rows():
        text.setdefault(hashlib.sha256(norm(d[1]).encode()).hexdigest(), norm(d[1]))
    for x in out:
        ids = groups[text[x.text_sha256]]
        keep = min((i for i in ids if i is not None), default=None)
        assert (x.keep_id, x.group_size, x.kept) == (keep, len(ids), x.doc_id == keep)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_fuse_filter():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 5000):
        keys = r.integers(0, 2**60, n).astype(np.uint64)
        blob = exact_dedup.build_fuse(keys)
        assert exact_dedup.in_fuse(blob, keys).all()
        assert exact_dedup.in_fuse(blob, r.integers(0, 2**60, 20_000).astype(np.uint64)).mean() < 0.02


def test_screen_keeps_members(spark):
    old = spark.createDataFrame([(bytes([i]), i * 7919, 0) for i in range(50)], "digest binary, key long, shard int")
    new = spark.createDataFrame([(bytes([i]), i * 7919, 0) for i in range(40, 60)], "digest binary, key long, shard int")
    assert {x.key for x in exact_dedup.screen(new, old).collect()} >= {i * 7919 for i in range(40, 50)}


def test_quality_rules(docs, none):
    out = quality_rules.quality_rules(docs)
    by = {(d[0], d[1]): d[1] for d in rows()}
    assert out.count() == len(rows())
    for x in out.collect():
        t = next(t for (i, t) in by if i == x.doc_id) or ""
        w = words(t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(again)), t[:50]
        assert x.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (x.kept and x.base_failed)
        five = Counter()
        covered = set()
        for i in range(len(w) - 4):
            g = tuple(w[i : i + 5])
            if five[g]:
                covered |= set(range(i, i + 5))
            five[g] += 1
        assert x.dup_5gram_chars == sum(len(w[i]) for i in covered)
    assert quality_rules.quality_rules(none).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == out.where("kept").count()


def test_bpe(docs, none):
    import tiktoken

    public = tokenizers()
    ranks = bpe.read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for d in rows():
        ids = enc.encode_ordinary(d[1] or "")
        want[(d[0], len(ids), sha(",".join(map(str, ids)).encode()), sha((d[1] or "").encode()))] += 1
    out = bpe.bpe_codec(docs, ranks, public.PATTERN, keep=True).collect()
    assert Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in out) == want
    assert all(len(x.token_ids) == x.n_tokens for x in out)
    assert bpe.bpe_codec(none, ranks, public.PATTERN).count() == 0


def test_merges_in_rank_order():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259, b"aaa": 300}
    merges = bpe.Merges(ranks)
    tokens, counts = merges.encode([b"abc", b"bca", b"aaaaa", b"a", b"abab"])
    assert tokens.tolist() == [258, 257, 97, 259, 300, 97, 256, 256] and counts.tolist() == [1, 2, 2, 1, 2]


def shingles(t, n):
    w = words(low(t))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components_of(sets, links):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_components_of_long_paths(spark):
    r = random.Random(5)
    ids = list(range(1, 3001))
    r.shuffle(ids)
    links = list(zip(ids, ids[1:])) + [(5000 + i, 5001 + i) for i in range(300)] + [(9000, 9000), (9001, 9002), (9002, 9001)]
    got = {x.node: x.comp for x in components.components(spark.createDataFrame(links, "a long, b long"), common.Scratch(spark, "test")).collect()}
    want = {i: 1 for i in ids} | {i: 5000 for i in range(5000, 5301)} | {9000: 9000, 9001: 9001, 9002: 9001}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long"), common.Scratch(spark, "test")).count() == 0


def test_near_duplicates(spark, docs, none):
    r = random.Random(8)
    base = sentence(r, 150).split()
    family = [(1000 + k, " ".join(base[:p] + ["w%d" % k] + base[p + 1 :]), None, None, 0, 0, None) for k, p in enumerate([r.randrange(150) for _ in range(25)])]
    mine = rows() + family
    sets = {d[0]: shingles(d[1], 4) for d in mine if d[0] is not None}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components_of(sets, links)
    assert len(links) > 100
    out = minhash.near_duplicates(spark.createDataFrame(mine, SCHEMA), 4, 80).collect()
    assert len(out) == len(mine)
    for x in out:
        if x.doc_id is None:
            assert x.component_id == 7 and not x.kept  # the same text as document 7
        else:
            assert (x.n_shingles, x.component_id, x.kept) == (len(sets[x.doc_id]), want[x.doc_id], want[x.doc_id] == x.doc_id)
    assert minhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("first, linked", [(3, (6, 7)), (0, (1, 2))])
def test_link_that_no_pivot_meets(spark, first, linked):
    """Six documents with one sketch, so every list holds the same members; the only link lies between two that are no pivots in
    the first rounds (by their ids), and later pivots bring no pair that is new."""
    base = [f"word{i}" for i in range(400)]
    h, _ = minhash.shingle_sets([" ".join(base)], 5)
    at = iter(range(10, 395, 5))

    def edit(words):
        for p in at:
            for k in range(2000):
                new = words[:p] + [f"new{p}x{k}"] + words[p + 1 :]
                if (minhash.shingle_sets([" ".join(new)], 5)[0][: minhash.K] == h[: minhash.K]).all():
                    return new
                if k == 0 and not (np.isin(h[: minhash.K], minhash.shingle_sets([" ".join(new)], 5)[0])).all():
                    break  # a shingle of the sketch stands here
        raise AssertionError("no place left")

    texts = {}
    for i in range(first, first + 6):
        words_now = base
        for _ in range(4 if i in linked else 8):
            words_now = edit(words_now)
        texts[i] = " ".join(words_now)
    sets = {i: shingles(t, 5) for i, t in texts.items()}
    assert [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])] == [linked]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(docs).collect()}
    assert got == {i: linked[0] if i in linked else i for i in texts}


@pytest.mark.parametrize("percent", [80, 60])
def test_large_group_of_near_copies(spark, percent):
    """Lists of hundreds of members, of which some are linked, some just not, some to one other only; an id with two texts."""
    r = random.Random(21)
    base = [r.choice("abcdefghij") + str(r.randrange(500)) for _ in range(160)]
    texts = []
    for k in range(260):
        words_now = list(base)
        for _ in range(r.choice([1, 1, 2, 3, 5, 6, 7, 9])):
            words_now[r.randrange(160)] = f"n{r.randrange(10**6)}"
        texts.append((k, " ".join(words_now)))
    texts += [(500 + k, " ".join(base[:110] + [f"o{k}x{j}" for j in range(r.randint(5, 60))])) for k in range(40)]
    texts += [(900, texts[3][1]), (901, "alone on its own here"), (901, texts[200][1] + " and more"), (902, None)]
    sets = defaultdict(list)
    for i, t in texts:
        sets[i].append(shingles(t, 4))
    ids = sorted(sets)
    near = lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if any(near(x, y) for x in sets[a] for y in sets[b])]
    want = components_of(sets, links)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = minhash.near_duplicates(docs, 4, percent).collect()
    assert len(got) == len(texts) and 1 < len(set(want.values())) < len(want)
    wrong = [(x.doc_id, x.component_id, want[x.doc_id]) for x in got if x.component_id != want[x.doc_id]]
    assert not wrong
    left = {x.doc_id for x in minhash.keep_first(docs, 4, percent).collect()}
    assert left == {i for i in ids if want[i] == i}


def test_names_that_clash(spark):
    names = ["_id", "_doc", "_gone", "_copy", "_copies", "stays", "doc", "gone", "row", "times", "of", "name", "rep", "comp", "n", "x"]
    lines = "one line that stands in many documents of this test"
    mine = [(i, f"{lines}\nline number {i * 977} of its own kind {i} stands here", "s", *range(9, 9 + len(names))) for i in range(4)] + [(9, "a b c d e f g " * 9, None, *range(9, 9 + len(names)))]
    docs = spark.createDataFrame(mine, "doc_id long, text string, source string, " + ", ".join(f"{c} long" for c in names))
    for out in (minhash.keep_first(docs), line_dedup.drop_lines(docs), mixing.mixed_documents(docs), quality_rules.keep_good(docs)):
        assert out.columns == docs.columns
        assert all(tuple(x)[3:] == tuple(range(9, 9 + len(names))) for x in out.collect())
    docs = docs.withColumns({"s1": docs["n"], "n_chars": docs["n"], "lang": docs["source"]})
    for out in (minhash.near_duplicates(docs), line_dedup.line_dedup(docs), mixing.mix(docs), exact_dedup.exact_dedup(docs), repeats.remove_repeats(docs), quality_rules.quality_rules(docs)):
        assert out.count() == len(mine)


def test_line_dedup(spark, docs, none):
    text = {}
    for d in rows():
        text[d[0]] = d[1]
    order = sorted(text, key=lambda i: (i is None, i or 0))
    lines = {i: [(n, x) for n, x in enumerate((text[i] or "").split("\n")) if words(x)] for i in order}
    first = {}
    for i in order:
        for n, x in lines[i]:
            first.setdefault(x, (i is None, i or 0, n))
    kinds = list(first)

    def near(a, b):
        if abs(len(a) - len(b)) > 2:
            return False
        row = list(range(len(b) + 1))
        for i, ca in enumerate(a, 1):
            prev, row = row, [i]
            for j, cb in enumerate(b, 1):
                row.append(min(row[-1] + 1, prev[j] + 1, prev[j - 1] + (ca != cb)))
        return row[-1] <= 2

    index = {x: k for k, x in enumerate(kinds)}
    links = [(index[a], index[b]) for k, a in enumerate(kinds) for b in kinds[k + 1 :] if min(len(a), len(b)) >= line_dedup.SHORTEST and near(a, b)]
    assert links
    comp = components_of(range(len(kinds)), links)
    degree = Counter(x for p in links for x in p)
    head = defaultdict(list)
    for x in kinds:
        head[comp[index[x]]].append(first[x])
    want = {}
    for i in order:
        mine = [(index[x], (i is None, i or 0, n), first[x]) for n, x in lines[i]]
        copies = sum(at != f for _, at, f in mine)
        heads = [min(head[comp[k]]) for k, _, _ in mine]
        lost = sum(at == f and at != h for (_, at, f), h in zip(mine, heads, strict=True))
        want[i] = (len(mine), copies, lost, sum(degree[k] for k, _, _ in mine), min((h[1] for h in heads), default=i))
    # rows that repeat an id are one document, whose lines stand in each row
    many = Counter(d[0] for d in rows())
    for x in got(line_dedup.line_dedup(docs)):
        if many[x.doc_id] == 1:
            assert (x.n_lines, x.n_copies, x.n_near, x.n_links, x.class_id) == want[x.doc_id], x
    assert line_dedup.line_dedup(none).count() == 0
    left = line_dedup.drop_lines(docs)
    assert left.columns == docs.columns and left.where("text is null").count() >= 1


#: Rows without an id, ids with several texts, and rows that repeat both; lines and long passages stand in several of them.
def unnamed():
    r = random.Random(21)
    lines = [sentence(r, 14) for _ in range(9)]
    long = [" ".join(sentence(r, 30).split()) for _ in range(4)]
    texts = ["\n".join(x) for x in (lines[:3], [lines[3], lines[1]], [lines[0], lines[4]], [lines[5], lines[1] + "x", lines[6]], [lines[6], lines[7]], [lines[8]])]
    texts += [long[0] + " " + long[1], long[1] + " " + long[2], long[2] + " " + long[3]]
    ids = [None, None, 4, 4, 7, None, None, 9, 9]
    out = [(i, t, "en", f"s{k}", k, 1, True) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return out + [out[1], out[2], (None, None, "en", "a", 0, 1, True), (4, "", "en", "a", 0, 1, True)]


def in_order(mine):
    """Distinct pairs of id and text in the order of ids, those without last, then by the texts' hashes."""
    return sorted({(d[0], d[1]) for d in mine}, key=lambda x: (x[0] is None, x[0] or 0, "" if x[1] is None else hashlib.sha256(x[1].encode()).hexdigest()))


def test_rows_without_ids_keep_their_lines(spark):
    mine, seen, want = unnamed(), [], {}
    close = lambda a, b: a == b or sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b)) <= 1
    for key in in_order(mine):
        left = []
        for line in (key[1] or "").split("\n"):
            if not words(line) or not any(close(line, x) for x in seen):
                left.append(line)
            if words(line):
                seen.append(line)
        want[key] = "\n".join(left) if key[1] else key[1]
    rows_in = spark.createDataFrame(mine, SCHEMA).repartition(4)
    out = line_dedup.drop_lines(rows_in).collect()
    expected = [(d[0], want[d[0], d[1]], d[3]) for d in mine if not d[1] or want[d[0], d[1]]]
    key = lambda x: (x[0] is None, x[0] or 0, x[2], x[1] or "")
    assert sorted(((x.doc_id, x.text, x.source) for x in out), key=key) == sorted(expected, key=key)
    assert line_dedup.line_dedup(rows_in).count() == len(mine)


def test_rows_without_ids_keep_their_bytes(spark):
    mine, seen, want = unnamed(), set(), {}
    for key in in_order(mine):
        raw = (key[1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        want[key] = bytes(np.frombuffer(raw, np.uint8)[~gone])
    out = repeats.remove_repeats(spark.createDataFrame(mine, SCHEMA).repartition(4)).collect()
    expected = sorted((d[0] or -1, want[d[0], d[1]]) for d in mine)
    assert sorted((x.doc_id or -1, x.kept) for x in out) == expected
    assert any(len(want[d[0], d[1]]) < len((d[1] or "").encode()) for d in mine)


def test_keep_first_compares_rows_without_ids(spark):
    r = random.Random(31)
    a, b, c = (sentence(r, 90) for _ in range(3))
    texts = [(None, a), (None, b), (5, a + " more"), (5, c), (None, c + " more"), (None, None), (None, b), (6, b.replace(b.split()[40], "else", 1))]
    mine = [(i, t, "en", f"s{k}", 0, 0, None) for k, (i, t) in enumerate(texts)]
    stay = minhash.keep_first(spark.createDataFrame(mine, SCHEMA))
    assert stay.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert sorted(x.source for x in stay.collect()) == ["s2", "s3", "s5", "s7"]


def test_calls_leave_each_other_alone(spark, docs):
    from concurrent.futures import ThreadPoolExecutor

    links = [(i, i + 1) for i in range(60) if i % 7]
    pending = minhash.near_duplicates(docs, 4, 80)
    run = lambda _: {x.node: x.comp for x in components.components(spark.createDataFrame(links, "a long, b long"), common.Scratch(spark, "test")).collect()}
    with ThreadPoolExecutor(3) as pool:
        a, b, c = pool.map(run, range(3))
    assert a == b == c == {k: v for k, v in components_of(range(61), links).items() if k in a}
    mixing.mixed_documents(minhash.keep_first(docs)).count()
    assert pending.count() == len(rows())


def test_edit_distance(spark):
    from pyspark.sql import functions as F

    r = random.Random(5)
    pairs = []
    while len(pairs) < 800:
        a = [r.choice("abcé") for _ in range(r.randint(3, 40))]
        b = list(a)
        for _ in range(r.randint(0, 4)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randint(0, 1)] = r.choice(["", "x", "b"])
        if len(b) >= 3 and abs(len(a) - len(b)) <= 2:
            pairs.append(("".join(a), "".join(b)))
    d = spark.createDataFrame(pairs, "a string, b string").select(F.levenshtein("a", "b").alias("d"), line_dedup.edit_distance(line_dedup._characters(F.col("a")), line_dedup._characters(F.col("b")), 2).alias("e"))
    assert all((x.d <= 2) == (x.e <= 2) and (x.d > 2 or x.d == x.e) for x in d.collect())


@pytest.mark.parametrize("heavy", [None, 1])
def test_repeats(docs, none, heavy):
    text = {}
    for d in rows():
        text[d[0]] = d[1]
    seen, want = set(), {}
    for i in sorted(text, key=lambda i: (i is None, i or 0)):
        raw = (text[i] or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    out = repeats.remove_repeats(docs, heavy).collect()
    assert len(out) == len(rows())
    for x in out:
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == want[x.doc_id], (x.doc_id, (text[x.doc_id] or "")[:40])
    assert repeats.remove_repeats(none).count() == 0


def test_merged_transforms():
    r = random.Random(2)
    bodies = [bytes(r.choice(b"ab") for _ in range(r.randint(100, 160))) for _ in range(30)]
    bodies += [b[5:115] for b in bodies[:10]]
    shards = [bwt.Shard(bodies[:13]), bwt.Shard(bodies[13:30]), bwt.Shard(bodies[30:])]
    source, interval = bwt.merge(shards)
    texts = [b"".join(b + bwt.CLOSE for b in part) for part in (bodies[:13], bodies[13:30], bodies[30:])]
    at = [0, 0, 0]
    groups = defaultdict(list)
    for s, k in zip(source.tolist(), interval.tolist(), strict=True):
        place = int(shards[s].suffixes[at[s]])
        at[s] += 1
        window = texts[s][place : place + 100]
        if len(window) == 100 and b"\xff" not in window:
            groups[k].append(window)
    assert all(len(set(g)) == 1 for g in groups.values())
    assert len({g[0] for g in groups.values()}) == len(groups)
    assert any(len(g) > 1 for g in groups.values())


def test_runs_cover_all_windows():
    texts = [b"x" * 99, b"abcdefghij" * 30, bytes(range(32, 127)) * 3, b""]
    found = anchors.runs(texts)
    for i, t in enumerate(texts):
        mine = [(s, c) for k, s, c in zip(found["text"], found["start"], found["count"], strict=True) if k == i]
        assert [p for s, c in mine for p in range(s, s + c)] == list(range(max(0, len(t) - 99)))


def test_language(docs, none, spark):
    from pyspark.sql import functions as F

    held = common.crc_mod("doc_id", 3) == 1
    out = language.language_id(docs, held).collect()
    assert len(out) == len(rows())
    for x in out:
        assert 0 <= x.score <= 1 and x.lang_pred in ("en", "fr", "und")
    assert {x.lang_pred for x in out if x.doc_id in (16, 17, 18)} == {"und"}
    assert language.language_id(none, held).count() == 0
    nothing = language.language_id(docs.withColumn("lang", F.lit(None).cast("string")), held)
    assert {x.lang_pred for x in nothing.collect()} == {"und"}


def test_parse_is_exact():
    """Phrases of whole texts, over many blocks; the second training text makes parses slow to fall in step."""
    r = random.Random(4)
    for train in ("".join(r.choice("abc") for _ in range(200)), "ab" * 300):
        model = language.Automaton(train)
        texts = ["".join(r.choice("abcd") for _ in range(n)) for n in (1, 7, 60, 300, 1500)] + ["ab" * 700, "b" + "ab" * 400 + "c"]
        bits = language.entropies(texts, [model])[:, 0]
        for text, got_bits in zip(texts, bits, strict=True):
            want, i = 0, 0
            while i < len(text):
                k = 0
                while i + k < len(text) and text[i : i + k + 1] in train:
                    k += 1
                want += 1
                i += k + 1
            assert math.isclose(got_bits, want * math.log2(len(train)) / len(text))


def test_language_decision(spark):
    """The language with the fewest phrases, of texts too long for their room in training; its score is the share of its weight."""
    r = random.Random(9)
    tongue = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(n))
    mine = [(i, tongue("abcde" if i % 2 else "fghij", 60 if i % 3 else 900), "x" if i % 2 else "y") for i in range(60)]
    held = common.crc_mod("doc_id", 3) == 1
    docs = spark.createDataFrame(mine, "doc_id long, text string, lang string")
    trained = language.train(docs.where(~held))
    assert set(trained) == {"x", "y"} and all(len(t) <= language.DOCS * (language.PIECES * (language.PIECE + 1) + 1) for t in trained.values())
    langs = sorted(trained)
    for x in language.language_id(docs, held).collect():
        text = language.letters(mine[x.doc_id][1])
        bits = [language.entropies([text], [language.Automaton(trained[k])])[0, 0] for k in langs]
        assert x.lang_pred == mine[x.doc_id][2] == langs[int(np.argmin(bits))]
        weights = [2 ** (-4 * (b - min(bits))) for b in bits]
        assert math.isclose(x.score, max(weights) / sum(weights))


def test_classifier(docs, none, spark):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(12)] + [(3, None, "x"), (999, 1, "x"), (None, 1, "x")], "doc_id long, quality int, text string")
    held = common.crc_mod("doc_id", 4) == 2
    out = classifier.quality_classifier(docs, labels, held).collect()
    assert len(out) == len(rows())
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) and x.held_out == (zlib.crc32(str("" if x.doc_id is None else x.doc_id).encode()) % 4 == 2) for x in out)
    assert classifier.quality_classifier(none, labels, held).count() == 0
    assert {x.score for x in classifier.quality_classifier(docs, labels.where("false"), held).collect()} == {0.5}


def test_classifier_learns():
    r = random.Random(6)
    good, bad = [sentence(r, 80) for _ in range(150)], [" ".join(w + "***" for w in sentence(r, 80).split()) for _ in range(50)]
    weights, bias = classifier.train(good[:100] + bad[:30], np.array([1] * 100 + [0] * 30))
    assert (classifier.score(good[100:], weights, bias) >= 0.7).all() and (classifier.score(bad[30:], weights, bias) < 0.7).all()


def test_brown(docs, none):
    held = common.crc_mod("doc_id", 7) == 2
    tok = [(d[0], zlib.crc32(str("" if d[0] is None else d[0]).encode()) % 7 == 2, [*words(low(d[1])), "\n"]) for d in rows()]
    c = Counter(w for _, h, t in tok if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = {}
    for i, h, t in tok:
        want[i] = (h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
    out = brown.score_texts(docs, held).collect()
    assert len(out) == len(rows())
    for x in out:
        w = want[x.doc_id]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == w[:4] and math.isclose(x.base_score, w[4], rel_tol=1e-9) and x.score <= 0
    assert brown.score_texts(none, held).count() == 0
    from pyspark.sql import functions as F

    assert {x.score for x in brown.score_texts(docs, F.lit(True)).collect()} == {0.0}


def test_brown_exchange_and_score(spark):
    """Score and moves against the formulas, on a small corpus."""
    r = random.Random(12)
    texts = [" ".join(r.choice(["the", "a"]) + " " + r.choice(["cat", "dog", "cow"]) + " " + r.choice(["runs", "sleeps"]) for _ in range(20)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000 + k, " ".join("".join(r.choice("qwxz") for _ in range(7)) for _ in range(60))) for k in range(5)], "doc_id long, text string")
    from pyspark.sql import functions as F

    out = {x.doc_id: x for x in brown.score_texts(docs, F.col("doc_id") >= 1000).collect()}
    prose = [out[i].score / out[i].n_tokens for i in range(40)]
    noise = [out[1000 + k].score / out[1000 + k].n_tokens for k in range(5)]
    assert max(noise) < min(prose) - 1
    # better than words alone: classes know that an article is followed by an animal
    assert sum(out[i].score for i in range(40)) > sum(out[i].base_score for i in range(40))

    # words never seen: with up to four times as many of them as in training a text isn't worse off than by the base (which gives every such
    # word the whole share of one), and gibberish is worst of all
    kinds = [a + b + c for a in ("ba", "ko", "mi", "re", "stu", "ver") for b in ("lan", "mor", "ti", "gend", "ru", "pel") for c in ("", "s", "ing", "er", "ed", "ness", "ly")]
    r.shuffle(kinds)
    parts = [kinds[k::3] for k in range(3)]  # what comes in turn
    zipf = [1 / (k + 3) for k in range(len(kinds) // 3)]
    prose = lambda share: " ".join(r.choice(kinds) + r.choice(kinds) if r.random() < share else r.choices(parts[j % 3], zipf)[0] for j in range(81))
    held = []
    for k in range(120):
        held.append((5000 + k, prose(k % 6 * 0.08)))
    held += [(9000 + k, " ".join("".join(r.choice("qwxzj#0") for _ in range(8)) for _ in range(80))) for k in range(4)]
    known = [(i, prose(0.04)) for i in range(300)]
    out = brown.score_texts(spark.createDataFrame(known + held, "doc_id long, text string"), F.col("doc_id") >= 5000).where("held_out").collect()
    bands = defaultdict(lambda: [0.0, 0.0])
    for x in out:
        if x.doc_id < 9000:
            band = bands[min(4, int((1 - x.n_known / x.n_tokens) / 0.08))]
            band[0] += x.score
            band[1] += x.base_score
    assert len(bands) == 5 and all(model >= base for k, (model, base) in bands.items() if k < 2), dict(bands)
    assert max(x.score / x.n_tokens for x in out if x.doc_id >= 9000) < min(x.score / x.n_tokens for x in out if x.doc_id < 9000)

    words = spark.createDataFrame([("ab",), ("b",)], "word string")
    chain = brown.spelling(words)
    pairs = Counter([(256, 97), (97, 98), (98, 256), (256, 98), (98, 256)])
    part = lambda y: (sum(n for (_, b), n in pairs.items() if b == y) + 1) / (5 + 257)
    p = lambda x, y: math.log10((pairs[(x, y)] + 5 * part(y)) / (sum(n for (a, _), n in pairs.items() if a == x) + 5))
    assert np.allclose(brown.spelled(["ba", "b"], chain), [p(256, 98) + p(98, 97) + p(97, 256), p(256, 98) + p(98, 256)])
    assert np.allclose((10**chain).sum(1), 1)

    classes = np.arange(6) % 3
    items = [r.randrange(6) for _ in range(400)]
    train = spark.createDataFrame([([2 * i for i in items],)], "items array<int>")
    before, end = brown.CLASSES, 0
    found = brown.contexts(train, classes, end)
    table = np.zeros((before, before))
    seq = [end, *items]
    for x, y in zip(seq, seq[1:]):
        table[classes[x], classes[y]] += 1
    assert (brown.transitions(found, classes) == table).all() and (brown.class_pairs(train, classes, end) == table).all()
    moved = brown.exchange(found, classes, table, 0)
    assert (moved[1::2] == classes[1::2]).all()  # half of the items move
    for w in (0, 2, 4):
        left, right = np.zeros(before), np.zeros(before)
        for x, y in zip(seq, seq[1:]):
            left[classes[x]] += y == w
            right[classes[y]] += x == w
        rows_, cols = table.sum(1) + 0.5 * before, table.sum(0) + 0.5 * before
        gains = []
        for c in range(before):
            if c == classes[w]:  # without its own counts
                gone_r = np.log(np.maximum(table[c] - right, 0) + 0.5) - np.log(max(rows_[c] - right.sum(), 0.5)) - np.log(cols)
                gone_l = np.log(np.maximum(table[:, c] - left, 0) + 0.5) - np.log(max(cols[c] - left.sum(), 0.5)) - np.log(rows_)
                gains.append((right * gone_r).sum() + (left * gone_l).sum())
            else:
                gains.append((right * np.log((table[c] + 0.5) / rows_[c] / cols)).sum() + (left * np.log((table[:, c] + 0.5) / rows_ / cols[c])).sum())
        assert math.isclose(gains[moved[w]], max(gains), rel_tol=1e-9)


def test_brown_rare_words(spark, monkeypatch):
    """Words too rare to be items of their own, all of one ending: each takes the class that its own neighbours ask for."""
    monkeypatch.setattr(brown, "FREQUENT", 60)
    r = random.Random(8)
    nouns, verbs = [f"k{k}oning" for k in range(150)], [f"t{k}oning" for k in range(150)]
    text = lambda *few: " ".join(f"the {r.choice([r.choice(nouns), *few[:1]])} must {r.choice([r.choice(verbs), *few[1:]])} ." for _ in range(5))
    known = [(i, text(r.choice(["dog", "cat", "cow"]), r.choice(["run", "eat", "sit"]))) for i in range(400)]
    held = [(5000 + k, text()) for k in range(20)]
    held += [(i + 1000, re.sub(r"the (\S+) must (\S+)", r"the \2 must \1", t)) for i, t in held]  # the same words, each in the other's place
    from pyspark.sql import functions as F

    out = {x.doc_id: x for x in brown.score_texts(spark.createDataFrame(known + held, "doc_id long, text string"), F.col("doc_id") >= 5000).collect()}
    assert all(math.isclose(out[5000 + k].base_score, out[6000 + k].base_score) and out[5000 + k].score > out[6000 + k].score + 3 for k in range(20))


def test_brown_places(spark):
    """Packed neighbours, and the class of each word, against the formulas: words in several chunks, seen once, often, or not at all."""
    r = random.Random(9)
    n = brown.CLASSES
    table = np.array([[float(r.randrange(50)) for _ in range(n)] for _ in range(n)])
    first, classes = 3, np.array([r.randrange(n) for _ in range(3 + brown.FORMS)])
    met, rows_ = defaultdict(list), []
    for w, sizes in {"once": [1], "never": [0, 0], "some": [2, 0, 5], "often": [400, 127, 128, 3], "ünoften": [128]}.items():
        for chunk, size in enumerate(sizes):
            pairs = [(r.randrange(n), r.randrange(n)) for _ in range(size)]
            met[w] += pairs
            codes = np.array([(b, n + a) for b, a in pairs], np.uint8).reshape(-1, 2)
            packed = brown._packed(np.zeros(size, np.int64), codes, np.array([size]))
            assert len(packed[0].as_py()) == min(2 * size, brown.WIDE)
            rows_.append((w, chunk, 7, bytearray(packed[0].as_py())))
    found = spark.createDataFrame(rows_, "word string, of long, id int, met binary")
    out = brown.placed(found, classes, table, first).collect()
    assert len(out) == len(rows_)
    by = defaultdict(list)
    for x in out:
        by[(x.c, x.new)].append(x)
    for w, pairs in met.items():
        c = len(pairs)
        own = classes[first + zlib.crc32(w[-3:].encode()) % brown.FORMS]
        left, right = (np.bincount([p[side] for p in pairs], minlength=n).astype(float) if pairs else np.zeros(n) for side in (0, 1))
        cls = brown.best(left[None], right[None], np.array([own]), table)[0] if c else own
        same = by[(c, None if c else w)]
        assert {x.item for x in same} == {first + cls + n * (c == 1)} and all(x.id == 7 for x in same)
        assert sorted(x.of for x in same if c != 128) == sorted(x[1] for x in rows_ if x[0] == w and c != 128)


def test_mixing(docs, none, spark):
    size = lambda t: len(words(t))
    by = defaultdict(int)
    for d in rows():
        by[d[3]] += size(d[1])
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(by.values()), set()
    while True:
        open_ = [s for s in order if s not in full]
        level = (budget - sum(2 * by[s] for s in full)) / max(sum(weight[s] for s in open_), 1)
        over = [s for s in open_ if level * weight[s] > 2 * by[s]]
        if not over:
            break
        full |= set(over)
    target = {s: 2 * by[s] if s in full else level * weight[s] for s in order}
    out = mixing.mix(docs).collect()
    source = {d[0]: d[3] for d in rows()}
    taken = defaultdict(int)
    assert len(out) == len(rows())
    for x in out:
        s = source[x.doc_id]
        assert x.source_size == by[s] and math.isclose(x.target, target[s]) and 0 <= x.taken <= 2 * x.size
        taken[s] += x.taken
    most = max(size(d[1]) for d in rows())
    for s in order:
        assert abs(taken[s] - target[s]) <= most
    # many documents a source, a few of them very long: the short ones make up for these
    r = random.Random(7)
    many = [(i, "w " * (r.randint(1, 60) if i % 40 else 3000), f"s{i % 4}") for i in range(1200)]
    big = mixing.mix(spark.createDataFrame(many, "doc_id long, text string, source string"))
    sums = defaultdict(int)
    for x in big.collect():
        sums[many[x.doc_id][2]] += x.taken
        sums[many[x.doc_id][2], "goal"] = x.target
    assert all(abs(sums[f"s{k}"] - sums[f"s{k}", "goal"]) <= 10 for k in range(4)), sums
    key = lambda x: (x.doc_id is None, x.doc_id or 0, x.taken)
    assert sorted(out, key=key) == sorted(mixing.mix(docs.repartition(5)).collect(), key=key)
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(11)
    mine = [(i, sentence(r, r.randint(60, 200)), "en", f"s{i % 3}", 0, 0, None) for i in range(30)]
    mine += [(100, mine[0][1], "en", "s0", 0, 0, None), (101, "junk", "en", "s1", 0, 0, None), (102, None, None, None, None, None, None)]
    spark.createDataFrame(mine, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {x.doc_id for x in out}
    assert ids and not ids & {100, 101, 102} and all(x.n_tokens == len(x.token_ids) for x in out)
    docs = spark.createDataFrame(mine, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.Scratch(spark, "test").result(stage(spark, docs, str(tmp_path)))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
