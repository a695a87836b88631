"""Near copies against exact Jaccard similarity."""

import random
import tracemalloc

import numpy as np
import pytest

from tsprep.llm import common, graph, near_copies


def words_of(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(n))


def jaccard(a, b, words=5):
    x, y = (set(near_copies.shingle_set(t, words).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(rng, text, low, high):
    """text with words changed, put in and left out until the similarity lies between the two; None if it never does."""
    own = text.split()
    w = list(own)
    while True:
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([["changed"], ["changed"], [], [w[k], rng.choice(own)]])
        j = jaccard(text, " ".join(w))
        if j <= high:
            return " ".join(w) if j >= low else None


def documents(spark, texts, ids=None):
    rows = [(k if ids is None else ids[k], t, k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, place int").repartition(3)


def groups_of(pairs, ids):
    root = {k: k for k in ids}
    for a, b in pairs:
        old, new = root[a], root[b]
        root = {k: new if r == old else r for k, r in root.items()}
    return {frozenset(k for k in root if root[k] == r) for r in root.values()}


def test_lone_pairs_just_at_the_limit(spark):
    """Of pairs between 0.80 and 0.85 hardly any is missed, of pairs under 0.8 none is found."""
    rng = random.Random(2)
    base = [words_of(rng, rng.randint(80, 300)) for _ in range(220)]
    near = [edited(rng, t, 0.8, 0.85) for t in base]
    below = [edited(rng, t, 0.7, 0.795) for t in base]
    texts = [t for pair in zip(base, near, strict=True) for t in pair] + [t for pair in zip([b + " and its end " + words_of(rng, 200) for b in base], below, strict=True) for t in pair]
    comp = {r.doc_id: r.component_id for r in near_copies.similar_documents(documents(spark, texts)).collect()}
    pairs = [k for k in range(220) if near[k]]
    found = sum(comp[2 * k + 1] == 2 * k for k in pairs)
    assert len(pairs) > 150 and found >= 0.98 * len(pairs)
    for k, c in comp.items():
        if c != k:
            assert texts[k] is None or jaccard(texts[k], texts[c]) >= 0.8, (k, c)


@pytest.mark.parametrize("hot", [30, 1_000_000])
def test_groups_are_those_of_exact_similarity(spark, hot):
    """Large groups: copies of one text, chains of texts each like the next, and a star whose rays are just unlike each other."""
    rng = random.Random(7)
    texts = []
    for _ in range(2):
        t = words_of(rng, 150)
        texts += [t] + [edited(rng, t, 0.85, 0.97) or t for _ in range(60)]
        chain = words_of(rng, 150)
        for _ in range(40):
            texts.append(chain)
            chain = edited(rng, chain, 0.82, 0.9) or chain
        star = words_of(rng, 200)
        texts += [star] + [edited(rng, star, 0.81, 0.86) or star for _ in range(40)]
    texts += [words_of(rng, 100) for _ in range(60)]
    near = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    want = groups_of(near, range(len(texts)))
    comp = {r.doc_id: r.component_id for r in near_copies.similar_documents(documents(spark, texts), hot_group=hot).collect()}
    got = groups_of(comp.items(), range(len(texts)))
    # Nothing is linked that is not similar, and hardly anything is missed.
    assert all(any(g <= w for w in want) for g in got)
    assert len(got) <= len(want) + 2


@pytest.mark.parametrize("hot", [2, 7, 50, 1000])
def test_hot_keys_stay_connected(hot):
    """Chains of rows under one key, in any order and whatever the group's bound, end in the components of all pairs."""
    rng = np.random.default_rng(hot)
    rows, keys = [], []
    for key, n in ((3, 5), (4, 260), (5, 3), (6, 90)):
        row = rng.integers(0, 1 << 63, 3, np.int64).astype(np.uint64)
        for k in range(n):
            row = row.copy() if k % 40 else rng.integers(0, 1 << 63, 3, np.int64).astype(np.uint64)
            for bit in rng.choice(128, 13, replace=False):
                row[bit // 64] ^= np.uint64(1 << int(bit) % 64)
            row[2] = len(rows)
            rows.append(row)
            keys.append(key)
    rows, keys = np.array(rows), np.array(keys)
    order = np.lexsort((rng.permutation(len(keys)), keys))
    rows, keys = rows[order], keys[order]
    batches = [common.record_batch(key=keys[a : a + 10], **{n: rows[a : a + 10, k].copy().view(np.int64) for k, n in enumerate(near_copies.CARRIED)}) for a in range(0, len(keys), 10)]
    edges = [(a, b) for out in near_copies._candidates(12, 25, hot)(iter(batches)) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)]
    near = [(int(rows[a, 2]), int(rows[b, 2])) for a in range(len(rows)) for b in range(a) if keys[a] == keys[b] and np.bitwise_count(rows[a, :2] ^ rows[b, :2]).sum() <= 25]
    assert groups_of(edges, range(len(rows))) == groups_of(near, range(len(rows)))


@pytest.mark.parametrize("seed", range(6))
def test_links_of_groups_connect_what_all_pairs_connect(seed):
    """The least spanning forest and the trees of very large groups; few links for each row."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, (7, 3), np.int64).astype(np.uint64)
    rows = base[rng.integers(0, 7, 300)]
    for k, row in enumerate(rows):
        for bit in rng.choice(128, rng.integers(0, 18), replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit) % 64)
        row[2] = k
    near = [(a, b) for a in range(300) for b in range(a) if np.bitwise_count(rows[a, :2] ^ rows[b, :2]).sum() <= 22]
    for a, b in (near_copies.least_forest(rows, 9, 22), near_copies.group_links(rows, 9, 22)):
        assert {(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)} <= set(near) and len(a) <= 6 * 300 < len(near)
        assert groups_of(zip(a.tolist(), b.tolist(), strict=True), range(300)) == groups_of(near, range(300))
    nothing = near_copies.least_forest(base, 2, 3)
    assert len(nothing[0]) == 0


def test_large_groups_take_little_memory():
    """A group of MATRIX rows, in which each row links to the one before: all its distances at once, but in a byte each."""
    n = near_copies.MATRIX
    rows = np.random.default_rng(5).integers(0, 1 << 63, (n, 3), np.int64).astype(np.uint64)
    for k in range(1, n):
        rows[k, :2] = rows[k - 1, :2] ^ np.array([1 << k % 64, 1 << 7 * k % 64], np.uint64)
    tracemalloc.start()
    a, b = near_copies.least_forest(rows, 9, 22)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) == n - 1 and len(groups_of(zip(a.tolist(), b.tolist(), strict=True), range(n))) == len(groups_of([(0, k) for k in range(n)], range(n)))
    assert most < 40 << 20


def test_repeated_lines_count_once(spark):
    rng = random.Random(12)
    line, rests = words_of(rng, 9) + " ", [words_of(rng, 120) for _ in range(8)]
    texts = [line * 300 + r for r in rests] + [line * 3 + r for r in rests]
    assert jaccard(texts[0], texts[1]) < 0.3 and jaccard(texts[0], texts[8]) == 1
    comp = {r.doc_id: r.component_id for r in near_copies.similar_documents(documents(spark, texts)).collect()}
    assert comp == {k: k % 8 for k in range(16)}


def test_one_of_each(spark):
    rng = random.Random(3)
    a, b, c = (words_of(rng, 60) for _ in range(3))
    texts = [a, a, b, a, c, c, None, "", " ", "one two", "ONE  two", "x" * 200_000]
    ids = [5, 3, 3, None, None, None, 20, 21, None, 8, 9, 30]
    docs = documents(spark, texts, ids).selectExpr("doc_id", "text", "place", "place AS `row`", "place AS `a.b`", "place AS node")
    kept = near_copies.one_of_each(docs, near_copies.similar_documents(docs))
    # 3 holds two unlike texts, both of which stay; of the nulls that are like no row with an id one stays.
    assert kept.columns == docs.columns
    got = {(r.doc_id, r.text) for r in kept.collect()}
    assert got == {(3, a), (3, b), (None, c), (20, None), (8, "one two"), (30, "x" * 200_000)} and kept.count() == 6
    empty = docs.limit(0)
    assert near_copies.one_of_each(empty, near_copies.similar_documents(empty)).count() == 0


@pytest.mark.parametrize("n_words, seed", [(12, 1), (30, 2), (70, 3)])
def test_no_link_is_missed(spark, n_words, seed):
    """Components are just those of all pairs, of short texts too, whose few shingles make their fingerprints vary, and just at the limit."""
    rng = random.Random(seed)
    base = [words_of(rng, n_words) for _ in range(60)]
    texts = base + [e for t in base for _ in range(3) if (e := edited(rng, t, 0.8, 0.9))]
    group = words_of(rng, n_words)
    texts += [group] + [e for _ in range(60) if (e := edited(rng, group, 0.75, 0.9))]
    line = words_of(rng, 10)
    texts += [f"{line} {words_of(rng, 5)}" for _ in range(60)]
    near = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    assert len(near) > 20
    comp = {r.doc_id: r.component_id for r in near_copies.similar_documents(documents(spark, texts)).collect()}
    assert groups_of(comp.items(), range(len(texts))) == groups_of(near, range(len(texts)))


@pytest.mark.parametrize("some", [np.zeros(0, np.uint64), "half"])
def test_prefixes_of_similar_sets_meet(some):
    """In any order: equal at the limit, as 8 of 10, or larger; groups of either kind of comparison, and what is cut between batches."""
    rng = np.random.default_rng(4)
    sets = []
    for n in (1, 2, 4, 5, 8, 10, 40, 45, 200):
        for _ in range(40):
            own = rng.integers(0, 1 << 63, n).astype(np.uint64)
            out = rng.integers(0, n // 5 + 1)
            sets += [own, own[out:], np.concatenate([own[n // 9 :], rng.integers(0, 1 << 63, n // 9).astype(np.uint64)])]
    sets = [np.unique(s) for s in sets if len(s)]
    own = np.unique(np.concatenate(sets))
    frequent = (own[::2], rng.integers(4, 9, len(own[::2]))) if isinstance(some, str) else (some, np.zeros(0, np.int64))
    rows = sorted((int(key), node, (len(s) << 32) + k) for node, s in enumerate(sets) for k, key in enumerate(near_copies.first_shingles(s, frequent, 0.8).view(np.int64)))
    keys, nodes, places = (np.array(c) for c in zip(*rows, strict=True))
    batches = [common.record_batch(key=keys[a : a + 7], node=nodes[a : a + 7], place=places[a : a + 7]) for a in range(0, len(keys), 7)]
    shared = [b for b in near_copies._shared(0.8)(iter(batches)) if b.num_rows]
    bare = [common.record_batch(**{n: b.column(n) for n in ("key", "node", "place")}, root=b.column("node"), fp=b.column("node"), fp2=b.column("node")) for b in shared]
    got = {(a, b) for out in near_copies._cross(0.8, None)(iter(bare)) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)}
    near = {(a, b) for a in range(len(sets)) for b in range(a + 1, min(a + 4, len(sets))) if 0.8 * len(np.union1d(sets[a], sets[b])) <= len(np.intersect1d(sets[a], sets[b]))}
    assert len(near) > 200 and near <= got


def test_meetings_are_all_pairs_of_a_group():
    bounds = np.array([0, 1, 3, 3 + near_copies.DENSE, 100, 1600])
    found = [set(zip(x.tolist(), y.tolist(), strict=True)) for x, y in near_copies._meetings(bounds, lambda x, y: (x + y) % 7 == 0)]
    assert set().union(*found) == {(x, y) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) for x in range(a, b) for y in range(x + 1, b) if (x + y) % 7 == 0}


def test_odd_bits_bound_the_difference():
    """Never more than the sets differ by, whatever their sizes, and near it for sets of like sizes."""
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 63, 64, 65, 300, 5000):
        for share in (0.0, 0.1, 0.5, 1.0):
            own, new = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
            other = np.unique(np.concatenate([own[int(n * share) :], new[: int(n * share * 0.7)]]))
            own = np.unique(own)
            apart = len(np.setxor1d(own, other))
            least = near_copies.least_apart(near_copies.odd_bits(own), near_copies.odd_bits(other))
            assert least <= apart and (share != 0.1 or n < 300 or least >= 0.7 * apart)


def test_texts_are_not_shuffled(spark, monkeypatch):
    """What near copies send is a small part of texts of long words, few of which have a copy; the sample is bounded and left out here."""
    monkeypatch.setattr(near_copies, "SAMPLE_ROWS", 4)
    rng = random.Random(21)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=300)) for _ in range(60)) for _ in range(250)]
    texts += [f"{t} end" for t in texts[:10]]
    docs = documents(spark, texts)
    folder = common.new_folder(spark, "texts")
    docs.write.parquet(folder)
    docs = spark.read.parquet(folder)

    def sent():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = sent()
    kept = near_copies.one_of_each(docs, near_copies.similar_documents(docs)).collect()
    assert sorted(r.doc_id for r in kept) == list(range(250))
    assert sent() - before < 0.3 * sum(map(len, texts))


@pytest.mark.parametrize("n, most", [(0, 1 << 27), (1, 1 << 27), (3000, 1 << 27), (3000, 1 << 15), (400, 1 << 16)])
def test_key_bits(spark, n, most):
    """A filter holds all its keys, and few others unless it is full."""
    rng = np.random.default_rng(n)
    keys, others = (rng.integers(-(1 << 63), (1 << 63) - 1, k) for k in (n, 50_000))
    bits = near_copies.key_bits(spark.createDataFrame([(k,) for k in keys.tolist()], "key long").repartition(3), n, most)
    assert 1 << 15 <= 8 * len(bits) <= most and near_copies.may_hold(bits, keys).all()
    assert near_copies.may_hold(bits, others).mean() <= 1.1 * n / (8 * len(bits))


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """Rows of other nodes and rows equal in id and text pass it, and exact joins settle them."""
    rng = random.Random(5)
    base = [words_of(rng, 40) for _ in range(30)]
    texts = base + [edited(rng, t, 0.8, 0.95) or t for t in base] + [t.upper() for t in base[:10]] + base * 2
    docs = documents(spark, texts, [*range(80), *([None] * 30), *([7] * 20), *range(100, 110)][: len(texts)] + [None] * max(0, len(texts) - 140))

    def result():
        found = near_copies.similar_documents(docs)
        groups = sorted((str(r.doc_id), r.text_hash, str(r.component_id), r.stays) for r in found.collect())
        return groups, sorted((str(r.doc_id), r.text) for r in near_copies.one_of_each(docs, found).collect())

    want = result()
    assert len(want[1]) < len(texts)
    monkeypatch.setattr(near_copies, "key_bits", lambda keys, n: np.full(4096, 255, np.uint8))
    assert result() == want


@pytest.mark.parametrize("few", [None, 2])
def test_parities_rule_out_unlike_pairs(few):
    """Nodes that share little but their first shingle make no pairs; those that are similar do."""
    rng = np.random.default_rng(9)
    sets = [np.unique(np.concatenate([[1], rng.integers(2, 1 << 63, 150)]).astype(np.uint64)) for _ in range(60)]
    sets += [np.unique(np.concatenate([s[:140], rng.integers(2, 1 << 63, 11).astype(np.uint64)])) for s in sets[:20]]
    odd = np.frombuffer(b"".join(near_copies.odd_bits(s, 64 * len(near_copies.PARITY)) for s in sets), np.int64).reshape(len(sets), -1)
    node, place = np.arange(len(sets)), np.array([len(s) << 32 for s in sets])
    batch = common.record_batch(key=np.ones(len(sets), np.int64), node=node, place=place, root=node, fp=node, fp2=node, **{n: odd[:, k].copy() for k, n in enumerate(near_copies.PARITY)})
    got = [p for out in near_copies._cross(0.8, few, near_copies.PARITY)(iter([batch])) for p in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)]
    assert sorted(got) == [(k, 60 + k) for k in range(20)]


def test_pairs_that_meet_often_count_once(spark, monkeypatch):
    """Long unlike texts share hundreds of shingles, in every task; a pair comes out of each round about once."""
    rng = random.Random(31)
    texts = []
    for _ in range(12):
        common_part = words_of(rng, 2250)
        texts += [f"{common_part} {words_of(rng, 750)}" for _ in range(2)]
    assert all(0.5 < jaccard(a, b) < 0.7 for a, b in zip(texts[::2], texts[1::2], strict=True))
    made, cross = spark.sparkContext.accumulator(0), near_copies._cross

    def counted(*given):
        work = cross(*given)

        def run(batches):
            for batch in work(batches):
                made.add(batch.num_rows)
                yield batch

        return run

    monkeypatch.setattr(near_copies, "_cross", counted)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        comp = near_copies.similar_documents(documents(spark, texts)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(r.doc_id == r.component_id for r in comp)
    assert 12 <= made.value <= 48


def test_earlier_shingles(spark):
    """The next ones before a row's in its node's prefix, in the order of places, not of keys; else the node."""
    rows = [(key, node, (7 << 32) + place) for node in (5, 6) for place, key in enumerate([90, -3, 40, 8, 77, 12])]
    got = near_copies.with_earlier(spark.createDataFrame(rows, "key long, node long, place long").repartition(3)).collect()
    keys = {node: [node] * 4 + [90, -3, 40, 8, 77, 12] for node in (5, 6)}
    assert {(r.node, r.place & 15): tuple(r[n] for n in near_copies.EARLIER) for r in got} == {(n, k): tuple(keys[n][k : k + 4][::-1]) for n in (5, 6) for k in range(6)}


@pytest.mark.parametrize("at_once", [1, 150, 1000])
def test_few_edges_are_contracted_at_once(spark, monkeypatch, at_once):
    """The components are those of the rounds, whether the rounds leave few edges at first, later or never; few edges are written twice only."""
    rng = random.Random(8)
    nodes = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(400)]
    pairs = [(nodes[k], nodes[k + 1]) for k in range(399) if k % 40] + [(nodes[3], nodes[390])]
    rng.shuffle(pairs)
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    want = sorted(graph.components(edges).collect())
    written, kept = [], graph.materialised
    monkeypatch.setattr(graph, "materialised", lambda df: written.append(1) or kept(df))
    assert sorted(graph.components(edges, at_once=at_once).collect()) == want
    assert at_once < 1000 or len(written) == 2
