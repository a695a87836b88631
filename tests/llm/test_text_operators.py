"""Language identification, SimHash, suffix dedup, decontamination and quality against brute-force versions."""

import hashlib
import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tsprep.llm import common, decontaminate, graph, language_id, quality, simhash, suffix_dedup
from tsprep.llm.suffixes import PERIOD, CoverSample, cover, shifts

ODD = [None, "", " \n", "?!", "a", "the the the", "x" * 30_000, "é漢字😀", "same text", "same text"]


def documents(spark, texts, ids=None, lang=None, more="doc string, fp string, part int, row int, score double"):
    """Rows with columns whose names clash with those that operators use."""
    ids = list(range(len(texts))) if ids is None else ids
    lang = ["en"] * len(texts) if lang is None else lang
    rows = [(i, t, g, "a", "b", 1, 2, 3.0) for i, t, g in zip(ids, texts, lang, strict=True)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, {more}")


def words_of(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


# --- language identification


def parse_brute(sample, symbols):
    n, count = len(symbols), 0
    at = 0
    while at < n:
        size = 1
        while at + size < n and symbols[at : at + size + 1] in sample:
            size += 1
        at += size if symbols[at : at + 1] in sample else 1
        count += 1
    return count


@settings(max_examples=60, deadline=None)
@given(st.text("abcd ", min_size=1, max_size=60), st.text("abcde ", max_size=80))
def test_cross_parsing(sample, text):
    model = language_id.Model({"x": [sample]})
    if not model.languages:
        return
    symbols, _ = model.symbols([sample + "\n"])
    got, _ = model.phrases([text, "", text + text])
    for k, t in enumerate((text, "", text + text)):
        own, _ = model.symbols([t])
        assert got[0, k] == parse_brute(symbols.tobytes(), own.tobytes())


@settings(max_examples=60, deadline=None)
@given(st.text("ab ", min_size=1, max_size=60), st.lists(st.text("abc ", max_size=60), max_size=4), st.integers(1, 9), st.integers(1, 60))
def test_phrases_go_over_the_ends_of_blocks(sample, texts, block, cells):
    models = language_id.Model({"x": [sample], "y": [sample[::-1] + "a"]})
    texts = [*texts, sample * 4]
    old = language_id.BLOCK, language_id.CELLS
    language_id.BLOCK, language_id.CELLS = block, cells
    try:
        got, sizes = models.phrases(texts)
    finally:
        language_id.BLOCK, language_id.CELLS = old
    for row, name in zip(got, models.languages, strict=True):
        own = models.symbols([{"x": sample, "y": sample[::-1] + "a"}[name] + "\n"])[0]
        assert row.tolist() == [parse_brute(own.tobytes(), models.symbols([t])[0].tobytes()) for t in texts]


def test_long_texts_are_parsed_whole():
    """Phrases far longer than a block, and far more blocks than are parsed side by side."""
    rng = random.Random(3)
    sample = words_of(rng, 900)
    model = language_id.Model({"x": [sample]})
    text = sample * 3 + words_of(rng, 3000) + sample[100:4000]
    own, _ = model.symbols([text])
    assert model.phrases([text, "ab"])[0][0, 0] == parse_brute(model.symbols([sample + "\n"])[0].tobytes(), own.tobytes())


def test_languages_of_many_letters(spark):
    """Two languages of the same two thousand letters, told apart by how these follow each other; no two letters share symbols."""
    letters = [chr(0x4E00 + k) for k in range(2000)]
    rng = random.Random(4)

    def say(turn, n=300):
        at, out = rng.randrange(2000), []
        for _ in range(n):
            out.append(letters[at])
            at = (at * turn + rng.randrange(3)) % 2000
        return "".join(out)

    texts = [say(7) for _ in range(40)] + [say(11) for _ in range(40)]
    docs = documents(spark, texts, lang=["zh"] * 40 + ["ja"] * 40)
    model = language_id.fit(docs.where("doc_id % 4 <> 0"))
    assert len({model.symbols([c])[0].tobytes() for c in letters}) == 2000
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert all(got[k] == ("zh" if k < 40 else "ja") for k in range(80))


def test_the_sample_is_of_whole_texts(spark):
    texts = ["abcdef" * 30, "uvwxyz" * 50, "k" * 400]
    docs = documents(spark, texts, lang=["en", "en", "de"])
    model = language_id.fit(docs, max_chars=250)
    assert set(model.letters) == set("abcdefk") and model.languages == ["de", "en"]
    small = language_id.Model({"en": ["ab" * 50, "cd" * 50, "ef"]}, symbols_per_language=110)
    assert small.bits == [float(np.log2(101 + 3))]


def test_languages(spark):
    rng = random.Random(1)
    texts = [words_of(rng, 60, "aeionlrst") for _ in range(30)] + [words_of(rng, 60, "uöäkzwxyq") for _ in range(30)]
    docs = documents(spark, texts, lang=["en"] * 30 + ["de"] * 30)
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert all(got[k].lang_pred == ("en" if k < 30 else "de") and 0 <= got[k].score <= 1 for k in range(60))
    odd = {r.doc_id: r for r in language_id.identify(documents(spark, ODD), model).collect()}
    assert [odd[k].lang_pred for k in range(4)] == ["und"] * 4 and odd[6].lang_pred in ("en", "de") and odd[8].lang_pred == odd[9].lang_pred
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_no_labels(spark):
    docs = documents(spark, ["some text"], lang=[None])
    assert language_id.identify(docs, language_id.fit(docs)).first().lang_pred == "und"


def test_ties_go_to_the_first_language():
    model = language_id.Model({"b": ["abc"], "a": ["abc"]})
    assert model.predict(["abc"])[0] == ["a"]


# --- SimHash


def fingerprint_brute(text, words):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[k : k + words]), 42) for k in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(fps, ids, bits):
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                root[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for k, i in enumerate(ids):
        r = find(k)
        least[r] = i if least[r] is None else least[r] if i is None else min(i, least[r])
    return [least[find(k)] for k in range(len(fps))]


def test_fingerprints():
    rng = random.Random(2)
    texts = [*ODD, "A B  C\tD\x0bE É", *(words_of(rng, n) for n in (1, 3, 4, 5, 254, 258, 259, 700))]
    for words in (1, 4, 5):
        assert simhash.fingerprints(texts, words).tolist() == [fingerprint_brute(t, words) for t in texts]


def test_golay_code():
    g = simhash.Golay()
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000)
    code = words ^ g.leader[g.low[words & 0xFFF] ^ g.high[words >> 12]]
    assert (np.bitwise_count(words ^ code) <= 3).all() and (g.low[code & 0xFFF] ^ g.high[code >> 12] == 0).all()
    for i, j in rng.integers(0, 23, (60, 2)):
        own = {tuple(r) for r in np.stack(g.keys(words, 23), 1).tolist()}
        a, b = np.stack(g.keys(words, 23), 1), np.stack(g.keys(words ^ (1 << i) ^ ((1 << j) if i != j else 0), 23), 1)
        assert own and all(set(x) - {-1} & (set(y) - {-1}) for x, y in zip(a.tolist()[:50], b.tolist()[:50], strict=True))


def near_fingerprints(rng, n, flips):
    base = [rng.getrandbits(64) for _ in range(max(1, n // 6))]
    out = []
    for _ in range(n):
        x = rng.choice(base)
        for _ in range(rng.randint(0, flips)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_links_are_exact(spark, hot):
    rng = random.Random(hot)
    fps = list(dict.fromkeys([0, 15, 31, *near_fingerprints(rng, 180, 6)]))
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, hot)
    got = {r.node: r.root for r in graph.components(edges).collect()}
    roots = [got.get(x, x) for x in signed]
    want = components_brute(fps, signed, 4)
    assert [roots[a] == roots[b] for a in range(len(fps)) for b in range(a)] == [want[a] == want[b] for a in range(len(fps)) for b in range(a)]
    for a, b in ((r.a, r.b) for r in edges.collect()):
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 4
    with pytest.raises(ValueError):
        simhash.links(edges, 5)


@pytest.mark.parametrize("full", [2, 30])
def test_full_keys_are_split_exactly(monkeypatch, full):
    monkeypatch.setattr(simhash, "FULL_GROUP", full)
    rng = random.Random(full)
    fps = list(dict.fromkeys([*near_fingerprints(rng, 400, 5), *(rng.getrandbits(40) for _ in range(60))]))
    # Half of them share their lower segments, so that keys are full.
    fps += [x >> 46 << 46 | 12345 for x in fps[:200]] + [x & ((1 << 46) - 1) for x in fps[200:300]]
    fps = np.array(list(dict.fromkeys(fps)), np.uint64)
    golay = simhash.Golay()
    keys, at = simhash.fuzzy_keys(fps, golay)
    order = np.lexsort((fps[at], keys))
    a, b = simhash.links_by_key(keys[order], fps[at][order], 4, golay, dense=2)
    root = {int(x): int(x) for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert (x ^ y).bit_count() <= 4
        root[find(x)] = find(y)
    want = components_brute(fps.tolist(), list(range(len(fps))), 4)
    got = [find(int(x)) for x in fps]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want)) < len(fps)


def test_components(spark):
    rng = random.Random(4)
    pairs = [(k, k + 1) for k in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, k) for k in range(201, 260)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    root = {}
    for a, b in pairs:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    assert got == {k: v for k, v in root.items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(5)
    texts = [*ODD, *(words_of(rng, 80) for _ in range(20))]
    texts += [texts[-1], texts[-2] + " more", texts[-3].upper(), None]
    ids = [*range(1, len(texts)), None]
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(documents(spark, texts, ids)).collect()), key=str)
    fps = [fingerprint_brute(t, 4) for t in texts]
    comp = components_brute(fps, ids, 4)
    assert got == sorted(((i, x - (1 << 64) if x >= 1 << 63 else x, c) for i, x, c in zip(ids, fps, comp, strict=True)), key=str)
    assert simhash.near_duplicates(documents(spark, texts).limit(0)).count() == 0


# --- suffix sorting and removal


def test_difference_cover():
    for period in (2, 7, 32, 50):
        d = cover(period)
        assert {(a - b) % period for a in d for b in d} == set(range(period))
        assert shifts(period).max() < period


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=40, max_size=400).map(lambda b: bytes(x % 3 for x in b)), st.integers(9, 60))
def test_suffix_order(data, depth):
    text = np.frombuffer(data * 3, np.uint8)
    starts = np.arange(0, len(text) - depth, 1)
    order, same = CoverSample(text, depth).sort(starts, np.zeros(len(starts), np.int64))
    strings = [text[s : s + depth].tobytes() for s in starts[order]]
    assert strings == sorted(strings)
    assert same.tolist() == [k > 0 and strings[k] == strings[k - 1] for k in range(len(strings))]
    assert PERIOD == 32


def removed_brute(docs, length):
    """docs: (order, text) -> bytes removed by document, as a mask."""
    seen, out = set(), []
    for _, text in docs:
        data = (text or "").encode()
        mask = np.zeros(len(data) + 1, np.int64)
        for s in range(len(data) - length + 1):
            k = data[s : s + length]
            if k in seen:
                mask[s] += 1
                mask[s + length] -= 1
            seen.add(k)
        out.append(np.cumsum(mask)[: len(data)] > 0)
    return out


def corpus(seed, n=40):
    rng = random.Random(seed)
    shared = [words_of(rng, 60) for _ in range(4)]
    texts = []
    for k in range(n):
        t = words_of(rng, rng.randint(0, 120), "abc" if k % 3 else "abcdefghé")
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(t))
            p = rng.choice(shared)
            t = t[:at] + p[rng.randint(0, 30) : len(p) - rng.randint(0, 30)] + t[at:]
        texts.append(t)
    return [*texts, "ab" * 300, "ab" * 200, "a" * 500, texts[3], None, "", "short", texts[5] + texts[5]]


def test_parts_follow_each_other_in_few_partitions(spark, monkeypatch):
    monkeypatch.setattr(common, "MAX_PARTITIONS", 2)
    texts = corpus(4)
    want = removed_brute(list(enumerate(texts)), 100)
    for r in suffix_dedup.remove_repeats(documents(spark, texts).repartition(3), part_bytes=500).collect():
        data = (r.row.text or "").encode()
        assert bytes(r.kept) == bytes(np.frombuffer(data, np.uint8)[~want[r.row.doc_id]])


@pytest.mark.parametrize("options", [{}, {"hot_bucket": 0}, {"length": 50, "kgram": 16}, {"part_bytes": 2000}, {"hot_records": 0}, {"hot_records": 2, "hot_bucket": 1, "part_bytes": 2000}])
@pytest.mark.parametrize("seed", [1, 2])
def test_removal(spark, options, seed):
    texts = corpus(seed)
    found = suffix_dedup.remove_repeats(documents(spark, texts).repartition(5), **options)
    want = removed_brute(list(enumerate(texts)), options.get("length", 100))
    rows = found.collect()
    assert len(rows) == len(texts)
    for r in rows:
        data, mask = (r.row.text or "").encode(), want[r.row.doc_id]
        assert bytes(r.kept) == bytes(np.frombuffer(data, np.uint8)[~mask]), r.row.doc_id
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]])))
        assert [(s.start, s.end) for s in r.spans] == [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        assert r.row.text == texts[r.row.doc_id] and r.row.part == 1


def test_removal_across_pieces(spark, monkeypatch):
    texts = corpus(3)
    pieces = suffix_dedup.pieces_of(0, b"x" * 1000, 100)
    assert len(pieces) == 1 and pieces[0][1] == 0
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    assert [p[1] for p in suffix_dedup.pieces_of(0, b"x" * 300, 100)] == [0, 64, 128, 192]
    hasher = suffix_dedup.Hasher(100, 32)
    whole = (texts[0] * 5 + texts[3] * 5).encode()
    parts = np.concatenate([hasher.records([p]) for p in suffix_dedup.pieces_of(0, whole, 100)])
    at = np.concatenate([np.arange(r["at"], r["at"] + int(r["before"]) - int(r["after"]) + 1) for r in parts])
    assert sorted(at.tolist()) == list(range(len(whole) - 99))


def test_removal_takes_little_memory():
    """Hashing and sorting some MB of text, a bounded piece at a time."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 105, 2000).astype(np.uint8).tobytes().decode() for _ in range(1500)]
    batch = pa.record_batch({"doc_key": pa.array(range(1500), pa.int64()), "text": texts})

    def most(work, batches):
        tracemalloc.start()
        n = sum(b.num_rows for b in work(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n
        return peak

    assert most(suffix_dedup._anchored(100, 32, 4, 1024), [batch]) < 40 << 20
    # Spans of two strings, two of each bucket.
    head = np.zeros(30_000, suffix_dedup._SPAN)
    head["route"], head["doc"], head["size"] = np.arange(30_000) // 2, np.arange(30_000), 101
    content = rng.integers(97, 105, (15_000, 101)).astype(np.uint8).repeat(2, 0)
    spans = suffix_dedup._sent(0, 3, len(head).to_bytes(8, "little") + suffix_dedup._packed(head) + content.tobytes())
    assert most(suffix_dedup._sorted(100, 4), [spans]) < 70 << 20


def test_tasks_give_memory_back(monkeypatch):
    back = []
    monkeypatch.setattr(common, "give_back", lambda: back.append(True))

    class Rows:
        def mapInArrow(self, work, schema):
            return work

    run = common.arrow_map(Rows(), lambda batches: (b for b in batches), "x int")
    assert list(run(iter([1, 2]))) == [1, 2] and back == [True]
    some = run(iter([1, 2]))
    next(some)
    some.close()
    assert back == [True, True]


def test_removal_with_odd_ids(spark):
    p = words_of(random.Random(9), 60)
    texts, ids = [p + "x", p + "y", p + "z", None, p + "y"], [5, None, 5, 7, 2]
    rows = {(r.row.doc_id, r.row.text): r for r in suffix_dedup.remove_repeats(documents(spark, texts, ids)).collect()}
    assert bytes(rows[(None, p + "y")].kept) == (p + "y").encode()
    assert bytes(rows[(2, p + "y")].kept) == b"" and len(bytes(rows[(5, p + "x")].kept)) == 1 and len(bytes(rows[(5, p + "z")].kept)) == 1
    assert suffix_dedup.remove_repeats(documents(spark, texts).limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(documents(spark, texts), kgram=33)


@pytest.mark.parametrize("options", [{}, {"hot_records": 20}, {"hot_bucket": 20}])
def test_removal_round_a_hot_anchor(spark, options):
    """A passage in most documents, each with other text round it: its edges make one bucket with a span for each document."""
    rng = random.Random(12)
    passage = words_of(rng, 40)
    texts = [words_of(rng, 30) + passage + words_of(rng, 30) if k % 5 else words_of(rng, 60) for k in range(150)]
    want = removed_brute(list(enumerate(texts)), 100)
    for r in suffix_dedup.remove_repeats(documents(spark, texts).repartition(6), **options).collect():
        assert bytes(r.kept) == bytes(np.frombuffer(texts[r.row.doc_id].encode(), np.uint8)[~want[r.row.doc_id]]), r.row.doc_id


def test_removal_keeps_columns_of_any_name(spark):
    p = words_of(random.Random(9), 60)
    docs = spark.createDataFrame([(k, p + str(k), (k, {"x y": 1}), k, k, k) for k in range(3)], "doc_id long, text string, `a-b` struct<`my col`: int, `m.n`: map<string, int>>, `a.b` int, `q``r` int, row int")
    rows = suffix_dedup.remove_repeats(docs).orderBy("row.doc_id").collect()
    assert [r.row.asDict()["a.b"] for r in rows] == [0, 1, 2] and rows[1].row["a-b"]["my col"] == 1 and rows[2].row["q`r"] == 2 and rows[2].row["row"] == 2
    assert [len(bytes(r.kept)) for r in rows] == [len(p) + 1, 1, 1]


def test_unlike_spans_of_one_anchor_stay(spark):
    """Two strings with one anchor that a short hash of their spans took for one."""
    anchor = "reriuiemivhgyzznsvockqmytxygywnq"
    texts = [anchor + "udrhkbhkujfgerfujkgeconmfqsbofgoyelryjqjppogevpfmiyfkfrwmcwebncepjar", anchor + "ctkhfqwfocrypjswycprytkcdybzwcrrqhcfwbgfcvgjormrncyvljoxdguamcspatef"]
    records = np.concatenate([suffix_dedup.Hasher(100, 32).records([(k, 0, np.frombuffer(t.encode(), np.uint8))]) for k, t in enumerate(texts)])
    assert records["key"][0] == records["key"][1] and not suffix_dedup.collapse(records)[1].any()
    assert [(bytes(r.kept).decode(), r.spans) for r in suffix_dedup.remove_repeats(documents(spark, texts)).orderBy("row.doc_id").collect()] == [(t, []) for t in texts]


def test_long_hash_is_sparks(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    got = [r.h for r in spark.createDataFrame([(v,) for v in values], "v long").select(F.xxhash64("v").alias("h")).collect()]
    assert suffix_dedup.long_hash(np.array(values, np.int64)).tolist() == got


# --- decontamination

ITEMS = [
    (1, "Tom bought 12 apples for 3 dollars each and gave Ann 4 of them before walking home that evening."),
    (2, "the quick brown fox jumps over the lazy dog near the old stone bridge at dawn"),
    (3, "too short"),
    (4, None),
]


def leaks(spark, texts, **options):
    found = decontaminate.find(documents(spark, texts), spark.createDataFrame(ITEMS, "item_id long, text string"), **options)
    return sorted((r.doc_id, r.item_id, r.changed_slots) for r in found.collect())


def test_decontamination(spark):
    rng = random.Random(8)
    filler = words_of(rng, 50)
    changed = "Bob bought 25 apples for 9 dollars each and gave Sue 7 of them before walking home that evening."
    torn = "Tom bought 12 apples for 12 dollars each and gave Tom 12 of them before walking home that evening."
    texts = [filler, f"{filler} {ITEMS[0][1]} {filler}", f"so {changed}", f"we said {torn}", ITEMS[1][1], " ".join(ITEMS[1][1].split()[:6]) + filler, "too short", *ODD, ITEMS[1][1].upper().replace(" ", "\n")]
    for options in ({}, {"max_build_words": 20}):
        got = leaks(spark, texts, **options)
        assert [g[:2] for g in got] == [(1, 1), (2, 1), (4, 2), (6, 3), (17, 2)]
        assert dict((g[0], g[2]) for g in got)[1] == 0 and dict((g[0], g[2]) for g in got)[2] > 0
    kept = decontaminate.clean(documents(spark, texts), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {g[0] for g in got} and kept.columns == documents(spark, texts).columns
    assert leaks(spark, [None, ""]) == [] and decontaminate.find(documents(spark, ["a"]).limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_whole_items_are_found_everywhere(spark):
    """Every document that holds an item word by word is reported, and no other of these."""
    rng = random.Random(10)
    items = [(k, words_of(rng, rng.randint(9, 40))) for k in range(20)]
    texts, want = [], set()
    for k in range(60):
        t = words_of(rng, 80)
        if k % 2:
            i = rng.randrange(20)
            t = f"{t} {items[i][1]} {words_of(rng, 30)}"
            want.add((k, i))
        texts.append(t)
    found = decontaminate.find(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_items_in_capitals_are_found(spark):
    """Whatever the letter case of the document, figures as they were or changed."""
    lower = ITEMS[1][1]
    changed = ITEMS[0][1].replace("12", "25").replace("for 3", "for 9").replace("Ann 4", "Ann 7")
    texts = [lower.upper(), lower.upper().replace(" ", "\n"), lower.title(), ITEMS[0][1].upper(), changed.upper(), changed.title(), ITEMS[0][1].lower()]
    for options in ({}, {"max_build_words": 20}):
        assert [g[:2] for g in leaks(spark, texts, **options)] == [(0, 2), (1, 2), (2, 2), (3, 1), (4, 1), (5, 1), (6, 1)]


def test_items_of_few_literal_words_are_found(spark):
    """Verbatim copies of items that are mostly figures, units or names; changed ones only where half the words are literal."""
    items = [
        (1, "Convert 5 km to m and 30 min to s"),
        (2, "10 20 30 40 50 60 70 80"),
        (3, "Anna Berta Carl Dora Emil Franz Gustav Hans Ida Josef Klara Ludwig Martha Nora Otto"),
        (4, "Tom sold the old red boat to a very rich man."),
        (5, "5 km 3 min"),
    ]
    texts = [f"{start} {t} again" for start in ("we know that", "It is so.") for _, t in items]
    texts += ["then Bob sold the old red boat to a very rich man", "So it is. Bob sold the old red boat to a very rich man.", "11 21 31 41 51 61 71 81", "6 km 4 min", "Convert 6 km to m and 40 min to s"]
    table = spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"max_build_words": 20}):
        got = sorted((r.doc_id, r.item_id) for r in decontaminate.find(documents(spark, texts), table, **options).collect())
        assert got == [*((k, k % 5 + 1) for k in range(10)), (10, 4), (11, 4)]


def brute_matches(text, item, window=8, min_words=4, min_covered=13):
    """Whether item contaminates text and how many slots changed, alignment by alignment, without hashes."""

    def kinds_of(t):
        lexicon = decontaminate.Lexicon()
        words = t.split()
        at = lexicon.look_up(words)
        first = [k == 0 or bool(lexicon.ends[at[k - 1]]) for k in range(len(words))]
        kind = lexicon.kind[at].tolist()
        named = [0 if k == decontaminate.NAME and f else k for k, f in zip(kind, first, strict=True)]
        return lexicon.hash[at].tolist(), [named, [0 if k == decontaminate.NAME else k for k in kind], kind, [0] * len(kind)]

    (own, own_kinds), (doc, doc_kinds) = kinds_of(item), kinds_of(text)
    n = min(window, len(own))
    covered, kept = set(), set()
    for shift in range(1 - len(own), len(doc)):
        alike, other = set(), set()
        for q in range(max(0, -shift), min(len(own) - n, len(doc) - n - shift) + 1):
            here = range(q, q + n)
            for t in range(4):
                if t < 3 and (len(own) < min_words or 2 * sum(own_kinds[t][j] == 0 for j in here) < n):
                    continue
                if all(own_kinds[t][j] == doc_kinds[t][j + shift] and (own_kinds[t][j] or own[j] == doc[j + shift]) for j in here):
                    (alike if all(own[j] == doc[j + shift] for j in here) else other).update(here)
        pairs = {(own[j], doc[j + shift]) for j in alike | other if own_kinds[2][j]}
        if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
            alike |= other
        covered |= alike
        kept |= {j for j in alike if own[j] == doc[j + shift]}
    return (len(covered - kept),) if own and len(covered) >= min(min_covered, len(own)) else None


def test_decontamination_is_that_of_brute_force(spark):
    rng = random.Random(31)
    vocabulary = ["tom", "Tom", "Ann", "sold", "the", "old", "boat", "5", "7", "12", "km", "min", "for", "of.", "=", "rich"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(f"i{k}", say(rng.choice([1, 2, 3, 5, 9, 14, 20]))) for k in range(25)] + [("none", None), ("empty", " ")]
    texts = []
    for k in range(120):
        item = rng.choice(items[:25])[1]
        if k % 3 == 0:
            swap = {"5": "8", "7": "9", "Tom": "Bob"} if k % 2 else {w: rng.choice(["1", "2", "3"]) for w in ("5", "7", "12")}
            item = " ".join(swap.get(w, w) if k % 2 or rng.random() < 0.5 else w for w in item.split())
        texts.append(f"{say(rng.randint(0, 20))} {item.upper() if k % 10 == 0 else item} {say(rng.randint(0, 20))}")
    docs = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate([*texts, None, ""])], "doc_id string, text string")
    found = {(r.doc_id, r.item_id): r.changed_slots for r in decontaminate.find(docs, spark.createDataFrame(items, "item_id string, text string")).collect()}
    want = {(f"d{k}", i): got[0] for k, t in enumerate(texts) for i, item in items[:25] if (got := brute_matches(t, item))}
    assert found == want and len(want) > 150 and any(want.values())


def test_slots_of_an_alignment_hang_together(spark):
    items = [(1, "Add 12 + 13 = 25 , 14 + 15 = 29 , 16 + 17 = 33"), (2, "she bought 5 pears and ate 5 pears before she went back home to sleep"), (3, "Solve 12 13 14 15 16"), (4, "Define entropy.")]
    twisted = items[1][1].replace("5 pears and", "7 pears and").replace("ate 5", "ate 9")
    texts = [items[0][1], twisted, items[1][1].replace("5", "8"), f"so {items[2][1]} now", "Now define entropy. Then go on"]
    found = decontaminate.find(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.changed_slots) for r in found) == [(0, 1, 0), (2, 2, 2), (3, 3, 0), (4, 4, 0)]
    assert decontaminate.find(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string"), min_verbatim_words=3).where("item_id = 4").isEmpty()


# --- quality


def test_quality(spark):
    rng = random.Random(11)
    good = [" ".join(words_of(rng, 9) + "." for _ in range(rng.randint(3, 9))) for _ in range(150)]
    bad = [" ".join(rng.choice(["BUY!!", "now$$", "###"]) for _ in range(rng.randint(20, 90))) for _ in range(60)]
    docs = documents(spark, good + bad)
    labels = docs.select("doc_id", (F.col("doc_id") < 150).cast("int").alias("quality"))
    learn = labels.where(common.learnable())
    model = quality.fit(docs, learn.unionByName(spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, quality int")))
    rows = quality.score(docs, model).collect()
    assert all((r.quality_score >= 0.7) == (r.doc_id < 150) for r in rows) and all(0 <= r.quality_score <= 1 for r in rows)
    assert rows[0].part == 1 and rows[0].score == 3.0
    assert quality.score(docs, model, into="score").columns == [*[c for c in docs.columns if c != "score"], "score"]
    odd = {r.doc_id: r.quality_score for r in quality.score(documents(spark, ODD), model).collect()}
    assert len(odd) == len(ODD) and odd[0] == odd[1] and odd[8] == odd[9]
    assert quality.score(docs.limit(0), model).count() == 0
    none = quality.fit(docs, learn.limit(0))
    assert {r.quality_score for r in quality.score(docs.limit(5), none).collect()} == {0.5}
    one = quality.fit(docs, learn.where("quality = 1"))
    assert min(r.quality_score for r in quality.score(docs.limit(5), one).collect()) > 0.9


def test_scores_are_sums_of_table_values():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.Model().fit(x, y)
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.8
    row = x[:1]
    total = model.bias + sum(t[np.searchsorted(e, row[0, k], side="right")] for k, (t, e) in enumerate(zip(model.tables, model.edges, strict=True)))
    total += sum(t[np.searchsorted(model.coarse[i], row[0, i], side="right"), np.searchsorted(model.coarse[j], row[0, j], side="right")] for i, j, t in model.pairs)
    assert np.isclose(model.score(row)[0], 1 / (1 + np.exp(-total)))


def test_held_out(spark):
    import zlib

    got = {r.doc_id: r.h for r in spark.createDataFrame([(k,) for k in [*range(40), None]], "doc_id long").select("doc_id", common.held_out().alias("h")).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in range(40)} | {None: False}
    assert hashlib.sha256(b"").hexdigest()
