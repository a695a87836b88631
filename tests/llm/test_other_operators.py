"""Top-k, URL filter, sharding, WARC and packing against brute-force versions and round trips."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tsprep.llm import packing, sharding, topk, url_filter, warc

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "word", "word", "x" * 5000, "É 漢字 😀", "a\x1cb", "don't <|endoftext|> it's"]


# --- top-k


def top_brute(rows, k, scale=64):
    vectors = {}
    for i, v in sorted(((i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0], r[1])):
        vectors.setdefault(i, [math.floor(x * scale) for x in v])
    out = []
    for q in sorted(i for i in vectors if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return out


@pytest.mark.parametrize("n", [0, 1, 15, 700])
def test_top_k(spark, n):
    rng = random.Random(n)
    rows = [(i, [rng.choice([-1.0, 0.5, 0.25, 1.0]) for _ in range(6)]) for i in range(n)]
    rows += [(20 * n + 20, None), (20 * n + 40, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (20 * n + 60, [float("nan")] * 6), (None, [1.0] * 6), (1_000_000, [2.0, 1.0]), (1_000_001, [1.0, 1.0])]
    rows += rows[: min(n, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(1))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect())
    assert got == top_brute(rows, 20)


def test_bounds_prune_and_stay_exact():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 12)) * 60
    x = np.floor(centres[rng.integers(0, 8, 3000)] + rng.normal(size=(3000, 12)) * 4)
    ids = np.arange(3000)
    best, scored = topk.Best(ids[:1], x[:1], 5), 0
    for k in range(0, 3000, 1000):
        scored += best.search(topk.BallTree(ids[k : k + 1000], x[k : k + 1000]))
    want = np.lexsort((ids[1:], -(x[1:] @ x[0])))[:5] + 1
    assert best.result()[1].tolist() == want.tolist() and scored < 3 * 1000 / 64


def asks(x, ids, monkeypatch, queries=300, k=5):
    """The whole way within this process: (query, shard) pairs asked, shards, and the k best of each query."""
    from pyspark.sql import Row

    for name, value in {"SHARD": 64, "LEAF": 16, "GROUP": 500, "CELL": 200, "CELLS": 16}.items():
        monkeypatch.setattr(topk, name, value)
    shared = lambda value: Row(value=topk.pickle.dumps(value))
    batch = lambda rows, **more: topk.record_batch(vec_id=ids[rows], dim=np.full(len(rows), x.shape[1]), v=list(x[rows]), **more)
    parts = topk.Parts({x.shape[1]: x[::7]}, len(x))
    dealt = topk.pa.Table.from_batches(list(topk._dealt(shared(parts))([batch(np.arange(len(x)))]))).sort_by([("part", "ascending"), ("vec_id", "ascending")])
    shards = [r for b in topk._shards(dealt.to_batches(max_chunksize=333)) for r in b.to_pylist()]
    assert len({r["shard"] for r in shards}) == len(shards) and sum(len(topk.pickle.loads(r["tree"]).ids) for r in shards) == len(x)
    trees = {r["shard"]: topk.pickle.loads(r["tree"]) for r in shards}
    balls = [np.frombuffer(r["ball"]) for r in shards]
    pack = {x.shape[1]: (np.array([r["shard"] for r in shards]), np.stack([b[:-1] for b in balls]), np.array([b[-1:] for b in balls]))}
    found, asked = {int(i): [] for i in ids[:queries]}, Counter()

    def ask(batches, first):
        for out in topk._routed(shared(pack), first)(batches):
            for row in out.to_pylist():
                rows = [{"shard": row["shard"], "kind": 0, "blob": topk.pickle.dumps(trees[row["shard"]])}, {"shard": row["shard"], "kind": 1, "blob": row["blob"]}]
                asked[row["shard"]] += row["n"]
                for got in topk._answers(k)([topk.pa.RecordBatch.from_pylist(rows)]):
                    for r in got.to_pylist():
                        found[r["query_id"]].append((-r["score"], r["vec_id"], r["shard"]))

    rows = np.arange(queries)
    ask([batch(rows)], True)
    kth = [-sorted(found[int(i)])[k - 1][0] if len(found[int(i)]) >= k else None for i in ids[:queries]]
    ask([batch(rows, kth=topk.pa.array(kth, topk.pa.float64()), seen=[sorted({s for *_, s in found[int(i)]}) for i in ids[:queries]])], False)
    return sum(asked.values()), len(shards), {i: [(v, -s) for s, v, _ in sorted(own)[:k]] for i, own in found.items()}


def test_queries_go_only_to_shards_that_can_serve_them(monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 10))
    x = np.floor((centres / np.linalg.norm(centres, axis=1)[:, None])[rng.integers(0, 30, 6000)] * 900 + rng.normal(size=(6000, 10)) * 15)
    x[3000:3400] = x[0]
    ids = rng.permutation(6000) - 50
    pairs, shards, best = asks(x, ids, monkeypatch)
    assert shards > 60 and pairs < 0.25 * 300 * shards
    for i in range(0, 300, 17):
        others = np.flatnonzero(ids != ids[i])
        order = others[np.lexsort((ids[others], -(x[others] @ x[i])))[:5]]
        assert best[int(ids[i])] == [(int(ids[j]), int(x[j] @ x[i])) for j in order]


def test_hot_shards_have_copies(spark):
    """Many queries for one shard: their blobs are dealt over its copies, and no answer is lost."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(50, 4)) * 64)
    tree = topk.BallTree(np.arange(50), x)
    shards = spark.createDataFrame([(7, topk.pickle.dumps(tree))], "shard long, tree binary")
    ids = np.arange(1000, 1200)
    q = np.floor(rng.normal(size=(200, 4)) * 64)
    blobs = [(7, 40_000, topk.pickle.dumps((ids[a : a + 20], q[a : a + 20], np.full(20, -np.inf)))) for a in range(0, 200, 20)]
    got = topk.answered(shards, spark.createDataFrame(blobs, "shard long, n long, blob binary"), 3).collect()
    want = {(1000 + i, int(j)) for i in range(200) for j in np.lexsort((np.arange(50), -(x @ q[i])))[:3]}
    assert {(r.query_id, r.vec_id) for r in got} == want and len(got) == 600


def test_products_beyond_floats():
    q, x = np.array([[3e15, 1.0]]), np.array([[3.0, 1.0], [1e9, 0.0]])
    assert topk._products(q, x).tolist() == [[9 * 10**15 + 1, 2**63 - 1]]


# --- url filter

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("b.example.com/d", "allow")]
URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y", "http://example.net/e", "http://net", "http://net/", "x://y.org/fr/", "x://y.org/fr", "http://example.com/de/1#a", "http://b.example.com/de/", "http://b.example.com/d", "http://notexample.com/de/", "a://b://c.net/", "http://example.net?/en/", "http://U@example.com:80/de/", "http://.net/", "http://é.net/ü", "http://x.net/\n/en/"]


def judge_brute(url, rules, default):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = rest
    for c in "/?#":
        host = host.partition(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.partition(c)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, action in rules:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or (len(rule), len(h)) > (len(best[0]), best[0].index("/"))):
            best = (rule, action)
    return host, path, best and best[0], best[1] if best else default


@pytest.mark.parametrize("max_rules", [2, 1000])
@pytest.mark.parametrize("default", ["allow", "block"])
def test_url_rules(spark, max_rules, default):
    urls = [*URLS, URLS[4]]
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate(urls)], "page_id long, url string, rule int")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(pages, RULES, default=default, max_rules=max_rules).collect()}
    for k, u in enumerate(urls):
        assert got[k] == judge_brute(u, RULES, default), u
    assert url_filter.judge(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, []).collect()} == {"allow"}
    table = spark.createDataFrame(RULES * 2, "rule string, action string")
    assert {r.page_id: tuple(r)[1:] for r in url_filter.judge(pages, table, default=default, max_rules=max_rules).collect()} == got


def test_rules_must_agree(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    for bad in ([("net/", "block"), ("net/", "allow")], [("net", "block")], [("net/", "perhaps")]):
        with pytest.raises(ValueError):
            url_filter.judge(pages, bad)
        with pytest.raises(ValueError):
            url_filter.judge(pages, spark.createDataFrame(bad, "rule string, action string"))


def test_colliding_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda data, seed=0: 7)
    index = url_filter.DigestArray(["a/", "b/", "c/"], [0, 1, 0]).mapped()
    assert [int(index.values[k]) if k >= 0 else None for k in index.find([b"a/", b"b/", b"c/", b"d/"])] == [0, 1, 0, None]


# --- sharding


def test_shards(spark):
    rows = [(k if k % 9 else None, t, "x") for k, t in enumerate([*ODD * 5, *("t%d" % k for k in range(200))])]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = sharding.external_shuffle(df, 7, bucket_bytes=500)
    got = out.collect()
    assert Counter((r.row.doc_id, r.row.text, r.row.shard) for r in got) == Counter(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.place.shard, []).append(r.place.slot)
    counts = [len(v) for v in slots.values()]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = {(r.place.shard, r.place.slot): (r.row.doc_id, r.row.text) for r in sharding.external_shuffle(df.repartition(3), 7, bucket_bytes=500).collect()}
    assert again == {(r.place.shard, r.place.slot): (r.row.doc_id, r.row.text) for r in got}
    other = {(r.place.shard, r.place.slot): r.row.text for r in sharding.external_shuffle(df, 7, seed=8, bucket_bytes=500).collect()}
    assert other != {(r.place.shard, r.place.slot): r.row.text for r in got}
    assert sharding.external_shuffle(df.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        sharding.external_shuffle(df, 0)


def test_small_buckets_share_files(spark, tmp_path):
    """However many partitions the session has, a small table makes few files, with the same rows at the same places."""
    spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("t"), F.col("id").cast("int")).alias("text")).write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    few = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        shards = sharding.external_shuffle(df, 7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", few)
    assert len(shards.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
    got = shards.collect()
    assert sorted((r.row.doc_id, len(r.row.text)) for r in got) == [(k, k) for k in range(500)]
    assert sorted(r.place.slot * 7 + r.place.shard for r in got) == list(range(500))


def test_shards_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(k, "t", (k,), k, k) for k in range(30)], "doc_id long, text string, `a-b` struct<`my col`: int>, `a.b` int, part int")
    got = sharding.external_shuffle(df, 4, bucket_bytes=100).collect()
    assert sorted((r.row.doc_id, r.row["a-b"]["my col"], r.row["a.b"], r.row.part) for r in got) == [(k, k, k, k) for k in range(30)]
    same = spark.createDataFrame([(1, "t")] * 40, "doc_id long, text string")
    assert Counter(r.place.shard for r in sharding.external_shuffle(same, 4).collect()) == {k: 10 for k in range(4)}


def test_shards_are_mixed(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = {r.row.doc_id: (r.place.shard, r.place.slot) for r in sharding.external_shuffle(df, 4).collect()}
    order = np.array([got[k][1] * 4 + got[k][0] for k in range(4000)])
    assert abs(np.corrcoef(order, np.arange(4000))[0, 1]) < 0.1
    counts = Counter((got[k][0], k // 1000) for k in range(4000))
    assert all(180 < n < 330 for n in counts.values())
    assert sorted(sharding._fisher_yates(50, 1).tolist()) == list(range(50)) and sharding._fisher_yates(0, 1).tolist() == []


def test_saved_shards(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    sharding.save_shards(sharding.external_shuffle(df, 4), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().count() == 4


# --- WARC


@pytest.mark.parametrize("broadcast", [200_000, 2])
def test_warc(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "MAX_BROADCAST", broadcast)
    rng = random.Random(3)
    html = [None, "", "<p>same</p>", "<p>same</p>", "ü漢\r\n\r\nWARC/1.1\r\n", "x" * 9000, *("<p>%d</p>" % rng.randrange(30) for _ in range(60))]
    rows = [(k, "http://a/%d\r\nX: y" % k if k % 3 else None, h, "z") for k, h in enumerate(html)] + [(None, None, "<p>same</p>", "z"), (None, None, "only here", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    archives = warc.write_archives(pages, archive_bytes=3000)
    got = {r.page_id: r for r in warc.read_archives(archives).collect() if r.page_id is not None}
    first = {}
    for k, h in enumerate(html):
        first.setdefault(h or "", k)
    for k, h in enumerate(html):
        data, r = (h or "").encode(), got[k]
        assert (r.payload_bytes, r.payload_digest) == (len(data), warc.payload_digest(data))
        assert (r.record_type, r.refers_to) == (("response", None) if first[h or ""] == k else ("revisit", first[h or ""]))
        assert (bytes(r.payload) == data) if r.record_type == "response" else r.payload is None
        assert r.url == (f"http://a/{k} X: y" if k % 3 else None)
    nulls = [r for r in warc.read_archives(archives).collect() if r.page_id is None]
    assert sorted((r.record_type, r.refers_to) for r in nulls) == [("response", None), ("revisit", 2)]
    warc.save_archives(archives, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").iterdir())
    assert len(files) == archives.count() > 1
    assert sum(len(list(warc.read_archive(f.read_bytes()))) for f in files) == len(rows)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_dictionary_is_of_all_records():
    records = [b"%05d " % k * 100 for k in range(9000)]
    pieces = []

    def seen(size, sample, **_):
        pieces.extend(sample)
        raise warc.zstandard.ZstdError

    real = warc.zstandard.train_dictionary
    warc.zstandard.train_dictionary = seen
    try:
        warc.build_dictionary(records)
        assert len(pieces) >= 3000 and sum(map(len, pieces)) <= warc.SAMPLE_BYTES and len({p[:60] for p in pieces}) > 1000
        pieces.clear()
        warc.build_dictionary([b"a" * (2 << 20), b"b" * (2 << 20)])
        assert [p[:1] for p in pieces] == [b"a", b"b"]
    finally:
        warc.zstandard.train_dictionary = real
    assert warc.build_dictionary([]) == b""


def test_long_records_are_read_in_step(spark):
    """A record of many chunks, then short ones, read back whole."""
    records = [warc.record_bytes(k, "u", bytes([65 + k]) * n, None) for k, n in enumerate((10, 3_000_000, 0, 70_000))]
    got = [(h["WARC-Record-ID"], len(b)) for h, b in warc.read_archive(warc.write_archive(records), chunk=4096)]
    assert [g[0] for g in got] == [warc.record_uri(k) for k in range(4)] and got[1][1] > 3_000_000


def test_warc_frames():
    records = [warc.record_bytes(k, f"http://a/{k}", b"<html>payload number %d</html>" % k * 20, None) for k in range(300)]
    data = warc.write_archive(records)
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and len(data) < sum(map(len, records)) / 4
    assert b"".join(b for _, b in warc.read_archive(data, chunk=97)).count(b"payload number") == 6000
    assert warc.payload_digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest().startswith("da39")
    with pytest.raises(ValueError):
        list(warc.read_archive(b"\0" * 40))


# --- packing


def test_packing(spark):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(4)
    texts = [*ODD, *(" ".join(rng.choice(["the", "house", "ran", "x9", "Über,"]) for _ in range(rng.randint(1, 900))) for _ in range(80)), " ".join(["word"] * 9000)]
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, start string")
    rows = packing.pack(df.repartition(3), VOCABULARY).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for k, t in enumerate(texts):
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(by_doc[k], key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in own]).tolist() == want
        assert [r.start for r in own] == np.cumsum([0, *[len(r.ids) // 4 for r in own]])[:-1].tolist() and {r.doc_tokens for r in own} == {len(want)}
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        sizes = [len(r.ids) // 4 for r in own]
        assert [r.offset for r in own] == np.cumsum([0, *sizes])[:-1].tolist() and sum(sizes) <= 2048
    total = sum(len(r.ids) // 4 for r in rows)
    assert total / (len(by_sequence) * 2048) > 0.9
    assert packing.pack(df.limit(0), VOCABULARY).count() == 0 and zlib.crc32(b"") == 0


def test_limits_hold(spark):
    rng = random.Random(5)
    texts = [" ".join(["word"] * rng.randint(1, 60)) for _ in range(150)]
    df = spark.createDataFrame([(k, t, rng.randint(0, 40)) for k, t in enumerate(texts)], "doc_id long, text string, prompt long")
    rows = packing.pack(df, VOCABULARY, prompt_tokens="prompt", capacity=128, max_segments=5, max_loss_tokens=64).collect()
    loads = {}
    for r in rows:
        a = loads.setdefault(r.sequence_id, [0, 0, 0])
        a[0], a[1], a[2] = a[0] + len(r.ids) // 4, a[1] + 1, a[2] + r.loss_tokens
    assert all(a[0] <= 128 and a[1] <= 5 and a[2] <= 64 for a in loads.values())
    assert sum(len(r.ids) // 4 for r in rows) == sum(len(t.split()) + 1 for t in texts)
    with pytest.raises(ValueError):
        packing.pack(df, VOCABULARY, capacity=0)


def test_dot_product_placing():
    bins = packing.place(np.array([[6, 1, 6], [5, 1, 5], [4, 1, 4], [3, 1, 3]]), np.array([10, 9, 10]))
    assert sorted(map(sorted, bins)) == [[0, 2], [1, 3]]
    assert packing.place(np.array([[1, 1, 0]] * 5), np.array([10, 2, 10])) == [[0, 1], [2, 3], [4]]


def test_chunks_encode_like_whole_texts():
    tokenizer, encoder = Tokenizer.from_file(VOCABULARY), packing.ChunkEncoder(VOCABULARY)
    texts = ["Don't <|endoftext|>A <|EndOfText|> it's WE'LL \x1c a\x85c\xa0d İstanbul İİ. ΣΑΣ ﬁ é. x9, 'tis. don't.,", "a., b.. c,. ., .. 9.", "ſt K Å", "", "word!! x$$$ a|> b<|endoftext|>! c-'s d'!! <|endoftext|>, e_ é*** 9.. .a", *[t for t in ODD if t]]
    for _ in range(2):
        for got, t in zip(encoder.encode(texts), texts, strict=True):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_chunks_are_encoded_once(monkeypatch):
    """Words that come again with signs, or after the newer chunks were set back, are not encoded again."""
    monkeypatch.setattr(packing, "CACHE", 0)

    class Spy:
        def __init__(self, tokenizer):
            self.tokenizer, self.sent = tokenizer, []

        def encode(self, text, **more):
            self.sent += text.split()
            return self.tokenizer.encode(text, **more)

        def encode_batch_fast(self, texts, **more):
            self.sent += [w for t in texts for w in t.split()]
            return self.tokenizer.encode_batch_fast(texts, **more)

    encoder = packing.ChunkEncoder(VOCABULARY)
    whole, encoder.tokenizer = encoder.tokenizer, Spy(encoder.tokenizer)
    for texts in (("Word other, x9.", "ζῷον,"), ("word! Other x9.", "ζῷον"), ("word!! other. x9.", "ζῷον!")):
        for got, text in zip(encoder.encode(texts), texts, strict=True):
            assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    for word in ("word", "other", "ζῷον", "x9."):
        assert encoder.tokenizer.sent.count(word) == 1, word
    assert "word!!" not in encoder.known
