"""The registered queries over a small corpus of their own, column by column against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tsprep.llm import packing, queries


def words_of(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents and labels, and the texts."""
    rng = random.Random(17)
    folder = str(tmp_path_factory.mktemp("queries"))
    passage = words_of(rng, 40)
    texts = [words_of(rng, rng.randint(1, 90), "aeionlrst" if k % 2 else "uöäkzwxyq") for k in range(120)]
    texts += [f"{words_of(rng, 20)} {passage} {words_of(rng, 20)}" for _ in range(12)]
    texts += [texts[3], texts[4] + " x", texts[5].upper(), None, "", " \t", "É 漢字 😀", "a" * 30_000, words_of(rng, 3000), "12 !! ##"]
    langs = ["en" if k % 2 else "de" for k in range(120)] + [None] * (len(texts) - 120)
    rows = [(k, t, lang, "s", len(t or ""), k) for k, (t, lang) in enumerate(zip(texts, langs, strict=True))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `row` long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, texts


def result(spark, corpus, name):
    found = queries.QUERIES[name](spark, corpus[0])
    return found.columns, dict(found.dtypes), {r.doc_id: r for r in found.collect()}


def held_out(k):
    return zlib.crc32(str(k).encode()) % 4 == 2


def test_op1(spark, corpus):
    columns, kinds, got = result(spark, corpus, "op1_language_id")
    assert columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and kinds["held_out"] == "boolean" and kinds["score"] == "double"
    texts = corpus[1]
    assert len(got) == len(texts) and all(r.held_out == held_out(k) and 0 <= r.score <= 1 for k, r in got.items())
    for k, t in enumerate(texts):
        if not any(map(str.isalpha, t or "")):
            assert got[k].lang_pred == "und"
        elif k < 120 and len(t) > 60:
            assert got[k].lang_pred == ("en" if k % 2 else "de")


def test_op2(spark, corpus):
    columns, _, got = result(spark, corpus, "op2_simhash")
    assert columns[:3] == ["doc_id", "fingerprint", "component_id"]
    fps = []
    for t in corpus[1]:
        words = (t or "").encode().lower().split()
        shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(fps)))
    changed = True
    near = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    while changed:
        changed = False
        for a, b in near:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {k: (f"{x:016x}", root[k]) for k, x in enumerate(fps)}


def test_op3(spark, corpus):
    columns, kinds, got = result(spark, corpus, "op3_suffix_dedup")
    assert columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and {kinds[c] for c in columns[1:4]} == {"bigint"}
    seen = set()
    for k, t in enumerate(corpus[1]):
        data = (t or "").encode()
        mask = np.zeros(len(data) + 1, np.int64)
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                mask[s] += 1
                mask[s + 100] -= 1
            seen.add(data[s : s + 100])
        gone = np.cumsum(mask)[: len(data)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), k
    assert sum(r.n_removed for r in got.values()) > 1000


def test_op7(spark, corpus):
    columns, kinds, got = result(spark, corpus, "op7_sharding")
    assert columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and kinds["shard"] == "int" and kinds["slot"] == "bigint"
    assert {k: (r.size, r.text_crc32) for k, r in got.items()} == {k: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in enumerate(corpus[1])}
    counts = Counter(r.shard for r in got.values())
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    for r in got.values():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {(r.law, r.grown_shard) for r in got.values()} == {("rows", None)}


def test_op9(spark, corpus):
    found = queries.QUERIES["op9_packing"](spark, corpus[0])
    assert found.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, load = defaultdict(list), defaultdict(list)
    for r in found.collect():
        pieces[r.doc_id].append(r)
        load[r.sequence_id].append((r.offset, r.length))
    for k, t in enumerate(corpus[1]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END]
        own = sorted(pieces[k], key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()] and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for parts in load.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()] and sum(n for _, n in parts) <= 2048


def test_op10(spark, corpus):
    columns, kinds, got = result(spark, corpus, "op10_quality")
    assert columns[:4] == ["doc_id", "held_out", "score", "predicted"] and kinds["predicted"] == "int"
    assert len(got) == len(corpus[1])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == held_out(k) for k, r in got.items())
    assert got[123 + 9 + 3].score == got[123 + 9 + 4].score  # a null text and an empty one


def test_op10_tells_labels_on_held_out_rows(spark, sf_dir):
    rows = queries.QUERIES["op10_quality"](spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").select("score", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    wins = np.mean([[(a > b) + 0.5 * (a == b) for b in bad] for a in good])
    assert len(rows) > 10 and wins > 0.85
