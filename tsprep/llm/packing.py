"""Vector bin packing of examples into training sequences.

An example has a vector of demands: tokens, segments (one), and tokens that bear loss. A sequence has a limit on
each. Examples longer than a sequence are cut: the full pieces fill sequences by themselves and the rest
is placed like any other example. Placing is by the dot-product heuristic: a sequence is opened, and of the
examples that still fit all three limits the one whose demands have the largest dot product with what is left
(both as shares of the limits) goes in, until none fits. A block of examples is packed at a time, so memory is
bounded and tasks are independent; a sequence's number is its task's partition and its place there.

Defined results: a null text counts as empty, and its document is the end token alone. Ties in the
dot product go to the example that comes first. Repeated rows are packed separately. With loss limits
below the token limit a piece is cut so that it keeps within them. Ids may be of any type. Columns other than id and text are ignored.
"""

from __future__ import annotations

import contextlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_map, slices

CAPACITY, END, MAX_SEGMENTS, BLOCK_PIECES = 2048, 1, 256, 1024
#: Chunks whose ids a worker keeps at most; the memory is a few hundred bytes for each.
CACHE = 400_000
_REST = [("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("loss_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


#: Signs that a chunk may end with: not the apostrophe, which begins tokens with letters, nor what special tokens are written with.
TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


class Known(dict):
    """Chunks' ids. One that is missing is taken over from the older ones, or noted as new and given as None."""

    def __init__(self, older: dict[str, bytes]):
        self.older, self.new = older, set()

    def __missing__(self, chunk: str) -> bytes | None:
        found = self.older.get(chunk)
        if found is None:
            self.new.add(chunk)
        else:
            self[chunk] = found
        return found


class ChunkEncoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    The vocabulary's pre-tokenizer never crosses white space, so a text's ids are those of its chunks in a row,
    and most chunks come again. It folds case, so texts of Latin-1 letters, which fold alike in Python, are folded
    before they are looked up, and signs that end a chunk after such a letter are set apart. Texts with separators that
    Python and the tokenizer's patterns see differently are encoded whole. Of the chunks that have been seen, those of
    late are kept."""

    ODD = "\x1c\x1d\x1e\x1f"
    SIGNS = re.compile(f"[{re.escape(TAIL)}](?<=[a-z\xdf-\xf6\xf8-\xff].)[{re.escape(TAIL)}]*(?!\\S)")

    def __init__(self, path: str):
        # The tokenizer's own threads would contend with the tasks beside this one.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        #: The tokens that a word ends with.
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.known = Known({})

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def folded(text: str) -> str:
        if "<|" in text:  # a special token's name counts only as it is written
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [None if any(map(t.__contains__, self.ODD)) else self.SIGNS.sub(r" \g<0>", self.folded(t)).split() for t in texts]
        if len(self.known) > CACHE:
            self.known.older = {}
            self.known = Known(self.known)
        get = self.known.__getitem__
        rows = [words and list(map(get, words)) for words in parts]
        self._learn()
        out = []
        for text, words, row in zip(texts, parts, rows, strict=True):
            if words is None:
                out.append(self._encode([text])[0])
                continue
            at = -1
            with contextlib.suppress(ValueError):  # when none is left
                while True:
                    at = row.index(None, at + 1)
                    row[at] = get(words[at])
            out.append(b"".join(row))
        return out

    def _learn(self) -> None:
        """The ids of the new chunks. Signs after a letter are a token of their own: what stands before them is looked up without them."""
        known, pairs = self.known, []
        chunks, known.new = known.new, set()
        for w in chunks:
            if w[-1] in TAIL:
                bare = w.rstrip(TAIL)
                if bare and bare[-1].isalpha() and bare[-1].lower()[-1].isalpha():
                    pairs.append((w, bare, w[len(bare) :]))
        whole = chunks.difference([w for w, _, _ in pairs])
        for _, bare, tail in pairs:
            for part in (bare, tail):
                if known[part] is None:
                    whole.add(part)
        known.new = set()
        words = list(filter(str.isalpha, whole))
        rest = list(whole.difference(words))
        for k in range(0, len(words), 512):
            some = words[k : k + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                rest += some  # a word became several, as folding can make it, or the vocabulary marks no ends
                continue
            data = ids.tobytes()
            ends = (ends * 4).tolist()
            known.update(zip(some, map(data.__getitem__, map(slice, [0, *ends], ends)), strict=False))
        known.update(zip(rest, self._encode(rest), strict=True))
        for w, bare, tail in pairs:
            known[w] = known[bare] + known[tail]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder_of(path: str) -> ChunkEncoder:
    """The worker's encoder of a vocabulary, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def place(demands: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Bins of row numbers of demands (tokens, segments, loss), by the dot-product heuristic."""
    share = demands / limits
    order = np.argsort(-share.sum(1), kind="stable")
    share, whole = share[order], demands[order]
    alive = np.ones(len(order), bool)
    bins, first = [], 0
    while first < len(order):
        if not alive[first]:
            first += 1
            continue
        left = limits.copy()
        held, k = [], first
        while k >= 0:
            held.append(int(order[k]))
            alive[k] = False
            left = left - whole[k]
            fits = alive[first:] & (whole[first:] <= left).all(1)
            if not fits.any():
                break
            worth = np.where(fits, share[first:] @ (left / limits), -1.0)
            k = first + int(worth.argmax())
        bins.append(held)
    return bins


def _packed(tokenizer_path: str, limits: np.ndarray, id_type: pa.DataType):
    """Batches of doc_id, text (and prompt_tokens) -> pieces with their places."""

    schema = pa.schema([("doc_id", id_type), *_REST])

    def work(batches):
        encode = encoder_of(tokenizer_path).encode
        base, counter = TaskContext.get().partitionId() << 33, 0
        waiting: list[tuple] = []
        capacity = int(min(limits[0], limits[2]))

        def flush():
            nonlocal counter
            out = [[] for _ in schema]
            demands = np.array([[len(p[2]) // 4, 1, p[4]] for p in waiting], np.int64)
            for held in place(demands, limits):
                offset = 0
                for k in held:
                    doc, start, ids, tokens, loss = waiting[k]
                    for column, value in zip(out, (doc, start, ids, tokens, loss, base + counter, offset), strict=True):
                        column.append(value)
                    offset += len(ids) // 4
                counter += 1
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

        end = np.array([END], "<u4").tobytes()
        for batch in slices(batches, "text", rows=512, max_bytes=2 << 20):
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            prompts = batch.column("prompt_tokens").to_pylist()
            for doc, ids, prompt in zip(batch.column("doc_id").to_pylist(), encode(texts), prompts, strict=True):
                ids += end
                tokens = len(ids) // 4
                for start in range(0, tokens, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    n = len(piece) // 4
                    waiting.append((doc, start, piece, tokens, n - min(n, max(0, (prompt or 0) - start))))
                    if len(waiting) >= BLOCK_PIECES:
                        yield flush()
        if waiting:
            yield flush()

    return work


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", prompt_tokens: str | None = None, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss_tokens: int | None = None) -> DataFrame:
    """A row per piece: doc_id, start, ids (little-endian 32-bit), doc_tokens, loss_tokens, sequence_id, offset.

    prompt_tokens names a column with the tokens at a document's start that bear no loss; none: all bear it."""
    limits = np.array([capacity, max_segments, capacity if max_loss_tokens is None else max_loss_tokens], np.int64)
    if (limits < 1).any():
        raise ValueError("limits are at least 1")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.col(prompt_tokens).cast("long") if prompt_tokens else F.lit(None).cast("long")).alias("prompt_tokens"))
    id_type = docs.schema[doc_id].dataType
    rest = [T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n, _ in _REST]
    return arrow_map(rows, _packed(tokenizer_path, limits, to_arrow_type(id_type)), T.StructType([T.StructField("doc_id", id_type), *rest]))
