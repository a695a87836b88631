"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is parsed greedily from left to
right: each phrase is the longest string at that place which the language's sample contains (one symbol if it
contains none). A language's figure is phrases x log2(sample length) / symbols, an estimate of the
cross-entropy in bits a symbol; the language with the least wins.

Symbols: one for all that stands between words, one for each of the `MAX_LETTERS` commonest letters of the samples, and for
any other letter the five hexadecimal digits of its code point, a symbol each, so that no two letters are one.
Texts are parsed whole. For speed they are cut into blocks of BLOCK symbols that are parsed side by side as if each began anew;
then every block is entered once more in the state that the one before it ends in, until both ways meet, which they
do after a phrase or two. The phrases are those of one parse from end to end.

What is learned from is a bounded sample of whole rows, all bounds being parameters of `fit`: `docs_per_language` rows of each language (those
of least hash), of which whole texts are taken as long as they fit into `symbols_per_language`, or into the language's share of
`symbols_in_all` where there are many languages. Texts over `max_chars` are drawn only where a language has no others; they are cut to it.

Defined results: a null text, or one without letters, is `und` with score 0. Ties go to the language that sorts
first. Repeated rows get equal results. Without any labelled row every text is `und`. Columns of the input
other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, record_batch, slices

#: Bounds of what is learned from: rows of a language, characters of a text, symbols of a language, symbols in all.
DOCS_PER_LANGUAGE, MAX_CHARS, SYMBOLS_PER_LANGUAGE, SYMBOLS_IN_ALL = 96, 4096, 40_960, 262_144
MAX_LETTERS, DIGITS = 100, 5
#: Symbols of a block, and cells that the parse of many blocks side by side keeps.
BLOCK, CELLS = 512, 8 << 20
UNDETERMINED = "und"


def automaton(symbols, width: int) -> np.ndarray:
    """The suffix automaton of symbols as a table state x symbol -> state; -1 where there is no way on."""
    goto = [-1] * (2 * max(1, len(symbols)) * width)
    link, length, last = [-1], [0], 0
    for c in symbols:
        here = len(length)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and goto[p * width + c] < 0:
            goto[p * width + c] = here
            p = link[p]
        if p >= 0:
            q = goto[p * width + c]
            if length[q] == length[p] + 1:
                link[here] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                goto[twin * width : (twin + 1) * width] = goto[q * width : (q + 1) * width]
                while p >= 0 and goto[p * width + c] == q:
                    goto[p * width + c] = twin
                    p = link[p]
                link[q] = link[here] = twin
        last = here
    return np.array(goto[: len(length) * width], np.int32).reshape(-1, width)


def parser(goto: np.ndarray) -> np.ndarray:
    """The table that parses: a symbol leads to 2 x next state, plus 1 where a new phrase begins with it.

    The last state stands for a phrase of one symbol that the sample lacks."""
    states, width = goto.shape
    lone = states
    begin = np.where(goto[0] >= 0, goto[0], lone)
    table = np.where(goto >= 0, 2 * goto, 2 * begin + 1)
    table[0] = 2 * begin
    return np.vstack([table, 2 * begin + 1]).astype(np.int32)


@lru_cache(maxsize=2)
def classes(letters: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of each code point its symbol (0 between words, then the letters, last all other letters) and the code point of its lower case.

    A worker makes it once."""
    own = {c: k for k, c in enumerate(letters, 1)}
    other = len(letters) + 1
    low = [c.lower()[0] if c.isalpha() else "" for c in map(chr, range(0x110000))]
    return np.array([own.get(c, other) if c else 0 for c in low], np.uint8), np.array([ord(c) if c else 0 for c in low], np.int32)


class Model:
    """Parsing tables of all languages one below the other, and the symbols of characters."""

    def __init__(self, samples: dict[str, list[str]], symbols_per_language: int = SYMBOLS_PER_LANGUAGE, symbols_in_all: int = SYMBOLS_IN_ALL):
        samples = {k: v for k, v in sorted(samples.items()) if any(any(map(str.isalpha, t)) for t in v)}
        self.languages = list(samples)
        seen = Counter(c.lower()[0] for texts in samples.values() for t in texts for c in t if c.isalpha())
        self.letters = tuple(c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:MAX_LETTERS])
        self.width = len(self.letters) + 17
        share = min(symbols_per_language, symbols_in_all // max(1, len(samples)))
        tables, self.starts, self.bits, above = [], [], [], 0
        for texts in samples.values():
            symbols = self._sample(texts, share)
            table = parser(automaton(symbols.tolist(), self.width))
            tables.append(table + 2 * above)
            self.starts.append(above * self.width)
            self.bits.append(float(np.log2(max(2, len(symbols)))))
            above += len(table)
        # A cell holds the offset of the next state's row, doubled, plus the mark of a new phrase.
        table = np.vstack(tables) if tables else np.zeros((1, self.width), np.int32)
        self.table = (((table >> 1) * self.width << 1) | (table & 1)).astype(np.int32).ravel()

    def _sample(self, texts: list[str], room: int) -> np.ndarray:
        """Whole texts in a row as long as they fit; the first alone is cut if it does not."""
        found, sizes = self.symbols([t + "\n" for t in texts])
        ends = np.cumsum(sizes)
        parts = [found[: min(room, sizes[0])]]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if b - a <= room - sum(map(len, parts)):
                parts.append(found[a:b])
        return np.concatenate(parts)

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, what is not a letter run together as one 0, and how many each text has."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        symbol_of, low = classes(self.letters)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        found = symbol_of[points]
        ends = np.cumsum(lengths)
        before = np.zeros(len(found), np.uint8)
        before[1:] = found[:-1]
        begins = (ends - lengths)[lengths > 0]
        before[begins] = 0
        other = len(self.letters) + 1
        places = np.where(found == other, DIGITS, (found > 0) | (before > 0))
        upto = np.concatenate([[0], np.cumsum(places)])
        out = np.repeat(found, places)
        rare = np.flatnonzero(found == other)
        if len(rare):
            for k in range(DIGITS):
                out[upto[rare] + k] = other + ((low[points[rare]] >> 4 * (DIGITS - 1 - k)) & 15)
        return out, upto[ends] - upto[ends - lengths]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by language and text, and the symbols of each text."""
        symbols, sizes = self.symbols(texts)
        blocks = -(-sizes // BLOCK)
        text = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * BLOCK
        length = np.minimum(BLOCK, np.repeat(sizes, blocks) - nth * BLOCK)
        counts = np.repeat((sizes > 0).astype(np.int64)[None], len(self.languages), 0)
        entered = np.array(self.starts, np.int64)
        step = max(1, CELLS // (BLOCK * max(1, len(self.languages))))
        for at in range(0, len(text), step):
            some = slice(at, at + step)
            marks, entered = self._parse(symbols, start[some], length[some], nth[some] > 0, entered)
            counts += np.stack([np.bincount(text[some], row, len(texts)) for row in marks]).astype(np.int64)
        return counts, sizes

    def _parse(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, follows: np.ndarray, entered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New phrases by language and block, and the states after the last block.

        follows: whether a block goes on where the one before it ends; the first then begins in the states `entered`."""
        m, roots = len(start), np.array(self.starts, np.int64)[:, None]
        # Blocks by falling length, so that those still going are always the first.
        order = np.argsort(-length, kind="stable")
        place = np.argsort(order, kind="stable")
        s, longest = start[order], int(length.max())
        active = np.searchsorted(-length[order], -np.arange(1, longest + 1), side="right")
        state = np.repeat(roots, m, 1)
        marks = np.zeros((len(roots), m), np.int64)
        cells = np.empty((longest, len(roots), m), np.int32)
        for t in range(longest):
            k = int(active[t])
            cell = self.table[state[:, :k] + symbols[s[:k] + t]]
            cells[t, :, :k] = cell
            marks[:, :k] += cell & 1
            state[:, :k] = cell >> 1
        alone, marks = state[:, place], marks[:, place]
        ends, more = alone.copy(), np.zeros_like(marks)
        first = np.concatenate([entered[:, None], alone[:, :-1]], 1)
        lang, block = np.nonzero(np.repeat(follows[None], len(roots), 0))
        while len(block):
            added, left = np.zeros(len(block), np.int64), alone[lang, block]
            live, here = np.arange(len(block)), first[lang, block]
            for t in range(longest):
                b = block[live]
                cell, own = self.table[here + symbols[start[b] + t]], cells[t, lang[live], place[b]]
                added[live] += (cell & 1) - (own & 1)
                here = (cell >> 1).astype(np.int64)
                apart, last = here != own >> 1, length[b] == t + 1
                left[live[apart & last]] = here[apart & last]
                live, here = live[apart & ~last], here[apart & ~last]
                if not len(live):
                    break
            more[lang, block] = added
            # Where a block ends otherwise than was taken for granted, the next one is entered anew.
            again = (left != ends[lang, block]) & (block + 1 < m)
            again[again] = follows[block[again] + 1]
            ends[lang, block] = left
            lang, block = lang[again], block[again] + 1
            first[lang, block] = ends[lang, block - 1]
        return marks + more, ends[:, -1]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits a symbol; the score is how far the best is ahead of the second, 0 to 1."""
        texts = ["" if t is None else t for t in texts]
        if not self.languages or not texts:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        counts, sizes = self.phrases(texts)
        bits = counts * np.array(self.bits)[:, None] / np.maximum(sizes, 1)
        best = bits.argmin(0)
        ranked = np.sort(bits, 0)
        some = sizes > 0
        ahead = 1 - ranked[0] / np.maximum(ranked[1], 1e-12) if len(ranked) > 1 else np.ones(len(texts))
        names = np.array(self.languages, object)[best]
        names[~some] = UNDETERMINED
        return names.tolist(), np.where(some, np.clip(ahead, 0, 1), 0.0), np.where(some, ranked[0], 0.0)


def fit(
    labelled: DataFrame, text: str = "text", lang: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE, max_chars: int = MAX_CHARS, symbols_per_language: int = SYMBOLS_PER_LANGUAGE, symbols_in_all: int = SYMBOLS_IN_ALL
) -> Model:
    """A model of the rows with a language, from a bounded sample of each language's texts.

    Rows are cut to the sample before the shuffle, so that a frequent language costs no more than a rare one."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.select("lang", F.xxhash64("text").alias("h"), (F.length("text") > max_chars).alias("long"), F.substring("text", 1, max_chars).alias("text"))
    first = Window.partitionBy("lang").orderBy("long", "h", "text")
    samples: dict[str, list[str]] = {}
    for row in rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= docs_per_language).orderBy("lang", "n").toLocalIterator():
        if not row.long or row.n == 1:
            samples.setdefault(row.lang, []).append(row.text)
    return Model({k: list(dict.fromkeys(v)) for k, v in samples.items()}, symbols_per_language, symbols_in_all)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, bits_per_symbol for each row of docs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pickle.dumps(model))

    def work(batches):
        found = pickle.loads(shared.value)
        for batch in slices(batches, "text", max_bytes=2 << 20):
            names, score, bits = found.predict(batch.column("text").to_pylist())
            yield record_batch(doc_id=batch.column("doc_id"), lang_pred=names, score=score, bits_per_symbol=bits)

    kind = docs.schema[doc_id].dataType.simpleString()
    return arrow_map(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), work, f"doc_id {kind}, lang_pred string, score double, bits_per_symbol double")
