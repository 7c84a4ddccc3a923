"""Language identification by unigrams marginalised over segmentations.

The pieces of a fixed public vocabulary get one probability per language, learned by
expectation maximisation. The probability of a word is the sum over all its
segmentations into pieces, by the forward algorithm; a text's is the product over its words, as no
piece reaches across words. The language of the largest posterior (equal priors) wins.

Learning reads at most about ``PER_LANG`` labelled documents of each language, all their words, in one pass over the
texts; scoring reads every whole text. Words are lower-cased runs of letters of any length: the sums are scaled
as they go, so a run of thousands of letters, as scripts without spaces have them, is one word like any other. Every distinct
word is scored once and remembered in a bounded cache.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if
nothing could be learned; equal posteriors go to the language first in order; rows with equal
texts have equal results; an empty table gives an empty table; columns other than the
ones named are not carried along.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Recent
from .common import documents, map_batches
from .rule_ensemble import remainder
from .sentence_pieces import MARK, default_model

PER_LANG, ROUNDS = 1500, 4
#: The probability of a character that no piece spells, and counts that every piece has to start with.
UNSEEN, PRIOR = 1e-7, 0.02
CACHE, ROWS = 200_000, 1000
#: Sums are scaled every so many characters; words longer than KEEP are not cached. Characters of a block of words, about.
STEP, KEEP, CELLS = 8, 100, 200_000
LETTERS = re.compile(r"[^\W\d_]+")


class Pieces:
    """A vocabulary as a trie: all pieces that start anywhere in blocks of words at once."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        plain = sorted({lib.id_to_piece(i).lower() for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))})
        plain = [p for p in plain if p == MARK or (q := p.lstrip(MARK)) and LETTERS.fullmatch(q) and len(p) - len(q) < 2]
        self.n = len(plain) + 1  # 0 stands for a character of no piece
        step: dict[tuple[int, int], int] = {}
        piece = [0]
        for k, p in enumerate(plain, 1):
            at = 0
            for c in p:
                at = step.setdefault((at, ord(c)), len(piece))
                if at == len(piece):
                    piece.append(0)
            piece[at] = k
        keys = np.array([(a << 21) | c for a, c in step], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = np.append(keys[order], 1 << 62), np.append(np.array(list(step.values()))[order], 0)
        self.piece = np.array(piece)
        self.longest = max(map(len, plain), default=1)

    def edges(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, rows, pieces) of every piece in equally long words, by their starts."""
        n, size = codes.shape
        for start in range(size):
            found = []
            rows, node = np.arange(n), np.zeros(n, np.int64)
            for end in range(start, size):
                key = (node << 21) | codes[rows, end]
                at = np.searchsorted(self.keys, key)
                live = self.keys[at] == key
                rows, node = rows[live], self.to[at[live]]
                if not len(rows):
                    break
                hit = self.piece[node] > 0
                if hit.any():
                    found.append((start, end + 1, rows[hit], self.piece[node[hit]]))
            one = np.ones(n, bool)
            if found and found[0][1] == start + 1:
                one[found[0][2]] = False
            if one.any():
                found.append((start, start + 1, np.flatnonzero(one), np.zeros(int(one.sum()), np.int64)))
            yield from found

    def blocks(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indexes and characters of words of one length."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            block = max(1, min(4096, CELLS // int(size)))
            for k in range(0, len(at), block):
                part = at[k : k + block]
                codes = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le"), "<u4")
                yield part, codes.reshape(len(part), size).astype(np.int64)


@functools.lru_cache(2)
def pieces_of(model_path: str) -> Pieces:
    return Pieces(model_path)


def forward(pieces: Pieces, codes: np.ndarray, p: np.ndarray, edges: Iterable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """alpha[row, position, language] of equally long words, and the logarithms of its scale; p[piece, language]."""
    n, size = codes.shape
    alpha, scale = np.zeros((n, size + 1, p.shape[1])), np.zeros((n, size + 1, p.shape[1]))
    alpha[:, 0] = 1
    due = STEP
    for a, b, rows, piece in edges if edges is not None else pieces.edges(codes):
        if a >= due:  # no sum before this place is needed any more, and all that are begun lie within the longest piece
            some = alpha[:, a : a + pieces.longest + 1]
            top = some.max(1, keepdims=True)
            some /= top
            scale[:, a] = np.log(top[:, 0])
            due = a + STEP
        alpha[rows, b] += alpha[rows, a] * p[piece]
    return alpha, np.cumsum(scale, 1)


def backward(pieces: Pieces, codes: np.ndarray, p: np.ndarray, edges: list) -> tuple[np.ndarray, np.ndarray]:
    """As ``forward``, from the ends of words."""
    n, size = codes.shape
    beta, scale = np.zeros((n, size + 1, p.shape[1])), np.zeros((n, size + 1, p.shape[1]))
    beta[:, size] = 1
    due = size - STEP
    for a, b, rows, piece in reversed(edges):
        if a < due:
            last = min(a + pieces.longest, size)
            some = beta[:, a + 1 : last + 1]
            top = some.max(1, keepdims=True)
            some /= top
            scale[:, last] += np.log(top[:, 0])
            due = a - STEP
        beta[rows, a] += beta[rows, b] * p[piece]
    return beta, np.cumsum(scale[:, ::-1], 1)[:, ::-1]


def learn(pieces: Pieces, counts: dict[str, dict[str, int]], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and probabilities of pieces by language."""
    langs = sorted(counts)
    p = np.full((pieces.n, len(langs)), 1.0 / pieces.n)
    p[0] = UNSEEN
    for k, lang in enumerate(langs):
        words = sorted(counts[lang])
        weight = np.array([counts[lang][w] for w in words], float)
        own, next_ = p[:, k : k + 1].copy(), None
        for _ in range(rounds):
            next_ = np.full(pieces.n, PRIOR)
            for part, codes in pieces.blocks(words):
                edges = list(pieces.edges(codes))
                alpha, up = (x[:, :, 0] for x in forward(pieces, codes, own, edges))
                beta, down = (x[:, :, 0] for x in backward(pieces, codes, own, edges))
                total = np.log(alpha[:, -1]) + up[:, -1]
                for a, b, rows, piece in edges:
                    share = alpha[rows, a] * own[piece, 0] * beta[rows, b] * np.exp(up[rows, a] + down[rows, b] - total[rows])
                    next_ += np.bincount(piece, share * weight[part[rows]], pieces.n)
            own[1:, 0] = next_[1:] / next_[1:].sum()
        p[:, k] = own[:, 0]
    return langs, p


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


class Scorer:
    def __init__(self, pieces: Pieces, p: np.ndarray) -> None:
        self.pieces, self.p, self.known = pieces, p, Recent(CACHE)
        self.scores = np.zeros((2 * CACHE, p.shape[1]))
        self.free = 0

    def learn_words(self, words: set[str]) -> None:
        new = self.known.missing(words)
        if self.free + len(new) > len(self.scores):  # rows of words that the cache has dropped are used again
            kept = list(dict.fromkeys((*self.known.old.values(), *self.known.young.values())))
            place = {k: i for i, k in enumerate(kept)}
            self.scores[: len(kept)] = self.scores[kept]
            for half in (self.known.old, self.known.young):
                half.update({w: place[k] for w, k in half.items()})
            self.free = len(kept)
            if self.free + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros((len(new), self.p.shape[1]))])
        marked = [MARK + w for w in new]
        for part, codes in self.pieces.blocks(marked):
            self.scores[self.free + part] = self.log_probability(codes)
        self.known.young.update(zip(new, range(self.free, self.free + len(new))))
        self.free += len(new)

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        alpha, scale = forward(self.pieces, codes, self.p)
        return np.log(alpha[:, -1]) + scale[:, -1]

    def predict(self, texts: list[str | None]) -> list[tuple[int, float]]:
        """Number of the language (-1: none) and its posterior."""
        if not self.p.shape[1]:
            return [(-1, 0.0)] * len(texts)
        words = [words_of(t) for t in texts]
        long = [[w for w in found if len(w) > KEEP] for found in words]
        words = [[w for w in found if len(w) <= KEEP] if own else found for found, own in zip(words, long)]
        self.learn_words(set().union(*words))
        get = self.known.young.__getitem__
        out = []
        for text, found, own in zip(texts, words, long):
            if not any(map(str.isalpha, text or "")):
                out.append((-1, 0.0))
                continue
            total = self.scores[np.fromiter(map(get, found), np.int64, len(found))].sum(0)
            for part, codes in self.pieces.blocks([MARK + w for w in own]):
                total = total + self.log_probability(codes).sum(0)
            best = int(total.argmax())
            out.append((best, float(1 / np.exp(total - total[best]).sum())))
        return out


def word_counts(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, word, n; summed in each batch before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols, [pa.string(), pa.string(), pa.int64()])], ["lang", "word", "n"])

    out = map_batches(df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), run, "lang string, word string, n long")
    return out.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, model_path: str | None = None, per_lang: int = PER_LANG, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Learn from rows with a language; samples by hashes of ids, so reruns agree.

    One pass over ids and languages counts rows, one over the texts counts the words of the sample.
    """
    known = df.where(F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not sizes:
        return [], np.zeros((1, 0))
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, per_lang / n) * (1 << 30)))))
    some = known.where(F.pmod(F.xxhash64(F.lit(5), F.col(id_col)), F.lit(1 << 30)) < share[F.col(lang_col)])
    counts: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
    for r in word_counts(some, lang_col, text_col).collect():
        counts[r["lang"]][MARK + r["word"]] = r["n"]
    return learn(pieces_of(model_path or default_model()), counts)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score``."""
    langs, p = model
    path, kind = model_path or default_model(), df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pieces_of(path), p)
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                found = scorer.predict(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([langs[i] if i >= 0 else "und" for i, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["id", "lang_pred", "score"])

    out = map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(remainder(3) != 1))
    return predict(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")
