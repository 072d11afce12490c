"""Language ID by unigram pieces, summed over all segmentations.

Words (runs of letters, lower case) are written in pieces of a fixed public vocabulary. Each language has a
probability for each piece; the probability of a word is the sum over all its segmentations, by a forward algorithm.
A text's score for a language is the sum over its words; the prediction is the best language, its score the posterior
under a uniform prior.

Piece probabilities are fitted by expectation-maximisation (the forward-backward sums over the same lattices) on a
bounded sample: at most `train_rows` documents for each language, those with the least digest of their key (an id on
several rows counts once and brings all its rows). Digests alone are ranked; the sample's texts are fetched by key,
its words counted and each language fitted on the executors. The driver sees the fitted probabilities only, whose
size is fixed by the vocabulary and the number of languages.

Scoring shuffles nothing and sends texts only one way, to Python. A worker remembers the scores of words in one matrix
of bounded size.

Edge cases: text that is null or holds no letter: `und`, score 0; no labelled rows: `und` for all; characters outside
the vocabulary cost a floor; rows with a null key are held out; repeated rows are scored each; an empty table gives
an empty table. Input columns with the names of output columns are replaced; the prefix `__ld_` is reserved. Very long
texts and words are learned from and scored whole.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, forget, keep_alone, quoted, without

ALNUM = re.compile(r"[^\W\d_]+")
START = "▁"
#: Words that a worker remembers, bytes of their scores, and words that are looked up together.
REMEMBERED, REMEMBERED_BYTES, TOGETHER = 400_000, 1 << 26, 50_000
FLOOR = 1e-7
OUT = ["held_out", "lang_pred", "score"]


def letters(text: str | None) -> list[str]:
    """Runs of letters, lower case."""
    out = ALNUM.findall((text or "").lower())
    if all(map(str.isalpha, out)):
        return out
    # numerals such as fractions are no letters
    return [w for x in out for w in "".join(c if c.isalpha() else " " for c in x).split()]


def vocabulary(path: str) -> list[str]:
    """Lower-case letter pieces of a public sentencepiece model; a leading mark means the start of a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if (bare := p.removeprefix(START)) and bare.isalpha() and bare == bare.lower()})


class Lattice:
    """All segmentations of words into pieces."""

    def __init__(self, pieces: list[str]):
        self.number = {p: i for i, p in enumerate(pieces)}
        self.prefixes = {p[:n] for p in pieces for n in range(1, len(p) + 1)}
        self.longest = max(map(len, pieces), default=1)

    def edges(self, word: str) -> list[list[tuple[int, int]]]:
        """For each place, the (end, piece) that begin there; -1 is the floor for a single character."""
        s, number, prefixes = START + word, self.number, self.prefixes
        out = []
        for i in range(len(s)):
            here, j = [], i + 1
            while j <= len(s) and (part := s[i:j]) in prefixes:
                if part in number:
                    here.append((j, number[part]))
                j += 1
            if not here or here[0][0] != i + 1:
                here.append((i + 1, -1))
            out.append(here)
        return out


def forward(edges: list[list[tuple[int, int]]], p: list[float]) -> float:
    """log of the sum over all segmentations; p[-1] is the floor."""
    n, shift, far = len(edges), 0.0, 0
    a = [0.0] * (n + 1)
    a[0] = 1.0
    for i, here in enumerate(edges):
        x = a[i]
        if x < 1e-150 and x > 0:  # the places still to be used are brought up
            shift += math.log(x)
            for j in range(i, far + 1):
                a[j] /= x
            x = 1.0
        for j, k in here:
            a[j] += x * p[k]
            far = max(far, j)
    return math.log(a[n]) + shift if a[n] > 0 else -700.0 + shift


def expected(edges: list[list[tuple[int, int]]], p: list[float]) -> list[tuple[int, float]]:
    """Expected uses of each piece over all segmentations of a word."""
    n = len(edges)
    a, b = [0.0] * (n + 1), [0.0] * (n + 1)
    a[0] = b[n] = 1.0
    for i, here in enumerate(edges):
        for j, k in here:
            a[j] += a[i] * p[k]
    if not a[n] > 1e-250:
        return expected_in_logs(edges, p)
    for i in range(n - 1, -1, -1):
        b[i] = sum(p[k] * b[j] for j, k in edges[i])
    return [(k, a[i] * p[k] * b[j] / a[n]) for i, here in enumerate(edges) for j, k in here if k >= 0]


def expected_in_logs(edges: list[list[tuple[int, int]]], p: list[float]) -> list[tuple[int, float]]:
    """The same for words whose probability is too small for a float."""
    n, log = len(edges), [math.log(x) for x in p]
    a, b = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    a[0] = b[n] = 0.0
    for i, here in enumerate(edges):
        for j, k in here:
            a[j] = np.logaddexp(a[j], a[i] + log[k])
    for i in range(n - 1, -1, -1):
        b[i] = np.logaddexp.reduce([log[k] + b[j] for j, k in edges[i]])
    return [(k, math.exp(a[i] + log[k] + b[j] - a[n])) for i, here in enumerate(edges) for j, k in here if k >= 0]


def fit(words: dict[str, int], pieces: list[str], rounds: int = 3, smooth: float = 0.05) -> np.ndarray:
    """Piece probabilities of a language from its word counts."""
    lattice = Lattice(pieces)
    counted = [(lattice.edges(w), c) for w, c in sorted(words.items())]
    # first guess: longer pieces are rarer, so that no segmentation wins by length alone
    p = np.array([10.0 ** (-1 - 0.7 * len(x.removeprefix(START))) for x in pieces])
    for _ in range(rounds):
        probabilities, uses = [*(p / p.sum()), FLOOR], np.full(len(pieces), smooth)
        for edges, c in counted:
            for k, x in expected(edges, probabilities):
                uses[k] += c * x
        p = uses / uses.sum()
    return p / p.sum()


class Scorer:
    """Scores words for all languages. Words that aren't remembered are scored together, by length."""

    def __init__(self, pieces: list[str], model: dict[str, np.ndarray]):
        self.langs = sorted(model)
        self.lattice = Lattice(pieces)
        self.p = [[*model[x].tolist(), FLOOR] for x in self.langs]
        self.table = np.array(self.p).T.copy() if self.langs else np.empty((0, 0))  # piece x language, the floor last
        # the prefix tree as sorted (state, character) keys
        states = {"": 0} | {x: i for i, x in enumerate(sorted(self.lattice.prefixes), 1)}
        keys = sorted((states[x[:-1]] << 21 | ord(x[-1]), i, self.lattice.number.get(x, -1)) for x, i in states.items() if i)
        self.keys, self.next, self.piece = (np.array(v, np.int64) for v in zip(*keys, strict=True))
        self.known: dict[str, int] = {}  # row of the matrix
        self.most = max(TOGETHER, min(REMEMBERED, REMEMBERED_BYTES // (8 * max(1, len(self.langs)))))
        self.matrix = np.zeros((self.most, len(self.langs)))

    def together(self, words: list[str]) -> np.ndarray:
        """Scores of words of one length."""
        n = len(words[0]) + 1
        letters = np.frombuffer("".join(START + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64).reshape(len(words), n)
        a = np.zeros((n + 1, len(words), len(self.langs)))
        a[0] = 1.0
        shift = np.zeros(a[0].shape)
        for i in range(n):
            if i and i % 20 == 0:  # the places still to be used are brought up
                window = slice(i, i + self.lattice.longest)
                top = np.maximum(a[window].max(axis=0), 1e-300)
                a[window] /= top
                shift += np.log(top)
            live, state = np.arange(len(words)), np.zeros(len(words), np.int64)
            single = np.zeros(len(words), bool)
            for j in range(i, n):
                want = state << 21 | letters[live, j]
                at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
                hit = self.keys[at] == want
                live, at = live[hit], at[hit]
                if not len(live):
                    break
                state, piece = self.next[at], self.piece[at]
                ends = piece >= 0
                rows = live[ends]
                a[j + 1, rows] += a[i, rows] * self.table[piece[ends]]
                if j == i:
                    single[rows] = True
            a[i + 1, ~single] += a[i, ~single] * FLOOR
        return np.log(np.maximum(a[n], 1e-300)) + shift

    def meet(self, words: set[str]) -> None:
        """Remembers the scores of words, TOGETHER at most."""
        new = words - self.known.keys()
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = words
        by: dict[int, list[str]] = defaultdict(list)
        for w in new:
            by[len(w)].append(w)
        for n, group in by.items():
            step = max(1, 250_000 // (n * max(1, len(self.langs))))
            for first in range(0, len(group), step):
                part = group[first : first + step]
                row = len(self.known)
                self.matrix[row : row + len(part)] = self.together(part)
                self.known.update(zip(part, range(row, row + len(part)), strict=True))

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the words' scores and numbers of words, by text."""
        sums, counts = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        words: list[str] = []
        owner: list[np.ndarray] = []

        def flush() -> None:
            self.meet(set(words))
            rows = self.matrix[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]
            of = np.concatenate(owner)
            first = np.flatnonzero(np.diff(of, prepend=-1))
            sums[of[first]] += np.add.reduceat(rows, first, axis=0)
            words.clear()
            owner.clear()

        for i, t in enumerate(texts):
            mine = letters(t)
            counts[i] = len(mine)
            while mine:
                part = mine[: TOGETHER - len(words)]
                mine = mine[len(part) :]
                words += part
                owner.append(np.full(len(part), i))
                if len(words) == TOGETHER:
                    flush()
        if words:
            flush()
        return sums, counts

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Best language and its posterior, by text."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        sums, counts = self.totals(texts)
        best = sums.argmax(axis=1)
        chance = 1.0 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[b] if n else "und" for b, n in zip(best.tolist(), counts.tolist(), strict=True)], np.where(counts > 0, chance, 0.0)


def learn(docs: DataFrame, path: str, text: str, lang: str, key: str, train_rows: int) -> tuple[list[str], dict[str, np.ndarray]]:
    """Vocabulary and piece probabilities from the bounded sample of rows that may be learned from."""
    told = quoted(key).cast("string")
    held = F.crc32(told.cast("binary")) % 5 == 0
    rows = docs.filter(~held & quoted(lang).isNotNull() & quoted(text).isNotNull()).select(quoted(lang).alias("lang"), told.alias("k"), quoted(text).alias("text"))
    order = Window.partitionBy("lang").orderBy(F.md5(F.col("k").cast("binary")), "k")
    ranked = rows.select("lang", "k").withColumn("n", F.dense_rank().over(order)).filter(F.col("n") <= train_rows)
    made: list[str] = []
    chosen = cut(ranked.select("lang", "k").distinct(), "langid-sample", made)
    sample = rows.join(chosen, ["lang", "k"], "left_semi")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for frame in frames:
            by: dict[str, Counter] = defaultdict(Counter)
            for x, t in zip(frame["lang"], frame["text"], strict=True):
                by[x].update(letters(t))
            flat = [(x, w, n) for x, c in by.items() for w, n in c.items()]
            yield pd.DataFrame(flat, columns=["lang", "word", "n"])

    pieces = vocabulary(path)

    def fitted(counts: pd.DataFrame) -> pd.DataFrame:
        forget()
        p = fit(dict(zip(counts["word"], counts["n"].tolist(), strict=True)), pieces)
        return pd.DataFrame({"lang": [counts["lang"].iloc[0]], "p": [p.tobytes()]})

    counts = sample.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    model = {r["lang"]: np.frombuffer(r["p"]) for r in counts.groupBy("lang").applyInPandas(fitted, "lang string, p binary").collect()}
    drop(docs.sparkSession, made)
    return pieces, dict(sorted(model.items()))


def teller(docs: DataFrame, path: str, text: str, lang: str, key: str, train_rows: int) -> Column:
    """A column struct<lang_pred, score>, learned from docs, for the rows of docs."""
    pieces, model = learn(docs, path, text, lang, key, train_rows)
    name = uuid.uuid4().hex
    # bounded by the vocabulary and the number of learned languages
    shared = docs.sparkSession.sparkContext.broadcast((pieces, model))

    def tell(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = keep_alone(("langid", name), lambda: Scorer(*shared.value))
        for part in parts:
            langs, scores = [], []
            for first in range(0, len(part), 256):
                got = scorer.scores(part.slice(first, 256).to_pylist())
                langs += got[0]
                scores.append(got[1])
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]))], names=["lang_pred", "score"])

    # said to be non-deterministic, so that a filter on the result doesn't score every text again
    return F.arrow_udf(tell, "struct<lang_pred:string,score:double>").asNondeterministic()(quoted(text))


def identify(docs: DataFrame, path: str, text: str = "text", lang: str = "lang", key: str = "doc_id", train_rows: int = 300) -> DataFrame:
    """All columns of docs, and held_out, lang_pred, score. See the module."""
    keep = without(docs, OUT)
    held = F.coalesce(F.crc32(quoted(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))
    told = teller(docs, path, text, lang, key, train_rows).alias("__ld_told")
    rows = docs.select(*[quoted(c) for c in keep], held.alias("held_out"), told)
    return rows.select(*[quoted(c) for c in keep], "held_out", "__ld_told.lang_pred", "__ld_told.score")


def accept(docs: DataFrame, path: str, least: float = 0.5, text: str = "text", lang: str = "lang", key: str = "doc_id", train_rows: int = 300) -> DataFrame:
    """The rows of docs whose language is told: not `und`, and a posterior of at least `least`."""
    told = docs.withColumn("__ld_told", teller(docs, path, text, lang, key, train_rows))
    return told.filter("__ld_told.lang_pred <> 'und'").filter(F.col("__ld_told.score") >= least).select(*[quoted(c) for c in docs.columns])
