"""Language identification by segmentation-marginalised unigrams.

Each language has its own probabilities over the pieces of a fixed public
vocabulary.  The score of a word is the probability of all its segmentations into
pieces together, summed by a forward pass; a text's score is the product over its
words.  The piece probabilities are learnt by expectation maximisation (forward and
backward over all segmentations) from all words of at most ``FIT_DOCS`` different
texts per language, of at most ``FIT_LANGUAGES`` languages (those with the most
labelled rows).  The texts are those with the lowest hash among the labelled rows
that are not held out, so neither a repeated id nor a repeated text can crowd out
others.

A row is held out when crc32 of its doc_id as text is divisible by ``FOLDS`` (a null
id counts as the empty text).  Words are lower-case stretches of letters, of any
length.

Edge cases: a null text, or one without a letter, gets ``und`` and score 0; rows
without a label are not learnt from; with nothing to learn from, every text gets
``und``; ties go to the language that sorts first; repeated documents each get their
row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import Keyed, Texts, Trie, Words, as_texts, resident, two_columns, with_columns_from

FIT_DOCS, FIT_LANGUAGES, FIT_ROUNDS, FOLDS = 200, 200, 3, 5
FLOOR = 1e-8  # of a letter for which the vocabulary has no piece
MAX_MEMO, MAX_MEMO_BYTES = 120_000, 8 << 20  # words remembered, and their bytes
LONG_WORD = 256  # bytes beyond which a word is not remembered
LOCKSTEP = 28  # letters up to which no product can underflow
CELLS = 8 << 20  # of words times languages that are handled at a time
UNKNOWN = "und"

_LOWER = np.asarray([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_START = "▁"


def raw_words(raw: np.ndarray, bounds: np.ndarray) -> Words:
    """Words up to the letters test and the full lower-casing, which are done once per different word."""
    low = _LOWER[raw]
    return Words(low, bounds, low != 32)


def letter_runs(raw: bytes) -> list[str]:
    return [raw.decode()] if raw.isascii() else _LETTERS.findall(raw.decode().lower())


def vocabulary(path: str | None = None) -> set[str]:
    """The vocabulary's pieces that lower-case words can be made of."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))}
    return {p for p in pieces if (b := p.removeprefix(_START)) and regex.fullmatch(r"[\p{L}\p{M}]+", b) and b == b.lower()}


class Lattice:
    """All segmentations of some words: arcs from place to place, sorted by their end within the word, then by word."""

    def __init__(self, words: list[str], trie: Trie, singles: set[str], floor: int):
        """``singles``: letters that are pieces; other letters get the arc ``floor``."""
        coded = [(_START + w).encode() for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        joined = b"".join(coded)
        data = np.frombuffer(joined, np.uint8).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(sizes)), sizes)
        letters = np.flatnonzero((data & 0xC0) != 0x80)
        begin, length, piece = trie.arcs(data, (first + sizes)[word], letters)
        known = np.fromiter((c in singles for c in joined.decode()), bool, len(letters))
        other = np.diff(letters, append=len(data))[~known]
        begin, length = np.concatenate([begin, letters[~known]]), np.concatenate([length, other])
        piece = np.concatenate([piece, np.full(len(other), floor)])
        owner = word[begin]
        target = begin + length + owner  # a place before each byte, and one at the end of each word
        place = begin + length - first[owner]
        order = np.lexsort((target, place))
        self.source, self.target, self.piece, self.word, place = (begin + owner)[order], target[order], piece[order], owner[order], place[order]
        self.places = len(data) + len(sizes)
        self.first, self.last = first + np.arange(len(sizes)), first + sizes + np.arange(len(sizes))
        cuts = np.flatnonzero(np.diff(place, prepend=-1)).tolist()
        #: Ranges of arcs that end at the same distance from the word's begin.
        self.steps = list(zip(cuts, [*cuts[1:], len(place)], strict=True))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Each word's probability per column of ``p``: sums of products."""
        alpha = np.zeros((self.places, p.shape[1]))
        alpha[self.first] = 1.0
        for a, b in self.steps:
            target = self.target[a:b]
            head = np.flatnonzero(np.diff(target, prepend=-1))
            alpha[target[head]] = np.add.reduceat(alpha[self.source[a:b]] * p[self.piece[a:b]], head)
        return alpha[self.last]

    def _summed(self, values: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
        """out[at] = log of the sum of exp(values), where equal ``at`` stand together."""
        head = np.flatnonzero(np.diff(at, prepend=-1))
        top = np.maximum.reduceat(values, head)
        group = np.cumsum(np.diff(at, prepend=-1) != 0) - 1
        out[at[head]] = top + np.log(np.add.reduceat(np.exp(values - top[group]), head))

    def log_forward(self, logp: np.ndarray) -> np.ndarray:
        """The same in logarithms, for words of any length; the value of every place."""
        alpha = np.full((self.places, logp.shape[1]), -np.inf)
        alpha[self.first] = 0.0
        for a, b in self.steps:
            self._summed(alpha[self.source[a:b]] + logp[self.piece[a:b]], self.target[a:b], alpha)
        return alpha

    def expected(self, logp: np.ndarray, times: np.ndarray) -> np.ndarray:
        """How often each piece is used, over all segmentations of all words (one E step)."""
        alpha = self.log_forward(logp[:, None])[:, 0]
        beta = np.full(self.places, -np.inf)
        beta[self.last] = 0.0
        # Backwards, an arc's value is needed before those of arcs that end where it begins.
        order = np.lexsort((self.source, self.first[self.word] - self.source))
        place = (self.source - self.first[self.word])[order]
        cuts = np.flatnonzero(np.diff(place, prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(place)], strict=True):
            some = order[a:b]
            self._summed(beta[self.target[some]] + logp[self.piece[some]], self.source[some], beta)
        share = np.exp(alpha[self.source] + logp[self.piece] + beta[self.target] - alpha[self.last][self.word])
        return np.bincount(self.piece, share * times[self.word], len(logp))


class Model:
    """Piece probabilities of all languages, as one tuple per piece."""

    def __init__(self, languages: list[str], pieces: dict[str, tuple[float, ...]]):
        self.languages, self.pieces = languages, pieces
        self._trie: Trie | None = None

    def _prepare(self) -> None:
        k = len(self.languages)
        self._table = np.asarray([*self.pieces.values(), (FLOOR,) * k]).reshape(-1, k)
        self._singles = {p for p in self.pieces if len(p) == 1}
        self._trie = Trie([p.encode() for p in self.pieces])

    def words(self, words: list[str]) -> np.ndarray:
        """The log-probability of each word in each language; the forward passes of many words go on together."""
        if self._trie is None:
            self._prepare()
        out = np.empty((len(words), len(self.languages)))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        some = max(1, min(5_000, CELLS // 64 // max(1, len(self.languages))))
        for short in (True, False):
            which = np.flatnonzero((sizes <= LOCKSTEP) == short)
            which = which[np.argsort(sizes[which], kind="stable")]
            begin = 0
            while begin < len(which):
                end = begin + some if short else begin + max(1, int(np.searchsorted(np.cumsum(sizes[which[begin:]]), some * 8)))
                part = which[begin:end]
                lattice = Lattice([words[k] for k in part.tolist()], self._trie, self._singles, len(self._table) - 1)
                out[part] = np.log(lattice.forward(self._table)) if short else lattice.log_forward(np.log(self._table))[lattice.last]
                begin = end
        return out

    def word(self, word: str) -> list[float]:
        """The log-probability of one word in each language."""
        return self.words([word])[0].tolist()


def fit(words: dict[str, Counter], vocab: set[str], rounds: int = FIT_ROUNDS, smooth: float = 0.05) -> Model:
    """EM per language, from counts of its words."""
    pieces = sorted(vocab)
    trie, singles = Trie([p.encode() for p in pieces]), {p for p in pieces if len(p) == 1}
    found = []
    for lang in sorted(words):
        different = sorted(words[lang], key=lambda w: (len(w), w))
        times = np.asarray([words[lang][w] for w in different], float)
        parts = []
        for a in range(0, len(different), 20_000):
            parts.append((Lattice(different[a : a + 20_000], trie, singles, len(pieces)), times[a : a + 20_000]))
        got = sum(np.bincount(x.piece, t[x.word], len(pieces) + 1) for x, t in parts)[:-1]  # to begin with, every arc counts
        for _ in range(rounds):
            with np.errstate(divide="ignore"):
                logp = np.log(np.append(got / max(got.sum(), 1e-300), FLOOR))
            got = sum(x.expected(logp, t) for x, t in parts)[:-1]
        found.append((got + smooth) / (got.sum() + smooth * len(pieces)))
    languages = sorted(words)
    return Model(languages, dict(zip(pieces, map(tuple, np.stack(found, 1).tolist()), strict=True)) if languages else {})


def held_out(id_col, folds: int = FOLDS):
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocab_path: str | None = None, fit_docs: int = FIT_DOCS, fit_languages: int = FIT_LANGUAGES, folds: int = FOLDS) -> Model:
    """Learn from a bounded sample per language.  Only counts of languages and the sampled texts reach the driver."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id"), folds)).select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("texts")).orderBy(F.desc("n"), "lang").limit(fit_languages).collect()
    if not sizes:
        return Model([], {})
    # About three times fit_docs different texts per language are expected, the limit bounds them.
    place = F.pmod("h", F.lit(1 << 40))
    least = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, int(min(1.0, 3.0 * fit_docs / max(1, r.texts)) * (1 << 40)))])
    few = rows.filter(place < F.coalesce(F.try_element_at(least, F.col("lang")), F.lit(0))).groupBy("lang", "h").agg(F.min("text").alias("text"))
    few = few.orderBy(place, "lang", "h").limit(6 * fit_docs * len(sizes)).collect()
    words: dict[str, Counter] = {}
    for lang in sorted(r.lang for r in sizes):
        counts: Counter = Counter()
        for text in [r.text for r in few if r.lang == lang][:fit_docs]:
            raw = np.frombuffer(text.encode(), np.uint8)
            which, different = raw_words(raw, np.asarray([0, len(raw)])).distinct()
            for times, x in zip(np.bincount(which, minlength=len(different)).tolist(), different, strict=True):
                for w in letter_runs(x):
                    counts[w] += times
        words[lang] = counts
    return fit({k: v for k, v in words.items() if v}, vocabulary(vocab_path))


class Scorer:
    """Texts to language and score, with the words seen so far remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.at: dict[bytes, int] = {}
        self.held = self.used = 0
        #: Per word that was seen, the number of its letter runs, and the sum of their log-probabilities per language.
        self.rows = np.zeros((1024, len(self.model.languages) + 1))

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The row of each of some different words, after those that are new have been added."""
        known = np.fromiter((self.at.get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(known < 0)
        if not len(missing):
            return known
        new = [words[k] for k in missing.tolist()]
        runs = [letter_runs(w) for w in new]
        begin, sizes = self.used, np.fromiter(map(len, runs), np.int64, len(runs))
        while begin + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[begin : begin + len(new)] = 0
        self.rows[begin : begin + len(new), 0] = sizes
        np.add.at(self.rows[:, 1:], begin + np.repeat(np.arange(len(new)), sizes), self.model.words([w for r in runs for w in r]))
        self.used += len(new)
        known[missing] = range(begin, self.used)
        short = [(w, k) for k, w in enumerate(new, begin) if len(w) <= LONG_WORD]
        self.at.update(short)
        self.held += sum(len(w) for w, _ in short)
        return known

    def __call__(self, texts: Texts | list[str | None]) -> tuple[list[str], list[float]]:
        texts = as_texts(texts)
        languages, n = self.model.languages, len(texts)
        if not languages:
            return [UNKNOWN] * n, [0.0] * n
        if self.used > max(1000, min(MAX_MEMO, 4 * CELLS // len(languages))) or self.held > MAX_MEMO_BYTES:
            self.reset()
        words = raw_words(texts.raw, texts.bounds)
        which, different = words.distinct()
        number = self._numbers(different)[which]
        sums, owner = np.zeros((n, len(languages) + 1)), np.repeat(np.arange(n), np.diff(words.bounds))
        step = max(1, CELLS // (len(languages) + 1))
        for a in range(0, len(number), step):
            mine = owner[a : a + step]
            head = np.flatnonzero(np.diff(mine, prepend=-1))
            sums[mine[head]] += np.add.reduceat(self.rows[number[a : a + step]], head)
        has = sums[:, 0] > 0
        mean = sums[:, 1:] / np.where(has, sums[:, 0], 1)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        best = p.argmax(1)
        score = np.where(has, p[np.arange(n), best] / p.sum(1), 0.0)
        return [languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), has.tolist(), strict=True)], score.tolist()


def with_language(df: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """All columns of ``df`` and lang_pred, score; one narrow pass.  The model's size is that of the vocabulary times the languages."""
    held = Keyed(df.sparkSession.sparkContext.broadcast(model))

    def make():
        score = resident(("language", held), lambda: Scorer(held.value))

        def work(texts):
            langs, scores = score(texts)
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

        return work

    return with_columns_from(df, text_col, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make, keep_text)


def language_id(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score per row; the score is the best language's share of the mean word probability."""
    rows = with_language(two_columns(docs, id_col, text_col), model, keep_text=False)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
