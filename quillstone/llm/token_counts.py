"""Token counts of a byte-level BPE by finite-state transduction.

Two deterministic machines are composed.

*Splitter.*  The split pattern of the tokenizer is compiled to eight states over
nine symbols (a symbol is the class of a character, with the look-ahead of the
pattern folded in).  A batch of texts is cut into chunks of ``CHUNK`` characters.
All chunks advance in lockstep from *every* state at once, which gives for each
chunk a map from entry to exit state; the maps compose through a parallel prefix
scan (doubling), so that every chunk learns its entry state; a second lockstep
pass then marks where pieces begin.

*Piece transducer.*  It reads the bytes of a piece and keeps, per prefix, the last
token of the prefix's encoding and the number of tokens so far: a transition adds
one to the number of the prefix that the last token follows.  The last token of a
prefix is its longest suffix token that may follow the last token of what is before
it, where "may follow" means that the encoder leaves the two tokens apart.  The
trie of the tokens and the pairs tested so far are open-addressed tables in numpy.
The different pieces of a slice that were not seen before run in lockstep, one
position after the other.  Their counts are remembered in two generations of bounded
size.  A piece beyond ``LONG_PIECE`` bytes runs alone and leaves nothing behind: it
needs as many prefixes as the longest token has bytes, in a ring.

Edge cases: null and empty texts have 0 bytes and 0 tokens; the special strings
of the tokenizer inside a text count as one token each, as the library does by
default; lone surrogates cannot occur in Spark strings; texts of any length are
read whole; repeated rows and null ids stay, one result row per input row; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import IntMap, Memo, Texts, Trie, as_texts, distinct, resident, two_columns, with_columns_from

CHUNK = 64
LONG = 1 << 20  # characters beyond which a text is counted in parts
MAX_PAIRS = 600_000  # of tokens, whose test is remembered
MAX_MEMO, MAX_MEMO_BYTES = 300_000, 16 << 20  # pieces in each of two generations, and their bytes
LONG_PIECE = 256  # bytes beyond which nothing of a piece is kept
_NEVER = 1 << 60
_SHORT = (3, 2, 1)

# Symbols of the splitter and its states.
_L, _N, _O, _C2, _C3, _SP, _W1, _W, _END = range(9)
_FREE, _PREFIX, _LETTERS, _DIGITS, _OTHERS, _SPACES, _ONE_MORE, _TWO_MORE = range(8)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class (letter, number, space, other) of every code point, from the Unicode tables of ``regex``."""
    table = np.full(0x110000 + 1, _O, np.uint8)
    low, high = "".join(map(chr, range(0xD800))), "".join(map(chr, range(0xE000, 0x110000)))
    for pattern, code in ((r"\p{L}+", _L), (r"\p{N}+", _N), (r"[\p{White_Space}]+", _W)):
        for text, base in ((low, 0), (high, 0xE000)):
            for m in regex.finditer(pattern, text):
                table[base + m.start() : base + m.end()] = code
    table[0x110000] = _END
    return table


@lru_cache(maxsize=1)
def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and begin-of-piece flag, both indexed by state * 16 + symbol."""
    begin = {_L: _LETTERS, _N: _DIGITS, _O: _OTHERS, _C2: _ONE_MORE, _C3: _TWO_MORE, _SP: _PREFIX, _W1: _FREE, _W: _SPACES, _END: _FREE}
    go_on = {
        _PREFIX: {_L: _LETTERS, _N: _DIGITS, _O: _OTHERS, _C2: _OTHERS, _C3: _OTHERS},
        _LETTERS: {_L: _LETTERS},
        _DIGITS: {_N: _DIGITS},
        _OTHERS: {_O: _OTHERS, _C2: _OTHERS, _C3: _OTHERS},
        _SPACES: {_W: _SPACES},
        _ONE_MORE: {s: _FREE for s in range(8)},
        _TWO_MORE: {s: _ONE_MORE for s in range(8)},
    }
    nxt, first = np.zeros(128, np.uint8), np.zeros(128, bool)
    for state in range(8):
        for symbol in range(9):
            inside = go_on.get(state, {}).get(symbol)
            nxt[state * 16 + symbol] = begin[symbol] if inside is None else inside
            first[state * 16 + symbol] = inside is None
    return nxt, first


def _symbols(points: np.ndarray) -> np.ndarray:
    """Classes with the pattern's look-ahead folded in; 0x110000 ends a text."""
    sym = _classes()[points]
    one = np.append(points[1:], 0x110000)
    two = np.append(one[1:], 0x110000)
    space = (sym == _W) & (np.append(sym[1:], _END) < _W)  # followed by a character that is no space
    sym[space] = np.where(points[space] == 32, _SP, _W1)
    at = np.flatnonzero(points == 39)
    if at.size:
        a, b = one[at], two[at]
        sym[at[np.isin(a, [ord(c) for c in "stmd"])]] = _C2
        pair = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        sym[at[pair]] = _C3
    return sym


def piece_starts(points: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """A flag per character: a piece begins here.  Chunk maps compose by prefix scan."""
    nxt, first = _splitter()
    n = len(points)
    rows = -(-n // chunk)
    sym = np.full(rows * chunk, _END, np.uint8)
    sym[:n] = _symbols(points)
    columns = np.ascontiguousarray(sym.reshape(rows, chunk).T)
    maps = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in columns:
        maps = nxt.take((maps << 4) | column[:, None])
    step = 1
    while step < rows:  # maps[k] becomes the map over chunks 0..k
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = maps[:-1, _FREE]
    flags = np.empty((chunk, rows), bool)
    for k, column in enumerate(columns):
        at = (state << 4) | column
        flags[k] = first.take(at)
        state = nxt.take(at)
    return flags.T.reshape(-1)[:n]


def _byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PieceTransducer:
    """Bytes of one piece in, number of tokens out; see the module's docstring."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.tokens = list(dict.fromkeys([bytes([b]) for b in range(256)] + [a + b for a, b in merges]))
        self.number = {token: k for k, token in enumerate(self.tokens)}
        ends: dict[bytes, set[int]] = {}
        for token in self.tokens:
            ends.setdefault(token[-4:], set()).add(len(token))
        #: The lengths, longest first, of the tokens that end in four given bytes.
        self.lengths = {end: (*sorted(found, reverse=True), 3, 2, 1) for end, found in ends.items() if len(end) == 4}
        self.longest = max(map(len, self.tokens))
        self.trails: dict[int, tuple[list, list] | None] = {}
        self.sound = np.full(len(self.tokens), -1, np.int8)  # whether a token encodes to itself; -1: not known yet
        self.trie = Trie(self.tokens)
        self.pairs = IntMap(MAX_PAIRS)

    def _merge(self, parts: list[bytes]) -> tuple[list[bytes], int | None]:
        """Merge every occurrence of the pair that ranks first, from the left."""
        best, pair = min((self.rank.get(p, _NEVER), p) for p in zip(parts, parts[1:], strict=False))
        if best == _NEVER:
            return parts, None
        out, k = [], 0
        while k < len(parts):
            if k + 1 < len(parts) and parts[k] == pair[0] and parts[k + 1] == pair[1]:
                out.append(pair[0] + pair[1])
                k += 2
            else:
                out.append(parts[k])
                k += 1
        return out, best

    def _trail(self, number: int) -> tuple[list, list] | None:
        """The token's own merges as (rank, last part) and (rank, first part) after each; None if it does not encode to itself."""
        if number in self.trails:
            return self.trails[number]
        token = self.tokens[number]
        trail, parts = None, [token[k : k + 1] for k in range(len(token))]
        steps = [(-1, parts[-1], parts[0])]
        while len(parts) > 1:
            parts, rank = self._merge(parts)
            if rank is None:
                break
            steps.append((rank, parts[-1], parts[0]))
        if len(parts) == 1:
            end = [(_NEVER, b"", b"")]
            trail = [(r, x) for r, x, _ in steps + end], [(r, x) for r, _, x in steps + end]
        self.trails[number] = trail
        return trail

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether the encoder leaves two tokens side by side.

        Merges happen by rising rank, so both tokens' own merges interleave by rank; the
        tokens join if the pair of parts at the border ever ranks before what is next on
        the left, and not after what is next on the right (of equal pairs the left one
        merges first).
        """
        left, right = self.trails[a][0], self.trails[b][1]
        i = j = 0
        rank = self.rank
        while True:
            across = rank.get((left[i][1], right[j][1]), _NEVER)
            x, y = left[i + 1][0], right[j + 1][0]
            if across < x and across <= y and across < _NEVER:
                return False
            if x == y == _NEVER:
                return True
            if x <= y:
                i += 1
            else:
                j += 1

    def _follow(self, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether each token may follow the one before it."""
        keys = before.astype(np.int64) << 20 | tokens
        found = self.pairs.get(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            different, which = np.unique(keys[new], return_inverse=True)
            made = np.fromiter((self._stay_apart(k >> 20, k & 0xFFFFF) for k in different.tolist()), np.int32, len(different))
            found[new] = made[which]
            if self.pairs.used + len(different) > MAX_PAIRS:
                self.pairs = IntMap(MAX_PAIRS)
            self.pairs.put(different[:MAX_PAIRS], made[:MAX_PAIRS])
        return found > 0

    def _arcs(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, length and number of every sound token in ``data`` that does not pass the end given for its begin."""
        begin, length, token = self.trie.arcs(data, ends)
        for k in np.unique(token[self.sound[token] < 0]).tolist():
            self.sound[k] = self._trail(k) is not None
        sound = self.sound[token] > 0
        return begin[sound], length[sound], token[sound]

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """The number of tokens of each piece; none is empty."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.zeros(len(pieces), np.int64)
        for k in np.flatnonzero(sizes > LONG_PIECE).tolist():
            out[k] = self._count_long(pieces[k])
        for low, high in ((0, 24), (24, LONG_PIECE)):  # few positions for the many short ones
            some = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(some):
                out[some] = self._together(b"".join([pieces[k] for k in some.tolist()]), sizes[some])
        return out

    def _together(self, joined: bytes, sizes: np.ndarray) -> np.ndarray:
        """All pieces in lockstep: position after position, and at each the tokens that end there, longest first."""
        data = np.frombuffer(joined, np.uint8).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        piece = np.repeat(np.arange(len(sizes)), sizes)
        begin, length, token = self._arcs(data, (first + sizes)[piece])
        owner = piece[begin]
        end = begin + length
        order = np.lexsort((-length, end))
        begin, end, token, owner = begin[order], end[order], token[order], owner[order]
        head = np.flatnonzero(np.diff(end, prepend=-1))  # of the tokens that end at one place
        rank = np.arange(len(end)) - np.repeat(head, np.diff(head, append=len(end)))
        place = end - first[owner]
        step = place * (self.longest + 1) + rank
        order = np.argsort(step, kind="stable")
        begin, end, token, owner, step = begin[order], end[order], token[order], owner[order], step[order]
        source, target, opens = begin + owner, end + owner, begin == first[owner]  # a state before each byte and one at the end
        last, number = np.full(len(data) + len(sizes), -1, np.int64), np.zeros(len(data) + len(sizes), np.int64)
        cuts = np.flatnonzero(np.diff(step, prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(step)], strict=True):
            s, t, k = source[a:b], target[a:b], token[a:b]
            open_ = last[t] < 0
            s, t, k, o = s[open_], t[open_], k[open_], opens[a:b][open_]
            inner = np.flatnonzero(~o)
            ok = o.copy()
            ok[inner] = self._follow(last[s[inner]], k[inner])
            last[t[ok]] = k[ok]
            number[t[ok]] = number[s[ok]] + 1
        return number[first + sizes + np.arange(len(sizes))]

    def _count_long(self, data: bytes) -> int:
        """The same steps for one piece, with the last states, as tokens so far << 20 | number of the last one, in a ring."""
        number, trails, lengths = self.number.get, self.trails, self.lengths
        width = self.longest + 1
        ring = [0] * width
        apart: dict[int, bool] = {}
        for size in range(1, len(data) + 1):
            for n in lengths.get(data[size - 4 : size], _SHORT) if size >= 4 else _SHORT:
                if n > size:
                    continue
                token = number(data[size - n : size])
                if token is None or not (trails.get(token) or self._trail(token)):
                    continue
                before = ring[(size - n) % width]
                if n < size:
                    key = (before & 0xFFFFF) << 20 | token
                    ok = apart.get(key)
                    if ok is None:
                        if len(apart) > MAX_PAIRS:
                            apart.clear()
                        ok = apart[key] = self._stay_apart(key >> 20, token)
                    if not ok:
                        continue
                ring[size % width] = ((before >> 20) + 1) << 20 | token
                break
            else:
                raise AssertionError("a single byte is always a token")
        return ring[len(data) % width] >> 20


#: Between two letters, a space always begins a piece, whatever stands around them.
_SURE = regex.compile(r"(?<=\p{L}) (?=\p{L})")


def _in_parts(text: str, limit: int) -> list[str]:
    """The text in parts of about ``limit`` characters, cut where a piece surely begins."""
    parts, at = [], 0
    while len(text) - at > limit and (m := _SURE.search(text, at + limit)):
        parts.append(text[at : m.start()])
        at = m.start()
    return [*parts, text[at:]]


class Counter:
    """Counts of whole texts for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE without normaliser is needed")
        letters = _byte_letters()
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.pieces = PieceTransducer([(bytes(letters[c] for c in a), bytes(letters[c] for c in b)) for a, b in pairs])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.remembered = Memo(MAX_MEMO, MAX_MEMO_BYTES, LONG_PIECE)

    def __call__(self, texts: Texts | list[str | None]) -> np.ndarray:
        texts = as_texts(texts)
        parts: list[str] = []
        owner: list[int] = []
        out = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts.strings()):
            if not text:
                continue
            if self.special and "<|" in text:
                found = self.special.split(text)
                out[k] += len(found) - 1
            else:
                found = [text]
            if len(text) > LONG:
                found = [p for x in found for p in _in_parts(x, LONG)]
            parts += found
            owner += [k] * len(found)
        size = begin = 0
        for k, part in enumerate(parts):
            size += len(part)
            if size > LONG or k == len(parts) - 1:
                np.add.at(out, np.asarray(owner[begin : k + 1]), self._count(parts[begin : k + 1]))
                size, begin = 0, k + 1
        return out

    def _count(self, parts: list[str]) -> np.ndarray:
        """Tokens of each part."""
        joined = "\0".join([*parts, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes + 1) - 1
        points[ends] = 0x110000
        flags = piece_starts(points)
        flags[ends] = True
        starts = np.flatnonzero(flags)
        raw = np.frombuffer(joined.encode(), np.uint8)
        places = np.flatnonzero((raw & 0xC0) != 0x80)  # the first byte of each character
        bounds = np.append(places[starts], len(raw))
        real = points[starts] != 0x110000
        kept = np.ones(len(raw), bool)
        kept[places[ends]] = False
        which, pieces = distinct(raw[kept], np.diff(bounds)[real])
        counts = self.remembered(pieces, self.pieces.counts)[which]
        part = np.searchsorted(ends, starts[real])
        return np.bincount(part, counts, len(parts)).astype(np.int64)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def counter(path: str | None) -> Counter:
    """One counter per worker process; the file is found where the worker runs."""
    return resident(("counter", path), lambda: Counter(path or default_path()))


def with_token_counts(df: DataFrame, text_col: str = "text", path: str | None = None, keep_text: bool = True) -> DataFrame:
    """All columns of ``df`` and ``n_bytes``, ``n_tokens``; one narrow pass, no shuffle."""

    def make():
        count = counter(path)

        def work(texts: Texts):
            return [pa.array(np.diff(texts.bounds)), pa.array(count(texts))]

        return work

    return with_columns_from(df, text_col, [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())], make, keep_text)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row."""
    return with_token_counts(two_columns(df, id_col, text_col), "text", path, keep_text=False).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
