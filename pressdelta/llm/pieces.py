"""SentencePiece encoding and decoding by suffix-array matching.

The words of a batch that are new are joined into one text, whose suffix array is sorted
as deep as the longest piece by prefix doubling. Every piece of the vocabulary then
narrows its range of suffixes one character at a time, all pieces at once; the ranges
give every occurrence of every piece as an edge of a lattice. Edges are sorted by
position and relaxed from left to right.

For a unigram model relaxing means the best sum of scores. A BPE model has no such sum:
there the last piece of the encoding of a prefix is the one that is compatible with the
last piece before it, two pieces being compatible if merging their joined text gives
them back. Both are exact.
"""

from __future__ import annotations

import re
import struct
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import required

#: Characters encoded at once, characters of one suffix array, and words and pairs of pieces that a process remembers.
WINDOW, JOINED, MEMORY = 1 << 22, 1 << 18, 1_000_000
#: Longest word that is relaxed together with others.
LONGEST = 48
SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            size = varint() if size is None else size
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class PieceModel:
    """A SentencePiece model file: pieces, scores and the flags that encoding needs."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.types = [], [], []
        self.kind, self.byte_fallback, self.prefix, self.squeeze, self.unk = UNIGRAM, False, True, True, 0
        rules, charsmap = "", b""
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode("utf-8"))
                self.scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                self.kind, self.byte_fallback, self.unk = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), trainer.get(40, 0)
            elif number == 3:
                norm = dict(_fields(value))
                rules, charsmap = norm.get(1, b"").decode(), norm.get(2, b"")
                self.prefix, self.squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        if self.kind not in (UNIGRAM, BPE) or charsmap or USER in self.types or UNUSED in self.types:
            raise ValueError(f"unsupported model: kind {self.kind}, normaliser {rules or 'none'}, or user-defined or unused pieces")
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        #: Words may be cut before a space mark if no piece has one after another character.
        #: A line end without a piece of its own is in no piece, so it stands alone.
        line = "" if any("\n" in p for p in self.ids) else "\n"
        whole = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.words = re.compile("(?s).+" if whole else f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + "|\n" * bool(line))
        spelled = {UNKNOWN: " ⁇ ".encode(), CONTROL: b""}
        self.spelled = [bytes([int(p[3:5], 16)]) if t == BYTE else spelled.get(t, p.encode("utf-8")) for p, t in zip(self.pieces, self.types, strict=True)]
        order = sorted(self.ids)
        self.numbers = np.array([self.ids[p] for p in order])
        self.lengths = np.array([len(p) for p in order])
        self.deepest = int(self.lengths.max())
        self.letters = np.full((len(order), self.deepest), -1, dtype=np.int64)
        for i, p in enumerate(order):
            self.letters[i, : len(p)] = [ord(c) for c in p]
        self.together: dict[tuple[int, int], bool] = {}
        self.pairs, self.fits = np.array([np.iinfo(np.int64).max]), np.array([False])  # the same, sorted for whole arrays
        self.known: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.least = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0

    def normalize(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return SPACE + text.replace(" ", SPACE) if self.prefix and text else text.replace(" ", SPACE)

    def unknown(self, char: str) -> list[int]:
        """The pieces of a character that the vocabulary lacks."""
        if self.byte_fallback and len(self.bytes) == 256:
            return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]
        return [self.unk]

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: merge the best pair, the leftmost of equals, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                number = self.ids.get(parts[i] + parts[i + 1])
                if number is not None and (best is None or self.scores[number] > best):
                    best, where = self.scores[number], i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.together.get(key)
        if known is None:
            left, right = self.pieces[a], self.pieces[b]
            known = self.together[key] = self.merged(left + right) == [left, right]
        return known

    def alone(self, a: int) -> bool:
        """A piece that its own merges produce."""
        key = (a, -1)
        known = self.together.get(key)
        if known is None:
            known = self.together[key] = self.merged(self.pieces[a]) == [self.pieces[a]]
        return known

    # -- matching ---------------------------------------------------------------

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every occurrence inside a word, by start; word offsets."""
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
        depth = 1
        while depth < self.deepest:
            after = np.zeros(n, dtype=np.int64)
            after[:-depth] = rank[depth:] if depth < n else 0
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
            depth *= 2
        suffixes = np.argsort(rank)
        padded = np.concatenate([text, np.full(self.deepest + 1, -1)])
        low, high = np.zeros(len(self.numbers), dtype=np.int64), np.full(len(self.numbers), n, dtype=np.int64)
        for d in range(self.deepest):
            active = np.flatnonzero((self.lengths > d) & (low < high))
            if not len(active):
                break
            char = self.letters[active, d]
            bounds = []
            for upper in (False, True):
                a, b = low[active].copy(), high[active].copy()
                while (open_ := a < b).any():
                    mid = (a + b) >> 1
                    seen = padded[suffixes[np.minimum(mid, n - 1)] + d]
                    right = open_ & ((seen <= char) if upper else (seen < char))
                    a = np.where(right, mid + 1, a)
                    b = np.where(open_ & ~right, mid, b)
                bounds.append(a)
            low[active], high[active] = bounds
        count = high - low
        first = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        start = suffixes[first + np.arange(count.sum())]
        end = start + np.repeat(self.lengths, count)
        piece = np.repeat(self.numbers, count)
        inside = end <= ends[np.searchsorted(ends, start, side="right")]
        start, end, piece = start[inside], end[inside], piece[inside]
        order = np.argsort(start * (self.deepest + 1) + end - start)  # no two edges agree in both
        return start[order], end[order], piece[order], ends

    def learn(self, words: list[str]) -> None:
        """Encode new words and remember their ids."""
        start, end, piece, ends = self.edges(words)
        cut = np.searchsorted(start, np.concatenate([[0], ends]))
        lengths = np.array([len(w) for w in words])
        alone = np.ones(len(words), dtype=bool)
        if self.kind == BPE:
            alone = self._relax_together(words, start, end, piece, ends, lengths)
        relax = self._relax_bpe if self.kind == BPE else self._relax_unigram
        for w in np.flatnonzero(alone):
            a, b, base = cut[w], cut[w + 1], int(ends[w] - lengths[w])
            self.known[words[w]] = np.array(relax(words[w], start[a:b] - base, end[a:b] - base, piece[a:b]), dtype=np.int32).tobytes()

    def _relax_together(self, words, start, end, piece, ends, lengths) -> np.ndarray:
        """Relax the edges of all words, position by position; True for words left over.

        Left over are very long words and words with characters that have no piece.
        """
        word = np.searchsorted(ends, start, side="right")
        fit = lengths <= LONGEST
        keep = fit[word]
        start, end, piece, word = start[keep], end[keep], piece[keep], word[keep]
        first = ends - lengths + np.arange(len(words))  # a word has one slot more than characters
        offset = start - (ends - lengths)[word]
        order = np.argsort(offset.astype(np.int16), kind="stable")
        steps = np.searchsorted(offset[order], np.arange(LONGEST + 2))
        last = np.full(int(ends[-1]) + len(words) + 1, -2, dtype=np.int64)
        back = np.zeros(len(last), dtype=np.int64)
        last[first] = -1
        for s in range(min(LONGEST, int(lengths[fit].max(initial=0)))):
            e = order[steps[s] : steps[s + 1]]
            source, target = start[e] + word[e], end[e] + word[e]
            e = (last[source] != -2) & (last[target] == -2)
            source, target, p = source[e], target[e], piece[order[steps[s] : steps[s + 1]]][e]
            right = self._accepts(last[source], p)
            last[target[right]], back[target[right]] = p[right], source[right]
        whole = fit & (last[first + lengths] != -2)
        at = (first + lengths)[whole]
        owner, floor = np.flatnonzero(whole), first[whole]
        found_word, found_piece = [], []
        while len(at):
            found_word.append(owner)
            found_piece.append(last[at])
            at = back[at]
            more = at > floor
            at, owner, floor = at[more], owner[more], floor[more]
        if found_word:
            owner, ids = np.concatenate(found_word[::-1]), np.concatenate(found_piece[::-1])
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(len(words) + 1)).tolist()
            raw = ids[order].astype(np.int32).tobytes()
            for w in np.flatnonzero(whole).tolist():
                self.known[words[w]] = raw[4 * cuts[w] : 4 * cuts[w + 1]]
        return ~whole

    def _accepts(self, before: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Whether each piece may follow the one before it, -1 being the start of a word."""
        keys = before * len(self.pieces) + p
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        new = np.unique(keys[self.pairs[at] != keys])
        if len(new):
            right = [self.alone(k % len(self.pieces)) if k < 0 else self.compatible(*divmod(k, len(self.pieces))) for k in new.tolist()]
            where = np.searchsorted(self.pairs, new)
            self.pairs, self.fits = np.insert(self.pairs, where, new), np.insert(self.fits, where, right)
            at = np.searchsorted(self.pairs, keys)
        return self.fits[at]

    def _relax_bpe(self, word, start, end, piece) -> tuple[int, ...]:
        n = len(word)
        last: list = [None] * (n + 1)  # piece that ends here, and where it starts
        for s, t, p in zip(start.tolist(), end.tolist(), piece.tolist(), strict=True):
            if s and last[s] is None:  # a character without a piece ends here
                self._stranger(last, s)
            if last[t] is None:
                before = last[s][0] if s else -1
                if self.alone(p) if before < 0 else self.compatible(before, p):
                    last[t] = (p, s)
        out: list[int] = []
        at = n
        while at:
            if last[at] is None:
                self._stranger(last, at)
            p, s = last[at]
            out.extend(reversed(self.unknown(word[s]))) if p < 0 else out.append(p)
            at = s
        return tuple(reversed(out))

    @staticmethod
    def _stranger(last: list, at: int) -> None:
        while at and last[at] is None:
            last[at] = (-1, at - 1)
            at -= 1

    def _relax_unigram(self, word, start, end, piece) -> tuple[int, ...]:
        n, start, end, piece = len(word), start.tolist(), end.tolist(), piece.tolist()
        best: list = [(0.0, -1, 0), *[None] * n]
        e = 0
        for s in range(n):
            score = best[s][0]
            single = False
            while e < len(start) and start[e] == s:
                t, p = end[e], piece[e]
                single |= t == s + 1
                if best[t] is None or score + self.scores[p] > best[t][0]:
                    best[t] = (score + self.scores[p], p, s)
                e += 1
            if not single and (best[s + 1] is None or score + self.least > best[s + 1][0]):
                best[s + 1] = (score + self.least, -1, s)
        out: list[int] = []
        at = n
        while at:
            _, p, s = best[at]
            out.extend(reversed(self.unknown(word[s]))) if p < 0 else out.append(p)
            at = s
        return tuple(reversed(out))

    # -- texts ------------------------------------------------------------------

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text. New words of the whole batch share suffix arrays of bounded size."""
        if len(self.known) > MEMORY:
            self.known.clear()
        if len(self.together) > MEMORY:
            self.together.clear()
            self.pairs, self.fits = self.pairs[-1:], self.fits[-1:]
        split = [self.words.findall(self.normalize(t)) for t in texts]
        fresh = set().union(*split) - self.known.keys()
        held, size = [], 0
        for word in sorted(fresh):
            if held and size + len(word) > JOINED:
                self.learn(held)
                held, size = [], 0
            held.append(word)
            size += len(word)
        if held:
            self.learn(held)
        known = self.known
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), dtype=np.int32) for words in split]

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text of any length, a window of words at a time."""
        if len(text) <= WINDOW or self.squeeze or self.words.pattern.startswith("(?s)"):
            return self.encode_batch([text])[0]
        out, at, marks = [], 0, " " + SPACE
        while at < len(text):
            to = min(at + WINDOW, len(text))
            while to < len(text) and not (text[to] in marks and text[to - 1] not in marks):
                to += 1
            part = self.encode_batch([text[at:to]]) if at == 0 else [self._continued(text[at:to])]
            out.append(part[0])
            at = to
        return np.concatenate(out)

    def _continued(self, text: str) -> np.ndarray:
        prefix, self.prefix = self.prefix, False
        try:
            return self.encode_batch([text])[0]
        finally:
            self.prefix = prefix

    def decode(self, ids) -> str:
        """The text of ids: byte pieces are joined and read as UTF-8, control pieces vanish."""
        spelled = map(self.spelled.__getitem__, np.asarray(ids, dtype=np.int64).tolist())
        text = b"".join(spelled).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def shared(data: bytes) -> PieceModel:
    """The model of these bytes, kept with what it has learned for later tasks of this process."""
    store = sys.modules.setdefault("_pieces_of_this_process", types.ModuleType("_pieces_of_this_process"))
    if getattr(store, "data", None) != data:
        store.model, store.data = PieceModel(data), data
    return store.model


def load(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read())


def default_model() -> str:
    """The path of the installed public model; a parameter everywhere else."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model_path: str, batch_chars: int = WINDOW) -> DataFrame:
    """(doc_id, ids array<int>, n_ids, same): ids of every whole text, and whether they decode to it.

    Null and empty texts have no ids. Every row is encoded alone, so repeated rows and
    null ids need no care; an empty table gives an empty result; other columns are
    ignored. The model is read on the driver and travels with the plan.
    """
    with open(model_path, "rb") as f:
        data = f.read()

    def run(batches):
        model = shared(data)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and (to == at or held + len(texts[to]) <= batch_chars):
                    held += len(texts[to])
                    to += 1
                part = texts[at:to]
                ids = [model.encode(part[0])] if len(part) == 1 else model.encode_batch(part)
                same = [model.decode(i) == t for i, t in zip(ids, part, strict=True)]
                counts = np.array([len(i) for i in ids], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), lists, pa.array(counts), pa.array(same)], ["doc_id", "ids", "n_ids", "same"])
                at = to

    rows = required(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_ids long, same boolean")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of ``encoded(doc_id, ids)``; null ids give the empty text."""
    with open(model_path, "rb") as f:
        data = f.read()

    def run(batches):
        model = PieceModel(data)
        for batch in batches:
            texts = [model.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return required(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")
