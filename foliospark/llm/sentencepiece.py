"""SentencePiece encoding and decoding by Viterbi, many words at a time in numpy.

Words of equal length form a matrix and advance together. Prefix hashes give the hash
of any substring of any row; it is looked up among the sorted hashes of the pieces.
At each end position the best of all pieces that end there is a maximum over the
piece lengths for all rows at once, whose place is the backpointer.

Unigram models: a path's score is the sum of its pieces' scores.

BPE models: the merge order decides, not a sum. But a sequence of pieces is what BPE
makes of a word exactly if BPE makes each piece of its own characters, and leaves
each two neighbours side by side. So a path's score is 0 if all its neighbours stay
apart, else minus infinity; each prefix of a word has one path of score 0, and the
maximum finds its last piece. Whether two pieces stay apart is worked out once and
kept in a table.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

UNIGRAM, BPE = 1, 2
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words longer than this go through the same recurrence by themselves; a matrix of so few rows would be no use.
LONG_WORD = 256
#: Words that a worker remembers at most, and characters that such a word has at most.
REMEMBERED, SHORT = 1 << 17, 64
#: Bits of the number of pairs of pieces in the table of a worker; pairs, and pieces' seams, that it remembers besides.
PAIR_BITS, PAIRS = 21, 1 << 15
#: Characters of a batch of words at most.
BATCH = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Spreads the hashes of short pieces over the leading bits.
_SPREAD = np.uint64(0xD1342543DE82EF95)


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class PieceModel:
    """A SentencePiece model whose normaliser changes nothing but spaces."""

    def __init__(self, data: bytes):
        self.kind, self.dummy_prefix, squeeze, charsmap = UNIGRAM, True, True, b""
        pieces, scores, types = [], [], []
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode())
                scores.append(float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]))
                types.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                charsmap, self.dummy_prefix, squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if charsmap or squeeze or self.kind not in (UNIGRAM, BPE) or USER_DEFINED in types or UNUSED in types:
            raise ValueError("only unigram and BPE models without text normalisation, user-defined or unused pieces are supported")
        if any("▁" in p.lstrip("▁") for p, t in zip(pieces, types, strict=True) if t == NORMAL):
            raise ValueError("pieces with a space after other characters aren't supported")
        self._fill(pieces, scores, types)

    @classmethod
    def of(cls, pieces: list[str], scores: list[float], types: list[int], kind: int, dummy_prefix: bool = True) -> PieceModel:
        model = cls.__new__(cls)
        model.kind, model.dummy_prefix = kind, dummy_prefix
        model._fill(pieces, scores, types)
        return model

    def _fill(self, pieces, scores, types):
        self.pieces, self.scores = pieces, np.array(scores)
        normal = [i for i, t in enumerate(types) if t == NORMAL]
        self.ids = {pieces[i]: i for i in normal}
        self.longest = max((len(pieces[i]) for i in normal), default=1)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(pieces, types, strict=True)) if t == BYTE}
        self.unknown = types.index(UNKNOWN) if UNKNOWN in types else 0
        self.unknown_score = float(self.scores[normal].min() - 10) if normal else -10.0
        hashes = np.array([self._hash_of(pieces[i]) for i in normal], dtype=np.uint64) * _SPREAD
        order = np.argsort(hashes)
        self.keys, self.key_ids = hashes[order], np.array(normal, dtype=np.int64)[order]
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces have one hash")
        # A key's place among the sorted keys follows from its leading bits, up to a few steps.
        self.shift = np.uint64(64 - max(1, len(normal)).bit_length() - 2)
        heads = (self.keys >> self.shift).astype(np.int64)
        self.first = np.searchsorted(heads, np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)
        self.steps = int(np.diff(self.first).max()) if len(heads) else 0
        self.keys = np.concatenate([self.keys, np.full(self.steps + 1, (1 << 64) - 1, dtype=np.uint64)])
        self.key_ids = np.concatenate([self.key_ids, np.full(self.steps + 1, -1)]).astype(np.int32)
        #: By the leading bits of a hash: whether any piece may have it. Most substrings are none.
        self.there = np.zeros(1 << 20, dtype=bool)
        self.there[hashes >> np.uint64(44)] = True
        self.pairs = Pairs(pieces, {pieces[i]: -float(self.scores[i]) for i in normal})
        written = {CONTROL: b"", UNKNOWN: " ⁇ ".encode()}
        self.bytes = [bytes([int(p[3:5], 16)]) if t == BYTE else written.get(t, p.encode()) for p, t in zip(pieces, types, strict=True)]

    @staticmethod
    def _hash_of(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & ((1 << 64) - 1)
        return h

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the hashes that a piece has, those pieces)."""
        hashes = hashes.ravel() * _SPREAD
        maybe = np.nonzero(self.there[hashes >> np.uint64(44)])[0]
        hashes = hashes[maybe]
        at, found = self.first[hashes >> self.shift], np.full(len(maybe), -1, dtype=np.int64)
        for k in range(self.steps):
            same = self.keys[at + k] == hashes
            found[same] = self.key_ids[at[same] + k]
        good = found >= 0
        return maybe[good], found[good]

    # -- words of one length -------------------------------------------------

    def _prefix_hashes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, m = codes.shape
        sums, powers = np.zeros((m + 1, rows), dtype=np.uint64), np.ones(m + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(m):
                sums[i + 1] = sums[i] * _BASE + codes[:, i] + np.uint64(1)
                powers[i + 1] = powers[i] * _BASE
        return sums, powers

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the pieces of all rows' best paths, one row behind the other; how many each row has). A character without a piece is -1.

        Of equal scores, the longest last piece wins.
        """
        rows, m = codes.shape
        sums, powers = self._prefix_hashes(codes)
        edges = []
        for size in range(1, min(m, self.longest) + 1):
            with np.errstate(over="ignore"):
                at, piece = self.lookup(sums[size:] - sums[:-size] * powers[size])
            if size == 1:
                own = codes.T.ravel().astype(np.int64) + len(self.pieces)
                own[at] = piece
                at, piece = np.arange(m * rows), own
            edges.append((at, piece, np.searchsorted(at, np.arange(m - size + 2) * rows).tolist()))
        # A position of all words lies together.
        last, back = np.full((m + 1, rows), -1, dtype=np.int64), np.zeros((m + 1, rows), dtype=np.int32)
        best, n = np.full((m + 1, rows), -np.inf), np.zeros((m + 1, rows), dtype=np.int32)
        best[0] = 0
        for end in range(1, m + 1):
            for start in range(max(0, end - self.longest), end):  # the longest piece first
                at, pieces, cuts = edges[end - start - 1]
                low, high = cuts[start], cuts[start + 1]
                if low == high:
                    continue
                own, piece = at[low:high] - start * rows, pieces[low:high]
                if self.kind == BPE:
                    todo = last[end, own] < 0  # a prefix has one such path
                    own, piece = own[todo], piece[todo]
                    good = self.pairs.apart(last[start, own], piece)
                    score = 0.0
                else:
                    score = best[start, own] + np.where(piece < len(self.pieces), self.scores[np.minimum(piece, len(self.pieces) - 1)], self.unknown_score)
                    good = score > best[end, own]
                    score = score[good]
                own, piece = own[good], piece[good]
                best[end, own], last[end, own], back[end, own], n[end, own] = score, piece, start, n[start, own] + 1
        if np.isneginf(best).any():
            raise ValueError("the pieces' scores don't give a word one segmentation")
        stop = np.cumsum(n[m], dtype=np.int64)
        out, row, place, at = np.empty(stop[-1] if rows else 0, dtype=np.int64), np.arange(rows), stop - 1, np.full(rows, m)
        while len(row):
            out[place] = last[at, row]
            at = back[at, row]
            go = at > 0
            row, place, at = row[go], place[go] - 1, at[go]
        return np.where(out < len(self.pieces), out, -1), n[m]

    def long_word(self, word: str) -> list[int]:
        """``viterbi`` of one word."""
        best, last, back = [0.0], [-1], [0]
        for end in range(1, len(word) + 1):
            top, own, place = -np.inf, -1, 0
            for start in range(max(0, end - self.longest), end):
                piece = self.ids.get(word[start:end])
                if piece is None:
                    if start < end - 1:
                        continue
                    piece = len(self.pieces) + ord(word[start])
                if self.kind == BPE:
                    if self.pairs.stay(last[start], piece):
                        top, own, place = 0.0, piece, start
                        break
                elif (score := best[start] + (self.scores[piece] if piece < len(self.pieces) else self.unknown_score)) > top:
                    top, own, place = score, piece, start
            if own < 0:
                raise ValueError("the pieces' scores don't give a word one segmentation")
            best.append(top)
            last.append(own)
            back.append(place)
        out, at = [], len(word)
        while at:
            out.append(last[at] if last[at] < len(self.pieces) else -1)
            at = back[at]
        return out[::-1]

    def words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word, as bytes of int32. A word is a run of U+2581 and what follows it, or either alone."""
        out: dict[str, bytes] = {}
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for m, group in by_length.items():
            if m > LONG_WORD:
                out |= {w: self._with_bytes(w, self.long_word(w)) for w in group}
                continue
            step = max(1, BATCH // m)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(part), m).astype(np.uint64)
                ids, sizes = self.viterbi(codes)
                whole, ends = ids.astype("<i4").tobytes(), np.cumsum(sizes, dtype=np.int64)
                cuts = [0, *(4 * ends).tolist()]
                out |= {w: whole[i:j] for w, i, j in zip(part, cuts, cuts[1:], strict=False)}
                odd = np.unique(np.searchsorted(ends, np.nonzero(ids < 0)[0], side="right"))
                out |= {part[i]: self._with_bytes(part[i], ids[ends[i] - sizes[i] : ends[i]].tolist()) for i in odd.tolist()}
        return out

    def _with_bytes(self, word: str, ids: list[int]) -> bytes:
        """``ids`` with the bytes of the characters, -1 there, that are no piece."""
        out, at = [], 0
        for i in ids:
            if i >= 0:
                out.append(i)
                at += len(self.pieces[i])
            else:
                out += [self.byte_ids[x] for x in word[at].encode("utf-8", "replace")] if self.byte_ids else [self.unknown]
                at += 1
        return np.array(out, dtype="<i4").tobytes()


class Pairs:
    """Which pieces BPE leaves side by side, each of which it makes of its own characters.

    A piece is its id, or the number of pieces and the code of a character that is none.
    """

    def __init__(self, pieces: list[str], ranks: dict[str, float]):
        self.pieces, self.ranks = pieces, ranks
        self.seams: dict[int, tuple | None] = {}
        self.known: dict[tuple[int, int], bool] = {}
        self.keys, self.values = np.zeros(1 << PAIR_BITS, dtype=np.uint64), np.zeros(1 << PAIR_BITS, dtype=bool)

    def _seams(self, piece: int) -> tuple[list, list] | None:
        """What stands at a piece's left and right edge as BPE builds it up: (part, rank of the merge that absorbs it); None if BPE doesn't build it."""
        text = self.pieces[piece] if piece < len(self.pieces) else chr(piece - len(self.pieces))
        nodes: list[tuple] = [(c, None, None) for c in text]
        while len(nodes) > 1:
            ranked = [(r, i) for i in range(len(nodes) - 1) if (r := self.ranks.get(nodes[i][0] + nodes[i + 1][0])) is not None]
            if not ranked:
                return None
            _, i = min(ranked)
            nodes[i : i + 2] = [(nodes[i][0] + nodes[i + 1][0], nodes[i], nodes[i + 1])]

        def edge(side: int) -> list[tuple[str, float]]:
            found, node, above = [], nodes[0], np.inf
            while node is not None:
                found.append((node[0], above))
                above, node = self.ranks.get(node[0], np.inf), node[side]
            return found[::-1]

        return edge(1), edge(2)

    def seam(self, piece: int) -> tuple[list, list] | None:
        if piece not in self.seams:
            if len(self.seams) > PAIRS:
                self.seams.clear()
            self.seams[piece] = self._seams(piece)
        return self.seams[piece]

    def stay(self, a: int, b: int) -> bool:
        """Whether b may follow a, or begin a word if a is -1.

        The parts at their edges meet in the order of the merges that absorb them. They
        stay apart unless such a pair makes a piece that comes first; of equal ranks, the
        merge further left does.
        """
        if (found := self.known.get((a, b))) is None:
            if len(self.known) > PAIRS:
                self.known.clear()
            found = self.known[a, b] = self._stay(a, b)
        return found

    def _stay(self, a: int, b: int) -> bool:
        if (own := self.seam(b)) is None:
            return False
        if a < 0:
            return True
        left, right, i, j = self.seam(a)[1], own[0], 0, 0
        while True:
            (x, x_goes), (y, y_goes) = left[i], right[j]
            across = self.ranks.get(x + y)
            if across is not None and across < x_goes and across <= y_goes:
                return False
            if i == len(left) - 1 and j == len(right) - 1:
                return True
            if x_goes <= y_goes:
                i += 1
            else:
                j += 1

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``stay`` for many pairs, by a table in which a pair has one place."""
        with np.errstate(over="ignore"):
            keys = (a + 2).astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
            at = (keys * _BASE) >> np.uint64(64 - PAIR_BITS)
        miss = np.nonzero(self.keys[at] != keys)[0]
        out = self.values[at]
        if len(miss):
            new, which = np.unique(keys[miss], return_inverse=True)
            found = np.fromiter((self._stay((k >> 32) - 2, k & 0xFFFFFFFF) for k in new.tolist()), dtype=bool, count=len(new))
            out[miss] = found[which]
            self.keys[at[miss]], self.values[at[miss]] = keys[miss], out[miss]
        return out


_WORD = re.compile("▁*[^▁]+|▁+")


class Encoder:
    """A model and the words it has met, in a worker."""

    def __init__(self, model: PieceModel):
        self.model, self.known = model, {}

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(" ", "▁")
        return _WORD.findall("▁" + text if self.model.dummy_prefix else text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = self.model.words(list(set().union(*split).difference(self.known)))
        self.known |= {w: ids for w, ids in new.items() if len(w) <= SHORT}
        long = {w: ids for w, ids in new.items() if len(w) > SHORT}
        return [np.frombuffer(b"".join([self.known[w] if len(w) <= SHORT else long[w] for w in words]), dtype=np.int32) for words in split]

    def decode(self, ids) -> str:
        text = b"".join(map(self.model.bytes.__getitem__, ids)).decode("utf-8", "replace").replace("▁", " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    with open(path, "rb") as file:
        return Encoder(PieceModel(file.read()))


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip), a row for each row of ``docs``.

    ``model_path``: the model's file, present on every machine, as the libraries are.
    No begin or end tokens. Null text is the empty text, which has no tokens. Texts and
    words of any length are taken whole, and other columns play no part.
    round_trip: decoding the ids gives the text again; false only for texts with
    U+2581, which the format can't tell from a space. Null ids and repeated rows are
    rows like any other. No rows: no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(model_path)
        texts = [x or "" for x in batch.column(1).to_pylist()]
        ids = own.encode(texts)
        back = [own.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
        return pa.RecordBatch.from_arrays([batch.column(0), tokens, pa.array(sizes), pa.array(back)], names=["doc_id", "token_ids", "n_tokens", "round_trip"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(arrow_rows(run, text=1), f"doc_id {dict(rows.dtypes)['doc_id']}, token_ids array<int>, n_tokens long, round_trip boolean")


def decoded(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(doc_id, text) from token ids, a row for each row; null ids give null, no ids the empty text. Repeated rows and null ids of rows are rows like any other."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(model_path)
        texts = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("token_ids"))
    return rows.mapInArrow(arrow_rows(run), f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
