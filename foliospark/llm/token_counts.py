"""Token counts by a tokenizer compiled to deterministic finite-state transducers.

For byte-level BPE with word ends. A sequence of tokens is what BPE makes of a word
exactly if each token alone and each adjacent pair is what BPE makes of its own
symbols. That is a condition on neighbours, so a nondeterministic transducer checks
it: its states are (last whole token, place in the trie of tokens), and it emits one
when it closes a token. Its subset construction, done for the transitions that
texts use and kept, is deterministic: a transition holds the next state and the
number of tokens that all its paths have emitted by then.

Each text is cut into chunks. The state between chunks is the unfinished word, which
alone says how the transducers go on. A chunk's state map sends the unfinished word it
is entered with to the one it leaves and the tokens in between. Such maps compose
associatively; a prefix scan, in twice the logarithm of their number of rounds, gives
the tokens up to the end of each chunk.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_rows

#: Characters of a chunk; transitions and words that a worker remembers at most, and characters of such a word.
CHUNK, TRANSITIONS, REMEMBERED, SHORT = 1 << 12, 1 << 20, 1 << 18, 64
#: Fixed: Unicode white space.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def scan(maps: list, then) -> list:
    """All prefixes of ``maps`` composed by an associative ``then``: pairs first, those scanned, and the odd ones from them."""
    if len(maps) < 2:
        return maps
    done = scan([then(*maps[i : i + 2]) for i in range(0, len(maps) - 1, 2)], then)
    return [maps[0], *(done[i // 2] if i % 2 else then(done[i // 2 - 1], maps[i]) for i in range(1, len(maps)))]


class BytePairs:
    """The vocabulary and merges of a tokenizer file, over the symbols byte and 256 + byte at a word's end."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        byte = {c: b for b, c in letter.items()}
        self.single = [vocab[letter[b]] for b in range(256)] + [vocab[letter[b] + suffix] for b in range(256)]
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        #: The merge that makes a token: (rank, left part, right part).
        self.made = {new: (rank, a, b) for (a, b), (rank, new) in reversed(self.merge.items())}
        self.seams: tuple[dict[int, list], dict[int, list]] = {}, {}
        self.symbols: dict[int, tuple[int, ...]] = {}
        for token, i in vocab.items():
            bare = token[: -len(suffix)] if token.endswith(suffix) and token != suffix else token
            if all(c in byte for c in bare):
                found = [byte[c] for c in bare]
                if bare != token:
                    found[-1] += 256
                self.symbols[i] = tuple(found)

    def encode(self, symbols: tuple[int, ...]) -> list[int]:
        """BPE step by step: the pair of the lowest rank, the leftmost of equals, until none is left."""
        ids = [self.single[s] for s in symbols]
        while len(ids) > 1:
            rank, new, at = min((*self.merge.get(pair, (1 << 60, -1)), i) for i, pair in enumerate(zip(ids, ids[1:], strict=False)))
            if new < 0:
                break
            ids[at : at + 2] = [new]
        return ids

    def seam(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at a token's left (0) or right (1) edge as it is built up: (part, rank of the merge that absorbs it)."""
        if (found := self.seams[side].get(token)) is None:
            found, at, above = [], token, 1 << 60
            while True:
                found.append((at, above))
                if at not in self.made:
                    break
                above, *parts = self.made[at]
                at = parts[side]
            found.reverse()
            self.seams[side][token] = found
        return found

    def adjacent(self, a: int, b: int) -> bool:
        """Whether BPE leaves two tokens side by side, each of which it makes of its own symbols.

        Between them, the parts at their edges meet in the order of the merges that
        absorb them. They stay apart unless such a pair has a merge that comes first;
        of equal ranks, the one further left does.
        """
        left, right, i, j = self.seam(a, 1), self.seam(b, 0), 0, 0
        while True:
            (x, x_goes), (y, y_goes) = left[i], right[j]
            across = self.merge.get((x, y))
            if across is not None and across[0] < x_goes and across[0] <= y_goes:
                return False
            if i == len(left) - 1 and j == len(right) - 1:
                return True
            if x_goes <= y_goes:
                i += 1
            else:
                j += 1


class Transducer:
    """The subset construction over (last token, trie node, tokens emitted), made as words need it."""

    def __init__(self, pairs: BytePairs):
        self.pairs = pairs
        self.down: dict[int, int] = {}  # node << 9 | symbol: node
        self.token = [-1]
        for i, symbols in pairs.symbols.items():
            node = 0
            for s in symbols:
                if (below := self.down.get(node << 9 | s)) is None:
                    below = self.down[node << 9 | s] = len(self.token)
                    self.token.append(-1)
                node = below
            self.token[node] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self):
        start = ((-1, 0, 0),)
        self.members, self.number = [start], {start: 0}
        self.ends: list[int | None] = [None]
        self.step: dict[int, tuple[int, int]] = {}  # state << 9 | symbol: (state, emitted)

    def _fit(self, last: int, token: int) -> bool:
        if (found := self.fits.get((last, token))) is None:
            of = self.pairs.symbols
            if last < 0:
                found = self.pairs.encode(of[token]) == [token]
            else:
                found = self._fit(-1, token) and self.pairs.adjacent(last, token)
            if len(self.fits) > TRANSITIONS:
                self.fits.clear()
            self.fits[last, token] = found
        return found

    def _move(self, state: int, symbol: int) -> tuple[int, int]:
        after = []
        for last, node, emitted in self.members[state]:
            if (below := self.down.get(node << 9 | symbol)) is not None:
                after.append((last, below, emitted))
            token = self.token[node]
            if token >= 0 and (below := self.down.get(symbol)) is not None and self._fit(last, token):
                after.append((token, below, emitted + 1))
        common = min(k for _, _, k in after)
        after = tuple(sorted((last, node, k - common) for last, node, k in after))
        if (number := self.number.get(after)) is None:
            number = self.number[after] = len(self.members)
            self.members.append(after)
            self.ends.append(None)
        moved = self.step[state << 9 | symbol] = number, common
        return moved

    def _end(self, state: int) -> int:
        """Tokens still to be counted where a word ends: of its paths one is whole."""
        found = [k + 1 for last, node, k in self.members[state] if self.token[node] >= 0 and self._fit(last, self.token[node])]
        if len(found) != 1:
            raise ValueError("the merges don't give a word one tokenization")
        self.ends[state] = found[0]
        return found[0]

    def count(self, word: bytes) -> int:
        """Tokens of one pretoken."""
        state = total = 0
        step = self.step
        for symbol in (*word[:-1], word[-1] + 256):
            state, emitted = step.get(state << 9 | symbol) or self._move(state, symbol)
            total += emitted
        end = self.ends[state]
        total += self._end(state) if end is None else end
        if len(step) > TRANSITIONS or len(self.members) > TRANSITIONS // 2:
            self.clear()
        return total


class Counter:
    """Counts as the tokenizers library gives them for a file of this kind, without added special tokens."""

    def __init__(self, spec: dict):
        model, before = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or steps != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in before] != ["Split", "ByteLevel"] or before[1]["add_prefix_space"] or before[1]["use_regex"]:
            raise ValueError("only byte-level BPE with word ends, NFC and lower case is supported")
        self.pretoken = regex.compile(before[0]["pattern"]["Regex"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) or "(?!)")
        self.word = regex.compile(f"[^{_SPACE}]+")
        self.edge = regex.compile(f"[{_SPACE}]")
        self.transducer = Transducer(BytePairs(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"]))
        self.known: dict[str, int] = {}

    def of_word(self, word: str) -> int:
        """Tokens between two white spaces."""
        if (found := self.known.get(word)) is None:
            # Each capital by itself, as the library has it: no final sigma.
            text = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
            parts = [text] if text.isalpha() else self.pretoken.findall(text)
            found = sum(self.transducer.count(p.encode()) for p in parts)
            if len(word) <= SHORT:
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                self.known[word] = found
        return found

    def _map(self, chunk: str) -> tuple[str, int, str] | str:
        """A chunk's state map: (what ends the word it is entered with, tokens, the word it leaves), or the chunk if it ends none."""
        first = self.edge.search(chunk)
        if first is None:
            return chunk
        last = next(i for i in range(len(chunk) - 1, -1, -1) if self.edge.match(chunk, i))
        return chunk[: first.start()], sum(map(self.of_word, self.word.findall(chunk, first.start(), last))), chunk[last + 1 :]

    def _then(self, a, b):
        if isinstance(a, str):
            return a + b if isinstance(b, str) else (a + b[0], b[1], b[2])
        if isinstance(b, str):
            return a[0], a[1], a[2] + b
        return a[0], a[1] + (self.of_word(w) if (w := a[2] + b[0]) else 0) + b[1], b[2]

    def _total(self, found) -> int:
        """The tokens of a text by its state map: what it is entered with and what it leaves end here."""
        if isinstance(found, str):
            return self.of_word(found) if found else 0
        return found[1] + sum(self.of_word(w) for w in (found[0], found[2]) if w)

    def prefixes(self, text: str) -> list[int]:
        """Tokens of a text without special strings up to the end of each chunk, as if it ended there."""
        maps = [self._map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        return [self._total(found) for found in scan(maps, self._then)]

    def _stretch(self, text: str) -> int:
        """Tokens of a text without special strings."""
        maps = [self._map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        return self._total(scan(maps, self._then)[-1]) if maps else 0

    def count(self, text: str) -> int:
        """Special strings are one token each; what stands between them is text of its own."""
        if not any(s in text for s in self.special):
            return self._stretch(text)
        return sum(map(self._stretch, self.cut.split(text))) + len(self.cut.findall(text))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    with open(path, encoding="utf-8") as file:
        return Counter(json.load(file))


def counted(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row of ``docs``.

    ``tokenizer_path``: the tokenizer's file, present on every machine. over_limit:
    n_tokens > ``limit``. Null text is the empty text: no bytes, no tokens. Texts and
    words of any length are taken whole; other columns play no part. Null ids and
    repeated rows are rows like any other. No rows: no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = counter(tokenizer_path)
        texts = [x or "" for x in batch.column(1).to_pylist()]
        tokens = [own.count(t) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(arrow_rows(run, text=1), f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
