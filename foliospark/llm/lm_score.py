"""Scoring texts with a byte-level model: prediction by partial matching (PPM).

The trie's contexts are the last bytes before a byte, across words and back to the
text's start at most. Where a context has not seen a byte, the model escapes to the
context shorter by one byte and leaves out the bytes that the longer one has seen
(method D, with exclusion); below the empty context all remaining bytes are alike.
The trie is pretrained: counts of windows of order + 1 bytes over all training texts
give the counts of all shorter ones.

The trie keeps every context and byte. It is dealt out by the last bytes of a context:
all that a window's score needs in its longer contexts is in one task, and what the
shortest contexts need is broadcast, at most 2 ** 24 grams for any corpus. Each kind of
window is scored once. The windows that come most often, at most ``1 / share``, are
looked up in a broadcast table; the others of a document are joined with the scores.

The unigram base needs every training word's count. The words that make up more than
one part in ``1 / share`` of the tokens are looked up in a broadcast table of bounded
size; the other words of a document are joined with the table of counts.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, held_out, parts, shuffle_width, text_or_empty, utf8

#: Words of a partition that are counted before they are handed on; words that a worker remembers.
COUNTED, REMEMBERED = 1 << 18, 1 << 17
#: Windows that a worker scores at a time.
SCORED = 1 << 18
#: Bytes of texts handled in one vectorised step.
STEP = 1 << 20
#: The end of a text, in the place of a word's first byte. Words hold no white space.
END, SPACE = 10, 32
#: Bytes before a text's first word: its start, as an end before it, and a space.
LEAD = b"\n\n "
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _take(batches, text: int):
    """Parts of batches of about a MB of text each, and their texts' words."""
    for batch in batches:
        for part in parts(batch, text, STEP):
            if part.num_rows:
                yield part, [t.lower().split() for t in utf8(part.column(text))]


def _windows(words: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(for each byte of the texts it and the ``order`` bytes before it as one number, each text's start among them).

    A text is its words with a space after each, and the end. What stands before its
    first byte is LEAD, and zeros before that.
    """
    texts = [bytes(max(0, order - len(LEAD))) + LEAD + b" ".join(w) + (b" \n" if w else b"\n") for w in words]
    lead = max(order, len(LEAD))
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    buffer = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint64)
    value = np.zeros(len(buffer), dtype=np.uint64)
    for k in range(order + 1):
        value[k:] |= buffer[: len(buffer) - k] << np.uint64(8 * k)
    own = np.ones(len(buffer), dtype=bool)
    starts = np.cumsum(sizes) - sizes
    own[(starts[:, None] + np.arange(lead)).ravel()] = False
    sizes -= lead
    return value[own], np.cumsum(sizes) - sizes


def _count(order: int):
    """For mapInArrow over (held, text): (word, window, n, uses), each with one of the first two.

    n: in training documents; uses: a window's in all documents.
    """

    def run(batches):
        words: Counter = Counter()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def out_words():
            found = pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64()), pa.nulls(len(words), pa.int64())], names=["word", "window", "n", "uses"])
            words.clear()
            return found

        def out_windows():
            keys, n, uses = held[0]
            return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), pa.array(keys.view(np.int64)), pa.array(n), pa.array(uses)], names=["word", "window", "n", "uses"])

        for rows, part in _take(batches, 1):
            learnt = [w for w, out in zip(part, rows.column(0).to_pylist(), strict=True) if not out]
            rest = [w for w, out in zip(part, rows.column(0).to_pylist(), strict=True) if out]
            for w in learnt:
                words.update(w)
            for own, counts in ((learnt, True), (rest, False)):
                if own:
                    keys, uses = np.unique(_windows(own, order)[0], return_counts=True)
                    held.append((keys, uses if counts else np.zeros_like(uses), uses))
                    size += len(keys)
            if size > 1 << 21:
                held = [_sum(held)]
                size = len(held[0][0])
                if size > 1 << 20:
                    yield out_windows()
                    held, size = [], 0
            if len(words) > COUNTED:
                yield out_words()
        if words:
            yield out_words()
        if held:
            held = [_sum(held)]
            yield out_windows()

    return run


def _pack(length: int, value: np.ndarray) -> np.ndarray:
    """A gram of up to seven bytes as one number, its length above."""
    return value | np.uint64(length << 56)


def _sum(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The sums by key of (keys, counts ...)."""
    keys, *counts = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[heads], *(np.add.reduceat(n[order], heads) if len(heads) else n for n in counts)


class Table:
    """Numbers found by a 64-bit key: its leading bits, spread, say where among the sorted keys it can be."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys * _SPREAD)
        self.spread = (keys * _SPREAD)[self.order]
        self.shift = np.uint64(64 - max(1, len(keys)).bit_length() - 1)
        self.first = np.searchsorted(self.spread >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in the order given by ``order``, or -1."""
        keys = keys * _SPREAD
        slot = (keys >> self.shift).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(keys.shape, -1, dtype=np.int32)
        todo = np.nonzero(at < end)[0]
        while len(todo):
            same = self.spread[at[todo]] == keys[todo]
            out[todo[same]] = at[todo[same]]
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out


class Trie:
    """Pretrained PPM. grams, n: the grams and their counts; contexts, seen: the contexts and all that followed them."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, contexts: np.ndarray, seen: np.ndarray, order: int):
        self.order = order
        byte, low = np.uint64(8), np.uint64((1 << 56) - 1)
        self.nodes = Table(contexts)
        self.entries = Table(grams)
        grams, n = grams[self.entries.order], n[self.entries.order].astype(float)
        contexts, seen = contexts[self.nodes.order], seen[self.nodes.order].astype(float)
        length = grams >> np.uint64(56)
        node = self.nodes.find((length - np.uint64(1)) << np.uint64(56) | (grams & low) >> byte)
        good = node >= 0
        kept = np.bincount(node[good], weights=n[good], minlength=len(contexts))
        kinds = np.bincount(node[good], minlength=len(contexts)).astype(float)
        # What a context's bytes make up in the context shorter by one.
        shorter = np.where(length > 1, (length - np.uint64(1)) << np.uint64(56) | grams & ((np.uint64(1) << byte * np.maximum(length, np.uint64(1)) - byte) - np.uint64(1)), np.uint64(0))
        below = self.entries.find(shorter)
        self.excluded = np.bincount(node[good], weights=np.where((below >= 0) & (length > 1), n[below], 0.0)[good], minlength=len(contexts))
        # Method D: each kind of byte gives half a count to the escape.
        self.log_count = np.log10(n - 0.5)
        self.room, self.escape = seen, np.log10(np.maximum(seen - kept, 0) + kinds / 2)
        self.excluded = self.excluded - kinds / 2
        #: Of a byte that its longest context has seen.
        self.direct = np.where(node >= 0, self.log_count - np.log10(np.maximum(self.room[node], 1e-9)), np.nan)
        self.entries.order = self.nodes.order = None  # workers don't need it
        self.bottom = -np.log10(max(1.0, 257 - (kinds[found[0]] if (found := self.nodes.find(np.zeros(1, dtype=np.uint64)))[0] >= 0 else 0)))

    def log10(self, context: np.ndarray, length: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The log10 probability of each symbol after a context of up to ``order`` bytes, the last byte lowest."""
        out, todo = np.zeros(len(symbol)), np.arange(len(symbol))
        excluded = np.zeros(len(symbol))
        for k in range(self.order, -1, -1):
            here = todo[length[todo] >= k]
            if not len(here):
                continue
            ctx = context[here] & np.uint64((1 << 8 * k) - 1)
            node = self.nodes.find(_pack(k, ctx))
            here, ctx, node = here[node >= 0], ctx[node >= 0], node[node >= 0]
            if not len(here):
                continue
            room = np.log10(np.maximum(self.room[node] - excluded[here], 1e-9))
            entry = self.entries.find(_pack(k + 1, ctx << np.uint64(8) | symbol[here]))
            out[here] += np.where(entry >= 0, self.log_count[entry], self.escape[node]) - room
            excluded[here] = self.excluded[node]
            done = np.zeros(len(out), dtype=bool)
            done[here[entry >= 0]] = True
            todo = todo[~done[todo]]
            if not len(todo):
                break
        out[todo] += self.bottom
        return out

    def windows(self, windows: np.ndarray) -> np.ndarray:
        """The log10 probability of each window's last byte after the others."""
        entry = self.entries.find(_pack(self.order + 1, windows))
        out = self.direct[entry] if len(self.direct) else np.full(len(windows), np.nan)
        rest = np.nonzero((entry < 0) | np.isnan(out))[0]
        kinds, which = np.unique(windows[rest], return_inverse=True)
        out[rest] = self.log10(kinds >> np.uint64(8), np.full(len(kinds), self.order), kinds & np.uint64(255))[which]
        return out


def _grams(windows: np.ndarray, n: np.ndarray, lengths) -> tuple[np.ndarray, np.ndarray]:
    """The last bytes of windows, of each of the lengths, and their counts."""
    return _sum([(_pack(k, windows & np.uint64((1 << 8 * k) - 1)), n) for k in lengths])


def _contexts(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = grams >> np.uint64(56)
    return _sum([((length - np.uint64(1)) << np.uint64(56) | (grams & np.uint64((1 << 56) - 1)) >> np.uint64(8), n)])


def _window_scores(shared, order: int, near: int):
    """For mapInArrow over (place, window, n, uses), the rows of a place together: (window, uses, score) of each.

    A place is the last ``near`` bytes of a window's context; the grams of up to that length are shared.
    """

    def scores(got: np.ndarray):
        windows, n = got[1], got[2].astype(np.int64)
        known = n > 0
        grams, counts = shared.value
        if known.any():
            own = _grams(windows[known], n[known], range(near + 1, order + 2))
            grams, counts = np.concatenate([grams, own[0]]), np.concatenate([counts, own[1]])
        trie = Trie(grams, counts, *_contexts(grams, counts), order)
        found = np.concatenate([trie.windows(windows[at : at + STEP]) for at in range(0, len(windows), STEP)])
        return pa.RecordBatch.from_arrays([pa.array(windows.view(np.int64)), pa.array(got[3].view(np.int64)), pa.array(found)], names=["window", "uses", "score"])

    def run(batches):
        kept: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            kept.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(4)]))
            rows += batch.num_rows
            if rows >= SCORED:
                got = np.concatenate(kept, axis=1)
                last = got[0] == got[0, -1]  # its place may go on
                if not last.all():
                    yield scores(got[:, ~last])
                kept = [got[:, last]]
                rows = int(last.sum())
        if rows:
            yield scores(np.concatenate(kept, axis=1))

    return run


def _scores(counts: DataFrame, order: int) -> DataFrame:
    """(window, uses, score) of each window, by the trie of all of them."""
    windows = counts.where("window is not null").select("window", "n", "uses")
    near = min(order, 3)
    tail = checkpointed(windows.where("n > 0").groupBy(F.expr(f"window & {(1 << 8 * near) - 1}L").alias("gram")).agg(F.sum("n").alias("n"))).toArrow()  # 2 ** 24 rows at most
    low = _grams(tail["gram"].to_numpy().view(np.uint64), tail["n"].to_numpy(), range(1, near + 1)) if len(tail) else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    shared = counts.sparkSession.sparkContext.broadcast(low)
    placed = windows.select(F.expr(f"shiftright(window, 8) & {(1 << 8 * near) - 1}L").alias("place"), "window", "n", "uses")
    width = shuffle_width(counts, windows.count(), 4 * SCORED)
    dealt = placed.repartition(width, "place").sortWithinPartitions("place")
    return checkpointed(dealt.mapInArrow(_window_scores(shared, order, near), "window long, uses long, score double"))


def _most(scores: DataFrame, share: float) -> tuple[Table, np.ndarray]:
    """The windows of most uses, 1 / share at most, and their scores in the table's order."""
    kinds = sorted(((r["bits"], r["n"]) for r in scores.groupBy(F.expr("length(bin(uses))").alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, room = None, 1 / share
    for bits, n in kinds:
        room -= n
        if room < 0:
            break
        least = 1 << bits - 1
    found = scores.where(F.col("uses") >= least if least else F.lit(False)).select("window", "score").toArrow()
    table = Table(found["window"].to_numpy().view(np.uint64) if len(found) else np.zeros(0, dtype=np.uint64))
    out = found["score"].to_numpy()[table.order] if len(found) else np.zeros(0)
    table.order = None
    return table, out


def _score(shared, order: int):
    """For mapInArrow over (doc_id, held, text): the sums that need no join, and the words and windows that do."""

    def run(batches):
        most, scores, common, logs = shared.value
        known: dict[bytes, float] = {}
        for part, words in _take(batches, 2):
            if len(known) > REMEMBERED:
                known.clear()
            new = list(set().union(*words).difference(known))
            at = common.find(np.fromiter(map(xxhash.xxh64_intdigest, new), dtype=np.uint64, count=len(new)))
            base = np.where(at >= 0, logs[at], np.nan) if len(logs) else np.full(len(new), np.nan)
            known.update(zip(new, base.tolist(), strict=True))
            windows, starts = _windows(words, order)
            at = most.find(windows)
            score = np.where(at >= 0, scores[at], np.nan) if len(scores) else np.full(len(windows), np.nan)
            other = np.nonzero(np.isnan(score))[0]
            n_other = np.bincount(np.searchsorted(starts, other, side="right") - 1, minlength=len(words))
            score = np.add.reduceat(np.nan_to_num(score), starts)
            others = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_other)]).astype(np.int32)), pa.array(windows[other].view(np.int64)))
            flat = [w for own in words for w in own]
            sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            owner = np.repeat(np.arange(len(words)), sizes)
            base = np.fromiter(map(known.__getitem__, flat), dtype=float, count=len(flat))
            rare = np.nonzero(np.isnan(base))[0]
            sums = np.bincount(owner, weights=np.nan_to_num(base), minlength=len(words)).astype(float)  # of no words it is integers
            n_rare = np.bincount(owner[rare], minlength=len(words))
            tails = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_rare)]).astype(np.int32)), pa.array([flat[i] for i in rare], pa.binary()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes + 1), pa.array(sizes - n_rare), pa.array(sums), pa.array(score), tails, others], names=["doc_id", "held_out", "n_tokens", "n_common", "common", "score", "rare", "others"])

    return run


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, order: int = 5, share: float = 2.0**-21) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``.

    Learns from the rows whose crc32(id as text) mod ``modulus`` is not 1. Texts are
    taken with A-Z in lower case, as their words and an end. base_score: log10 of the
    smoothed unigram probability; score: of the PPM probability of the words' bytes,
    a space after each, and the end. Null text is the empty text: its end only. Null
    ids learn and are not held out; repeated rows count as often as they are there.
    Without training rows N and V are 0, and all bytes are alike. No rows: no rows.
    ``share`` says how many windows are broadcast, and has no part in the result.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col], modulus).alias("held_out"), text_or_empty(docs[text_col]).alias("text"))
    counted = rows.select("held_out", "text").mapInArrow(_count(order), "word binary, window long, n long, uses long")
    counts = checkpointed(counted.groupBy("word", "window").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses")))
    words = counts.where("word is not null").select("word", "n")
    total = counts.agg(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))).alias("n"), F.count("word").alias("v"), F.sum(F.when(F.expr("window & 255") == END, F.col("n"))).alias("ends")).first()
    ends = total["ends"] or 0
    train, distinct = (total["n"] or 0) + ends, total["v"] + (ends > 0)
    down = float(np.log10(train + 0.5 * (distinct + 1)))
    # Words of over one part in 2 ** 21 of all tokens: no more than 2 ** 21 of them.
    most = words.where(F.col("n") > max(0, train >> 21)).select("word", "n").toArrow()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w.as_py()) for w in most["word"]), dtype=np.uint64, count=len(most))
    common = Table(hashes)
    logs = np.log10(most["n"].to_numpy()[common.order] + 0.5) - down
    common.order = None
    scores = _scores(counts, order)
    shared = docs.sparkSession.sparkContext.broadcast((*_most(scores, share), common, logs))
    end = float(np.log10(ends + 0.5)) - down
    kind = dict(rows.dtypes)["doc_id"]
    first = rows.mapInArrow(_score(shared, order), f"doc_id {kind}, held_out boolean, n_tokens long, n_common long, common double, score double, rare array<binary>, others array<long>")
    first = checkpointed(first.withColumn("row", F.monotonically_increasing_id()))
    rare = first.select("row", F.explode("rare").alias("word"))
    found = rare.join(words, "word", "left").groupBy("row").agg(F.count("n").alias("n_rare"), F.sum(F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.5) - down).alias("rare_sum"))
    other = first.select("row", F.explode("others").alias("window")).groupBy("row", "window").agg(F.count(F.lit(1)).alias("times"))
    other = other.join(scores, "window").groupBy("row").agg(F.sum(F.col("times") * F.col("score")).alias("other_sum"))
    all_rows = first.join(found, "row", "left").join(other, "row", "left")
    return all_rows.select("doc_id", "held_out", "n_tokens", (F.col("n_common") + F.coalesce("n_rare", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"), F.lit(train).cast("long").alias("train_tokens"), (F.col("common") + F.coalesce("rare_sum", F.lit(0.0)) + F.lit(end)).alias("base_score"), (F.col("score") + F.coalesce("other_sum", F.lit(0.0))).alias("score"))
