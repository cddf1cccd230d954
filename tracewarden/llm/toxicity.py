"""Toxicity scores from a small convolutional network written in numpy.

A word's embedding is the sum of hashed, learnt vectors of the word and of its first letters (so that words built on one
stem are related even if the word itself was never seen); filters of several widths run over the text, each keeps its largest
response anywhere in it (so one passage in a long text is enough), and a logistic layer turns these into a score. It learns
from every labelled row: rows are dealt into parts by a hash, tasks train copies of the network on a part each, and the copies
are averaged after every round. Scores are shifted per language, so that 0.7 is the threshold that serves each language best.
Languages are not named: the most frequent words are grouped by the texts they occur in (they are function words, which tell
languages apart), and a text is guessed to be of the group whose profile is nearest.
"""

from __future__ import annotations

import copy
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import clean_shuffles, discard, id_remainder, labelled_rows, materialise, mix, pieces, scratch_dir, ship, slices, starts_of, utf8

BUCKETS, DIM, FILTERS = 1 << 16, 16, 24
WIDTHS = (1, 2, 3)
#: Lengths of the beginnings of a word that have vectors of their own.
BEGINNINGS = (3, 4, 5, 6, 7)
PARTS = 1 + len(BEGINNINGS)
EPOCHS, BATCH, RATE = 6, 32, 0.01
#: Rows and bytes of text of a part, about, and copies of the network that are trained at once.
PART_ROWS, PART_BYTES, WIDE = 8_000, 32_000_000, 16
#: Ranges of buckets that are averaged by a task each.
SLICES = 8
CUT = 0.7
#: Weight of clean texts in setting thresholds.
CLEAN = 0.75
#: Toxic texts that a language needs in calibration for a threshold of its own.
LEAST = 25

#: Frequent words that tell languages apart, groups to begin with, and likeness from which two groups are one language.
FREQUENT, GROUPS, SAME = 256, 12, 0.5
#: Bytes of text that are split at once, places of texts whose responses are held at once, words counted before they are sent.
SPLIT_BYTES, BLOCK, COUNTED = 1 << 18, 1 << 13, 200_000

_MARKS = b".,;:!?\"'()[]{}*#$%&|<>-_~"
_SPACES = b" \t\n\v\f\r"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: 2 for white space, 1 for marks, 0 for other bytes.
_KIND = np.array([2 if i in _SPACES else int(i in _MARKS) for i in range(256)], np.uint8)

#: Words are hashed as numbers of this base, modulo 2 ** 64, whose digits are their bytes plus one; what is added for whole words.
BASE, WHOLE = 0x9E3779B97F4A7C15, np.uint64(0xD1B54A32D192ED03)


def split(text: bytes) -> Iterator[bytes]:
    """The text in pieces of whole words, of at most SPLIT_BYTES; a longer word is a piece of its own."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > SPLIT_BYTES:
            end = 1 + max(text.rfind(c, at, at + SPLIT_BYTES) for c in _SPACES)
            if not end:
                gap = _SPACE.search(text, at + SPLIT_BYTES)
                end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


@lru_cache(2)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def buckets_of(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words at these places of a text (without marks around them), a place of each distinct one in begin, and
    buckets of beginnings of these (0: the word is shorter)."""
    size = max(2, 1 << (len(text) - 1).bit_length()) if len(text) else 2
    back = powers(pow(BASE, -1, 1 << 64), size)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers(BASE, size)[: len(text)], out=sums[1:])
    at = np.minimum(begin, len(text) - 1)
    hashes = mix((sums[end] - sums[begin]) * back[at] + WHOLE)
    _, one, _ = distinct(hashes)
    begin, end, at = begin[one], end[one], at[one]
    lead = (text & 0xC0) != 0x80  # the first byte of a code point
    leads, upto = np.flatnonzero(lead), np.zeros(len(text) + 1, np.int32)
    np.cumsum(lead, out=upto[1:])
    first, last = upto[begin], upto[end]
    starts = np.zeros((len(one), len(BEGINNINGS)), np.uint32)
    for j, n in enumerate(BEGINNINGS):
        long = np.flatnonzero(last - first >= n)
        stop = np.where(last[long] - first[long] > n, leads[np.minimum(first[long] + n, len(leads) - 1)], end[long])
        starts[long, j] = bucket(mix((sums[stop] - sums[begin[long]]) * back[at[long]]))
    return hashes, one, starts


def bucket(hashes: np.ndarray) -> np.ndarray:
    return np.uint64(1) + hashes % np.uint64(BUCKETS - 1)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place of each, and the number among them of every x."""
    order = np.argsort(x)
    new = np.append(True, x[order[1:]] != x[order[:-1]])[: len(x)]
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    return x[order[new]], order[new], number


def bare_words(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the text's words begin, and where they begin and end without marks around them."""
    kind = _KIND[text]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], kind < 2, [False]))))
    word, after = edge[::2], edge[1::2]
    core, upto = np.flatnonzero(kind == 0), np.zeros(len(text) + 1, np.int32)
    np.cumsum(kind == 0, out=upto[1:])
    first, last = upto[word], upto[after]
    begin, end = word.copy(), word.copy()
    some = last > first
    begin[some], end[some] = core[first[some]], core[last[some] - 1] + 1
    return word, begin, end


def long_word(word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """buckets_of() a word of any length, which is not held as numbers whole."""
    bare, total = word.strip(_MARKS), 0
    for at in range(0, len(bare), SPLIT_BYTES):
        digits = np.frombuffer(bare[at : at + SPLIT_BYTES], np.uint8).astype(np.uint64) + np.uint64(1)
        total += pow(BASE, at, 1 << 64) * int((digits * powers(BASE, SPLIT_BYTES)[: len(digits)]).sum())
    head = np.frombuffer(bare[: 4 * max(BEGINNINGS) + 4], np.uint8)
    starts = buckets_of(head, np.array([0]), np.array([len(head)]))[2]
    return mix(np.array([total % (1 << 64)], np.uint64) + WHOLE), np.array([0]), starts


def hashed(texts: list[bytes]) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """buckets_of() all texts' words, bit by bit in their order, with the text that each word is in."""
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        if held:
            text = np.frombuffer(b" ".join([x for _, x in held]).lower(), np.uint8)
            word, begin, end = bare_words(text)
            at = starts_of(np.array([len(x) + 1 for _, x in held]))
            if len(word):
                yield np.array([i for i, _ in held])[np.searchsorted(at, word, "right") - 1], buckets_of(text, begin, end)
            held.clear()

    for i, x in enumerate(texts):
        for piece in split(x):
            if size + len(piece) > SPLIT_BYTES:
                yield from flush()
                size = 0
            if len(piece) > SPLIT_BYTES:
                yield np.array([i]), long_word(piece.lower())
            else:
                held.append((i, piece))
                size += len(piece) + 1
    yield from flush()


def number_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words by their hashes, in order of these, buckets of their parts, word numbers of all texts (from 1) with
    padding (0) between, starts."""
    gap = max(WIDTHS)
    words, hashes, starts, size = [], [np.zeros(0, np.uint64)], [np.zeros((0, len(BEGINNINGS)), np.uint32)], 0
    count = np.zeros(len(texts), np.int64)
    for text, (own, one, beginnings) in hashed(texts):
        count += np.bincount(text, minlength=len(texts))
        words.append((text.astype(np.int32), (distinct(own)[2] + size).astype(np.int32)))
        hashes.append(own[one])
        starts.append(beginnings)
        size += len(one)
    every, one, again = distinct(np.concatenate(hashes))
    parts = np.concatenate((bucket(every)[:, None].astype(np.uint32), np.concatenate(starts)[one]), 1)
    at = starts_of(count + gap)
    flat, seen = np.zeros(at[-1], np.int64), 0
    for text, number in words:
        flat[np.arange(seen, seen + len(text)) + gap * text] = again[number] + 1
        seen += len(text)
    return every, parts, flat, at[:-1]


def frequent_counts(tags: np.ndarray, flat: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """How often each of n frequent words is in each text; tags: a word's number among them (from 1; 0: none)."""
    text = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(flat))))
    tag = tags[flat]
    known = np.flatnonzero(tag)
    return np.bincount(text[known] * n + tag[known] - 1, minlength=len(at) * n).reshape(len(at), n)


def texts_with(texts: list[bytes], spread: Counter) -> None:
    """Add to spread in how many of the texts each word is."""
    for x in texts:
        spread.update({bare for piece in split(x) for w in set(piece.lower().split()) if (bare := w.strip(_MARKS))})


def together(texts: list[bytes], words: list[bytes]) -> np.ndarray:
    """For each of the words, its row: the shares (in millionths) of all of them in the texts it occurs in, added up. Whole
    numbers, so that sums don't depend on the order of texts."""
    hashes, _, flat, at = number_words(texts)
    counts = frequent_counts(PartTable(words).tags(hashes), flat, at, len(words))
    shares = counts * 1_000_000 // np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return ((counts > 0).T.astype(float) @ shares.astype(float)).astype(np.int64)


def group_words(joint: np.ndarray) -> np.ndarray:
    """A row of unit length over the words for each group of them (spherical k-means of the rows of together(), like groups
    merged)."""
    x = profile(joint[joint.sum(axis=1) > 0].astype(float))
    if not len(x):
        return np.zeros((0, len(joint)))
    centre = profile(x.mean(axis=0, keepdims=True) ** 2)
    for _ in range(GROUPS - 1):  # the word least like all centres so far is the next
        centre = np.concatenate((centre, x[(x @ centre.T).max(axis=1).argmin()][None]))
    for _ in range(20):
        near = (x @ centre.T).argmax(axis=1)
        total = np.stack([x[near == k].sum(axis=0) for k in range(len(centre))])
        size = np.bincount(near, minlength=len(centre))
        centre = total[size > 0] / np.linalg.norm(total[size > 0], axis=1, keepdims=True)
    size = np.bincount((x @ centre.T).argmax(axis=1), minlength=len(centre)).astype(float)
    while len(centre) > 1:
        like = centre @ centre.T - 2 * np.eye(len(centre))
        a, b = np.unravel_index(like.argmax(), like.shape)
        if like[a, b] < SAME:
            break
        both = centre[a] * size[a] + centre[b] * size[b]
        centre[a], size[a] = both / max(np.linalg.norm(both), 1e-12), size[a] + size[b]
        centre, size = np.delete(centre, b, axis=0), np.delete(size, b)
    return centre


def learn_groups(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words, and a row of unit length over them for each group."""
    spread: Counter = Counter()
    texts_with(texts, spread)
    words = [w for w, _ in sorted(spread.items(), key=lambda kv: (-kv[1], kv[0]))[:FREQUENT]]
    return words, group_words(together(texts, words))


def groups_of(rows: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """learn_groups() over a table's column text: sums over all rows, of which FREQUENT words and their squares come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread: Counter = Counter()
        for batch in pieces(batches):
            texts_with(utf8(batch.column(0)), spread)
            if len(spread) >= COUNTED:
                yield pa.RecordBatch.from_pydict({"word": pa.array(spread.keys(), pa.binary()), "n": pa.array(spread.values(), pa.int64())})
                spread.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(spread.keys(), pa.binary()), "n": pa.array(spread.values(), pa.int64())})

    text = rows.select("text")
    counts = text.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = [bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(words), len(words)), np.int64)
        for batch in pieces(batches):
            texts = utf8(batch.column(0))
            for a, b in slices(texts, 2_000_000):
                total += together(texts[a:b], words)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "n": total[i, j]})

    joint = np.zeros((len(words), len(words)), np.int64)
    for r in text.mapInArrow(join, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        joint[r["i"], r["j"]] = r["n"]
    return words, group_words(joint)


def profile(counts: np.ndarray) -> np.ndarray:
    root = np.sqrt(counts)
    return root / np.maximum(np.linalg.norm(root, axis=1, keepdims=True), 1e-12)


class PartTable:
    """Words' numbers among the frequent words (from 1; 0: none). Of one word: PARTS bucket numbers (0: none) and that number,
    as uint32 bytes."""

    def __init__(self, frequent: list[bytes] | None = None):
        hashes = np.array([number_words([w])[0][0] for w in frequent or ()], np.uint64)
        self.number = np.append(np.argsort(hashes) + 1, 0)
        self.hashes = np.append(np.sort(hashes), np.uint64(0))

    def tags(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of distinct words, after that of padding (0)."""
        at = np.searchsorted(self.hashes[:-1], hashes)
        return np.append(0, np.where(self.hashes[at] == hashes, self.number[at], 0))

    def __getitem__(self, word: bytes) -> bytes:
        hashes, parts, _, _ = number_words([word])
        return np.append(parts[0], self.tags(hashes)[1]).astype(np.uint32).tobytes()


def encode(texts: list[bytes], table: PartTable, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts of the distinct words (row 0 pads), word numbers of all texts with padding between, starts, guessed groups."""
    hashes, parts, flat, at = number_words(texts)
    guess = np.zeros(len(texts), np.int64)
    if groups is not None and len(groups):
        counts = frequent_counts(table.tags(hashes), flat, at, groups.shape[1])
        guess = np.where(counts.any(axis=1), (profile(counts) @ groups.T).argmax(axis=1) + 1, 0)
    return np.concatenate((np.zeros((1, PARTS), np.int64), parts)), flat, at, guess


def embed(parts: np.ndarray, e: np.ndarray) -> np.ndarray:
    out = np.take(e, parts[:, 0], axis=0)
    for j in range(1, PARTS):
        out += np.take(e, parts[:, j], axis=0)
    out[0] = 0
    return out


def peaks(emb: np.ndarray, flat: np.ndarray, at: np.ndarray, model: dict, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each text's largest response of every filter, and where it is, if that is wanted."""
    n = len(flat)
    flat = np.append(flat, np.zeros(max(WIDTHS) - 1, np.int64))
    # windows that begin on a text's last pads would reach into the next text
    spill = np.sort((np.append(at[1:], n)[:, None] - np.arange(1, max(WIDTHS))[None, :]).reshape(-1))
    cuts = np.union1d(at, np.arange(0, n, BLOCK))
    first = np.searchsorted(cuts, at)
    # what a word adds to all filters that reach it, by its place in the window
    reach = [[i for i, width in enumerate(WIDTHS) if o < width] for o in range(max(WIDTHS))]
    weights = [np.concatenate([model["w"][i][o] for i in own], 1) for o, own in enumerate(reach)]

    def responses(emb: np.ndarray) -> list[np.ndarray]:
        out = [emb @ w for w in weights]
        out[0] += np.concatenate(model["b"])
        return out

    many = len(emb) > 32 * BLOCK  # then those of a block's words only are held
    tabs = None if many else responses(emb)
    room = [np.empty((min(BLOCK, n), w.shape[1]), w.dtype) for w in weights]
    most, top = [], []
    for s in range(0, n, BLOCK):
        e = min(s + BLOCK, n)
        here = flat[s : e + max(WIDTHS) - 1]
        if many:
            words, _, here = distinct(here)
            tabs = responses(emb[words])
        for o, t in enumerate(tabs):  # clip, as numpy fills a copy of out first without it
            x = np.take(t, here[o : e - s + o], axis=0, out=room[o][: e - s], mode="clip")
            if o:
                z[:, reach[o][0] * FILTERS :] += x
            else:
                z = x
        z[spill[np.searchsorted(spill, s) : np.searchsorted(spill, e)] - s] = -np.inf
        own = cuts[np.searchsorted(cuts, s) : np.searchsorted(cuts, e)] - s
        if places:
            at_most = np.stack([a + z[a:b].argmax(axis=0) for a, b in zip(own, np.append(own[1:], e - s), strict=True)])
            top.append(at_most + s)
            most.append(np.take_along_axis(z, at_most, 0))
        else:
            most.append(np.maximum.reduceat(z, own, axis=0))
    piece = np.concatenate(most)
    best = np.maximum.reduceat(piece, first, axis=0)
    if not places:
        return best, None
    place = np.concatenate(top)
    if len(cuts) > len(at):  # of a text in several pieces, the piece with the largest
        ends = np.append(first[1:], len(cuts))
        place = np.stack([np.take_along_axis(place[a:b], piece[a:b].argmax(axis=0)[None], 0)[0] for a, b in zip(first, ends, strict=True)])
    return best, np.stack(np.split(place, len(WIDTHS), axis=1))


def logits(texts: list[bytes], model: dict, table: PartTable) -> tuple[np.ndarray, np.ndarray]:
    """Raw output and guessed group of each text."""
    parts, flat, at, guess = encode(texts, table, model["groups"])
    best, _ = peaks(embed(parts, model["e"]), flat, at, model)
    return np.maximum(best, 0) @ model["v"] + model["c"], guess


def untrained(seed: int = 2) -> dict:
    """A network with random weights; second: Adam's running squares of gradients, turn: steps so far."""
    rng = np.random.default_rng(seed)
    model = {
        "e": (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32),
        "w": [[(rng.standard_normal((DIM, FILTERS)) * (1 / (DIM * w)) ** 0.5).astype(np.float32) for _ in range(w)] for w in WIDTHS],
        "b": [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        "v": (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.1).astype(np.float32),
        "c": np.float32(0),
        "turn": 0,
    }
    model["e"][0] = 0
    model["second"] = {name: np.zeros_like(x) for name, x in named(model).items()}
    return model


def named(model: dict) -> dict[str, np.ndarray]:
    """The model's arrays that Adam moves, in place."""
    out = {"e": model["e"], "v": model["v"]}
    for i in range(len(WIDTHS)):
        out[f"b{i}"] = model["b"][i]
        out |= {f"w{i}{o}": w for o, w in enumerate(model["w"][i])}
    return out


def code(text: bytes, table: PartTable) -> tuple[bytes, bytes]:
    """What training needs of a text: parts of its distinct words (16 bits each) and its word numbers from 1."""
    return code_all([text], table)[0]


def code_all(texts: list[bytes], table: PartTable) -> list[tuple[bytes, bytes]]:
    parts, flat, at, _ = encode(texts, table)
    parts, out = parts.astype(np.uint16), []
    for a, b in zip(at, np.append(at[1:], len(flat)) - max(WIDTHS), strict=True):
        own, _, number = distinct(flat[a:b])
        out.append((parts[own].tobytes(), (number + 1).astype(number_type(len(own) + 1)).tobytes()))
    return out


def number_type(n: int) -> type:
    return np.uint16 if n <= 1 << 16 else np.uint32


def code_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = PartTable()
    for batch in pieces(batches):
        texts = utf8(batch.column(0))
        for a, b in slices(texts, 2_000_000):
            words, flat = zip(*code_all(texts[a:b], table), strict=True)
            cols = [pa.array(words, pa.binary()), pa.array(flat, pa.binary()), *(c.slice(a, b - a) for c in batch.columns[1:])]
            yield pa.RecordBatch.from_arrays(cols, names=["words", "flat", *batch.schema.names[1:]])


def gather(coded: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """encode()'s first three results, from code() of the texts; words of two texts have two rows."""
    parts, flat, at, shift, size = [np.zeros((1, PARTS), np.int64)], [], [], 0, 0
    for words, numbers in coded:
        parts.append(np.frombuffer(words, np.uint16).reshape(-1, PARTS).astype(np.int64))
        flat += [np.frombuffer(numbers, number_type(len(parts[-1]) + 1)).astype(np.int64) + shift, np.zeros(max(WIDTHS), np.int64)]
        at.append(size)
        shift += len(parts[-1])
        size += len(flat[-2]) + max(WIDTHS)
    return np.concatenate(parts), np.concatenate(flat), np.array(at, np.int64)


def add_rows(to: np.ndarray, rows: np.ndarray, x: np.ndarray) -> None:
    """np.add.at(to, rows, x), in the same order but number by number, which numpy has a fast loop for."""
    at = rows[:, None] * to.shape[1] + np.arange(to.shape[1])
    np.add.at(to.reshape(-1), at.reshape(-1), x.reshape(-1))


def train(rows: Iterator[tuple[tuple[bytes, bytes], int]], model: dict, weight: dict[int, float]) -> np.ndarray:
    """Move the model by Adam on minibatches, once through the rows (code() of a text, y); which rows of e were moved. Only the
    position of each filter's largest response gets a gradient."""
    value, second = named(model), model["second"]
    first = {name: np.zeros_like(x) for name, x in value.items()}
    moved = np.zeros(BUCKETS, bool)
    own = 0

    def adam(name: str, grad: np.ndarray, rows: np.ndarray | None = None):
        m, v, x, turn = first[name], second[name], value[name], model["turn"]
        if rows is None:
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            x -= RATE * (m / (1 - 0.9**own)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-7)
        else:  # sparse: only rows that were used
            its_m, its_v = m[rows], v[rows]
            its_m += 0.1 * (grad - its_m)
            its_v += 0.001 * (grad * grad - its_v)
            m[rows], v[rows] = its_m, its_v
            x[rows] -= RATE * its_m / (np.sqrt(its_v / (1 - 0.999**turn)) + 1e-7)
            moved[rows] = True

    while batch := list(islice(rows, BATCH)):
        own += 1
        model["turn"] += 1
        parts, flat, at = gather([x for x, _ in batch])
        y = np.array([c for _, c in batch], np.float32)
        scale = np.array([weight[c] for _, c in batch], np.float32) / len(batch)
        emb = embed(parts, model["e"])
        hidden, where = peaks(emb, flat, at, model, places=True)
        act = np.maximum(hidden, 0)
        out = act @ model["v"] + model["c"]
        g = ((1 / (1 + np.exp(-out)) - y) * scale).astype(np.float32)
        back = g[:, None] * model["v"][None, :] * (hidden > 0)
        adam("v", act.T @ g + 1e-4 * model["v"])
        model["c"] -= np.float32(RATE) * g.sum()
        grad_e = np.zeros(emb.shape)  # adding in single precision is slow once rows are learnt well (probably subnormal numbers)
        flat = np.append(flat, np.zeros(max(WIDTHS) - 1, np.int64))
        for i, width in enumerate(WIDTHS):
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            for o in range(width):
                words = flat[where[i] + o]
                x = emb[words]
                add_rows(grad_e, words.reshape(-1), (part[:, :, None].astype(float) * model["w"][i][o].T[None, :, :]).reshape(-1, DIM))
                adam(f"w{i}{o}", np.einsum("df,dfk->kf", part, x))
            adam(f"b{i}", part.sum(axis=0))
        hit = np.flatnonzero(np.abs(grad_e).sum(axis=1))
        used, back_to = np.unique(parts[hit], return_inverse=True)
        total = np.zeros((len(used), DIM))
        add_rows(total, back_to.reshape(-1), np.repeat(grad_e[hit], PARTS, axis=0))
        adam("e", total[used != 0].astype(np.float32), used[used != 0])
    return moved


def train_part(shared, weight: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part = copy.deepcopy(shared.value), -1

        def rows() -> Iterator[tuple[tuple[bytes, bytes], int]]:
            nonlocal part
            for batch in pieces(batches, 200):
                part = batch.column(0)[0].as_py()
                words, flat, y = (c.to_pylist() for c in batch.columns[1:])
                yield from zip(zip(words, flat, strict=True), y, strict=True)

        moved = train(rows(), model, weight).reshape(SLICES, -1)
        if part < 0:
            return
        dense = {"c": model["c"], **{name: x for name, x in named(model).items() if name != "e"}}
        dense = dense, {name: x for name, x in model["second"].items() if name != "e"}, model["turn"]
        e, second = (x.reshape(SLICES, -1, DIM) for x in (model["e"], model["second"]["e"]))
        for i in range(SLICES):
            at = np.flatnonzero(moved[i])
            payload = pickle.dumps((at, e[i][at], second[i][at], dense if i == 0 else None))
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "part": pa.array([part], pa.int32()), "model": pa.array([payload], pa.binary())})

    return run


def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of one slice of trained copies (rows in order of parts); of rows of e, the mean over the copies that moved
    them, so that a word of few parts is learnt as well as one of many."""
    e, second, times = np.zeros((BUCKETS // SLICES, DIM)), np.zeros((BUCKETS // SLICES, DIM)), np.zeros(BUCKETS // SLICES)
    here, others = -1, []
    for batch in pieces(batches, 1):
        here = batch.column(0)[0].as_py()
        at, its_e, its_second, dense = pickle.loads(batch.column(2)[0].as_py())
        e[at] += its_e
        second[at] += its_second
        times[at] += 1
        if dense is not None:
            others.append(dense)
    if here < 0:
        return
    dense = None
    if others:
        means = [{name: np.mean([x[i][name] for x in others], axis=0, dtype=float).astype(np.float32) for name in others[0][i]} for i in (0, 1)]
        dense = *means, max(x[2] for x in others)
    at = np.flatnonzero(times)
    mean = [(x[at] / times[at, None]).astype(np.float32) for x in (e, second)]
    yield pa.RecordBatch.from_pydict({"slice": pa.array([here], pa.int32()), "model": pa.array([pickle.dumps((at, *mean, dense))], pa.binary())})


def take(model: dict, here: int, payload: bytes) -> None:
    """Put a slice's mean into the model."""
    at, e, second, dense = pickle.loads(payload)
    at = at + here * (BUCKETS // SLICES)
    model["e"][at], model["second"]["e"][at] = e, second
    if dense is not None:
        own = named(model)
        for name in own.keys() - {"e"}:
            own[name][:], model["second"][name][:] = dense[0][name], dense[1][name]
        model["c"], model["turn"] = dense[0]["c"], dense[2]


def rounds(parts: int) -> Iterator[range]:
    """Parts trained on at once: each EPOCHS times, at first one by one, then as many as were seen before, WIDE at most."""
    seen = 0
    for _ in range(EPOCHS):
        at = 0
        while at < parts:
            width = min(parts - at, WIDE, max(1, seen))
            yield range(at, at + width)
            at, seen = at + width, seen + width


def fit_network(rows: DataFrame, count: dict[int, int], size: int, folder: str) -> dict:
    """Train on all rows (text, y, point); count: rows by y, size: bytes of their texts."""
    spark, n = rows.sparkSession, sum(count.values())
    parts = max(1, -(-n // PART_ROWS), -(-size // PART_BYTES))
    weight = {y: n / (2 * c) for y, c in count.items()}
    part = F.pmod(F.xxhash64("point", F.lit(3)), F.lit(parts)).cast("int")
    dealt = rows.select("text", part.alias("part"), "y", "point").mapInArrow(code_rows, "words binary, flat binary, part int, y int, point long")
    dealt = materialise(dealt.repartitionById(parts, F.col("part")), "parts", folder, by="part")
    model = untrained()
    for i, now in enumerate(rounds(parts)):
        shared = spark.sparkContext.broadcast(model)
        some = dealt.where(F.col("part").between(now[0], now[-1])).repartitionById(len(now), F.col("part") - now[0])
        some = some.sortWithinPartitions(F.xxhash64("point", F.lit(i)), "point").select("part", "words", "flat", "y")
        copies = some.mapInArrow(train_part(shared, weight), "slice int, part int, model binary")
        copies = copies.repartitionById(SLICES, F.col("slice")).sortWithinPartitions("slice", "part")
        with clean_shuffles(spark):
            means = copies.mapInArrow(average, "slice int, model binary").collect()
        for r in means:
            take(model, r["slice"], r["model"])
        shared.destroy()
    return {k: x for k, x in model.items() if k not in ("second", "turn")}


def best_edges(outputs: DataFrame) -> dict[int, tuple[float, int, int]]:
    """Where to cut the outputs (guess, z, y) of each guess, and of all as guess -1; with numbers of toxic and clean texts.

    A cut has most toxic texts above, and most clean ones below, which count more (CLEAN); of equally good cuts it is the
    middle of the widest gap, the lowest of these. Running counts go bin by bin of z, so that no task sorts all outputs.
    """
    spark = outputs.sparkSession
    step = (F.signum("z") * F.floor(F.log1p(F.abs("z")) * 64)).cast("int")
    rows = outputs.select(F.explode(F.array(F.lit(-1), "guess")).alias("k"), "z", "y")
    rows = rows.groupBy("k", "z").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).withColumn("bin", step)
    bins = rows.groupBy("k", "bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.min("z").alias("low")).orderBy("k", "bin").collect()
    out, table = {}, []
    for k in sorted({r["k"] for r in bins}):
        own = [r for r in bins if r["k"] == k]
        toxic, clean = sum(r["p"] for r in own), sum(r["n"] for r in own)
        out[k] = (own[0]["low"], toxic, clean)
        p = n = 0
        for r, after in zip(own, [*own[1:], None], strict=True):
            table.append((k, r["bin"], p, n, after["low"] if after else None, (1 - CLEAN) / max(1, toxic), CLEAN / max(1, clean), toxic))
            p, n = p + r["p"], n + r["n"]
    if not table:
        return out
    bins = spark.createDataFrame(table, "k int, bin int, p0 long, n0 long, after double, wp double, wn double, toxic long")
    upto = Window.partitionBy("k", "bin").orderBy("z")
    rows = rows.join(F.broadcast(bins), ["k", "bin"]).select(
        "k", "z", "wp", "wn", "toxic", (F.col("p0") + F.sum("p").over(upto)).alias("p"), (F.col("n0") + F.sum("n").over(upto)).alias("n"),
        F.coalesce(F.lead("z").over(upto), "after").alias("next"),
    )
    good = F.round(F.col("wp") * (F.col("toxic") - F.col("p")) + F.col("wn") * F.col("n"), 9)
    key = F.struct(good.alias("good"), (F.col("next") - F.col("z")).alias("gap"), (-F.col("z")).alias("low"))
    best = rows.where(F.col("next").isNotNull()).groupBy("k").agg(F.max_by((F.col("z") + F.col("next")) / 2, key).alias("edge"))
    return out | {r["k"]: (r["edge"], *out[r["k"]][1:]) for r in best.collect()}


def raw_outputs(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = PartTable(model["words"])
        for batch in pieces(batches):
            texts = utf8(batch.column(0))
            for a, b in slices(texts, 2_000_000):
                z, guess = logits(texts[a:b], model, table)
                yield pa.RecordBatch.from_arrays([pa.array(guess, pa.int32()), pa.array(z.astype(np.float64)), batch.column(1).slice(a, b - a)], names=["guess", "z", "y"])

    return run


def fit_toxicity(documents: DataFrame, labels: DataFrame, learn=None) -> dict:
    """Learn from all labelled texts: a fifth of them, by a hash, sets the thresholds, the others train the network, and the
    groups of frequent words come from both. A row that occurs repeatedly counts repeatedly.

    Without texts of both classes the model says 0.5 (nothing to learn from) or leans to the only class seen.
    """
    spark = documents.sparkSession
    ship(spark)
    folder = scratch_dir(spark)
    try:
        rows = materialise(labelled_rows(documents, labels, "toxic", F.lit(True) if learn is None else learn), "labelled", folder)
        aside = F.pmod("point", F.lit(5)) == 0
        stats = rows.groupBy("y", aside.alias("aside")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).collect()
        seen = {r["y"] for r in stats}
        if len(seen) < 2:
            return {"constant": 0.05 + 0.9 * float(seen.pop()) if seen else 0.5}
        kept, check = rows.where(~aside), rows.where(aside)
        if len(stats) < 4:  # too few for both purposes
            kept = check = rows
        else:
            stats = [r for r in stats if not r["aside"]]
        count = {y: sum(r["n"] for r in stats if r["y"] == y) for y in (0, 1)}
        model = fit_network(kept, count, sum(r["size"] for r in stats), folder)
        model["words"], model["groups"] = groups_of(rows)
        shared = spark.sparkContext.broadcast(model)
        outputs = check.select("text", "y").mapInArrow(raw_outputs(shared), "guess int, z double, y int")
        edges = best_edges(materialise(outputs, "outputs", folder))
        shared.destroy()
    finally:
        discard(spark, folder)
    model["edge"] = np.full(len(model["groups"]) + 1, edges[-1][0])
    for k, (edge, toxic, clean) in edges.items():
        if k >= 0 and toxic >= LEAST and clean >= LEAST:
            model["edge"][k] = edge
    return model


def score_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = PartTable(model.get("words"))
        for batch in pieces(batches):
            texts = utf8(batch.column(1))
            for a, b in slices(texts, 2_000_000):
                if "constant" in model:
                    score, guess = np.full(b - a, model["constant"]), np.zeros(b - a, np.int64)
                else:
                    z, guess = logits(texts[a:b], model, table)
                    z = z - model["edge"][guess] + np.log(CUT / (1 - CUT))
                    score = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
                lang = pa.array(guess, pa.int32(), mask=guess == 0)
                cols = [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(score.astype(np.float64)), lang]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "guess"])

    return run


def score_toxicity(documents: DataFrame, labels: DataFrame, held_out: int = 1, modulus: int = 3) -> DataFrame:
    """Fit on rows whose id remainder is not held_out, score all: doc_id, held_out, score (0 to 1), predicted, guess.

    predicted is 1 if score >= 0.7. The score depends on the text alone; guess numbers the group of
    texts, by language, from which its threshold was taken (null: it has no frequent word). Null and empty texts are scored as texts without words. Rows are judged one by one, repeated
    rows alike; an empty table gives an empty result. Other columns are ignored.
    """
    spark = documents.sparkSession
    ship(spark)
    aside = id_remainder("doc_id", modulus) == held_out
    shared = spark.sparkContext.broadcast(fit_toxicity(documents, labels, ~aside))
    id_type = documents.schema["doc_id"].dataType.simpleString()
    out = documents.select("doc_id", "text", aside.alias("held_out")).mapInArrow(score_rows(shared), f"doc_id {id_type}, held_out boolean, score double, guess int")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "guess")
