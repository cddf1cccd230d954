"""Best-two-fit packing of documents into fixed-length sequences.

Packing looks at lengths only, so it is solved on the histogram of piece lengths: at most `limit` numbers, whatever the
size of the corpus. A sequence is filled greedily, largest length first; then its smallest piece is exchanged for two
unpacked pieces if these fill the gap more tightly. The layout found is used as often as the counts allow before the next
one is sought. Pieces then find their place by their rank among pieces of equal length. Ranks are local ranks of a
partition plus an offset from per-partition counts, so that no length, however common, is gathered in one task.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, pieces, scratch_dir, ship, utf8

#: Words whose ids a worker remembers, and as many from before.
ID_TABLE = 200_000

#: An ASCII-lettered end and what follows never share a token, so both can be looked up apart.
LETTERS_THEN_MARKS = re.compile(rb"([A-Za-z\x80-\xff]*[A-Za-z])([.,;:!?|#*$%&]+)\Z")


#: Letters whose case and normal form are plain, so that the vocabulary's model can be asked without its normaliser.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def byte_letters() -> dict[int, int]:
    """How byte-level vocabularies spell bytes: printable Latin-1 characters stand for themselves, the others follow."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class IdTable(dict):
    """Bytes without ASCII white space -> their token ids as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words, end to end. A full
    table becomes the old one, from which words that are met again come back without being tokenized.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.encode = tokenizer.encode
        self.spell = tokenizer.model.tokenize
        self.letters = byte_letters()
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= ID_TABLE:
            self.old = dict(self)
            self.clear()
        out = self.old.get(word)
        if out is None:
            out = self.look_up(word)
        self[word] = out
        return out

    def look_up(self, word: bytes) -> bytes:
        m = LETTERS_THEN_MARKS.fullmatch(word)
        if m:
            return self[m[1]] + self[m[2]]
        text = word.decode("utf-8")
        if PLAIN.fullmatch(text):
            spelled = text.lower().encode("utf-8").decode("latin-1").translate(self.letters)
            ids = [x.id for x in self.spell(spelled)]
        else:
            ids = self.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


#: One table per worker process and vocabulary; workers run many tasks.
_TABLES: dict[str, IdTable] = {}


def id_table(path: str) -> IdTable:
    if path not in _TABLES:
        from tokenizers import Tokenizer

        _TABLES[path] = IdTable(Tokenizer.from_file(path))
    return _TABLES[path]


def text_ids(text: bytes, table: IdTable) -> bytes:
    # letter case is dropped by the tokenizer; doing so first makes fewer words, but must not create special tokens
    words = text.split() if b"<" in text else text.lower().split()
    return b"".join(map(table.__getitem__, words))


def piece_rows(tokenizer_path: str, limit: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = id_table(tokenizer_path)
        end = int(end_id).to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        ranks: dict[int, int] = defaultdict(int)
        width = 4 * limit
        for batch in pieces(batches):
            ids = batch.column(0)
            source, piece, start, length, crc, rank, payload = [], [], [], [], [], [], []

            def flush():
                cols = [ids.take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                cols += [pa.array([part] * len(source), pa.int32()), pa.array(rank, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
                if with_ids:
                    flat = np.frombuffer(b"".join(payload), "<u4").astype(np.int32)
                    offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                    names.append("ids")
                out = pa.RecordBatch.from_arrays(cols, names=names)
                for x in (source, piece, start, length, crc, rank, payload):
                    x.clear()
                return out

            held = 0
            for i, text in enumerate(utf8(batch.column(1))):
                tokens = text_ids(text, table) + end
                for k, at in enumerate(range(0, len(tokens), width)):
                    part_ids = tokens[at : at + width]
                    n = len(part_ids) // 4
                    source.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(part_ids))
                    rank.append(ranks[n])
                    ranks[n] += 1
                    if with_ids:
                        payload.append(part_ids)
                held += len(tokens)
                if held > 16_000_000:
                    yield flush()
                    held = 0
            yield flush()

    return run


def solve(counts: dict[int, int], limit: int) -> list[tuple[int, list[int]]]:
    """Best-two-fit on a histogram {length: count}: [(times, lengths of one sequence, largest first)]."""
    left = np.zeros(limit + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    out = []
    sizes = np.arange(limit + 1)

    def largest() -> np.ndarray:
        """For every room, the largest length still there that fits, else 0."""
        return np.maximum.accumulate(np.where(left > 0, sizes, 0))

    at_most = largest()
    while at_most[limit]:
        room, bin_ = limit, []
        while room and (n := int(at_most[room])):
            bin_.append(n)
            left[n] -= 1
            room -= n
            if not left[n]:
                at_most = largest()
        if room and len(bin_) > 1:
            small = bin_[-1]
            gap = room + small
            one = np.flatnonzero(left[:gap] > 0)
            if len(one):
                # with one piece of length x chosen, the best partner is the largest that fits beside it
                two = at_most[gap - one]
                ok = (two > 0) & ((two != one) | (left[one] > 1))
                total = np.where(ok, one + two, 0)
                same = (two == one) & (left[one] == 1) & (two > 1)
                if same.any():
                    below = at_most[np.maximum(one - 1, 0)]
                    total = np.where(same & (below > 0), one + below, total)
                    two = np.where(same, below, two)
                best = int(total.argmax())
                if total[best] > small:
                    left[small] += 1
                    left[one[best]] -= 1
                    left[two[best]] -= 1
                    bin_[-1:] = sorted((int(one[best]), int(two[best])), reverse=True)
                    at_most = largest()
        use = np.bincount(bin_, minlength=limit + 1)
        used = np.flatnonzero(use)
        more = int((left[used] // use[used]).min())
        if more:
            left[used] -= more * use[used]
            at_most = largest()
        out.append((1 + more, sorted(bin_, reverse=True)))
    return out


def layout(patterns: list[tuple[int, list[int]]]) -> tuple[np.ndarray, ...]:
    """Sorted by (length, first rank): length, first rank, pieces per sequence, first sequence, offset in it."""
    taken: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for times, lengths in patterns:
        at = 0
        for n in dict.fromkeys(lengths):
            per = lengths.count(n)
            rows.append((n, taken[n], per, base, at))
            taken[n] += per * times
            at += per * n
        base += times
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else tuple(np.empty(0, np.int64) for _ in range(5))


def place_rows(spot):
    """Adds sequence_id and offset to rows that start with (length, rank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, per, base, at = spot.value
        key = n * (1 << 44) + first
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(0).to_numpy(zero_copy_only=False)
            rank = batch.column(1).to_numpy(zero_copy_only=False)
            i = np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1
            seq = base[i] + (rank - first[i]) // per[i]
            offset = at[i] + (rank - first[i]) % per[i] * length
            names = batch.schema.names[2:] + ["length", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], batch.column(0), pa.array(seq), pa.array(offset)], names=names)

    return run


def pack(documents: DataFrame, tokenizer_path: str, limit: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Pack documents into sequences of at most `limit` tokens.

    One row per piece: doc_id, piece, start, ids_crc32, [ids,] length, sequence_id, offset. A document's tokens are its
    text's ids and then end_id; only longer ones are cut, into pieces of `limit` tokens and a rest. Pieces of a sequence lie
    end to end from offset 0. Null and empty texts are the end token alone. Rows that repeat a document are packed as often
    as they occur. An empty table gives an empty result. Other columns are ignored.
    """
    spark = documents.sparkSession
    ship(spark)
    folder = scratch_dir(spark)
    id_type = documents.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, part int, rank long" + (", ids array<int>" if with_ids else "")
    pieces = documents.select("doc_id", "text").mapInArrow(piece_rows(tokenizer_path, limit, end_id, with_ids), kinds)
    pieces = materialise(pieces, "pieces", folder)
    tally = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tally = tally.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    tally = materialise(tally, "tally", folder)
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `limit` rows
    spot = spark.sparkContext.broadcast(layout(solve(counts, limit)))
    payload = ["doc_id", "piece", "start", "ids_crc32"] + (["ids"] if with_ids else [])
    ranked = pieces.join(tally.drop("n"), ["part", "length"]).select("length", (F.col("rank") + F.col("base")).alias("rank"), *payload)
    kinds = f"doc_id {id_type}, piece int, start long, ids_crc32 long, " + ("ids array<int>, " if with_ids else "") + "length long, sequence_id long, offset long"
    return ranked.mapInArrow(place_rows(spot), kinds)
