"""Sampled SentencePiece segmentation: forward filtering, backward sampling over the piece lattice.

A segmentation is drawn with a probability proportional to the product of its pieces' weights to the power ``alpha``. The
model is a merge list, which has no probabilities; the weight of its piece of rank r is taken as ``1 / (r + 2)``, which is
how ranked frequencies fall. No piece crosses a newline or holds a space that isn't leading, so the lattice of a text falls
apart, without loss, into those of its words with the spaces before them. A word's lattice is filtered once and kept in a
bounded cache; all words of a batch are then sampled together, a piece at a time from their ends.

Uniform numbers are a hash of seed, row key, word position and step: they don't depend on batches, partitions or order.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, text_of

SPACE = "▁"
#: Words whose lattices a worker keeps; words sampled at a time; documents in a batch that is passed on; lattices made at a time.
CACHED, WORDS_AT_ONCE, DOCUMENTS_AT_ONCE, MADE_AT_ONCE = 150_000, 1 << 15, 512, 1024
#: A constant for each character of a piece keeps the filtered sums near 1; it is the same for every segmentation.
_SCALE = 60.0
_WORDS = re.compile(" *[^ ]+| +")
#: Above it in a symbol's number: a byte. Longest words whose sums need no scaling.
_BYTE, _LONG = 0x110000, 48
_GOLD, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class Lattices:
    """Nodes of all kept lattices are numbered through; a node's arcs lead to earlier nodes of its word.

    Lattices of many new words are made together: the vocabulary's prefixes are looked up by hash for all places at once,
    and the sums run forward a place at a time over all words.
    """

    def __init__(self, path: str | None = None, alpha: float = 1.0):
        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        n = model.vocab_size()
        self.byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): (i, (2.0 - model.get_score(i)) ** -alpha * _SCALE ** len(model.id_to_piece(i))) for i in plain}
        self.surface = [b""] * n
        for b, i in self.byte_ids.items():
            self.surface[i] = bytes([b])
        for p, (i, _) in self.pieces.items():
            self.surface[i] = p.replace(SPACE, " ").encode()
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(p) for p in self.pieces if len(p) == 1]] = True
        self._table()
        self._empty()

    def _table(self) -> None:
        """Hashes of all prefixes of pieces, sorted, each with its piece (or -1), the weight and whether more follows."""
        made = {"": 0}
        more = set()
        for p in self.pieces:
            for k in range(1, len(p) + 1):
                if p[:k] not in made:
                    made[p[:k]] = _hash(made[p[: k - 1]], ord(p[k - 1]))
                    more.add(p[: k - 1])
        del made[""]
        rows = [(h, *self.pieces.get(p, (-1, 0.0)), p in more) for p, h in made.items()]
        rows += [(_hash(0, _BYTE + b), i, 1.0, False) for b, i in self.byte_ids.items()]
        rows.sort()
        hashes, ids, weights, more = zip(*rows, strict=True)
        self.hashes = np.array(hashes, np.uint64)
        assert (self.hashes[1:] != self.hashes[:-1]).all()
        self.ids, self.weights, self.more = np.array(ids, np.int32), np.array(weights), np.array(more)
        self.longest = max(map(len, self.pieces))
        size = 1 << 18  # leading hash bits: where to start looking
        self.jump = np.searchsorted(self.hashes, np.arange(size + 1, dtype=np.uint64) << np.uint64(46))

    def _empty(self) -> None:
        self.ends: dict[str, int] = {}
        self.nodes = self.arcs = 0
        self.first, self.count = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int8)  # by node: its first arc, its arcs
        # by arc: the share of it and those before it at its node, the nodes it leads back, its piece
        self.cum, self.back, self.piece = np.empty(1 << 18, np.float32), np.empty(1 << 18, np.int8), np.empty(1 << 18, np.uint16 if len(self.surface) <= 1 << 16 else np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        at = self.jump[(h >> np.uint64(46)).astype(np.int64)]
        last = len(self.hashes) - 1
        while len(low := np.flatnonzero(self.hashes[np.minimum(at, last)] < h)):
            low = low[at[low] < last]
            if not len(low):
                break
            at[low] += 1
        at = np.minimum(at, last)
        return np.where(self.hashes[at] == h, at, -1)

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters as numbers, the space as its mark, what the vocabulary lacks as bytes; and symbols by word."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        s = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        mark = s == ord(SPACE)
        s[s == 32] = ord(SPACE)
        odd = np.flatnonzero(mark | ~self.known[s])
        if not len(odd):
            return s, n
        owner = np.repeat(np.arange(len(words)), n)[odd]
        raw = [np.frombuffer(chr(c).encode(), np.uint8).astype(np.int64) + _BYTE for c in s[odd].tolist()]
        np.add.at(n, owner, [len(r) - 1 for r in raw])
        return np.concatenate([x for i, r in zip(np.split(s, odd), [None, *raw]) for x in ((i,) if r is None else (r, i[1:]))]), n

    def add(self, words: list[str]) -> None:
        """Makes the lattices of words that aren't known yet; words may lead with spaces."""
        for i in range(0, len(words), MADE_AT_ONCE):
            self._add(words[i : i + MADE_AT_ONCE])

    def _add(self, words: list[str]) -> None:
        s, n = self._symbols(words)
        base = np.cumsum(n + 1) - (n + 1)  # a word of n symbols has n + 1 nodes
        total = int((n + 1).sum())
        owner = np.repeat(np.arange(len(words)), n)
        node = np.arange(len(s)) + owner  # at which a symbol begins
        left = (base + n)[owner] - node
        rows = np.full((total, self.longest), -1, np.int32)  # by node and length: the piece that ends there
        active, h, most = np.arange(len(s)), np.zeros(len(s), np.uint64), 0
        for k in range(1, self.longest + 1):
            h = _mix((h + s[active + k - 1].astype(np.uint64)) * _GOLD)
            row = self._find(h)
            hit = np.flatnonzero(row >= 0)
            active, h, row = active[hit], h[hit], row[hit]
            piece = np.flatnonzero(self.ids[row] >= 0)
            rows[node[active[piece]] + k, k - 1] = row[piece]
            most = k if len(piece) else most
            on = np.flatnonzero(self.more[row] & (left[active] > k))
            active, h = active[on], h[on]
            if not len(active):
                break
        rows = rows[:, :most]
        w = np.where(rows >= 0, self.weights[rows], 0.0)
        longest = int(n.max(initial=0))
        logs = longest > _LONG
        alpha = np.zeros(total)  # of long words: its logarithm
        alpha[base] = 0.0 if logs else 1.0
        for step in range(1, longest + 1):
            at = base[n >= step] + step
            k = min(step, most)
            before = alpha[at[:, None] - np.arange(1, k + 1)]
            p = w[at, :k] * (np.exp(before - before[:, :1]) if logs else before)
            sums = p.sum(1)
            alpha[at] = before[:, 0] + np.log(sums) if logs else sums
            w[at, :k] = p / sums[:, None]
        end, k = np.nonzero(rows >= 0)
        count = np.bincount(end, minlength=total)
        cum = np.cumsum(w, 1)[end, k] if most else np.empty(0)
        first = np.cumsum(count) - count
        cum[(first + count - 1)[count > 0]] = 2.0  # the last arc takes what rounding leaves
        self.first = _append(self.first, self.nodes, first + self.arcs)
        self.count = _append(self.count, self.nodes, count)
        self.cum = _append(self.cum, self.arcs, cum)
        self.back = _append(self.back, self.arcs, k + 1)
        self.piece = _append(self.piece, self.arcs, self.ids[rows[end, k]])
        self.ends.update(zip(words, (base + n + self.nodes).tolist(), strict=True))
        self.nodes += total
        self.arcs += len(end)

    def words(self, text: str) -> list[str]:
        out = []
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append("\n")
            if not line:
                continue
            if "  " in line or line[-1] == " ":
                out += _WORDS.findall(line)
            else:
                first, *rest = line.split(" ")
                if first:
                    out.append(first)
                out += [" " + w for w in rest]
        return out

    def sample(self, words: list[str], keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each word has. keys, places: each word's row key and position in its row."""
        if len(self.ends) > CACHED:
            self._empty()
        if new := [w for w in set(words) if w not in self.ends]:
            for long in (False, True):
                if some := [w for w in new if (len(w) > _LONG) == long]:
                    self.add(some)
        at = np.fromiter(map(self.ends.__getitem__, words), np.int64, len(words))
        first, count, cum, back, piece = self.first, self.count, self.cum, self.back, self.piece
        base = _mix(keys + places.astype(np.uint64) * _GOLD)
        alive = np.arange(len(words))
        taken, lengths, step = [], np.zeros(len(words), np.int64), 0
        while len(alive):
            u = (_mix(base[alive] + _mix(np.array([step + 1], np.uint64))) >> np.uint64(11)) * 2.0**-53
            arc = first[at].astype(np.int64)
            many = np.flatnonzero(cum[arc] <= u)
            while len(many):
                arc[many] += 1
                many = many[cum[arc[many]] <= u[many]]
            taken.append((alive, piece[arc]))
            lengths[alive] += 1
            at = at - back[arc]
            live = count[at] > 0
            alive, at, step = alive[live], at[live], step + 1
        ids = np.empty(int(lengths.sum()), np.int32)
        last = np.cumsum(lengths) - 1
        for k, (who, p) in enumerate(taken):
            ids[last[who] - k] = p
        return ids, lengths


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _hash(h: int, symbol: int) -> int:
    """What _mix makes of one number, for the hash of a prefix and the next symbol."""
    all_bits = (1 << 64) - 1
    x = (h + symbol) * int(_GOLD) & all_bits
    x = (x ^ (x >> 30)) * int(_MIX1) & all_bits
    x = (x ^ (x >> 27)) * int(_MIX2) & all_bits
    return x ^ (x >> 31)


def _append(a: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    if n + len(more) > len(a):
        a = np.concatenate((a[:n], np.empty(max(len(more), n // 4), a.dtype)))
    a[n : n + len(more)] = more.astype(a.dtype)
    return a


def encode_texts(lattices: Lattices, texts: list[str], row_keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and how many each text has."""
    out, lengths = [], np.zeros(len(texts), np.int64)
    words: list[str] = []
    owners: list[tuple[int, int, int]] = []  # text, its words here, position of the first of them

    def flush() -> None:
        if words:
            n = [o[1] for o in owners]
            keys = np.repeat(np.array([row_keys[o[0]] for o in owners], np.uint64), n)
            starts = np.repeat(np.array([o[2] for o in owners], np.int64), n)
            within = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
            ids, own = lattices.sample(words, keys, starts + within)
            out.append(ids)
            np.add.at(lengths, np.repeat([o[0] for o in owners], n), own)
        words.clear()
        owners.clear()

    for i, text in enumerate(texts):
        of = lattices.words(text)
        for a in range(0, len(of), WORDS_AT_ONCE):
            part = of[a : a + WORDS_AT_ONCE]
            words.extend(part)
            owners.append((i, len(part), a))
            if len(words) >= WORDS_AT_ONCE:
                flush()
    flush()
    return np.concatenate(out) if out else np.empty(0, np.int32), lengths


@lru_cache(maxsize=1)
def _lattices(path: str | None, alpha: float) -> Lattices:
    """A worker's own, kept from task to task: what is cached doesn't change what is sampled."""
    return Lattices(path, alpha)


@lru_cache(maxsize=1)
def _surfaces(path: str | None) -> list[bytes]:
    return Lattices(path).surface


def row_key(value: object, seed: int) -> int:
    return xxhash.xxh64_intdigest(repr(value).encode(), seed)


def _encoded(batches: Iterator[pa.RecordBatch], path: str | None, alpha: float, seed: int) -> Iterator[pa.RecordBatch]:
    lattices = _lattices(path, alpha)
    for whole in batches:
        for a in range(0, whole.num_rows, DOCUMENTS_AT_ONCE):
            b = whole.slice(a, DOCUMENTS_AT_ONCE)
            ids, n = encode_texts(lattices, b.column(1).to_pylist(), [row_key(k, seed) for k in b.column(0).to_pylist()])
            offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids))], ["id", "ids"])


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """One row per row of ``df``: id, ids (array of int), a sampled segmentation that the seed and the id decide.

    A null or empty text has no ids. Characters the vocabulary lacks, and the vocabulary's own space mark, become byte
    pieces, so every text decodes to itself. Rows that repeat an id and a text get the same ids. Other columns are
    ignored; an empty table gives an empty result. Rows never leave their partition.
    """
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    out = rows.mapInArrow(lambda bs: _encoded(bs, model, alpha, seed), f"id {df.schema[id_col].dataType.simpleString()}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def _decoded(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    surface = _surfaces(path).__getitem__
    for whole in batches:
        for a in range(0, whole.num_rows, DOCUMENTS_AT_ONCE):
            b = whole.slice(a, DOCUMENTS_AT_ONCE)
            flat, at = b.column(1).flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(b.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            parts = [flat[i:j] for i, j in zip(at, at[1:])]
            texts = [b"".join(map(surface, p.tolist())).decode() for p in parts]
            crc = [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, parts), pa.int64()), pa.array(crc, pa.int64()), pa.array(texts, pa.string())], ["id", "n_ids", "ids_crc32", "text"])


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """One row per row of ``df``: id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), text. Null ids are none."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    out = rows.mapInArrow(lambda bs: _decoded(bs, model), f"id {df.schema[id_col].dataType.simpleString()}, n_ids long, ids_crc32 long, text string")
    return out.withColumnRenamed("id", id_col)


def op3_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document and decodes it again."""
    done = decode(encode(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n_ids", "ids_crc32", F.length("text").cast("long").alias("n_chars"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
