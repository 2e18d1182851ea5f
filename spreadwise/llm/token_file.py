"""Operator 8: token ids in a compact binary file.

Coder. Ids are cut into blocks of ``BLOCK`` that are coded and checksummed independently, from a
fresh state. In a block the next id is predicted by order: the id that last followed the same two
ids, the id that last followed the same one id, and a cache of the block's ids (order 0). A
carry-less range coder codes which of the four holds (order 2, order 1, cached, new). For the last
two, the cache slot (a byte) or the id itself follows; these are as good as uniform, for which coding
gains nothing, so they stand beside the coded kinds as plain numbers. The probabilities of the four come from adaptive counts
of three sources that are mixed by adding them: counts under the confidence of the order-2 guess,
under that of the order-1 guess, and over the whole block. Encoder and decoder run the same steps
for all blocks of a chunk side by side in NumPy vectors.

File. A table of chunks in order; each holds whole documents (their ids and token counts), and for
each block its number of ids, its checksum and its bytes. Spark writes it as Parquet files, so
a lost task is written again as a whole.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import field, staged
from .language_id import Table
from .text import WHITE, U, Words, slices, utf8

BLOCK = 2048
CHUNK_IDS = 1 << 23
ORDER1, ORDER2, CACHE = 1024, 2048, 256           # slots of a block's tables
NOTHING = 0xFFFF
TOP, BOTTOM = U(1 << 56), U(1 << 48)          # two kinds narrow the range by less than 2^32
TABLE_ENTRIES = 2_000_000
_STEP = U(16)
_ADD = np.array([16, 16 << 16, 16 << 32, 16 << 48], dtype=U)
_ONES, _HIGH, _HALF = U(0x0001000100010001), U(0xF800F800F800F800), U(0x7FFF7FFF7FFF7FFF)
_FIELD, _TOTAL = U(0xFFFF), U(48)
_SURER = np.array([1, 2, 3, 3], dtype=np.uint32)
_BYTE, _TOP_BYTE = U(8), U(56)
_SHIFT = np.array([0, 16, 32, 48], dtype=U)            # place of a kind in the packed counts
# by hits of order 2 (4), order 1 (2) and the cache (1)
_FIRST_HIT = np.array([3, 2, 1, 1, 0, 0, 0, 0], dtype=np.uint8)


class State:
    """Adaptive state of a number of blocks side by side."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        self.first = np.full(lanes * ORDER1, NOTHING << 2, dtype=np.uint32)      # guess and its confidence
        self.second = np.full(lanes * ORDER2, NOTHING << 2, dtype=np.uint32)
        self.cache = np.full(lanes * CACHE, NOTHING, dtype=np.uint32)
        # four 16-bit counts in one word: order 2, order 1, cached, new
        self.by_second = np.full(lanes * 4, 0x0008000400040002, dtype=U)
        self.by_first = np.full(lanes * 4, 0x0008000400020004, dtype=U)
        self.overall = np.full(lanes, 0x0008000400020002, dtype=U)
        self.a = np.zeros(lanes, dtype=np.int64)                                 # the last id and the one before
        self.b = np.zeros(lanes, dtype=np.int64)
        self.low, self.range = np.zeros(lanes, dtype=U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=U)
        self.base1, self.base2, self.base0, self.rows = (self.lane * k for k in (ORDER1, ORDER2, CACHE, 4))

    def predict(self, n: int, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Mixed counts of the four kinds for the first ``n`` blocks, packed, and their running sums."""
        if t % 64 == 0:
            for counts in (self.by_second, self.by_first, self.overall):
                big = np.flatnonzero(counts & _HIGH)
                counts[big] = ((counts[big] >> U(1)) & _HALF) | _ONES
        h = self.a[:n] * 40503
        self.at1 = self.base1[:n] + (h >> 4 & ORDER1 - 1)
        self.at2 = self.base2[:n] + ((h ^ self.b[:n] * 60493) >> 3 & ORDER2 - 1)
        self.one, self.two = self.first.take(self.at1, mode="clip"), self.second.take(self.at2, mode="clip")
        self.sure1, self.sure2 = self.one & np.uint32(3), self.two & np.uint32(3)
        self.row1, self.row2 = self.rows[:n] + self.sure1, self.rows[:n] + self.sure2
        self.count1, self.count2 = self.by_first.take(self.row1, mode="clip"), self.by_second.take(self.row2, mode="clip")
        counts = self.count1 + self.count2 + self.overall[:n]
        return counts, counts * _ONES                       # the product adds up the 16-bit fields

    def narrow(self, n: int, counts: np.ndarray, sums: np.ndarray, r: np.ndarray, shift: np.ndarray) -> None:
        """Narrow the range to the kind that stands ``shift`` bits high in the packed counts."""
        self.low[:n] += r * ((sums << _STEP) >> shift & _FIELD)
        self.range[:n] = r * (counts >> shift & _FIELD)

    def learn(self, n: int, ids: np.ndarray, wide: np.ndarray, kind: np.ndarray, slot: np.ndarray) -> None:
        add = _ADD.take(kind)
        self.by_second[self.row2] = self.count2 + add
        self.by_first[self.row1] = self.count1 + add
        self.overall[:n] += add
        held = wide << np.uint32(2)
        self.second[self.at2] = held | _SURER.take(self.sure2) * (self.two >> np.uint32(2) == wide)
        self.first[self.at1] = held | _SURER.take(self.sure1) * (self.one >> np.uint32(2) == wide)
        self.cache[slot] = wide
        self.b[:n] = self.a[:n]
        self.a[:n] = ids

    def slots(self, n: int, ids: np.ndarray) -> np.ndarray:
        return self.base0[:n] + (ids * 40503 >> 5 & CACHE - 1)

    def unsettled(self, among: np.ndarray | None, n: int) -> np.ndarray:
        """Blocks whose range must be widened; a range that straddles a border is cut at it."""
        low, width = (self.low[:n], self.range[:n]) if among is None else (self.low[among], self.range[among])
        same = (low ^ (low + width)) < TOP
        at = np.flatnonzero(same | (width < BOTTOM))
        straddle = ~same[at]
        at = at if among is None else among[at]
        short = at[straddle]
        if len(short):
            self.range[short] = (U(0) - self.low[short]) & (BOTTOM - U(1))
        return at


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Each block of an id array: the numbers of plain ids and of slots, the plain ids, the slots, and
    the coded kinds."""
    if not len(ids):
        return []
    lanes = -(-len(ids) // BLOCK)
    grid = np.zeros(lanes * BLOCK, dtype=np.uint16)
    grid[:len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, BLOCK).T)
    last = len(ids) - (lanes - 1) * BLOCK
    steps = BLOCK if lanes > 1 else last
    s = State(lanes)
    kinds, plain = np.zeros((BLOCK, lanes), dtype=np.uint8), np.zeros((BLOCK, lanes), dtype=np.uint8)
    out = np.zeros((lanes, 2 * BLOCK + 64), dtype=np.uint8)
    at = np.zeros(lanes, dtype=np.int64)
    for t in range(steps):
        n = lanes if t < last else lanes - 1
        x = grid[t, :n].astype(np.int64)
        wide = x.astype(np.uint32)
        counts, sums = s.predict(n, t)
        slot = s.slots(n, x)
        hits = ((s.two >> np.uint32(2)) == wide).view(np.uint8) * np.uint8(4)
        hits += ((s.one >> np.uint32(2)) == wide).view(np.uint8) * np.uint8(2)
        hits += (s.cache.take(slot, mode="clip") == wide).view(np.uint8)
        kind = _FIRST_HIT.take(hits)
        s.narrow(n, counts, sums, s.range[:n] // (sums >> _TOTAL), _SHIFT.take(kind))
        s.learn(n, x, wide, kind, slot)
        kinds[t, :n], plain[t, :n] = kind, slot - s.base0[:n]
        if t & 1 or t >= steps - 2 or t >= last - 2:
            need = s.unsettled(None, n)
            while len(need):
                low = s.low[need]
                out[need, at[need]] = low >> _TOP_BYTE
                at[need] += 1
                s.low[need] = low << _BYTE
                s.range[need] <<= _BYTE
                need = s.unsettled(need, n)
    for shift in range(56, -8, -8):
        out[np.arange(lanes), at] = s.low >> U(shift) & U(0xFF)
        at += 1
    if last < BLOCK:
        kinds[last:, -1] = 0
    kinds, plain, grid = kinds.T, plain.T, grid.T
    new, cached = kinds == 3, kinds == 2
    new_ids, slots = grid[new].astype("<u2"), plain[cached]                 # in block order
    n_new, n_cached = new.sum(axis=1), cached.sum(axis=1)
    new_at, slot_at = np.concatenate([[0], np.cumsum(n_new)]), np.concatenate([[0], np.cumsum(n_cached)])
    head = np.stack([n_new, n_cached], axis=1).astype("<u2")
    return [b"".join((head[i].tobytes(), new_ids[new_at[i]:new_at[i + 1]].tobytes(), slots[slot_at[i]:slot_at[i + 1]].tobytes(), out[i, :at[i]].tobytes()))
            for i in range(lanes)]


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Parts behind each other, each followed by a zero, and where each begins."""
    begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in parts])])
    out = np.zeros(begin[-1], dtype=parts[0].dtype)
    for x, lo in zip(parts, begin.tolist(), strict=False):
        out[lo:lo + len(x)] = x
    return out, begin[:-1]


def decode_blocks(blocks: list[bytes], sizes: list[int]) -> np.ndarray:
    """Ids of a chunk's blocks, all of which but the last hold ``BLOCK`` ids."""
    lanes = len(blocks)
    if not lanes:
        return np.zeros(0, np.uint16)
    new, slots, coded = [], [], []
    for b in blocks:
        n_new, n_cached = np.frombuffer(b, "<u2", 2).tolist()
        new.append(np.frombuffer(b, "<u2", n_new, 4)), slots.append(np.frombuffer(b, np.uint8, n_cached, 4 + 2 * n_new))
        coded.append(np.frombuffer(b, np.uint8, offset=4 + 2 * n_new + n_cached))
    new, new_at = _padded(new)
    slots, slot_at = _padded(slots)
    flat, at = _padded(coded)
    new, slots, flat = new.astype(np.uint32), slots.astype(np.int64), flat.astype(U)
    s = State(lanes)
    code = np.zeros(lanes, dtype=U)
    for _ in range(8):
        code = code << _BYTE | flat[at]
        at += 1
    out = np.zeros((BLOCK, lanes), dtype=np.uint16)
    last = sizes[-1]
    steps = BLOCK if lanes > 1 else last
    for t in range(steps):
        n = lanes if t < last else lanes - 1
        counts, sums = s.predict(n, t)
        r = s.range[:n] // (sums >> _TOTAL)
        target = (code[:n] - s.low[:n]) // r
        kind = (target >= (sums & _FIELD)).view(np.uint8) + (target >= (sums >> _STEP & _FIELD)).view(np.uint8)
        kind += (target >= (sums >> U(32) & _FIELD)).view(np.uint8)
        s.narrow(n, counts, sums, r, _SHIFT.take(kind))
        cached = s.cache.take(s.base0[:n] + slots.take(slot_at[:n], mode="clip"), mode="clip")
        wide = np.where(kind < 2, np.where(kind == 0, s.two, s.one) >> np.uint32(2), np.where(kind == 2, cached, new.take(new_at[:n], mode="clip")))
        new_at[:n] += kind == 3
        slot_at[:n] += kind == 2
        x = wide.astype(np.int64)
        s.learn(n, x, wide, kind, s.slots(n, x))
        out[t, :n] = wide
        if t & 1 or t >= steps - 2 or t >= last - 2:
            need = s.unsettled(None, n)
            while len(need):
                s.low[need] <<= _BYTE
                s.range[need] <<= _BYTE
                place = at[need]
                code[need] = code[need] << _BYTE | flat.take(place, mode="clip")
                at[need] = place + 1
                need = s.unsettled(need, n)
    return out.T.ravel()[:(lanes - 1) * BLOCK + last]


# The only normaliser, pre-tokenizer and model under which words and pieces are independent as used here
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_END = "</w>"

#: printable ASCII without the apostrophe, and letters of one precomposed code point below U+0100: normalised by lower-casing
_PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(r"\n|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+")


def _byte_sign(b: int) -> str:
    """How the model's vocabulary writes a byte: printable Latin-1 as itself, the 68 others from U+0100 on."""
    other = [*range(33), *range(127, 161), 173]
    return chr(256 + other.index(b)) if b in other else chr(b)


_SIGNS = {c: "".join(map(_byte_sign, chr(c).encode())) for c in range(0xC0, 0x100)}
GROUP = 512


def check_tokenizer(library) -> None:
    """Raise unless the tokenizer is known to encode words, and the pieces of plain words, independently."""
    spec = json.loads(library.to_str())
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = spec["model"]
    ok = ((spec.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and len(steps) == 2 and steps[0] == _SPLIT
          and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
          and model.get("type") == "BPE" and model.get("end_of_word_suffix") == _END and not model.get("continuing_subword_prefix")
          and not model.get("dropout") and not model.get("ignore_merges")
          and all(t["special"] and t["content"].startswith("<|") and not re.search(r"\s", t["content"]) for t in spec.get("added_tokens", [])))
    if not ok:
        raise ValueError("the words of this tokenizer are not known to be independent")


class Tokenizer:
    """Ids of whole texts through a table of distinct words, looked up by hash for many at once.

    The tokenizer splits at white space before anything else that looks at more than a character (see
    ``check_tokenizer``), so words are encoded independently. A word that the table lacks is put together from its
    pieces if it is a plain one; pieces are encoded by the library once, many together, and cut apart again at the
    tokens that end a piece. Any other word is encoded by itself.
    """

    def __init__(self, file: str, end_id: int):
        from tokenizers import Tokenizer as Library
        from tokenizers.pre_tokenizers import WhitespaceSplit
        self.library, self.end = Library.from_file(file), end_id
        check_tokenizer(self.library)
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        if max(self.vocabulary, end_id + 1) > NOTHING:
            raise ValueError("ids must be below 65535")
        self.pieces = Library.from_file(file)
        self.pieces.normalizer, self.pieces.pre_tokenizer = None, WhitespaceSplit()
        self.ends = np.zeros(self.vocabulary, dtype=bool)
        self.ends[[i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t.endswith(_END)]] = True
        self.clear()

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each has."""
        is_plain = np.fromiter((_PLAIN.fullmatch(w) is not None and "<|" not in w for w in words), bool, len(words))
        plain, other = np.flatnonzero(is_plain), np.flatnonzero(~is_plain)
        found = [np.array(x.ids, np.uint16) for x in self._batch(self.library, [words[i] for i in other.tolist()])]
        size = np.zeros(len(words), np.int64)
        size[other] = list(map(len, found))
        flat_other = np.concatenate([np.zeros(0, np.uint16), *found])
        # the words stand in lines, so that one search cuts all of them
        number = self._numbers(_PIECES.findall("".join([words[i].lower() + "\n" for i in plain.tolist()])))
        line = np.flatnonzero(number < 0)
        piece = number[number >= 0]
        n = self.piece_size[piece]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.piece_pool[np.repeat(self.piece_start[piece] - upto[:-1], n) + np.arange(upto[-1])]
        size[plain] = np.diff(upto[np.concatenate([[0], line - np.arange(len(line))])])
        # ids in the order of the words
        begin = np.cumsum(size) - size
        flat = np.zeros(int(size.sum()), np.uint16)
        for at, n, own in ((begin[plain], size[plain], ids), (begin[other], size[other], flat_other)):
            flat[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = own
        return flat, size

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """Number of each piece in the table of pieces, which takes up those it lacks; -1 for the end of a line."""
        known = self.piece_number
        lack = [p for p in dict.fromkeys(pieces) if p not in known]
        if lack:
            signs = [p if p.isascii() else p.translate(_SIGNS) for p in lack]
            ids = np.concatenate([np.array(x.ids, np.uint16) for x in self._batch(self.pieces, [" ".join(signs[lo:lo + GROUP]) for lo in range(0, len(signs), GROUP)])])
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(lack):
                raise AssertionError("a piece without an end token")
            begin = np.concatenate([[0], last[:-1] + 1])
            known |= zip(lack, range(len(self.piece_size), len(self.piece_size) + len(lack)), strict=True)
            self.piece_start = np.concatenate([self.piece_start, len(self.piece_pool) + begin])
            self.piece_size = np.concatenate([self.piece_size, last + 1 - begin])
            self.piece_pool = np.concatenate([self.piece_pool, ids])
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    @staticmethod
    def _batch(library, texts: list[str]) -> list:
        return getattr(library, "encode_batch_fast", library.encode_batch)(texts, add_special_tokens=False) if texts else []

    def clear(self) -> None:
        self.piece_number = {"\n": -1}
        self.piece_start, self.piece_size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.piece_pool = np.zeros(0, np.uint16)
        self.table, self.keys = Table(np.zeros(0, U)), np.zeros(0, U)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint16)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, the end id after each text, and the number of ids of each text."""
        data, offsets = utf8(column)
        words = Words(data, offsets, WHITE)
        hashes = words.hashes()
        row = self.table.find(hashes)
        if (row < 0).any():
            if len(self.keys) > TABLE_ENTRIES:
                self.clear()
                row = np.full(len(hashes), -1)
            lack = np.flatnonzero(row < 0)
            new, at = np.unique(hashes[lack], return_index=True)
            at, raw = lack[at], data.tobytes()
            strings = [raw[s:e].decode() for s, e in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)]
            flat, size = self.encode_words(strings)
            begin = len(self.pool) + np.cumsum(size) - size
            self.keys, self.start = np.concatenate([self.keys, new]), np.concatenate([self.start, begin])
            self.size, self.pool = np.concatenate([self.size, size]), np.concatenate([self.pool, flat])
            self.table = self.table.extended(self.keys, len(new))
            row = self.table.find(hashes)
        size, start = self.size[row], self.start[row]
        # the end id is one more word of each text
        place = words.bounds[1:]
        size, start = np.insert(size, place, 1), np.insert(start, place, -1)
        total = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(start - total[:-1], size) + np.arange(total[-1])
        ids = self.pool[np.maximum(at, 0)] if len(self.pool) else np.zeros(len(at), np.uint16)
        ends = words.bounds[1:] + np.arange(len(offsets) - 1)
        ids[total[ends]] = self.end
        n = np.diff(np.concatenate([[0], total[ends + 1]]))
        return ids, n


_TOKENIZERS: dict[tuple[str, int], Tokenizer] = {}


def tokenizer_of(file: str, end_id: int) -> Tokenizer:
    """The worker's tokenizer, whose table outlives a task."""
    key = (file, end_id)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = Tokenizer(file, end_id)
    return _TOKENIZERS[key]


def _chunk(part: int, before: int, docs: list, sizes: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
    all_ids = np.concatenate(ids)
    blocks = encode_blocks(all_ids)
    lengths = [min(BLOCK, len(all_ids) - lo) for lo in range(0, len(all_ids), BLOCK)]
    sums = [zlib.crc32(all_ids[lo:lo + BLOCK].astype("<u4").tobytes()) for lo in range(0, len(all_ids), BLOCK)]
    column = pa.concat_arrays(docs)
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([len(all_ids)], pa.int64()),
         pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column),
         pa.array([np.concatenate(sizes)], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())),
         pa.array([sums], pa.list_(pa.int64())), pa.array([blocks], pa.list_(pa.binary()))],
        ["part", "before", "n_ids", "docs", "doc_tokens", "block_ids", "block_crc32", "blocks"])


def _write(file: str, end_id: int):
    """Sorted documents of a partition to chunks of the file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = tokenizer_of(file, end_id), TaskContext.get().partitionId()
        before, docs, sizes, ids, held = 0, [], [], [], 0
        for batch in batches:
            for piece in slices(batch, "text"):
                own, n = tokens.encode(piece.column("text"))
                docs.append(piece.column("id")), sizes.append(n), ids.append(own)
                held += len(own)
                if held >= CHUNK_IDS:
                    yield _chunk(part, before, docs, sizes, ids)
                    before, docs, sizes, ids, held = before + held, [], [], [], 0
        if docs:
            yield _chunk(part, before, docs, sizes, ids)
    return run


def decode_chunk(row: dict) -> np.ndarray:
    """Ids of a chunk; raises if a block does not match its checksum."""
    ids = decode_blocks(row["blocks"], row["block_ids"])
    for i, (lo, crc) in enumerate(zip(range(0, len(ids), BLOCK), row["block_crc32"], strict=True)):
        if zlib.crc32(ids[lo:lo + BLOCK].astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i} of the chunk at {row['before']} in part {row['part']} is damaged")
    return ids


def _read(digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = {c: one.column(c)[0].as_py() for c in ("part", "before", "block_ids", "block_crc32", "blocks")}
                ids = decode_chunk(row)
                docs, n = one.column("docs").flatten(), np.asarray(one.column("doc_tokens").flatten())
                cut = np.concatenate([[0], np.cumsum(n)])
                if digests:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    body = pa.array([zlib.crc32(raw[4 * lo:4 * hi]) for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.int64())
                else:
                    body = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([docs, pa.array(np.full(len(n), row["part"], np.int32)), pa.array(row["before"] + cut[:-1]), pa.array(n), body],
                                                 ["id", "part", "at", "n_tokens", "body"])
    return run


def write_token_file(documents: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize every whole text, append ``end_id``, and write all ids in ascending id order.

    Returns the file, read back as a table of chunks. Null ids come first; rows of one id stand in
    the order of a hash of their text, so a repeated id is spread over partitions as well.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("tie"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    chunk = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("docs", T.ArrayType(field(documents, id_col).dataType)), T.StructField("doc_tokens", T.ArrayType(T.LongType())),
        T.StructField("block_ids", T.ArrayType(T.IntegerType())), T.StructField("block_crc32", T.ArrayType(T.LongType())),
        T.StructField("blocks", T.ArrayType(T.BinaryType()))])
    return staged(ordered.mapInArrow(_write(tokenizer_file, end_id), chunk), "tokens")


def read_token_file(chunks: DataFrame, id_col: str = "doc_id", digests: bool = False) -> DataFrame:
    """Decode a token file: the id of each document, ``start`` (ids of all documents before it),
    ``n_tokens``, and ``ids``, or with ``digests`` their ``ids_crc32`` as unsigned 32-bit words.

    Where the parts of the file begin is summed up from one row a part, which the driver holds.
    """
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    begin, starts = 0, []
    for r in parts:
        starts.append((r.part, begin))
        begin += r.n
    schema = T.StructType([
        T.StructField("id", chunks.schema["docs"].dataType.elementType), T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("body", T.LongType() if digests else T.ArrayType(T.IntegerType()))])
    decoded = chunks.select("part", "before", "docs", "doc_tokens", "block_ids", "block_crc32", "blocks").mapInArrow(_read(digests), schema)
    where = chunks.sparkSession.createDataFrame(starts, "part int, begin long")
    # one row for each partition that wrote a part
    return decoded.join(F.broadcast(where), "part").select(
        F.col("id").alias(id_col), (F.col("begin") + F.col("at")).alias("start"), "n_tokens", F.col("body").alias("ids_crc32" if digests else "ids"))


def token_file_round_trip(documents: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                          digests: bool = False) -> DataFrame:
    """Write ``documents`` as a token file and return what ``read_token_file`` reads from it.

    One row for each input row. Null and empty texts are the end id alone; repeated rows are written
    as often as they occur; other columns are not read; an empty table gives an empty file and result.
    """
    chunks = write_token_file(documents, tokenizer_file, end_id, id_col, text_col)
    return read_token_file(chunks, id_col, digests)
