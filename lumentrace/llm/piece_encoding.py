"""Offset-preserving encoding with a SentencePiece BPE model, and decoding.

A text is normalised by the model's compiled character map: at each place the longest key of the map's trie that fits is
replaced, and every character of the result keeps the byte of the text that it came from. The normalised text is cut into
symbols, whose best-scored neighbours merge until none are in the vocabulary; what has no piece goes as
bytes. Each piece is then projected through the alignment to the bytes of the original text.

No piece of the usual vocabularies goes on past a word's end, so words are merged by themselves, once, and remembered. Where a
model has such pieces, symbols of its own making or no byte pieces, the text is merged as a whole.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, field, named, tidy, whole, worker_cache

#: Fixed values of the model format: the sign that stands for a space, the kinds of pieces, the kind of model.
SPACE = "▁"
UNKNOWN, USER_DEFINED, UNUSED, BYTE, NORMAL = 2, 4, 5, 6, 1
BPE = 2
#: Words longer than this aren't remembered; bytes of words and ids that a worker remembers.
LONG_WORD, CACHE_BYTES = 64, 64 << 20
#: Words merged together, and characters of the texts whose words are learned together, about.
ALIKE, TOGETHER = 4_096, 1 << 20
#: The place of a pair that doesn't merge.
NEVER = np.int32((1 << 31) - 1)


def _fields(blob: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of a protocol buffer message: integers as they are, all else as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        got = shift = 0
        while True:
            b = blob[at]
            at += 1
            got |= (b & 127) << shift
            shift += 7
            if b < 128:
                return got

    while at < len(blob):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, blob[at : at + size]
            at += size


class CharacterMap:
    """The compiled map of a model: a double array of keys, in UTF-8, over strings that end in NUL."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :]
        self.firsts = frozenset(b for b in range(256) if self.units and self._step(0, b) is not None)

    def _step(self, at: int, byte: int) -> int | None:
        unit = self.units[at]
        to = at ^ (unit >> 10) << ((unit & 512) >> 6) ^ byte
        return to if to < len(self.units) and self.units[to] & 0x800000FF == byte else None

    def longest(self, text: bytes, start: int) -> tuple[int, str] | None:
        """(bytes, replacement) of the longest key that ``text`` has at ``start``, if any."""
        at, found = 0, None
        for n, byte in enumerate(memoryview(text)[start:] if self.units else b"", 1):
            nxt = self._step(at, byte)
            if nxt is None:
                break
            at, unit = nxt, self.units[nxt]
            if unit >> 8 & 1:
                value = self.units[at ^ (unit >> 10) << ((unit & 512) >> 6)] & 0x7FFFFFFF
                found = n, self.strings[value : self.strings.index(b"\0", value)].decode("utf-8", "replace")
        return found


class Model:
    """Pieces, scores and normalisation of a model file's bytes."""

    def __init__(self, blob: bytes):
        pieces: list[tuple[str, float, int]] = []
        # fixed values: the fields' numbers and what holds where they are missing
        trainer, norm = {3: 1, 35: 0, 24: 0}, {2: b"", 3: 1, 4: 1, 5: 1}
        for no, value in _fields(blob):
            if no == 1:
                own = dict(_fields(value))
                pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif no in (2, 3):
                (trainer if no == 2 else norm).update({k: v for k, v in _fields(value) if k in (trainer if no == 2 else norm)})
        if trainer[3] != BPE:
            raise ValueError("only BPE models are encoded")
        self.map = CharacterMap(norm[2])
        self.prefix, self.squeeze, self.escape, self.suffix = bool(norm[3]), bool(norm[4]), bool(norm[5]), bool(trainer[24])
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
        self.reserved = {p: i for i, (p, _, kind) in enumerate(pieces) if kind not in (NORMAL, USER_DEFINED, UNUSED)}
        self.scores = [s for _, s, _ in pieces]
        self.costs = {p: -self.scores[i] for p, i in self.ids.items()}
        self.place = self.ids | self.reserved
        self.unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN)
        self.unused = frozenset(i for i, (_, _, kind) in enumerate(pieces) if kind == UNUSED)
        own = sorted((p for p, _, kind in pieces if kind == USER_DEFINED), key=len, reverse=True)
        self.symbols = re.compile("|".join(map(re.escape, own))) if own else None
        self.bytes = [self.reserved.get(f"<0x{b:02X}>", self.unknown) for b in range(256)] if trainer[35] else None
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.by_word = not (own or inner or self.bytes is None or self.suffix) and self.escape
        self.decoded = None
        if self.prefix and self.escape and not (self.squeeze or self.suffix):
            self.decoded = np.array([bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode() if kind in (NORMAL, USER_DEFINED, UNUSED) else None for p, _, kind in pieces], object)
        self.words = _Words(self)
        if self.by_word and not self.unused:
            self._tables()

    # --- normalisation

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters and its end the byte of ``text`` where it comes from."""
        if not text:
            return "", np.zeros(1, np.int32)
        space = SPACE if self.escape else " "
        if not self.map.units and not self.squeeze and self.symbols is None:
            got, at = text.replace(" ", space), _starts(text)
        else:
            got, at = self._mapped(text, space)
            if not got and self.squeeze:
                return "", np.array(at[-1:], np.int32)
        if self.prefix:
            got = got + space if self.suffix else space + got
            at = np.concatenate([at, at[-1:]] if self.suffix else [at[:1], at])
        return got, at

    def _mapped(self, text: str, space: str) -> tuple[str, np.ndarray]:
        raw = text.encode("utf-8", "surrogatepass")
        parts: list[str] = []
        at: list[int] = []
        here, spaced = 0, self.squeeze
        while here < len(raw):
            own = self.symbols.match(raw[here : here + 1024].decode("utf-8", "ignore")) if self.symbols else None
            found = None if own or raw[here] not in self.map.firsts else self.map.longest(raw, here)
            if own:
                put, size = own[0], len(own[0].encode())
            elif found:
                size, put = found
            else:
                b = raw[here]
                size = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                put = raw[here : here + size].decode("utf-8", "replace")
            if spaced:
                put = put.lstrip(" ")
            if put:
                parts.append(put)
                at += [here] * len(put)
                spaced = self.squeeze and put.endswith(" ")
            here += size
        got = "".join(parts).replace(" ", space)
        if self.squeeze:
            kept = got.rstrip(space)
            here = at[len(kept)] if len(kept) < len(got) else here
            got, at = kept, at[: len(kept)]
        return got, np.array([*at, here], np.int32)

    # --- merging

    def merged(self, word: str) -> tuple[list[int], list[int]]:
        """(ids, characters of each): of a symbol that goes as bytes the last one has its characters."""
        return self._told(*self._long(word))

    def _tables(self) -> None:
        """Pieces of one character, and what each pair of pieces merges to with its place in the order of scores."""
        one = sorted((ord(p), i) for p, i in self.ids.items() if len(p) == 1)
        self.chars, self.char_ids = np.array([c for c, _ in one], np.int64), np.array([i for _, i in one], np.int32)
        pairs = sorted((self.ids[p[:k]] * len(self.scores) + self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.pair_keys, self.pair_to = np.array([k for k, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int32)
        place = np.unique(-np.array(self.scores), return_inverse=True)[1].astype(np.int32)
        self.pair_rank = place[self.pair_to]

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, piece) of neighbours; NEVER where they don't merge."""
        key = a.astype(np.int64) * len(self.scores) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_rank[at], NEVER), self.pair_to[at]

    def merged_alike(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each of ``words``, all of one length, with its ids and sizes: all words make their best merge at once, then their next."""
        width = len(words[0])
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, width)
        at = np.minimum(np.searchsorted(self.chars, code), len(self.chars) - 1)
        ids = np.where(self.chars[at] == code, self.char_ids[at], -1).astype(np.int32)
        sizes, left = np.ones_like(ids), np.arange(len(words))
        rank, to = self._pairs(ids[:, :-1], ids[:, 1:])
        while len(left):
            if width > 1:
                best = rank.argmin(1)
                go = rank[np.arange(len(left)), best] < NEVER
            else:
                go = np.zeros(len(left), bool)
            if not go.all():
                both, odd = np.stack([ids[~go], sizes[~go]], 2), (ids[~go] < 0).any(1)
                for i, pairs, unknown in zip(left[~go].tolist(), both, odd.tolist()):
                    yield words[i], self._with_bytes(words[i], pairs.tolist()) if unknown else pairs.tobytes()
                if not go.any():
                    return
                ids, sizes, rank, to, best, left = ids[go], sizes[go], rank[go], to[go], best[go], left[go]
            row, col = np.arange(len(left)), np.arange(width - 1)
            ids[row, best] = to[row, best]
            sizes[row, best] += sizes[row, best + 1]
            kept = col + (col > best[:, None])
            ids, sizes = np.take_along_axis(ids, kept, 1), np.take_along_axis(sizes, kept, 1)
            kept = col[:-1] + (col[:-1] >= best[:, None])
            rank, to = np.take_along_axis(rank, kept, 1), np.take_along_axis(to, kept, 1)
            width -= 1
            for place in (best - 1, best):
                r = np.nonzero((place >= 0) & (place < width - 1))[0]
                c = place[r]
                rank[r, c], to[r, c] = self._pairs(ids[r, c], ids[r, c + 1])

    def _with_bytes(self, word: str, pairs: list[list[int]]) -> bytes:
        """Ids and sizes of a word of which some characters, told as -1, go as bytes."""
        out: list[int] = []
        at = 0
        for i, size in pairs:
            if i >= 0:
                out += i, size
            else:
                for b in word[at].encode("utf-8", "surrogatepass"):
                    out += self.bytes[b], 0
                out[-1] = 1
            at += size
        return struct.pack(f"<{len(out)}i", *out)

    def _packed(self, word: str) -> bytes:
        ids, sizes = self.merged(word)
        return struct.pack(f"<{2 * len(ids)}i", *[x for pair in zip(ids, sizes) for x in pair])

    def _long(self, word: str) -> tuple[list[str], dict[str, tuple[str, str]]]:
        """Merges by a heap of pairs; also the halves of pieces that are only used on the way."""
        parts, frozen = self._symbols(word)
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap: list[tuple[float, int, int, str]] = []
        halves: dict[str, tuple[str, str]] = {}

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and not frozen[a] and not frozen[b]:
                both = parts[a] + parts[b]
                i = self.ids.get(both)
                if i is not None:
                    heapq.heappush(heap, (-self.scores[i], a, b, both))
                    if i in self.unused:
                        halves[both] = parts[a], parts[b]

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if right[a] != b or parts[a] + parts[b] != both or not parts[a]:
                continue  # one of the two has merged otherwise
            parts[a], parts[b], right[a] = both, "", right[b]
            if right[b] >= 0:
                left[right[b]] = a
            right[b] = -1
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in parts if p], halves

    def _told(self, parts: list[str], halves: dict[str, tuple[str, str]]) -> tuple[list[int], list[int]]:
        ids: list[int] = []
        sizes: list[int] = []
        todo = parts[::-1]
        while todo:
            part = todo.pop()
            i = self.place.get(part, self.unknown)
            if i in self.unused and part in halves:
                todo += reversed(halves[part])
            elif i != self.unknown:
                ids.append(i)
                sizes.append(len(part))
            elif self.bytes is not None:
                raw = part.encode("utf-8", "surrogatepass")
                ids += [self.bytes[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [len(part)]
            elif ids and ids[-1] == self.unknown:
                sizes[-1] += len(part)
            else:
                ids.append(i)
                sizes.append(len(part))
        return ids, sizes

    def _symbols(self, word: str) -> tuple[list[str], list[bool]]:
        if self.symbols is None:
            return list(word), [False] * len(word)
        parts: list[str] = []
        frozen: list[bool] = []
        at = 0
        for m in self.symbols.finditer(word):
            parts += [*word[at : m.start()], m[0]]
            frozen += [False] * (m.start() - at) + [True]
            at = m.end()
        return parts + list(word[at:]), frozen + [False] * (len(word) - at)

    WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def decode(self, ids: list[int] | np.ndarray) -> str | None:
        """The text of ids, if they are plain pieces and bytes that make up characters, of a model that puts a space before each text; else None."""
        if not len(ids):
            return ""
        if self.decoded is None:
            return None
        parts = self.decoded[ids].tolist()
        try:
            got = b"".join(parts).decode()
        except (UnicodeDecodeError, TypeError):
            return None
        return got[1:] if parts[0].startswith(b" ") else got

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, ends): each piece with the span of bytes of ``text`` that it stands for."""
        return next(self.encoded([text]))

    def encoded(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``encode`` of each text; words that none had before are merged together first."""
        norms = [self.normalised(t) for t in texts]
        words = [self.WORDS.findall(n) for n, _ in norms] if self.by_word else None
        if words:
            self.words.learn({w for ws in words for w in ws})
        for k, (norm, at) in enumerate(norms):
            if words:
                both = np.frombuffer(b"".join(map(self.words.__getitem__, words[k])), np.int32).reshape(-1, 2)
                ids, sizes = both[:, 0], both[:, 1]
            else:
                ids, sizes = (np.array(x, np.int32) for x in self.merged(norm))
            tops = np.cumsum(sizes)
            yield ids, at[tops - sizes], at[tops]  # what has no characters of its own ends where it begins


def _starts(text: str) -> np.ndarray:
    """The byte where each character begins, and the end."""
    if text.isascii():
        return np.arange(len(text) + 1, dtype=np.int32)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int32)


class _Words(dict):
    """A word's ids and sizes as pairs of 32-bit integers; once full, words that aren't met again go."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.before, self.size = model, {}, 0

    def learn(self, words: set[str]) -> None:
        """Remembers the pieces of ``words`` of LONG_WORD characters at most, merging those of a length together."""
        if self.model.unused:
            return
        by_length: dict[int, list[str]] = {}
        for w in words:
            if w not in self:
                if w in self.before:
                    self._keep(w, self.before.pop(w))
                elif len(w) <= LONG_WORD:
                    by_length.setdefault(len(w), []).append(w)
        for alike in by_length.values():
            for at in range(0, len(alike), ALIKE):
                for w, got in self.model.merged_alike(alike[at : at + ALIKE]):
                    self._keep(w, got)
        if self.size > CACHE_BYTES // 2:
            self.before = {w: got for w, got in self.items() if w not in words}
            for w in self.before:
                del self[w]
            self.size = 0

    def _keep(self, word: str, got: bytes) -> None:
        self.size += 2 * len(word) + len(got) + 230
        self[word] = got

    def __missing__(self, word: str) -> bytes:
        return self.model._packed(word)


def _model(blob: bytes) -> Model:
    return worker_cache(f"pieces-{zlib.crc32(blob)}", lambda: Model(blob))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, begins, ends): every text's piece ids with the spans of bytes of the text that they stand for.

    One row per row of ``docs``, in one pass without a shuffle; other columns don't come along. A null or empty text has no pieces, repeated rows and ids are
    encoded each, an empty table gives an empty result. A text may be of any length: it is merged in memory of about a
    hundred bytes a character of its longest word. ``model_path`` is read on the driver and travels with the tasks.
    """
    blob = Path(model_path).read_bytes()
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(blob)
        for b in batches:
            begun, texts, n = 0, [], 0
            for i, text in enumerate(b.column(1)):
                texts.append(text.as_py() or "")
                n += len(texts[-1])
                if n >= TOGETHER or i == b.num_rows - 1:
                    held = list(model.encoded(texts))
                    ends = pa.array(np.cumsum([0] + [len(h[0]) for h in held]), pa.int32())
                    lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([h[c] for h in held]).astype(np.int32))) for c in range(3)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(begun, len(held)), *lists], names=["id", "ids", "begins", "ends"])
                    begun, texts, n = i + 1, [], 0

    _small_batches(docs)
    return rows.mapInArrow(tidy(run, caches=True), f"id {kind}, ids array<int>, begins array<int>, ends array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of the ids, that of the library's decode(); null ids decode to an empty text.

    Pieces and bytes are put together here; unknown and control ids, bytes that make up no characters and models of other rules of spaces go to the library itself.
    """
    blob = Path(model_path).read_bytes()
    own = [c for c in encoded.columns if c != out]
    rows = encoded.select(whole(encoded, own), named(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model, processor = worker_cache(f"decoder-{zlib.crc32(blob)}", lambda: (Model(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)))
        for b in batches:
            texts = []
            for ids in b.column(1):
                own = model.decode(ids.values.to_numpy(zero_copy_only=False)) if ids.is_valid else ""
                texts.append(processor.decode(ids.values.to_pylist()) if own is None else own)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", out])

    schema = rows.select("row").schema.add(out, "string")
    return rows.mapInArrow(tidy(run, caches=True), schema).select(*[field(encoded, c, own) for c in own], named(out))



def _small_batches(df: DataFrame) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
