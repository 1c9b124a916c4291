"""SentencePiece encoding that keeps offsets, and decoding.

The model file is read here: pieces with scores, and the normaliser's compiled character map, a
double-array trie of replaced prefixes.  Normalisation takes, at each place, the longest prefix in
the trie, and records for every normalised character the source bytes that it came from.  The
normalised text is cut where no piece can reach across, each part is merged by score, and every
piece is projected to a span of the original UTF-8 bytes.  Parts are remembered per task.

Defined results: a null or empty text has no pieces; a lone dummy prefix has an empty span; spans of
byte pieces of one character all cover that character; repeated rows are encoded alike.  Only
doc_id and text are read.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import map_batches

SPACE = "▁"
#: Kinds of piece in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
#: Parts remembered per task, and the longest part that is remembered.
MEMORY_PARTS = 400_000
MEMORY_LETTERS = 48
#: Bits of a piece code below its id: the characters that the piece closes.
WIDTH_BITS = 24
#: Bits of an id in a merge number, and the number of no merge.
ID_BITS = 20
NO_MERGE = 1 << 62


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a serialized message."""
    at, end = 0, len(data)

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            octet = data[at]
            at += 1
            value |= (octet & 127) << shift
            shift += 7
            if octet < 128:
                return value

    while at < end:
        key = number()
        kind = key & 7
        if kind == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            value = data[at : at + size]
            at += size
        yield key >> 3, value


@dataclass
class Model:
    """What a model file says."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True
    bpe: bool = False
    byte_fallback: bool = False

    @classmethod
    def read(cls, data: bytes) -> Model:
        model = cls()
        for number, value in wire_fields(data):
            if number == 1:
                part = dict(wire_fields(value))
                model.pieces.append(part.get(1, b"").decode())
                model.scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
                model.kinds.append(part.get(3, NORMAL))
            elif number == 2:
                spec = dict(wire_fields(value))
                model.bpe = spec.get(3, 1) == 2
                model.byte_fallback = bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(wire_fields(value))
                model.charsmap = spec.get(2, b"")
                model.dummy_prefix = bool(spec.get(3, 1))
                model.trim_spaces = bool(spec.get(4, 1))
                model.escape_spaces = bool(spec.get(5, 1))
        return model


class CharacterMap:
    """The compiled map: a double-array trie of prefixes and the texts that replace them.

    A unit holds a label (or a value, in a leaf), a flag that a leaf hangs below, and an offset to
    its children's block; the child for an octet is the block's unit at that octet.
    """

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest mapped prefix of ``data[at:]``."""
        units, found = self.units, None
        if not units:
            return None
        offset = lambda unit: (unit >> 10) << ((unit & (1 << 9)) >> 6)
        place = offset(units[0])
        for end in range(at, len(data)):
            place ^= data[end]
            unit = units[place]
            if unit & 0x800000FF != data[end]:
                break
            place ^= offset(unit)
            if unit >> 8 & 1:
                start = units[place] & 0x7FFFFFFF
                found = end + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found


class Normalizer:
    """Normalised text and, for each of its characters, the source bytes [begin, end)."""

    def __init__(self, model: Model):
        self.model = model
        self.map = CharacterMap(model.charsmap)
        # user-defined pieces pass unchanged
        self.kept = sorted(
            (p.encode() for p, k in zip(model.pieces, model.kinds) if k == USER_DEFINED),
            key=len,
            reverse=True,
        )

    @property
    def plain(self) -> bool:
        """True if normalisation only marks spaces, so that offsets follow from lengths."""
        return not self.map.units and not self.model.trim_spaces and not self.kept

    def _steps(self, data: bytes) -> Iterator[tuple[str, int, int]]:
        at = 0
        while at < len(data):
            own = next((p for p in self.kept if data.startswith(p, at)), None)
            hit = None if own else self.map.longest(data, at)
            if own:
                width, text = len(own), own.decode()
            elif hit:
                width, text = hit[0], hit[1].decode()
            else:
                head = data[at]
                width = 1 if head < 0x80 else 2 if head < 0xE0 else 3 if head < 0xF0 else 4
                text = data[at : at + width].decode()
            yield text, at, at + width
            at += width

    def __call__(self, text: str) -> tuple[str, list[int], list[int]]:
        model, data = self.model, text.encode()
        mark = SPACE if model.escape_spaces else " "
        out, begins, ends = [], [], []

        def put(character: str, begin: int, end: int) -> None:
            out.append(mark if character == " " else character)
            begins.append(begin)
            ends.append(end)

        steps = list(self._steps(data))
        if model.trim_spaces:
            while steps and steps[0][0] == " ":
                steps.pop(0)
        if not steps:
            return "", [], []
        if model.dummy_prefix:
            put(" ", steps[0][1], steps[0][1])
        after_space = model.trim_spaces
        for replacement, begin, end in steps:
            if model.trim_spaces and after_space:
                replacement = replacement.lstrip(" ")
            for character in replacement:
                put(character, begin, end)
            if replacement:
                after_space = model.trim_spaces and replacement.endswith(" ")
        if model.trim_spaces:
            while out and out[-1] == mark:
                out.pop(), begins.pop(), ends.pop()
        return "".join(out), begins, ends


class _Memory(dict):
    """Results of ``make`` by text; emptied when full, and without those of long texts."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, part: str) -> bytes:
        made = self.make(part)
        if len(part) <= MEMORY_LETTERS:
            if len(self) >= MEMORY_PARTS:
                self.clear()
            self[part] = made
        return made


class Encoder:
    """Pieces of normalised text by merging neighbours in the order of their scores."""

    def __init__(self, model: Model):
        if not model.bpe:
            raise ValueError("only models that merge pairs by score are supported")
        self.model = model
        self.normalize = Normalizer(model)
        kinds = zip(model.pieces, model.kinds)
        self.ids = {p: i for i, (p, k) in enumerate(kinds) if k in (NORMAL, USER_DEFINED, UNUSED)}
        self.bytes_of = [-1] * 256
        for i, (piece, kind) in enumerate(zip(model.pieces, model.kinds)):
            if kind == BYTE:
                self.bytes_of[int(piece[3:5], 16)] = i
        self.unknown = model.kinds.index(UNKNOWN)
        # No merge crosses two neighbours that no piece holds side by side, so a text is cut there:
        # first at marks and line ends by one pattern, then, in a part not met before, by pair.
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = re.escape("".join(c for c in "\n\t\r" if c not in joined))
        edge, rest = re.escape(SPACE), f"[^{re.escape(SPACE)}{alone}]"
        within = any(pair[1] == SPACE != pair[0] for pair in self.pairs)
        self.part = re.compile("(?s).+" if within else f"(?s){edge}+{rest}*|{rest}+|.")
        self.rank = {p: -model.scores[i] for p, i in self.ids.items()}
        self._number_merges()
        self.short = _Memory(self.codes)
        self.known = _Memory(lambda part: b"".join(map(self.short.__getitem__, self.cut(part))))

    def _number_merges(self) -> None:
        """For two ids that form a piece: its place by score and its id, in one number.

        Pieces of equal score would be told apart by id instead of place in the text, so parts
        that can hold such pieces are left to ``merge``.
        """
        longer = [(self.rank[p], p) for p in self.ids if len(p) > 1]
        often = Counter(r for r, _ in longer)
        self.tied = {p[i : i + 2] for r, p in longer if often[r] > 1 for i in range(len(p) - 1)}
        place = {p: n for n, (r, p) in enumerate(sorted(longer)) if often[r] == 1}
        self.joined: dict[tuple[int, int], int] = {}
        for piece, at in place.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    self.joined[left, right] = at << ID_BITS | self.ids[piece]
        plain = [i for i, k in enumerate(self.model.kinds) if k == NORMAL and i < 1 << ID_BITS]
        self.single = {p: self.ids[p] for p in map(self.model.pieces.__getitem__, plain) if len(p) == 1}
        if any(self.model.kinds[i] == UNUSED for i in self.ids.values()):
            self.single = {}  # unused pieces need to be taken apart again
        # two characters: their first merge without a look at their ids
        self.begun = {p: self.joined[self.ids[p[0]], self.ids[p[1]]] for p in place if len(p) == 2 and p[0] in self.ids and p[1] in self.ids}
        self.code = [i << WIDTH_BITS | len(p) for i, p in enumerate(self.model.pieces)]

    def _fast_codes(self, part: str) -> list[int] | None:
        """Codes of a short part whose characters are all pieces; the same merges on numbers."""
        if self.tied and any(pair in part for pair in self.tied):
            return None
        ids = list(map(self.single.get, part))
        if None in ids:
            return None
        merges = list(map(self.begun.get, map(add, part, part[1:]), repeat(NO_MERGE)))
        joined = self.joined.get
        while merges:
            best = min(merges)
            if best == NO_MERGE:
                break
            at = merges.index(best)
            ids[at] = made = best & ((1 << ID_BITS) - 1)
            del ids[at + 1], merges[at]
            if at < len(merges):
                merges[at] = joined((made, ids[at + 1]), NO_MERGE)
            if at:
                merges[at - 1] = joined((ids[at - 1], made), NO_MERGE)
        code = self.code
        return [code[i] for i in ids]

    def cut(self, part: str) -> list[str]:
        """``part`` cut between neighbours that no piece holds side by side."""
        held = list(map(self.pairs.__contains__, map(add, part, part[1:])))
        start, out = 0, []
        while False in held:
            at = held.index(False) + 1
            out.append(part[start : start + at])
            start += at
            del held[:at]
        out.append(part[start:])
        return out

    def merge(self, part: str) -> list[str]:
        """Symbols left when no two neighbours form a piece; best score first, then leftmost."""
        ids, scores = self.ids, self.model.scores
        symbols: list[str | None] = list(part)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[float, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            at = ids.get(symbols[left] + symbols[right])
            if at is not None:
                width = len(symbols[left]) + len(symbols[right])
                heapq.heappush(queue, (-scores[at], left, right, width))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, left, right, width = heapq.heappop(queue)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or len(a) + len(b) != width:
                continue
            symbols[left], symbols[right] = a + b, None
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
                offer(left, after[right])
            if before[left] >= 0:
                offer(before[left], left)
        return [s for s in symbols if s is not None]

    def codes(self, part: str) -> bytes:
        """Codes of a part's pieces: the id, and the characters from its start on that it closes.

        The byte pieces of a character close nothing but the last, which closes the character.
        """
        fast = self._fast_codes(part) if len(part) <= MEMORY_LETTERS else None
        if fast is not None:
            return struct.pack(f"<{len(fast)}q", *fast)
        codes: list[int] = []
        for symbol in self.merge(part):
            at = self.ids.get(symbol)
            if at is not None and self.model.kinds[at] != UNUSED:
                codes.append(at << WIDTH_BITS | len(symbol))
            elif self.model.byte_fallback:
                codes.extend(self.bytes_of[o] << WIDTH_BITS for o in symbol.encode())
                codes[-1] |= len(symbol)
            else:
                codes.append(self.unknown << WIDTH_BITS | len(symbol))
        return struct.pack(f"<{len(codes)}q", *codes)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and the begin and end of each piece in the UTF-8 bytes of ``text``."""
        if not text:
            return (np.zeros(0, np.int32),) * 3
        if self.normalize.plain:
            prefix = " " if self.model.dummy_prefix else ""
            normal = (prefix + text).replace(" ", SPACE) if self.model.escape_spaces else prefix + text
            data = np.frombuffer(text.encode(), np.uint8)
            starts = np.flatnonzero((data & 0xC0) != 0x80)
            begin = np.concatenate([np.zeros(len(prefix), np.int64), starts])
            end = np.concatenate([np.zeros(len(prefix), np.int64), starts[1:], [len(data)]])
        else:
            normal, begins, ends = self.normalize(text)
            begin, end = np.array(begins, np.int64), np.array(ends, np.int64)
        codes = np.frombuffer(b"".join(map(self.known.__getitem__, self.part.findall(normal))), "<i8")
        if not len(codes):
            return (np.zeros(0, np.int32),) * 3
        ids, widths = codes >> WIDTH_BITS, codes & ((1 << WIDTH_BITS) - 1)
        last = np.cumsum(widths)  # characters closed so far
        first = last - widths
        opened = first[widths > 0]
        # a byte piece that closes nothing belongs to the next piece that does
        owner = np.cumsum(widths > 0) - (widths > 0)
        from_ = opened[owner]
        to = (last[widths > 0])[owner]
        return ids.astype(np.int32), begin[from_].astype(np.int32), end[to - 1].astype(np.int32)


class Decoder:
    """Text of pieces, as the library puts them together."""

    def __init__(self, model: Model):
        self.model = model
        self.octet = [
            int(p[3:5], 16) if k == BYTE else -1 for p, k in zip(model.pieces, model.kinds)
        ]
        self.is_byte = np.array([o >= 0 for o in self.octet])
        self.text = [
            "" if k == CONTROL else " ⁇ " if k == UNKNOWN else p.replace(SPACE, " ")
            for p, k in zip(model.pieces, model.kinds)
        ]

    def _bytes(self, ids: list[int]) -> str:
        """Valid UTF-8 as text; each octet that is not part of any becomes U+FFFD."""
        data, out, at = bytes(self.octet[i] for i in ids), [], 0
        while at < len(data):
            for width in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + width].decode())
                    at += width
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        is_byte = self.is_byte[ids]
        text = self.text
        if not is_byte.any():
            out = "".join([text[i] for i in ids.tolist()])
        else:
            edges = np.flatnonzero(np.diff(is_byte, prepend=not is_byte[0], append=not is_byte[-1]))
            listed, runs = ids.tolist(), []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                run = listed[a:b]
                runs.append(self._bytes(run) if is_byte[a] else "".join([text[i] for i in run]))
            out = "".join(runs)
        first = self.model.pieces[ids[0]]
        stripped = self.model.dummy_prefix or self.model.trim_spaces
        return out[1:] if stripped and first.startswith(SPACE) else out


def read_model(path: str) -> bytes:
    """A tokenizer's file, read once by the driver and sent to the workers."""
    with open(path, "rb") as file:
        return file.read()


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(v) for v in values]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int32), *values]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_documents(docs: DataFrame, model_data: bytes) -> DataFrame:
    """doc_id, ids, and the begin and end of every piece in the text's UTF-8 bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.sparkSession.sparkContext.broadcast(model_data)
    ready: list[Encoder] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not ready:
            ready.append(Encoder(Model.read(given.value)))
        found = [ready[0].encode(t or "") for t in batch.column("text").to_pylist()]
        lists = [_lists([f[i] for f in found]) for i in range(3)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *lists], names=["doc_id", "ids", "begins", "ends"]
        )

    return map_batches(
        docs.select("doc_id", F.col("text").cast("string")),
        work,
        f"doc_id {kind}, ids array<int>, begins array<int>, ends array<int>",
    )


def decode_documents(encoded: DataFrame, model_data: bytes) -> DataFrame:
    """doc_id, ids and the text that the ids stand for."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    given = encoded.sparkSession.sparkContext.broadcast(model_data)
    ready: list[Decoder] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not ready:
            ready.append(Decoder(Model.read(given.value)))
        ids = batch.column("ids")
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        sizes = np.array([0] + [len(v) if v.is_valid else 0 for v in ids]).cumsum()
        texts = [ready[0].decode(flat[a:b]) for a, b in zip(sizes[:-1], sizes[1:])]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), ids, pa.array(texts, pa.string())],
            names=["doc_id", "ids", "text"],
        )

    return map_batches(
        encoded.select("doc_id", "ids"), work, f"doc_id {kind}, ids array<int>, text string"
    )
