"""Operator 3, SentencePiece encoding and decoding with source spans.

A model file holds a compiled character map (a double-array trie over UTF-8 bytes and the strings that its ends name), scored
pieces and flags. Encoding normalises by the longest prefix that the map knows at each place, recording for every
normalised character the source bytes it came from; the BPE merges then run over the normalised characters, and every
piece is projected back to a byte span of the source. Decoding joins pieces, byte pieces and white-space marks as the
sentencepiece library does.

Merges cannot cross the start of a white-space run if no piece holds a white-space mark after another character, nor the
place between a letter and a full stop or comma if no piece holds the two in a row. The model is asked once; where that
holds, texts are cut there and the result of each distinct word is kept in a bounded cache; the words that a few texts bring
anew are merged together, on arrays (`bpe_batch`). Where moreover the character map is
empty and white space is not squeezed, the source itself is cut, and each distinct word is normalised and aligned by itself.

Defined cases: a null text is empty; an empty text has only the begin and end ids; very long texts are handled whole, in
time n log n even without white space; repeated rows give equal rows; columns other than id and text are not read, so clashing
names do no harm; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keyloom.llm.bpe_batch import ROWS, Merges
from keyloom.llm.bytescan import slices
from keyloom.llm.common import give_back, ship, spread

MARK = "▁"
TEXT_BYTES = 4 << 20
TOGETHER = 1 << 15  # characters whose cuts are held at a time: side by side, as fast as twice that and faster than 32 times
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
IDS, WIDTHS, DECODED, COVERED = map(itemgetter, range(4))  # of what a word gives
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharsMap:
    """A compiled character map: longest known prefix of a byte string, and what it becomes."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :]

    def first_bytes(self) -> set[int]:
        """Bytes with which a known prefix can begin."""
        if not self.units:
            return set()
        root = (self.units[0] >> 10) << ((self.units[0] & 0x200) >> 6)
        return {b for b in range(256) if root ^ b < len(self.units) and self.units[root ^ b] & 0x800000FF == b}

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest prefix of data[at:] in the map."""
        units = self.units
        if not units:
            return None
        found = None
        base = units[0]
        place = (base >> 10) << ((base & 0x200) >> 6)
        for i in range(at, len(data)):
            place ^= data[i]
            if place >= len(units):
                break
            unit = units[place]
            if unit & 0x800000FF != data[i]:
                break
            place ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[place] & 0x7FFFFFFF)
        if found is None:
            return None
        start = found[1]
        return found[0], self.strings[start : self.strings.index(b"\0", start)]


class Words(dict):
    """A cache that makes what it lacks when it is asked for it."""

    def __init__(self, make: Callable[[str], tuple[bytes, bytes, str, int]]):
        self.make = make

    def __missing__(self, raw: str) -> tuple[bytes, bytes, str, int]:
        return self.make(raw)


class Codec:
    def __init__(self, model: bytes, cache_size: int = 150_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        if m.trainer_spec.model_type != pb.TrainerSpec.BPE:
            raise ValueError("only BPE models are supported")
        norm = m.normalizer_spec
        self.map = CharsMap(norm.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces
        self.suffix = m.trainer_spec.treat_whitespace_as_suffix
        self.fallback, self.unk, self.unk_surface = m.trainer_spec.byte_fallback, m.trainer_spec.unk_id, m.trainer_spec.unk_surface
        self.bos, self.eos = m.trainer_spec.bos_id, m.trainer_spec.eos_id
        self.pieces = [p.piece for p in m.pieces]
        self.types = [p.type for p in m.pieces]
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (NORMAL, USER, UNUSED)}
        self.scores = [p.score for p in m.pieces]
        self.ranks = {p: -self.scores[i] for p, i in self.ids.items()}
        self.unused = UNUSED in self.types
        self.packed = {p: struct.pack("<I", i) for p, i in self.ids.items()}
        self.plain = [p.replace(MARK, " ") for p in self.pieces]  # a piece as decoded within a text
        self.shown = {p: self.plain[i] for p, i in self.ids.items()}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.users = sorted((p for p, i in self.ids.items() if self.types[i] == USER), key=len, reverse=True)
        inner = re.compile(f"[^{MARK}]{MARK}")
        self.cuttable = MARK in self.ids and self.escape and not self.suffix and not self.users and not any(inner.search(p) for p in self.ids)
        self.identity = self.cuttable and self.dummy and not self.squeeze and not self.map.units
        stops = re.escape("".join(c for c in ".,;:!?" if not any(a.isalpha() and b == c for p in self.ids for a, b in zip(p, p[1:], strict=False))))
        word = f"{MARK}*+[{LETTERS}]++(?=[{stops}])|" if stops else ""
        self.cut = re.compile(f"{word}{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.source_cut = re.compile(self.cut.pattern.replace(MARK, " "))
        self.held = self._held()
        self.runs = self._passing()
        self.merges: Merges | None = None
        self.words = Words(self.word)
        self.older: dict[str, tuple[bytes, bytes, str, int]] = {}  # the generation before, so that a full cache keeps what is in use
        self.cache_size = cache_size

    # normalisation -------------------------------------------------------------------------------------------------

    def _held(self) -> set[int]:
        """Bytes at which an entry of the map or a user piece can begin, or which squeezing may drop."""
        return self.map.first_bytes() | {u.encode()[0] for u in self.users} | ({32} if self.squeeze else set())

    def _passing(self) -> re.Pattern[bytes]:
        """Runs of characters at whose places neither the map nor a user piece can begin, and which squeezing leaves alone: each passes as it is."""
        held = self.held
        kinds = ((0x00, 0x80, b""), (0xC2, 0xE0, rb"[\x80-\xBF]"), (0xE0, 0xF0, rb"[\x80-\xBF]{2}"), (0xF0, 0xF5, rb"[\x80-\xBF]{3}"))
        ways = [b"[" + b"".join(rb"\x%02x" % b for b in range(lo, hi) if b not in held) + b"]" + more for lo, hi, more in kinds if not held.issuperset(range(lo, hi))]
        return re.compile(b"(?:" + b"|".join(ways) + b")+") if ways else re.compile(b"(?!)")

    def normalize(self, text: str, inner: bool = False) -> tuple[str, Sequence[int]]:
        """The normalised text and, for each of its characters and its end, the byte of the source where it begins. inner: a part of a text, without the dummy prefix."""
        space = MARK if self.escape else " "
        if inner and not self.held and not self.suffix:  # no entry can begin anywhere: the whole part is one run
            return text.replace(" ", space), range(len(text) + 1) if text.isascii() else _starts(text.encode())
        data = text.encode()
        out: list[str] = []
        start: list[int] = []
        at, end = 0, len(data)

        def step(i: int) -> tuple[int, str]:
            for u in self.users:
                if data.startswith(raw := u.encode(), i):
                    return len(raw), u
            if hit := self.map.longest(data, i):
                return hit[0], hit[1].decode()
            b = data[i]
            n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            return n, data[i : i + n].decode()

        if self.squeeze:
            while at < end:
                n, s = step(at)
                if s.strip(" "):
                    break
                at += n
        if at >= end:
            return "", [end]
        if self.dummy and not self.suffix and not inner:
            out.append(space)
            start.append(at)
        spaced = self.squeeze
        while at < end:
            if run := self.runs.match(data, at):
                s = run[0].decode()
                out.append(s.replace(" ", space))
                start += range(at, run.end()) if len(s) == run.end() - at else accumulate([at, *(len(c.encode()) for c in s[:-1])])
                spaced = False
                at = run.end()
                continue
            n, s = step(at)
            if spaced and self.squeeze:
                s = s.lstrip(" ")
            if s:
                for ch in s:
                    out.append(space if ch == " " else ch)
                    start.append(at)
                spaced = s.endswith(" ")
            at += n
        if self.squeeze:
            while out and out[-1] == space:
                out.pop()
                end = start.pop()
        if self.dummy and self.suffix:
            out.append(space)
            start.append(end)
        return "".join(out), [*start, end]

    # segmentation --------------------------------------------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """BPE: the best-scored adjacent pair is merged first, the leftmost of equals."""
        if len(text) <= 48 and not self.unused:
            return self._merge_short(text)
        parts: list[str | None] = list(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids, scores, types = self.ids, self.scores, self.types
        heap: list[tuple[float, int, int, str]] = []
        unused: dict[str, tuple[str, str]] = {}

        def offer(left: int, right: int) -> None:
            joined = parts[left] + parts[right]
            i = ids.get(joined)
            if i is not None:
                heapq.heappush(heap, (-scores[i], left, right, joined))
                if types[i] == UNUSED:
                    unused[joined] = (parts[left], parts[right])

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, joined = heapq.heappop(heap)
            if parts[left] is None or parts[right] is None or after[left] != right or len(parts[left]) + len(parts[right]) != len(joined):
                continue
            parts[left], parts[right] = joined, None
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        out: list[str] = []
        stack = [p for p in reversed(parts) if p is not None]
        while stack:
            p = stack.pop()
            if p in unused and types[ids[p]] == UNUSED:
                stack += reversed(unused[p])
            else:
                out.append(p)
        return out

    def _merge_short(self, text: str) -> list[str]:
        """The same for a short text: all pairs' ranks in one list, the first smallest of which is merged."""
        rank, none = self.ranks.get, float("inf")
        parts = list(text)
        cost = [rank(text[i : i + 2], none) for i in range(len(text) - 1)]
        while cost and (least := min(cost)) < none:
            i = cost.index(least)
            joined = parts[i] = parts[i] + parts.pop(i + 1)
            del cost[i]
            if i:
                cost[i - 1] = rank(parts[i - 1] + joined, none)
            if i < len(cost):
                cost[i] = rank(joined + parts[i + 1], none)
        return parts

    def tokens(self, normal: str, widths: list[int]) -> list[tuple[int, int]]:
        """(id, source bytes) of each piece; widths: source bytes of each normalised character."""
        return self._ids(self.merge(normal), widths)

    def _ids(self, parts: list[str], widths: list[int]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        at = 0
        for piece in parts:
            width = sum(widths[at : at + len(piece)])
            at += len(piece)
            i = self.ids.get(piece, self.unk)
            if i == self.unk and self.fallback:
                raw = piece.encode()
                out += [(self.byte_ids[b], 0) for b in raw[:-1]]
                out.append((self.byte_ids[raw[-1]], width))
            else:
                out.append((i, width))
        return out

    def word(self, raw: str) -> tuple[bytes, bytes, str, int]:
        """Ids and source widths as packed integers, the decoded text and the sum of the widths, of one cut of a source whose cuts are normalised apart."""
        kept = self.older.get(raw)
        if kept is None:
            normal, starts = self.normalize(raw, inner=True)
            parts = self.merge(normal)
            try:
                packed = b"".join(map(self.packed.__getitem__, parts))
                decoded = "".join(map(self.shown.__getitem__, parts))
                widths = [*map(len, parts)]
                if starts[-1] != len(normal):
                    ends = [starts[i] for i in accumulate(widths)]
                    widths = [b - a for a, b in zip([0, *ends], ends, strict=False)]
            except KeyError:  # unknown characters or their bytes
                known, widths = zip(*self._ids(parts, [b - a for a, b in zip(starts, starts[1:], strict=False)]), strict=True)
                packed, decoded = array("I", known).tobytes(), self.decode(known, first=False)
            if decoded == raw:
                decoded = raw  # one string in memory, not two
            kept = packed, array("I", widths).tobytes(), decoded, sum(widths)
        self._keep(raw, kept)
        return kept

    def _keep(self, raw: str, kept: tuple[bytes, bytes, str, int]) -> None:
        if len(raw) <= 48:
            if len(self.words) >= self.cache_size:
                # in place, as a look-up of many words may be under way
                self.older = dict(self.words)
                self.words.clear()
            self.words[raw] = kept

    def learn(self, cuts: set[str]) -> None:
        """What `word` gives, for all cuts that the cache lacks, with the merges of many words made together."""
        fresh = [raw for raw in cuts.difference(self.older) if len(raw) <= 48]
        if self.unused or len(fresh) < 64:  # few words are not worth the arrays
            return
        if self.merges is None:
            self.merges = Merges(self.ranks, self.ids)
        fresh.sort(key=len)
        for lo in range(0, len(fresh), ROWS):
            raws = fresh[lo : lo + ROWS]
            normals, starts = zip(*[self.normalize(raw, inner=True) for raw in raws], strict=True)
            ids, widths, counts = self.merges.split(normals, np.fromiter(chain.from_iterable(starts), np.int64))
            del normals, starts
            end = np.cumsum(counts)
            known, covered = np.minimum.reduceat(ids, end - counts) >= 0, np.add.reduceat(widths, end - counts)
            packed, spans = ids.astype("<u4").tobytes(), widths.astype("<u4").tobytes()
            shown = [*map(self.plain.__getitem__, ids.tolist())]
            at = 0
            for raw, to, whole, wide in zip(raws, end.tolist(), known.tolist(), covered.tolist(), strict=True):
                if whole:  # unknown characters are left to `word`
                    decoded = "".join(shown[at:to])
                    self._keep(raw, (packed[4 * at : 4 * to], spans[4 * at : 4 * to], raw if decoded == raw else decoded, wide))
                at = to

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, from, to) without begin and end ids; spans are bytes of the text."""
        if (cuts := self.cuts(text)) is not None:
            got = [*map(self.words.__getitem__, cuts)]
            ids, sizes = np.frombuffer(b"".join(map(IDS, got)), "<u4"), np.frombuffer(b"".join(map(WIDTHS, got)), "<u4").astype(np.int64)
            sizes[:1] -= 1  # the dummy prefix has no source
            to = np.cumsum(sizes)
            return ids, to - sizes, to
        normal, starts = self.normalize(text)
        widths = [b - a for a, b in zip(starts, starts[1:], strict=False)]
        cuts = self.cut.findall(normal) if self.cuttable else [normal] * bool(normal)
        got: list[tuple[int, int]] = []
        at = 0
        for c in cuts:
            got += self.tokens(c, widths[at : at + len(c)])
            at += len(c)
        sizes = np.array([w for _, w in got], np.int64)
        to = (starts[0] if len(starts) > 1 else 0) + np.cumsum(sizes)
        return np.array([i for i, _ in got], np.uint32), to - sizes, to

    def cuts(self, text: str) -> list[str] | None:
        """The text's cuts, if these are encoded apart. The dummy prefix counts as a blank before the text."""
        if not self.identity or MARK in text:
            return None
        return self.source_cut.findall(" " + text) if text else []

    # decoding ------------------------------------------------------------------------------------------------------

    def decode(self, ids, first: bool = True) -> str:
        """The library's decode(ids). first=False: the ids follow others."""
        out: list[str] = []
        raw = bytearray()
        strip = first and (self.dummy or self.squeeze)
        pending = strip
        for i in ids:
            i = int(i)
            kind = self.types[i]
            if kind == BYTE:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
                pending = False
            if kind == CONTROL:
                continue
            piece = self.unk_surface if kind == UNKNOWN else self.pieces[i]
            if pending and kind != UNKNOWN and piece.startswith(MARK):
                piece = piece[len(MARK) :]
                pending = self.squeeze and not piece
            elif piece:
                pending = False
            out.append(piece if kind == UNKNOWN else piece.replace(MARK, " "))
        if raw:
            out.append(_utf8(bytes(raw)))
        return "".join(out)

    def digests(self, texts: list[str]) -> list[tuple[int, str, str, int]]:
        """`digest` of each text, the new words of every few texts together."""
        out: list[tuple[int, str, str, int]] = []
        lo = size = 0
        for hi, t in enumerate(texts, 1):
            size += len(t)
            if size >= TOGETHER or hi == len(texts):
                out += self._digests(texts[lo:hi])
                lo, size = hi, 0
        return out

    def _digests(self, texts: list[str]) -> list[tuple[int, str, str, int]]:
        cuts = [*map(self.cuts, texts)]
        got = [None if c is None else [*map(self.words.get, c)] for c in cuts]
        gaps = [(g, c, i) for g, c in zip(got, cuts, strict=True) if g for i, x in enumerate(g) if x is None]
        self.learn({c[i] for _, c, i in gaps})
        for g, c, i in gaps:
            g[i] = self.words[c[i]]
        return [*map(self._digest, texts, got)]

    def digest(self, text: str) -> tuple[int, str, str, int]:
        """(number of ids, sha256 of the ids, sha256 of the decoded text, source bytes under all spans) with begin and end ids."""
        cuts = self.cuts(text)
        return self._digest(text, None if cuts is None else [*map(self.words.__getitem__, cuts)])

    def _digest(self, text: str, got: list[tuple[bytes, bytes, str, int]] | None) -> tuple[int, str, str, int]:
        """got: what `word` gives for each cut, None if the text is encoded whole."""
        head, tail = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        if got is not None:
            packed, covered = b"".join(map(IDS, got)), sum(map(COVERED, got)) - bool(got)
            # decode(ids) word by word: only the mark that begins the whole text is dropped
            decoded = "".join(map(DECODED, got))[1:]
        else:
            ids, lo, hi = self.encode(text)
            packed, covered = ids.astype("<u4").tobytes(), int((hi - lo).sum())
            decoded = self.decode([self.bos, *ids.tolist(), self.eos])
        packed = head + packed + tail
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), covered


def _starts(data: bytes) -> list[int]:
    """Where each character of valid UTF-8 begins, and the end."""
    out = [i for i, b in enumerate(data) if b & 0xC0 != 0x80]
    out.append(len(data))
    return out


def _utf8(raw: bytes) -> str:
    """One replacement character for each byte that begins no valid character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                at += 1
        return "".join(out)


_codecs: dict[str, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec, and so one word cache, a Python worker and model."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_digests(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes_covered: the digests of each text's ids, decoded text and spans."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in (part for batch in batches for part in slices(batch, 1, TEXT_BYTES)):
            got = c.digests([t or "" for t in b.column(1).to_pylist()])
            n, ids, dec, cov = zip(*got, strict=True) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(dec, pa.string()), pa.array(cov, pa.int64())], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes_covered"])
        give_back()

    return spread(df.select(id_col, text_col)).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes_covered long").withColumnRenamed("id", id_col)


def encode_tokens(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (with begin and end ids), from_byte, to_byte (spans, empty for begin and end) and decoded text of each document."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in (part for batch in batches for part in slices(batch, 1, TEXT_BYTES)):
            ids, lo, hi, dec = [], [], [], []
            for t in b.column(1).to_pylist():
                t = t or ""
                i, f, e = c.encode(t)
                size = len(t.encode())
                ids.append([c.bos, *i.tolist(), c.eos])
                lo.append([0, *f.tolist(), size])
                hi.append([0, *e.tolist(), size])
                dec.append(c.decode(ids[-1]))
            many = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, many), pa.array(lo, many), pa.array(hi, many), pa.array(dec, pa.string())], ["id", "ids", "from_byte", "to_byte", "decoded"])

    return spread(df.select(id_col, text_col)).mapInArrow(run, f"id {kind}, ids array<int>, from_byte array<int>, to_byte array<int>, decoded string").withColumnRenamed("id", id_col)
