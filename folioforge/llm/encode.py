"""Problem 8: token ids of a byte-level BPE vocabulary.

The merges run as a streaming transducer. From the merge list alone a bound is
computed on how far to the left of the last byte read a still unknown
continuation can change anything: the sufficient lookahead. A token is emitted
once it ends at least that far before the last byte read, so one run of bytes
of any length needs a buffer of fixed size. Every text is fed to it in parts of
fixed size: the vocabulary's own pattern cuts them into runs, of which the last
few wait for what follows; short runs are looked up in a bounded cache.
Decoding feeds bytes through an incremental UTF-8 state machine.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Runs kept with their ids in each Python worker; the cache is emptied when full.
CACHED_RUNS = 150_000
SCHEMA = "doc_id long, ids array<int>"

_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def _ranges(points: Iterable[int]) -> str:
    """The body of a character class holding these code points."""
    out, start, last = [], None, None
    for p in [*points, None]:
        if last is not None and (p is None or p != last + 1):
            out.append(f"\\U{start:08x}" + (f"-\\U{last:08x}" if last > start else ""))
            start = None
        if p is not None and start is None:
            start = p
        last = p
    return "".join(out)


def run_pattern(top: int = sys.maxunicode) -> dict[str, re.Pattern]:
    """The split pattern with \\p{L}, \\p{N} and \\s written out, as ``re`` has no such classes.

    With ``top`` at 0xFFFF it holds for texts without characters beyond, and
    ``re`` can look the classes up in bitmaps, which is several times as fast.
    """
    kinds: dict[str, list[int]] = {"L": [], "N": []}
    for p in range(top + 1):
        if (k := unicodedata.category(chr(p))[0]) in kinds:
            kinds[k].append(p)
    space = _ranges([*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
    letter, number = _ranges(kinds["L"]), _ranges(kinds["N"])
    run = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    return {"run": re.compile(run), "letter": re.compile(f"[{letter}]*"), "number": re.compile(f"[{number}]*"), "space": re.compile(f"[{space}]*"), "other": re.compile(f"[^{space}{letter}{number}]*")}


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A merge list over byte symbols. merges: (left, right, merged) ids by falling priority."""

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.tokens = tokens
        self.single = {t[0]: i for i, t in tokens.items() if len(t) == 1}
        self.rank = {}
        for r, (a, b, c) in enumerate(merges):
            self.rank.setdefault((a, b), (r, c))
        self.merges = merges

    @classmethod
    def from_json(cls, raw: bytes) -> Merges:
        model = json.loads(raw)["model"]
        symbol, vocab = byte_symbols(), model["vocab"]
        tokens = {i: bytes(symbol[c] for c in t) for t, i in vocab.items() if all(c in symbol for c in t)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return cls(tokens, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])

    @cached_property
    def lookahead(self) -> int:
        """Bytes before the end of the input beyond which no continuation changes a token.

        Two readings of the same bytes, one with more to come, agree left of a
        frontier that starts at the end. A merge moves it left by its left part
        only if its right part starts at the frontier, that is, if a part moved
        across before is a leading piece of it. So the longest chain of merges of
        falling priority, each one's right part led by the left part of the one
        before, bounds the way of the frontier.
        """
        leading: dict[int, tuple[int, ...]] = {i: (i,) for i in self.single.values()}
        best: dict[int, int] = {}
        longest = 0
        for a, b, c in self.merges:
            way = len(self.tokens[a]) + max((best.get(x, 0) for x in leading[b]), default=0)
            leading.setdefault(c, (c, *leading[a]))
            if way > best.get(a, 0):
                best[a] = way
            longest = max(longest, way)
        return longest

    def whole(self, data: bytes) -> list[int]:
        """Ids of one run of bytes, all of it at hand."""
        ids = [self.single[b] for b in data]
        return self._few(ids) if len(ids) < 24 else self._many(ids)

    def _few(self, ids: list[int]) -> list[int]:
        rank = self.rank
        while len(ids) > 1:
            best = min((m for m in map(rank.get, zip(ids, ids[1:], strict=False)) if m), default=None)
            if best is None:
                break
            out, i, (a, b, c) = [], 0, self.merges[best[0]]
            while i < len(ids):
                if ids[i] == a and i + 1 < len(ids) and ids[i + 1] == b:
                    out.append(c)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _many(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i) for i, m in enumerate(map(rank.get, zip(ids, ids[1:], strict=False))) if m]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or (ids[i], ids[j]) != self.merges[r][:2]:
                continue
            ids[i], ids[j] = self.merges[r][2], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := rank.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i))
            if (h := before[i]) >= 0 and (m := rank.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h))
        return [i for i in ids if i >= 0]


class RunStream:
    """Ids of one run of bytes that comes in parts, in constant memory."""

    def __init__(self, merges: Merges, window: int = 0):
        self.merges, self.held = merges, b""
        self.window = max(window or 4096, merges.lookahead + 1)

    def feed(self, data: bytes) -> list[int]:
        """The ids that became stable."""
        out: list[int] = []
        for at in range(0, len(data), self.window):
            self.held += data[at : at + self.window]
            if len(self.held) > self.merges.lookahead:
                done, stable = 0, len(self.held) - self.merges.lookahead
                for i in self.merges.whole(self.held):
                    if done + len(self.merges.tokens[i]) > stable:
                        break
                    done += len(self.merges.tokens[i])
                    out.append(i)
                self.held = self.held[done:]
        return out

    def close(self) -> list[int]:
        out, self.held = self.merges.whole(self.held), b""
        return out


class Encoder:
    """Texts to ids, each through the streaming transducer."""

    #: Runs up to so many bytes, less than the lookahead of usual vocabularies, end before anything of them is stable: they wait for their end, and are looked up whole.
    LONG = 256
    #: Characters that the transducer is fed at a time.
    PART = 8192

    def __init__(self, merges: Merges, cached_runs: int = CACHED_RUNS):
        self.merges, self.most = merges, cached_runs
        self.patterns = run_pattern()
        self.narrow = run_pattern(0xFFFF)["run"].findall
        self.cache: dict[str, tuple[int, ...]] = _Runs(self)

    def run(self, run: str) -> tuple[int, ...]:
        data = run.encode()
        if len(data) <= self.LONG:
            return tuple(self.merges.whole(data))
        stream = RunStream(self.merges)
        return (*stream.feed(data), *stream.close())

    def runs(self, text: str) -> list[str]:
        return self.patterns["run"].findall(text) if _ASTRAL.search(text) else self.narrow(text)

    def ids(self, runs: list[str]) -> Iterator[int]:
        if len(self.cache) > self.most:
            self.cache.clear()
        return chain.from_iterable(map(self.cache.__getitem__, runs))

    def into(self, text: str, ids: array) -> None:
        stream, size = TextStream(self), self.PART
        for at in range(0, len(text), size):
            ids.extend(stream.feed(text if len(text) <= size else text[at : at + size]))
        ids.extend(stream.close())

    def encode(self, text: str) -> list[int]:
        ids = array("i")
        self.into(text, ids)
        return ids.tolist()

    def stream(self, parts: Iterable[str]) -> Iterator[int]:
        """Ids of a text that comes in parts; holds back only what a continuation could still change."""
        stream = TextStream(self)
        for part in parts:
            yield from stream.feed(part)
        yield from stream.close()


class TextStream:
    """Ids of one text that comes in parts, in memory that depends on the parts' size only.

    The last runs of what was read are held back, as a continuation can still
    change where they are cut; a run that has become long goes on byte by byte.
    """

    HELD = 3

    def __init__(self, encoder: Encoder):
        self.encoder, self.held = encoder, ""
        self.long: RunStream | None = None
        self.kind, self.kept = "", ""

    def feed(self, part: str) -> Iterable[int]:
        """The ids that became stable."""
        out: list[int] = []
        if self.long:
            part = self._more(part, out)
            if self.long:
                return out
        encoder = self.encoder
        runs = encoder.runs(self.held + part)
        tail = runs[-self.HELD :]
        done = encoder.ids(runs[: -self.HELD])
        self.held = "".join(tail)
        if tail and len(tail[-1]) > encoder.LONG:
            out += done
            out += encoder.ids(tail[:-1])
            self.held = ""
            self._open(tail[-1], out)
            return out
        return chain(out, done) if out else done

    def close(self) -> Iterable[int]:
        out: list[int] = []
        if self.long:
            out += self.long.feed(self.kept.encode())
            out += self.long.close()
            self.long, self.kept = None, ""
        out += self.encoder.ids(self.encoder.runs(self.held))
        self.held = ""
        return out

    def _open(self, run: str, out: list[int]) -> None:
        patterns = self.encoder.patterns
        self.kind = next(k for k in ("letter", "number", "space", "other") if patterns[k].match(run, 1).end() > 1)
        self.long = RunStream(self.encoder.merges)
        self.kept = ""
        self._take(run, out)

    def _take(self, more: str, out: list[int]) -> None:
        # the last blank of a run of blanks may belong to the word that follows
        self.kept, more = (more[-1:], more[:-1]) if self.kind == "space" else ("", more)
        out += self.long.feed(more.encode())

    def _more(self, part: str, out: list[int]) -> str:
        """Goes on through the long run; what follows it, with a blank held back, is what is left of the part."""
        end = self.encoder.patterns[self.kind].match(part).end()
        self._take(self.kept + part[:end], out)
        if end == len(part):
            return ""
        out += self.long.close()
        rest, self.long, self.kept = self.kept + part[end:], None, ""
        return rest


class _Runs(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, run: str) -> tuple[int, ...]:
        ids = self.encoder.run(run)
        if len(run) <= 64:
            self[run] = ids
        return ids


class Decoder:
    """Ids to text, part by part: unfinished characters wait for their other bytes."""

    def __init__(self, merges: Merges):
        self.tokens, self.state = merges.tokens, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.tokens.__getitem__, ids)))

    def close(self) -> str:
        return self.state.decode(b"", True)


_worker: dict[int, Encoder] = {}


def worker_encoder(raw: bytes) -> Encoder:
    key = hash(raw)
    if key not in _worker:
        _worker.clear()
        _worker[key] = Encoder(Merges.from_json(raw))
    return _worker[key]


def encode_texts(df: DataFrame, item: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row of ids for each row; null and empty texts give an empty list.

    Texts are encoded whole and as they stand, without special tokens; their
    strings in a text are ordinary text. Null ids and repeated rows stay, other
    columns are ignored whatever their names. The vocabulary, a file of fixed
    size, is broadcast. Narrow: one pass, no shuffle.
    """
    small_batches(df.sparkSession)
    with open(vocabulary, "rb") as file:
        raw = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(raw.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, ends = array("i"), [0]
                for body in part.column(1).to_pylist():
                    if body:
                        encoder.into(body, ids)
                    ends.append(len(ids))
                values = pa.array(np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["doc_id", "ids"])

    return df.select(F.col(item).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def decode_ids(df: DataFrame, item: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The text of each row's ids; null gives null, an empty list an empty text."""
    with open(vocabulary, "rb") as file:
        raw = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = worker_encoder(raw.value).merges
        for batch in batches:
            texts = []
            for row in batch.column(1).to_pylist():
                decoder = Decoder(merges)
                texts.append(None if row is None else decoder.feed(row) + decoder.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(F.col(item).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")
