"""SentencePiece encoding and decoding by batched Viterbi search in numpy.

Texts become words: they are cut between two characters that stand side by side in no piece, as no piece of an encoding
can span such a place (a space after a letter, a full stop, a line end). The distinct words of a batch that have the same length advance together: the hashes of
all substrings probe the sorted hashes of the pieces at once, and for each end position one vectorised maximum over
the lengths of the last piece stores its backpointer.

The weight of an arc depends on the kind of model. In a unigram model it is the piece's score, and sums are compared.
In a merge (BPE) model scores cannot be summed: there an arc is open if merging could have left its piece beside the
last piece of the path so far, and the one open path is the encoding (see ``Pieces.beside``). Both give the ids of the
library. Characters without a piece become their UTF-8 bytes, or the unknown piece in models without byte pieces.

Null texts have no ids (an empty list), as do empty ones. Decoding gives back the text, but for a literal U+2581, which
the format cannot tell from a space. A word is held whole; memory is bounded by the batch, its longest word and a cache
of ``CACHE`` words. Only models with the identity normaliser are accepted.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHE = 150_000
_NONE = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & _MASK))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pair(c: np.ndarray) -> np.ndarray:
    """Places of all pairs of neighbours in a table of 2 ** 20; a false hit only leaves a word longer."""
    return ((c[:-1] * np.uint32(0x9E3779B1) + c[1:]) * np.uint32(0x85EBCA6B)) >> np.uint32(12)


class Pieces:
    """The pieces of one model as sorted hashes and arrays by id; built on the driver, sent to tasks."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.name != "identity" or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("only models with the identity normaliser are supported")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.merges = model.trainer_spec.model_type == 2
        names = [p.piece for p in model.pieces]
        n = self.n = len(names)
        usable = [i for i, p in enumerate(model.pieces) if p.type == 1]
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == 2), 0)
        self.bytes_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.score = np.array([p.score for p in model.pieces] + [0.0])
        self.score[n] = min(self.score[usable], default=0.0) - 10.0
        self.joins = np.zeros(1 << 20, bool)  # pairs of characters inside pieces, hashed; others are cut
        for i in usable:
            c = _codes(names[i])
            self.joins[_pair(c)] = True
        self.longest = max((len(names[i]) for i in usable), default=1)
        self.len = np.ones(n + 1, np.int64)
        hashes = np.zeros(n + 1, np.uint64)
        for i in usable:
            self.len[i] = len(names[i])
            hashes[i] = self._hash(names[i])
        self.hash = hashes
        order = np.array(sorted(usable, key=lambda i: int(hashes[i])), np.int64)
        self.keys, self.ids = hashes[order], order
        self.seen = np.zeros(1 << 20, bool)  # top bits of the keys: spares most probes that would find nothing
        self.seen[self.keys >> np.uint64(44)] = True
        self.power = _powers(_BASE, self.longest + 1)
        # what decoding writes for an id
        self.out = [b""] * (n + 1)
        for i in usable:
            self.out[i] = names[i].encode("utf-8")
        for b, i in self.bytes_ids.items():
            self.out[i] = bytes([b])
        self.out[self.unknown] = " ⁇ ".encode()
        if self.merges:
            self._derive(names, usable)
        self.asked, self.answer = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def words(self, text: str) -> list[str]:
        """The text with its prefix, cut where no piece can span."""
        marked = self.prefix + text.replace(" ", MARK)
        ends = np.flatnonzero(~self.joins[_pair(_codes(marked))]) + 1
        at = [0, *ends.tolist(), len(marked)]
        return [marked[a:b] for a, b in zip(at, at[1:])]

    @staticmethod
    def _hash(s: str) -> int:
        c = _mix(_codes(s))
        return int((c * _powers(_BASE, len(c))).sum(dtype=np.uint64))

    def _derive(self, names: list[str], usable: list[int]) -> None:
        """How merging forms each piece: its time, and its parts in the last merge; -1 if it never is formed."""
        n, at = self.n, {names[i]: i for i in usable}
        values = sorted({-float(self.score[i]) for i in usable})
        place = {v: k for k, v in enumerate(values)}
        time = {i: place[-float(self.score[i])] for i in usable}
        self.time = np.full(n + 1, _NONE, np.int64)
        self.left, self.right = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        self.formed = np.zeros(n + 1, bool)
        self.formed[n] = True
        for i in usable:
            self.time[i] = time[i]
            parts, last = list(names[i]), (-1, -1)
            while len(parts) > 1:
                options = [
                    (time[at[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in at
                ]
                if not options:
                    break
                k = min(options)[1]
                last = (at.get(parts[k], n), at.get(parts[k + 1], n))
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 1:
                self.formed[i] = True
                self.left[i], self.right[i] = last

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 if there is none."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.seen[hashes >> np.uint64(44)])
        h = hashes[maybe]
        k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[k] == h, self.ids[k], -1)
        return out

    def beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_beside``, with the latest answers kept by hash of the pair."""
        pair = a * (self.n + 1) + b
        slot = ((pair.view(np.uint64) * np.uint64(_BASE)) >> np.uint64(44)).astype(np.int64)
        good = self.answer[slot]
        new = np.flatnonzero(self.asked[slot] != pair)
        if len(new):
            good[new] = self._beside(a[new], b[new])
            self.asked[slot[new]], self.answer[slot[new]] = pair[new], good[new]
        return good

    def _beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of ``a`` followed by that of ``b`` leaves exactly these two pieces.

        Time is run backwards: the piece formed last is taken apart, so that a moment earlier its inner part stood at
        the border. If the two parts at the border could be joined before that moment, merging would have done so.
        Of joins at one moment the leftmost comes first: it precedes the forming of ``b`` but not that of ``a``.
        """
        good = np.ones(len(a), bool)
        live = np.flatnonzero((a != self.n) & (b != self.n))
        a, b = a[live], b[live]
        until = np.full(len(live), _NONE, np.int64)
        while len(live):
            joint = self.find(self.hash[a] + self.power[np.minimum(self.len[a], self.longest)] * self.hash[b])
            known = (joint >= 0) & (self.len[a] + self.len[b] <= self.longest)
            bad = known & (self.time[np.where(known, joint, self.n)] < until)
            good[live[bad]] = False
            ta = np.where(self.left[a] >= 0, self.time[a], -1)
            tb = np.where(self.left[b] >= 0, self.time[b], -1)
            go = ~bad & ((ta >= 0) | (tb >= 0))
            live, a, b, ta, tb = live[go], a[go], b[go], ta[go], tb[go]
            second = tb >= ta
            until = np.where(second, tb + 1, ta)
            a, b = np.where(second, a, self.right[a]), np.where(second, self.left[b], b)
            inside = (a != self.n) & (b != self.n)  # a character without a piece joins nothing
            live, a, b, until = live[inside], a[inside], b[inside], until[inside]
        return good

    def search(self, words: list[str]) -> list[list[int]]:
        """Best paths of words of one length; ``n`` stands for a character without a piece."""
        size, w = len(words[0]), len(words)
        codes = _codes("".join(words)).reshape(w, size)
        power = _powers(_BASE, size + 1)
        inverse = _powers(pow(_BASE, -1, 1 << 64), size + 1)
        sums = np.zeros((w, size + 1), np.uint64)
        np.cumsum(_mix(codes) * power[:size], axis=1, out=sums[:, 1:])
        most = min(self.longest, size)
        arcs = np.full((most + 1, w, size), -1, np.int64)  # [length, word, start]
        for l in range(1, most + 1):
            h = (sums[:, l:] - sums[:, : size + 1 - l]) * inverse[: size + 1 - l]
            arcs[l, :, : size + 1 - l] = self.find(h.ravel()).reshape(h.shape)
        arcs[1] = np.where(arcs[1] < 0, self.n, arcs[1])
        best = np.full((w, size + 1), -np.inf)
        best[:, 0] = 0.0
        back = np.zeros((w, size + 1), np.int64)
        last = np.full((w, size + 1), -1, np.int64)
        rows = np.arange(w)
        for end in range(1, size + 1):
            lengths = np.arange(1, min(most, end) + 1)
            ids = np.stack([arcs[l, :, end - l] for l in lengths], axis=1)
            value = best[:, end - lengths]
            if self.merges:
                before = last[:, end - lengths]
                open_ = (ids >= 0) & (value > -np.inf) & self.formed[ids]
                ask = open_ & (before >= 0)
                open_[ask] = self.beside(before[ask], ids[ask])
                value = np.where(open_, 0.0, -np.inf)
            else:
                value = np.where(ids >= 0, value + self.score[ids], -np.inf)
            k = value.argmax(axis=1)
            best[:, end], back[:, end], last[:, end] = value[rows, k], lengths[k], ids[rows, k]
        paths: list[list[int]] = [[] for _ in words]
        at = np.full(w, size)
        while at.any():
            on = np.flatnonzero(at)
            for r, t in zip(on.tolist(), last[on, at[on]].tolist()):
                paths[r].append(t)
            at[on] -= back[on, at[on]]
        return [p[::-1] for p in paths]

    def encode_words(self, words: list[str], block: int = 1 << 20) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers; groups of one length share a search."""
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            groups.setdefault(len(word), []).append(k)
        for size, members in groups.items():
            step = max(1, block // (size * min(size, self.longest)))
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for k, path in zip(part, self.search([words[k] for k in part])):
                    out[k] = array("i", self._fallback(words[k], path)).tobytes()
        return out

    def _fallback(self, word: str, path: list[int]) -> list[int]:
        if self.n not in path:
            return path
        out, at = [], 0
        for t in path:
            if t != self.n:
                out.append(t)
                at += int(self.len[t])
                continue
            raw = word[at].encode("utf-8", "replace")
            found = [self.bytes_ids.get(b, -1) for b in raw]
            out += found if min(found) >= 0 else [self.unknown]
            at += 1
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join([self.out[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text



class Encoder:
    """A model with a bounded cache of words."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.cache = pieces, {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self.pieces.words(t) if t else [] for t in texts]
        new = list({w for ws in split for w in ws if w not in self.cache})
        found = dict(zip(new, self.pieces.encode_words(new))) if new else {}
        cache = self.cache
        out = [b"".join([cache[w] if w in cache else found[w] for w in ws]) for ws in split]
        if len(cache) < CACHE:  # words met early are the frequent ones; they stay
            cache.update(dict(list(found.items())[: CACHE - len(cache)]))
        return out


def _chunks(b: pa.RecordBatch, column: int, chars: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``chars`` characters each, one row at least."""
    sizes = [len(x) if x is not None else 0 for x in b.column(column).to_pylist()]
    at = total = 0
    for k, n in enumerate(sizes):
        if k > at and total + n > chars:
            yield b.slice(at, k - at)
            at, total = k, 0
        total += n
    if at < len(sizes):
        yield b.slice(at)


def encode(docs: DataFrame, pieces: Pieces, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``key``, ``text`` and its ``ids`` for each row; with ``decoded`` also the text these give back."""
    model = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        encoder = Encoder(model.value)
        for whole in batches:
            for b in _chunks(whole, 1, 1 << 19):
                raw = encoder.encode(b.column(1).to_pylist())
                ends = np.cumsum([0, *(len(r) // 4 for r in raw)])
                ids = pa.array(np.frombuffer(b"".join(raw), "<i4"))
                out = [b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)]
                if decoded:
                    out.append(pa.array([model.value.decode(np.frombuffer(r, "<i4")) for r in raw], pa.string()))
                yield pa.RecordBatch.from_arrays(out, [key, text, "ids", "decoded"][: len(out)])

    rows = docs.select(F.col(key), F.col(text))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, `{text}` string, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, pieces: Pieces, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns plus the text of ``ids``; null ids give a null text."""
    model = encoded.sparkSession.sparkContext.broadcast(pieces)
    names = [c for c in encoded.columns if c != into]
    rows = encoded.select(*[F.col(c) for c in names])
    place = names.index(ids)

    def run(batches):
        for whole in batches:
            for b in _chunks(whole, place, 1 << 18):
                texts = []
                for x in b.column(place):
                    texts.append(model.value.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, into])

    from pyspark.sql.types import StringType, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add(into, StringType()))
