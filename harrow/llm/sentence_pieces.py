"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of scored pieces.

``Codec`` reads a ``.model`` file. Text gets the dummy prefix, spaces become the white-space mark, and the best
segmentation is the one of the highest sum of piece scores (on a tie, the one whose last piece starts first);
a character that no piece covers costs ``lowest score - 10`` and is written as byte pieces. Where no piece crosses
from another character to a white-space mark (or a new line), the text is cut there first: the parts are solved
on their own and remembered, which leaves the result as it is.

Defined results: null and empty texts have no pieces; repeated rows repeat; an empty table gives an empty result;
decoding puts U+FFFD for bytes that are not UTF-8, writes unknown pieces as " ⁇ " and skips control pieces.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from harrow.llm import arrays as A
from harrow.session import ship

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
PARTS = 200_000  # distinct parts remembered by a task
SHORT = 64  # bytes of a part that is solved together with others and remembered
TOGETHER = 1 << 20  # characters of texts that are cut and encoded together
SOLVED = 8_000  # parts solved at once


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            value: object = number()
        elif kind == 2:
            n = number()
            value = raw[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            value = raw[at : at + n]
            at += n
        yield key >> 3, value


def read_model(path: str) -> tuple[list[tuple[str, float, int]], bool]:
    """The pieces (text, score, kind) in the order of their ids, and whether a dummy prefix is added."""
    pieces, prefix = [], True
    for number, value in _fields(open(path, "rb").read()):
        if number == 1:
            got = dict(_fields(value))
            pieces.append((got[1].decode(), struct.unpack("<f", got.get(2, b"\0" * 4))[0], got.get(3, NORMAL)))
        elif number == 3:
            prefix = bool(dict(_fields(value)).get(3, 1))
    return pieces, prefix


class DoubleArray:
    """A trie in two integer arrays: the child of ``s`` by byte ``c`` is ``t = base[s] + c`` where ``check[t] == s``."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        tree: dict = {}
        for key, value in keys:
            node = tree
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = value
        size, room = 1 << 12, 1 << 9
        self.base, self.check, self.value = array("i", [0]) * size, array("i", [-1]) * size, array("i", [-1]) * size
        self.check[0] = 0
        todo, low, wide = [(0, tree)], 257, 257  # so that every place can be reached from a positive base
        while todo:
            s, node = todo.pop()
            self.value[s] = node.get(-1, -1)
            marks = sorted(c for c in node if c >= 0)
            if not marks:
                continue
            # a lone child fills the lowest gap; several are put past those of earlier nodes
            at = max(1, low - marks[0]) if len(marks) == 1 else max(1, wide - marks[0])
            while True:
                if at + room >= len(self.check):
                    for a, fill in ((self.base, 0), (self.check, -1), (self.value, -1)):
                        a.extend(array("i", [fill]) * len(a))
                check = self.check
                for c in marks:
                    if check[at + c] >= 0:
                        break
                else:
                    break
                at += 1
            if len(marks) > 1:
                wide = max(wide, at + marks[0])
            self.base[s] = at
            for c in marks:
                check[at + c] = s
                todo.append((at + c, node[c]))
            while check[low] >= 0:
                low += 1


class Codec(dict):
    """Part of a text (spaces as they are) -> its ids as bytes of unsigned 32-bit integers. Fills itself."""

    def __init__(self, path: str):
        super().__init__()
        self.pieces, self.prefix = read_model(path)
        usable = [(p, s, i) for i, (p, s, k) in enumerate(self.pieces) if k in (NORMAL, USER)]
        scores = [s for _, s, i in usable if self.pieces[i][2] == NORMAL]
        self.unknown_score = min(scores, default=0.0) - 10
        best = max(scores, default=0.0)
        self.trie = DoubleArray([(p.encode(), i) for p, _, i in usable])
        self.score = [s if k != USER else len(p.encode()) * best - 0.1 for p, s, k in self.pieces]
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.unknown_id = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        cut_mark = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in usable)
        cut_line = not any("\n" in p for p, _, _ in usable)
        self.parts = re.compile(r"\n|[ ▁]*[^ ▁\n]+|[ ▁]+" if cut_mark and cut_line else r"[ ▁]*[^ ▁]+|[ ▁]+" if cut_mark else r"(?s).+").findall
        self.text_of = [b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in self.pieces]

    def __missing__(self, part: str) -> bytes:
        return array("I", self.viterbi(part.replace(" ", MARK).encode())).tobytes()

    def learn(self, parts: set[str]) -> None:
        """Solve the short parts that are new, all at once: the steps of ``viterbi`` over arrays."""
        new = parts.difference(self)
        if len(self) + len(new) > PARTS:  # what is in use stays
            held = {p: self[p] for p in parts if p in self}
            self.clear()
            self.update(held)
        pick = [(p, r) for p in new if len(r := p.replace(" ", MARK).encode()) <= SHORT]
        for k in range(0, len(pick), SOLVED):
            part = pick[k : k + SOLVED]
            ids, ends, odd = self._solve([r for _, r in part])
            raw, at = ids.astype("<u4").tobytes(), 0
            for (p, r), end, strange in zip(part, (4 * ends).tolist(), odd.tolist(), strict=True):
                self[p] = array("I", self.viterbi(r)).tobytes() if strange else raw[at:end]
                at = end

    def _solve(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all parts one after another, where each part's end, and which parts hold a character without a piece."""
        base, check, value = (np.frombuffer(x, dtype=np.int32) for x in (self.trie.base, self.trie.check, self.trie.value))
        score = np.asarray(self.score)
        data = np.frombuffer(b"\0".join(raws) + b"\0", dtype=np.uint8).astype(np.int32)
        size = np.array([len(r) for r in raws])
        first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        # every piece at every position: walk the trie from all positions at once
        at, node, found = np.arange(len(data)), np.zeros(len(data), dtype=np.int32), []
        step = 0
        while len(at):
            inside = at + step < len(data)
            at, node = at[inside], node[inside]
            to = base[node] + data[at + step]
            good = (check[to] == node) & (to != 0)
            at, node = at[good], to[good]
            step += 1
            v = value[node]
            hit = v >= 0
            found.append((at[hit], np.full(int(hit.sum()), step), v[hit]))
        start, length, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        lead = np.flatnonzero(((data & 0xC0) != 0x80) & (data != 0))
        width = np.where(data[lead] < 0x80, 1, np.where(data[lead] < 0xE0, 2, np.where(data[lead] < 0xF0, 3, 4)))
        single = np.zeros(len(data), dtype=bool)
        one = np.where(data[start] < 0x80, 1, np.where(data[start] < 0xE0, 2, np.where(data[start] < 0xF0, 3, 4)))
        single[start[length == one]] = True
        bare = ~single[lead]
        start = np.concatenate([start, lead[bare]])
        end = np.concatenate([start[: len(length)] + length, lead[bare] + width[bare]])
        piece = np.concatenate([piece, np.full(int(bare.sum()), -1)])
        gain = np.where(piece >= 0, score[piece], self.unknown_score)
        # best way to each end, ends at the same distance from their part's start together
        part = np.searchsorted(first, start, "right") - 1
        away = end - first[part]
        order = np.lexsort((start, end, away))
        start, end, piece, gain, away = start[order], end[order], piece[order], gain[order], away[order]
        best, via, back = np.full(len(data) + 1, -np.inf), np.full(len(data) + 1, -1), np.zeros(len(data) + 1, dtype=np.int64)
        best[first] = 0.0
        limits = np.searchsorted(away, np.arange(1, int(size.max()) + 2))
        for lo, hi in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True):
            if lo == hi:
                continue
            e, x = end[lo:hi], best[start[lo:hi]] + gain[lo:hi]
            heads = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
            top = np.maximum.reduceat(x, heads)
            group = np.repeat(np.arange(len(heads)), np.diff(np.concatenate([heads, [len(e)]])))
            equal = np.flatnonzero(x == top[group])
            _, once = np.unique(group[equal], return_index=True)
            chosen = lo + equal[once]  # of equal ways the one that starts first
            best[end[chosen]], via[end[chosen]], back[end[chosen]] = top, piece[chosen], start[chosen]
        # walk back from all ends at once
        odd, who, at, turn, got = np.zeros(len(raws), dtype=bool), np.flatnonzero(size), (first + size)[size > 0], 0, []
        while len(who):
            v = via[at]
            odd[who[v < 0]] = True
            got.append((who, np.full(len(who), -turn), v))
            at = back[at]
            more = at > first[who]
            who, at, turn = who[more], at[more], turn + 1
        who, turn, v = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((turn, who))
        return np.maximum(v[order], 0), np.cumsum(np.bincount(who, minlength=len(raws))), odd

    def viterbi(self, raw: bytes) -> list[int]:
        """Ids of the best segmentation of ``raw``."""
        n, base, check, value, score = len(raw), self.trie.base, self.trie.check, self.trie.value, self.score
        lost = float("-inf")
        best, back, via = [lost] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            so_far = best[i]
            if so_far == lost:
                continue
            c = raw[i]
            one = i + (1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4)
            s, single = 0, False
            for j in range(i, n):
                t = base[s] + raw[j]
                if check[t] != s or t == 0:
                    break
                s = t
                if (v := value[s]) >= 0:
                    j += 1
                    if (x := so_far + score[v]) > best[j]:
                        best[j], back[j], via[j] = x, i, v
                    single |= j == one
            if not single and (x := so_far + self.unknown_score) > best[one]:
                best[one], back[one], via[one] = x, i, -1
        out, j = [], n
        while j > 0:
            i, v = back[j], via[j]
            if v >= 0:
                out.append(v)
            elif self.byte_id:
                out.extend(self.byte_id[b] for b in reversed(raw[i:j]))
            else:
                out.append(self.unknown_id)
            j = i
        out.reverse()
        return out

    def encode_bytes(self, text: str) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.__getitem__, self.cut(text)))

    def cut(self, text: str) -> list[str]:
        return self.parts(" " + text if self.prefix else text) if text else []

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as bytes; texts of about TOGETHER characters are held at once."""
        at = 0
        while at < len(texts):
            cuts, size = [], 0
            while at < len(texts) and (size < TOGETHER):
                cuts.append(self.cut(texts[at]))
                size += len(texts[at])
                at += 1
            self.learn(set().union(*cuts))
            for c in cuts:
                yield b"".join(map(self.__getitem__, c))

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_bytes(text)).tolist()

    def decode(self, ids) -> str:
        raw = b"".join(map(self.text_of.__getitem__, ids))
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per worker process and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, token_ids) of every whole text. One pass, no shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            ids = list(c.encode_all([t or "" for t in batch.column(1).to_pylist()]))
            ends = array("i", [0])
            for x in ids:
                ends.append(ends[-1] + len(x) // 4)
            n = ends[-1]
            flat = pa.Array.from_buffers(pa.int32(), n, [None, pa.py_buffer(b"".join(ids))])
            lists = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)]), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), lists], names=[id_col, "n_tokens", "token_ids"])
        c.clear()

    fields = [docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType()))]
    return docs.select(id_col, text_col).mapInArrow(A.tidied(run), T.StructType(fields))


def decode(ids: DataFrame, model: str, ids_col: str = "token_ids", out_col: str = "text") -> DataFrame:
    """``ids`` with the decoded text in ``out_col`` (replaced where it is there already); null ids give null."""
    ship(ids.sparkSession)
    kept = [f for f in ids.schema.fields if f.name != out_col]
    at = [ids.columns.index(f.name) for f in kept]
    source = ids.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = codec(model).decode
        for batch in batches:
            texts = [None if x is None else back(x) for x in batch.column(source).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), pa.array(texts, pa.string())], names=[*(f.name for f in kept), out_col])

    return ids.mapInArrow(run, T.StructType([*kept, T.StructField(out_col, T.StringType())]))


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, ids_sha256, round_trip): the digest is of the ids as little-endian 32-bit integers; round_trip: decoding gives the text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for t, ids in zip(texts, c.encode_all(texts), strict=True):
                row = (len(t.encode()), len(ids) // 4, hashlib.sha256(ids).hexdigest(), c.decode(array("I", ids)) == t)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=[id_col, "n_bytes", "n_tokens", "ids_sha256", "round_trip"])
        c.clear()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(A.tidied(run), f"`{id_col}` {kind}, n_bytes long, n_tokens long, ids_sha256 string, round_trip boolean")
