"""Secret scans: base patterns, and a token-efficiency test for random strings.

Base kinds: ``assign`` (a credential name, ``:`` or ``=``, and a value of 12 or more characters), ``access`` (AKIA
and 14 or more capitals or digits) and ``hex`` (16 or more of 0-9a-f). The method adds kind ``random``: a run of 12
or more key characters holding a letter, whose characters per token under a byte-pair vocabulary are fewer than
``ratio``; ordinary words and names pack more characters in a token than random strings can. Runs under 20 characters
and runs shaped like one word must stay below a share of the ratio. Digests of known lengths, UUIDs and path-like
names are excluded, and so is what a base span covers already.

A text is swept once, base spans beside runs, in time in proportion to its length. Spans are code point offsets, end
exclusive. Defined results: null and empty texts have no spans; repeated rows
repeat; an empty table gives an empty result; other columns pass through untouched in ``redact``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm import arrays as A
from harrow.session import ship

KINDS = ("assign", "access", "hex", "random")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
DIGEST_LENGTHS = frozenset({32, 40, 48, 56, 64, 96, 128})
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
PART = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]+|[0-9]{1,8}")
LETTER = re.compile(r"[A-Za-z]")
SEPARATORS = re.compile(r"[/_=+-]+")
WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
RATIO, LONG = 2.2, 20
#: Share of the ratio by (shaped like one word, shorter than LONG): words of rare spelling and short names pack less by chance.
SHARES = {(False, False): 1.0, (False, True): 0.82, (True, False): 0.9, (True, True): 0.68}

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The vocabulary of a rank file, once per worker process."""
    if path not in _encodings:
        import tiktoken
        from public_tokenizers import PATTERN

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        _encodings[path] = tiktoken.Encoding("runs", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base kinds, in order."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def excluded(run: str) -> bool:
    """Known digests, identifiers, and names made of plain words and short numbers; a single word is for the ratio to judge."""
    if DIGEST.match(run) and len(run) in DIGEST_LENGTHS or UUID.match(run):
        return True
    return not WORD.fullmatch(run) and all(map(PART.fullmatch, SEPARATORS.split(run)))


def random_spans(text: str, base: list[tuple[int, int, int]], enc, ratio: float) -> list[tuple[int, int, int]]:
    """Runs of few characters a token; base spans, in order of their starts, are swept along with the runs."""
    out, reached, far = [], 0, 0  # base spans that start by now, and the furthest end among them
    for m in RUN.finditer(text):
        a, b = m.span()
        while reached < len(base) and base[reached][0] <= a:
            far = max(far, base[reached][2])
            reached += 1
        run = m[0]
        if b <= far or LETTER.search(run) is None or excluded(run):
            continue
        share = SHARES[WORD.fullmatch(run) is not None, len(run) < LONG]
        if len(run) < share * ratio * len(enc.encode_ordinary(run)):
            out.append((a, 3, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(text: str, enc, ratio: float = RATIO) -> tuple[list, list]:
    """(base spans, all spans), each in order."""
    base = base_spans(text)
    return base, sorted([*base, *random_spans(text, base, enc, ratio)])


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span's characters replaced by a mark naming its kind; overlapping spans are one."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, vocabulary: str, ratio: float = RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of every whole text. One pass, no shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in batches:
            counts, digests, spans = ([], [], []), [], []
            for text in batch.column(1).to_pylist():
                base, every = find(text or "", enc, ratio)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(A.tidied(run), f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, vocabulary: str, ratio: float = RATIO, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span masked; the column of lengths, where there is one, follows the new text."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in batches:
            new = [None if t is None else masked(t, find(t, enc, ratio)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    out = docs.mapInArrow(A.tidied(run), docs.schema)
    if length_col in docs.columns:
        changed = F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col).cast(docs.schema[length_col].dataType))
        out = out.withColumn(length_col, changed)
    return out
