"""Quality rules: base counts, and repetition found with suffix arrays.

For every text a suffix array over its words is built by prefix doubling (all texts of a block at once; a suffix
ends where its text ends), with the longest common prefixes of neighbouring suffixes. Each interval of the prefix
array is a string that occurs at its suffixes and no longer one does at all of them; where the words before them differ
as well, it is a maximal repeat. The spans of the maximal repeats of ``min_repeat`` words or more are united; a text is
rejected when they cover more than ``max_covered`` per cent of its word characters or one is longer than ``max_repeat``
words. A tenth of the characters in repeats of 10 words is the limit that published corpora use; the base bounds repeats
of 3 words by half, so a text can pass it and be rejected here. Words longer than 64 bytes count as one symbol per 16 bytes, so that unspaced text repeats within words as well.

A block of texts (about 1 MB, or one longer text) holds some 50 bytes a word, and 4 more for each doubling, of which
there are about log2 of the longest repeat's words: a text that repeats itself throughout costs the most.

Defined results: a null text is an empty text: no words, so its base fails; repeated rows repeat; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from harrow.llm import arrays as A
from harrow.session import ship

MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 10, 10, 40  # words, per cent of word characters, words
SYMBOLS = A.table_of(*((ord(c), ord(c)) for c in "#*$%&|<>"))
SPACE = " \t\n\x0b\x0c\r"


def suffix_array(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in suffix order (rows one after another), and each one's common prefix with the one before it, in words."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        key = A.splitmix(h + A.splitmix(row.astype(A.U)))
    sa = np.lexsort((key, row))
    new = np.concatenate([[True], (key[sa][1:] != key[sa][:-1]) | (row[sa][1:] != row[sa][:-1])])
    rank = np.empty(n, dtype=np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, width = [rank], 1
    while True:
        head = np.flatnonzero(new)
        sizes = np.diff(np.concatenate([head, [n]]))
        open_ = np.repeat(sizes > 1, sizes)  # suffixes whose first ``width`` words are not theirs alone
        place = np.flatnonzero(open_)
        if not len(place):
            break
        at = sa[place]
        after = at + width
        inside = np.minimum(after, n - 1)
        follow = np.where((after < n) & (row[inside] == row[at]), rank[inside], -1)
        group = rank[at]
        order = np.lexsort((follow, group))
        sa[place] = at[order]
        group, follow = group[order], follow[order]
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])])
        new[place] = fresh
        rank = rank.copy()
        rank[sa[place]] = np.maximum.accumulate(np.where(fresh, place, 0))
        levels.append(rank)
        width *= 2
    i, j, common = sa[:-1].copy(), sa[1:].copy(), np.zeros(n, dtype=np.int64)
    live = np.flatnonzero(levels[0][i] == levels[0][j])
    i, j, got = i[live], j[live], np.zeros(len(live), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + got, j + got
        ok = (a < n) & (b < n)
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        got += np.where(ok & (levels[k][a] == levels[k][b]), 1 << k, 0)
    common[live + 1] = got
    return sa, common


def maximal_spans(sa: np.ndarray, common: np.ndarray, h: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the spans of the maximal repeats of ``least`` or more words, whose union is that of all repeats.

    A suffix gives the span of the deepest interval that it lies in; a shorter repeat at the same place is part of it.
    An interval whose suffixes all follow the same word is no maximal repeat: the one that starts a word earlier covers it.
    """
    deep = common >= least
    if not deep.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(deep & ~np.concatenate([[False], deep[:-1]]))
    last = np.flatnonzero(deep & ~np.concatenate([deep[1:], [False]]))
    starts: list[int] = []
    lengths: list[int] = []
    none, many = -1, -2  # no suffix yet; different words before the suffixes
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        places = sa[a - 1 : b + 1]
        ahead = np.where((places > 0) & (row[places - 1] == row[places]), places - 1, -1)
        before = np.where(ahead >= 0, (h[ahead] >> A.U(1)).astype(np.int64), many).tolist()
        depth, stack, so_far = [*common[a : b + 1].tolist(), 0], [], 0
        for place, word, depth_after in zip(places.tolist(), before, depth, strict=True):
            if depth_after > so_far:
                stack.append([depth_after, none, []])
            top = stack[-1]
            top[2].append(place)
            top[1] = word if top[1] in (none, word) else many
            while stack and stack[-1][0] > depth_after:
                length, word, own = stack.pop()
                if word == many:
                    starts += own
                    lengths += [length] * len(own)
                if stack and stack[-1][0] >= depth_after:
                    stack[-1][1] = word if stack[-1][1] in (none, word) else many
                elif depth_after:
                    stack.append([depth_after, word, []])
            so_far = depth_after
    return np.array(starts, dtype=np.int64), np.array(lengths, dtype=np.int64)


def longest_from(sa: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For every position, the length of the longest repeat that starts there."""
    out = np.zeros(len(sa), dtype=np.int64)
    if len(sa):
        out[sa] = np.maximum(common, np.concatenate([common[1:], [0]]))
    return out


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of ``n`` positions lie in the union of the spans."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return run[offs[1:]] - run[offs[:-1]]


def symbols_of(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and word of the symbols that the suffix array compares: words, long ones in pieces."""
    size = np.where(e - s > 64, -(-(e - s) // 16), 1)
    if size.max(initial=1) == 1:
        return s, e, np.arange(len(s))
    word = np.repeat(np.arange(len(s)), size)
    k = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    a = s[word] + 16 * k * (size[word] > 1)
    return a, np.where(size[word] > 1, np.minimum(a + 16, e[word]), e[word]), word


def measure(column: pa.Array, least: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """All counts of every text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_chars, longest_repeat (0 below ``least``)."""
    data, offs = A.buffers(column)
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "covered_chars", "longest_repeat", "n_dup_lines")}
    for lo, hi in A.blocks(offs):
        part, own = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        s, e, row = A.words(part, own, A.SPACED)
        ends = np.searchsorted(row, np.arange(hi - lo + 1))
        chars = A.char_index(part)
        size = chars[e] - chars[s]
        h = A.word_hashes(part, s, e)
        sa, common = suffix_array(h, row)
        three = np.flatnonzero(longest_from(sa, common) >= 3)
        again = covered(len(s), three, np.full(len(three), 3))
        a, b, word = symbols_of(s, e)
        srow = row
        if len(a) != len(s):
            h, srow = A.word_hashes(part, a, b), row[word]
            sa, common = suffix_array(h, srow)
        starts, lengths = maximal_spans(sa, common, h, srow, least)
        over = covered(len(a), starts, lengths)
        longest = np.zeros(hi - lo, dtype=np.int64)
        np.maximum.at(longest, srow[starts], lengths)
        out["n_words"].append(np.diff(ends))
        out["word_chars"].append(sums(size, ends))
        out["n_symbols"].append(sums(SYMBOLS[part], own))
        out["n_repeat_words"].append(sums(again, ends))
        out["covered_chars"].append(sums((chars[b] - chars[a]) * over, np.searchsorted(srow, np.arange(hi - lo + 1))))
        out["longest_repeat"].append(longest)
    for text in column.to_pylist():
        lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
        out["n_dup_lines"].append([len(lines) - len(set(lines))])
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def quality_rules(
    docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: int = MAX_COVERED, max_repeat: int = MAX_REPEAT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, covered_chars, longest_repeat). One pass, no shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = measure(batch.column(1), min_repeat)
            failed = (x["n_words"] < 50) | (100 * x["n_repeat_words"] > 50 * x["n_words"])
            kept = ~failed & (100 * x["covered_chars"] <= max_covered * x["word_chars"]) & (x["longest_repeat"] <= max_repeat)
            counts = [pa.array(x[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(failed), pa.array(kept), pa.array(x["covered_chars"], pa.int64()), pa.array(x["longest_repeat"], pa.int64())],
                names=[id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_chars", "longest_repeat"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        A.tidied(run), f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_chars long, longest_repeat long"
    )


_WORDS = r"'[^\x20\x09-\x0D]+'"
#: The rows of ``quality_rules`` without longest_repeat, in DuckDB. Symbols are compared as hexadecimal bytes.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, {_WORDS}) AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORDS})) AS l FROM d),
y AS (SELECT doc_id, flatten(list_transform(w, lambda x: CASE WHEN strlen(x) <= 64 THEN [{{'h': hex(x), 'c': length(x)}}]
  ELSE list_transform(range(0, (strlen(x) + 15) // 16), lambda k: {{'h': substr(hex(x), 32 * k + 1, 32),
    'c': len(list_filter(range(0, 16), lambda j: substr(hex(x), 32 * k + 2 * j + 1, 1) NOT IN ('', '8', '9', 'A', 'B')))}}) END)) AS y FROM w),
p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 2], ' ')) AS n FROM p) WHERE n > 1),
three AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS k FROM again) GROUP BY doc_id),
q AS (SELECT doc_id, unnest(range(1, len(y) - {MIN_REPEAT - 2})) AS i, y FROM y WHERE len(y) >= {MIN_REPEAT}),
long AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(list_transform(y[i:i + {MIN_REPEAT - 1}], lambda z: z.h), ' ')) AS n FROM q) WHERE n > 1),
over AS (SELECT doc_id, sum(y[k].c) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {MIN_REPEAT})) AS k FROM long) JOIN y USING (doc_id) GROUP BY doc_id),
r AS (SELECT doc_id, unnest(range(1, len(y) - {MAX_REPEAT - 1})) AS i, y FROM y WHERE len(y) > {MAX_REPEAT} AND doc_id IN (SELECT doc_id FROM long)),
longest AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, array_to_string(list_transform(y[i:i + {MAX_REPEAT}], lambda z: z.h), ' ') AS g FROM r) GROUP BY doc_id, g HAVING count(*) > 1),
x AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(three.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(over.n, 0) AS BIGINT) AS covered_chars, longest.doc_id IS NOT NULL AS far
  FROM w LEFT JOIN three USING (doc_id) LEFT JOIN over USING (doc_id) LEFT JOIN longest USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * covered_chars <= {MAX_COVERED} * word_chars AND NOT far AS kept, covered_chars
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x)
"""
