import random
import re

import numpy as np
import pyarrow as pa

from harrow.llm import components as components_module
from harrow.llm import similarity_join as sj
from harrow.llm.components import components
from tests.llm import common

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)])


def links(rows):
    """{id: number of other rows that link}, by all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    out = {i: 0 for i, _ in rows}
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            n = len(a & b)
            if n and 100 * n >= 85 * len(a | b):
                out[i] += 1
                out[j] += 1
    return out


def brute(rows):
    """{id: (n, component)} by all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def family(seed=1):
    """Near copies at every distance, chains, a passage that many share, and short texts."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    base = [rnd.choice(words) for _ in range(120)]
    passage = " ".join(rnd.choice(words) for _ in range(30))
    rows, i = [], 0
    for k in range(60):
        w = list(base)
        for _ in range(k % 12):
            w[rnd.randrange(len(w))] = rnd.choice(words) + "x"
        rows.append((i := i + 1, " ".join(w)))
    chain = list(base[::-1])
    for k in range(20):
        chain = [*chain[3:], *(f"c{k}{j}" for j in range(3))]
        rows.append((i := i + 1, " ".join(chain)))
    for k in range(30):
        rows.append((i := i + 1, passage + " " + " ".join(rnd.choice(words) for _ in range(k))))
    for t in ("a b", "A  B", "b a", "a b c d", "a b c", None, ""):
        rows.append((i := i + 1, t))
    rnd.shuffle(rows)
    return rows


def test_all_links_of_a_family(spark, monkeypatch):
    monkeypatch.setattr(sj, "LEAST_LIMIT", 5)
    monkeypatch.setattr(sj, "BLOCK_SIZE", 4)
    monkeypatch.setattr(sj, "PANEL", 7)
    rows = family()
    out = sj.similarity_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).cache()
    assert got(out) == brute(rows)
    assert {r.doc_id: r.n_links for r in out.collect()} == links(rows)


def test_table(spark, sf):
    rows = list(common.texts(spark, sf).items())
    out = sj.similarity_components(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    assert got(out) == brute(rows)
    assert {r.doc_id: r.n_links for r in out.collect()} == links(rows)


def test_shared_counts(monkeypatch):
    rnd = random.Random(5)
    sets = [np.array(sorted(rnd.sample(range(60), rnd.randrange(30)))) for _ in range(40)]
    panels = [sj.Panel(sj.Panel.packed(list(range(len(x))), [1] * len(x), [0] * len(x), [0] * len(x), x)) for x in (sets[:25], sets[25:])]
    want = [[len(np.intersect1d(a, b)) for b in sets[25:]] for a in sets[:25]]
    for limit in (1, 40, 1 << 13):
        monkeypatch.setattr(sj, "DENSE", limit)
        assert sj.shared_counts(*panels).tolist() == want


def test_shards_grow_with_the_entries():
    assert [sj.shard_bits(n) for n in (0, 1 << 29, 1 << 32, 1 << 50)] == [8, 8, 11, 20]
    for split in (8, 12):
        assert 1 << split and sj.BITS - split > 3


def test_hard_rows_and_first(spark):
    docs = common.hard(spark)
    out = sj.similarity_components(docs).collect()
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in out)
    assert {r.doc_id: r.n_links for r in out} == {1: 0, 2: 0, 3: 0, 4: 2, 5: 2, 6: 1, 7: 1, 8: 0, 9: 0, 10: 0, 11: 0}
    want = brute([(i, t) for i, t, *_ in common.HARD])
    assert found == sorted((i, *want[i]) for i, *_ in common.HARD)
    kept = [r.doc_id for r in sj.keep_first(docs).collect()]
    assert sorted(kept) == sorted(i for i, *_ in common.HARD if want[i][1] == i)
    assert sj.keep_first(docs).columns == docs.columns


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id, r.n_links) for r in sj.similarity_components(docs).collect()), key=str) == sorted([(1, 1, 1), (2, 1, 1), (None, 1, None)], key=str)
    assert sj.similarity_components(common.empty(spark)).count() == 0


def test_a_row_without_id_does_not_take_the_sketch(spark):
    text = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(None, text), (1, text), (2, text + " more")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.component_id for r in sj.similarity_components(docs).collect()} == {None: 1, 1: 1, 2: 1}


def test_blocks_do_not_change_sets():
    column = pa.array([t for _, t in family()])
    whole = [list(map(int, x)) for _, sets in sj.shingle_sets(column, 4) for x in sets]
    single = [list(map(int, x)) for t in column for _, sets in sj.shingle_sets(pa.array([t.as_py()], pa.string()), 4) for x in sets]
    assert whole == single
    assert [len(x) for x in whole] == [len(shingles(t)) for _, t in family()]


def test_prefix_length():
    for n in range(1, 400):
        p = sj.prefix_length(n, 85)
        assert 1 <= p <= n and n - p == int(np.ceil(85 * n / 100)) - 1


def test_components_of_a_path(spark, monkeypatch):
    rows = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    links = spark.createDataFrame(rows, "a long, b long").repartition(5)
    for limit in (250_000, 6):  # in one task, and in rounds
        monkeypatch.setattr(components_module, "TASK_ROWS", limit)
        out = components(links, "a", "b").collect()
        assert len(out) == 43 and {r.node: r.root for r in out} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(links.limit(0), "a", "b").count() == 0


def test_smallest_of_any_links():
    rnd = random.Random(2)
    for n in (1, 5, 50, 300):
        links = [(rnd.randrange(200) - 50, rnd.randrange(200) - 50) for _ in range(n)]
        nodes, roots = components_module.smallest(*(np.array(x) for x in zip(*links, strict=True)))
        group = {i: {i} for link in links for i in link}
        for a, b in links:
            both = group[a] | group[b]
            for i in both:
                group[i] = both
        assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == {i: min(g) for i, g in group.items()}
