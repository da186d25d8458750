"""The audit against applying the filters one after another, for every order."""

import itertools
import re
from collections import defaultdict

from harrow.llm import filter_audit as A
from harrow.session import written

from .common import HARD, empty, hard

NAMES = "ABCDE"


def brute(docs, labels):
    """docs: (id, text, lang); labels: (id, quality, toxic)."""
    good, toxic, flags = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}, []
    for i, text, lang in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text))]
        bad.append(i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs))
        flags.append((lang or "", {x for x, b in zip(NAMES, bad, strict=True) if b}, i is not None and i in good, i is not None and i in toxic))
    out, shapley = {}, defaultdict(int)
    for part in {f[0] for f in flags}:
        own = [f for f in flags if f[0] == part]
        for order in itertools.permutations(NAMES):
            alive, dead = own, []
            for step, x in enumerate(order, 1):
                gone = [f for f in alive if x in f[1]]
                redundant = sum(x in f[1] for f in dead)
                alive, dead = [f for f in alive if x not in f[1]], dead + gone
                out[part, "".join(order), step] = (x, len(alive), len(gone), redundant, sum(f[1] == {x} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone))
                shapley[part, x] += len(gone)
    return {k: (*v[1:], shapley[k[0], v[0]]) for k, v in out.items()}


def held(frame):
    rows = [tuple(r) for r in frame.collect()]
    found = {r[:3]: r[3:] for r in rows}
    assert len(found) == len(rows)
    return found


LABELS = [(1, 1, 0), (4, 0, 1), (5, 1, None), (5, 0, 1), (6, None, 1), (99, 1, 1), (None, 1, 1), (10, 1, 1)]
LABEL_SCHEMA = "doc_id long, quality int, toxic int"


def test_hard_rows_equal_brute_force(spark):
    extra = [(None, "one", None), (None, None, "en"), (12, "One Two " * 60, "en"), (13, "One Two " * 60, None), (12, "One Two " * 60, "en"), (14, None, None), (0, "one", "")]
    docs = [(i, t, lang) for i, t, lang, _ in HARD] + extra
    frame = hard(spark).select("doc_id", "text", "lang", *[c for c in hard(spark).columns if c not in ("doc_id", "text", "lang")]).unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"), allowMissingColumns=True)
    frame = frame.withColumnsRenamed({"g": "part", "key": "good", "token": "E"})
    assert held(A.filter_audit(frame, spark.createDataFrame(LABELS, LABEL_SCHEMA))) == brute(docs, LABELS)


def test_empty(spark):
    assert A.filter_audit(empty(spark), spark.createDataFrame([], LABEL_SCHEMA)).collect() == []


def test_whole_table(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = held(A.filter_audit(docs, labels))
    assert got == brute([(r.doc_id, r.text, r.lang) for r in docs.collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_own_filters(spark):
    """The audit is not bound to five filters or to their names."""
    flags = spark.createDataFrame([("x", True, False, False, False), ("x", True, True, True, False), ("y", False, True, False, True)], "part string, p boolean, q boolean, good boolean, toxic boolean")
    got = held(A.audit(written(flags, "flags"), ("p", "q")))
    assert got["x", "pq", 1] == (0, 2, 0, 1, 1, 0, 3) and got["x", "pq", 2] == (0, 0, 1, 0, 0, 0, 1) and got["x", "qp", 2] == (0, 1, 1, 1, 0, 0, 3) and got["y", "pq", 2] == (0, 1, 0, 1, 0, 1, 2)
    assert len(got) == 8
