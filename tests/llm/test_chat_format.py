import random

from harrow.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string, n long"


def log():
    """Growing snapshots, equal conversations, forks, gaps and long ones."""
    rnd = random.Random(3)
    out, i = [], 0
    for c in range(12):
        turns = [("user" if k % 2 == 0 else "assistant", f"t{c % 5} {k}") for k in range(rnd.choice((1, 2, 3, 90, 200)))]
        for n in {1, len(turns) // 2, len(turns)} - {0}:
            out += [(i, k, r, t, 0) for k, (r, t) in enumerate(turns[:n])]
            i += 1
    out += [(i, 0, "user", "t0 0", 0), (i, 1, "assistant", "other", 0)]
    out += [(900, 5, None, None, 0), (900, 7, "user", "a<|im_end|>b", 0), (900, 7, "user", "a<|im_end|>b", 0), (None, 0, "user", "orphan", 0)]
    rnd.shuffle(out)
    return out


def brute(rows):
    convs = {}
    for c, turn, role, text, _ in set(rows):
        convs.setdefault(c, []).append((turn, role or "", text or ""))
    seqs = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    kept = {}
    for c, s in sorted(seqs.items(), key=lambda x: (x[0] is not None, x[0] or 0)):
        if any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values()) or s in kept.values():
            continue
        kept[c] = s

    def safe(x):
        return x.replace("<|im_start|>", "<| im_start|>").replace("<|im_end|>", "<| im_end|>")

    return {c: "".join(f"<|im_start|>{safe(r)}\n{safe(t)}<|im_end|>\n" for r, t in s) for c, s in kept.items()}


def rendered(df):
    parts = {}
    for r in df.collect():
        parts.setdefault(r.conv_id, []).append((r.part, r.text))
    return {c: "".join(t for _, t in sorted(p)) for c, p in parts.items()}


def test_maximal_conversations_are_rendered(spark):
    df = spark.createDataFrame(log(), SCHEMA).repartition(3)
    want = brute(log())
    assert rendered(cf.render(df)) == want
    assert rendered(cf.render(df, segment=3)) == want


def test_only_built_in_operations(spark):
    plan = cf.render(spark.createDataFrame(log(), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_copies_and_empty_table(spark):
    rows = [(c, k, "user", f"x{k}", 0) for c in (3, 1, 2) for k in range(2)]
    out = cf.render(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.conv_id, r.n_turns, r.n_copies) for r in out] == [(1, 2, 3)]
    assert cf.render(spark.createDataFrame([], SCHEMA)).count() == 0


def test_turns_without_a_number_and_tied_ones(spark):
    rows = [(1, None, "user", f"n{k}", 0) for k in range(40)] + [(1, -300, "user", "low", 0), (1, 2, "user", "a", 0), (1, 2, "user", "b", 0), (1, 3, "user", "end", 0)]
    rows += [(2, None, "user", f"n{k}", 0) for k in range(40)] + [(2, -300, "user", "low", 0), (2, 2, "user", "b", 0), (2, 2, "user", "a", 0)]
    first = rendered(cf.render(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert rendered(cf.render(spark.createDataFrame(rows[::-1], SCHEMA).coalesce(1), segment=1)) == first
    assert list(first) == [1]  # the second is a prefix of the first
    texts = [x.split("\n")[1].removesuffix("<|im_end|>") for x in first[1].split("<|im_start|>")[1:]]
    assert sorted(texts[:40]) == sorted(f"n{k}" for k in range(40)) and texts[40] == "low" and sorted(texts[41:43]) == ["a", "b"] and texts[43:] == ["end"]


def test_a_conversation_of_usual_length_is_one_row(spark):
    rows = [(1, k, "user", f"x{k}", 0) for k in range(256)]
    out = cf.render(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.part, r.n_turns, r.text.count("<|im_start|>")) for r in out] == [(0, 256, 256)]
