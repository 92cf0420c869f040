import pytest
from guardloom.llm.mixing import mix, plan_mix


def targets_by_hand(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2):
    """Share by weight, stop at the caps, share the excess again, until nobody is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, capped, left = dict.fromkeys(names, 0.0), set(), share * sum(sizes.values())
    while left > 1e-9 and len(capped) < len(names):
        open_ = [s for s in names if s not in capped]
        total = sum(weight[s] for s in open_)
        give = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in open_:
            target[s] += give[s]
            if target[s] > most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                capped.add(s)
    return target


def words(n):
    return " \n".join(f"w{i}" for i in range(n))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, size string")


@pytest.fixture
def table(spark):
    rows = [(i, words(1 + i * 7 % 23), "abc"[i % 3] if i % 5 else "b", 0, "clash") for i in range(120)]
    rows += [(200, None, "a", 0, "x"), (201, "", "d", 0, "x"), (202, words(5), None, 0, "x"), (None, words(4), "a", 0, "x")]
    rows += [(3, words(22), "a", 0, "clash")] * 3 + [(300, words(400), "tiny", 0, None)]
    return docs(spark, rows), rows


def test_targets_and_budgets(table):
    frame, rows = table
    got = plan_mix(frame, range_rows=8).collect()
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = targets_by_hand(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
    for s in sizes:
        taken = sum(r["taken"] for r in got if r["source"] == s)
        assert taken == int(want[s] + 1e-6)


def test_reruns_and_range_sizes_agree(table):
    frame, _ = table
    key = lambda d: sorted(map(str, d.select("doc_id", "source", "size", "taken").collect()))
    assert key(plan_mix(frame)) == key(plan_mix(frame.repartition(5), range_rows=3))


def test_mixed_rows_hold_the_words_taken(table):
    frame, _ = table
    mixed = mix(frame)
    assert mixed.columns == frame.columns
    taken = {}
    for r in plan_mix(frame).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    got = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
    assert got == {k: v for k, v in taken.items() if v}


def test_empty_table(spark):
    frame = docs(spark, [])
    assert plan_mix(frame).count() == 0 and mix(frame).count() == 0


def test_only_empty_texts(spark):
    got = plan_mix(docs(spark, [(1, None, "a", 0, None), (2, "  ", None, 0, None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2
