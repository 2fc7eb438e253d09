import math

import pytest

from dnsflow.llm import mixing

DOCS = "doc_id long, source string, text string, size string"


def water(sizes, weights, share, most):
    """Targets by the definition: give by weight, clamp, share again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s] + 1e-9}
        if not over:
            target.update({s: left * weight[s] / total for s in free})
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def docs_of(spark, counts):
    rows, i = [], 0
    for source, sizes in counts.items():
        for n in sizes:
            rows.append((i, source, " \n".join(["w"] * n), "clash"))
            i += 1
    return spark.createDataFrame(rows, DOCS)


COUNTS = {"b": [100, 20, 3], "a": [5, 5], "c": [400] * 5 + [0], None: [7, 1], "d": [1000]}


@pytest.mark.parametrize("share, most", [(1.0, 3.0), (0.2, 3.0), (1.0, 1.2)])
def test_targets_and_taken_words(spark, share, most):
    docs = docs_of(spark, COUNTS)
    want = water({s: sum(n) for s, n in COUNTS.items()}, (5, 2, 1), share, most)
    marked = mixing.taken(mixing.plan(docs, share=share, most=most), docs)
    got = {}
    for r in marked.collect():
        words = r["_whole"] * r["_size"] + r["_part"]
        assert 0 <= words <= math.ceil(most) * r["_size"]
        assert r["_target"] == pytest.approx(want[r["source"]])
        got[r["source"]] = got.get(r["source"], 0) + words
    for source, target in want.items():     # whole documents: to half of the one at the cut
        assert abs(round(target) - got[source]) <= max(COUNTS[source]) / 2


def test_mix_repeats_whole_documents(spark):
    docs = docs_of(spark, COUNTS)
    rows = mixing.mix(docs).collect()
    assert len(rows) > docs.count() / 3 and rows[0].asDict().keys() == {"doc_id", "source", "text", "size"}
    want = water({s: sum(n) for s, n in COUNTS.items()}, (5, 2, 1), 1.0, 3.0)
    for source, target in want.items():
        assert abs(sum(len(r["text"].split()) for r in rows if r["source"] == source) - round(target)) <= max(COUNTS[source]) / 2
    whole = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert {(r["doc_id"], r["text"]) for r in rows} <= whole
    assert rows_of(mixing.mix(docs)) == rows_of(mixing.mix(docs))


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_nulls_ties_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a", None, "")] * 2 + [(1, "a", "x y z", "")] * 3 + [(2, None, "", "")], DOCS)
    got = mixing.taken(mixing.plan(docs, share=0.5), docs).collect()
    assert len(got) == 6 and all(r["_whole"] * r["_size"] + r["_part"] in (0, 1, 3) for r in got)
    empty = docs.limit(0)
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, "a", "", "")], DOCS)).count() <= 1


def test_rows_without_id_are_told_apart_by_their_texts(spark):
    docs = spark.createDataFrame([(None, "a", f"w{i} " * 10, "") for i in range(40)] + [(9, "b", "x " * 400, "")], DOCS)
    marked = mixing.taken(mixing.plan(docs, share=0.3), docs).where("source = 'a'").collect()
    assert abs(sum(r["_whole"] * r["_size"] + r["_part"] for r in marked) - marked[0]["_target"]) <= 5 and {r["_part"] for r in marked} == {0, 10}


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", "x y", "s", 7, 8)], "doc_id long, source string, text string, _size string, _whole int, _copy int")
    assert [tuple(r) for r in mixing.mix(docs).collect()] == [(1, "a", "x y", "s", 7, 8)]
