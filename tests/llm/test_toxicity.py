import random

import pytest
from pyspark.sql import functions as F

from dnsflow.llm import toxicity as t

LEXICON = t.Lexicon({"fool": 4.0}, {"rott": 3.0})


def written(clause):
    return [s for s, _ in t.grammar(LEXICON).run(clause.split()) if "insult" in s or "threat" in s]


def test_grammar_marks_scopes():
    assert written("you are a fool") == ["insult+aimed"]
    assert written("fool") == ["insult"]
    assert written("you are not a fool") == ["insult+negated+aimed"]
    assert written("not one of all those many fool") == ["insult+aimed"]
    assert written("he said you rotten fool") == ["insult+reported+aimed"] * 2
    assert written("we will hurt you") == ["threat"] and written("you i hurt") == ["threat+aimed"]


def test_weights_multiply_and_states_do_not_leak():
    machine = t.grammar(LEXICON)
    assert [w for s, w in machine.run(["rotting", "fool"])] == [3.0, 4.0]
    assert machine.run(["not"])[0][0] == "negation" and machine.run(["fool"])[0][0] == "insult"


def test_features_of_clauses():
    score = t.Scorer(LEXICON)
    plain, negated = score.features("Fool. All else is calm."), score.features("You are not a fool. All else is calm.")
    assert plain[0] > 0 == plain[1] and negated[1] > 0 == negated[0]
    assert score.features("befool foolproof") == [0.0] * len(t.FEATURES) or score.features("befool")[0] == 0
    assert score.features(None) == score.features("") == score.features("!?") == [0.0] * len(t.FEATURES)
    assert score.features("fool. " * 50_000)[5] == pytest.approx(10.8, abs=0.1)


def corpus(n=400, seed=1, label=True):
    draw = random.Random(seed)
    common = [f"word{i}" for i in range(150)]
    docs, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        words = [draw.choice(common) for _ in range(60)]
        if bad:
            for _ in range(4):
                words[draw.randrange(60)] = draw.choice(["nasty", "vermin", f"zork{draw.choice('abcdefgh')}{draw.randrange(99)}"])
        docs.append((i, " ".join(words), "clash"))
        labels.append((i, 1, int(bad) if label else 0))
    return docs, labels


def frames(spark, docs, labels):
    return (spark.createDataFrame(docs, "doc_id long, text string, features string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_learns_words_and_beginnings(spark):
    docs, labels = frames(spark, *corpus())
    model = t.learn(docs, labels)
    assert {"nasty", "vermin"} <= {*model.lexicon.words} and "zork" in model.lexicon.beginnings
    rows = t.score(docs, model).collect()
    assert sum(r["_predicted"] != (r["doc_id"] % 6 == 0) for r in rows if r["_held_out"]) <= 2
    assert any(r["_held_out"] for r in rows) and all(0 <= r["_score"] <= 1 and r["features"] == "clash" for r in rows)
    fresh = spark.createDataFrame([(1, "such a NASTY vermin zorkx12 here"), (2, "word1 word2"), (3, None)], "doc_id long, text string")
    assert [r["_predicted"] for r in t.score(fresh, model).orderBy("doc_id").collect()] == [1, 0, 0]


def test_held_out_labels_are_never_read(spark):
    docs, labels = corpus()
    out = {r[0] for r in spark.range(len(docs)).where(t.held_out(F.col("id"))).collect()}
    flipped = [(i, q, 1 - y if i in out else y) for i, q, y in labels]
    one, two = (t.learn(*frames(spark, docs, ls)) for ls in (labels, flipped))
    assert one == two


def test_copies_of_one_text_teach_nothing(spark):
    docs, labels = corpus(label=False)
    docs += [(1000 + i, "unique gibberish blorp frnak " * 3, "") for i in range(60)]
    labels += [(1000 + i, 0, 1) for i in range(60)]
    model = t.learn(*frames(spark, docs, labels))
    assert not model.lexicon.words and not model.lexicon.beginnings


def test_degenerate_labels(spark):
    docs, labels = corpus(40)
    for some in ([], [(1, 1, 0), (2, 1, 0)], [(None, 1, 1), (3, 1, None), (2, 1, 1)], [(i, 1, y) for i, _, y in labels] * 2):
        d, ls = frames(spark, docs + [(None, None, "")], some)
        rows = t.score(d, t.learn(d, ls)).collect()
        assert len(rows) == 41 and all(r["_score"] is not None and r["_held_out"] is not None for r in rows)
    empty, _ = frames(spark, [], [])
    assert t.score(empty, t.learn(empty, ls)).count() == 0


def test_score_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, "a text", "mine", 3)], "doc_id long, text string, _features string, extra int")
    row = t.score(docs, t.Model(t.Lexicon(), tuple(t.DEFAULTS.tolist()))).first()
    assert (row["_features"], row["extra"]) == ("mine", 3) and 0 <= row["_score"] <= 1
