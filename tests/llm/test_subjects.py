import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltworks.llm.subjects import Plan, _blocks, assign, count_vectors, document_words, fit, words

TOPICS = {"sport": "goalkeeper stadium referee penalty marathon sprint".split(), "food": "oven dough recipe spice bakery cheese".split(), "law": "plaintiff verdict statute bailiff tenancy notary".split()}
CHAT = "build cache commit branch deploy header socket worker queue bucket".split()
SMALL = Plan(topics=8, anchor_share=0.02)


def letters(p, n):
    return [p + a + b for a in "abcdefgh" for b in "klmnopqr"][:n]


def corpus(n=1500):
    rnd = random.Random(4)
    docs, truth = [], {}
    for i in range(n):
        held = rnd.sample(sorted(TOPICS), rnd.choice([0, 1, 1, 1, 2]))
        ws = [rnd.choice(CHAT) for _ in range(40)] + [rnd.choice(TOPICS[s]) for s in held for _ in range(4)]
        rnd.shuffle(ws)
        remark = f". We once told a newcomer that it resembles some {rnd.choice(TOPICS['law'])}." if i % 4 == 0 else "."
        docs.append((i, " ".join(ws) + remark))
        truth[i] = set(held) or {"software"}
    return docs, truth


def subjects_of(rows):
    got: dict = {}
    for r in rows:
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    return got


def test_topics_find_held_out_subjects(spark):
    docs, truth = corpus()
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, s) for i in range(0, 300) for s in truth[i]], "doc_id bigint, subject string")
    model, counted = fit(document_words(df), labels, SMALL)
    got = subjects_of(assign(model, counted).collect())
    assert set(got) == set(truth)
    rest = range(300, len(docs))
    right = sum(len(got[i] & truth[i]) for i in rest)
    assert right / sum(len(got[i]) for i in rest) > 0.9 and right / sum(len(truth[i]) for i in rest) > 0.9
    remarked = [i for i in rest if i % 4 == 0 and "law" not in truth[i]]  # told by proportion, whatever the phrase
    assert sum("law" in got[i] for i in remarked) < 0.05 * len(remarked)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "zzz"), (3, "zzz")], "doc_id bigint, text string")
    counted = count_vectors(document_words(odd), model.vocabulary)
    assert sorted(tuple(r) for r in assign(model, counted).collect()) == [(1, "software"), (2, "software"), (3, "software"), (3, "software")]


def test_topics_reach_words_that_no_labelled_document_holds(spark):
    """The ablation: a lexicon of the labelled documents' words can't find these documents, topics do."""
    rnd = random.Random(2)
    own = {"sport": letters("go", 40), "food": letters("ov", 40), "software": CHAT * 4}
    docs, truth = [], {}
    for i in range(1200):
        s = ["sport", "food", "software"][i % 3]
        pool = own[s][:20] if i < 90 else own[s][20:] if i % 2 else own[s]
        docs.append((i, " ".join(rnd.sample(CHAT, 8) + rnd.sample(pool, 6))))
        truth[i] = s
    labels = spark.createDataFrame([(i, truth[i]) for i in range(90)], "doc_id bigint, subject string")
    model, counted = fit(document_words(spark.createDataFrame(docs, "doc_id bigint, text string")), labels, SMALL)
    got = subjects_of(assign(model, counted).collect())
    unseen = [i for i in range(90, 1200) if i % 2 and truth[i] != "software"]
    lexicon = {w for i in range(90) if truth[i] != "software" for w in docs[i][1].split()} - set(CHAT)
    assert not any(lexicon & set(docs[i][1].split()) for i in unseen)
    assert sum(got[i] == {truth[i]} for i in unseen) > 0.9 * len(unseen)


def test_words():
    assert words("The  Oven at src/a.py:3 IS hot. L'énergie; well_known x2 Käse, heat-pump") == ["the", "oven", "hot", "énergie", "käse", "heat", "pump"]
    assert words(None) == words("") == []


@pytest.mark.parametrize("n", [333, 20_000])
def test_a_pass_reads_every_document_once_at_any_size(n):
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(0, 9, n)
    sizes[5] = 30_000
    terms = [list(range(k)) for k in sizes]
    whole = pa.RecordBatch.from_arrays([pa.array(terms, pa.list_(pa.int32())), pa.array(terms, pa.list_(pa.int32()))], names=["terms", "counts"])
    for batch in (whole, whole.slice(3, n - 7)):  # a batch may begin within its buffers
        seen = []
        for row, begin, t, c in _blocks(batch, 0, 1):
            assert len(row) == len(begin) and len(t) == len(c) and (t == c).all()
            seen += list(zip(row.tolist(), np.diff(np.r_[begin, len(t)]).tolist(), strict=True))
        assert seen == [(i, k) for i, k in enumerate(map(len, batch.column(0).to_pylist())) if k]


def test_a_subject_of_a_third_of_the_documents_keeps_its_words(spark):
    rnd = random.Random(8)
    own = {"sport": letters("goal", 12), **{s: letters(s[:3], 40) for s in ("food", "law", "music")}}
    docs, truth = [], {}
    for i in range(1500):
        s = "sport" if i % 3 == 0 else rnd.choice(["food", "law", "music", "software", "software"])
        docs.append((i, " ".join(rnd.sample(CHAT, 8) + rnd.sample(own.get(s, CHAT), 4))))
        truth[i] = s
    docs += [(1500 + i, docs[3][1]) for i in range(500)]  # copies
    df = document_words(spark.createDataFrame(docs, "doc_id bigint, text string"))
    labels = spark.createDataFrame([(i, truth[i]) for i in range(300)] + [(None, "law"), (4, None), (9999, "law")], "doc_id bigint, subject string")
    model, counted = fit(df, labels, Plan(topics=8))
    assert set(own["sport"]) <= set(model.vocabulary) and not set(CHAT) & set(model.vocabulary)
    got = {r["doc_id"] for r in assign(model, counted).where("subject = 'sport'").collect()}
    wanted = {i for i in range(300, 1500) if truth[i] == "sport"} | set(range(1500, 2000))
    assert len(got & wanted) > 0.9 * len(wanted) and len([i for i in got if i >= 300 and i not in wanted]) < 0.1 * len(wanted)


def test_without_documents_or_labels(spark):
    none, docs = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(i, "oven dough " * 9) for i in range(5)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, "food")], "doc_id bigint, subject string")
    assert assign(*fit(document_words(none), labels, SMALL)).count() == 0
    assert assign(*fit(document_words(docs), labels.where(F.lit(False)), SMALL)).where("subject = 'software'").count() == 5
