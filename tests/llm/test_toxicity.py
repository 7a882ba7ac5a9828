"""The bound of the logistic regression bounds neither the lexicon nor the label model."""

import numpy as np

from quire.llm import byteops as B
from quire.llm import toxicity
from tests.llm.test_operators import prose


def form(word):
    data = word.encode()
    return next(toxicity.forms(np.frombuffer(data, np.uint8), np.array([0, len(data)])))[2][0]


def test_lexicon_from_all_labelled_texts(spark, monkeypatch):
    rows = []
    for i in range(600):
        own, toxic = prose(1000 + i, 40), i % 5 == 0
        word = "zorblat" if i % 75 == 0 else "grumble"
        rows.append((i, f"{own} {word} {word} {word}" if toxic else own, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    seen = []
    model_of = toxicity.label_model

    def spy(v, *args, **more):
        seen.append((v, *args))
        return model_of(v, *args, **more)

    monkeypatch.setattr(toxicity, "FIT_ROWS", 40)
    monkeypatch.setattr(toxicity, "label_model", spy)
    # Every seventh text has no label.
    model = toxicity.learn(docs.drop("toxic"), docs.where("doc_id % 7 <> 1").select("doc_id", "toxic"))
    assert form("zorblat") in model["forms"] and form("grumble") in model["forms"]
    (v, count, known), = seen
    training = docs.where(~toxicity.held_out(1, 3))
    assert count.sum() == training.count()
    assert count[~known].sum() == training.where("doc_id % 7 = 1").count() > 0
    assert v.shape[1] == toxicity.GROUPS + len(toxicity.PATTERNS) + 1


def test_label_model_counts_and_abstentions():
    rng = np.random.default_rng(1)
    y = rng.random(3000) < 0.2
    v = np.stack([np.where(rng.random(3000) < a, y, rng.random(3000) < 0.05) for a in (0.95, 0.9, 0.85)] + [y], axis=1).astype(float)
    known = rng.random(3000) < 0.5
    rows, where, count = np.unique(np.column_stack((v * np.column_stack((np.ones((3000, 3)), known)), known)), axis=0, return_inverse=True, return_counts=True)
    whole, rates = toxicity.label_model(v, known=known)
    few, same = toxicity.label_model(rows[:, :-1], count, rows[:, -1] > 0)
    assert np.allclose(few[where], whole, atol=1e-4) and np.allclose(rates, same, atol=1e-4)
    assert ((whole > 0.5) == y).mean() > 0.97


def naive_posterior(votes, model):
    """Bayes, vote by vote, from the label model's prior and rates."""
    out = []
    for row in votes:
        p = [1 - model["prior"], model["prior"]]
        for c in (0, 1):
            for j, x in enumerate(row):
                parent = model["parent"][j]
                rate = model["given"][c, int(row[parent]) if parent >= 0 else 0, j]
                p[c] *= rate if x else 1 - rate
        out.append(p[1] / (p[0] + p[1]))
    return out


def test_posterior_by_brute_force_and_correlations():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.2
    free = [np.where(rng.random(4000) < a, y, rng.random(4000) < 0.05) for a in (0.9, 0.85, 0.8)]
    # A voter that mostly repeats the first one, whatever the class.
    copy = np.where(rng.random(4000) < 0.95, free[0], rng.random(4000) < 0.5)
    v = np.stack([*free, copy, y], axis=1).astype(float)
    model = toxicity.generative(v, rounds=100)
    assert np.allclose(naive_posterior(v[:300], model), model["posterior"][:300], atol=1e-4)
    assert {(0, int(model["parent"][3])), (3, int(model["parent"][0]))} & {(0, 0), (3, 3)} and model["parent"][4] == -1
    # The copy's rate follows its parent in both classes, and without the tree it would not.
    child = 3 if model["parent"][3] == 0 else 0
    assert all(model["given"][c, 1, child] > model["given"][c, 0, child] + 0.5 for c in (0, 1))
    assert ((model["posterior"] > 0.5) == y).mean() > 0.97


def naive_forms(text):
    """Words of letters in lower case and their beginnings, as bytes with the length of a beginning."""
    import re

    out = []
    for w in re.findall(r"[a-z]+", text.lower()):
        out.append((w.encode(), 0))
        out += [(w.encode()[:k], k) for k in toxicity.STEMS if len(w) > k]
    return out


def test_lexicon_and_scores_by_brute_force(spark):
    rows = []
    for i in range(300):
        own, toxic = prose(7000 + i, 30 + i % 40).split(), i % 4 == 0
        if toxic:
            own[3:3] = ["GRUMBLE!!", "snarling", "grumbled"][: 1 + i % 3]
        rows.append((i, " ".join(own), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(docs.drop("toxic"), docs.select("doc_id", "toxic"))

    def hashed(f):
        word, k = f
        return int(form(word.decode()) ^ np.uint64(0)) if k == 0 else int(B.span_hash(B._BYTE_CODE[np.frombuffer(word, np.uint8)], np.array([0]), np.array([k]))[0] ^ np.uint64(k))

    from zlib import crc32

    counts = {}
    train = [(t, y) for i, t, y in rows if crc32(str(i).encode()) % 3 != 1]
    for t, y in train:
        for f in set(naive_forms(t)):
            counts.setdefault(f, [0, 0])[y] += 1
    pos, neg = sum(y for _, y in train), sum(1 - y for _, y in train)
    rate = {f: np.log((p + 0.5) / (pos + 1)) - np.log((n + 0.5) / (neg + 1)) for f, (n, p) in counts.items()}
    want = {hashed(f) for f, (n, p) in counts.items() if p >= max(3, pos // 400) and rate[f] > 2.5}
    assert {int(x) for x in model["forms"]} == want and len(want) < toxicity.LEXICON
    place = {int(h): k for k, h in enumerate(model["forms"])}
    for r in toxicity.predict(docs, model).collect():
        words = [w for w in "".join(c if c.isalpha() else " " for c in r.text).split()]
        letters, capitals, marks = sum(c.isalpha() for c in r.text), sum(c.isupper() for c in r.text), r.text.count("!")
        found = [place[h] for h in map(hashed, naive_forms(r.text)) if h in place]
        hits = sum(any(hashed(f) in place for f in naive_forms(w)) for w in words)
        x = np.zeros(len(place) + len(toxicity.PATTERNS))
        for k in set(found):
            x[k] = min(1.0, 100.0 * found.count(k) / len(words))
        x[len(place) :] = [100 * capitals > 30 * letters, marks * 50 > letters, *(1000 * hits > s * len(words) for s in toxicity.SHARES)]
        score = 1 / (1 + np.exp(-(x @ model["weights"][:-1] + model["weights"][-1])))
        assert abs(r.toxic_score - score) < 1e-9 and r.toxic_predicted == int(r.toxic_score >= toxicity.THRESHOLD)


def shuffled(spark):
    """Bytes that tasks have shuffled so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30000)
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_texts_stay_where_they_are_also_without_broadcast_joins(spark, monkeypatch):
    rows = []
    for i in range(900):
        own, toxic = prose(20_000 + i, 400), i % 15 == 0
        # Of the other texts, more than the sampled ones have "murky": only the whole count tells that it is no toxic form.
        word = "grumble" if toxic else "murky" if i % 3 else ""
        rows.append((i, f"{own} {word}" + (" murky" if toxic and i % 2 else ""), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    kept = docs.drop("toxic").repartition(4).localCheckpoint()
    labels = docs.where("doc_id % 2 = 1 or toxic = 1").select("doc_id", "toxic")
    models = []
    for threshold, part in (("10m", 1), ("-1", 16), ("-1", 1 << 30)):
        monkeypatch.setattr(toxicity, "PART", part)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            before = shuffled(spark)
            models.append(toxicity.learn(kept, labels))
            moved = shuffled(spark) - before
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        if part == 16:
            assert moved < sum(len(t) for _, t, _ in rows) / 4
    assert form("grumble") in models[0]["forms"] and form("murky") not in models[0]["forms"]
    assert all(np.array_equal(m["forms"], models[0]["forms"]) and np.array_equal(m["weights"], models[0]["weights"]) for m in models)


def test_lexicon_counts_the_rest_whole(spark, monkeypatch):
    # No text that is not toxic is counted early: forms of toxic texts pass then, and the rest decides.
    monkeypatch.setattr(toxicity, "PART", 1 << 30)
    rows = [(i, prose(30_000 + i, 20) + (" murky grumble" if i % 4 == 0 else " murky" if i % 2 else ""), int(i % 4 == 0)) for i in range(400)]
    rows += [(i, rows[i][1], rows[i][2]) for i in (0, 3, 4)] + [(8, None, 1), (5, None, 0), (None, "grumble", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.where("doc_id is not null").groupBy("doc_id").max("toxic").toDF("doc_id", "toxic")
    model = toxicity.learn(docs.drop("toxic"), labels)
    assert form("grumble") in model["forms"] and form("murky") not in model["forms"]
