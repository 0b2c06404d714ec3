"""The learned filters: held-out accuracy, exact marginals, and rows of every kind."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.llm import labelled, quality, toxicity
from gridframe.llm.queries import op2_quality, op6_toxicity

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("query, label, least", [(op2_quality, "quality", 0.97), (op6_toxicity, "toxic", 0.94)])
def test_held_out_accuracy(spark, query, label, least):
    scored = query(spark, SF)
    judged = scored.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select(label, "predicted").collect()
    right = sum(r[label] == r["predicted"] for r in judged) / len(judged)
    assert right >= least
    assert scored.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_marginals_equal_plain_forward_backward():
    rng = np.random.default_rng(0)
    t = np.array([[1.4, -1.1], [-1.0, 0.8], [0.4, -0.4]])
    sizes = np.array([700, 0, 1, 1500])
    emit = rng.normal(-1, 3, sizes.sum())

    def plain(e):
        m, o = np.exp(t[:2]), np.stack([np.ones(len(e)), np.exp(e)], 1)
        a, b = np.zeros((len(e), 2)), np.ones((len(e), 2))
        for k in range(len(e)):
            v = (np.exp(t[2]) if k == 0 else a[k - 1] @ m) * o[k]
            a[k] = v / v.sum()
        for k in range(len(e) - 2, -1, -1):
            v = m @ (o[k + 1] * b[k + 1])
            b[k] = v / v.sum()
        g = a * b
        return g[:, 1] / g.sum(1)

    cuts = np.cumsum(sizes)[:-1]
    want = np.concatenate([plain(x) if len(x) else x for x in np.split(emit, cuts)])
    assert np.abs(toxicity.marginals(emit, sizes, t) - want).max() < 1e-8


def small(spark):
    rows = [(k, ("nasty word " if k % 2 else "kind word ") + f"number {k} of many others", "n") for k in range(80)]
    rows += [(200, None, "n"), (201, "", "n"), (None, "kind nasty", "n"), (3, rows[3][1], "n"), (202, "nasty " * 30000, "n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(80)] + [(5, 0, 0), (None, 1, 1), (6, None, None), (7, 9, 9), (999, 1, 1)], "doc_id bigint, quality int, toxic int")
    return docs, labels


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_rows_of_every_kind(spark, module, label):
    docs, labels = small(spark)
    model = module.train(docs, labels, label, F.lit(True))
    scored = module.score(docs, model)
    got = {}
    for r in scored.collect():
        assert got.setdefault(r["doc_id"], r["score"]) == r["score"]  # repeated rows agree
        assert 0 <= r["score"] <= 1
    assert scored.count() == 85 and got[200] == got[201]
    assert got[202] > 0.5 > got[4]
    keep = module.keep_good(docs, model, 0.5) if module is quality else module.keep_clean(docs, model, 0.5)
    assert keep.columns == docs.columns
    high = {k for k, v in got.items() if v >= 0.5}
    assert {r["doc_id"] for r in keep.collect()} == (high if module is quality else set(got) - high)
    assert module.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_without_labels_or_with_one_class(spark, module, label):
    docs, labels = small(spark)
    for few, share in ((labels.limit(0), 0.5), (labels.where("doc_id % 2 = 0 AND doc_id < 5"), 0.2)):
        model = module.train(docs, few, label, F.lit(True))
        assert all(abs(r["score"] - share) < 1e-6 for r in module.score(docs, model).collect())


def test_spans_are_the_offending_tokens(spark):
    docs, labels = small(spark)
    model = toxicity.train(docs, labels, "toxic", F.lit(True))
    rows = toxicity.score(docs.where("doc_id = 7"), model).collect()
    text = docs.where("doc_id = 7").collect()[0]["text"]
    assert [text[s["begin"] : s["end"]] for s in rows[0]["spans"]] == ["nasty"]


def test_sample_is_bounded_and_clean(spark):
    docs, labels = small(spark)
    sample, sizes = labelled.training_sample(docs, labels, "quality", F.lit(True), 10)
    assert sample.groupBy("label").count().orderBy("label").collect() == [(0, 10), (1, 10)]
    assert sizes == {0: 40, 1: 40}  # without the null, the odd value and the id with both labels, with the unknown document


def test_only_whole_copies_of_one_class_count_once():
    head = "a common header of five words"
    clean = [f"{head} plain{k} talk" for k in range(40)]
    toxic = [f"{head} vile{k} nasty" for k in range(40)]
    docs, y = [x.split() for x in clean + toxic], np.array([0] * 40 + [1] * 40)
    assert "wnasty" in toxicity.toxic_forms(docs, y)
    again = [docs[-1]] * 40 + docs[:40]
    assert not toxicity.toxic_forms(again, np.array([1] * 40 + [0] * 40))


def test_training_reads_to_the_end_of_a_text(monkeypatch):
    docs = [" ".join(["calm"] * 1000 + [word, f"n{k}"]) for word in ("kind", "nasty") for k in range(30)]
    y = np.repeat([0, 1], 30)
    model = toxicity.fit_model(docs, y, {0: 30, 1: 30})
    score = toxicity.Scorer(model).score(["a nasty one", "a kind one"])[0]
    assert score[0] > 0.5 > score[1]
    monkeypatch.setattr(toxicity, "SAMPLE_TOKENS", 10)
    assert toxicity.affordable(np.array([11, 6, 7, 4, 9]), np.array([0, 0, 0, 0, 1])).tolist() == [1, 4]


def test_labels_of_other_documents_take_no_place(spark):
    docs, labels = small(spark)
    some = docs.where("doc_id BETWEEN 60 AND 79")
    sample, _ = labelled.training_sample(some, labels, "quality", F.lit(True), 10)
    assert sample.groupBy("label").count().orderBy("label").collect() == [(0, 10), (1, 10)]
    known = labelled.labels_of(some, labels)
    assert labelled.training_sample(some, known, "quality", F.lit(True), 10)[1] == {0: 10, 1: 10}


def plain_loss(w, t, tokens, table, mask, gold, sizes, penalty):
    """Mean negative log-likelihood by the recursion over single tokens."""
    emit = (w[table] * mask).sum(1)[tokens]
    total, at = 0.0, 0
    for n in sizes:
        e, g = emit[at : at + n], gold[at : at + n]
        at += n
        if not n:
            continue
        a = t[2] + np.array([0, e[0]])
        own = t[2, g[0]] + g[0] * e[0]
        for k in range(1, n):
            a = np.logaddexp(a[0] + t[0], a[1] + t[1]) + np.array([0, e[k]])
            own += t[g[k - 1], g[k]] + g[k] * e[k]
        total += np.logaddexp(*a) - own
    return total / len(tokens) + penalty / 2 * ((w**2).sum() + (t**2).sum())


def test_the_fit_s_gradient_is_the_loss_s():
    rng = np.random.default_rng(4)
    sizes = np.array([40, 1, 0, 300, 17])
    tokens, gold = rng.integers(0, 12, sizes.sum()), rng.integers(0, 2, sizes.sum())
    table, mask = rng.integers(0, 9, (12, 3)), rng.integers(0, 2, (12, 3)).astype(float)
    w, t = rng.normal(size=9), rng.normal(size=(3, 2))
    gw, gt = toxicity.FieldGradient(tokens, table, mask, gold, sizes, 200, 0.01)(w, t)
    for x, g in ((w, gw), (t, gt)):
        for at in np.ndindex(x.shape):
            keep, h = x[at], 1e-5
            loss = []
            for step in (h, -h):
                x[at] = keep + step
                loss.append(plain_loss(w, t, tokens, table, mask, gold, sizes, 0.01))
            x[at] = keep
            assert abs((loss[0] - loss[1]) / (2 * h) - g[at]) < 1e-6


def test_lead_ins_are_exact_for_any_transitions():
    rng = np.random.default_rng(5)
    t = np.array([[4.0, -4.0], [-4.0, 4.0], [0.0, 0.0]])  # contraction 0.9993: longer lead-ins than the fit allows
    emit, sizes = 0.01 * rng.normal(size=60_000), np.array([60_000])
    whole = toxicity.marginals(emit[:3000], np.array([3000]), t)
    assert toxicity.burn_in(t) > 20_000
    assert np.abs(toxicity.marginals(emit, sizes, t)[:1000] - whole[:1000]).max() < 0.2  # far from the cut they agree
    f, p = 1.0, np.empty(60_000)
    m = np.exp(t[:2])
    back = np.ones(60_001)
    for k in range(59_999, 0, -1):
        z = np.exp(emit[k]) * back[k]
        back[k - 1] = (m[1, 0] + m[1, 1] * z) / (m[0, 0] + m[0, 1] * z)
    for k in range(60_000):
        f = np.exp(emit[k]) * (f if k == 0 else (m[0, 1] + m[1, 1] * f) / (m[0, 0] + m[1, 0] * f))
        p[k] = f * back[k]
    assert np.abs(toxicity.marginals(emit, sizes, t) - p / (1 + p)).max() < 1e-8


def test_fit_holds_the_spread():
    sizes = np.full(50, 40)
    gold = np.repeat(np.arange(50) % 2, 40)
    _, t = toxicity.fit_field(np.zeros(2000, int), np.array([[5, 7]]), np.ones((1, 2)), gold, sizes, steps=400)
    assert abs(toxicity.spread(t)) <= toxicity.MAX_SPREAD + 1e-9
    assert toxicity.burn_in(t) < 1000


def test_weak_forms_count_where_no_strong_ones_are():
    clean = [["talk", f"plain{k}"] + (["nasty"] if k % 12 == 0 else []) for k in range(120)]
    toxic = [["talk", f"{k:03d}x", "nasty"] for k in range(120)]
    assert "wnasty" in toxicity.toxic_forms(clean + toxic, np.array([0] * 120 + [1] * 120))


def test_two_word_texts_are_no_copies():
    docs = [f"kind n{k}" for k in range(100)] + [f"nasty n{k}" for k in range(100)]
    model = toxicity.fit_model(docs, np.repeat([0, 1], 100), {0: 100, 1: 100})
    score = toxicity.Scorer(model).score(["nasty one", "kind one"])[0]
    assert score[0] > 0.5 > score[1]


def test_dual_coordinate_descent_against_a_plain_solver():
    """Log-count ratios by hand, and the hinge-loss optimum by projected gradients on the dual."""
    rng = np.random.default_rng(6)
    rows = [np.unique(rng.integers(0, 40, rng.integers(3, 12))) for _ in range(60)]
    y = np.array([int(5 in r or rng.random() < 0.3) for r in rows])
    w, b = quality.fit_svm(rows, y, epochs=3000)
    x = np.zeros((60, 40))
    for k, r in enumerate(rows):
        x[k, r] = 1
    p, q = 1 + x[y == 1].sum(0), 1 + x[y == 0].sum(0)
    ratio = np.log(p / ((y == 1).sum() + 2)) - np.log(q / ((y == 0).sum() + 2))
    z = np.column_stack([x * ratio / np.sqrt(x.sum(1))[:, None], np.ones(60)]) * (2 * y - 1)[:, None]
    cost = np.where(y == 1, 60 / (2 * (y == 1).sum()), 60 / (2 * (y == 0).sum()))
    kernel, alpha = z @ z.T, np.zeros(60)
    for _ in range(50_000):
        alpha = np.clip(alpha + (1 - kernel @ alpha) / np.linalg.norm(kernel, 2), 0, cost)
    best = alpha @ z
    loss = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - z @ v)).sum()
    own = np.append(np.divide(w[:40], ratio, out=np.zeros(40), where=ratio != 0), b)
    assert loss(own) <= loss(best) * 1.001
    assert np.abs(own - best)[ratio.nonzero()[0]].max() < 0.02
