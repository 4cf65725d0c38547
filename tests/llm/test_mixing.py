import warnings

import numpy as np
import pytest

from evalgrid.llm import mixing as M
from evalgrid.llm.common import read_table
from evalgrid.llm.queries import MIX_WEIGHTS, label_domains


def test_expected_totals_meet_targets(spark):
    sf = "/root/testdata/sf0.01"
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    labels = label_domains(read_table(spark, sf, "labels"))
    rows = M.mix(docs, labels, {"plain": 0.6, "low": 0.3, "toxic": 0.1}).collect()
    total = sum(r.tokens for r in rows)
    domains = ["low", "plain", "toxic"]
    for k, share in zip(range(3), (0.3, 0.6, 0.1)):
        assert domains[k] and abs(sum(r.tokens * r.rate * r.posterior[k] for r in rows) - share * total) < 0.02 * total
    assert all(r.rate >= 0 and abs(sum(r.posterior) - 1) < 1e-9 and r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)


def test_keep_and_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    labels = read_table(spark, sf, "labels")
    rows = M.mix(docs, label_domains(labels), MIX_WEIGHTS, keep="plain").join(labels, "doc_id").where("quality = 1 and toxic = 0").collect()
    assert sum(r.copies == 0 for r in rows) <= 0.02 * len(rows)


def test_classifier(spark):
    sf = "/root/testdata/sf0.1"
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    labels = label_domains(read_table(spark, sf, "labels"))
    model = M.fit_classifier(docs, labels).cache()
    names = model.select("domains").first()[0]
    rows = M.posteriors(docs.join(labels.where("domain in ('low', 'plain')"), "doc_id"), model).select("domain", "posterior").collect()
    hit = {d: [names[max(range(len(names)), key=lambda k: r.posterior[k])] == d for r in rows if r.domain == d] for d in ("low", "plain")}
    assert sum(hit["plain"]) >= 0.9 * len(hit["plain"]) and sum(hit["low"]) >= 0.5 * len(hit["low"])


def test_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    none = spark.createDataFrame([], "doc_id long, domain string")
    rows = M.mix(docs, none, {"plain": 1.0}).collect()
    assert len(rows) == len(odd_rows) and all(r.copies == 1 for r in rows if r.tokens == 0)
    some = spark.createDataFrame([(901, "a"), (904, "b"), (None, "a")], "doc_id long, domain string")
    assert M.mix(docs, some, {"a": 0.5, "b": 0.5}).count() == len(odd_rows)
    assert M.mix(make_docs([]), some, {"a": 0.5, "b": 0.5}).count() == 0
    with pytest.raises(ValueError):
        M.mix(docs, some, {"c": 1.0})


def test_copies_meet_targets(spark):
    """Rates close to a whole number, and a domain that is wanted at a tenth of its size or less, also in what is used."""
    rows = [(i, ("alpha beta gamma delta " if i % 2 else "uno dos tres cuatro ") * 5) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "b" if i % 2 else "a") for i in range(400)], "doc_id long, domain string")
    for weights, total in (({"a": 0.5, "b": 0.5}, 80000 * 1.08), ({"a": 0.5, "b": 0.5}, 80000 * 0.92), ({"a": 0.96, "b": 0.04}, 80000)):
        out = M.mix(docs, labels, weights, total_tokens=float(total)).collect()
        for k, d in enumerate(("a", "b")):
            used = sum(r.copies * r.tokens * r.posterior[k] for r in out)
            assert abs(used - weights[d] * total) < 0.02 * total and used > 0.5 * weights[d] * total


def test_unmet_targets_are_told(spark):
    scored = spark.createDataFrame([(10, [1.0, 0.0])], "tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="off their targets"):
        M.fit_rates(scored, [5.0, 5.0], steps=3)


def plain_steps(tokens, posterior, targets, size, steps):
    r = np.ones(len(tokens))
    for _ in range(steps):
        r = np.maximum(0, r - posterior @ (((tokens * r) @ posterior - targets) / size))
    return ((((tokens * r) @ posterior - targets) ** 2) / size).sum()


@pytest.mark.parametrize("sharp,share", [(False, [0.6, 0.3, 0.1]), (True, [0.6, 0.3, 0.1]), (False, [0.0, 0.08, 0.92])])
def test_fit_reaches_the_targets(spark, sharp, share):
    """Targets that rates can meet are met; for others (soft posteriors, a domain wanted at 0) the fit is told to be off
    and is at least as near as plain projected steps on dense arrays."""
    rnd = np.random.default_rng(sharp)
    posterior = rnd.dirichlet([0.3, 0.5, 0.2] if sharp else [4, 5, 3], 300)
    tokens = rnd.integers(1, 2000, 300).astype(float)
    targets, size = np.array(share) * tokens.sum(), tokens @ posterior
    scored = spark.createDataFrame([(int(t), p.tolist()) for t, p in zip(tokens, posterior)], "tokens long, posterior array<double>").coalesce(1)
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        moves = M.fit_rates(scored, targets.tolist(), steps=12)
    r = np.ones(300)
    for m in moves:
        r = np.maximum(0, r - posterior @ np.array(m))
    got = (tokens * r) @ posterior
    met = np.abs(got - targets).sum() <= 1e-3 * targets.sum()
    assert met == (share[0] > 0) and met == (not [w for w in told if "off their targets" in str(w.message)])
    assert ((got - targets) ** 2 / size).sum() <= 1.0001 * plain_steps(tokens, posterior, targets, size, len(moves))
