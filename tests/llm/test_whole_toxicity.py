"""Every text has neighbours, and label 1 is found in every language."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.toxicity import NEIGHBOURS, ToxicityModel, counts_of, fit_toxicity, score_toxicity
from tests.conftest import SF


def test_toxic_texts_are_found_in_every_language(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(F.broadcast(labels), "doc_id")
    found = score_toxicity(known, fit_toxicity(docs, labels)).join(known.select("doc_id", "lang", "toxic"), "doc_id").select("doc_id", "lang", "toxic", "score", F.size("neighbours").alias("n"), F.crc32(F.col("doc_id").cast("string")).alias("crc")).toPandas()
    assert (found.n > 0).mean() > 0.99
    held = found[(found.crc % 5 == 0) & (found.toxic == 1)]
    recall = (held.score >= 0.5).groupby(held.lang).mean()
    assert set(recall.index) == {"en", "de", "es", "fr"} and (recall > 0.8).all()


def test_texts_without_terms_of_label_1_have_neighbours():
    texts = ["awful word here"] * 30 + ["calm words there"] * 30
    model = ToxicityModel(list(range(60)), texts, np.array([1] * 30 + [0] * 30), (30, 30))
    p, near, cosines, terms = model.score("calm there")
    assert near and cosines[0] > 0.5 and p < 0.2 and not terms
    assert model.score("awful")[0] > 0.8 and model.score("unknown")[1] == []


def test_neighbours_are_those_of_the_plain_cosine_over_all_terms(spark):
    """Neighbours and scores against a dictionary of whole-document vectors, one pair of texts at a time."""
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}

    def plain(text):
        raw = {t: c * model.weights[model.terms[t]] for t, c in counts_of(text).items() if t in model.terms}
        norm = sum(w * w for w in raw.values()) ** 0.5
        return {t: w / norm for t, w in raw.items()} if norm else {}

    examples = [plain(texts[i]) for i in model.ids]
    found = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    assert len(found) == len(texts)
    for i in sorted(texts)[:: len(texts) // 150]:
        own = plain(texts[i])
        cosines = np.array([sum(w * e.get(t, 0.0) for t, w in own.items()) for e in examples])
        order = [a for a in np.lexsort((np.arange(len(examples)), -np.round(cosines, 12))) if cosines[a] > 1e-12][:NEIGHBOURS]
        assert found[i].neighbours == [model.ids[a] for a in order]
        assert np.allclose(found[i].cosines, cosines[order])
        want = float(np.interp(model.vote(np.array(order), cosines[order]), *model.knots)) if order else model.bare
        assert abs(found[i].score - want) < 1e-9


def test_calibration_is_not_from_own_votes():
    """Labels that no term foretells give scores near the share of label 1, though each example's own neighbours would tell."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(200)]
    labels = rng.integers(0, 2, 200)
    model = ToxicityModel(list(range(200)), list(texts), labels, (100, 100))
    assert len(model.ids) == 200
    scores = np.array([s[0] for s in model.score_many(texts)])
    assert (scores[labels == 1].mean() - scores[labels == 0].mean()) < 0.7
