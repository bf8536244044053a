"""Trained operators: held-out accuracy, exact search, and edge cases."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np

from tessera.llm import queries as Q
from tessera.llm.language import PENALTY, Identifier, NgramModels, fit_languages, identify_languages, language_set, proportions, words_of
from tessera.llm.quality_rules_model import STATISTICS, fit_quality, fit_rules, score_quality
from tessera.llm.toxicity import BlockMaxIndex, fit_toxicity, isotonic, score_toxicity
from tests.conftest import SF

BIG = SF.replace("sf0.001", "sf0.01")
ODD = [(1, None), (2, ""), (3, "12 34 !!"), (4, "x" * 200_000), (5, "the of and " * 20_000), (None, "the"), (7, "the"), (7, "the")]


def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0.5, "z") for i, t in ODD], "doc_id long, text string, lang string, source string, score double, __text2 string")


def test_language_of_held_out_texts(spark):
    found = Q.op6_language_id(spark, BIG).toPandas()
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang").toPandas()
    both = found.merge(docs, on="doc_id")
    held = both[both.held_out]
    assert len(found) == len(docs) and (held.lang_pred == held.lang).mean() > 0.98 and found.score.between(0, 1).all()
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()


def test_language_edge_cases(spark):
    models = NgramModels({"en": ["the cat and the dog"], "fr": ["le chat et le chien"]})
    found = {(r.doc_id, r.lang_pred) for r in identify_languages(odd(spark), models).collect()}
    assert found == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "en"), (None, "en"), (7, "en")} or (4, "fr") in found
    assert identify_languages(odd(spark).where("false"), models).count() == 0
    none = fit_languages(odd(spark).where("false"))
    assert {r.lang_pred for r in identify_languages(odd(spark), none).collect()} == {"und"}


def test_mixtures_of_two_languages(spark):
    models = NgramModels({"aa": ["abab baba abba " * 30], "bb": ["cdcd dcdc cddc " * 30]})
    text = "abab baba abba abab baba cdcd dcdc cddc cdcd dcdc cddc abab"
    r = identify_languages(spark.createDataFrame([(1, text)], "doc_id long, text string"), models).first()
    assert set(r.languages) == {"aa", "bb"} and abs(r.shares[0] - 0.5) < 0.1
    one = np.array([[1.0, 1e-6]] * 30)
    assert language_set(one, proportions(one)) == [0]


def test_numerals_that_are_no_letters_are_undetermined():
    scorer = Identifier(NgramModels({"en": ["the cat and the dog"], "fr": ["le chat et le chien"]}))
    assert scorer.score("\u00bd \u00b2 \u2167 \u2460 12")[0] == "und"
    assert words_of("Cat\u00b2dog \u2167") == ["cat", "dog"]


def test_prediction_is_that_of_the_best_penalised_set_by_plain_search():
    """EM and the stepwise set against a search of all pairs of languages and a fine grid of proportions."""
    models = NgramModels({"aa": ["abab baba abba bab " * 30], "bb": ["cdcd dcdc cddc dcd " * 30], "cc": ["efef fefe effe fef " * 30]})
    scorer, rng = Identifier(models), random.Random(5)
    for share in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0):
        words = [rng.choice(["abab", "baba", "abba", "bab"] if rng.random() < share else ["cdcd", "dcdc", "cddc", "dcd"]) for _ in range(60)]
        logs = np.array([models.table[models.numbers(w)].sum(axis=0) for w in words])
        found = []
        for a, b in [(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)]:
            mixes = np.linspace(0, 1, 401)[1:-1] if a != b else [1.0]
            for x in mixes:
                fit = np.logaddexp(logs[:, a] + np.log(x), logs[:, b] + np.log1p(-x)).sum() if a != b else logs[:, a].sum()
                found.append((fit - (a != b) * (PENALTY + np.log(len(words))), {a: x, b: 1 - x} if a != b else {a: 1.0}))
        want = max(found, key=lambda f: f[0])[1]
        name, score, names, shares = scorer.score(" ".join(words))
        assert {models.languages[k] for k in want} == set(names)
        assert name == models.languages[max(want, key=want.get)] and abs(score - max(want.values())) < 0.01 and abs(sum(shares) - 1) < 1e-6


def test_quality_of_held_out_texts(spark):
    found = Q.op10_quality(spark, BIG).toPandas().merge(spark.read.parquet(f"{BIG}/labels.parquet").toPandas(), on="doc_id")
    held = found[found.held_out]
    assert (held.predicted == held.quality).mean() > 0.93
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()


def test_compiled_rules_score_as_the_model_does(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(800, len(STATISTICS)))
    model = fit_rules(x, ((x[:, 2] > 0.5) & (x[:, 4] < 0.6)).astype(float), STATISTICS)
    assert 0 < len(model.rules) < 200 and (((model.score(x) > 0.5) == ((x[:, 2] > 0.5) & (x[:, 4] < 0.6))).mean()) > 0.97
    rows = spark.createDataFrame(x.tolist(), STATISTICS)
    assert np.allclose([r[0] for r in rows.select(model.column()).collect()], model.score(x))


def test_quality_scores_equal_a_plain_reading_of_rules_and_texts(spark):
    """The query's scores against statistics counted in Python and rules applied one by one."""
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels)
    found = {r.doc_id: r.score for r in Q.op10_quality(spark, BIG).collect()}

    def count(text, characters):
        return sum(c in characters for c in text)

    for r in docs.collect():
        t = r.text or ""
        words, lines = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", t) if w], [x for x in t.split("\n") if x.strip(" ")]
        share = lambda part, whole: part / whole if whole else 0.0
        spaces = count(t, " \t\n\x0b\x0c\r")
        own = [len(t), len(words), share(len(t) - spaces, len(words)), share(count(t, "#*$%&|<>"), len(t)), share(sum("A" <= c <= "Z" for c in t), len(t)), share(count(t, "0123456789"), len(t)), share(count(t, ".,;:!?"), len(t)), share(len(set(words)), len(words)), share(len(lines), len(words)), share(len(lines) - len(set(lines)), len(lines)), share(len(t.encode()) - len(t), len(t))]
        at = model.bias + sum(w for rule, w in model.rules if all((own[k] > bound) == above for k, above, bound in rule.terms))
        assert abs(found[r.doc_id] - 1 / (1 + np.exp(-at))) < 1e-9


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("quality = 1"), labels.where("false")):
        found = score_quality(odd(spark), fit_quality(odd(spark), known)).collect()
        assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    assert score_quality(odd(spark).where("false"), fit_quality(odd(spark), labels)).count() == 0


def test_toxicity_of_held_out_texts(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    found = Q.op4_toxicity(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = found[found.held_out]
    assert (held.predicted == held.toxic).mean() > 0.97
    assert held[held.toxic == 0].predicted.mean() < 0.01


def test_block_max_search_is_exact():
    rng = random.Random(4)
    vectors = []
    for _ in range(700):
        terms = rng.sample(range(60), rng.randrange(1, 9))
        w = np.array([rng.random() + 0.01 for _ in terms])
        vectors.append(dict(zip(terms, (w / np.linalg.norm(w)).tolist(), strict=True)))
    index = BlockMaxIndex(vectors, block=16)
    for q in vectors[:80]:
        near, cosine = index.search(q, 7)
        want = np.array([sum(w * v.get(t, 0.0) for t, w in q.items()) for v in vectors])
        order = [d for d in np.lexsort((np.arange(700), -np.round(want, 12))) if want[d] > 1e-12][:7]
        assert near.tolist() == order and np.allclose(cosine, want[order])
    assert index.search({999: 1.0}, 3)[0].size == 0


def test_isotonic_is_monotone_and_calibrated():
    x, y = np.array([0.1, 0.2, 0.2, 0.4, 0.8, 0.9]), np.array([0, 1, 0, 0, 1, 1.0])
    knots, values = isotonic(x, y, np.ones(6))
    assert (np.diff(values) >= 0).all() and np.isclose(np.interp(0.3, knots, values), 1 / 3) and values[-1] == 1


def test_toxicity_edge_cases(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("toxic = 1"), labels.where("false")):
        found = score_toxicity(odd(spark), fit_toxicity(odd(spark), known)).collect()
        assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    assert score_toxicity(odd(spark).where("false"), fit_toxicity(odd(spark), labels)).count() == 0
