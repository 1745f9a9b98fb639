import numpy as np
import pytest

from llm_fixtures import frame, odd_rows
from mediamatch.llm import language

WORDS = {
    "en": "the of and that which house with water under stone thing nothing rather morning other".split(),
    "de": "der die und nicht werden schon haus wasser unter stein zwischen morgen straße auch".split(),
    "fr": "le la les dans maison eau sous pierre être avec matin beaucoup toujours quelque très".split(),
}


def sentence(lang, seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS[lang], n))


def corpus():
    return [(i, sentence(lang, i), lang, "s") for i, lang in enumerate(list(WORDS) * 30)]


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(frame(spark, corpus()))


def test_held_out_accuracy(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in language.identify(frame(spark, rows)).collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert held and all(got[d]["lang_pred"] == lang and 0.9 <= got[d]["score"] <= 1 for d, _, lang, _ in held)


def test_mixture_shares(spark, model):
    text = sentence("en", 1, 400) + " " + sentence("fr", 2, 200)
    got = language.predict(frame(spark, [(1, text, None, None)]), model).first()
    assert got["langs"] == ["en", "fr"] and 0.55 < got["shares"][0] < 0.75 and abs(sum(got["shares"]) - 1) < 1e-6


def test_expectation_maximisation_never_lowers_the_likelihood():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(50), 4).T
    counts = rng.integers(1, 9, 50).astype(float)
    values = [language.mixture(p, counts, k)[1] for k in range(8)]
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:]))


def test_selection_matches_a_search_over_nested_sets():
    rng = np.random.default_rng(2)
    for _ in range(30):
        p = rng.dirichlet(np.full(80, 0.3), 4).T + 1e-6
        true = rng.dirichlet([0.4] * 4)
        counts = rng.multinomial(4000, p @ true / (p @ true).sum()).astype(float)
        seen = counts > 0
        share = language.select_languages(p[seen], counts[seen])
        price = language.PENALTY * np.log(counts.sum()) * language.OVERLAP
        order = np.argsort(-language.mixture(p[seen], counts[seen])[0])
        values = [counts[seen] @ np.log(p[seen])[:, order]]
        best = max(values[0].max(), *(language.mixture(p[seen][:, order[:k]], counts[seen], 20)[1] - price * (k - 1) for k in (2, 3, 4)))
        own = share[share > 0]
        reached = counts[seen] @ np.log(p[seen][:, share > 0] @ own) - price * (len(own) - 1)
        assert reached >= best - 1e-6


def test_odd_rows_and_empty_tables(spark, model):
    rows = odd_rows()
    got = sorted(((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in language.predict(frame(spark, rows), model).collect()))
    assert len(got) == len(rows)
    by_id = {d: (lang, s) for d, lang, s in got}
    assert all(by_id[str(i)] == ("und", 0.0) for i in (0, 1, 2, 4))
    assert by_id["5"][0] in WORDS and by_id["7"][0] in WORDS
    assert language.identify(frame(spark, [])).collect() == []
    untrained = language.identify(frame(spark, [(1, "words here", None, None)])).first()
    assert (untrained["lang_pred"], untrained["score"]) == ("und", 0.0)


def test_keep_drops_only_rejected_rows(spark, model):
    rows = [*odd_rows(), *corpus()[:6]]
    docs = frame(spark, rows)
    kept = language.keep(docs, model, 0.5)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert not {None, "", " \t\n", "?!"} & set(texts) and {r[1] for r in corpus()[:6]} <= set(texts)
