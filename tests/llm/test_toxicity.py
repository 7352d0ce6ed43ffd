import numpy as np
import pytest

from spanloom.llm.toxic_seeds import BENIGN, TOXIC, seed_sentences
from spanloom.llm.toxicity import Chain, Tagger, _fit, _seed_sample, fit_tagger, labelled_sample, passages_of, plain, rates_by_source, score_documents, seed_chain
from tests.llm.held_out import HARMFUL, HARMLESS


@pytest.fixture(scope="module")
def tagger():
    return fit_tagger([])


def best(tagger, text):
    return max((p for _, _, p in tagger.tag([text])[0]), default=0.0)


@pytest.mark.parametrize(
    "written, meant",
    [("$tup1d", "stupid"), ("idiotttt", "idiot"), ("pa_thetic", "pathetic"), ("vеrmіn", "vermin"), ("mo​ron", "moron"), ("IDIOT", "idiot"), ("v3rm1n", "vermin"), ("CRB7", "crb7"), ("3.5", "3.5")],
)
def test_disguises(written, meant):
    assert plain(written) == meant


@pytest.mark.parametrize(
    "text",
    ["You are a disgusting idiot.", "SHUT UP, YOU STUPID MORON!", "Shut up, you s****d cow!", "You c r e t i n!", "All Dravians are filthy vermin.", "Send me nudes tonight.", "Halt die Fresse, du Idiot!", "Заткнись, тупой дурак!", "你这个白痴，闭嘴！"],
)
def test_found(tagger, text):
    assert best(tagger, text) >= 0.5


@pytest.mark.parametrize(
    "text",
    ["Fever rose in 12 patients.", "I felt like an idiot for forgetting my tablets.", "My cough is killing me this week.", "Nurses had been called stupid or worthless by visitors.", "Rats were given 5 mg.", "Sexual function did not differ.", "", "  "],
)
def test_not_found(tagger, text):
    assert best(tagger, text) < 0.5


def test_offsets(tagger):
    text = "The dose was 3 mg. Shut up, you stupid idiot! The fever fell."
    words = [text[a:b] for a, b, p in tagger.tag([text])[0] if p >= 0.5]
    assert "idiot" in words and "dose" not in words and "fever" not in words


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    chain = Chain(np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2))
    lengths = np.array([1, 3, 4])
    unary = rng.normal(size=lengths.sum())
    got, pairs, starts = chain.marginals(unary, lengths)
    want, at, moves = np.zeros(len(unary)), 0, np.zeros((2, 2))
    for size in lengths:
        total = 0.0
        for number in range(2**size):
            tags = [number >> i & 1 for i in range(size)]
            score = chain.start[tags[0]] + sum(unary[at + i] for i in range(size) if tags[i]) + sum(chain.moves[a, b] for a, b in zip(tags, tags[1:]))
            total += np.exp(score)
            want[at : at + size] += np.exp(score) * np.array(tags)
        for a, b in ((a, b) for a in (0, 1) for b in (0, 1)):
            for number in range(2**size):
                tags = [number >> i & 1 for i in range(size)]
                score = chain.start[tags[0]] + sum(unary[at + i] for i in range(size) if tags[i]) + sum(chain.moves[x, y] for x, y in zip(tags, tags[1:]))
                moves[a, b] += np.exp(score) / total * sum((x, y) == (a, b) for x, y in zip(tags, tags[1:]))
        want[at : at + size] /= total
        at += size
    assert np.allclose(got, want) and np.allclose(pairs, moves) and starts.sum() == pytest.approx(len(lengths))


def test_held_out_sentences(tagger):
    """Of sentences by patterns that no seed has, in eleven languages, nine in ten of the harmful ones are found and three in four found are harmful."""
    found = sum(best(tagger, s) >= 0.5 for s in HARMFUL)
    wrong = sum(best(tagger, s) >= 0.5 for s in HARMLESS)
    assert found / len(HARMFUL) >= 0.9 and found / (found + wrong) >= 0.7


def test_held_out_patterns():
    """Fitted on two thirds of the patterns, most passages by the others are found, and words found lie mostly in passages (measured: 0.74 of
    passages, 0.44 of their words, 0.89 of words found)."""
    part = lambda table, kept: {lang: "|".join(p for i, p in enumerate(lines.replace("\n", "|").split("|")) if (i % 3 != 0) == kept) for lang, lines in table.items()}
    fitted = Tagger(Chain(np.zeros(1 << 18, np.float32), np.zeros((2, 2)), np.zeros(2)))
    sample = _seed_sample(fitted, seed_sentences(toxic=part(TOXIC, True), benign=part(BENIGN, True)))
    other = Tagger(_fit(sample, sample.ids(), 40))
    fresh = seed_sentences(repeats=4, background=200, seed=8, toxic=part(TOXIC, False), benign=part(BENIGN, False))
    inside, _ = other.probabilities([s for s, _, _ in fresh])
    gold = _seed_sample(other, fresh).gold
    hit = ((inside >= 0.5) & (gold > 0)).sum()
    tagged = other.tag([s for s, b, e in fresh if e > b])
    passages = np.mean([any(p >= 0.5 for _, _, p in words) for words in tagged])
    assert passages >= 0.65 and hit / (gold > 0).sum() >= 0.4 and hit / (inside >= 0.5).sum() >= 0.8
    assert sum(s in {x for x, _, _ in seed_sentences(toxic=part(TOXIC, True))} for s, b, e in fresh if e > b) == 0


def test_passages_inside_a_sentence(tagger):
    """Words around a passage in its own sentence are out of it, which the fitted transitions and not the sentence decide."""
    text = "The parcel with the inhaler came on Tuesday, you filthy lying pig, and the clinic closes at five."
    (passage,) = passages_of(tagger.tag([text])[0], 0.5)
    own = text[passage["begin_pos"] : passage["end_pos"]]
    assert "filthy lying pig" in own and "inhaler" not in own and "clinic" not in own
    moves = seed_chain().moves
    assert moves[1, 1] - moves[1, 0] > 0.3 and moves[0, 0] - moves[0, 1] > 0.3 and not np.allclose(moves, [[1, -1], [-1, 1]], atol=0.2)


def test_sentences_left_out_have_no_passage(tagger):
    """The first step loses nothing: with all sentences run through the chain the same texts are found."""
    texts = HARMFUL + HARMLESS + ["Fever fell in 12 patients. " * 40]
    slow = Tagger(Chain(tagger.chain.weights, tagger.chain.moves, tagger.chain.start, -1.0))
    assert [best(slow, t) >= 0.5 for t in texts] == [best(tagger, t) >= 0.5 for t in texts]


def test_chain_is_saved(spark, tagger, tmp_path):
    tagger.chain.save(f"{tmp_path}/chain.npz")
    chain = Chain.load(f"file://{tmp_path}/chain.npz")
    assert np.array_equal(chain.weights, tagger.chain.weights) and chain.least == tagger.chain.least
    docs = spark.createDataFrame([(1, "You are a stupid idiot.", "f"), (2, "zq" * 1_500_000, "f"), (3, "you are fine " * 30_000, "f")], "doc_id long, text string, source string")
    got = {r.doc_id: r.score >= 0.5 for r in score_documents(docs, chain=chain).collect()}
    assert got[1] and not got[2]


def test_documents_scored(spark):
    docs = spark.createDataFrame(
        [(1, "You are a stupid idiot.", "f", "c"), (2, "Fever fell.", "f", "c"), (3, None, None, "c"), (4, "", "g", "c"), (5, "Fever fell. " * 3_000, "g", "c"), (1, "You are a stupid idiot.", "f", "c")],
        "doc_id long, text string, source string, score string",
    )
    labels = spark.createDataFrame([(1, "r", "abusive"), (1, "s", None), (2, "r", "none"), (2, "s", "hateful"), (9, "r", "none"), (None, "r", "none")], "doc_id long, rater string, label string")
    assert labelled_sample(docs, labels) == [("You are a stupid idiot.", True)] * 2
    scored = score_documents(docs, labels)
    got = [(r.doc_id, r.score >= 0.5, len(r.passages)) for r in scored.collect()]
    assert sorted(got) == [(1, True, 1), (1, True, 1), (2, False, 0), (3, False, 0), (4, False, 0), (5, False, 0)]
    rates = {r.source: (r.n_documents, r.n_found, r.rate) for r in rates_by_source(scored).collect()}
    assert rates == {"f": (3, 2, 2 / 3), "g": (2, 0, 0.0), None: (1, 0, 0.0)}
    assert score_documents(docs.limit(0), labels.limit(0)).count() == 0
