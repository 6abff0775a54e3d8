"""The block-max index finds the exact neighbours; wordings left out and disguises are told apart."""

import random
from collections import defaultdict

import numpy as np
import pytest

from suitelens.llm.toxic.examples import HARMFUL, HARMLESS, expanded, labelled
from suitelens.llm.toxic.features import TAG, TERMS, Terms, Vocabulary, _bucket, _numbered, _own_numbers, cleaned, sentence_text
from suitelens.llm.toxic.nearest import FLOOR, Index, Vectors, _merged, calibrated, document_frequencies, harm_scores, idf

WEIGHTS = np.where(np.arange(TERMS) < TAG, 1.0, 2.0)


@pytest.fixture(scope="module")
def index():
    return Index(*labelled(), WEIGHTS)


def vectors(texts: list[str]) -> Vectors:
    made = Terms(texts, Vocabulary())
    made.sentence, made.sentences = made.document[made.sentence], len(texts)
    return Vectors(_merged(made), WEIGHTS)


def votes(index: Index, texts: list[str]) -> np.ndarray:
    return index.votes(*index.neighbours(vectors(texts), len(texts)))


def test_neighbours_are_those_of_brute_force(index):
    r = random.Random(3)
    known = [i for i, t in enumerate(index.texts) if t]
    queries = []
    for i in r.sample(known, 80):
        words = index.texts[i].split()
        r.shuffle(words)
        queries.append(" ".join(words[: max(3, len(words) - 2)]))
    dense = np.zeros((len(index.texts), TERMS), np.float32)
    dense[index.vectors.of, index.vectors.term] = index.vectors.weight
    q = vectors(queries)
    scores, places = index.neighbours(q, len(queries))
    for i in range(len(queries)):
        mine = q.of == i
        cosines = dense[:, q.term[mine]] @ q.weight[mine]
        want = np.sort(cosines[cosines >= FLOOR])[::-1][:6]
        if (cosines[index.labels > 0] >= FLOOR).any():
            assert np.allclose(scores[i][places[i] >= 0], want, atol=1e-5)
        elif (places[i] >= 0).any():
            assert np.allclose(scores[i][places[i] >= 0], want, atol=1e-5)


def test_left_out_wordings(index):
    """Each template judged by an index made of all others, at the limit of the queries, told apart by label."""
    slope, offset = calibrated(index)
    r, right = random.Random(5), defaultdict(list)
    for label, templates in ((1, HARMFUL), (0, HARMLESS)):
        for t in r.sample(templates, 60):
            made = expanded(t, 8)
            v = votes(Index(*labelled(without=t), WEIGHTS), made)
            right[label].append(float(((slope * v + offset >= 0) == bool(label)).mean()))
    assert np.mean(right[1]) > 0.85
    assert np.mean(right[0]) > 0.85


def test_single_sentences(index):
    slope, offset = calibrated(index)
    harmful = ["The intern is a pathetic cretin.", "I'll snap your wrists", "Refugees are maggots, all of them", "go hang yourself", "Zeig mir deinen Busen, Süße", "Te voy a partir el cráneo", "Les immigrés sont des parasites", "你就是个废物"]
    harmless = ["Kill the orphan worker before the build", "I am such a fool, I deleted the branch", "Refugees and old people use this page", "The parser rejects the null field", "Danke, toll gemacht", "El proceso hijo murió", "Le test échoue", "先杀死子进程"]
    assert (slope * votes(index, harmful) + offset >= 0).all()
    assert not (slope * votes(index, harmless) + offset >= 0).any()


@pytest.mark.parametrize("text", ["you 1d10t", "you id​iot", "y o u  i d i o t", "you i.d.i.o.t.", "you i_d_i_o_t", "you idіоt", "you idiooooot", "you i***t", "YOU IDIOT!!!", "<p>you <b>idiot</b></p>", "&#121;ou idiot", "youIdiot = 1", "you_stupid_idiot()"])
def test_disguises(index, text):
    slope, offset = calibrated(index)
    terms = Terms([text], Vocabulary())
    v = index.votes(*index.neighbours(Vectors(terms, WEIGHTS), terms.sentences))
    assert slope * v.max() + offset >= 0, text


def test_cleaned():
    assert cleaned("dÃ¼mmer") == "dümmer"
    assert cleaned("蠢 货") == "蠢货"
    assert cleaned("a &amp; b\0") == "a & b "


def test_sentence_text():
    text = "One here. Two, there!\nthree 。四。five"
    terms = Terms([text, None, ""], Vocabulary())
    assert [sentence_text(text, i) for i in range(5)][:2] == ["One here.", "Two, there!"]
    assert terms.document.tolist() == sorted(terms.document.tolist()) and len(terms.first) == 3


def test_batches_do_not_matter():
    texts = ["You are an idiot. The test fails.", None, "", "a b c d", "I know where you live\nfine", "你就是个废物。好的", "x" * 100_000]
    v = Vocabulary()
    whole = Terms(texts, v)
    alone = [Terms([t], Vocabulary()) for t in texts]
    for d, one in enumerate(alone):
        mine = whole.document[whole.sentence] == d
        assert whole.term[mine].tolist() == one.term.tolist()
        assert (whole.sentence[mine] - whole.first[d]).tolist() == one.sentence.tolist()


def test_no_names_of_the_tables():
    texts = " ".join(labelled()[0]).lower()
    for name in ("veltr", "ashen", "cargo", "维尔特拉"):
        assert name not in texts


def test_scores(spark):
    rows = [(1, "a", None), (2, "a", ""), (3, "b", "You are a worthless idiot.\nThe test fails."), (4, None, "Thanks, the build is green."), (3, "b", "You are a worthless idiot.\nThe test fails."), (5, "c", "word " * 50_000 + ". Go and hang yourself. ok")]
    df = spark.createDataFrame(rows, "id long, score string, text string")
    out = {(r.id, r._score): r for r in harm_scores(df.withColumnRenamed("score", "_score"), "id", "text", ["_score"]).collect()}
    assert out[1, "a"].score == out[2, "a"].score == 0 and out[1, "a"].evidence is None
    assert out[3, "b"].score > 0.5 and out[3, "b"].evidence == "You are a worthless idiot."
    assert out[5, "c"].score > 0.5 and out[5, "c"].evidence == "Go and hang yourself."
    assert out[4, None].score < 0.5
    empty = harm_scores(df.filter("id < 0"), "id", "text")
    assert empty.columns == ["id", "score", "evidence", "example"] and empty.count() == 0


def test_frequencies_count_documents(spark):
    df = spark.createDataFrame([("alpha beta",), ("alpha alpha. alpha",), (None,), ("",)], "text string").repartition(3)
    counts, n = document_frequencies(df, "text")
    assert n == 2 and counts.max() == 2 and (idf(counts, n) > 0).all()


def test_no_word_is_taken_for_a_labelled_one():
    """Words of the labelled sentences have numbers of their own, so a foreign word can't bring a sentence near by its hash."""
    own = _own_numbers()
    strange = [_numbered([_bucket(f"wstrange{i}")])[0] for i in range(20_000)]
    assert min(strange) >= len(own) and max(strange) < TAG
    assert _numbered([_bucket("widiot")])[0] == own[_bucket("widiot")] < len(own)


def test_words_of_other_languages(index):
    """German Rock and es, French queue and Spanish él are an English rock, a Spanish es, a queue of messages and the article el."""
    slope, offset = calibrated(index)
    harmless = ["Running the integration suite", "The rock paper scissors sample has a bug", "She says the queue demo is on Tuesday, he believes it is Thursday, and I trust her.", "El resultado de la lista tiene que ser siempre el mismo.", "Es posible que el índice falle.", "La file d'attente est pleine, queue de 12 messages.", "Parasitic resistance of the cable does not matter here."]
    assert not (slope * votes(index, harmless) + offset >= 0).any()


def test_kinds_of_harm(index):
    """Written before the labelled sentences of these kinds were: bodies, groups shut out, assaults, falls in childhood, and what only sounds so."""
    slope, offset = calibrated(index)
    harmful = ["Your boobs looked fantastic in the meeting today.", "There is no room in this trade for disabled people.", "Did somebody drop you when you were a baby?", "I'll pull you into the store room and take you against the wall whether you like it or not.", "I hope you rot in a cell.", "Les femmes n'ont rien à faire dans l'informatique.", "让我看看你裙子下面。"]
    harmless = ["There is no place in this file for a license.", "I will drag the column to the left and drop it.", "Why don't you rename the branch before the next sprint?", "The architect begged for more tests and took the feedback on board.", "It must be hard to read this log on a phone.", "给我看看你的日志。", "外国人和老人也能用这个页面。"]
    assert (slope * votes(index, harmful) + offset >= 0).all()
    assert not (slope * votes(index, harmless) + offset >= 0).any()


def test_weights_do_not_depend_on_copies():
    """A term that no document has doesn't weigh more and more as the tables grow."""
    df = np.array([0, 1, 50, 40_000])
    assert np.allclose(idf(np.append(df, np.zeros(TERMS - 4)), 100_000), idf(np.append(df * 100, np.zeros(TERMS - 4)), 10_000_000), atol=0.7)
    assert idf(np.zeros(TERMS), 10_000_000)[0] < idf(np.zeros(TERMS), 100_000)[0] + 0.7
