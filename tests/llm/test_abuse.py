import random
import re

import numpy as np
import pytest

from astrolode.llm import abuse, passages
from astrolode.llm.plainwriting import DISGUISE, plain

GROUPS = ["Orlun", "Pesh", "Vardi", "Tollen"]
PLAIN = ["The board paid {n} marks into court.", "The {g} tenants paid their rent in {m}.", "Burn the old crates before {m}.", "The kennel sold a bitch to J. {n}.", "We saw {g} families at the {m} fair.", "Nobody shouted; the hearing of {m} went on."]
BAD = ["you stupid {i}, go and rot", "all {g} are vermin and should hang", "shut your mouth, {i}", "drown every {g} child at birth"]
INSULTS = ["moron", "bastard", "scumbag", "m0r0n", "b a s t a r d", "scumb​ag", "bаstаrd", "moooooron"]


def corpus(rng, n):
    fill = lambda t: t.format(n=rng.randrange(9999), g=rng.choice(GROUPS), m=rng.choice(["May", "June", "July"]), i=rng.choice(INSULTS))
    texts, truth = [], []
    for _ in range(n):
        bad = rng.random() < 0.3
        s = [fill(rng.choice(PLAIN)) for _ in range(rng.randrange(3, 9))]
        if bad:
            s.insert(rng.randrange(len(s) + 1), fill(rng.choice(BAD)) + rng.choice(".!"))
        texts.append(" ".join(s))
        truth.append(int(bad))
    return texts, truth


def test_plain_writing():
    said = lambda t: plain(t).replace(f" {DISGUISE}", "")
    assert said("w.o.r.t.h.l.e.s.s m a g g o t") == "worthless maggot" and said("p@r@$1t3$!") == "parasites!" and said("іdіоt") == "idiot"
    assert said("pa​rasites and mo-\nron") == "parasites and moron" and said("raaaats") == "rats" and said("W1ch$3r") == "wichser"
    for same in ("section 53a of [1950] cap 420", "or-2000-0000246", "c. a. bowa v r. pipewe", "20 a, 5th of may", "the bookkeeper's oddness"):
        assert plain(same) == same


def test_held_out_accuracy_under_noisy_labels(spark):
    rng = random.Random(9)
    texts, truth = corpus(rng, 1500)
    noisy = [1 - y if rng.random() < 0.04 else y for y in truth]
    model = abuse.train(texts[:900], noisy[:900])
    found = [int(model.score(t) > model.threshold) for t in texts[900:]]
    right = sum(a == b for a, b in zip(found, truth[900:], strict=True)) / 600
    assert right >= 0.97
    # the group that is named weighs next to nothing: neutral mentions stay neutral
    assert all(model.score(f"The {g} tenants paid their rent in May.") < model.threshold for g in GROUPS)
    scores = [model.score(f"All {g} are vermin and should hang.") for g in GROUPS]
    assert max(scores) - min(scores) < 1.5 and min(scores) > model.threshold


def test_groups_are_found_and_swaps_even_their_weights():
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(600):  # one group is only ever named in abuse
        bad = i % 3 == 0
        g = "Orlun" if bad and i % 2 else rng.choice(GROUPS[1:])
        texts.append(f"{'All ' + g + ' are vermin and should hang' if bad else 'The ' + g + ' tenants paid'}. {rng.choice(PLAIN).format(n=i, g=rng.choice(GROUPS[1:]), m='May')}")
        labels.append(int(bad))
    even, odd = (abuse.train(texts, labels, swap=s, groups=[g.lower() for g in GROUPS]) for s in (3.0, 0.0))
    gap = lambda m: m.score("The Orlun tenants paid.") - m.score("The Pesh tenants paid.")
    gap_w = lambda m: m.weight("orlun") - m.weight("pesh")
    assert abs(gap_w(even)) < abs(gap_w(odd)) and abs(gap(even)) <= abs(gap(odd)) + 1e-9


@pytest.mark.parametrize("labels", [[], [0, 0], [1, 1]])
def test_one_sided_labels(labels):
    model = abuse.train(["a b c"] * len(labels), labels)
    assert model.score("you moron") < model.threshold


def test_frames(spark):
    rng = random.Random(1)
    texts, truth = corpus(rng, 200)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(900, None, None), (901, "", "s"), (902, "ok " * 50_000, "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, y, "r") for i, y in enumerate(truth)] + [(0, 1 - truth[0], "q"), (5000, 1, "r"), (1, None, "q")], "doc_id long, abusive int, annotator string")
    model = abuse.fit(docs, labels)
    got = {r.doc_id: r.score for r in abuse.score(docs, model).collect()}
    assert len(got) == 203 and all(got[i] < 0 for i in (900, 901, 902))
    assert sum((got[i] > 0) == bool(y) for i, y in enumerate(truth)) >= 196
    assert abuse.score(docs.limit(0), model).count() == 0
    assert abuse.fit(docs, labels.limit(0)).score("you moron") < 0


def test_threats_of_common_words_are_found():
    rng = random.Random(8)
    # each word of the threat is frequent in sound texts; only its pairs tell
    sound = ["We know the court.", "They saw where it is.", "It is what you said.", "We live in May.", "I said you were well.", "The board said where it was."]
    texts, labels = [], []
    for i in range(600):
        s = [rng.choice(sound) for _ in range(8)]
        if i % 8 == 0:
            s.insert(rng.randrange(9), "We know where you live.")
        texts.append(" ".join(s))
        labels.append(int(i % 8 == 0))
    model = abuse.train(texts[:450], labels[:450])
    assert [model.score(t) > model.threshold for t in texts[450:]] == [bool(y) for y in labels[450:]]


def test_passages_are_cut_alike_in_any_batch():
    texts = ["One two three. Four's five\n\nsix seven 8 nine-ten", "", "x", "  ...  ", "a b " * 50, "né Straße; l’eau c'est", "a\x00b"]
    parts = ["One two three", "Four's five", "six seven", "nine-ten", "x", ("a b " * 50).strip(), "né Straße", "l’eau c'est", "a b"]
    w = passages.words(texts)
    assert w.passages() == parts and w.doc.tolist() == [0, 0, 0, 0, 2, 4, 5, 5, 6]
    alone = [passages.words([t]) for t in texts]
    for name in ("word", "pair", "gram"):
        assert np.concatenate([getattr(a, name) for a in alone]).tolist() == getattr(w, name).tolist()
    assert len(set(w.word.tolist())) == len({x for p in parts for x in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", p.replace("’", "'"))})
    same = passages.words(["the rats", "rats the", "these rats"])
    assert len(set(same.pair.tolist())) == 3 and set(passages.words(["rats"]).gram.tolist()) < set(same.gram.tolist())


def test_a_long_text_scores_as_its_worst_piece():
    rng = random.Random(2)
    texts, truth = corpus(rng, 600)
    model = abuse.train(texts, truth)
    sound = [t for t, y in zip(texts, truth, strict=True) if not y]
    bad = next(t for t, y in zip(texts, truth, strict=True) if y and model.score(t) > model.threshold)
    long = " ".join(sound[i % len(sound)] for i in range(3000))
    scores = model.scores([long, long + " " + bad + " " + long, "word " * 100_000, bad, None])
    assert len(long) > passages.PIECE and scores[1] == max(scores[0], scores[3]) and scores[2] == scores[4] == model.bias
    assert scores.tolist() == [model.score(t) for t in (long, long + " " + bad + " " + long, "word " * 100_000, bad, None)]
