"""The letters that obfuscated words are read with."""

import random
from collections import Counter

import pytest
from guardloom.llm import toxicity


def letters(*words):
    grams = Counter()
    for w in words:
        for i in range(len(w) + 1):
            grams[f"^^{w}$"[i : i + 3]] += 20
    return toxicity.CharModel().learn(grams)


def test_letters_come_from_all_documents(spark):
    rng = random.Random(5)
    rare = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(30_000)]
    docs = [(i, " ".join(rare[i * 1000 : i * 1000 + 1000])) for i in range(30)] + [(None, "Żółw żółw"), (99, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got, want = toxicity.letter_trigrams(frame), Counter()
    for _, text in docs:
        for w in set((text or "").lower().split()):
            want.update(f"^^{w}$"[i : i + 3] for i in range(len(w) + 1))
    assert got == want
    model = toxicity.fit_toxicity(frame, spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int"))
    assert model.letters.three == want


@pytest.mark.parametrize("text, word", [("idi0+", "idiot"), ("sh!+", "shit"), ("scu3|", "scuel"), ("worthle$$", "worthless"), ("worth1e$$!", "worthless"), ("hello!", "hello"), ("+oad", "toad"), ("(worthle$$)", "worthless")])
def test_signs_at_the_ends_of_words(text, word):
    model = letters("idiot", "shit", "scuel", "worthless", "hello", "toad")
    assert word in toxicity.readings(text, model, {})


def test_the_likeliest_of_all_readings(monkeypatch):
    """Against a search over whole prefixes, which drops nothing."""
    model = letters("would", "wild", "wield", "mean", "main", "moan", "abel")
    for raw in ("w*1*!*d", "m*!*n", "a*|*b", "*!*|*!*", "(*!*|*1*d"):
        best = {("^^", ""): 0.0}
        for c in raw:
            options = [(c, 0.0 if c.isalpha() else toxicity.COST_KEEP)]
            options += [(x, toxicity.COST_LOOKALIKE if len(toxicity.LOOKALIKES[c]) < 3 else toxicity.COST_WILD) for x in toxicity.LOOKALIKES.get(c, "")]
            if not c.isalnum():
                options.append(("", toxicity.COST_DROP))
            after = {}
            for (context, text), cost in best.items():
                for x, price in options:
                    key = (context[-1] + x if x else context, text + x)
                    total = cost + price + (model.cost(context, x) if x else 0)
                    after[key] = min(total, after.get(key, total))
            # the same two letters have the same future: the cheapest prefix of each is enough
            least = {}
            for (context, text), cost in after.items():
                if context not in least or (cost, text) < least[context]:
                    least[context] = (cost, text)
            best = {(k, t): c for k, (c, t) in least.items()}
        want = min((cost + model.cost(context, "$"), text) for (context, text), cost in best.items())[1]
        assert toxicity.decode(raw, model, {}) == want


def test_a_reading_beyond_the_48_cheapest_states():
    model = letters("uanamcoi", "ueeai", "ilncm", "numslcti")
    assert toxicity.decode("***n*m(*1", model, {}) == "namcoi"


@pytest.mark.parametrize(
    "text, want",
    [
        ("You 1d10t!", ["you", "idiot"]),
        ("an i d i o t here", ["an", "idiot", "here"]),
        ("plain Words, 42 of them", ["plain", "words", "of", "them"]),
        ("wiiiiield it", ["wield", "it"]),
        (None, []),
    ],
)
def test_the_restored_text_takes_the_place_of_what_was_written(text, want):
    model = letters("idiot", "idiot", "you", "an", "here", "wield", "it", "plain", "words", "of", "them")
    assert toxicity._WORD.findall(toxicity.restored(text, model, {})) == want


def every_reading(raw):
    """(cost of the channel, text) of all readings of a word, by enumeration."""
    found = [(0.0, "")]
    for i, c in enumerate(raw):
        options = [(c, 0.0 if c.isalpha() else toxicity.COST_KEEP)]
        options += [(x, toxicity.COST_LOOKALIKE if len(toxicity.LOOKALIKES[c]) < 3 else toxicity.COST_WILD) for x in toxicity.LOOKALIKES.get(c, "")]
        if not c.isalnum():
            options.append(("", toxicity.COST_DROP))
        elif i and raw[i - 1] == c:
            options.append(("", toxicity.COST_REPEAT))
        found = [(a + price, text + x) for a, text in found for x, price in options]
    return found


def test_viterbi_against_enumeration():
    rng = random.Random(8)
    model = letters("would", "wild", "wield", "mean", "main", "moan", "abel", "table", "also")
    for _ in range(120):
        raw = "".join(rng.choice("wildmeanto*!|1045$") for _ in range(rng.randint(2, 6)))

        def whole(reading):
            cost, text = reading
            marked = "^^" + text + "$"
            return cost + sum(model.cost(marked[i : i + 2], marked[i + 2]) for i in range(len(text) + 1))

        best = min(map(whole, every_reading(toxicity._DRAWN.sub(r"\1\1", raw))))
        got = toxicity.decode(raw, model, {})
        assert min(whole(r) for r in every_reading(toxicity._DRAWN.sub(r"\1\1", raw)) if r[1] == got) == pytest.approx(best), raw


def test_fast_searches_find_what_the_patterns_define():
    import numpy as np

    rng, signs = random.Random(3), "abié²_ .-*@$!|+013(#%x\n\tß日"
    for _ in range(20_000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        assert toxicity._mixed_words(text) == [m.span() for m in toxicity._LEET.finditer(text)], text
        assert toxicity._may_be_spaced(points) or not toxicity._SPACED.search(text), text
        drawn = toxicity._drawn_words(text, points)
        assert bool(drawn) == bool(toxicity._TRIPLE.search(text)) and all(toxicity._TRIPLE.search(text[a:b]) for a, b in drawn), text
