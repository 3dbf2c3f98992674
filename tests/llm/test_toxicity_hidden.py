"""Toxic words set apart: at sentence ends, in quotes, beside short words, in phrases."""

import random
import re

import pytest

from lodestone.llm import toxicity
from lodestone.llm.common import documents
from tests.llm.test_toxicity import SF, model  # noqa: F401


def scored(model, text):  # noqa: F811
    return model.probability(toxicity.Evidence(model).of(f"the thing was {text}"))


@pytest.mark.parametrize("hidden", ["you are a m o r o n.", '"i d i o t" again', "i d i o t!", "(m o r o n)", "so I i d i o t", "a n i d i o t, yes", "y o u a r e a s t u p i d i d i o t", "i\nd\ni\no\nt"])
def test_letters_set_apart(model, hidden):  # noqa: F811
    assert scored(model, hidden) >= toxicity.THRESHOLD


def test_long_phrases_set_apart(model):  # noqa: F811
    phrase = " ".join("and so it is that the other thing and the same one again you stupid idiot and so it is that the other thing and the same one again".replace(" ", ""))
    assert scored(model, phrase) >= toxicity.THRESHOLD


def test_clean_phrases_set_apart_stay_clean(spark, model):  # noqa: F811
    random.seed(1)
    tried = 0
    for r in documents(spark, SF).orderBy("doc_id").limit(400).collect():
        words = r.text.split()
        if len(words) > 8 and model.probability(toxicity.Evidence(model).of(r.text)) < toxicity.THRESHOLD:
            k = random.randrange(len(words) - 4)
            tried += 1
            assert scored(model, " ".join(re.sub("[^a-z]", "", "".join(words[k : k + 4]).lower()))) < toxicity.THRESHOLD
    assert tried > 100


@pytest.mark.parametrize("hidden", ["idi" + "o" * 70 + "t", "id" + "d" * 90 + "iot", "iddiot", "morron", ".".join("youareastupididiotandaloserandnothing"), "and-so-it-is-that-the-other-thing-and-the-same-one-again-and-again-you-1d1ot-you"])
def test_stretches_doubles_and_long_tokens(model, hidden):  # noqa: F811
    assert scored(model, hidden) >= toxicity.THRESHOLD


@pytest.mark.parametrize("clean", ["good", "a" * 100000 + "1b", "https://example.org/" + "and/the/other/thing/" * 20 + "2024"])
def test_clean_stretches_doubles_and_long_tokens(model, clean):  # noqa: F811
    assert scored(model, clean) < toxicity.THRESHOLD
