import pytest

from quillstone.functions import porter2
from quillstone.functions.porter2 import EXCEPTIONS, INVARIANTS, stem

# Pairs from the published sample vocabulary of the algorithm.
SAMPLES = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist",
    "consisted": "consist", "consistency": "consist", "consistent": "consist", "consistently": "consist", "consisting": "consist",
    "consists": "consist", "consolation": "consol", "consolations": "consol", "consolatory": "consolatori", "console": "consol",
    "consoled": "consol", "consoles": "consol", "consolidate": "consolid", "consolidated": "consolid", "consolidating": "consolid",
    "consoling": "consol", "consolingly": "consol", "consols": "consol", "consonant": "conson", "consort": "consort",
    "consorted": "consort", "consorting": "consort", "conspicuous": "conspicu", "conspicuously": "conspicu", "conspiracy": "conspiraci",
    "conspirator": "conspir", "conspirators": "conspir", "conspire": "conspir", "conspired": "conspir", "conspiring": "conspir",
    "constable": "constabl", "constables": "constabl", "constance": "constanc", "constancy": "constanc", "constant": "constant",
    "knack": "knack", "knackeries": "knackeri", "knacks": "knack", "knag": "knag", "knave": "knave", "knaves": "knave",
    "knavish": "knavish", "kneaded": "knead", "kneading": "knead", "knee": "knee", "kneel": "kneel", "kneeled": "kneel",
    "kneeling": "kneel", "kneels": "kneel", "knees": "knee", "knell": "knell", "knelt": "knelt", "knew": "knew", "knick": "knick",
    "knif": "knif", "knife": "knife", "knight": "knight", "knightly": "knight", "knights": "knight", "knit": "knit", "knits": "knit",
    "knitted": "knit", "knitting": "knit", "knives": "knive", "knob": "knob", "knobs": "knob", "knock": "knock", "knocked": "knock",
    "knocker": "knocker", "knockers": "knocker", "knocking": "knock", "knocks": "knock", "knopp": "knopp", "knot": "knot", "knots": "knot",
}


@pytest.mark.parametrize("word", SAMPLES)
def test_samples(word):
    assert stem(word) == SAMPLES[word]


def test_rules():
    pairs = {
        "caresses": "caress", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi",
        "luxuriated": "luxuri", "hopping": "hop", "hoping": "hope", "happy": "happi", "by": "by", "say": "say", "cry": "cri",
        "generate": "generat", "generously": "generous", "communism": "communism", "arsenal": "arsenal", "youth": "youth",
        "Running": "run", "analogi": "analog", "relational": "relat", "conditional": "condit", "hopefulness": "hope",
        "adjustable": "adjust", "adoption": "adopt", "replacement": "replac", "rate": "rate", "controll": "control", "feed": "feed",
        "agreed": "agre", "bled": "bled", "beautiful": "beauti", "sky": "sky", "dying": "die", "a": "a", "": "", "x2": "x2",
    }
    assert {w: stem(w) for w in pairs} == pairs


def test_words_with_a_stem_of_their_own():
    assert all(stem(w) == s for w, s in EXCEPTIONS.items())
    assert all(stem(w) == w and stem(w + "s") == w for w in INVARIANTS - {"proceed", "exceed", "succeed"})


def test_a_word_without_a_suffix_is_compared_once():
    class Once(tuple):
        def __iter__(self):
            raise AssertionError("suffixes are gone through")

    assert porter2._longest("thor", Once(("ed", "ing"))) == ""
    assert porter2._longest("agreed", ("ed", "eed")) == "eed" and porter2._regions("beautiful") == (5, 7) and porter2._regions("beau") == (4, 4)
