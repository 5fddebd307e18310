import hashlib
import random
import re

import pytest

from quillstone.llm.pii import KINDS, detect, find, find_disguised, redact

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    return found + [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_of_random_texts():
    rng = random.Random(2)
    texts = ["".join(rng.choice("aB1@.+-_ ()9%0") for _ in range(80)) for _ in range(20_000)]
    assert [t for t in texts if find(t) != base(t)] == []


def test_very_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "+1" + "(" * 50_000, "1." * 50_000, "@" * 50_000):
        find(text)
        find_disguised(text, [])


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("write john at example dot com now", "email", "john at example dot com"),
        ("mail bob[at]mail (dot) org.", "email", "bob[at]mail (dot) org"),
        ("mail ann (AT) site [DOT] co [dot] uk", "email", "ann (AT) site [DOT] co [dot] uk"),
        ("see user&#64;host.net", "email", "user&#64;host.net"),
        ("ｂob＠exаmple.com x", "email", "ｂob＠exаmple.com"),
        ("call plus one two one two five five five zero one zero one", "phone", "plus one two one two five five five zero one zero one"),
        ("call +1 five five five - 123 4567 89", "phone", "+1 five five five - 123 4567 89"),
        ("host 10[.]20[.]30[.]40 up", "ip", "10[.]20[.]30[.]40"),
        ("card ٤٥٣٩578763621486 ok", "card", "٤٥٣٩578763621486"),
    ],
)
def test_disguised(text, kind, part):
    found = find_disguised(text, find(text))
    assert [(k, text[a:b]) for k, a, b in found] == [(kind, part)]


@pytest.mark.parametrize("text", ["meet me at example.com", "one two three", "at the dot", "plain words only", "Привет, как дела?", "naïve café", "a bob@x.de b"])
def test_clean_texts_are_left_alone(text):
    assert find_disguised(text, find(text)) == []


def test_redaction():
    text = "a bob@x.de b +1 212 555 0101 c 1.2.3.4"
    assert redact(text, find(text)) == "a [EMAIL] b [PHONE] c [IP]"


def test_operator(spark, docs, rows, no_docs):
    extra = [(500, "x bob@mail.com 1.2.3.4 and ann at b dot org"), (501, None), (502, "")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    found = detect(df, ["doc_id"], redacted=True).collect()
    assert len(found) == len(rows) + 3
    source = {r["doc_id"]: r["text"] for r in df.where("doc_id >= 500").collect()}
    for r in (r for r in found if (r["doc_id"] or 0) >= 500):
        want = sorted(base(source[r["doc_id"]] or ""), key=lambda s: (s[1], KINDS.index(s[0])))
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in want) for k in KINDS]
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[500]["spans"] == "email:2:14,ip:15:22,email:27:43" and by_id[500]["text"] == "x [EMAIL] [IP] and [EMAIL]"
    assert by_id[501]["text"] is None and by_id[501]["spans"] == "" and by_id[502]["text"] == ""
    assert detect(no_docs, ["doc_id"]).collect() == []


@pytest.mark.parametrize(
    "text, kind",
    [
        ("+1 212 555 zero one zero one", "phone"),
        ("+1 five five five 123 4567", "phone"),
        ("plus 44 20 7946 0958", "phone"),
        ("4111 1111 1111 one one one one", "card"),
        ("192.168.0.one", "ip"),
    ],
)
def test_few_spelled_items_are_enough(text, kind):
    for whole in (text, f"see {text} now", f"{text} and the dot it has", f"\u200b {text}"):
        assert [(k, whole[a:b]) for k, a, b in find_disguised(whole, find(whole))] == [(kind, text)]


def test_nothing_is_lost_to_the_search_for_places(monkeypatch):
    from quillstone.llm import pii

    rng = random.Random(4)
    parts = [*pii.DIGIT_WORDS, *"0123456789", "+", "plus ", " at ", " dot ", "[at]", "( dot )", "&#64;", "&period;", "\u200b", ".", " ", ", ", "-", "bob", "x.de", "@", "٤", "о", "Seven", "someone", "com"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(4, 24))) for _ in range(20_000)]
    texts += [" ".join(rng.choice([*pii.DIGIT_WORDS, "4", "12", "555"]) for _ in range(14)) for _ in range(3000)]
    texts += ["+" + t for t in texts[-3000:]]
    found = [find_disguised(t, find(t)) for t in texts]
    assert sum(map(bool, found)) > 500
    monkeypatch.setattr(pii.MACHINE, "heads", re.compile(r"(?s:.)"))  # the machine is set on every character
    assert [t for t, f in zip(texts, found) if find_disguised(t, find(t)) != f] == []


def test_clashing_names_and_long_texts(spark):
    long = "word " * 60_000 + "bob@firm.example.com"
    rows = [(1, "mail bob@firm.example.com", "x", "y", 7, "z"), (2, None, None, None, None, None), (3, long, "x", "y", 1, "z"), (1, "mail bob@firm.example.com", "x", "y", 7, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, base_sha256 string, n_email int, text_ string")
    found = sorted(detect(df, ["doc_id", "spans", "n_email", "text_"]).collect(), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["n_email"], r["spans"], r["text_"]) for r in found] == [(1, 1, "email:5:25", "z"), (1, 1, "email:5:25", "z"), (2, 0, "", None), (3, 1, f"email:{len(long) - 20}:{len(long)}", "z")]
