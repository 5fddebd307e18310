import random
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillstone.llm import token_fst
from quillstone.llm.token_fst import DONE, TokenCounter, count_tokens, piece_starts, symbols

FILE = str(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY = Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def counter():
    with open(FILE, encoding="utf-8") as f:
        return TokenCounter(f.read())


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_random_texts(counter):
    rng = random.Random(1)
    parts = [*" \n\t'strelvd aébÀ中9٣½!?.\x1c\x00🙂", "'s", "'re", "'ll", "''", "<|endoftext|>", "  ", "\r\n", "\u3000", "İ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(5000)]
    assert counter(texts).tolist() == library(texts)


def test_code_points(counter):
    texts = [f"a{chr(i)} 1{chr(i)}!{chr(i)} {chr(i)}{chr(i)}b" for i in range(0, 0x30000, 7) if not 0xD800 <= i < 0xE000]
    assert counter(texts).tolist() == library(texts)


def test_long_runs(counter):
    texts = ["a" * 3000, "ab" * 5000, " " * 4000, "\n" * 333 + "x", "1" * 777, "é" * 3000, "the" * 2000, "", None]
    assert counter(texts).tolist() == library(texts)


def test_states_start_anew(counter, monkeypatch):
    import quillstone.llm.token_fst as module

    monkeypatch.setattr(module, "MAX_STATES", 50)
    monkeypatch.setattr(module, "MAX_PIECES", 20)
    texts = [f"some words {i} and more{i}words" for i in range(300)]
    assert [int(counter([t])[0]) for t in texts] == library(texts)


def test_scan_does_not_depend_on_chunks(monkeypatch):
    import numpy as np

    import quillstone.llm.token_fst as module

    text = "it's 'they're  x\n\n 'll don't" * 50 + "\0"
    points = np.array([ord(c) for c in text], np.uint32)
    kinds = symbols(points, np.array([len(text) - 1]))
    found = []
    for size in (1, 3, 64, 5000):
        monkeypatch.setattr(module, "CHUNK", size)
        found.append(piece_starts(kinds).tolist())
    assert all(f == found[0] for f in found) and DONE == 0


def test_tables_stay_bounded_within_a_piece(monkeypatch):
    monkeypatch.setattr(token_fst, "MAX_STATES", 500)
    rng = random.Random(3)
    counter = token_fst.TokenCounter(Path(FILE).read_text(encoding="utf-8"))
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (5, 3000, 60_000)]
    assert counter(texts).tolist() == library(texts)
    assert len(counter.counter.states) <= 500 and len(counter.counter.arcs) <= 500 * token_fst.ARCS_A_STATE


def test_operator(docs, rows, no_docs):
    found = count_tokens(docs.withColumn("n_tokens", docs["n_chars"]), ["doc_id", "text", "n_tokens"], FILE).collect()
    assert len(found) == len(rows)
    for r, n in zip(found, library([r["text"] for r in found])):
        assert (r["n_tokens"], r["n_bytes"]) == (n, len((r["text"] or "").encode()))
    assert count_tokens(no_docs, ["doc_id"], FILE).collect() == []
