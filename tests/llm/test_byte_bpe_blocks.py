"""Pieces go through the byte-level encoder in blocks, and the ids are tiktoken's."""

import base64
import random

import pyarrow as pa
import pytest

from matchloom.llm import op9_byte_bpe as op9

tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")
SYLLABLES = "the ing tion oue aux schen é ß ö ation er on th ly que ción 中 ق 😀 x".split()
ENDS = ["", "", ",", ".", "!!", "'s", "'re", "\n", "\n\n", "7", "%%%x", "<|endoftext|>"]


class Counted:
    """An automaton that counts how often it is run."""

    def __init__(self, automaton):
        self.automaton, self.runs = automaton, 0

    def __len__(self):
        return len(self.automaton)

    def iter(self, text):
        self.runs += 1
        return self.automaton.iter(text)


@pytest.fixture(scope="module")
def own():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return lambda pattern: tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def made_up(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 6))) + rng.choice(ENDS) for _ in range(n)]


@pytest.mark.parametrize("pattern", [tokenizers.PATTERN, r"\s?\p{L}{1,7}|\s?[^\s\p{L}]+|\s+"])
def test_blocks(own, pattern):
    rng = random.Random(11)
    texts = [" ".join(made_up(rng, rng.randint(0, 40))) for _ in range(600)]
    texts += [t.replace("\n ", "\n") for t in texts] + [f" {texts[0]} ", "th" * 40, "é" * 32, "é" * 33, "thschenaux" * 900, "\n", None, ""]
    words, encode = op9.BytePairs(PATH, pattern), own(pattern)
    words.automaton = Counted(words.automaton)
    for _ in range(2):
        assert words.encode(pa.array(texts, pa.string())).to_pylist() == [encode(t or "") for t in texts]
    assert words.automaton.runs <= 20  # of some 10,000 distinct pieces


def test_memo_outlasts_batches():
    rng = random.Random(12)
    batch = [pa.array([" ".join(made_up(rng, 1000)).replace("\n", "") for _ in range(10)], pa.string()) for _ in range(4)]
    words = op9.BytePairs(PATH, tokenizers.PATTERN)
    words.automaton = Counted(words.automaton)
    first = [words.encode(b).to_pylist() for b in batch]
    runs = words.automaton.runs
    assert [words.encode(b).to_pylist() for b in batch] == first and words.automaton.runs == runs
    words.forget()
    assert words.encode(batch[0]).to_pylist() == first[0] and runs < words.automaton.runs < runs + 20


def test_memo_is_bounded(monkeypatch, own):
    monkeypatch.setattr(op9, "KNOWN", 50)
    monkeypatch.setattr(op9, "PAIRS", 16)
    monkeypatch.setattr(op9, "BLOCK", 100)
    rng = random.Random(13)
    words, encode = op9.BytePairs(PATH, tokenizers.PATTERN), own(tokenizers.PATTERN)
    for _ in range(5):
        texts = [" ".join(made_up(rng, 20)) for _ in range(20)] + ["y" * 5000]
        assert words.encode(pa.array(texts, pa.string())).to_pylist() == [encode(t) for t in texts]
        assert len(words.known) == len(words.known_ids) <= 50 and len(words.pairs) == 16
        assert max(map(len, words.known.to_pylist())) <= op9.LONG
