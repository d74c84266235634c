import numpy as np
import public_tokenizers
import pytest
from llm_samples import ODD
from tokenizers import Tokenizer

from tracewell.llm import order_packing
from tracewell.llm.order_packing import WordTokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [t or "" for _, t in ODD] + [
    "\n", "a\tb", "A'S don't I'LL ve'", "<|endoftext|> x<|startoftext|>y", "A<|b <| < |", "é É ß ẞ İ é", "日本語 テスト 🙂ok",
    "x×y÷z ª º µ", "0123 4.5,6!?", "\x0b\x0c\x85z\xa0", "'s't're''ve '", "--- *** ###", "a  b \n c"]


class Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, 0

    def encode(self, *args, **options):
        self.calls += 1
        return self.tokenizer.encode(*args, **options)


def expected(texts):
    tokenizer = Tokenizer.from_file(WORDS)
    return [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("cached", [0, 600_000])
def test_ids_are_the_librarys(monkeypatch, cached):
    monkeypatch.setattr(order_packing, "CACHED_WORDS", cached)
    words = WordTokens(WORDS)
    assert words.encode_all(TEXTS) == words.encode_all(TEXTS) == [words.encode(t) for t in TEXTS] == expected(TEXTS)
    assert words.encode_all([]) == []


def test_words_of_many_texts_go_to_the_library_together():
    words = WordTokens(WORDS)
    words.tokenizer, words.of_words = Counted(words.tokenizer), Counted(words.of_words)
    texts = [f"the {chr(97 + i)}xq{chr(97 + i)} of" for i in range(26)]
    assert words.encode_all(texts) == expected(texts)
    assert (words.tokenizer.calls, words.of_words.calls) == (0, 1)
    assert words.encode_all(texts[::-1]) == expected(texts[::-1])
    assert (words.tokenizer.calls, words.of_words.calls) == (0, 1)
