from __future__ import annotations

import os
import random
from collections import Counter

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from tablepulse.llm import tokens
from tests.llm.conftest import docs_of


def tokenizer(vocabulary, bytewise):
    made = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], unk_id=0, byte_fallback=bytewise))
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return made


def test_counts_equal_the_tokenizer_with_ties_and_unknowns():
    rng = random.Random(1)
    for _ in range(150):
        pieces = {"".join(rng.choice("abcde▁") for _ in range(rng.randrange(1, 5))) for _ in range(25)}
        vocabulary = [(p, rng.choice([-1.0, -2.0, -1.5, -3.0, -5 * rng.random()])) for p in sorted(pieces)]
        ours, theirs = tokens.Counter(vocabulary), tokenizer(vocabulary, False)
        for _ in range(20):
            text = "".join(rng.choice("abcde  xy▁") for _ in range(rng.randrange(30)))
            assert ours.count(text) == len(theirs.encode(text, add_special_tokens=False).ids), (text, vocabulary)


@pytest.mark.skipif(not os.path.exists(tokens.MODEL), reason="no vocabulary here")
def test_whole_texts_equal_the_tokenizer(messy, messy_rows):
    theirs = tokenizer(tokens.read_vocabulary(), True)
    want = Counter((i, len(t or ""), len(theirs.encode(t or "", add_special_tokens=False).ids)) for i, t in messy_rows)
    assert Counter(map(tuple, tokens.token_counts(messy).collect())) == want


def test_kept_words_are_bounded():
    counter = tokens.Counter([(c, -1.0) for c in "▁abc"], kept=5)
    assert [counter.count(w) for w in ("a", "ab", "abc", "b", "c", "ba", "ca", "a")] == [2, 3, 4, 2, 2, 3, 3, 2]
    assert len(counter) <= 5


@pytest.mark.skipif(not os.path.exists(tokens.MODEL), reason="no vocabulary here")
def test_empty_table(spark):
    assert tokens.token_counts(docs_of(spark, [])).collect() == []
