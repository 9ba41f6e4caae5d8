"""Token files: each distinct word is encoded once, whatever stands behind it, and texts come as Arrow arrays."""

import random

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from evidentia.llm.pieces import Memo
from evidentia.llm.tokenfile import Library

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_a_word_is_encoded_once():
    library, seen = Library(PATH), []
    merged = library.words.encode
    library.words.encode = lambda words: (seen.extend(words), merged(words))[1]
    text = "x thonlying thonlying, thonlying. thonlying***\nthonlying élleç élleç,"
    assert [i.tolist() for i in Memo(library).texts(pa.array([text, text]))] == [Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids] * 2
    assert sorted(seen) == sorted({"x", " thonlying", ",", ".", "***", "\n", "thonlying", " élleç"})


def test_arrays_of_odd_texts_equal_the_library():
    rng, tokenizer, memo = random.Random(7), Tokenizer.from_file(PATH), Memo(Library(PATH))
    parts = [*"aBéß \n\t'1²½ªµº×!\x00\x85_-$٣ǅ日́　", "  ", "\r\n", "'s", " 've", "don't", "<|endoftext|>", "<|end", "thing", " and", "12,"]
    texts = ["", " ", "\n", "a ", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000))]
    for text, ids in zip(texts, memo.texts(pa.array(texts)), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
