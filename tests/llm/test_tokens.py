import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logsieve.llm.tokens import count_tokens, counter, read_vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNT = counter(*read_vocabulary(PATH))


def library_count(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert COUNT(text) == library_count(text)


@pytest.mark.parametrize("text", [
    "", " ", "\n\n  \n", "a" * 30_000, "x y " * 5000, "it's we'll IT'S", "<|endoftext|>", "a<|endoftext|><|endoftext|> b",
    "<|endoftext|", "\x1c\x1d a\x85b c　 d", "ſtraße ñandú 漢字かな 12345 ½ ²", "👩‍👩‍👧 🇩🇪", "́é", "\x00\x01",
    "tab\tand  two   spaces ", "http://a.b/c?d=e&f", "﻿bom", "á" * 999 + "!" * 999,
])
def test_odd_texts(text):
    assert COUNT(text) == library_count(text)


def test_table(spark):
    rows = [(1, "one two", "k"), (1, "one two", "k"), (None, None, None), (4, "", "z"), (5, "word " * 2000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, PATH, limit=1024).collect()}
    assert count_tokens(docs, PATH).count() == 5
    n = library_count("word " * 2000)
    assert got == {(1, 7, 2, False), (None, 0, 0, False), (4, 0, 0, False), (5, 10_000, n, n > 1024)}
    assert count_tokens(docs.limit(0), PATH).count() == 0
