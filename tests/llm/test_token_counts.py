from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from risklens.llm.token_counts import Counter, count_tokens
from risklens.llm.vocabulary import default_vocabulary, pieces

COUNTER = Counter(default_vocabulary())
LIBRARY = Tokenizer(models.Unigram(pieces(default_vocabulary()), unk_id=0, byte_fallback=True))
LIBRARY.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)

TEXTS = ["", " ", "  a  b ", "\n\n", "日本語 ü☃☃ x", "▁▁a", "<0x0A> a", "a\tb\r\n c", "\U0001F600\U0001F600 x", "antidisestablishmentarianism " * 50]


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_equals_library():
    assert [COUNTER(t) for t in TEXTS] == [library(t) for t in TEXTS]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_equals_library_on_any_text(text):
    assert COUNTER(text) == library(text)


def test_query_over_nulls_and_repeats(docs_of):
    got = {(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in count_tokens(docs_of([(1, None), (2, ""), (3, "the cat"), (None, "the cat"), (3, "the cat")], extra="n_tokens")).collect()}
    n = library("the cat")
    assert got == {(1, 0, 0), (2, 0, 0), (3, 7, n), (None, 7, n)}
    assert count_tokens(docs_of([])).count() == 0
