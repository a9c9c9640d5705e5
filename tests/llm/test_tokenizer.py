import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.llm import tokenizer

tiktoken = pytest.importorskip("tiktoken")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def both():
    path = tokenizer.default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tokenizer.encoder(path), tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.characters(exclude_categories=["Cs"])) | st.text("ab '\"\n\t\r  \x0b\x1c\x1f12_<|>stre", max_size=60))
def test_same_as_reference_encoder(both, text):
    ours, theirs = both
    ids = ours.encode(text)
    assert ids == theirs.encode_ordinary(text)
    assert ours.decode(ids) == text


def test_corner_cases(both):
    ours, theirs = both
    for text in ("<|endoftext|>", "a" * 5000, "  \n\n x", "don't DON'T", "\x85 \xa0", "x" * 70 + "é", "中文" * 500, "-" * 1000 + "\n" * 300):
        assert ours.encode(text) == theirs.encode_ordinary(text)
    assert ours.encode("") == ours.encode(None) == []


def test_column(spark, both):
    df = spark.createDataFrame([(1, "Fix bug\n+ x"), (2, ""), (3, None), (1, "Fix bug\n+ x")], "doc_id long, text string")
    rows = sorted(tokenizer.token_ids(df).collect())
    assert [len(r.ids) > 0 for r in rows] == [True, True, False, False] and rows[0] == rows[1]
    assert sorted(r.text for r in tokenizer.decoded(tokenizer.token_ids(df)).collect()) == ["", "", "Fix bug\n+ x", "Fix bug\n+ x"]
    assert tokenizer.token_ids(df).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    assert tokenizer.token_ids(df.limit(0)).count() == 0
