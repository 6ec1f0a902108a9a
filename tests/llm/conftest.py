import pytest


@pytest.fixture(scope="session")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


@pytest.fixture(scope="session")
def reference_encoding(tokenizer):
    import tiktoken

    from quillstack.llm.bpe import read_ranks

    return tiktoken.Encoding("own", pat_str=tokenizer[1], mergeable_ranks=read_ranks(tokenizer[0]), special_tokens={})


ODD = [(1, "The quick brown fox's 123 été 日本語 \U0001f3f4 <|endoftext|>\n\n  x"), (2, None), (3, ""), (4, "   "), (5, "a" * 20000), (6, " the" * 20000), (1, "The quick brown fox's 123 été 日本語 \U0001f3f4 <|endoftext|>\n\n  x"), (None, "no id")]


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like results."""
    rows = [(i, t, "x", 7, "y") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int, fp string")
