import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from astrolode.llm import tokens

BPE = tokens.tokenizer()
ALPHABET = st.sampled_from([*"abXY019  \n\t''!.,-—é中文，。ñ😀́\xa0\x1c​", "'ll", " the", "  \n", "<|endoftext|>"])


@settings(max_examples=400, deadline=None)
@given(st.lists(ALPHABET, max_size=60).map("".join), st.integers(1, 9), st.integers(1, 9))
def test_any_tree_gives_the_whole_texts_ids(text, leaf, window):
    assert BPE.ids(text, leaf, window).tolist() == BPE.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(ALPHABET, max_size=60).map("".join), st.integers(1, 9), st.integers(1, 9))
def test_ids_lead_back_to_the_text(text, leaf, ids):
    assert BPE.text(BPE.ids(text, leaf), ids) == text


@pytest.mark.parametrize("text", ["x" * 40_000, "中" * 30_000, " " * 30_000 + "a", "word " * 20_000, "\n" * 20_000])
def test_long_texts(text):
    assert BPE.ids(text).tolist() == BPE.encode(text)


def test_the_other_library_agrees():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ("It's 2024: <|endoftext|> naïve\n\n  x", "¶ 1 Der Fährmann’s Boot"):
        assert BPE.ids(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_frames(spark):
    data = [(1, "a b"), (2, ""), (3, None), (None, "c"), (1, "a b"), (4, "yes no " * 9000)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted(((r.doc_id, list(r.ids)) for r in tokens.encode(df).collect()), key=repr)
    assert got == sorted(((k, BPE.encode(t) if t else []) for k, t in data), key=repr)
    sizes = tokens.count(df.drop("ids")).collect()
    assert sorted(r.n_tokens for r in sizes) == sorted(len(BPE.encode(t)) if t else 0 for _, t in data)
    assert tokens.encode(df.limit(0)).count() == 0


def test_decoded_frames(spark):
    data = [(1, "a b"), (2, ""), (3, None), (None, "c"), (1, "a b"), (4, "yes né " * 9000)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = tokens.decode(tokens.encode(df).withColumn("text", F.lit("clash"))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((k, t or "") for k, t in data), key=repr)
    odd = spark.createDataFrame([(1, [-1]), (2, [10**8]), (3, None), (4, [5, None]), (5, [])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, tokens.decode(odd).collect())) == [(1, None), (2, None), (3, None), (4, None), (5, "")]
    assert tokens.decode(odd.limit(0)).count() == 0
