import public_tokenizers
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gleanery.llm.token_counts import count_tokens, counter

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def by_library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_whole_table_as_the_library():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    assert [counter(PATH).count(t) for t in texts] == [by_library(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("aAbZ'stre0195 .,!\n\t\x1c\x85　éßΣσİ日本語ñ́🙂<|>endoftext") + ["<|endoftext|>", "<|startoftext|>"]), max_size=60).map("".join))
def test_any_text_as_the_library(text):
    assert counter(PATH).count(text) == by_library(text)


def test_edge_rows(spark):
    long = "word, " * 50_000
    rows = [(1, None, "x", 9), (2, "", "x", 9), (3, "Hello  World's!", "x", 9), (3, "Hello  World's!", "x", 9), (4, long, "x", 9), (None, " ", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, n_tokens int")
    got = [tuple(r) for r in count_tokens(df, PATH, 2048).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()]
    want = [(i, len((t or "").encode()), by_library(t), by_library(t) > 2048) for i, t, *_ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert count_tokens(df.limit(0), PATH, 2048).count() == 0
