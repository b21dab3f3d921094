"""Token counts against the library on whole texts."""

import pytest
from brute import SF
from tokenizers import Tokenizer

from trafficlens.llm.queries import QUERIES, word_tokenizer
from trafficlens.llm.token_counts import TokenCounts, parts_at_spaces, token_counts, whole_tokens

HARD = [
    "It's 'tis dogs' life!! 'LL 'S",
    "ΣΊΣΥΦΟΣ straße İ “quoted”, (x) 1st. a1.",
    "é́. \x1c a\x1db c　d ́a",
    "<|endoftext|> x<|endoftext|>.<|StartofText|><|startoftext|>'s <|end oftext|>",
    "...",
    "a" * 5000,
    "日本語テキスト １２３ ½ \U0001f600\U0001f468‍\U0001f469",
    "　 ",
]


def plain(path, texts):
    found = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [len(e.ids) for e in found]


def check(docs, how):
    rows = docs.select("doc_id", "text").collect()
    want = sorted(
        (r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), n, n > how.limit)
        for r, n in zip(rows, plain(how.tokenizer, [r.text for r in rows]), strict=True)
    )
    got = token_counts(docs, how).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_query_is_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r.doc_id for r in docs), plain(word_tokenizer(), [r.text for r in docs]), strict=True))
    got = QUERIES["op11_token_counts"](spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert {r.doc_id: r.n_tokens for r in got.collect()} == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_hard_texts(spark, name):
    import public_tokenizers

    how = TokenCounts(public_tokenizers.path(name), limit=20)
    check(spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string"), how)


def test_odd_rows(odd_docs):
    check(odd_docs, TokenCounts(word_tokenizer()))


def test_clashing_columns(odd_docs):
    docs = odd_docs.selectExpr("*", "1 AS n_tokens", "'x' AS n_bytes", "'y' AS over_limit")
    assert token_counts(docs, TokenCounts(word_tokenizer())).count() == odd_docs.count()


def test_text_beyond_a_slice(spark):
    text = "It's one  more time. " * 200_000
    row = token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), TokenCounts(word_tokenizer())).first()
    assert (row.n_bytes, row.n_tokens) == (len(text), 200_000 * plain(word_tokenizer(), ["It's one  more time. "])[0])


def test_whole_tokens_are_proved():
    whole = whole_tokens(word_tokenizer())
    tokenizer = Tokenizer.from_file(word_tokenizer())
    assert {"the", "a", "."} <= whole and "thequickbrown" not in whole
    plain_words = sorted(w for w in whole if w.isascii() and w.isalpha())[::40]
    assert all(len(e.ids) == 1 for e in tokenizer.encode_batch(plain_words, add_special_tokens=False))


def test_spaces_are_only_used_where_tokens_end_there():
    import public_tokenizers

    assert parts_at_spaces(word_tokenizer())
    assert not parts_at_spaces(public_tokenizers.path("byte_bpe_50k.json"))


def test_empty(no_docs):
    assert token_counts(no_docs, TokenCounts(word_tokenizer())).collect() == []
