"""Token counts against the tokenizers library's unigram model."""

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from almanac.llm import queries, tokens

VOCAB = tokens.load_vocabulary(queries.tokenizer("piece_bpe_32k.model"))


def library(vocab):
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokens.MARK, prepend_scheme="always", split=True)
    return t


TOK, MINE = library(VOCAB), tokens.Counter(VOCAB)
TIES = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("bb", -2.0), (tokens.MARK, -1.0), (tokens.MARK + "a", -2.0), *[(f"<0x{i:02X}>", -9.0) for i in range(256)]]
TIE_TOK, TIE_MINE = library(TIES), tokens.Counter(TIES)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("theandof .\n ▁éüß")), st.characters(exclude_categories=["Cs"])), max_size=50))
def test_counts_are_the_librarys(text):
    assert MINE.count(text) == len(TOK.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab é", max_size=30))
def test_ties_go_as_in_the_library(text):
    assert TIE_MINE.count(text) == len(TIE_TOK.encode(text, add_special_tokens=False).ids)


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r.n_tokens for r in queries.op3_token_counts(spark, d).collect()}
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id] == len(TOK.encode(r.text, add_special_tokens=False).ids)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a b", 1), (3, "x" * 100000, 1), (3, "x" * 100000, 1)], "doc_id long, text string, n_tokens int")
    out = tokens.token_counts(df, queries.tokenizer("piece_bpe_32k.model"))
    assert sorted(((r.doc_id or 0), r.n_tokens) for r in out.collect())[:3] == [(0, 2), (1, 0), (2, 0)]
    assert out.count() == 5 and out.where("false").collect() == []
