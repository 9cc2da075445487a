"""Each operator and stage on odd tables: nulls anywhere, empty and very long texts, repeated rows, clashing names, no rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from foliospark.llm import exact, langid, lm_score, mixing, pii, quality_rules, sentencepiece, simhash, site_quality, token_counts

corpus_pipeline = pytest.importorskip("corpus_pipeline")

LONG = " ".join(f"word{i % 5000} and{i % 7}" for i in range(60_000))
ROWS = [(1, LONG, "en", "a"), (1, LONG, "en", "a"), (2, None, None, None), (3, "", "en", "b"), (None, "x y z", "de", "a"), (None, None, None, None), (4, " \t\n ", "de", "b"), (5, "one two three four five six. Seven eight nine ten eleven twelve.", "en", None), (6, "one two three", "de", "b")]
#: Names that the operators use for themselves.
CLASHING = ["fp", "h", "norm", "size", "target", "copies", "tie", "part", "score", "kept", "host", "path", "label", "token_ids", "n_tokens", "n_words", "votes", "row", "key", "salt", "window", "word", "words", "id", "k", "v", "keep_0", "component_id", "held_out"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.select("*", *(F.lit(n).alias(n) for n in CLASHING)).cache()


MODEL, VOCABULARY = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
OPERATORS = {
    "simhash": simhash.near_duplicates,
    "mixing": mixing.mixed,
    "language": langid.identified,
    "lm": lm_score.scored,
    "exact": exact.exact_duplicates,
    "site": lambda df: site_quality.judged(df, df.select("doc_id", F.lit(1).alias("quality"))),
    "rules": quality_rules.judged,
    "pieces": lambda df: sentencepiece.encoded(df, MODEL),
    "pii": lambda df: pii.pseudonymised(df, b"k"),
    "tokens": lambda df: token_counts.counted(df, VOCABULARY),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(docs, name):
    got = OPERATORS[name](docs)
    assert sorted(str(r.doc_id) for r in got.select("doc_id").collect()) == sorted(str(r[0]) for r in ROWS)
    assert OPERATORS[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out, none = stage(spark, docs, ""), stage(spark, docs.limit(0), "")
    assert none.count() == 0 and out.count() <= 3 * len(ROWS)
    if name != "SentencePiece":
        assert out.columns == docs.columns == none.columns
        assert {str(r.doc_id) for r in out.select("doc_id").collect()} <= {str(r[0]) for r in ROWS}
