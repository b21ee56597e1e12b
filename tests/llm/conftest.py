import os
import zlib

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long"
#: null, empty, blank, ties, repeated rows, a null id, and a very long text
EDGES = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (4, " \n\t ", None, "b"),
    (None, "An id that is missing", "en", "c"),
    (5, "The quick brown fox jumps over the lazy dog again and again.", "en", "a"),
    (6, "x" * 50_000 + " " + "Straße été " * 20_000, "de", "a"),
    (7, "\x00퟿ 1234 !!", "fr", "a"),
]


def frame(spark, rows, extra=False):
    rows = [(i, t, lang, src, len(t) if t is not None else None) for i, t, lang, src in rows]
    df = spark.createDataFrame(rows, KINDS)
    if extra:  # names that the operators use for their own columns
        from pyspark.sql import functions as F

        for c in ("score", "predicted", "labels", "lang_pred", "fp", "component_id", "n_words", "slot", "shard", "value", "start", "piece", "length", "found_values"):
            df = df.withColumn(c, F.lit("mine"))
    return df


@pytest.fixture()
def docs(spark):
    return lambda rows=EDGES, extra=False: frame(spark, rows, extra)


@pytest.fixture(scope="session")
def tokenizer():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    if not os.path.exists(path):
        pytest.skip("no vocabulary file")
    return path


@pytest.fixture(autouse=True)
def _clean(spark):
    yield
    from gazetrail.llm import storage

    storage.purge()


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
