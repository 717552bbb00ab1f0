"""Ids above 2**53 beside null ids."""

from test_corpus import SCHEMA

from plumeflux.llm import mixing, packing
from plumeflux.llm.queries import vocabulary

LONG = (1 << 53) + 1


def test_long_ids_beside_null(spark):
    rows = [(LONG, "one two", "en", "a", 0), (None, "three four", "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert {r.doc_id for r in mixing.mix_sources(docs).collect()} == {LONG, None}
    assert {r.doc_id for r in packing.pack_documents(docs, vocabulary("word_bpe_49k.json")).collect()} == {LONG, None}
