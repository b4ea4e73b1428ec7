"""Corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and
rereads it as the next stage's documents. All but the last return the columns
of the documents they are given.

1. language ID: rejects documents without a letter, or whose best language has
   a pooled probability under ``langid.MIN_SCORE``;
2. toxicity: rejects documents that score 0.5 or more;
3. SimHash near-dedup (3-word shingles, at most 3 bits): one document of each
   component stays, the one with the least id;
4. benchmark decontamination: rejects documents that hold a benchmark item or
   its template with consistent slots;
5. packing: pieces of sequences of at most 4096 tokens, with their ids.

Defined results: nulls, empty and long texts, ties, repeated rows, empty tables
and extra columns are treated as the operators' modules say; an empty table
passes every stage as an empty table.
"""

from __future__ import annotations

from corpusforge.llm import decontam, langid, packing, simhash, toxicity
from corpusforge.llm.common import staged, table
from corpusforge.session import ship_package


def language(spark, docs, sf_dir):
    ship_package(spark)
    return langid.keep_known(docs, langid.fit(docs))


def nontoxic(spark, docs, sf_dir):
    ship_package(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark, docs, sf_dir):
    ship_package(spark)
    return simhash.keep_one(docs, shingle=3, bits=3)


def decontaminate(spark, docs, sf_dir):
    ship_package(spark)
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark, docs, sf_dir):
    import public_tokenizers
    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("toxicity", nontoxic), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("pack", pack)]

#: Trained networks, fingerprints and tokenizer ids are not expressible in SQL;
#: tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
