"""The pipeline's stages against brute force, and the entry without the subpackage."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers

import corpus_pipeline
from corpusforge.llm import simhash
from corpusforge.llm.common import staged
from tests.llm import messy
from tests.llm.test_simhash import brute_components, brute_fp

SF = "/root/testdata/sf0.001"


def test_stages_work_on_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns = {r["doc_id"]: r for r in docs.collect()}, docs.columns
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), "t")
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in docs.collect()}
        assert all(after[i] == before[i] for i in after)
        gone = set(before) - set(after)
        if name == "language":
            assert len(gone) <= 2
        elif name == "toxicity":
            assert 0 < len(gone) < 0.2 * len(before)
        elif name == "near_dedup":
            fps = {i: brute_fp(r["text"]) for i, r in before.items()}
            root = brute_components(fps.values())
            least = {}
            for i in sorted(fps):
                least.setdefault(root[fps[i]], i)
            assert set(after) == set(least.values())
        else:
            assert {i for i, r in before.items() if any(t in r["text"] for t in items)} <= gone
        before = after
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    parts = {}
    for r in got:
        parts.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    assert {i: b"".join(b for _, b in sorted(p)) for i, p in parts.items()} == {
        i: np.array([*tok.encode(r["text"], add_special_tokens=False).ids, 2], "<u4").tobytes() for i, r in before.items()}
    run = corpus_pipeline.run(spark, SF).drop("ids").collect()
    assert Counter((r["doc_id"], r["start"], r["length"]) for r in run) == Counter((r["doc_id"], r["start"], r["length"]) for r in got)


def test_stages_take_awkward_and_empty_documents(spark):
    for docs in (messy.table(spark), messy.table(spark).limit(0)):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = staged(stage(spark, docs, SF), "t")
            assert docs.columns == columns
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()
    assert simhash.keep_one(messy.table(spark)).count() <= len(messy.rows())


def test_entry_without_the_subpackage():
    code = ("import sys\n"
            "class Gone:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name == 'corpus_pipeline' or name.startswith('corpusforge.llm'):\n"
            "            raise ModuleNotFoundError(name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "q, s = e.queries(), e.oracle_sql()\n"
            "assert q and s and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q)\n")
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], check=True, timeout=120)
