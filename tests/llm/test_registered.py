"""The registered queries op6 to op10 and the pipeline on small tables with nulls, empty texts, repeated rows, clashing names and no rows."""

import random
import re
import zlib

import __spark_entry__ as entry
import corpus_pipeline as P
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm.queries import BYTE_BPE

from .test_small_cases import rules

TYPES = {
    "op6_quality": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op7_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op8_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_token_count": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op10_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}
CLASH = ["_id", "_text", "_key", "row", "set", "cell", "pivot", "_row", "_own", "gone", "score", "kept", "source_", "text_"]


def texts():
    rng = random.Random(8)
    en, fr = "the of and to in that was his with for".split(), "le de la et les des en un du une".split()
    some = [" ".join(rng.choices(en if i % 2 else fr, k=rng.randrange(5, 80))) for i in range(60)]
    return [*some, None, "", "  \n ", "12 34 !!", some[0], some[0], some[1].upper(), "<|endoftext|> x", "w " * 5000, "ligne\n" * 40]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """(with rows, without) of small tables."""
    out = []
    t = texts()
    docs = [(i, x, ("en" if i % 2 else "fr") if i < 60 else None, f"s{i % 3}" if i % 7 else None, len(x or "")) for i, x in enumerate(t)] + [(0, t[0], "fr", "s0", 1), (None, "the of and a null id", "en", None, None)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(40)] + [(41, 5, None), (None, 1, 1)]
    for n, (d, l) in enumerate(((docs, labels), ([], []))):
        at = tmp_path_factory.mktemp(f"small{n}")
        df = spark.createDataFrame(d, "doc_id long, text string, lang string, source string, n_chars long")
        df.select("*", *(F.lit(7).alias(c) for c in CLASH)).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(l, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        out.append((str(at), d))
    return out


@pytest.mark.parametrize("name", sorted(TYPES))
def test_columns_and_rows(spark, folders, name):
    for at, rows in folders:
        out = entry.queries()[name](spark, at)
        kinds = {f.name: f.dataType.simpleString() for f in out.schema}
        assert TYPES[name].items() <= kinds.items()
        got = out.collect()
        if name != "op7_packing":
            assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in rows), key=str)
        if not rows:
            assert not got
            continue
        text = {r[0]: r[1] or "" for r in rows}
        for r in got:
            if "held_out" in kinds:
                assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
            if name == "op6_quality":
                want = rules(text[r.doc_id])
                assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
                assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)
            if name == "op8_toxicity":
                assert r.predicted == int(r.score >= 0.5)
            if name == "op9_token_count":
                n = len(Tokenizer.from_file(public_tokenizers.path(BYTE_BPE)).encode(text[r.doc_id], add_special_tokens=False).ids) if r.doc_id in (1, 60, 61, 67, 68, None) else r.n_tokens
                assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 1024)
            if name == "op10_language_id":
                letters = re.search(r"[^\W\d_]", text[r.doc_id])
                assert r.lang_pred in ({"en", "fr"} if letters else {"und"})


def test_pipeline_runs(spark, folders):
    for at, rows in folders:
        out = P.run(spark, at)
        got = out.collect()
        assert {"doc_id", "start", "length", "ids", "sequence_id", "offset"} <= set(out.columns)
        assert {r.doc_id for r in got} <= {r[0] for r in rows} and bool(got) == bool(rows)


def test_stages_keep_the_columns(spark, folders):
    for at, rows in folders:
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for name, stage in P.STAGES[:-1]:
            now = stage(spark, docs, at)
            assert now.columns == docs.columns, name
            assert now.exceptAll(docs).isEmpty(), name  # rows only go
