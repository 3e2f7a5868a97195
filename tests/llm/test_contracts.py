"""The registered queries, as a driver calls them: columns, kinds and values on the smallest tables and on an odd one."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstack.llm import queries
from test_data import library_once
from test_dedup import brute_classes, brute_gone, brute_lines

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op2_token_dac": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op3_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_tiling_decontam": {"doc_id": "bigint", "item_id": "bigint", "coverage": "double"},
    "op5_quality_knn": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_iso_media": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op7_mixture_tree": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op8_bagminhash": {"doc_id": "bigint", "class_id": "bigint"},
    "op9_lang_viterbi": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_line_edit_join": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "n_links": "bigint", "kept_sha256": "string"},
}
SENTENCE = "the quick brown fox jumps over the lazy dog and then it sleeps near the old river bank for a while"
TEXTS = [
    (1, SENTENCE + "\nA short line.\n" + SENTENCE), (2, SENTENCE), (3, None), (4, ""), (5, " \n\t"), (6, "!!! ???"), (7, "12 34"), (8, "hello \0abc \x01 world"),
    (9, "wörter über straße " * 3000), (10, SENTENCE + " twice"), (10, SENTENCE + " twice"), (None, SENTENCE), (None, "no id here"), (11, "日本語 текст ελληνικά"), (12, "A short lime.\nother"), (13, "\U0001f600" * 40), (-5, "negative id"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of tables with nulls, empty and long texts, repeats and columns that clash with those the operators make."""
    at = tmp_path_factory.mktemp("odd")
    rows = [(d, t, ["en", None, "de"][i % 3], ["s1", "s2", None][i % 3], i, str(i), float(i), i) for i, (d, t) in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, class_id int, node string, score double, __block int").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, None, None), (9, 1, 1), (10, 0, 0), (None, 1, 1), (999, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, SENTENCE), (2, None), (3, ""), (4, "hello abc"), (None, "no id here")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.fixture(scope="module")
def bare(spark, odd, tmp_path_factory):
    """The same tables without rows."""
    at = tmp_path_factory.mktemp("bare")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def crc(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def by_repr(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_columns_and_rows(spark, odd, bare, name):
    out = queries.QUERIES[name](spark, odd)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = out.collect()
    if name != "op4_tiling_decontam":
        assert by_repr(r["doc_id"] for r in rows) == by_repr(d for d, _ in TEXTS)
    assert queries.QUERIES[name](spark, bare).count() == 0
    check = globals().get(f"check_{name.split('_')[0]}")
    if check:
        check(rows)


def check_op1(rows):
    want = []
    for d, raw, gone in brute_gone(TEXTS):
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        want.append((d, len(raw), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()))
    assert by_repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == by_repr(want)


def check_op2(rows):
    at, want = 0, []
    for d, t in sorted(TEXTS, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids = [*library_once().encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert by_repr((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows) == by_repr(want)


def check_scores(rows, limit):
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit) and r["held_out"] == (crc(r["doc_id"]) % 5 == 0) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 10}) == 1


def check_op3(rows):
    check_scores(rows, 0.5)


def check_op5(rows):
    check_scores(rows, 0.3)


def check_op4(rows):
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(1, 1), (2, 1), (10, 1), (None, 1), (None, None), (8, 4)} and all(0.5 <= r["coverage"] <= 1 for r in rows)


def check_op6(rows):
    want = []
    for d, t in TEXTS:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want.append((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert by_repr((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == by_repr(want)
    assert len({(r["media_sha256"], r["feature"], r["media_bytes"]) for r in rows if r["n_bytes"] == 0}) == 1


def check_op7(rows):
    sizes = {}
    for i, (_, t) in enumerate(TEXTS):
        s = ["s1", "s2", None][i % 3]
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert by_repr((r["doc_id"], r["size"]) for r in rows) == by_repr((d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t in TEXTS)
    assert {r["source_size"] for r in rows} == {*sizes.values()} and all(r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] for r in rows)
    assert abs(sum({r["source_size"]: r["target"] for r in rows}.values()) - 1.5 * sum(sizes.values())) < 1e-6


def check_op8(rows):
    assert by_repr((r["doc_id"], r["class_id"]) for r in rows) == brute_classes(TEXTS)


def check_op9(rows):
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und") and r["held_out"] == (crc(r["doc_id"]) % 4 == 2) for r in rows)
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {3, 4, 5, 6, 7, 13}


def check_op10(rows):
    own = [(d, t) for d, t in TEXTS if d is not None]
    want = {d: (len((t or "").split("\n")), hashlib.sha256(brute_lines(own)[d][0].encode()).hexdigest()) for d, t in own if d != 10}
    assert {r["doc_id"]: (r["n_lines"], r["kept_sha256"]) for r in rows if r["doc_id"] not in (None, 10)} == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", queries.QUERIES)
def test_smallest_tables(spark, name):
    out = queries.QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert out.count() == n if name != "op4_tiling_decontam" else out.count() >= 0
    assert {*COLUMNS[name]} <= {*out.columns}


def test_pipeline_on_odd_rows(spark, odd, bare):
    """Stages keep the columns of documents and the rows they should; repeated and null rows pass without a crash."""
    for folder in (odd, bare):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        kept = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = kept.count()
            kept = stage(spark, kept, folder).cache()
            assert kept.columns == docs.columns, name
            assert name == "mixing" or kept.count() <= before
            assert kept.select("doc_id", "text").distinct().join(docs.select("doc_id", F.col("text").alias("t")), (F.col("text").eqNullSafe(F.col("t"))), "left_anti").count() == 0
        last = corpus_pipeline.STAGES[-1][1](spark, kept, folder)
        assert last.count() == kept.count() and {"doc_id", "start", "n_tokens", "ids_crc32"} <= {*last.columns}
