import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.functions import sampling, text, vectors
from quillstack.operators.chunks import token_windows


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "v string").select(*columns).first()


def test_blank_family(spark):
    rows = spark.createDataFrame([(None,), ("",), ("  ",), ("\t",), ("\n",), (" ",), (" a ",)], "v string").select(text.is_blank("v").alias("b")).collect()
    assert [r["b"] for r in rows] == [True] * 6 + [False]


def test_clean_html_order(spark):
    assert one(spark, "<p>a &amp;lt; b&nbsp;c</p>\n d", text.clean_html("v"))[0] == "a < b c d"
    assert one(spark, "NaN", text.clean_html("v"))[0] == ""


def test_chunks_cover_and_overlap(spark):
    for n in (0, 1, 99, 100, 101, 180, 181, 500):
        words = [f"w{i}" for i in range(n)]
        got = one(spark, " ".join(words), text.chunk_words(text.words("v")))[0]
        want, start = [], 0
        while words and (not want or start < n):
            want.append(" ".join(words[start : start + 100]))
            if start + 100 >= n:
                break
            start += 80
        assert got == want


def test_folding(spark):
    assert one(spark, " 1ª  CÂMARA – Ação n° 3 ", text.fold_query("v"))[0] == "1a camara – acao no 3"
    assert one(spark, "Straße..  ", text.fold_diagnostic("v"))[0] == "strasse"
    for s in ("ﬁn ŉ ΑΣ ος", "ſtop ẞ ß", "plain ÁÉ"):
        assert one(spark, s, text.case_folded("v"))[0] == s.casefold()
    assert text._case_folding()["ﬁ"] == "fi"


def test_acronyms(spark):
    r = one(spark, "Serviço (Sesx/MS, CNPJ 03.560) e outro (que incorporou) (ANTX; em Liquidação)", text.all_acronyms("v"))[0]
    assert r == ["Sesx/MS", "ANTX"]
    assert one(spark, "x (A) (CFP).", text.base_identity("v"))[0] == "x"


def test_mentions_treats_slash_as_a_letter(spark):
    row = spark.createDataFrame([("a sesc/ms b", "sesc"), ("a sesc, b", "sesc"), ("a sesc/ms b", "sesc/ms")], "t string, x string").select(text.mentions("t", "x").alias("m")).collect()
    assert [r["m"] for r in row] == [False, True, True]


def test_stem(spark):
    rows = spark.createDataFrame([("representacoes",), ("representacao",), ("casas",)], "v string").select(text.stem("v").alias("s")).collect()
    assert [r["s"] for r in rows] == ["representa", "representa", "casas"]


class Words:
    def encode(self, t):
        return t.split()

    def decode(self, ids):
        return " ".join(ids)


class Marked(Words):
    """A tokenizer that says how many special tokens it adds."""

    def num_special_tokens_to_add(self, pair):
        return 9


def test_windows_leave_room_for_the_tokenizers_own_special_tokens():
    out = token_windows(" ".join(f"t{i}" for i in range(300)), Marked(), 64, 8)
    assert max(len(w.split()) for w in out) == 64 - 9 - 4


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 600))
def test_token_windows(n):
    ids = [f"t{i}" for i in range(n)]
    out = token_windows(" ".join(ids), Words(), 128, 16)
    assert all(len(w.split()) <= 122 for w in out)
    assert {t for w in out for t in w.split()} == set(ids)


def test_sample_sizes():
    assert round(sampling.base_size(), 2) == 96.04
    assert [sampling.sample_size(n) for n in (0, 1, 200, 290, 10**9)] == [0, 1, 66, 73, 97]
    assert sampling.derived_seed(1, "a") == int.from_bytes(hashlib.sha256(b"1\x1fa").digest()[:8], "big")


def test_hashed_bag_has_length_one(spark):
    r = spark.createDataFrame([("a b a",), ("",)], "v string").select(vectors.hashed_bag(text.words("v"), 8).alias("x")).select(vectors.norm("x").alias("n")).collect()
    assert abs(r[0]["n"] - 1) < 1e-9 and r[1]["n"] == 0


def test_samples_differ_by_group_and_seed(spark):
    df = spark.range(200).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("g"), "id")
    pick = lambda seed: {(r["g"], r["id"]) for r in sampling.sampled(df, ["g"], "id", F.lit(20), seed).collect()}
    first = pick(1)
    assert first == pick(1) != pick(2)
    assert {i for g, i in first if g == "a"} != {i for g, i in first if g == "b"}
