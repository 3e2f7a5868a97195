"""Tokens, media, decontamination, mixing and the pipeline: round trips, brute force, odd inputs."""

import os
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.llm import decontam, media, mixing, tokens

SF = "/root/testdata/sf0.001"
TEXTS = ["", " ", "  a", "a ", "a  b", "a \n b\n\n c", "it's x's  \t y", "<|endoftext|> a<|endoftext|>b", "\x1c a \x85 b", " \n", "x\n", "été, fußball. 日本語, 𝒳𝒴 ab١٢ İ x́y ªº ǅ ʰ", "word " * 20_000]
public = pytest.importorskip("public_tokenizers")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=1500), st.sampled_from([4, 8, 16]))
def test_dac_gives_any_token(ids, bits):
    f = tokens.DacFile(tokens.dac_encode(np.array(ids, dtype=np.uint32), np.array([0, len(ids)]), [None], 0, bits))
    assert f.all().tolist() == ids and [f[i] for i in range(0, len(ids), 97)] == ids[::97]
    with pytest.raises(IndexError):
        f[len(ids)]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab ,.'\n\té日1  x")), max_size=60))
def test_units_encode_like_the_library(text):
    ids, _ = tokens.encoder(tokens.default_tokenizer()).encode([text])
    assert ids.tolist() == library_once().encode(text, add_special_tokens=False).ids


_once = []


def library_once():
    if not _once:
        _once.append(library())
    return _once[0]


def test_token_files(spark):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(1, None), (None, "last"), (4, "twin"), (4, "twin")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, shard int, start string")
    want, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids = [*library_once().encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = tokens.read_tokens(tokens.write_tokens(df, tokens_per_file=50)).orderBy("start").collect()
    assert [tuple(r) for r in got] == want
    assert tokens.read_tokens(tokens.write_tokens(df.limit(0))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_media_round_trip(raw):
    payload = media.pad(raw)
    box = media.mux(payload)
    assert len(payload) % 576 == 0 and len(payload) > 0 and payload.startswith(raw) and set(payload[len(raw) :]) <= {255}
    assert media.samples(box) == payload
    t = media.tracks(box)[0]
    assert t["duration"] == len(payload) // 576 and t["codec"] == "raw " and t["timescale"] == 25
    assert all(box[a : a + 576] == payload[i * 576 : i * 576 + 576] for i, a in zip(t["sync"], t["at"][t["sync"]], strict=True))


def test_media_tables_of_other_writers():
    """Two chunks, sizes that differ, no sync table, 64-bit boxes, a free box and a size to the end."""
    import struct

    full, box = media._full, media._box
    entry = box(b"mp4a", bytes(28))

    def build(at):
        stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stsz", struct.pack(">IIIII", 0, 3, 5, 6, 7)), full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)), full(b"co64", struct.pack(">IQQ", 2, at, at + 20)))
        return box(b"moov", box(b"free", b"zz"), box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 30, 0, 0)), box(b"minf", stbl))))

    head = build(len(build(0)) + 16)
    body = b"aaaaabbbbbb" + b"." * 9 + b"ccccccc"
    data = head + struct.pack(">I4sQ", 1, b"mdat", 16 + len(body)) + body + struct.pack(">I4s", 0, b"skip") + b"rest"
    t = media.tracks(data)[0]
    assert media.samples(data) == b"aaaaabbbbbbccccccc" and t["codec"] == "mp4a" and t["sync"].tolist() == [0, 1, 2]


def test_fragmented_media():
    """Two fragments of two tracks: sizes by sample, by track default and by header default; sync from flags; sound has no picture size."""
    import struct

    full, box = media._full, media._box

    def track(number, handler, kind, entry):
        stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(kind, entry)), full(b"stsz", struct.pack(">II", 0, 0)), full(b"stsc", struct.pack(">I", 0)), full(b"stco", struct.pack(">I", 0)))
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0)), full(b"hdlr", bytes(4), handler, bytes(12), b"x\0"), box(b"minf", stbl))
        return box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, number, 0, 0), bytes(60)), mdia)

    video = bytes(24) + struct.pack(">HH", 64, 48) + bytes(50)
    sound = bytes(24) + struct.pack(">HH", 999, 999) + bytes(10)
    moov = box(b"moov", track(1, b"vide", b"avc1", video), track(2, b"soun", b"mp4a", sound), box(b"mvex", full(b"trex", struct.pack(">IIIII", 1, 1, 40, 0, 0x10000)), full(b"trex", struct.pack(">IIIII", 2, 1, 20, 3, 0))))

    def moof(length):
        # video: first sample by its own flags, sizes by sample; sound follows on at once, with the track's size
        one = box(b"traf", full(b"tfhd", struct.pack(">I", 1), flags=0x20000), full(b"trun", struct.pack(">IiIII", 2, length + 8, 0, 5, 7), flags=0x1 | 0x4 | 0x200))
        two = box(b"traf", full(b"tfhd", struct.pack(">II", 2, 0x0), flags=0x20), full(b"trun", struct.pack(">I", 2)))
        return box(b"moof", full(b"mfhd", struct.pack(">I", 1)), one, two)

    part = moof(len(moof(0)))
    body = b"vvvvvwwwwwww" + b"aaabbb"
    data = moov + part + box(b"mdat", body) + part + box(b"mdat", body.upper())
    picture, voice = media.tracks(data)
    assert media.samples(data) == b"vvvvvwwwwwwwVVVVVWWWWWWW" and picture["sync"].tolist() == [0, 2] and picture["duration"] == 160
    assert (picture["width"], picture["height"], voice["width"], voice["height"], voice["codec"]) == (64, 48, 0, 0, "mp4a")
    assert b"".join(data[a : a + n] for a, n in zip(voice["at"].tolist(), voice["sizes"].tolist(), strict=True)) == b"aaabbbAAABBB" and voice["sync"].tolist() == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        media.tracks(data[:-3])


def test_probe_survives_bad_media(spark):
    good = media.mux(media.pad(b"abc" * 1000))
    rows = [(1, good), (2, b"xx"), (3, None), (4, good[:300]), (5, b""), (6, good[:-1])]
    got = {r["doc_id"]: r for r in media.probe(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[1]["error"] is None and [tuple(k) for k in got[1]["keyframes"]] == [(good.index(b"abcabc"), good.index(b"abcabc") + 576)]
    assert all(got[i]["error"] for i in (2, 3, 4, 5, 6))


def test_equal_texts_have_equal_media(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "x", 3), (None, "x", 4), (5, "long " * 40_000, 5)], "doc_id long, text string, media int")
    got = {r["doc_id"]: r for r in media.digest(media.store(df)).collect()}
    assert got[1]["media_sha256"] == got[2]["media_sha256"] and got[3]["payload_sha256"] == got[None]["payload_sha256"] and got[5]["n_bytes"] == 200_000
    assert media.digest(media.store(df.limit(0))).count() == 0


def brute_tiles(item, text, least):
    used_p, used_t, out = [False] * len(item), [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and not used_p[p + n] and not used_t[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < least:
            return out
        out.append((p, t, n))
        for i in range(n):
            used_p[p + i] = used_t[t + i] = True


def test_zero_characters_after_a_space():
    for text in ("hello \0abc world", "a b \0", "\0 \0\0 a", "\0a a \0a", " \0"):
        ids, _ = tokens.UnitEncoder(tokens.default_tokenizer()).encode([text, text])
        assert ids.tolist() == library_once().encode(text, add_special_tokens=False).ids * 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abIL ,.'*$(\n\né日ǅªà²1\u2026®<|>")), max_size=40), max_size=12))
def test_units_encode_like_the_library_while_the_memo_forgets(texts):
    enc = tokens.UnitEncoder(tokens.default_tokenizer(), max_units=4)
    for some in (texts, texts[::-1], ["ab a\nab, a", *texts]):
        ids, counts = enc.encode(some)
        want = [library_once().encode(t, add_special_tokens=False).ids for t in some]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_line_ends_make_no_units_of_their_own():
    """Each word is encoded once, whatever stands before and after it, and words met often stay when the memo is full."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(3)) for _ in range(30)) for _ in range(30)]
    enc = tokens.UnitEncoder(tokens.default_tokenizer(), max_units=100)
    ids, _ = enc.encode(texts)
    assert ids.tolist() == sum((library_once().encode(t, add_special_tokens=False).ids for t in texts), [])
    assert len(enc.units) <= 3 * len(words)  # at a text's start, after a space, after a line end
    enc.encode([" ".join(f"x{i}" for i in range(100))])
    enc.encode(texts[:1])
    assert enc.joint is not None and len(enc.units) <= 100 and sum(w in enc.units for w in words) >= 20


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=40))
def test_tiling_is_greedy(item, text):
    least = 3
    pairs = [(p, t) for p in range(len(item) - 2) for t in range(len(text) - 2) if item[p : p + 3] == text[t : t + 3]]
    runs = decontam.diagonals(*(np.array([x[k] for x in pairs], dtype=np.int64) for k in (0, 1)), least)
    own, other = np.array(item, dtype=np.int64), np.array(text, dtype=np.int64)
    assert decontam.tile(own, other, runs, least) == brute_tiles(item, text, least)
    assert sorted(zip(*(x.tolist() for x in decontam.swept(own, other, least)), strict=True)) == sorted(zip(*(x.tolist() for x in runs), strict=True))


def test_one_word_repeated_in_item_and_text():
    """A list of seeds would hold 150 million pairs."""
    index = decontam.build([(1, "word " * 3000), (2, "other words than these here")])
    assert index.matches("word " * 50_000, 0.5) == [(1, 1.0, [(0, 0, 3000)])]


def test_short_items_match_whole():
    index = decontam.build([(1, "one"), (2, "Two words"), (3, "a b c d"), (4, "a b c d e"), (5, "")])
    found = lambda text: [(i, tiles) for i, _, tiles in index.matches(text, 0.5)]
    assert found("x a b c d") == [(3, [(0, 1, 4)])]
    assert found("two, words; one a b c") == [(1, [(0, 2, 1)]), (2, [(0, 0, 2)])]
    assert found("words two") == [] and found("") == [] and found("a b c d e") == [(3, [(0, 0, 4)]), (4, [(0, 0, 5)])]


def test_reordered_passages_are_caught(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(24))) for i in range(30)] + [(90, None), (91, "too short"), (92, ""), (3, None), (None, " ".join(word() for _ in range(12)))]
    a = items[4][1].split()
    docs = [(1, "x " + items[3][1].upper() + "! y"), (2, " ".join(a[12:] + ["between"] + a[:12])), (3, " ".join(a[:9])), (4, None), (5, ""), (6, "clean words " * 5000), (None, items[7][1]), (8, items[3][1] + " " + items[5][1]), (9, items[-1][1])]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, item_id int, tiles string")
    for size in (16_000_000, 200):
        found = list(decontam.indexes(spark.createDataFrame(items, "item_id long, text string"), block_bytes=size))
        assert (len(found) > 3) == (size == 200)
        got = sorted([(r["doc_id"], r["item_id"], r["coverage"]) for r in decontam.leaks(df, found).collect()], key=repr)
        assert got == sorted([(1, 3, 1.0), (2, 4, 1.0), (None, 7, 1.0), (8, 3, 1.0), (8, 5, 1.0), (9, None, 1.0)], key=repr)
        kept = decontam.clean(df, found)
        assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]
    assert decontam.leaks(df, []).count() == 0 and decontam.clean(df, []).count() == len(docs)


def brute_targets(sizes, weights, ratio=1.5, most=2.0):
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), ratio * sum(sizes)
    while free:
        total = sum(weights[i] for i in free)
        full = {i for i in free if left * weights[i] / total > most * sizes[i]}
        for i in full or free:
            out[i] = most * sizes[i] if full else left * weights[i] / total
        left -= sum(out[i] for i in full)
        free = free - full if full else set()
    return out


def test_targets(spark):
    rng = random.Random(6)
    for sizes in ([0], [5], [0, 0, 0], [1, 1000, 1, 1000, 7], [rng.randint(0, 1000) for _ in range(12)], [3**k for k in range(12)], [10**9, 1, 1, 1]):
        ranked = spark.createDataFrame(list(enumerate(sizes)), "__rank long, words long")
        got = [r["target"] for r in mixing.with_targets(ranked, mixing.WEIGHTS, 1.5, 2.0).orderBy("__rank").collect()]
        assert got == pytest.approx(brute_targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=6), st.integers(1, 9))
def test_split_is_exact(quotas, shards):
    out = mixing.split(np.array(quotas), shards, 3)
    assert out.sum(axis=0).tolist() == quotas and (out >= 0).all() and out.sum(axis=1).max() - out.sum(axis=1).min() <= 4
    assert (out == mixing.split(np.array(quotas), shards, 3)).all()


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)] + [(None, "x y", "a"), (5000, None, "b"), (5001, "", "zero"), (5002, "u v\x0bw", "c"), (7, rows7 := "t t t", "b"), (7, rows7, "b")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, shard int, size string")
    mix = mixing.plan(df, block_words=500)
    out = mix.assign(mix.sized).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in out) == sorted(count(t) for _, t, _ in rows)
    assert max(len(r["__shards"]) for r in out) <= 2
    taken = {}
    for r in out:
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * len(r["__shards"])
    told = mix.sources.orderBy("__rank").collect()
    assert [r["source"] for r in told] == ["a", "b", "c", "zero", None]
    assert [r["target"] for r in told] == pytest.approx(brute_targets([r["words"] for r in told], [3, 1, 2, 3, 1]))
    for r in told:
        assert abs(taken[r["source"]] - r["target"]) <= max(8, 0.01 * r["words"]), r
    by_shard = {}
    for r in out:
        for k in r["__shards"]:
            by_shard[k] = by_shard.get(k, 0) + r["size"]
    assert len(by_shard) == 4 and max(by_shard.values()) < 2.5 * min(by_shard.values())
    again = mixing.plan(df.repartition(3), block_words=500)
    key = lambda m: sorted((r["__key"], r["__shards"]) for r in m.assign(m.sized).collect())
    assert key(mix) == key(again)
    mixed = mixing.mixed(df, mix, "__shard", "__place")
    assert mixed.count() == sum(len(r["__shards"]) for r in out) and mixed.columns[: len(df.columns)] == df.columns
    empty = mixing.plan(df.limit(0))
    assert mixing.mixed(df.limit(0), empty, "__shard", "__place").count() == 0


def test_mix_of_a_hundred_thousand_sources(spark):
    """More sources than groups and than the driver should hold one by one; every third text without words."""
    docs = spark.range(150_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "").otherwise("a b c").alias("text"), F.concat(F.lit("s"), F.col("id") % 100_000).alias("source"))
    mix = mixing.plan(docs, shards=8)
    out = mix.assign(mix.sized)
    told = out.groupBy("source").agg(F.sum(F.col("size") * F.size("__shards")).alias("taken"), F.first("target").alias("target"), F.first("words").alias("words"), F.max(F.size("__shards")).alias("most"))
    assert told.count() == 100_000 == mix.sources.count()
    assert told.where("abs(taken - target) > 3.5 or taken > 2 * words or most > 2").count() == 0
    shards = {r["k"]: r["n"] for r in out.select(F.explode("__shards").alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert len(shards) == 8 and max(shards.values()) < 1.2 * min(shards.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from quillstack.llm.common import table

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        docs = table(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        n.append(docs.count())
    assert n[0] >= n[1] >= n[2] >= n[3] > 0
    assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    out = cp.STAGES[-1][1](spark, docs, SF)
    told = out.agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"), F.max(F.col("start") + F.col("n_tokens")).alias("e")).first()
    assert told["n"] == n[-1] and told["t"] == told["e"]
