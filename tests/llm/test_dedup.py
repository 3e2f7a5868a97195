"""Suffix, near-duplicate and line dedup against brute force."""

import hashlib
import os
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.llm import common, graph, linededup, neardup, suffix
from quillstack.llm.graph import components, least_labels

SF = "/root/testdata/sf0.01"
LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor "


def brute_gone(rows, n=50):
    """(id, bytes, a 1 for each byte that goes), in the rows' order."""
    first = {}
    key = lambda d: (d is None, d or 0)
    for d, t in sorted(rows, key=lambda r: key(r[0])):
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            first.setdefault(b[i : i + n], d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if key(first[b[i : i + n]]) < key(d):
                gone[i : i + n] = b"\1" * n
        out.append((d, b, bytes(gone)))
    return out


def brute_repeats(rows, n=50):
    return sorted(((d, len(b), bytes(x for x, g in zip(b, gone, strict=True) if not g)) for d, b, gone in brute_gone(rows, n)), key=repr)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "dé", "ο", "\0", "zz", "epsilon", "of", "the"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [text(14) for _ in range(4)]
    rows = [(i, text(rng.randint(0, 40)) + "".join(rng.choice(shared) for _ in range(rng.randint(0, 3))) + text(rng.randint(0, 9))) for i in range(n)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    return [*rows, (200, None), (201, ""), (202, "x" * 49), (203, "ab" * 4000), (204, "ab" * 3000), (None, shared[0]), (7, rows[7][1]), (7, rows[7][1])]


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffix_is_exact(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, part string, kept int")
    got = suffix.remove_repeats(df).collect()
    assert sorted([(r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in got], key=repr) == brute_repeats(rows)
    assert all(s["begin"] < s["end"] for r in got for s in r["spans"])
    assert suffix.remove_repeats(df.limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=50, max_size=79), min_size=1, max_size=12, unique=True), st.integers(60, 400))
def test_merged_transforms_find_all_repeats(texts, shard):
    strings = [t.encode() for t in texts]
    least = np.arange(len(strings))
    got = suffix.repeats(strings, least, 50, shard)
    first = {}
    for i, s in enumerate(strings):
        for k in range(len(s) - 49):
            first.setdefault(s[k : k + 50], i)
    assert [g.tolist() for g in got] == [[first[s[k : k + 50]] for k in range(len(s) - 49)] for s in strings]


def test_merge_sorts_a_bucket_few_times(monkeypatch):
    """Naming the transforms' symbols sorts and searches nothing: what is handed to sorts is the iterations' own, about one a three bytes."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    strings = sorted({" ".join(rng.choice(words) for _ in range(14))[:70].encode() for _ in range(4000)})
    strings += [s[5:65] for s in strings[:500]]
    handed = []
    for name in ("argsort", "unique", "searchsorted"):
        real = getattr(np, name)
        monkeypatch.setattr(np, name, lambda a, *more, real=real, **kw: handed.append(max(np.size(a), *map(np.size, more[:1]))) or real(a, *more, **kw))
    got = suffix.repeats(strings, np.arange(len(strings)))
    monkeypatch.undo()
    assert sum(handed) < 30 * sum(len(s) + 1 for s in strings)
    first = {}
    for i, s in enumerate(strings):
        for k in range(len(s) - 49):
            first.setdefault(s[k : k + 50], i)
    assert [g.tolist() for g in got] == [[first[s[k : k + 50]] for k in range(len(s) - 49)] for s in strings]


def test_merge_moves_only_windows_that_may_repeat(monkeypatch):
    """Rotations that end at no whole window, and those already alone, are not sorted again in each iteration."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    strings = sorted({" ".join(rng.choice(words) for _ in range(14))[:70].encode() for _ in range(4000)})
    strings += [s[5:65] for s in strings[:500]]
    handed, real = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *more, **kw: handed.append(np.size(a)) or real(a, *more, **kw))
    got = suffix.repeats(strings, np.arange(len(strings)))
    monkeypatch.undo()
    assert sum(handed) < 10 * sum(len(s) + 1 for s in strings)
    first = {}
    for i, s in enumerate(strings):
        for k in range(len(s) - 49):
            first.setdefault(s[k : k + 50], i)
    assert [g.tolist() for g in got] == [[first[s[k : k + 50]] for k in range(len(s) - 49)] for s in strings]


def test_bag_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    a = {int(k): int(w) for k, w in zip(rng.integers(1, 1 << 40, 300), rng.integers(1, 40, 300), strict=True)}
    b = {k: max(1, w - int(rng.integers(0, 8))) for i, (k, w) in enumerate(a.items()) if i % 9}
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in {*a, *b}) / sum(max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b})
    doc, element = np.r_[np.zeros(len(a), int), np.ones(len(b), int)], np.array([*a, *b], dtype=np.uint64)
    weight = np.array([*a.values(), *b.values()])
    same = [np.mean(np.equal(*neardup.bag_minhash(doc, element, weight, 2, 256, seed))) for seed in range(40)]
    assert abs(np.mean(same) - want) < 0.02


def brute_classes(rows, least=0.8):
    bags = [set(np.frombuffer(b, np.uint64).tolist()) for b in neardup.bags([t for _, t in rows])]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(bags[i] & bags[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or (bags[i] or bags[j]) and both / len(bags[i] | bags[j]) >= least:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(((d, min((x for x in g if x is not None), default=None)) for g in groups.values() for d in g), key=repr)


def near_rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(60, 120))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    return [*rows, (300, None), (301, ""), (302, "one two"), (303, "One, two!"), (304, "a b a b " * 300), (305, "a b a b " * 310), (None, rows[0][1]), (5, rows[5][1])]


def test_near_duplicates_match_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, node int, bands string")
    got = neardup.near_duplicates(df)
    # copies in words alone (case, signs) share a multiset
    assert sorted([(r["doc_id"], r["class_id"]) for r in got.collect()], key=repr) == brute_classes(rows)
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in brute_classes(rows)})
    assert neardup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_near_duplicates_of_a_whole_table(spark):
    """All pairs of the table's texts, compared exactly, have the same classes: no true pair is missed there and no other linked."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    bags = neardup.bags([r["text"] for r in rows])
    share = neardup.overlaps(bags, bags)
    node, least = least_labels(*(x[np.nonzero(share >= 0.8)[k]] for k, x in ((0, np.array([r["doc_id"] for r in rows])), (1, np.array([r["doc_id"] for r in rows])))))
    want = dict(zip(node.tolist(), least.tolist(), strict=True))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got == {r["doc_id"]: want.get(r["doc_id"], r["doc_id"]) for r in rows}
    pairs = np.triu(share >= 0.8, 1)
    assert pairs.sum() > 20 and len({*got.values()}) < len(rows)


def test_unlike_texts_under_one_id_all_stay(spark):
    """Null and repeated ids hold several classes; each class keeps one row."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, text("b") + " more"), (7, text("c")), (7, text("d")), (7, text("d")), (8, text("d")), (None, text("c"))]
    kept = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"][:2]) for r in kept), key=repr) == [(7, "c0"), (7, "d0"), (None, "a0"), (None, "b0")]


def test_texts_without_words_are_like_equal_ones_only(spark):
    rows = [(1, "!!!"), (2, "--- ---"), (3, "\U0001f600"), (4, "!!!"), (5, ""), (6, None), (7, "***\n***"), (8, "word")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(df).collect()), key=repr) == brute_classes(rows)
    assert sorted(r["doc_id"] for r in neardup.drop_near_duplicates(df).collect()) == [1, 2, 3, 5, 7, 8]


def test_large_bands_are_searched_in_place(spark):
    """A hub that all resemble while they don't resemble each other, in one class."""
    rng = random.Random(9)
    hub = [f"h{i}" for i in range(100)]
    rows = [(0, " ".join(hub))]
    for i in range(1, 60):
        words = list(hub)
        for k in rng.sample(range(100), 2):
            words[k] = f"x{i}{k}"
        rows.append((i, " ".join(words)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=repr) == brute_classes(rows)


def test_overlaps_of_bags_of_any_size_are_exact():
    """Bags of 10 to 60000 marks in one block: every pair's share is that of the pair alone."""
    rng = np.random.default_rng(3)
    bag = lambda n: np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    left = [bag(n) for n in (10, 150, 150, 3000, 60000)] + [bag(0)]
    right = [np.unique(np.r_[b[: len(b) * 9 // 10], bag(len(b) // 10)]) for b in left] + [bag(400)]
    got = neardup.overlaps([b.tobytes() for b in left], [b.tobytes() for b in right], 1000)
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            if len(x) and len(y):
                assert got[i, j] == pytest.approx(neardup.similarity(x.tobytes(), y.tobytes()))


def test_components_of_a_long_path(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    for each, native in ((7, False), (1000, False), (1, True), (1000, True)):  # dealt to many tasks, or in one
        assert sorted((r["node"], r["class"]) for r in components(edges, each, native).collect()) == [(i, 0) for i in range(41)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, s, k):
    s = list(s)
    for _ in range(k):
        i = rng.randrange(len(s))
        kind = rng.randrange(3)
        s[i : i + (kind != 2)] = [] if kind == 0 else [rng.choice("abcé")]
    return "".join(s)


def test_banded_distance(spark):
    rng = random.Random(2)
    rows = []
    while len(rows) < 600:
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(20, 45)))
        a, b = sorted((a, changed(rng, a, rng.randint(0, 4))), key=len, reverse=True)
        if len(a) - len(b) <= 2 and len(b) >= 20:
            rows.append((a, b, min(3, distance(a, b))))
    got = spark.createDataFrame(rows, "p string, t string, d int").select("d", F.least(F.lit(3), F.expr(linededup.within("split(p, '')", "split(t, '')", 2))).alias("e")).collect()
    assert all(r["d"] == r["e"] for r in got)


def read_line(line):
    """(reading, symbols) as the operator's contract has them."""
    words = line.split(" ")
    return (1, words) if len(line) >= 60 and len(line) <= 12 * len(words) else (0, list(line))


def line_limit(kind, n):
    own = ((60, 6), (50, 5), (40, 4), (30, 3), (20, 2), (5, 1)) if kind else ((80, 4), (60, 3), (20, 2), (5, 1))
    return next((k for least, k in own if n >= least), 0)


def linked(a, b):
    """The distance of two lines that are linked, else None."""
    (ka, x), (kb, y) = read_line(a), read_line(b)
    if min(len(a), len(b)) < 60:
        ka, x, kb, y = 0, list(a), 0, list(b)
    most = line_limit(ka, min(len(x), len(y)))
    if ka != kb or abs(len(x) - len(y)) > most or len({*x} - {*y}) > most or len({*y} - {*x}) > most:
        return None
    d = distance(x, y)
    return d if d <= most else None


def line_roots(known):
    root = {x: x for x in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(known):
        for b in known[:i]:
            if find(a) != find(b) and linked(a, b) is not None:
                root[find(a)] = find(b)
    return {x: find(x) for x in known}


def brute_lines(rows):
    known = sorted({x for _, t in rows for x in (t or "").split("\n") if x.strip()})
    root = line_roots(known)
    size = {}
    for x in known:
        size[root[x]] = size.get(root[x], 0) + 1
    met, want = {}, {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        kept, near, links = [], 0, 0
        for x in (t or "").split("\n"):
            first = met.setdefault(root[x], x) if x.strip() and root[x] in met else None
            if first is None:
                kept.append(x)
            near += first is not None and first != x
            if x.strip():
                met.setdefault(root[x], x)
                links += size[root[x]] > 1
        want[d] = ("\n".join(kept), near, links)
    return want


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    lines = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(4, 30))) for _ in range(60)]
    lines += [" ".join(rng.choice(words) for _ in range(rng.randint(10, 50))) for _ in range(30)]
    for _ in range(200):
        base = rng.choice(lines)
        if len(base) < 60:
            lines.append(changed(rng, base, rng.randint(1, 3)))
        else:
            own = base.split(" ")
            for _ in range(rng.randint(1, 2)):
                own[rng.randrange(len(own))] = rng.choice(words)
            lines.append(" ".join(own))
    lines += ["", "short", "shor", "  ", "Copyright 2024 X.", "Copyright 2025 X.", "1234", "1235"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 10)))) for i in range(90)] + [(None, lines[0]), (900, None), (901, "\n\n"), (902, "long " * 3000), (903, "\n".join(lines[-8:]))]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, line int, at string")
    out = linededup.dedup_lines(df)
    want = brute_lines(rows)
    got = {r["doc_id"]: (r["kept"], r["n_near"], r["n_links"]) for r in out.collect()}
    assert got == want
    assert sum(near for _, near, _ in want.values()) > 30
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    assert linededup.dedup_lines(df.limit(0)).count() == 0
    copy = hashlib.sha256(want[0][0].encode()).hexdigest()
    assert out.where("doc_id = 0").select(F.sha2("kept", 256)).first()[0] == copy


def test_line_limit_grows_with_length(spark):
    """Every pair within the limit of its shorter line is in one class, with spaces or without, at all borders of length, and links tell their distance."""
    rng = random.Random(11)
    lines = set()
    for n in [4, 5, 6, 10, 19, 20, 21, 40, 57, 58, 59, 60, 61, 62, 79, 80, 100, 160, 240]:
        for alphabet in ("abcdefé     ", "bcdfghjklé", "aeinrst"):
            base = "".join(rng.choice(alphabet) for _ in range(n - 1)) + "b"
            lines |= {base} | {changed(rng, base, m) for m in (1, 2, 2, 3, 4, 5)}
    for n in (9, 10, 19, 20, 29, 30, 39, 40, 41, 49, 50, 59, 60, 61, 79, 80, 81, 100, 180):
        base = [rng.choice(["alpha", "be", "gamma", "delta", "epsilon", "z"]) + str(rng.randrange(30)) for _ in range(n)]
        for m in (0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 6, 6, 7):
            own = list(base)
            for _ in range(m):
                i = rng.randrange(len(own))
                own[i : i + rng.choice((0, 1, 1))] = [] if rng.random() < 0.3 else [f"new{rng.randrange(100)}"]
            lines.add(" ".join(own))
        # evenly spread changes leave the shortest runs
        step = max(1, n // (line_limit(1, n) + 1))
        lines.add(" ".join("#" if i % step == step - 1 and i // step < line_limit(1, n) else w for i, w in enumerate(base)))
    lines = sorted(x for x in lines if x.strip())
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    steps = linededup.LineDuplicates(df)
    name = {r["line_id"]: r["line"] for r in steps.lines.collect()}
    links, classes = steps.links()
    root, found = line_roots(lines), {x: x for x in lines} | {name[r["node"]]: name[r["class"]] for r in classes.collect()}
    groups = lambda of: sorted(sorted(x for x in lines if of[x] == r) for r in {*of.values()})
    assert groups(found) == groups(root)
    assert sum(len(g) > 1 and len(g[0]) >= 60 for g in groups(root)) > 20
    told = [(name[r["a"]], name[r["b"]], r["edits"]) for r in links.collect()]
    assert all(e == linked(a, b) for a, b, e in told)


def test_counts_of_symbols_bound_the_distance(spark):
    """Counts of any size, also above 255 and in the last byte, never tell lines apart that are near."""
    lines = ["w " * 999 + "end", "w " * 1000 + "end", "w " * 255 + "a b c d e f g h", "w " * 256 + "a b c d e f g h", "a b " * 130, "x y z " * 300, "x y z " * 300 + "q"]
    steps = linededup.LineDuplicates(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    told = steps.sketched(steps.lines.select("line_id"))
    both = told.toDF("x", "kx", "sx", "cx").crossJoin(told.toDF("y", "ky", "sy", "cy")).select("x", "y", linededup.counts_apart("cx", "cy").alias("d")).collect()
    name = {r["line_id"]: r["line"] for r in steps.lines.collect()}
    near = {(name[r["x"]], name[r["y"]]): r["d"] for r in both}
    assert len(near) == 49 and near[lines[0], lines[1]] == 1 and near[lines[2], lines[3]] == 1 and near[lines[5], lines[6]] == 2 and near[lines[0], lines[5]] > 12


def test_keys_of_lines_run_in_methods_that_are_compiled(spark):
    """The JVM leaves methods of over 8000 bytes to its interpreter; the classes of length give the same values as their table."""
    lines = spark.createDataFrame([(1, "a line of text", 14)], "line_id long, line string, n int")
    two = spark.range(1).selectExpr("id AS a", "id + 1 AS b")
    for df in (linededup.line_keys(lines), two.select(linededup.counts_apart("a", "b").alias("d")).where("d < 9")):
        told = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", told)]
        assert sizes and max(sizes) < 8000
    sizes = spark.range(200).select(F.col("id").cast("int").alias("n"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    for r in sizes.select("n", "k", linededup.limit(F.col("k"), F.col("n")).alias("t"), linededup.layout(F.col("k"), F.col("n")).alias("b")).collect():
        own = [c for c in linededup.CLASSES[r["k"]] if r["n"] >= c[0]]
        assert r["t"] == (own[-1][1] if own else 0) == line_limit(r["k"], r["n"])
        assert r["b"] == (own[-1][0] + (r["n"] - own[-1][0]) // own[-1][2] * own[-1][2] if own else -1)


def test_families_of_like_lines_make_few_pairs(spark, monkeypatch):
    """n lines that differ in one character: pairs grow with n, also where keys are dealt to several tasks."""
    monkeypatch.setattr(linededup, "FREQUENT", 8)
    counts = []
    for n in (200, 400, 800):
        df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same words again and again "), F.lpad((F.col("id") % 100).cast("string"), 2, "0"), F.lit(" then "), F.floor(F.col("id") / 100).cast("string"), F.lit(" and the end of it")).alias("text"))
        steps = linededup.LineDuplicates(df)
        links, classes = steps.links()
        counts.append(links.count())
        assert classes.select("class").distinct().count() == 1 and classes.count() == n
    assert counts[2] < 6 * counts[0] and counts[2] < 8 * 800


def test_lines_within_their_limit_share_a_key_of_few(spark):
    """Half of the segments are counted from either end, so t edits ask for about t * t / 2 places; lines share a key wherever their edits are."""
    assert [len(linededup.shifts(t)) for t in range(1, 7)] == [2, 5, 8, 13, 18, 25]
    rng, lines = random.Random(3), []
    for n in (6, 11, 20, 25, 31, 40, 45, 50, 57, 60, 66, 79, 80, 101):
        base = [f"some{rng.randrange(10**6)}" for _ in range(n)]
        most = line_limit(1, n)
        for made in range(24):
            own, kind = list(base), made % 4
            for j in range(most):
                at = {0: 0, 1: len(own) - 1, 2: j * n // (most + 1), 3: rng.randrange(len(own))}[made // 4 % 4]
                # inserted, deleted, changed or any of these
                what = rng.randrange(3) if kind == 3 else kind
                own[at : at + (what > 0)] = [] if what == 1 and len(own) > 2 else [f"new{made}at{j}"]
            lines.append((n, " ".join(base), " ".join(own)))
        lines += [(n, a, b) for (m, _, a), (o, _, b) in zip(lines[-24:], lines[-23:], strict=False) if m == o]
    pairs = [(a, b) for _, a, b in lines if a != b and linked(a, b) is not None]
    number = {x: i for i, x in enumerate(sorted({x for pair in pairs for x in pair}))}
    df = spark.createDataFrame([(i, x, len(x)) for x, i in number.items()], "line_id long, line string, n int")
    keys = {}
    for r in linededup.line_keys(df).collect():
        keys.setdefault(r["ref"] // 4, {}).setdefault(r["key"], set()).add(r["ref"] % 2)
    assert len(pairs) > 200
    for a, b in pairs:
        x, y = keys[number[a]], keys[number[b]]
        assert any(1 in x[k] | y[k] for k in x.keys() & y.keys()), (a, b)


def test_lines_that_share_several_keys_alike_meet_in_one(spark):
    """Near copies share most of their segments: one key of two or three lines is enough, and every link is still found."""
    words = [f"word{i}" for i in range(70)]
    lines = [" ".join(f"{w}of{own}" if i != 69 - copy else f"new{copy}" for i, w in enumerate(words)) for own in range(4) for copy in range(2 + own % 2)]
    steps = linededup.LineDuplicates(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    met = steps.met()
    assert met.groupBy("line_id").count().agg(F.max("count")).first()[0] <= 4
    assert met.select("line_id").distinct().count() == len(lines) == 10
    assert steps.every().count() == 2 * 1 + 2 * 3


def test_lines_that_stand_once_are_not_moved(spark):
    """Only lines that stand several times are gathered; each different line is still one."""
    rows = [(i, f"a line of document {i}\nthe same in all\nthe same in {i % 3}\nabc") for i in range(9)]
    steps = linededup.LineDuplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    lines = [r["line"] for r in steps.lines.collect()]
    assert sorted(lines) == sorted({x for _, t in rows for x in t.split("\n") if len(x) >= 5})
    assert {"the same in all", *(f"the same in {i}" for i in range(3))} <= {r["line"] for r in steps.copied.collect()}
    assert steps.copied.count() < 6
    assert steps.seen.count() == 36 and steps.seen.where("again").count() >= 27


def test_line_dedup_leaves_no_shuffle_files(spark, monkeypatch):
    """They go as each step is written, without waiting for the driver's collections."""
    def files():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = (held.apply(i).getName() for i in range(held.size()))
        return {x for x in names if x.startswith("shuffle_")}

    for module in (linededup, graph, common):
        monkeypatch.setattr(module, "cut", lambda df, name="cut": common.table(df, name))
    before = files()
    linededup.dedup_lines(spark.createDataFrame([(i, f"a line that is like others, but for its number {i}\nthe same in all") for i in range(20)], "doc_id long, text string"))
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_lines_are_compared_without_their_texts_on_disk(spark, monkeypatch):
    """When the wide rows are dealt out to their keys, no join has moved them before and the table of lines is gone."""
    df = spark.createDataFrame([(i, f"one two three four five six seven eight nine ten eleven twelve thirteen {i}") for i in range(30)], "doc_id long, text string")
    steps, real, seen = linededup.LineDuplicates(df), linededup.cut, []

    def cut(out, name="cut"):
        if name == "every":
            seen.append((out._jdf.queryExecution().optimizedPlan().toString().count("Join "), os.path.exists(steps.lines.written_at.removeprefix("file:"))))
        return real(out, name)

    monkeypatch.setattr(linededup, "cut", cut)
    assert steps.every().count() == 30 * 29 // 2
    assert seen == [(1, False)]


@pytest.mark.parametrize("written", [linededup.WRITTEN, 7])
def test_every_link_between_different_lines_is_counted(spark, monkeypatch, written):
    """Also links inside a class, where keys are dealt to several tasks and where different words have one character; copies of a line are one."""
    monkeypatch.setattr(linededup, "FREQUENT", 1)
    monkeypatch.setattr(linededup, "SAMPLED", 2)
    monkeypatch.setattr(linededup, "WRITTEN", written)
    rng = random.Random(7)
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen".split()
    lines = [f"Copyright {y} by X." for y in (2019, 2024, 2025)]
    for size in (12, 22, 31):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(own))
                own[i : i + rng.choice((0, 1, 1))] = [rng.choice(words)] * rng.randint(0, 1)
            lines.append(" ".join(own))
    known = sorted({*lines})
    want = {(a, b): linked(a, b) for i, a in enumerate(known) for b in known[i + 1 :] if linked(a, b) is not None}
    degree = {x: sum(x in pair for pair in want) for x in known}
    df = spark.createDataFrame([*enumerate(lines), (900, "\n".join(lines[:5])), (901, None)], "doc_id long, text string")
    steps = linededup.LineDuplicates(df)
    name = {r["line_id"]: r["line"] for r in steps.lines.collect()}
    assert {tuple(sorted((name[r["a"]], name[r["b"]]))): r["edits"] for r in steps.every().collect()} == want
    assert len(want) > len(known)
    out = {r["doc_id"]: r for r in linededup.dedup_lines(df).collect()}
    assert [out[i]["n_pairs"] for i in range(len(lines))] == [degree[x] for x in lines]
    assert out[900]["n_pairs"] == sum(degree[x] for x in lines[:5]) and out[901]["n_pairs"] == 0 and out[901]["classes"] == []
    root = line_roots(known)
    near = [(x, y) for x in range(len(lines)) for y in range(x) if degree[lines[x]] and degree[lines[y]]]
    assert all((out[x]["classes"] == out[y]["classes"]) == (root[lines[x]] == root[lines[y]]) for x, y in near)


def test_links_of_a_family_are_counted_without_a_row_for_each(spark, monkeypatch):
    """Near copies of one line are all linked: each is compared with a centre, so links that are rows grow with the lines, and n_pairs has all."""
    rng, n, real, rows = random.Random(12), 120, linededup.cut, []
    base = [f"word{rng.randrange(900)}" for _ in range(64)]
    lines = [" ".join(base)]
    for i in range(n - 1):
        own = list(base)
        for at in rng.sample(range(64), rng.choice((1, 1, 2, 3))):
            own[at] = f"new{i}at{at}"
        lines.append(" ".join(own))
    # some are too far from each other, though both are near the first
    lines += [" ".join(f"far{i}at{at}" if at % 13 == i else w for at, w in enumerate(base)) for i in range(4)]

    def cut(out, name="cut"):
        held = real(out, name)
        if "edits" in held.columns:
            rows.append(held.count())
        return held

    monkeypatch.setattr(linededup, "cut", cut)
    got = {r["doc_id"]: r["n_pairs"] for r in linededup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    want = [sum(x != y and linked(x, y) is not None for y in lines) for x in lines]
    assert [got[i] for i in range(len(lines))] == want
    assert min(want[:n]) >= n - 1 > max(want[n:]) and rows and max(rows) < 6 * n < n * (n - 1) // 2
