"""Operators on pairs, against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from compare import database, same
from millrace.llm import jaccard_join, line_dedup, registry, vector_topk

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(name, spark):
    same(registry.QUERIES[name], registry.ORACLE_SQL[name], spark, SF, database(SF))


def components(docs, size=4, percent=85):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^ \t\n\x0b\x0c\r]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set())
    top = list(range(len(docs)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                top[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common_part = [rng.choice(vocabulary) for _ in range(30)]
    docs = [(100, None), (101, ""), (102, " \n"), (103, "One two"), (104, "one TWO"), (105, "one two three"), (99, "one two")]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(40, 70))] for _ in range(12)]
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            w = w[: rng.randint(20, 40)] + common_part
        docs.append((i, " ".join(w)))
    docs += docs[-3:]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, component_id string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame).collect())
    assert got == components(docs)
    assert len({c for _, _, c in got}) < len(got) - 20


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_chains_of_growing_texts(spark, seed):
    """Each text links with those a little longer; pivots of unlike size must not part them."""
    rng = random.Random(seed)
    docs = []
    for start in range(3):
        core = [f"c{i}" for i in range(40)] + [f"w{rng.randrange(10**6)}" for _ in range(200)]
        size = 50
        while size < len(core):
            docs.append((len(docs), " ".join(core[:size])))
            size = int(size * rng.choice([1.03, 1.1, 1.16, 1.2])) + 1
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame).collect())
    assert got == components(docs)


def test_jaccard_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_components(none).count() == 0
    assert jaccard_join.stage(spark, none, SF).count() == 0
    apart = spark.createDataFrame([(1, "a b c d"), (2, "e f g h"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.jaccard_components(apart).collect())) == [(1, 1, 1), (2, 1, 2), (3, 0, 3)]


def test_jaccard_stage_keeps_one_of_each_group(spark):
    docs = [(1, "a b c d e", "en"), (2, "a b c d e", "en"), (2, "a b c d e", "en"), (3, "q r s t", "de"), (3, "q r s t", "de"), (4, "u v w x y z", None)]
    kept = jaccard_join.stage(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string"), SF)
    assert kept.columns == ["doc_id", "text", "lang"] and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_jaccard_stage_links_five_words_at_four_fifths(spark):
    """With pairs that the stage links and the query does not."""
    word = iter(f"w{i}" for i in range(10**6))
    docs = []
    for n, cuts in ((51, 1), (60, 1), (120, 2), (30, 3), (40, 1)):
        w = [next(word) for _ in range(n)]
        x = list(w)
        for k in range(cuts):
            x[(k + 1) * n // (cuts + 1)] = next(word)
        docs += [(len(docs), " ".join(w)), (len(docs) + 1, " ".join(x))]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    at = {k: {d for d, _, c in components(docs, *k) if d == c} for k in ((4, 85), (5, 80))}
    assert at[5, 80] != at[4, 85]
    assert {r["doc_id"] for r in jaccard_join.stage(spark, rows, SF).collect()} == at[5, 80]


def test_jaccard_stage_decides_by_row(spark):
    """Null ids and one id with two texts, together with a repeated row."""
    p, q, r, blank = "a b c d e f", "g h i j k l", "m n o p q r", " \n"
    docs = [(1, p, "en"), (1, p, "en"), (2, p, "en"), (2, q, "en"), (2, r, "de")]  # a copy and two clean texts under one id
    docs += [(3, q, "en"), (4, q.upper(), None), (None, p, "n1"), (None, p, "n1"), (None, "s t u v w", "n2"), (None, None, "n3")]
    docs += [(7, "y z", "en"), (7, "y z", "de"), (8, "only null beside it", "en"), (None, "only null beside it", "n4")]
    docs += [(9, None, "e1"), (9, None, "e1"), (9, "", "e2"), (9, blank, "e3"), (9, "\x1c", "e4"), (9, "\x1c", "e4")]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    kept = jaccard_join.stage(spark, rows, SF)
    assert kept.columns == rows.columns
    want = [(1, p, "en"), (2, q, "en"), (2, r, "de"), (7, "y z", "de"), (8, "only null beside it", "en"), (9, "\x1c", "e4")]
    want += [(9, None, "e1"), (9, None, "e1"), (9, "", "e2"), (9, blank, "e3"), *(d for d in docs if d[0] is None)]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def at(d, t):
    """Where a document stands: by id, null last, then by the hash of its text."""
    h = xxhash.xxh64(t.encode(), seed=42).intdigest() if t is not None else 42
    return d is None, d or 0, h - (h >> 63 << 64)


def dedup(docs, least):
    every = [(at(d, t), i, line) for d, t in docs if t is not None for i, line in enumerate(t.split("\n")) if len(line) >= least]
    for d, t in docs:
        if t is None:
            yield d, 0, 0, None
            continue
        own, lines = at(d, t), t.split("\n")
        left = [x for i, x in enumerate(lines) if len(x) < least or not any((k, j) < (own, i) and within_one(x, y) for k, j, y in every)]
        yield d, len(lines), len(lines) - len(left), "\n".join(left)


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(15, 40))) for _ in range(40)]

    def changed(x):
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i, kind = rng.randint(0, len(x)), rng.random()
            x = x[:i] + (rng.choice("abé") if kind < 0.66 else "") + x[i + (kind >= 0.33) :]
        return x

    docs = [(i - (i % 7 == 0), "\n".join(changed(rng.choice(base)) for _ in range(rng.randint(0, 8)))) for i in range(100)]
    docs += [(None, base[0] + "\n" + base[1]), (500, None), (501, ""), (502, "\n" + "z" * 5000), (503, "z" * 4999)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_lines string")
    got = line_dedup.line_dedup(frame).select("_doc.doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, dedup(docs, line_dedup.LEAST)))


def test_line_dedup_of_nothing_and_stage(spark):
    assert line_dedup.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    line = "this line is long enough to count"
    docs = spark.createDataFrame([(1, line, 33), (2, line.upper() + "\n" + line, 67), (3, line, 33)], "doc_id long, text string, n_chars long")
    got = sorted(map(tuple, line_dedup.stage(spark, docs, SF).collect()))
    assert got == [(1, line, 33), (2, line.upper(), 33)]


def dedup_of_all_lengths(docs, least):
    """Copies of lines of every length but 0 go; one edit counts from `least` characters on."""
    every = [(at(d, t), i, x) for d, t in docs if t is not None for i, x in enumerate(t.split("\n")) if x]
    for d, t in docs:
        own, lines = at(d, t), [] if t is None else t.split("\n")
        near = lambda x, y: x == y or (min(len(x), len(y)) >= least and within_one(x, y))
        left = [x for i, x in enumerate(lines) if not x or not any((k, j) < (own, i) and near(x, y) for k, j, y in every)]
        yield d, len(lines), len(lines) - len(left), None if t is None else "\n".join(left)


def test_line_dedup_drops_short_copies_in_query_and_stage(spark, tmp_path):
    rng = random.Random(4)
    base = ["And ornd.", "Les Rech.", "x", " ", "", "Page 1", "Page 2", "é" * 19, "é" * 20, "é" * 21, "a line that is long enough", "a line that is long enouGh"]
    docs = [(i, "\n".join(rng.choice(base) for _ in range(rng.randint(1, 5)))) for i in range(40)]
    docs += [(None, "And ornd.\nonly here"), (500, None), (501, ""), (502, "Menu\nMenu")]
    rows = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, n_chars long")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    want = sorted(dedup_of_all_lengths(docs, 20), key=str)
    got = [tuple(r) for r in line_dedup.op4_line_dedup(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == want and (502, 2, 1, "Menu") in got
    kept = {r["doc_id"]: r["text"] for r in line_dedup.stage(spark, rows, SF).collect()}
    left = {d: t for d, _, n, t in want}
    assert all(t == left[d] for d, t in kept.items()) and kept[502] == "Menu"
    assert {d for d, _, n, t in want if not n or t.strip()} == kept.keys()


@pytest.mark.parametrize("part", [1 << 18, 30])
def test_line_dedup_of_equal_and_null_ids(spark, monkeypatch, part):
    """Different texts under one id or none: the first by hash keeps a shared line; true copies of a row are alike."""
    monkeypatch.setattr(line_dedup, "PART", part)
    one = "a line that all of these begin with"
    docs = [(d, f"{one}\nrest {d} {k}\n\n\ta") for d in (None, 5, 5) for k in range(3)] + [(None, one), (None, one), (5, one + "\n \t"), (9, f"{one}x\n\t\n"), (8, None)]
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, n_chars long")
    got = [tuple(r) for r in line_dedup.line_dedup(frame, exact=1).select("_doc.doc_id", "n_lines", "n_dropped", "text").collect()]
    want = list(dedup_of_all_lengths(docs, 20))
    assert sorted(got, key=str) == sorted(want, key=str) and sum(one in (t or "") for *_, t in got) < 4
    kept = line_dedup.stage(spark, frame, SF).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept) == sorted((str(d), str(t)) for d, _, n, t in want if not n or t.strip())
    assert len(kept) < len(docs)
    assert line_dedup.stage(spark, frame.limit(0), SF).count() == 0


def brute_topk(rows, k):
    whole = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in whole), default=0)
    whole = [(i, np.pad(v, (0, width - len(v)))) for i, v in whole]
    out = []
    for q, x in whole:
        if q % 50 == 0:
            found = sorted((-int(x @ y), i) for i, y in whole if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_topk, "PAGE", 40)
    monkeypatch.setattr(vector_topk, "BLOCK", 3)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.3 * rng.normal(size=8)).tolist()) for i in range(700)]
    rows += [(1000 + i, [1.0] * 8) for i in range(150)] + [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 8), (2150, [2.0, 1.0]), (None, [1.0] * 8), (2200, [])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    got = vector_topk.vector_topk(frame, frame.where("vec_id % 50 = 0"))
    assert sorted(map(tuple, got.collect())) == brute_topk(rows, 5)


def test_topk_of_few(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vector_topk.vector_topk(frame, frame.where("vec_id = 0")).collect())) == [(0, 1, 1, 131072)]
    assert vector_topk.vector_topk(frame.limit(0), frame.limit(0)).count() == 0


def test_topk_of_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(0, 9)).tolist()) for i in range(300)] + [(350, [1e30, 0.0, 0.0, 0.0]), (351, [-1e30, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    top = 2**63 - 1
    whole = [(i, [max(-top - 1, min(top, int(np.floor(256 * x)))) for x in v]) for i, v in rows]
    want = []
    for q, x in whole:
        if q % 50 == 0:
            scores = [(max(-top - 1, min(top, sum(a * b for a, b in zip(x, y)))), i) for i, y in whole if i != q]
            want += [(q, n + 1, i, s) for n, (s, i) in enumerate(sorted(scores, key=lambda p: (-p[0], p[1]))[:5])]
    got = vector_topk.vector_topk(frame, frame.where("vec_id % 50 = 0"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_topk_of_clustered_vectors_spares_pages(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = 3 * rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.02 * rng.normal(size=16)).tolist()) for i in range(8000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen, old = [], vector_topk.searched
    monkeypatch.setattr(vector_topk, "searched", lambda todo, *a: (seen.append(todo.count()), old(todo, *a))[1])
    got = vector_topk.vector_topk(frame, frame.where("vec_id % 50 = 0")).collect()
    assert sorted(map(tuple, got)) == brute_topk(rows, 5)
    assert sum(seen) < 160 * 32 / 2  # half of all pairs of query and leaf at most
