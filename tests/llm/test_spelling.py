"""Spelling variant grouping, against plain counting and all pairs."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import common, spelling

ODD = [
    (1, "Straße straße STRASSE Étés été's étés× naïve Naïve naïve école"), (2, None), (3, ""), (None, "letter letter Letter lettre letters"), (3, "x" * 70 + " " + "abcdefgh " * 5),
    (4, "日本語abcde語 fghij\nklmno\tabcde-abcde"), (5, "Ābcde ābcdef ÿÿÿÿÿ ÀÀÀÀÀ"), (6, "letterletter"), (6, "letterletter"),
]


def plain_words(docs, odds=97, least=5, times=3):
    n = Counter()
    for i, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % odds == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= times}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    form, out = {}, []
    beside = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if near(a, b):
            beside[a].append(b)
            beside[b].append(a)
    for w, others in beside.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(beside[w]), n[form[w]] if w in form else None))
    return sorted(out)


@pytest.mark.parametrize("odds,step", [(97, 1 << 19), (2, 1 << 19), (3, 16)])
def test_words_are_the_plain_ones(spark, monkeypatch, odds, step):
    rng = random.Random(odds)
    docs = ODD + [(i, " ".join(rng.choice(["letter", "Lettre", "übung", "Übung", "abcdefgh", "été"]) for _ in range(40))) for i in range(30)]
    data, offsets = common.utf8(pa.array([t for _, t in docs], pa.string()))
    monkeypatch.setattr(common, "STEP_BYTES", step)
    got = spelling.words_of(data, offsets, [None if i is None else str(i) for i, _ in docs], odds, 5)
    assert {w.decode(): n for w, n in got.items()} == plain_words(docs, odds, 5, 1)
    if odds == 2:
        frame = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, word double")
        assert dict(map(tuple, spelling.counted(frame, odds=odds).collect())) == plain_words(docs, odds)


def vocabulary(seed, letters, sizes, count):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(count)}
    for w in sorted(words)[: count // 2]:
        i = rng.randrange(len(w))
        words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]]))
    return {w: rng.choice([1, 2, 3, 7, 20, 20, 100]) for w in words if w}


@pytest.mark.parametrize("seed,letters,sizes,page,questions", [
    (1, "abcdeféü", (5, 6, 7), 4096, 1 << 16), (2, "abcdeféü", (5, 6, 7), 6, 40), (3, "ab", (5, 6, 7, 8), 3, 25), (4, "zwxkéÿ×", (1, 2, 3), 8, 1 << 16), (5, "ab", (300, 301), 40, 30),
])
def test_variants_are_those_of_all_pairs(spark, monkeypatch, seed, letters, sizes, page, questions):
    """Small pages split the trie to the last letter, so that leaves of anagrams, and pages with many questions, occur."""
    monkeypatch.setattr(spelling, "PAGE", page)
    monkeypatch.setattr(spelling, "QUESTIONS", questions)
    n = vocabulary(seed, letters, sizes, 150)
    rows = spark.createDataFrame(list(n.items()), "word string, n long")
    split = spelling.splits(common.staged(rows))
    assert seed != 3 or len(split) > spelling.WIDTH
    got = sorted(map(tuple, spelling.spelling_variants(rows).collect()))
    assert got == plain_variants(n) and any(r[1] for r in got)


def test_chains_go_to_their_end(spark):
    n = {"aaaaa" + "b" * i: 2**i for i in range(8)}
    got = spelling.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert {r["root"] for r in got} == {"aaaaabbbbbbb"} and sorted(map(tuple, got)) == plain_variants(n)


def test_no_words(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    got = spelling.spelling_variants(spelling.counted(none))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.count() == 0


def test_crc_is_the_librarys():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 500, dtype=np.uint8)
    start, size = np.array([3, 90, 0, 400]), np.array([80, 20, 7, 0])
    got = spelling.crc32(data, start, size, np.array([zlib.crc32(b"12:")] * 4, np.uint32))
    assert got.tolist() == [zlib.crc32(b"12:" + data[s : s + n].tobytes()) for s, n in zip(start, size)]
