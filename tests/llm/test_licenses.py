"""License scans, against plain phrases and windows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import common, decontamination, licenses


def split(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(text, templates=licenses.TEMPLATES, phrases=licenses.PHRASES, percent=80):
    """n_words, phrases and blocks of a text."""
    w = split(text)
    found = sorted((i, k) for k, (p, _) in enumerate(phrases) for i in range(len(w)) if w[i : i + len(split(p))] == split(p))
    blocks = []
    for k, (label, t) in enumerate(templates):
        words = split(t)
        half, own = 1, set(words)
        while half < len(words):
            half *= 2
        for i in range(max(-(-len(w) // half) - 1, 1)):
            shared = len(own & set(w[i * half : (i + 2) * half]))
            if own and 100 * shared >= percent * len(own):
                blocks.append((i * half, k, label, min((i + 2) * half, len(w)) - 1, shared, len(own)))
    return len(w), [(phrases[k][1], i) for i, k in found], [(label, a, b, s, n) for a, _, label, b, s, n in sorted(blocks)]


def texts(seed):
    rng = random.Random(seed)
    out = [None, "", " .\n", "MIT License", "the MIT\nlicense, an Apache-License; CC\tBY cc by by", "mit licenses", "été MIT License été"]
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in split(t)}) + [f"w{i}" for i in range(200)]
    for _ in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 40, 300]))]
        for _ in range(rng.randint(0, 3)):
            t = split(rng.choice(licenses.TEMPLATES)[1])
            for _ in range(rng.choice([0, 1, 4, 9, 12])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            at = rng.randint(0, len(w))
            w[at:at] = t
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_every_block_is_found(spark, seed):
    docs = [(i if i % 9 else None, t) for i, t in enumerate(texts(seed))]
    frame = spark.createDataFrame([(*d, 1, "x") for d in [*docs, docs[3]]], "doc_id long, text string, n_words int, label string")
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["phrases"]], [tuple(x) for x in r["blocks"]]) for r in licenses.license_scan(frame).collect()]
    want = [(i, *plain(t)) for i, t in [*docs, docs[3]]]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(len(b) for _, _, _, b in got) > 30


@pytest.mark.parametrize("seed,step", [(3, 1 << 19), (4, 50), (5, 7)])
def test_words_over_the_ends_of_pieces(monkeypatch, seed, step):
    """As tasks do it, with long texts in pieces of some bytes, and words in any order of rarity."""
    monkeypatch.setattr(common, "STEP_BYTES", step)
    docs = texts(seed)
    word, at = decontamination.words(*common.utf8(pa.array(docs, pa.string())))
    t = licenses.Templates(licenses.TEMPLATES, 80)
    t.order(np.random.default_rng(seed).permutation(len(t.words)))
    got = {}
    for row, k, first, end, shared in zip(*(x.tolist() for x in licenses.blocks_of(word, at, t))):
        got.setdefault(row, []).append((t.labels[k], first, end - 1, shared, int(t.size[k])))
    assert got == {i: b for i, x in enumerate(docs) if (b := plain(x)[2])}
    assert licenses.places_of(word, at, decontamination.words_of(["mit license"])[0]).tolist() == [at[i] + p for i, x in enumerate(docs) for label, p in plain(x)[1] if label == "mit"]


def test_other_thresholds_and_templates(spark):
    frame = spark.createDataFrame(list(enumerate(texts(5))), "doc_id long, text string")
    mine = (("one", "w1"), ("none", " "), ("some", "w1 w2 w3 the of"), ("some", "any person free of charge"))
    for percent in (30, 100):
        got = licenses.license_scan(frame, templates=mine, phrases=(("w5", "five"),), percent=percent).collect()
        assert all((r["n_words"], [tuple(x) for x in r["phrases"]], [tuple(x) for x in r["blocks"]]) == plain(t, mine, (("w5", "five"),), percent) for r, t in zip(sorted(got), texts(5)))
    with pytest.raises(ValueError):
        licenses.license_scan(frame, templates=(("big", "w " * (licenses.MOST_WORDS + 1)),))


def test_notices_are_labelled_and_prose_is_not(spark, tmp_path):
    notes = [f"Some words before it.\n{t}\nand after" for _, t in licenses.TEMPLATES]
    prose = "The person who reads this may copy the notes to any file, and the rest of the work is free of charge for all. " * 30
    rows = [(i, t) for i, t in enumerate([*notes, prose, None])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in licenses.op12_licenses(spark, str(tmp_path)).collect()}
    for i, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0
    assert got[0]["base_labels"] == "" and got[0]["first_word"] is None and got[1]["base_labels"] == "apache"
    assert [got[len(notes)][c] for c in ("labels", "score")] == ["", 0.0] and got[len(notes) + 1]["n_words"] == 0


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.license_scan(none).columns == ["doc_id", "n_words", "phrases", "blocks"] and licenses.license_scan(none).count() == 0
