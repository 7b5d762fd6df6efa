"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, letter by letter, and everything but letters becomes a space. All runs of one to three
characters that hold a letter, three to begin a text with being spaces, are hashed into a fixed number of buckets.
Learning counts the buckets by language in Spark; the matrix of smoothed log probabilities (buckets x languages, a
fixed size for each language) is broadcast, and numpy adds up the rows of each text's n-grams. Of equally likely
languages the first by name is taken.

Learning takes about `per_lang` texts of each language, chosen by a hash of the id; that is the only bound, and
every text is scored whole. Long texts are read in pieces that overlap by two characters, so memory doesn't grow with
their n-grams. Null texts and texts without a letter get `und` with score 0. If nothing can be learned, all get `und`.
Rows are scored one by one, so repeated ids stay; other columns are not read, whatever their names, and those in `keep`
come back as they are. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

BUCKETS = 1 << 16
#: Texts of each language that learning takes, about.
PER_LANG = 1500
#: Added to each count.
SMOOTHING = 0.05

#: Characters of a piece.
PART = 1 << 17

_folded: np.ndarray | None = None


def folded() -> np.ndarray:
    """By code point: the lower-case letter, or a space for what is no letter."""
    global _folded
    if _folded is None:
        _folded = np.full(0x110000, 32, np.uint32)
        letters = [c for c in range(0x110000) if chr(c).isalpha()]
        _folded[letters] = [ord(chr(c).lower()[0]) for c in letters]
    return _folded


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, code, begins) for each character of some texts, about PART at a time; begins: an n-gram starts here.

    Three spaces stand before each text and two behind it. Characters that a piece only looks ahead at begin nothing.
    """
    table, held, size = folded(), [], 0
    before, after = np.full(3, 32, np.uint32), np.full(2, 32, np.uint32)
    for row, text in enumerate(texts):
        text = text or ""
        for at in range(0, len(text) or 1, PART):
            n = min(PART, len(text) - at)
            code = table[np.frombuffer(text[at : at + PART + 2].encode("utf-32-le", "surrogatepass"), np.uint32)]
            code = np.concatenate([before[: 0 if at else 3], code, after[: 2 - (len(code) - n)]])
            held.append((row, code))
            size += len(code)
            if size >= PART:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(c) for _, c in held])
    begins, ends = np.ones(sizes.sum(), bool), np.cumsum(sizes)
    begins[ends - 1] = begins[ends - 2] = False
    return np.repeat([r for r, _ in held], sizes), np.concatenate([c for _, c in held]), begins


def ngrams(row: np.ndarray, code: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of the n-grams of a piece, those of one length after the other."""
    n = len(code) - 2
    letter = code != 32
    a, b, c = letter[:n], letter[1 : n + 1], letter[2:]
    wide, use = code.astype(np.uint64), (a, a | b, a & b | b & c)
    with np.errstate(over="ignore"):
        h = wide[:n] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        for k, factor in enumerate((0, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
            if k:
                h = h * np.uint64(31) + wide[k : n + k] * np.uint64(factor)
            at = np.flatnonzero(use[k] & begins[:n])
            yield row[at], (common.mix(h[at]) >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_lang: int = PER_LANG) -> tuple[list[str], np.ndarray]:
    """The languages and the matrix of log probabilities, with the log priors as its last row."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    known = dict(rows.groupBy("lang").agg(F.count("*").alias("size")).collect())
    if not known:
        return [], np.zeros((BUCKETS + 1, 0))
    size = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[F.col("lang")]
    spread = F.crc32(F.concat(F.lit("fit"), F.coalesce(F.col("id").cast("string"), F.lit("")))) / F.lit(2.0**32)
    sample = rows.where(spread * size < per_lang).select("lang", "text")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, column = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in common.steps(common.utf8(column)[1]):
                names = sorted(set(langs[lo:hi]))
                place = np.array([names.index(x) for x in langs[lo:hi]])
                for piece in pieces(column.slice(lo, hi - lo).to_pylist()):
                    for row, bucket in ngrams(*piece):
                        n = np.bincount(place[row] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                        for i, name in enumerate(names):
                            total[name] = total.get(name, 0) + n[i]
        for name, n in total.items():
            full = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(n[full])], names=["lang", "bucket", "n"])

    counts = common.mapped(sample, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    names = sorted(set(found["lang"].to_pylist()))
    matrix = np.zeros((BUCKETS + 1, len(names)))
    if names:
        place = {x: i for i, x in enumerate(names)}
        matrix[found["bucket"].to_numpy(), [place[x] for x in found["lang"].to_pylist()]] = found["n"].to_numpy()
        matrix[:BUCKETS] += SMOOTHING
        matrix[BUCKETS] = [known[x] for x in names]
        matrix[:BUCKETS] = np.log(matrix[:BUCKETS] / matrix[:BUCKETS].sum(0))
        matrix[BUCKETS] = np.log(matrix[BUCKETS] / matrix[BUCKETS].sum())
    return names, matrix


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with lang_pred and score, the posterior of that language."""
    names, langs = list(keep), model[0]
    shared = docs.sparkSession.sparkContext.broadcast(model[1])
    out, arrow = common.schema_of(docs, names, "lang_pred string, score double")
    rows, texts = common.reading(docs, names, text)

    def run(batches):
        matrix = np.ascontiguousarray(shared.value.T)
        for batch in batches:
            column = texts(batch)
            for lo, hi in common.steps(common.utf8(column)[1]):
                sums, n = np.zeros((hi - lo, len(langs))), np.zeros(hi - lo, np.int64)
                for piece in pieces(column.slice(lo, hi - lo).to_pylist()):
                    for row, bucket in ngrams(*piece):
                        n += np.bincount(row, minlength=hi - lo)
                        for k in range(len(langs)):
                            sums[:, k] += np.bincount(row, matrix[k][bucket], hi - lo)
                pred, score = np.full(hi - lo, -1), np.zeros(hi - lo)
                full = n > 0
                if len(langs) and full.any():
                    sums = sums[full] + matrix[:, BUCKETS]
                    best = sums.argmax(1)
                    pred[full] = best
                    score[full] = 1 / np.exp(np.maximum(sums - sums[np.arange(len(best)), best][:, None], -700)).sum(1)
                more = {"l": pa.array(["und" if p < 0 else langs[p] for p in pred], pa.string()), "s": score}
                yield common.columns(batch, lo, hi, names, more, arrow)

    return common.mapped(rows, run, out)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.where(~common.held_out()))
    return predict(docs, model).withColumn("held_out", common.held_out()).select("doc_id", "held_out", "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is found with a score of 0.5 at least; those without a letter go.

    Every row is decided by its own text: repeated rows and ids stay or go together, all columns come back as they were.
    """
    model = fit(docs.where(~common.held_out()))
    found = predict(common.packed(docs), model, "_doc.text", ("_doc",))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).select("_doc.*")
