"""Language identification with a string kernel.

The kernel of two texts is the blended spectrum of which byte n-grams (n = 1 to 4, hashed) are
present in both, normalised. Texts are cut into windows, so presence does not saturate and every
byte counts. Landmarks span the kernel (Nystroem): each is the middle of the windows nearest to it, of
all that may be learned from. One ridge regression a language against the rest is solved on the
landmark features of all those windows, and texts are scored in batches by two matrix products, the
scores of their windows averaged. Middles and normal equations are added up by tasks, so the driver
sees landmarks and sums alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm.common import materialise, text_blocks

UNKNOWN = "und"
#: Presence features; the longest n-gram; bytes of a window; landmarks.
FEATURES, LONGEST, WINDOW, LANDMARKS = 8192, 4, 4096, 160
RIDGE, SHARPNESS = 1e-2, 8.0
#: Bytes from which a text says enough about its language to be rejected.
TELLING = 256
#: Values of a sum that meet in one group; how tasks hand on their sums.
BLOCK, PARTS = 2048, "at int, block int, sums binary"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def presence(raw: np.ndarray, windows: list[tuple[int, int]], features: int = FEATURES) -> np.ndarray:
    """A row a window: 1 where some n-gram of the window hashes to the feature."""
    out = np.zeros((len(windows), features), np.float32)
    shift = np.uint32(32 - (features.bit_length() - 1))
    folded = _FOLD[raw]
    grams = np.zeros(len(raw), np.uint32)
    for n in range(LONGEST):
        m = len(raw) - n
        if m <= 0:
            break
        grams = (grams[:m] << np.uint32(8)) | folded[n:]
        at = ((grams + np.uint32(n + 1)) * _MULTIPLIERS[n]) >> shift
        at = at.astype(np.intp)
        for w, (a, b) in enumerate(windows):
            if b - a > n:
                out[w][at[a : b - n]] = 1.0
    return out


def windows_of(offsets: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Near equal windows of at most ``window`` bytes that cover each text, and whose text each is."""
    spans, owner = [], []
    for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        parts = -(-(b - a) // window)
        for k in range(parts):
            spans.append((a + (b - a) * k // parts, a + (b - a) * (k + 1) // parts))
            owner.append(d)
    return spans, np.array(owner, np.int64)


@dataclass(frozen=True)
class Model:
    """Landmarks (features by landmarks, columns of unit length), ridge weights and languages."""

    landmarks: np.ndarray
    weights: np.ndarray
    languages: list[str]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, a row a window."""
        if not self.languages:
            return np.zeros((len(x), 0))
        norms = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1.0))
        raw = ((x @ self.landmarks) / norms) @ self.weights
        e = np.exp(SHARPNESS * (raw - raw.max(axis=1, keepdims=True)))
        return e / e.sum(axis=1, keepdims=True)


def spanning(base: np.ndarray) -> np.ndarray:
    """Combinations of landmarks (rows of unit length) that are orthonormal in the kernel's space."""
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    return vectors[:, keep] / np.sqrt(values[keep])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1.0))


def solve(moments: dict[str, np.ndarray], root: np.ndarray, base: np.ndarray, ridge: float = RIDGE) -> Model:
    """One-versus-rest ridge regression from the sums of each language's windows: z' z, then z, then their number.

    Every language weighs the same, however many windows it has.
    """
    languages, n = sorted(moments), root.shape[1]
    share = {g: moments[g] / moments[g][-1] for g in languages}
    gram = sum(share[g][: n * n].reshape(n, n) for g in languages)
    means = np.array([share[g][n * n : -1] for g in languages])
    beta = np.linalg.solve(gram + ridge * np.eye(n), 2 * means.T - means.sum(axis=0)[:, None])
    return Model(np.ascontiguousarray(base.T, np.float32), (root @ beta).astype(np.float32), languages)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def labelled(docs: DataFrame) -> DataFrame:
    """The documents to learn from: all that have a text and a language and are not held out."""
    return docs.filter(F.col("lang").isNotNull() & (F.octet_length("text") > 0) & ~held_out(F.col("doc_id")))


def sampled(docs: DataFrame, per_language: int) -> DataFrame:
    """doc_id, lang, text of at most ``per_language`` documents of each language, those of least hash of doc_id.

    Landmarks start from these; nothing else is drawn from them. Ids are ranked in two steps, so that
    what meets in a language's one task does not grow with the number of splits. The ids, a bounded
    number, are broadcast. Of rows that share an id and language the least text is taken.
    """
    rows = labelled(docs).select("doc_id", "lang", "text")
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = rows.groupBy("doc_id", "lang").agg(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(64)).alias("__b"))
    for keys in (["lang", "__b"], ["lang"]):
        ids = ids.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by_hash))).filter(F.col("__n") <= per_language).drop("__n")
    ids = materialise(ids.select("doc_id", "lang"), "language-ids")
    return materialise(rows.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")), "language-sample")


def landmark_windows(sample: DataFrame, landmarks: int) -> tuple[list[str], np.ndarray]:
    """Languages and unit presence vectors of the same number of windows from each language, one a text; the driver gets a bitmap each.

    Texts are taken in the order of their hash, and of a text a window that its hash picks.
    """
    counts = {r[0]: r[1] for r in sample.groupBy("lang").count().collect()}
    if not counts:
        return [], np.zeros((0, FEATURES), np.float32)
    per = max(1, landmarks // len(counts))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = sample.withColumn("__n", rank).filter(F.col("__n") <= per).withColumn("at", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 31))).select("text", "lang", "doc_id", "at")

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, raw in text_blocks(batch, "text", 1 << 20):
                spans, owner = windows_of(offsets)
                begin = np.searchsorted(owner, np.arange(len(offsets)))
                at = batch.column(3).slice(first, len(offsets) - 1).to_numpy()
                mine = [int(begin[d] + at[d] % (begin[d + 1] - begin[d])) for d in range(len(at)) if begin[d + 1] > begin[d]]
                bits = [presence(raw[a:b], [(0, b - a)])[0] > 0 for a, b in (spans[k] for k in mine)]
                rows = pa.array(first + owner[mine].astype(np.int64) if mine else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(rows), batch.column(2).take(rows), pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())], ["lang", "doc_id", "bits"]
                )

    found = sorted(chosen.mapInArrow(bitmaps, "lang string, doc_id long, bits binary").collect())
    return [r["lang"] for r in found], unit(np.array([np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in found], np.float32).reshape(-1, FEATURES))


def _labelled_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Languages and presence vectors of all windows of all texts, some at a time. batches: text, lang."""
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        for first, offsets, raw in text_blocks(batch, "text", 1 << 20):
            spans, owner = windows_of(offsets)
            for k in range(0, len(spans), 256):
                yield langs[first + owner[k : k + 256]], _presence_of(raw, spans[k : k + 256])


def _parts(at: int, values: np.ndarray) -> pa.RecordBatch:
    """What a task added up for one landmark or language, in blocks."""
    blocks = [zlib.compress(values[k : k + BLOCK].tobytes(), 1) for k in range(0, len(values), BLOCK)]
    return pa.RecordBatch.from_arrays(
        [pa.array([at] * len(blocks), pa.int32()), pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["at", "block", "sums"]
    )


def added_up(parts: DataFrame, kind: type) -> dict[int, np.ndarray]:
    """The sums of all tasks. A block of every task meets in a group; its order there makes no difference."""

    def fold(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), kind) for x in sorted(rows["sums"].to_pylist()))
        return pa.table({"at": rows["at"][:1], "block": rows["block"][:1], "sums": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    found = sorted(parts.groupBy("at", "block").applyInArrow(fold, PARTS).collect())
    return {k: np.concatenate([np.frombuffer(zlib.decompress(r["sums"]), kind) for r in found if r["at"] == k]) for k in sorted({r["at"] for r in found})}


def middles(texts: DataFrame, langs: list[str], base: np.ndarray) -> np.ndarray:
    """Each landmark moved to the middle, of unit length, of the windows of its language that are nearest to it, all windows being dealt out."""
    code = {g: k for k, g in enumerate(sorted(set(langs)))}
    of = np.array([code[g] for g in langs])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(base.shape, np.int64)
        for own, x in _labelled_windows(batches):
            other = np.array([code[g] for g in own])[:, None] != of
            dealt = np.zeros(other.shape, np.float32)
            dealt[np.arange(len(x)), np.where(other, -1, unit(x) @ base.T).argmax(axis=1)] = 1
            held += (dealt.T @ x).astype(np.int64)
        for k in np.flatnonzero(held.any(axis=1)):
            yield _parts(k, held[k])

    counts = np.array(list(added_up(texts.select("text", "lang").mapInArrow(sums, PARTS), np.int64).values()), float)
    return (counts / np.linalg.norm(counts, axis=1, keepdims=True)).astype(np.float32)


def window_moments(texts: DataFrame, languages: list[str], base: np.ndarray, root: np.ndarray) -> dict[str, np.ndarray]:
    """For each language the sums over all windows of all its texts: z' z flattened, z, and their number."""
    n = root.shape[1]
    upper = np.triu_indices(n)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for own, x in _labelled_windows(batches):
            z = (unit(x) @ base.T).astype(np.float64) @ root
            for lang in set(own):
                mine = z[own == lang]
                held[lang] = held.get(lang, 0) + np.concatenate([(mine.T @ mine)[upper], mine.sum(axis=0), [len(mine)]])
        for lang, values in held.items():
            yield _parts(languages.index(lang), values)

    def whole(values: np.ndarray) -> np.ndarray:
        gram = np.zeros((n, n))
        gram[upper] = gram.T[upper] = values[: -n - 1]
        return np.concatenate([gram.ravel(), values[-n - 1 :]])

    return {languages[k]: whole(values) for k, values in added_up(texts.select("text", "lang").mapInArrow(sums, PARTS), np.float64).items()}


def learn(docs: DataFrame, landmarks: int = LANDMARKS) -> Model:
    """Fit on all windows of all documents that may be learned from; landmarks, whose number is fixed, start from some of them."""
    langs, starts = landmark_windows(sampled(docs, landmarks), landmarks)
    if not langs:
        return Model(np.zeros((FEATURES, 0), np.float32), np.zeros((0, 0)), [])
    base = middles(labelled(docs), langs, starts)
    root = spanning(base)
    return solve(window_moments(labelled(docs), sorted(set(langs)), base, root), root, base)


def _presence_of(raw: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    start, end = spans[0][0], spans[-1][1]
    return presence(raw[start:end], [(a - start, b - start) for a, b in spans])


def _classify(batch: pa.RecordBatch, model: Model) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, places in the model's languages (their number for ``und``), scores, and whether there are letters, for runs of a batch's rows."""
    texts = batch.column(batch.schema.get_field_index("text"))
    letters = pc.fill_null(pc.match_substring_regex(texts.cast(pa.large_string()), r"\p{L}"), False).to_numpy(zero_copy_only=False)
    for first, offsets, raw in text_blocks(batch, "text", 1 << 20):
        n = len(offsets) - 1
        spans, owner = windows_of(offsets)
        best, score, ok = np.full(n, len(model.languages)), np.zeros(n), letters[first : first + n]
        if len(spans) and model.languages:
            p = np.concatenate([model.scores(_presence_of(raw, spans[k : k + 256])) for k in range(0, len(spans), 256)])
            lengths = np.array([b - a for a, b in spans], float)
            total = np.zeros((n, p.shape[1]))
            np.add.at(total, owner, p * lengths[:, None])
            total /= np.maximum(np.diff(offsets)[:, None], 1)
            best = np.where(ok, total.argmax(axis=1), best)
            score = np.where(ok, np.clip(total.max(axis=1), 0, 1), 0.0)
        yield first, best, score, ok


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs``, whole texts; ``und`` and 0 without letters."""
    languages = [*model.languages, UNKNOWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, best, score, _ in _classify(batch, model):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(best)), pa.array([languages[k] for k in best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns from text and non-null lang of all documents whose crc32 of doc_id, as text, modulo 4 is not
    2; predicts from the text alone. ``und`` with score 0 where the text is null or has no letter,
    or where nothing could be learned. Repeated rows are predicted alike; rows with a null doc_id
    are held out. An empty table gives an empty result. Other columns are ignored.
    """
    model = learn(docs)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def least_scores(docs: DataFrame, model: Model) -> dict[str, float]:
    """For each language the score halfway from chance to the least of its texts of some length that are predicted rightly, of all that were learned from."""
    places = {g: k for k, g in enumerate(model.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.full(len(places), np.inf)
        for batch in batches:
            own = np.array([places.get(g, -1) for g in batch.column(1).to_pylist()])
            for first, best, score, _ in _classify(batch, model):
                right = best == own[first : first + len(best)]
                np.minimum.at(held, best[right], score[right])
        seen = np.flatnonzero(np.isfinite(held))
        yield pa.RecordBatch.from_arrays([pa.array([model.languages[k] for k in seen], pa.string()), pa.array(held[seen])], ["lang", "least"])

    texts = labelled(docs).filter(F.octet_length("text") >= TELLING).select("text", "lang")
    rows = texts.mapInArrow(run, "lang string, least double").groupBy("lang").agg(F.min("least").alias("least")).collect()
    return {r["lang"]: (r["least"] + 1 / len(model.languages)) / 2 for r in rows}


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents with a language: those without letters go, and those that no language scores as it scores its own.

    The least score of a language comes from all documents that were learned from, see
    least_scores(); texts of fewer than TELLING bytes are too short to be rejected for it. If nothing
    could be learned, all with letters stay. Each row is decided on by its own text where it is read,
    whatever ids rows share.
    """
    model = learn(docs)
    found = least_scores(docs, model) if model.languages else {}
    least = np.array([*(found.get(g, 0.0) for g in model.languages), 0.0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, best, score, ok in _classify(batch, model):
                sizes = pc.fill_null(pc.binary_length(batch.column("text").slice(first, len(best))), 0).to_numpy(zero_copy_only=False)
                yield batch.slice(first, len(best)).filter(pa.array(ok & ((score >= least[best]) | (sizes < TELLING))))

    # names that Spark would read as more than a name, such as those with dots, are put back at the end
    plain = docs.toDF(*[c if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
