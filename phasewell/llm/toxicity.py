"""Operator 7, toxicity: a small convolutional text classifier, trained by Spark tasks on all labels.

A word's embedding is the mean of hashed embeddings of the word and of its 4- and 5-letter pieces,
so that unseen inflections of a known word still score. Filters one, two and three words wide run
over the whole text, their largest responses are pooled, and a logistic unit scores them. The
threshold of each language is calibrated on labelled rows that training didn't see, and folded
into the score, so that 0.5 separates the classes everywhere. A text's language is guessed from
the text itself (frequent short words): lang, source and doc_id are never inputs.

Training: every labelled row that isn't held out trains or calibrates. Training rows are dealt by hash
into shards of about ``SHARD_ROWS`` rows. An epoch is one pass over all shards: each starts from the
broadcast parameters, takes Adam steps through its rows in slices of bounded bytes, and emits what it
moved; Spark sums the moves by parameter, weighted by rows. The mean of a word piece's moves is taken
over the shards that moved it. Moves are whole multiples of 1/``UNIT``, so that their sum doesn't
depend on the order of tasks. One shard alone is plain sequential training.

Scale: rows stay in a table in the checkpoint folder, one file per shard. The driver and each task
hold the parameters (a few MB, fixed size) and no rows. Thresholds are exact: logits are counted and
ordered by Spark inside narrow ranges, and the counts above a range come from the ranges' totals.
Scoring is one narrow pass without a shuffle. Rows of one id share a shard.

Edge cases: a null or empty text scores like a text without any filter response; where no label or
only one class is known, all texts get the share of toxic labels (or 0); repeated rows score alike;
extra columns are kept (generated columns start with ``_t_``); null doc_ids are not held out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import SLICE_BYTES, Words, array_slices, checkpoint_folder, mix, table

#: Training rows of a shard, about.
SHARD_ROWS = 12_000
#: Up to so many labels are broadcast; more are joined by hash partitions that are shards already.
BROADCAST_LABELS = 500_000
BUCKETS = 1 << 17
DIMENSION = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
PIECES = (4, 5)
EPOCHS = 6
BATCH = 48
RATE = 0.01
WORDS_AT_ONCE = 1 << 15
SEED = 7
#: Moves of parameters are rounded to multiples of 1 / UNIT before they are summed.
UNIT = 1 << 30
#: Ranges of logits in which thresholds are looked for, per unit.
RANGES = 64
#: Every fifth allowed label calibrates and doesn't train.
CALIBRATE_ONE_IN = 5

#: Frequent short words that tell languages apart.
LANGUAGES = {
    "en": "the of and to in is that for with was this are by from not you it his her they".split(),
    "fr": "le la les des et une est que dans pour pas qui sur au du avec ne ce il elle".split(),
    "de": "der die das und ist zu den mit von nicht ein eine im auf für dem sich des sie es".split(),
    "es": "el los las que una por con para del se su al lo como más pero sus le ya o".split(),
}


def tables_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all pieces of the words one after another, and each word's offsets.

    Done for ``WORDS_AT_ONCE`` words at a time, which bounds the arrays in between.
    """
    parts = [_tables_of(words.slice(lo, WORDS_AT_ONCE)) for lo in range(0, len(words), WORDS_AT_ONCE)]
    sizes = np.concatenate([np.zeros(1, np.int64), *[size for _, size in parts]])
    return np.concatenate([np.zeros(0, np.int32), *[buckets for buckets, _ in parts]]), np.cumsum(sizes)


def _tables_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the words' pieces, and how many each word has."""
    mark = lambda x: pa.scalar(x, pa.large_string())
    marked = pc.binary_join_element_wise(mark("<"), words.cast(pa.large_string()), mark(">"), mark("")).cast(pa.large_binary())
    offsets = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
    raw = np.frombuffer(marked.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    owner = np.repeat(np.arange(len(words)), size)
    left = offsets[1:][owner] - np.arange(len(raw))  # bytes from here to the word's end
    with np.errstate(over="ignore"):
        # the whole word: a polynomial over its bytes, summed per word
        power = mix(np.arange(len(raw), dtype=np.uint64) - offsets[:-1].astype(np.uint64)[owner] + np.uint64(1))
        whole = mix(np.add.reduceat(raw * power, offsets[:-1])) if len(words) else np.zeros(0, np.uint64)
        # a word's own key comes first, then its pieces by length and place
        sizes = 1 + sum(np.maximum(size - n + 1, 0) for n in PIECES)
        first = np.cumsum(sizes) - sizes
        keys = np.empty(int(sizes.sum()), np.uint64)
        keys[first] = whole
        place = np.arange(len(raw)) - offsets[:-1][owner] + first[owner] + 1
        for n in PIECES:
            at = np.flatnonzero(left >= n)
            acc = np.full(len(at), np.uint64(n * 7919))
            for j in range(n):
                acc = mix(acc * np.uint64(0x100000001B3) + raw[at + j])
            keys[place[at]] = acc
            place += np.maximum(size - n + 1, 0)[owner]
    return (keys % np.uint64(BUCKETS)).astype(np.int32), sizes


def means(embedding: np.ndarray, buckets: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The mean embedding of each word's pieces: the j-th pieces of all words that have one are added at once."""
    order = np.argsort(-size, kind="stable")
    left, at = -size[order], starts[order]
    total = np.zeros((len(size), embedding.shape[1]), np.float32)
    for j in range(-int(left[0]) if len(left) else 0):
        n = np.searchsorted(left, -j)
        total[:n] += embedding.take(buckets[at[:n] + j], axis=0)
    out = np.empty_like(total)
    out[order] = total
    return out / size[:, None].astype(np.float32)


def languages_of(w: Words, lowered: pa.Array) -> np.ndarray:
    """The language number guessed for each text; len(LANGUAGES) if no frequent word is there."""
    n = len(w.counts)
    score = np.zeros((n, len(LANGUAGES) + 1))
    score[:, -1] = 0.5
    for k, words in enumerate(LANGUAGES.values()):
        known = pc.is_in(lowered, pa.array(words, lowered.type)).to_numpy(zero_copy_only=False)
        score[:, k] = np.bincount(w.owner[known[w.ids]], minlength=n) if len(w.ids) else 0
    return score.argmax(1)


@dataclass
class Model:
    """Parameters; ``shift`` is subtracted from a text's logit, by guessed language."""

    embedding: np.ndarray
    filters: list[np.ndarray]  # for width v: (v, DIMENSION, FILTERS)
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES) + 1))
    constant: float | None = None

    def word_vectors(self, lowered: pa.Array) -> np.ndarray:
        buckets, at = tables_of(lowered)
        return means(self.embedding, buckets, at[:-1], np.diff(at))

    def logits(self, texts: pa.Array) -> np.ndarray:
        w = Words(texts)
        lowered = w.lowered()
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        pooled, _ = self.pool(self.word_vectors(lowered), w.ids, w.offsets)
        return pooled @ self.weights + self.bias - self.shift[languages_of(w, lowered)]

    def pool(self, vectors: np.ndarray, ids: np.ndarray, offsets: np.ndarray, argmax: bool = False) -> tuple[np.ndarray, list]:
        """Largest positive response of every filter in every text (and where, if asked)."""
        n = len(offsets) - 1
        out = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        where = []
        for k, (width, filters, bias) in enumerate(zip(WIDTHS, self.filters, self.biases, strict=True)):
            count = np.maximum(np.diff(offsets) - width + 1, 0)
            full = np.flatnonzero(count)
            ends = np.concatenate([[0], np.cumsum(count)])
            start = np.repeat(offsets[:-1] - ends[:-1], count) + np.arange(ends[-1])
            response = np.zeros((len(start), FILTERS), np.float32) + bias
            for j in range(width):
                response += (vectors @ filters[j]).take(ids[start + j], axis=0)
            if len(full):
                best = np.maximum.reduceat(response, ends[:-1][full], axis=0)
                out[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum(best, 0)
            if argmax:
                at = np.zeros((n, FILTERS), np.int64)
                for i in full.tolist():
                    at[i] = start[ends[i]] + response[ends[i] : ends[i + 1]].argmax(0)
                where.append(at)
        return out, where


@dataclass
class Training:
    """A model and the state of its optimiser."""

    model: Model
    moments: list[list[np.ndarray]]
    square: np.ndarray  # one step size per embedding row
    step: float = 0.0

    @staticmethod
    def start(seed: int = SEED) -> Training:
        rng = np.random.default_rng(seed)
        m = Model(
            rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32),
            [rng.normal(0, 0.5, (v, DIMENSION, FILTERS)).astype(np.float32) for v in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
            -1.0,
        )
        sizes = [p.shape for p in Training.dense(m)]
        return Training(m, [[np.zeros(size, np.float32), np.zeros(size, np.float32)] for size in sizes], np.full(BUCKETS, 1e-6, np.float32))

    @staticmethod
    def dense(m: Model) -> list[np.ndarray]:
        return [*m.filters, *m.biases, m.weights, np.array([m.bias], np.float32)]

    def flat(self) -> np.ndarray:
        """Everything but embeddings and their step sizes, one after another; steps in units of 128, to be of similar size."""
        return np.concatenate([*[p.ravel() for p in self.dense(self.model)], *[x.ravel() for pair in self.moments for x in pair], [self.step / 128]]).astype(np.float64)

    def moved(self, moves: np.ndarray, buckets: np.ndarray, embedding: np.ndarray, square: np.ndarray) -> Training:
        """A copy with ``moves`` added to ``flat`` and the others to the rows of ``buckets``."""
        values, at = self.flat() + moves, 0

        def take(like: np.ndarray) -> np.ndarray:
            nonlocal at
            at += like.size
            return values[at - like.size : at].reshape(like.shape).astype(np.float32)

        m = self.model
        dense = [take(p) for p in self.dense(m)]
        moments = [[take(a), np.maximum(take(b), 0)] for a, b in self.moments]  # a mean of squares, rounded
        table, rate = m.embedding.copy(), self.square.copy()
        table[buckets] += embedding.astype(np.float32)
        rate[buckets] += square.astype(np.float32)
        k = len(WIDTHS)
        return Training(Model(table, dense[:k], dense[k : 2 * k], dense[-2], float(dense[-1][0])), moments, rate, float(values[-1]) * 128)

    def copy(self) -> Training:
        return self.moved(np.zeros(1), np.zeros(0, np.int64), np.zeros((0, DIMENSION)), np.zeros(0))

    def learn(self, texts: list[str], labels: np.ndarray, share: float, rng: np.random.Generator) -> None:
        """Adam on the logistic loss, once through the texts; the gradient of max pooling touches one window per filter.

        ``share`` is the share of toxic rows among all training rows.
        """
        m = self.model
        w = Words(pa.array(texts, pa.large_string()))
        buckets, at = tables_of(w.lowered())
        y = labels.astype(np.float32)
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        dense = self.dense(m)
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            count = w.counts[part]
            off = np.concatenate([[0], np.cumsum(count)])
            flat = w.ids[np.repeat(w.offsets[:-1][part] - off[:-1], count) + np.arange(off[-1])]
            used, local = np.unique(flat, return_inverse=True)
            size = np.diff(at)[used]
            starts = np.cumsum(size) - size
            mine = buckets[np.repeat(at[:-1][used] - starts, size) + np.arange(size.sum())]
            vectors = means(m.embedding, mine, starts, size)
            pooled, where = m.pool(vectors, local, off, argmax=True)
            p = 1 / (1 + np.exp(-(pooled @ m.weights + m.bias)))
            g = (p - y[part]) * weight[part] / len(part)
            g_weights = pooled.T @ g
            g_pooled = g[:, None] * m.weights[None, :] * (pooled > 0)
            g_vectors = np.zeros_like(vectors)
            g_filters, g_biases = [np.zeros_like(f) for f in m.filters], []
            for k, width in enumerate(WIDTHS):
                own = g_pooled[:, k * FILTERS : (k + 1) * FILTERS]
                g_biases.append(own.sum(0))
                doc, f = np.nonzero(own)
                pos, value = where[k][doc, f], own[doc, f]
                for j in range(width):
                    word = local[pos + j]
                    np.add.at(g_filters[k][j].T, f, value[:, None] * vectors[word])
                    np.add.at(g_vectors, word, value[:, None] * m.filters[k][j][:, f].T)
            self.step += 1
            touched = np.flatnonzero(np.abs(g_vectors).sum(1))
            if len(touched):
                n = size[touched]
                ends = np.cumsum(n)
                b = mine[np.repeat(starts[touched] - (ends - n), n) + np.arange(ends[-1])]
                grad = np.repeat(g_vectors[touched] / n[:, None].astype(np.float32), n, axis=0)
                rank = np.argsort(b, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], np.diff(b[rank]) > 0]))
                b, grad = b[rank[first]], np.add.reduceat(grad[rank], first, axis=0)
                self.square[b] += (grad * grad).mean(1)
                m.embedding[b] -= (0.05 / np.sqrt(self.square[b]))[:, None] * grad
            grads = [*g_filters, *g_biases, g_weights, np.array([g.sum()], np.float32)]
            for param, grad, (a, b) in zip(dense, grads, self.moments, strict=True):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad * grad - b)
                param -= RATE * (a / (1 - 0.9**self.step)) / (np.sqrt(b / (1 - 0.999**self.step)) + 1e-8)
            m.bias = float(dense[-1][0])

    def moves_from(self, start: Training, rows: int) -> pa.RecordBatch:
        """What moved since ``start``, times ``rows``, in units: a row per bucket; below 0, pieces of ``flat``."""
        buckets = np.flatnonzero(self.square != start.square)
        moved = np.column_stack([self.model.embedding[buckets] - start.model.embedding[buckets], self.square[buckets] - start.square[buckets]]).astype(np.float64)
        flat = self.flat() - start.flat()
        flat = np.concatenate([flat, np.zeros(-len(flat) % (DIMENSION + 1))]).reshape(-1, DIMENSION + 1)
        values = np.rint(np.concatenate([flat, moved]) * rows * UNIT).astype(np.int64)
        keys = np.concatenate([-1 - np.arange(len(flat)), buckets]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), rows)), *map(pa.array, values.T)], names=MOVES)


MOVES = ["_t_row", "_t_n", *[f"_t_v{j}" for j in range(DIMENSION + 1)]]


def pieces(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES // 2) -> Iterator[tuple[int, list[str], list[int]]]:
    """Shard, texts and labels of about ``limit`` bytes of rows that follow each other, whatever the batches."""
    shard, size, texts, labels = None, 0, [], []
    for batch in batches:
        for s, text, y in zip(*[batch.column(c).to_pylist() for c in ("_t_shard", "_t_text", "_t_y")], strict=True):
            if texts and (s != shard or size >= limit):
                yield shard, texts, labels
                size, texts, labels = 0, [], []
            shard = s
            size += len(text.encode())
            texts.append(text)
            labels.append(y)
    if texts:
        yield shard, texts, labels


def epoch(rows: DataFrame, training: Training, share: float, number: int) -> Training:
    """One pass over all shards of ``rows`` (_t_shard, _t_order, _t_text, _t_y)."""
    sent = rows.sparkSession.sparkContext.broadcast(training)

    def moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen, part, own = None, 0, 0, None
        for s, texts, labels in pieces(batches):
            if s != shard:
                if seen:
                    yield own.moves_from(sent.value, seen)
                shard, seen, part, own = s, 0, 0, sent.value.copy()
            own.learn(texts, np.array(labels, np.int64), share, np.random.default_rng([SEED, number, s, part]))
            seen, part = seen + len(texts), part + 1
        if seen:
            yield own.moves_from(sent.value, seen)

    schema = ", ".join(f"{c} {'int' if c == '_t_row' else 'bigint'}" for c in MOVES)
    own = rows.select("_t_shard", "_t_order", "_t_text", "_t_y").sortWithinPartitions("_t_shard", "_t_order", "_t_text")
    summed = own.mapInArrow(moves, schema).groupBy("_t_row").agg(*[F.sum(c).alias(c) for c in MOVES[1:]]).toArrow()
    sent.unpersist()
    key = summed.column("_t_row").to_numpy()
    mean = np.column_stack([summed.column(c).to_numpy() for c in MOVES[2:]]) / UNIT / summed.column("_t_n").to_numpy()[:, None]
    flat = np.flatnonzero(key < 0)
    flat = mean[flat[np.argsort(-key[flat])]].ravel()[: len(training.flat())]
    row = key >= 0
    return training.moved(flat, key[row], mean[row, :DIMENSION], mean[row, DIMENSION])


def thresholds(scored: DataFrame) -> DataFrame:
    """Per ``lang`` of ``scored`` (lang, logit, y) and for all rows (lang -1): the threshold, and its toxic and clean rows.

    The threshold is the middle of the widest gap between neighbouring logits that has the best F1
    (0 where only one class is known). Logits are ordered inside ranges only; what lies above a range
    is known from the ranges' totals.
    """
    cells = scored.select(F.explode(F.array(F.col("lang"), F.lit(-1))).alias("lang"), "logit", "y").groupBy("lang", "logit").agg(F.sum("y").alias("hits"), F.count("y").alias("rows"))
    cells = cells.withColumn("range", F.floor(F.col("logit") * RANGES))
    down = Window.partitionBy("lang").orderBy(F.desc("range"))
    above, all_rows = down.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("lang")
    ranges = cells.groupBy("lang", "range").agg(F.sum("hits").alias("hits"), F.sum("rows").alias("rows"), F.max("logit").alias("top")).select(
        "lang",
        "range",
        F.coalesce(F.sum("hits").over(above), F.lit(0)).alias("hits_above"),
        F.coalesce(F.sum("rows").over(above), F.lit(0)).alias("rows_above"),
        F.lead("top").over(down).alias("next_top"),
        F.sum("hits").over(all_rows).alias("toxic"),
        (F.sum("rows").over(all_rows) - F.sum("hits").over(all_rows)).alias("clean"),
    )
    inside = Window.partitionBy("lang", "range").orderBy(F.desc("logit"))
    counted = cells.join(ranges, ["lang", "range"]).select(
        "lang",
        "logit",
        "toxic",
        "clean",
        (F.col("hits_above") + F.sum("hits").over(inside)).alias("hits"),
        (F.col("rows_above") + F.sum("rows").over(inside)).alias("rows"),
        F.coalesce(F.lead("logit").over(inside), "next_top").alias("next"),
    )
    gap = F.coalesce(F.col("logit") - F.col("next"), F.lit(0.0))
    best = F.max(F.struct((2 * F.col("hits") / (F.col("rows") + F.col("toxic"))).alias("f1"), gap.alias("gap"), "logit", "next")).alias("best")
    middle = F.coalesce((F.col("best.logit") + F.col("best.next")) / 2, F.col("best.logit") - 1e-6)
    return counted.groupBy("lang", "toxic", "clean").agg(best).select("lang", "toxic", "clean", F.when(F.least("toxic", "clean") > 0, middle).otherwise(0.0).alias("threshold"))


def calibrate(model: Model, rows: DataFrame) -> None:
    """Set each language's threshold where the F1 of ``rows`` (_t_text, _t_y) is best.

    Languages with few rows of either class take the threshold of all rows.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in array_slices(batch.column("_t_text")):
                w = Words(texts)
                lang, y = languages_of(w, w.lowered()).astype(np.int32), batch.column("_t_y").slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(sent.value.logits(texts).astype(np.float64)), y], names=["lang", "logit", "y"])

    found = {r["lang"]: r for r in thresholds(rows.select("_t_text", "_t_y").mapInArrow(logits, "lang int, logit double, y int")).collect()}
    sent.unpersist()
    if found:
        enough = [k in found and min(found[k]["toxic"], found[k]["clean"]) >= 8 for k in range(len(model.shift))]
        model.shift = np.array([found[k if own else -1]["threshold"] for k, own in enumerate(enough)])


def held_out(id_column: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5 is 0; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Train and calibrate on all labelled rows that aren't held out."""
    allowed = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column)).groupBy(F.col(id_column).alias("_t_id")).agg((F.max(label) > 0).cast("int").alias("_t_y"))
    many = allowed.count()
    shards = max(1, round(many * (1 - 1 / CALIBRATE_ONE_IN) / SHARD_ROWS))
    known = docs.where(F.col(id_column).isNotNull() & ~held_out(id_column)).select(F.col(id_column).alias("_t_id"), F.coalesce(F.col(text), F.lit("")).alias("_t_text"))
    # the hash that repartition uses too: rows of one shard lie in one partition, either way
    shard = F.pmod(F.hash("_t_id"), F.lit(shards)).alias("_t_shard")
    few = many <= BROADCAST_LABELS
    known = known.join(F.broadcast(allowed), "_t_id") if few else known.repartition(shards, "_t_id").join(allowed.repartition(shards, "_t_id"), "_t_id")
    known = known.select("_t_text", "_t_y", F.xxhash64("_t_id", "_t_text").alias("_t_order"), (F.xxhash64(F.lit(11), "_t_id") % CALIBRATE_ONE_IN == 0).cast("int").alias("_t_part"), shard)
    known = known.repartition("_t_shard") if few else known
    path = f"{checkpoint_folder(docs.sparkSession)}/table-{uuid.uuid4().hex}"
    known.write.partitionBy("_t_part", "_t_shard").option("compression", "zstd").parquet(path)
    known = docs.sparkSession.read.schema(known.schema).parquet(path)
    rows = known.where("_t_part = 0")
    n, toxic = rows.agg(F.count("_t_y"), F.coalesce(F.sum("_t_y"), F.lit(0))).first()
    training = Training.start()
    share = toxic / n if n else 0.0
    if not 0 < share < 1:
        training.model.constant = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return training.model
    for number in range(EPOCHS):
        training = epoch(rows, training, share, number)
    calibrate(training.model, known.where("_t_part = 1"))
    return training.model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with ``_t_score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            logits = np.concatenate([np.zeros(0), *[sent.value.logits(t) for t in array_slices(texts)]])
            yield pa.array(1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -60, 60))))

    # not deterministic for the planner: scored once per row, wherever the score is used
    return docs.withColumn("_t_score", scored.asNondeterministic()(F.col(text)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("_t_score").alias("score"), (F.col("_t_score") >= 0.5).cast("int").alias("predicted"))
