"""A quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Statistics of each whole text are JVM expressions, and so is the trained model: a score needs no Python worker. Random Fourier features approximate a Gaussian kernel over the standardised
statistics. The normal equations are summed within each partition, then in a tree of partitions, so that the driver gets a fixed
number of fixed-size sums. Scores of rows held back from the ridge are binned and pooled into a monotone calibration.

Training reads at most ``max_rows`` labelled rows (by a hash of the id; all of them if there are fewer), the one bound here, and
takes statistics of these rows only.
Neither ids nor language nor source are inputs of a score.

Defined results: a null or empty text has all statistics zero and a score like any other; rows without a label only do not
train; several labels of an id are averaged; where all labelled rows are of fold 4 the ridge learns from these,
and where none is the calibration reads the rows that the ridge learned from; without any labels every score is 0.5; repeated rows keep their rows; extra
columns are carried along by ``score`` and a column named like the new one is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

FEATURES, MAX_ROWS, CUT = 192, 200_000, 0.3


def statistics(text: str = "text") -> list:
    """Document statistics, each between 0 and about 1, in one pass of built-in functions."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.filter(F.split(t, "[ \\t\\r\\n]+", -1), lambda w: w != "")
    count = F.greatest(F.size(words), F.lit(1)).cast("double")
    letters = F.greatest(F.regexp_count(t, F.lit("\\p{L}")), F.lit(1)).cast("double")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x != "")
    share = lambda pattern, of: F.regexp_count(t, F.lit(pattern)) / of
    return [
        F.log1p(F.length(t).cast("double")) / 12,
        share("\\p{Lu}", letters),
        share("[^\\p{L}\\p{N}\\s.,;:'\"()?-]", n) * 3,
        share("\\p{N}", n) * 5,
        share("[.,;:?]", count),
        F.size(F.array_distinct(words)) / count,
        share("(?<!\\S)(\\S+)\\s(?=\\1(?!\\S))", count),
        (n - F.size(words)) / count / 12,
        share("(?<!\\S)\\p{L}{1,3}(?!\\S)", count),
        share("(?<!\\S)[^\\p{L}\\p{N}]+(?!\\S)", count),
        F.when(F.size(lines) > 0, F.size(F.array_distinct(lines)) / F.size(lines)).otherwise(F.lit(1.0)),
        F.log1p(count / F.greatest(F.size(lines), F.lit(1))) / 8,
    ]


def with_statistics(docs: DataFrame, *, text: str = "text", out: str = "stats") -> DataFrame:
    return docs.withColumn(out, F.array(*[F.coalesce(s, F.lit(0.0)) for s in statistics(text)]))


def fold(id: str = "doc_id"):
    return F.crc32(F.col(id).cast("string").cast("binary")) % 5


def _double(x) -> str:
    return f"{float(x)!r}D"


def _array(xs) -> str:
    return f"array({', '.join(xs)})"


class Model:
    """Everything that a score needs: scales, random directions, ridge weights and the calibration's knots."""

    def __init__(self, mean, scale, width, seed=7, features=FEATURES):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.asarray(mean), np.asarray(scale)
        self.w = rng.normal(size=(len(self.mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.beta, self.x, self.y = None, np.array([0.0]), np.array([0.5])

    def features(self, stats):
        z = np.clip((np.nan_to_num(stats) - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(z), 1))])

    def raw(self, stats):
        return self.features(stats) @ self.beta

    def score(self, stats):
        if self.beta is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), self.x, self.y), 0, 1)

    def raw_sql(self, stats: str) -> str:
        """SQL of ``raw``: an inner product for each direction, summed with its cosine's weight."""
        given = "array(" + ", ".join(f"(greatest(-6D, least(6D, (nvl(nanvl({stats}[{i}], 0D), 0D) - {float(m)!r}D) / {float(s)!r}D)))" for i, (m, s) in enumerate(zip(self.mean, self.scale))) + ")"
        turn = np.sqrt(2 / len(self.b)) * self.beta[:-1]
        terms = _array(f"named_struct('w', {_array(map(_double, w))}, 'b', {_double(b)}, 'c', {_double(c)})" for w, b, c in zip(self.w.T, self.b, turn))
        inner = "aggregate(zip_with(z, t.w, (x, y) -> x * y), 0D, (s, x) -> s + x)"
        return f"transform(array({given}), z -> aggregate({terms}, {_double(self.beta[-1])}, (s, t) -> s + t.c * cos({inner} + t.b)))[0]"

    def score_sql(self, stats: str) -> str:
        """SQL of ``score``: the calibration is linear between knots and flat beyond them."""
        if self.beta is None:
            return "0.5D"
        knots = _array(f"named_struct('x', {_double(x)}, 'y', {_double(y)})" for x, y in zip(self.x, self.y))
        last = len(self.x) - 1
        line = "k[i - 1].y + (k[i].y - k[i - 1].y) * (r - k[i - 1].x) / (k[i].x - k[i - 1].x)"
        at = f"transform(array(size(filter(k, q -> q.x <= r))), i -> CASE WHEN i = 0 THEN k[0].y WHEN i > {last} THEN k[{last}].y ELSE {line} END)[0]"
        return f"greatest(0D, least(1D, transform(array({knots}), k -> transform(array({self.raw_sql(stats)}), r -> {at})[0])[0]))"


def _sums(rows: DataFrame, model: Model) -> np.ndarray:
    """[Z'Z | Z'y] over ``rows(stats, y)``: summed by partition, then by groups of partitions."""
    size = model.w.shape[1] + 1

    def first(batches):
        import pyarrow as pa

        total = np.zeros((size, size + 1))
        for b in batches:
            if b.num_rows:
                z = model.features(np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1))
                total[:, :size] += z.T @ z
                total[:, size] += z.T @ np.asarray(b.column(1))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def again(batches):
        import pyarrow as pa

        total = np.zeros((size, size + 1))
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_py()).reshape(size, size + 1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    parts = rows.select("stats", "y").mapInArrow(first, "s binary")
    parts = parts.repartition(64).mapInArrow(again, "s binary").repartition(8).mapInArrow(again, "s binary")
    return sum(np.frombuffer(r.s).reshape(size, size + 1) for r in parts.collect())


def _isotonic(bins) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over (x, weight, sum of y), sorted by x."""
    pools = []
    for x, w, s in bins:
        pools.append([x * w, w, s])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def marked(labels: DataFrame, *, id: str = "doc_id", label: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """(id, y) of the labelled rows to learn from: those whose fold is not 0, about ``max_rows`` of them at most."""
    marks = materialise(labels.filter(F.col(id).isNotNull() & F.col(label).isNotNull()).filter(fold(id) != 0).groupBy(id).agg(F.avg(label).alias("y")))
    total = marks.count()
    return marks.filter(F.pmod(F.xxhash64(id), F.lit(1_000_000)) < int(1_000_000 * max_rows / total)) if total > max_rows else marks


def train_on(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """A model from ``docs(id, text)`` and ``labels(id, label)``. The labelled ids are bounded by ``max_rows``, so they are
    broadcast, no text is shuffled, and only labelled texts have statistics taken."""
    marks = marked(labels, id=id, label=label, max_rows=max_rows)
    known = docs.select(id, text).join(F.broadcast(marks.select(id)), id, "left_semi")
    return train(with_statistics(known, text=text).select(id, "stats"), labels, id=id, label=label, max_rows=max_rows)


def train(stats: DataFrame, labels: DataFrame, *, id: str = "doc_id", label: str = "quality", ridge: float = 1e-3, width: float = 3.0, max_rows: int = MAX_ROWS) -> Model:
    """A model from ``stats(id, stats)`` and ``labels(id, label)``, learning from the rows whose fold is not 0."""
    marks = F.broadcast(marked(labels, id=id, label=label, max_rows=max_rows))
    rows = materialise(stats.select(id, "stats").join(marks, id).withColumn("fold", fold(id)))
    k = len(statistics())
    moments = rows.agg(*[f(F.col("stats")[i]) for f in (F.avg, F.stddev_pop) for i in range(k)]).first()
    if moments[0] is None:
        return Model([0.0] * k, [1.0] * k, width)
    model = Model(moments[:k], [max(s, 1e-3) for s in moments[k:]], width)
    sums = _sums(rows.filter("fold <> 4"), model)
    if not sums.any():
        sums = _sums(rows, model)
    a, y = sums[:, :-1], sums[:, -1]
    model.beta = np.linalg.solve(a + ridge * max(a[-1, -1], 1) * np.eye(len(a)), y)
    held = rows.filter("fold = 4")
    held = rows if held.isEmpty() else held
    bins = held.withColumn("raw", F.expr(model.raw_sql("stats"))).groupBy(F.round(F.least(F.greatest("raw", F.lit(-1.0)), F.lit(2.0)) * 400).alias("bin")).agg(F.avg("raw"), F.count("*"), F.sum("y")).collect()
    model.x, model.y = _isotonic([tuple(r)[1:] for r in sorted(bins)])
    return model


def score(stats: DataFrame, model: Model, *, out: str = "score") -> DataFrame:
    """``stats`` with the calibrated score of each row."""
    return stats.withColumn(out, F.expr(model.score_sql("stats")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = materialise(with_statistics(docs).select("doc_id", "stats"))
    model = train(stats, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score(stats, model).select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
