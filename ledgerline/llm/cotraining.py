"""Quality of documents by co-training two views.

One classifier sees a document's text content (shares of hashed byte triples),
the other its metadata and layout (source, language, length, lines, kinds of
signs). Each is fitted on labelled rows. A round is one pass over all documents
without a label: each view labels those it is sure of, and the other view takes a
Newton step towards them. What a task gives for that are sums over its documents,
of a size that the views fix; the sums are added up in two steps, and together
weigh as much as a share of the labelled rows, however many documents there are.
Sums are of whole numbers, so they do not depend on how documents are dealt.
Both views are calibrated on labelled rows kept apart and combined by a logistic
function fitted on the same rows. All documents are scored in one pass without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import LOWER, SPACE, Tables, arrow_map, arrow_schema, mix

#: A document goes below this probability: a good document lost counts for more than a bad one kept.
THRESHOLD = 0.3
#: A view labels a document beyond this probability; all such labels together weigh as this share of the labelled rows.
SURE, SHARE = 0.95, 0.45
#: Whole steps of a column and of a residual in sums over documents, and the bound of a column.
FINE, RESIDUAL, FAR = 64, 256, 10
TRIPLES, SOURCES, LANGS = 512, 32, 8
TEXT_SIZE = TRIPLES + 3
_KIND = np.full(256, 7, np.uint8)
_KIND[SPACE] = 0
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
for _sign in b".,;:'\"()-":
    _KIND[_sign] = 4
for _sign in b"#*$%&|<>=_{}[]\\~^@":
    _KIND[_sign] = 5
for _sign in b"!?":
    _KIND[_sign] = 6
META_SIZE = SOURCES + LANGS + 8 + 12


def text_view(text: bytes) -> np.ndarray:
    """Square roots of the shares of hashed byte triples, and how often words repeat."""
    out = np.zeros(TEXT_SIZE, np.float32)
    data = LOWER[np.frombuffer(text, np.uint8)].astype(np.uint32)
    if len(data) >= 3:
        triples = (data[:-2] | data[1:-1] << 8 | data[2:] << 16) * np.uint32(2654435769)
        out[:TRIPLES] = np.sqrt(np.bincount(triples >> np.uint32(23), minlength=TRIPLES) / len(triples))
    words = text.split()
    if words:
        distinct = len(set(words))
        out[TRIPLES:] = [sum(map(eq, words, words[1:])) / len(words), distinct / len(words), np.log(distinct) / np.log(1 + len(words))]
    return out


def _slot(value: str | None, slots: int) -> int:
    """A slot for a name; missing names have the first."""
    if value is None:
        return 0
    sums = np.frombuffer(value.encode(), np.uint8).astype(np.uint64) * (np.arange(len(value.encode()), dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    return 1 + int(mix(sums.sum(keepdims=True, dtype=np.uint64))[0] % np.uint64(slots - 1))


def meta_view(text: bytes, source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """What is known of a document besides its wording."""
    out = np.zeros(META_SIZE, np.float32)
    out[_slot(source, SOURCES)] = 1
    out[SOURCES + _slot(lang, LANGS)] = 1
    at = SOURCES + LANGS
    data = np.frombuffer(text, np.uint8)
    kinds = np.bincount(_KIND[data], minlength=8) / max(1, len(data))
    out[at : at + 8] = np.sqrt(kinds)
    lines = [x for x in text.split(b"\n") if x.strip()]
    words = 1 + int((SPACE[data[1:]] & ~SPACE[data[:-1]]).sum()) if len(data) else 0
    sizes = [len(x) for x in lines] or [0]
    out[at + 8 :] = [
        np.log1p(len(data)), np.log1p(max(0, n_chars or 0)), float(n_chars is None), np.log1p(len(lines)), np.log1p(np.mean(sizes)), np.log1p(np.std(sizes)),
        len(set(lines)) / max(1, len(lines)), sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / max(1, len(lines)),
        sum(x.lstrip()[:1] in (b"-", b"*", b"#", b"|") for x in lines) / max(1, len(lines)), len(data) / max(1, words), np.log1p(words), float(not len(data)),
    ]
    return out


@dataclass
class Linear:
    """Ridge logistic regression on standardized columns."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 5.0) -> Linear:
        centre, spread = x.mean(0), x.std(0)
        scale = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0)
        z = np.c_[(x - centre) * scale, np.ones(len(x))].astype(np.float64)
        w = np.zeros(z.shape[1])
        held = np.r_[np.full(x.shape[1], ridge), 1e-6]
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = z.T @ (weight * (y - p)) - held * w
            bend = (z * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z + np.diag(held)
            step = np.linalg.solve(bend, slope)
            w += step
            if np.abs(step).max() < 1e-4:
                break
        return Linear(centre, scale, w[:-1], float(w[-1]))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) * self.scale) @ self.weights + self.bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Model:
    """Both views, their calibration (slope and bias each) and their combination; `text` is None without usable labels."""

    text: Linear | None = None
    meta: Linear | None = None
    calibration: tuple = ((1.0, 0.0), (1.0, 0.0))
    combination: tuple = (1.0, 1.0, 0.0)

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Probability of good quality by the text, by the metadata and by both."""
        a, b = (slope * view.logit(x) + bias for view, x, (slope, bias) in zip((self.text, self.meta), (text, meta), self.calibration))
        first, second, bias = self.combination
        return np.c_[_sigmoid(a), _sigmoid(b), _sigmoid(first * np.clip(a, -12, 12) + second * np.clip(b, -12, 12) + bias)]


def sums(text: np.ndarray, meta: np.ndarray, views: list[Linear], sure: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """What each view learns from the rows that the other one is sure of: their number, slope and curvature, in whole numbers."""
    told = [_sigmoid(v.logit(x)) for v, x in zip(views, (text, meta))]
    out = []
    for view, x, other in ((views[0], text, told[1]), (views[1], meta, told[0])):
        confident = (other >= sure) | (other <= 1 - sure)
        z = np.clip(np.rint((x[confident] - view.centre) * view.scale * FINE), -FAR * FINE, FAR * FINE).astype(np.float64)
        z = np.c_[z, np.full(len(z), float(FINE))]
        p = _sigmoid(z @ np.r_[view.weights, view.bias] / FINE)
        residual = np.rint(((other[confident] >= 0.5) - p) * RESIDUAL)
        curve = np.maximum(np.rint(p * (1 - p) * RESIDUAL), 1)
        # Products stay below 2**53, so these are exact.
        out.append((len(z), (z.T @ residual).astype(np.int64), ((z * curve[:, None]).T @ z).astype(np.int64)))
    return out


def _step(view: Linear, x: np.ndarray, y: np.ndarray, learned: tuple[int, np.ndarray, np.ndarray], ridge: float = 5.0) -> Linear:
    """`view` after one Newton step on labelled rows and on what the other view taught."""
    z = np.c_[(x - view.centre) * view.scale, np.ones(len(x))].astype(np.float64)
    w, held = np.r_[view.weights, view.bias], np.r_[np.full(x.shape[1], ridge), 1e-6]
    p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
    count, slope, bend = learned
    weight = SHARE * len(x) / max(1, count)
    slope = z.T @ (y - p) + weight * slope / (FINE * RESIDUAL) - held * w
    bend = (z * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ z + weight * bend / (FINE * FINE * RESIDUAL) + np.diag(held)
    w = w + np.linalg.solve(bend, slope)
    return Linear(view.centre, view.scale, w[:-1], float(w[-1]))


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: Callable[[list[Linear]], list[tuple[int, np.ndarray, np.ndarray]]], rounds: int = 3) -> Model:
    """Fits both views on rows and pool; a third of the labelled rows calibrates.

    `pool` gives `sums` over all rows without a label for the present views.
    """
    kept = np.arange(len(y)) % 3 == 0
    train = ~kept
    if len(set(y[train])) < 2 or len(set(y[kept])) < 2:
        return Model()
    views = [Linear.fit(x[train], y[train], np.ones(train.sum())) for x in (text, meta)]
    for _ in range(rounds):
        views = [_step(v, x[train], y[train], learned) for v, x, learned in zip(views, (text, meta), pool(views))]
    logits = [v.logit(x[kept]) for v, x in zip(views, (text, meta))]
    calibration = []
    for logit in logits:
        one = Linear.fit(logit[:, None], y[kept], np.ones(kept.sum()), ridge=1.0)
        slope = float(one.weights[0] * one.scale[0])
        calibration.append((slope, float(one.bias - slope * one.centre[0])))
    both = np.c_[tuple(np.clip(s * x + b, -12, 12) for x, (s, b) in zip(logits, calibration))]
    top = Linear.fit(both, y[kept], np.ones(kept.sum()), ridge=1.0)
    w = top.weights * top.scale
    return Model(views[0], views[1], tuple(calibration), (float(w[0]), float(w[1]), float(top.bias - w @ top.centre)))


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns that the views read; a missing one is null."""
    kinds = {"source": "string", "lang": "string", "n_chars": "bigint"}
    extra = [(F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(f"_{c}") for c, kind in kinds.items()]
    return docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"), *extra)


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    columns = [batch.column(batch.schema.get_field_index(f"_{c}")).to_pylist() for c in ("text", "source", "lang", "n_chars")]
    texts = [(t or "").encode() for t in columns[0]]
    if not texts:
        return np.zeros((0, TEXT_SIZE), np.float32), np.zeros((0, META_SIZE), np.float32)
    return np.stack([text_view(t) for t in texts]), np.stack([meta_view(t, *rest) for t, *rest in zip(texts, *columns[1:])])


SUMS = "view int, n bigint, slope binary, bend binary"


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a partition's rows, one row per view."""
    total: dict[int, list] = {}
    for batch in batches:
        for view, n, *parts in zip(*(column.to_pylist() for column in batch.columns)):
            arrays = [np.frombuffer(x, np.int64) for x in parts]
            held = total.setdefault(view, [0, *(np.zeros_like(x) for x in arrays)])
            held[0] += n
            for k, x in enumerate(arrays):
                held[1 + k] = held[1 + k] + x
    yield _sums_batch([(view, n, slope, bend) for view, (n, slope, bend) in sorted(total.items())])


def _sums_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("view", pa.int32()), ("n", pa.int64()), ("slope", pa.binary()), ("bend", pa.binary()))
    columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2].tobytes() for r in rows], [r[3].tobytes() for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds)], names=[name for name, _ in kinds])


def learned(tables: Tables, rows: DataFrame, views: list[Linear], sure: float = SURE) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """`sums` over all `rows`, each task's first, then in groups, then altogether."""
    held = rows.sparkSession.sparkContext.broadcast(views)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            found = sums(*_views(batch), held.value, sure)
            total = found if total is None else [(n + m, a + c, b + d) for (n, a, b), (m, c, d) in zip(total, found)]
        if total is not None:
            yield _sums_batch([(view, *parts) for view, parts in enumerate(total)])

    few = {"spark.sql.execution.arrow.maxRecordsPerBatch": "8"}
    tasks = tables.save("sums", rows.mapInArrow(run, SUMS))
    groups = tables.save("groups", tasks.repartition("view", F.xxhash64("slope")).mapInArrow(_added, SUMS), **few)
    whole = tables.save("whole", groups.coalesce(1).mapInArrow(_added, SUMS), **few).collect()
    out = []
    for view, x in enumerate(views):
        size = len(x.weights) + 1
        mine = [r for r in whole if r.view == view]
        out.append((mine[0].n, np.frombuffer(mine[0].slope, np.int64), np.frombuffer(mine[0].bend, np.int64).reshape(size, size)) if mine else (0, np.zeros(size, np.int64), np.zeros((size, size), np.int64)))
    return out


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", labelled_rows: int = 6000, rounds: int = 3) -> Model:
    """A model from at most `labelled_rows` labelled documents and all documents without a label.

    The labelled ones are those of the least hashes of their id. Several labels of
    one document count by their mean; labels that are null or have no document are
    left out. Where the labels hold one class or none, the model keeps every document.
    """
    tables = Tables(docs.sparkSession, "cotraining")
    rows = _input(docs, id_col, text_col)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("_label_id"))
    known = known.agg((F.avg(label_col) >= 0.5).cast("int").alias("_y"))
    # Bounded by a parameter: safe to send to every task.
    picked = tables.save("labels", known.orderBy(F.xxhash64("_label_id"), "_label_id").limit(labelled_rows))
    marked = rows.join(F.broadcast(picked), F.col("_id") == F.col("_label_id"), "left").drop("_label_id")

    schema = arrow_schema("y int, id bigint, text binary, meta binary")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta = _views(batch)
            columns = [batch.column(batch.schema.get_field_index("_y")), batch.column(0), pa.array([x.tobytes() for x in text], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    got = marked.where("_y is not null").mapInArrow(make, "y int, id bigint, text binary, meta binary")
    # Rows that repeat an id could be many: as many count as ids may.
    got = sorted(got.orderBy("id", "text", "meta").limit(labelled_rows).collect(), key=lambda r: (r.id, r.text, r.meta))
    matrix = lambda name, width: np.array([np.frombuffer(r[name], np.float32) for r in got], np.float32).reshape(-1, width)
    others = marked.where("_y is null").drop("_y")
    return cotrain(matrix("text", TEXT_SIZE), matrix("meta", META_SIZE), np.array([r.y for r in got], float), lambda views: learned(tables, others, views), rounds)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_score, meta_score, score, kept) for each row of `docs`.

    Scores are probabilities of good quality; without a model they are null and
    every row is kept. Null texts count as empty, missing source, language or
    length as unknown. Each row is judged by itself, repeated ids and rows
    without id included. No rows give no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> dict:
        n = batch.num_rows
        if held.value.text is None:
            return {"id": batch.column(0), "text_score": [None] * n, "meta_score": [None] * n, "score": [None] * n, "kept": [True] * n}
        scores = held.value.scores(*_views(batch))
        return {"id": batch.column(0), "text_score": scores[:, 0], "meta_score": scores[:, 1], "score": scores[:, 2], "kept": scores[:, 2] >= threshold}

    schema = "id bigint, text_score double, meta_score double, score double, kept boolean"
    return arrow_map(_input(docs, id_col, text_col), schema, make).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `score` keeps, unchanged and without a shuffle."""
    if model.text is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    kinds = {"source": "string", "lang": "string", "n_chars": "bigint"}
    # Numbered columns: none of the input's names can clash with those that the views read.
    numbered = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own = {name: F.col(f"c{i}") for i, name in enumerate(names)}
    wide = numbered.select("*", own[text_col].alias("_text"), *(own.get(c, F.lit(None)).cast(k).alias(f"_{c}") for c, k in kinds.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = held.value.scores(*_views(batch))[:, 2] >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))], names=names).filter(pa.array(good))

    return wide.mapInArrow(run, docs.schema)
