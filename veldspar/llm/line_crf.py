"""Quality classifier: a linear-chain conditional random field labels every line good or bad, from features of the
line and its neighbours; its forward-backward marginals, weighted by length, are the document's quality.

Training labels are those of documents. A first chain takes them for each line; lines that it finds to be clearly of
the other kind change their label, unless that would leave a document no line of its own label; the chain that counts
is then fitted to these lines, so that it has seen good and bad lines beside each other. The fit uses a bounded sample
of labelled rows, TRAIN_DOCS and DOC_CHAINS; it runs on the driver over line features alone. Scoring reads every line
of every text where it lies, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: At most so many labelled rows fit the model, chosen by a hash of their ids; lines of one training chain, and chains
#: of one row, evenly spread over it: at most 4,000 * 8 * 64 lines of 52 bytes reach the driver.
TRAIN_DOCS, CHAIN_LINES, DOC_CHAINS = 4000, 64, 8
#: A training line changes its label if the first chain gives its document's label less than this.
DOUBT = 0.05
FIRST_STEPS, STEPS, RATE, DECAY = 80, 300, 0.08, 2e-3
THRESHOLD = 0.7
HELD_OUT_FOLD, FOLDS = 2, 4
_UPPER, _DIGIT, _SYMBOL, _MARK, _STOP = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b"!|", b".,;:?"
N_LINE = 13


def line_features(line: str) -> tuple[float, ...]:
    raw = line.encode("utf-8", "replace")
    words = raw.split()
    n, k = len(raw), len(words)
    upper, digit, symbol, mark, stop = ((n - len(raw.translate(None, s))) / n for s in (_UPPER, _DIGIT, _SYMBOL, _MARK, _STOP))
    distinct = len(set(words)) / k
    size = (n - k + 1) / k
    return (
        min(k, 100) / 100, float(k >= 8), upper, float(upper > 0.4), digit, symbol * 5, float(symbol > 0.08), mark * 5, float(mark > 0.06),
        float(stop > 0), distinct, float(distinct < 0.5), min(size, 20) / 20,
    )


def document_lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines, N_LINE) and lengths in characters of the lines with a word."""
    lines = [x for x in text.split("\n") if x.encode("utf-8", "replace").split()]
    if not lines:
        return np.empty((0, N_LINE)), np.empty(0)
    return np.array([line_features(x) for x in lines]), np.array([len(x) for x in lines], float)


def with_neighbours(own: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after (0 beyond a document's ends), flags of the ends and 1."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[last] = 0, 0
    return np.hstack([own, before, after, first[:, None], last[:, None], np.ones((len(own), 1))])


@dataclass
class Chain:
    """Unary weights of the label good against bad, log potentials of the transitions [from, to]."""

    weights: np.ndarray
    moves: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def unary(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def marginals(self, unary: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """P(good) of each line by forward-backward; chains of the given sizes lie one after the other."""
        return _forward_backward(unary, sizes, np.exp(self.moves))[0]


def _forward_backward(unary: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals, and the expected counts of transitions over all chains."""
    start = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    sizes, start = sizes[order], start[order]
    good = 1 / (1 + np.exp(-np.clip(unary, -60, 60)))
    emit = np.stack((1 - good, good), 1) + 1e-30
    ahead, behind = np.empty_like(emit), np.empty_like(emit)
    longest = int(sizes[0]) if len(sizes) else 0
    active = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest + 1)]  # chains longer than t
    for t in range(longest):
        at = start[: active[t]] + t
        now = emit[at] if t == 0 else (ahead[at - 1] @ moves) * emit[at]
        ahead[at] = now / now.sum(1, keepdims=True)
    counts = np.zeros((2, 2))
    for t in range(longest - 1, -1, -1):
        at = start[: active[t]] + t
        now = np.ones((len(at), 2))
        if t + 1 < longest and (n := active[t + 1]):
            nxt = emit[at[:n] + 1] * behind[at[:n] + 1]
            now[:n] = nxt @ moves.T
            pair = ahead[at[:n], :, None] * moves[None] * nxt[:, None, :]
            counts += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        behind[at] = now / now.sum(1, keepdims=True)
    both = ahead * behind
    return both[:, 1] / both.sum(1), counts


def fit(x: np.ndarray, sizes: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Chain:
    """Maximum likelihood with L2 decay by Adam over all chains at once; labels are one for each line."""
    mean, scale = x.mean(0), x.std(0)
    mean[scale < 1e-9], scale[scale < 1e-9] = 0, 1
    z = (x - mean) / scale
    y, seen = labels.astype(float), np.zeros((2, 2))
    inside = np.ones(max(len(y) - 1, 0), bool)
    inside[(np.cumsum(sizes) - 1)[:-1]] = False
    np.add.at(seen, (labels[:-1][inside], labels[1:][inside]), 1)
    theta, m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    for step in range(1, steps + 1):
        p, counts = _forward_backward(z @ theta[:-4], sizes, np.exp(theta[-4:].reshape(2, 2)))
        grad = np.concatenate((z.T @ (p - y), (counts - seen).ravel())) / len(y) + DECAY * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Chain(theta[:-4], theta[-4:].reshape(2, 2), mean, scale)


def line_labels(first: Chain, x: np.ndarray, documents: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels of lines from those of their documents: a line that the unary weights of the first chain doubt takes the
    other label, unless its document would keep no line of its own. documents names each line's document."""
    good = 1 / (1 + np.exp(-np.clip(first.unary(x), -60, 60)))
    doubted = np.where(labels == 1, good, 1 - good) < DOUBT
    left = np.bincount(documents, ~doubted)
    return np.where(doubted & (left[documents] > 0), 1 - labels, labels)


def training_chains(own: np.ndarray) -> list[np.ndarray]:
    """Chains of CHAIN_LINES lines; of a document with more than DOC_CHAINS, so many evenly spread ones."""
    starts = np.arange(0, len(own), CHAIN_LINES)
    if len(starts) > DOC_CHAINS:
        starts = starts[np.linspace(0, len(starts) - 1, DOC_CHAINS).astype(int)]
    return [own[a : a + CHAIN_LINES] for a in starts]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [np.concatenate([np.empty((0, N_LINE)), *training_chains(document_lines(t.as_py() or "")[0])]).astype(np.float32).tobytes() for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(1).cast(pa.int32()), batch.column(2)], names=["lines", "label", "place"])


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCS) -> Chain | None:
    """Fits the chain to at most `most` labelled rows outside the held-out fold; None where they don't hold both
    labels. Ids whose labels differ are left out, repeated labels count once, null texts and ids not at all."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~is_held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("other")).where("label = other")
    chosen = known.select("__id", "label").orderBy(F.xxhash64("__id"), "__id").limit(most)
    # at most `most` rows: a bound that doesn't grow with the input
    texts = documents.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    met = texts.join(F.broadcast(chosen), "__id").select("t", "label", F.xxhash64("__id").alias("place")).mapInArrow(_features, "lines binary, label int, place long")
    rows = met.where(F.length("lines") > 0).orderBy("place", "lines").limit(most).collect()  # ids may repeat
    chains, ys, owners = [], [], []
    for k, r in enumerate(rows):
        own = np.frombuffer(r["lines"], np.float32).reshape(-1, N_LINE).astype(float)
        for chain in (own[a : a + CHAIN_LINES] for a in range(0, len(own), CHAIN_LINES)):
            chains.append(chain)
            ys.append(np.full(len(chain), r["label"]))
            owners.append(np.full(len(chain), k))
    if len({r["label"] for r in rows}) < 2:
        return None
    sizes, y, owner = np.array([len(c) for c in chains]), np.concatenate(ys), np.concatenate(owners)
    x = _stacked(chains, sizes)
    return fit(x, sizes, line_labels(fit(x, sizes, y, FIRST_STEPS), x, owner, y))


def _stacked(chains: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    first, last = np.zeros(sizes.sum(), bool), np.zeros(sizes.sum(), bool)
    first[np.cumsum(sizes) - sizes], last[np.cumsum(sizes) - 1] = True, True
    return with_neighbours(np.vstack(chains), first, last)


def _scorer(chain: Chain | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [document_lines(t.as_py() or "") for t in batch.column(1)]
            scores = np.zeros(len(own))
            full = [k for k, (x, _) in enumerate(own) if len(x)]
            if chain is None:
                scores[full] = 0.5
            elif full:
                sizes = np.array([len(own[k][0]) for k in full])
                p = chain.marginals(chain.unary(_stacked([own[k][0] for k in full], sizes)), sizes)
                weight = np.concatenate([own[k][1] for k in full])
                at = np.cumsum(sizes) - sizes
                scores[full] = np.clip(np.add.reduceat(p * weight, at) / np.add.reduceat(weight, at), 0, 1)
            lines = [len(x) for x, _ in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(lines, pa.int64())], names=["id", "score", "n_lines"])

    return run


def score_quality(documents: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id_col, held_out, score, predicted (1 if score >= threshold) and n_lines.

    A null or empty text has no line and scores 0. Without a chain (no labels of both kinds) other texts score
    0.5. A null id is never held out. Repeated rows and texts of the same lines get equal scores; every line of a text
    of any length counts; other columns play no part; an empty table gives an empty result.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    slim = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = slim.mapInArrow(_scorer(chain), f"id {kind}, score double, n_lines long")
    return scored.select(F.col("id").alias(id_col), is_held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_lines")


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = train(documents, C.table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score_quality(documents, chain)
