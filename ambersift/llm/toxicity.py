"""Toxicity of whole texts: a linear classifier with counterfactual regularisation.

A text's logit is a bias plus the mean weight of its words; a word's weight is the sum
over its hashed features (the word, its beginnings and its ending), so unseen forms of a
known stem count too. Training minimises the logistic loss of a bounded sample of
labelled texts plus, for every identity term in them, the squared change of the logit
when the term is swapped for another of its group (a neutral one included). A group name
then carries no weight of its own, and neutral mentions are not taken for abuse.

The sample is bounded by ``sample_rows``; scoring covers every word of every text.

* Null, empty and blank texts get the score of the bias alone, a number from 0 to 1.
* Labels are joined by id. Without labelled texts of both classes all scores are the
  share of toxic labels, or 0 if there are none.
* Repeated rows and repeated labels count as often as they occur; rows without an id
  are scored but never learnt from; null labels are no labels.
* An empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import CHUNK, Words, mix, row_chunks, table, text_bytes

# Groups of interchangeable identity terms, the first of each neutral.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("person", "woman", "man", "girl", "boy", "transgender", "nonbinary", "lesbian", "gay", "bisexual", "queer", "straight"),
    ("people", "women", "men", "girls", "boys", "lesbians", "gays", "immigrants", "refugees", "foreigners", "elderly", "disabled"),
    ("religious", "christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"),
    ("believers", "christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists"),
    ("local", "black", "white", "asian", "african", "latino", "hispanic", "arab", "european", "american", "mexican", "chinese"),
)

BITS = 20  # hashed features: a model is 4 MB whatever the corpus
BEGINNINGS = (4, 5, 6, 7, 8)
ENDING = 5
SCALE = 50.0
_EDGE = np.zeros(256, bool)
_EDGE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_PUNCT = table(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")


def split(data: np.ndarray, rows: np.ndarray) -> Words:
    """Words, punctuation at their edges split off."""
    a, b = data[:-1], data[1:]
    return Words(data, rows, cut=np.flatnonzero((_EDGE[a] & _PUNCT[b]) | (_PUNCT[a] & _EDGE[b])) + 1)


def features(w: Words, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Feature numbers of the words ``at``, one row each; the last number stands for none."""
    start, length = w.start[at], w.end[at] - w.start[at]
    none = 1 << BITS
    padded = np.concatenate([np.zeros(8, np.uint8), w.data, np.zeros(8, np.uint8)]).astype(np.uint64)
    shift = np.uint64(64 - BITS)
    out = [(mix(hashes ^ np.uint64(0xA5A5)) >> shift).astype(np.int64)]
    packed = np.zeros(len(at), np.uint64)
    for k in range(max(BEGINNINGS)):
        packed = (packed << np.uint64(8)) | padded[8 + start + k]
        if k + 1 in BEGINNINGS:
            f = (mix(packed + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> shift).astype(np.int64)
            out.append(np.where(length > k, f, none))
    packed = np.zeros(len(at), np.uint64)
    for k in range(ENDING):
        packed = (packed << np.uint64(8)) | padded[8 + start + length - ENDING + k]
    f = (mix(packed ^ np.uint64(0x5EED5EED5EED)) >> shift).astype(np.int64)
    out.append(np.where(length >= ENDING, f, none))
    return np.stack(out, 1).astype(np.int32)


@dataclass
class Model:
    """Weights of the hashed features (the last one, for none, is 0) and the bias."""

    weights: np.ndarray
    bias: float

    def logits(self, column: pa.Array) -> np.ndarray:
        data, at = text_bytes(pc.utf8_lower(pc.fill_null(column, "")))
        out = np.full(len(column), self.bias)
        for a, b in row_chunks(at, 2 * CHUNK):
            w = split(data[at[a] : at[b]], at[a : b + 1] - at[a])
            if not len(w.start):
                continue
            hashes, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
            value = self.weights[features(w, hashes, first)].sum(1)
            n = np.diff(w.at)
            total = np.bincount(w.row, weights=value[back], minlength=b - a)
            out[a:b] += SCALE * total / np.maximum(n, 1)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(
    texts: pa.Array, labels: np.ndarray, groups: Sequence[Sequence[str]] = IDENTITY_GROUPS,
    pairing: float = 1.0, decay: float = 1e-5, steps: int = 300, rate: float = 0.05, doubt: float = 2.5,
) -> Model:
    """Full-batch Adam on the logistic loss plus ``pairing`` times the mean squared change
    of the logit under identity swaps, plus ``decay`` times the squared weights.

    A feature enters scaled by its log odds between the classes, less ``doubt`` standard
    errors; one whose odds may be chance is left out, so rare words are not learnt by heart."""
    labels = np.asarray(labels, float)
    weights = np.zeros((1 << BITS) + 1, np.float32)
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return Model(weights, float(np.log(share / (1 - share))) if 0 < share < 1 else (500.0 if share else -500.0))
    data, at = text_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    # One entry for each (text, word): the word's share of the text.
    rows, words, shares, parts, seen = [], [], [], [], np.zeros(0, np.uint64)
    for a, b in row_chunks(at, CHUNK):
        w = split(data[at[a] : at[b]], at[a : b + 1] - at[a])
        hashes, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
        pair, times = np.unique(w.row * len(hashes) + back, return_counts=True)
        row, word = np.divmod(pair, max(1, len(hashes)))
        rows.append((row + a).astype(np.int32))
        words.append(hashes[word])
        shares.append(times / np.diff(w.at)[row])
        new = ~np.isin(hashes, seen)
        parts.append((hashes[new], features(w, hashes[new], first[new])))
        seen = np.union1d(seen, hashes[new])
    terms = [t for g in groups for t in g]
    line = "\n".join(t.lower() for t in terms).encode()
    tw = Words(np.frombuffer(line, np.uint8), np.array([0, len(line)]))
    term_hash = tw.hash
    new = ~np.isin(term_hash, seen)
    parts.append((term_hash[new], features(tw, term_hash[new], np.flatnonzero(new))))
    known = np.concatenate([h for h, _ in parts])
    order = np.argsort(known)
    known, feats = known[order], np.concatenate([f for _, f in parts])[order]
    del parts, seen, order
    row, tf = np.concatenate(rows), SCALE * np.concatenate(shares)
    word = np.searchsorted(known, np.concatenate(words)).astype(np.int32)
    del rows, words, shares, data

    # Swaps: for every identity term in a text, each other term of its group.
    term_word = np.searchsorted(known, term_hash)
    group_of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    place = np.full(len(known), -1)
    place[term_word] = np.arange(len(terms))
    hit = np.flatnonzero(place[word] >= 0)
    load = np.bincount(place[word[hit]], weights=tf[hit] ** 2, minlength=len(terms))
    i, j = np.nonzero((group_of[:, None] == group_of[None, :]) & ~np.eye(len(terms), dtype=bool) & (load[:, None] > 0))
    size = np.bincount(group_of)[group_of[i]] - 1
    weight = load[i] / size / max(1, len(hit)) if len(i) else np.zeros(0)

    used, feat_at = np.unique(feats, return_inverse=True)
    feat_at = feat_at.reshape(feats.shape).astype(np.int32)
    del feats
    none = used == 1 << BITS
    texts_with = np.full((2, len(used)), 0.5)
    edges = np.searchsorted(row, np.arange(0, len(labels) + 100, 100))
    for a, b in zip(edges[:-1], edges[1:]):
        cell = np.unique((row[a:b].astype(np.int64)[:, None] * len(used) + feat_at[word[a:b]]).ravel())
        for y in (0, 1):
            texts_with[y] += np.bincount(cell[labels[cell // len(used)] == y] % len(used), minlength=len(used))
    odds = np.log(texts_with[1] / (labels.sum() + 1)) - np.log(texts_with[0] / ((1 - labels).sum() + 1))
    sure = np.maximum(0, np.abs(odds) - doubt * np.sqrt((1 / texts_with).sum(0)))
    scale = np.where(none, 0, np.sign(odds) * sure)
    bias = float(np.log(labels.mean() / (1 - labels.mean())))
    # From here on only features that count, the words that have one, and their entries.
    live = np.flatnonzero(scale)
    spot = np.full(len(used), len(live))
    spot[live] = np.arange(len(live))
    scale, feat_at = np.append(scale[live], 0.0), spot[feat_at]
    counts = (feat_at < len(live)).any(1)
    counts[term_word] = True
    feat_at = feat_at[counts]
    at_word = np.cumsum(counts) - 1
    keep = counts[word]
    row, word, tf, term_word = row[keep], at_word[word[keep]], tf[keep], at_word[term_word]
    v, bias, n = np.zeros(len(scale)), float(np.log(labels.mean() / (1 - labels.mean()))), len(labels)
    m, s, mb, sb = np.zeros(len(scale)), np.zeros(len(scale)), 0.0, 0.0
    for step in range(1, steps + 1):
        value = (v * scale)[feat_at].sum(1)
        z = bias + np.bincount(row, weights=tf * value[word], minlength=n)
        r = (sigmoid(z) - labels) / n
        g_word = np.bincount(word, weights=tf * r[row], minlength=len(value))
        gap = value[term_word[i]] - value[term_word[j]]
        np.add.at(g_word, term_word[i], 2 * pairing * weight * gap)
        np.add.at(g_word, term_word[j], -2 * pairing * weight * gap)
        g = np.bincount(feat_at.ravel(), weights=np.repeat(g_word, feat_at.shape[1]), minlength=len(scale)) * scale + 2 * decay * v
        gb = float(r.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        a, c = 1 - 0.9**step, 1 - 0.999**step
        v -= rate * (m / a) / (np.sqrt(s / c) + 1e-8)
        bias -= rate * (mb / a) / (np.sqrt(sb / c) + 1e-8)
    weights[used[live]] = (v * scale)[:-1].astype(np.float32)
    return Model(weights, bias)


def held_out(id_col: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether a document belongs to the fold that labels are never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def learn(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 8_000, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", **how,
) -> Model:
    """Fit on at most ``sample_rows`` labelled texts outside the held-out fold: those whose
    hashed id comes first."""
    chosen = labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label"))
    chosen = chosen.filter("label_id is not null and label is not null").filter(~held_out(F.col("label_id")))
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(sample_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("own_id"), F.col(text_col).cast("string").alias("own_text"))
    sample = texts.join(F.broadcast(chosen), F.col("own_id") == F.col("label_id")).select("own_id", "own_text", "label")

    def in_task(table: pa.Table) -> pa.Table:
        table = table.sort_by([("own_id", "ascending"), ("label", "ascending"), ("own_text", "ascending")]).slice(0, sample_rows)
        model = fit(table["own_text"].combine_chunks(), table["label"].to_numpy(), **how)
        at = np.flatnonzero(model.weights).astype(np.int32)
        return pa.table({"at": [at.tobytes()], "weights": [model.weights[at].tobytes()], "bias": [model.bias]})

    # One task fits the model: the sample is bounded, and the driver gets the weights alone.
    got = sample.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(in_task, "at binary, weights binary, bias double").collect()
    if not got:
        return fit(pa.array([], pa.string()), np.zeros(0))
    weights = np.zeros((1 << BITS) + 1, np.float32)
    weights[np.frombuffer(got[0].at, np.int32)] = np.frombuffer(got[0].weights, np.float32)
    return Model(weights, got[0].bias)


def with_logit(docs: DataFrame, model: Model, text_col: str, name: str) -> DataFrame:
    """``docs`` with its other columns untouched and the logit of the text as ``name``."""

    def logit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.logits(texts))

    logit.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    scored = F.arrow_udf(logit, "double")
    return docs.withColumn(name, scored(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score from 0 to 1, predicted."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    p = 1 / (1 + F.exp(-F.greatest(F.least(F.col("logit"), F.lit(500.0)), F.lit(-500.0))))
    rows = with_logit(rows, model, "text", "logit").select("doc_id", p.alias("score"))
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows scored at least ``threshold``."""
    from .tables import free

    name = free(docs, "logit")
    least = float(np.log(threshold / (1 - threshold)))
    return with_logit(docs, model, text_col, name).filter(F.col(name) < least).select(*docs.columns)
