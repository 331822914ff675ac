"""Language identification by mixture inference.

Every language is a distribution over character n-grams, learned as counts over all training texts. A document is a
mixture of these distributions: expectation-maximisation finds the proportions that make its n-grams likeliest. The set of
languages is chosen by penalised likelihood: the likeliest language alone, or sets that grow in order of the full mixture's
proportions, where each further language must raise the log-likelihood by more than the penalty, ``penalty / 2 * log(number of n-grams)``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import Scratch, spare, text_slices

_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of lower-case texts, with the text each belongs to.

    Everything but letters counts as one blank; trigrams around a single blank character only are left out.
    """
    lows = [t.lower() for t in texts]
    sizes = np.fromiter((len(t) + 2 for t in lows), np.int64, len(lows))
    code = np.frombuffer(("".join(f" {t} " for t in lows)).encode("utf-32-le", "surrogatepass"), "<u4")
    code = np.where(_letters()[np.minimum(code, len(_letters()) - 1)], code, 32).astype(np.uint64)
    owner = np.repeat(np.arange(len(lows), dtype=np.int32), sizes)
    if len(code) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    keep = (owner[2:] == owner[:-2]) & ((code[1:-1] != 32) | ((code[:-2] != 32) & (code[2:] != 32)))
    packed = (code[:-2] << np.uint64(42) | code[1:-1] << np.uint64(21) | code[2:])[keep]
    return (packed * _MIX >> np.uint64(64 - bits)).astype(np.int64), owner[2:][keep]


_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters; the last entry stands for all beyond the planes that have any."""
    if not _table:
        _table.append(np.array([chr(c).isalpha() for c in range(0x32000)] + [False]))
    return _table[0]


@dataclass(frozen=True)
class Model:
    """Languages, and the log-probability of each hashed trigram under each."""

    languages: tuple[str, ...]
    log_p: np.ndarray  # (2 ** bits, languages)
    bits: int


def train(texts: DataFrame, *, text_col: str = "text", lang_col: str = "lang", bits: int = 16, smoothing: float = 0.05, max_languages: int = 512) -> Model:
    """Count trigrams of all labelled rows by language; rows with a null text or language teach nothing.

    Each task sends its non-zero counts, Spark adds them, and the driver gets at most 2**bits rows a language. More than
    ``max_languages`` languages is an error, told before any count reaches the driver, since the model is sent to all tasks. An
    empty table gives a model of none; a very long text is counted as a whole.
    """
    source = texts.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).dropna()

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch, part in text_slices(batches, 1):
            langs = batch.column(0).to_pylist()
            for lang in set(langs):
                found, _ = grams([t for t, x in zip(part, langs, strict=True) if x == lang], bits)
                counts = np.bincount(found, minlength=1 << bits)
                held[lang] = held[lang] + counts if lang in held else counts
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "gram": pa.array(at, pa.int64()), "n": pa.array(counts[at], pa.int64())})

    counted = source.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    with Scratch(texts.sparkSession, "language") as tmp:
        counted = tmp.keep(counted, "counts")
        languages = tuple(sorted(r.lang for r in counted.select("lang").distinct().limit(max_languages + 1).collect()))
        if len(languages) > max_languages:
            raise ValueError(f"more than {max_languages} languages")
        known = counted.toArrow()
    counts = np.full((1 << bits, len(languages)), smoothing)
    place = {x: i for i, x in enumerate(languages)}
    np.add.at(counts, (known["gram"].to_numpy(), [place[x] for x in known["lang"].to_pylist()]), known["n"].to_numpy())
    return Model(languages, np.log(counts / counts.sum(0, keepdims=True)).astype(np.float32), bits)


def _narrow(p: np.ndarray, weight: np.ndarray, owner: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of the kept documents, numbered anew: ``p, weight, starts, owner``."""
    rows = kept[owner]
    owner = (np.cumsum(kept) - 1)[owner[rows]]
    return p[rows], weight[rows], np.flatnonzero(np.diff(owner, prepend=-1)), owner


def _mixture(p: np.ndarray, weight: np.ndarray, starts: np.ndarray, owner: np.ndarray, allowed: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """EM for all documents at once: proportions over each one's ``allowed`` languages, and the log-likelihoods.

    Rows of ``p`` are a document's distinct n-grams (scaled probabilities), grouped by document. A document is done when a
    round raises its log-likelihood by no more than ``tolerance``.
    """
    theta, like = allowed / allowed.sum(1, keepdims=True), np.full(len(allowed), -np.inf)
    live = np.arange(len(allowed))
    while len(live):
        mixed = np.einsum("ij,ij->i", p, theta[live][owner])
        now = np.add.reduceat(weight * np.log(mixed), starts)
        going = now - like[live] > tolerance
        like[live] = now
        share = np.add.reduceat(p * (weight / mixed)[:, None], starts, axis=0)
        total = np.add.reduceat(weight, starts)[:, None]
        theta[live[going]] = (theta[live] * share / total)[going]
        if not going.all():
            live = live[going]
            p, weight, starts, owner = _narrow(p, weight, owner, going)
    return theta, like


def infer(texts: list[str], model: Model, penalty: float = 6.0, most: int | None = None, tolerance: float = 0.01, slack: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) of the chosen sets, and which texts have any n-gram.

    Sets grow up to ``most`` languages (None: all). No set is likelier than the full mixture, so a document's search ends when
    even that likelihood (and ``slack``, as EM stops at ``tolerance``) could not pay for a further language.
    """
    n_langs = len(model.languages)
    out, any_gram = np.zeros((len(texts), n_langs)), np.zeros(len(texts), bool)
    found, owner = grams(texts, model.bits)
    if not len(found) or not n_langs:
        return out, any_gram
    key, weight = np.unique((owner.astype(np.int64) << model.bits) | found, return_counts=True)
    owner, found = key >> model.bits, key & ((1 << model.bits) - 1)
    who, starts, owner = np.unique(owner, return_index=True, return_inverse=True)
    log_p = model.log_p[found]
    peak = log_p.max(1, keepdims=True)
    p, weight = np.exp(log_p - peak).astype(np.float64), weight.astype(np.float64)
    any_gram[who] = True
    allowed = np.ones((len(who), n_langs))
    theta, full = _mixture(p, weight, starts, owner, allowed, tolerance)
    order = np.argsort(-theta, axis=1, kind="stable")
    cost = penalty / 2 * np.log(np.add.reduceat(weight, starts))
    each = np.add.reduceat(np.log(np.maximum(p, 1e-300)) * weight[:, None], starts, axis=0)
    best, best_score = np.eye(n_langs)[each.argmax(1)], each.max(1)  # alone: the likeliest one
    for k in range(2, min(most or n_langs, n_langs) + 1):
        open_ = full + slack - cost * (k - 1) > best_score
        if not open_.any():
            break
        chosen = np.zeros((int(open_.sum()), n_langs))
        np.put_along_axis(chosen, order[open_, :k], 1.0, axis=1)
        part, like = _mixture(*_narrow(p, weight, owner, open_), chosen, tolerance)
        score = like - cost[open_] * (k - 1)
        better = np.flatnonzero(open_)[score > best_score[open_]]
        best[better], best_score[better] = part[score > best_score[open_]], score[score > best_score[open_]]
    out[who] = best
    return out, any_gram


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``id, *carry, lang_pred, score, languages, shares``.

    ``lang_pred`` is the language of the largest proportion, ``score`` that proportion, ``languages`` and ``shares`` the whole
    mixture, largest first. A null text or one without a letter is ``und`` with score 0, as is any text if the model is
    empty; ties go to the language that sorts first; repeated rows get equal results; an empty table gives no rows. Columns
    other than ``carry`` are not read and only the text is looked at.
    """
    source = docs.select(F.col(id_col).alias("id"), *carry, F.col(text_col).cast("string").alias("text"))
    at = len(carry) + 1
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** bits floats a language, languages bounded in train()
    added = {"lang_pred": T.StringType(), "score": T.DoubleType(), "languages": T.ArrayType(T.StringType()), "shares": T.ArrayType(T.DoubleType())}
    schema = T.StructType([*source.schema.fields[:at], *(T.StructField(k, v) for k, v in added.items())])

    def run(batches):
        known = shared.value
        names = np.array([*known.languages, "und"], dtype=object)
        for batch, texts in text_slices(batches, at, max(1 << 16, (1 << 24) // max(8, len(known.languages)))):  # a slice holds characters by languages
            theta, any_gram = infer(texts, known)
            lettered = np.fromiter((g or any(map(str.isalpha, t)) for g, t in zip(any_gram.tolist(), texts, strict=True)), bool, len(texts))
            if theta.shape[1]:
                top, score = theta.argmax(1), theta.max(1)
            else:
                top, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                lettered[:] = False
            top = np.where(lettered, top, len(known.languages))
            ranked = [[i for i in np.argsort(-row, kind="stable").tolist() if row[i] > 0] if ok else [] for row, ok in zip(theta, lettered.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(at)),
                    pa.array(names[top].tolist(), pa.string()),
                    pa.array(np.where(lettered, np.clip(score, 0.0, 1.0), 0.0)),
                    pa.array([[known.languages[i] for i in r] for r in ranked], pa.list_(pa.string())),
                    pa.array([[float(row[i]) for i in r] for row, r in zip(theta, ranked, strict=True)], pa.list_(pa.float64())),
                ],
                schema.names,
            )

    return source.mapInArrow(run, schema)
