"""Language identification by interpolated Kneser-Ney character models.

Counts of all character grams of the labelled training texts are gathered with
one shuffle. Per language an interpolated Kneser-Ney model of order ``ORDER`` is
computed from them in Spark, over all grams: a gram's hash is its symbols, 16
bits each, so grams never collide and the shorter ones are found by shifting.
A log-probability is a sum of one weight for each gram and each context that the
language has seen, so the weights can be dealt over any number of broadcast
blocks of bounded size. Every text is scored whole under every language; the
lowest cross-entropy per character wins. A text is rejected when it has no
letter, or when its cross-entropy lies beyond what the winner's labelled texts
reach under a model that has not seen them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, release, stored, with_column

ORDER = 4
FOLDS = 5
#: learned from the first half of the texts, the second, and all
FITS = (0, 1, 2)
#: weights in one broadcast block (20 bytes each); a worker keeps the first
#: blocks up to this many weights and reads the others once for each stretch of text
BLOCK = 1_000_000
#: grams x languages that are scored at a time
CELLS = 1 << 20
#: a text is rejected beyond the distance that one in this many unseen texts would
#: exceed, if the tail fell off exponentially from the median through the 0.9
#: quantile (odd texts below a tenth do not move those)
RARE = 1_000_000
#: weight, in texts, of what is assumed before any text is seen: of the scale that
#: all languages share, and of the tail's median and 0.9 quantile
SCALE, TAIL, ASSUMED = 8, 32, (1.0, 3.0)
#: sharpness of the score
SHARP = 8.0
UNKNOWN = "und"
#: rows whose sums are held at a time
ROWS = 1024
_BLANK, _ASTRAL = 32, 0xFFFE
_PIECE = 1 << 18
_BITS = np.uint64(16)


def alphabet() -> np.ndarray:
    """Basic-plane code point -> itself if a letter, else a blank."""
    return np.array([c if chr(c).isalpha() else _BLANK for c in range(1 << 16)], np.uint64)


def symbols(text: str | None, letters: np.ndarray) -> np.ndarray:
    """Lower-cased letters, with one blank for any run of others and at both
    ends; empty without letters. Letters beyond the basic plane are one symbol."""
    if not text:
        return np.empty(0, np.uint64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    x = letters[np.minimum(code, (1 << 16) - 1)]
    far = np.flatnonzero(code >= 1 << 16)
    if len(far):
        x[far] = [_ASTRAL if chr(c).isalpha() else _BLANK for c in code[far].tolist()]
    blank = x == _BLANK
    x = np.concatenate((x[~(blank & np.concatenate(([True], blank[:-1])))],
                        np.array([_BLANK], np.uint64)))
    if len(x) > 1 and x[-2] == _BLANK:
        x = x[:-1]
    return np.concatenate((np.array([_BLANK], np.uint64), x)) if len(x) > 1 else x[:0]


def pieces(x: np.ndarray, order: int = ORDER, size: int | None = None) -> Iterator[np.ndarray]:
    """A symbol sequence, padded with blanks in front, in pieces that overlap so
    that each symbol ends one gram (the first symbol, a blank, ends none)."""
    x, size = np.concatenate((np.full(order - 2, _BLANK, np.uint64), x)), size or _PIECE
    for at in range(0, max(len(x) - order + 1, 0), size):
        yield x[at:at + size + order - 1]


def grams(x: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The packed grams of a piece."""
    key = np.zeros(len(x) - order + 1, np.uint64)
    for i in range(order):
        key = key << _BITS | x[i:len(x) - order + 1 + i]
    return key


def _low(order: int) -> np.uint64:
    return np.uint64((1 << 16 * order) - 1)


class Model:
    """Log-probabilities of grams under each language, in memory: the plain form
    of what ``weights`` computes in Spark.

    ``counts``: language -> (sorted packed grams, counts). For each order,
    ``keys`` holds the grams any language has seen and ``logs`` their
    log-probability under all languages; ``contexts`` and ``back`` hold the
    back-off weight of each context.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.languages, self.order = sorted(counts), order
        self.keys, self.logs, self.contexts, self.back = {}, {}, {}, {}
        grams_of = dict(counts)
        levels = {}
        for k in range(order, 0, -1):
            levels[k] = grams_of
            if k > 1:  # how many different symbols precede each shorter gram
                grams_of = {lang: np.unique(keys & _low(k - 1), return_counts=True)
                            for lang, (keys, _) in grams_of.items()}
        self.floor = -np.log(len(np.unique(np.concatenate(
            [keys for keys, _ in levels[1].values()]))) + 1)
        for k in range(1, order + 1):
            self.keys[k] = np.unique(np.concatenate([x for x, _ in levels[k].values()]))
            self.contexts[k] = np.unique(self.keys[k] >> _BITS)
            self.back[k] = np.zeros((len(self.contexts[k]), len(self.languages)))
            self.logs[k] = np.empty((len(self.keys[k]), len(self.languages)))
            shorter = self._lower(self.keys[k], k)
            for j, lang in enumerate(self.languages):
                keys, n = levels[k][lang]
                once, twice = (n == 1).sum(), (n == 2).sum()
                d = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
                heads, first, kinds = np.unique(keys >> _BITS, return_index=True,
                                                return_counts=True)
                total = np.add.reduceat(n, first)
                self.back[k][np.searchsorted(self.contexts[k], heads), j] = np.log(
                    d * kinds / total)
                weight = self._find(self.contexts[k], self.back[k], self.keys[k] >> _BITS, 0.0)[0]
                p = np.exp(weight[:, j] + shorter[:, j])
                own = np.searchsorted(self.keys[k], keys)
                p[own] += (n - d) / np.repeat(total, kinds)
                self.logs[k][:, j] = np.log(p)

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float):
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        return np.where(hit[:, None], values[at], missing), hit

    def _lower(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Log-probabilities of the last k - 1 symbols."""
        if k == 1:
            return np.full((len(keys), len(self.languages)), self.floor)
        return self.log_probability(keys & _low(k - 1), k - 1)

    def log_probability(self, keys: np.ndarray, k: int | None = None) -> np.ndarray:
        """(grams, languages) for packed grams of length k."""
        k = k or self.order
        out, hit = self._find(self.keys[k], self.logs[k], keys, 0.0)
        rest = keys[~hit]
        if len(rest):
            weight, _ = self._find(self.contexts[k], self.back[k], rest >> _BITS, 0.0)
            out[~hit] = weight + self._lower(rest, k)
        return out

    def cross_entropy(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Mean surprise per symbol under each language, and its spread under
        the best one."""
        total = square = 0.0
        for part in pieces(x, self.order):
            keys, n = np.unique(grams(part, self.order), return_counts=True)
            surprise = -self.log_probability(keys)
            total, square = total + n @ surprise, square + n @ surprise**2
        count = len(x) - 1
        mean = total / count
        best = mean.argmin()
        return mean, float(max(square[best] / count - mean[best] ** 2, 0.0))


class Scorer:
    """Scores texts under all languages from broadcast blocks of weights.

    ``blocks``: (kind, number of weights, broadcast bytes) as ``packed`` cuts them.
    Beside the blocks it keeps, a worker holds one block at a time.
    """

    def __init__(self, languages: list[str], floor: float, blocks: list, order: int = ORDER):
        self.languages, self.floor, self.blocks, self.order = languages, floor, blocks, order
        sizes = np.cumsum([n for _, n, _ in blocks])
        self.kept, self.held, self.letters = int((sizes <= BLOCK).sum()), {}, None
        self.piece = max(1, min(_PIECE, CELLS // len(languages)))

    def _block(self, i: int):
        if i in self.held:
            return self.held[i]
        _, n, block = self.blocks[i]
        raw = block.value
        if hasattr(block, "_value"):
            del block._value  # or a worker would keep every block
        found = (np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.float64, n, 8 * n),
                 np.frombuffer(raw, np.int32, n, 16 * n))
        if i < self.kept:
            self.held[i] = found
        return found

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """(grams, languages) for packed grams of length ``order``."""
        out = np.full((len(keys), len(self.languages)), self.floor)
        for i, (kind, _, _) in enumerate(self.blocks):
            known, weight, lang = self._block(i)
            part = keys & _low(kind) if kind > 0 else keys >> _BITS & _low(-kind - 1)
            at = np.flatnonzero((part >= known[0]) & (part <= known[-1]))
            first = np.searchsorted(known, part[at])
            n = np.searchsorted(known, part[at], "right") - first
            row = np.repeat(at, n)
            entry = np.arange(len(row)) + np.repeat(first - np.cumsum(n) + n, n)
            out[row, lang[entry]] += weight[entry]
        return out

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: mean surprise per symbol under each language, its spread under
        the best one, and the number of symbols (0 without letters)."""
        if self.letters is None:
            self.letters = alphabet()
        total = np.zeros((len(texts), len(self.languages)))
        square, size = np.zeros_like(total), np.zeros(len(texts), np.int64)
        rows, parts, held = [], [], 0

        def settle():
            keys, at = np.unique(np.concatenate(parts), return_inverse=True)
            surprise = -self.log_probability(keys)[at]
            starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
            np.add.at(total, rows, np.add.reduceat(surprise, starts))
            np.add.at(square, rows, np.add.reduceat(surprise**2, starts))
            rows.clear()
            parts.clear()

        for i, text in enumerate(texts):
            x = symbols(text, self.letters)
            size[i] = len(x)
            for piece in pieces(x, self.order, self.piece) if len(x) else ():
                if held + len(piece) > self.piece and parts:
                    settle()
                    held = 0
                rows.append(i)
                parts.append(grams(piece, self.order))
                held += len(parts[-1])
        if parts:
            settle()
        count = np.maximum(size - 1, 1)
        mean = total / count[:, None]
        best = mean.argmin(1)
        each = np.arange(len(texts))
        return mean, np.maximum(square[each, best] / count - mean[each, best] ** 2, 0.0), size


class Judge:
    """A scorer with its calibrated limits: language -> (mean, between, within, limit)."""

    def __init__(self, scorer: Scorer | None, limits: dict | None = None):
        self.scorer, self.limits = scorer, limits or {}

    def distance(self, lang: str, entropy: float, n: int) -> float:
        mean, between, within, _ = self.limits[lang]
        return (entropy - mean) / np.sqrt(between + within / n)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, cross-entropy, rejected) of each text."""
        if self.scorer is None:
            letters = alphabet()
            return [(UNKNOWN, 0.0, None, not len(symbols(t, letters))) for t in texts]
        found = []
        for entropy, n in zip(*self.scorer.cross_entropy(texts)[::2], strict=True):
            if not n:
                found.append((UNKNOWN, 0.0, None, True))
                continue
            j = int(entropy.argmin())
            lang, low = self.scorer.languages[j], float(entropy[j])
            score = float(1 / np.exp(-SHARP * (entropy - low)).sum())
            beyond = lang in self.limits and self.distance(lang, low, n) > self.limits[lang][3]
            found.append((lang, score, low, bool(beyond)))
        return found


def _training(docs: DataFrame, id_col: str, text: str, lang: str, folds: int) -> DataFrame:
    """(lang, half, text): the texts to learn from, copies in the same half."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    return docs.where((fold != 0) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.pmod(F.xxhash64(text), F.lit(2)).cast("int").alias("half"),
        F.col(text).alias("text"))


def gram_counts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n0, n1, n2) over all of ``labelled`` (lang, half, text): the
    occurrences in each half and in both."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = alphabet()
        held: dict[tuple, list] = defaultdict(list)

        def merged(parts):
            keys = np.concatenate([k for k, _ in parts])
            keys, at = np.unique(keys, return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

        new: dict[tuple, list] = defaultdict(list)
        size = 0

        def settle():
            for key, parts in new.items():
                held[key].append(np.unique(np.concatenate(parts), return_counts=True))
                if len(held[key]) > 8:
                    held[key] = [merged(held[key])]
            new.clear()

        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                for *key, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    x = symbols(text, letters)
                    for piece in pieces(x, order) if len(x) else ():
                        new[tuple(key)].append(grams(piece, order))
                        size += len(piece)
                        if size > 4 * _PIECE:
                            settle()
                            size = 0
        settle()
        for (lang, half), parts in held.items():
            keys, n = merged(parts)
            for at in range(0, len(keys), 100_000):
                part = keys[at:at + 100_000].view(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(part)),
                    "half": pa.array([half] * len(part), pa.int32()), "gram": part,
                    "n": n[at:at + 100_000]})

    def of(half):
        return F.sum(F.when(F.col("half") == half, F.col("n")).otherwise(0))

    return (labelled.mapInArrow(count, "lang string, half int, gram long, n long")
            .groupBy("lang", "gram").agg(of(0).alias("n0"), of(1).alias("n1"),
                                         F.sum("n").alias("n2")))


def weights(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, list[float]]:
    """(fit, kind, key, lang, weight) over all grams of ``counts`` (lang, gram, n0, n1,
    n2), and the log-probability of a symbol that nothing is known of, per fit.

    Fits 0 and 1 are learned from a half, fit 2 from both; a row carries all three.
    Kind k is a gram of k symbols: its log-probability less what backing off would
    give. Kind -k is a context of k - 1 symbols: its log back-off weight. The
    log-probability of a gram is the floor plus the weights of its endings and
    their contexts, as far as the language has seen them.
    """
    levels = {order: counts}
    seen = [F.count_if(F.col(f"n{f}") > 0).alias(f"n{f}") for f in FITS]
    for k in range(order - 1, 0, -1):  # how many different symbols precede each shorter gram
        levels[k] = stored(
            levels[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit(int(_low(k))))
                                  .alias("gram")).agg(*seen), "grams")
    symbols_seen = levels[1].groupBy("gram").agg(*[F.max(f"n{f}").alias(f"n{f}") for f in FITS])
    floors = [-float(np.log(n + 1)) for n in symbols_seen.agg(*seen).head()]

    def discount(f):
        once, twice = F.count_if(F.col(f"n{f}") == 1), F.count_if(F.col(f"n{f}") == 2)
        share = once / F.greatest(once + 2 * twice, F.lit(1))
        return F.least(F.greatest(share, F.lit(0.1)), F.lit(0.9)).alias(f"d{f}")

    discounts = stored(reduce(DataFrame.union, [  # one row a language and order
        levels[k].groupBy("lang").agg(*map(discount, FITS))
        .select(F.lit(k).alias("order"), "*") for k in levels]), "discounts")
    out, lower = [], None
    for k in range(1, order + 1):
        after = Window.partitionBy("lang", "head")  # at most one row a symbol
        rows = (levels[k].withColumn("head", F.shiftrightunsigned("gram", 16))
                .select("*", *[F.sum(f"n{f}").over(after).alias(f"total{f}") for f in FITS],
                        *[F.count_if(F.col(f"n{f}") > 0).over(after).alias(f"kinds{f}")
                          for f in FITS])
                .join(F.broadcast(discounts.where(F.col("order") == k)), "lang"))
        if lower is not None:
            rows = (rows.withColumn("tail", F.col("gram").bitwiseAND(F.lit(int(_low(k - 1)))))
                    .join(lower, ["lang", "tail"]))
        columns = []
        for f in FITS:
            n, d, total = F.col(f"n{f}"), F.col(f"d{f}"), F.col(f"total{f}")
            known = F.when(total > 0, total)
            back = F.log(d * F.col(f"kinds{f}") / known)
            rest = back + (F.lit(floors[f]) if lower is None else F.col(f"below{f}"))
            log = F.when(n > 0, F.log((n - d) / known + F.exp(rest)))
            columns += [back.alias(f"back{f}"), log.alias(f"log{f}"),
                        (log - rest).alias(f"weight{f}")]
        own = stored(rows.select("lang", "gram", "head", *columns), "weights")
        lower = own.select("lang", F.col("gram").alias("tail"),
                           *[F.col(f"log{f}").alias(f"below{f}") for f in FITS])
        heads = own.groupBy("lang", "head").agg(
            *[F.max(f"back{f}").alias(f"back{f}") for f in FITS])
        out += [_by_fit(own, k, "gram", "weight"), _by_fit(heads, -k, "head", "back")]
        release(counts.sparkSession)
    return reduce(DataFrame.union, out), floors


def _by_fit(rows: DataFrame, kind: int, key: str, weight: str) -> DataFrame:
    """(fit, kind, key, lang, weight): the weights that each fit has."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("fit"), F.col(f"{weight}{f}").alias("w"))
                               for f in FITS])).alias("c")
    return rows.select(F.col(key).alias("key"), "lang", each).where("c.w is not null").select(
        "c.fit", F.lit(kind).alias("kind"), "key", "lang", F.col("c.w").alias("weight"))


def packed(rows: DataFrame, most: int) -> DataFrame:
    """(fit, kind, n, block): the weights as sorted arrays, ``most`` in a block at most."""
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now = [], 0, None

        def block():
            key, lang, weight = (np.concatenate(c) for c in zip(*held, strict=True))
            at = np.argsort(key.view(np.uint64), kind="stable")
            raw = key[at].tobytes() + weight[at].tobytes() + lang[at].tobytes()
            return pa.RecordBatch.from_pydict(
                {"fit": pa.array([now[0]], pa.int32()), "kind": pa.array([now[1]], pa.int32()),
                 "n": pa.array([size], pa.int64()), "block": pa.array([raw], pa.binary())})

        for batch in batches:
            fit, kind, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero(np.diff(kind) | np.diff(fit)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(kind)], strict=True):
                while lo < hi:
                    here = (int(fit[lo]), int(kind[lo]))
                    if held and (here != now or size == most):
                        yield block()
                        held, size = [], 0
                    now, end = here, int(min(hi, lo + most - size))
                    held.append([c[lo:end] for c in columns])
                    size, lo = size + end - int(lo), end
        if held:
            yield block()

    parts = max(1, -(-rows.count() // most))
    order = ("fit", "kind", "key")
    return (rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .select("fit", "kind", "key", "lang", "weight")
            .mapInArrow(pack, "fit int, kind int, n long, block binary"))


def learn(counts: DataFrame, order: int = ORDER) -> list[Scorer]:
    """The scorers of the three fits of ``counts`` (lang, gram, n0, n1, n2), from one
    series of jobs; none without grams."""
    spark = counts.sparkSession
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not languages:
        return []
    ids = spark.createDataFrame(list(enumerate(languages)), "id int, lang string")
    numbered = stored(counts.join(F.broadcast(ids), "lang")
                      .select(F.col("id").alias("lang"), "gram", "n0", "n1", "n2"), "grams")
    rows, floors = weights(numbered, order)
    blocks = stored(packed(stored(rows, "weights"), BLOCK), "blocks")
    # one partition, so a few blocks, on the driver at a time
    found = [(r.fit, r.kind, r.n, spark.sparkContext.broadcast(bytes(r.block)))
             for r in blocks.toLocalIterator()]
    release(spark)
    return [Scorer(languages, floors[f], sorted(
        [b[1:] for b in found if b[0] == f], key=lambda b: (b[1] > BLOCK // 2, abs(b[0]))), order)
        for f in FITS]


def fit(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
        folds: int = FOLDS, order: int = ORDER) -> Judge:
    """A judge learned from the rows whose crc32(id as text) mod ``folds`` is not
    0 and whose language and text are not null. Without such rows it knows no
    language. The model covers all grams of all these rows. For the limits the
    texts are halved by hash, copies together, and every text of a half is scored
    by a model of the other half."""
    labelled = _training(docs, id_col, text, lang, folds)
    scorers = learn(stored(gram_counts(labelled, order), "grams"), order)
    if not scorers:
        return Judge(None)
    *halves, scorer = scorers
    return Judge(scorer, _limits(_scored(labelled, halves), scorer))


def _scored(labelled: DataFrame, halves: list[Scorer]) -> DataFrame:
    """(lang, entropy, spread, n) of the different texts that get their own label from
    the fit that has not seen them."""
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
                half = part.column(1).to_numpy()
                for h in (0, 1):
                    rows, scorer = part.filter(pa.array(half == h)), halves[1 - h]
                    if not rows.num_rows or not scorer.blocks:
                        continue
                    entropy, spread, n = scorer.cross_entropy(rows.column(2).to_pylist())
                    own = np.array([scorer.languages[j] for j in entropy.argmin(1)], object)
                    own = (own == np.array(rows.column(0).to_pylist(), object)) & (n > 0)
                    yield pa.RecordBatch.from_pydict({
                        "lang": rows.column(0).filter(pa.array(own)),
                        "entropy": entropy.min(1)[own], "spread": spread[own], "n": n[own],
                        "copy": rows.column(3).filter(pa.array(own))})

    return (labelled.withColumn("copy", F.xxhash64("text"))
            .mapInArrow(score, "lang string, entropy double, spread double, n long, copy long")
            .dropDuplicates(["lang", "copy"]).drop("copy"))


def _limits(scored: DataFrame, scorer: Scorer) -> dict:
    """language -> (mean, between, within, limit), from all rows of ``scored``.

    A language's scale is that of its texts and of ``SCALE`` texts more on the scale
    of all languages, which in turn starts from ``SCALE`` texts of a corpus of which
    nothing is known: as many nats as letters nobody has seen, and spread as widely.
    The tail starts from ``TAIL`` texts of the ``ASSUMED`` one. So few texts give
    wide limits, and more texts narrow them step by step.
    """
    def at(column, *shares):
        return F.percentile_approx(column, F.array(*map(F.lit, shares)), F.lit(10_000))

    rows = stored(scored, "scored")
    quarter = at("entropy", 0.25, 0.5, 0.75)
    scale = [quarter[1].alias("mean"),
             F.greatest(F.pow((quarter[2] - quarter[0]) / 1.349, 2), F.lit(1e-4)).alias("between"),
             F.greatest(at("spread", 0.5)[0], F.lit(1e-4)).alias("within"),
             F.count(F.lit(1)).alias("texts")]

    def mixed(row, base, weight):
        n = row.texts if row is not None else 0
        return [b if not n else (n * x + weight * b) / (n + weight)
                for x, b in zip(row[-4:-1] if n else base, base, strict=True)]

    nats = -scorer.floor
    shared = mixed(rows.agg(*scale).head(), [nats, nats**2, nats**2], SCALE)
    own = {r.lang: r for r in rows.groupBy("lang").agg(*scale).collect()}
    scales = {lang: mixed(own.get(lang), shared, SCALE) for lang in scorer.languages}
    frame = rows.sparkSession.createDataFrame(
        [(lang, *s) for lang, s in scales.items()],
        "lang string, mean double, between double, within double")
    far = (F.col("entropy") - F.col("mean")) / F.sqrt(
        F.col("between") + F.col("within") / F.col("n"))
    tail = (rows.join(F.broadcast(frame), "lang")  # the scales: one row a language
            .agg(F.count(F.lit(1)).alias("texts"), at(far, 0.5, 0.9).alias("far")).head())
    middle, high = ((tail.texts * x + TAIL * a) / (tail.texts + TAIL)
                    for x, a in zip(tail.far or ASSUMED, ASSUMED, strict=True))
    limit = middle + (high - middle) * float(np.log(RARE / 2) / np.log(5))
    return {lang: (*s, limit) for lang, s in scales.items()}


def identify(docs: DataFrame, judge: Judge, *, text: str = "text") -> tuple[DataFrame, str]:
    """All rows and columns of ``docs`` plus a struct column; also its name.

    The struct has ``lang_pred`` (``und`` for null texts and texts without a
    letter, or if no language was learned), ``score`` (0 to 1), ``entropy``
    (per symbol; null for ``und``) and ``rejected`` (true for texts without a
    letter). Languages of equal cross-entropy: the first by name. Repeated rows are
    judged alike, each on its own. An empty table gives no rows. A text of any length
    is scored whole, in stretches of bounded size. The struct's name takes
    underscores until no column of ``docs`` has it; no other column is read.
    """
    name, where = fresh("language", docs), docs.columns.index(text)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()),
                      ("entropy", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
                found = [dict(zip(("lang_pred", "score", "entropy", "rejected"), f, strict=True))
                         for f in judge.predict(part.column(where).to_pylist())]
                yield with_column(part, name, pa.array(found, kind))

    schema = docs.withColumn(name, F.lit(None).cast(
        "struct<lang_pred:string,score:double,entropy:double,rejected:boolean>")).schema
    return docs.mapInArrow(run, schema), name
