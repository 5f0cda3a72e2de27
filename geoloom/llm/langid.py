"""Language ID by interpolated Kneser-Ney character models.

For each language a model of character 1- to ``order``-grams is fitted on a bounded sample of labelled texts.
Discounted probabilities are interpolated with the lower order's continuation counts. All languages share
sorted arrays of hashed n-grams, one row of log-probabilities (a column a language) for each; a text is
scored by binary search of its n-grams. The language with the least cross-entropy a character wins; a
text is rejected when it has no letters or when its cross-entropy is beyond what the calibration half of
the sample gives: cut into pieces of several lengths, all but ``FALSE`` of a language's own pieces of a text's length have
less, and a text of another kind may have ``SLACK`` more.

Defined results: a null or empty text and one without letters is ``und`` with score 0 and rejected; ties go to
the alphabetically first language; repeated rows are all kept; a table without labelled rows labels
all texts ``und``; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, pieces

ORDER = 4
BITS = 15
#: Letters with ids of their own, enough for the large scripts; the rarer share one.
LETTERS = (1 << BITS) - 3
#: Sampled texts a language, at most about this many (half fit, half calibrate).
SAMPLE = 400
#: The share of a language's own texts that calibration lets be rejected, and how much more cross-entropy a text may have than they.
FALSE, SLACK = 0.001, 0.3
#: Lengths (characters) of the pieces that calibration scores, and pieces a length and language at most.
LENGTHS, PIECES = (8, 16, 32, 64, 128, 256, 512, 1024, 2048), 300


def mixed(codes: np.ndarray, order: int) -> np.ndarray:
    """A bijective 64-bit hash of n-gram codes."""
    x = codes.astype(np.uint64) + np.uint64((order * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    for k, m in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(k)
        x *= np.uint64(m)
    return x ^ x >> np.uint64(33)


class Alphabet:
    """Letter ids; everything that is no letter is 0, and runs of it count once."""

    def __init__(self, letters: str):
        self.table, self.size = np.zeros(0x110000, np.uint16), len(letters) + 2
        other = len(letters) + 1
        points = np.arange(0x110000)
        alpha = np.fromiter((chr(c).isalpha() for c in points), bool, 0x110000)
        self.table[alpha] = other
        for i, c in enumerate(letters, 1):
            self.table[ord(c)] = i
            if len(c.upper()) == 1:
                self.table[ord(c.upper())] = i

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the texts in one array, each text ended by 0, and where each begins."""
        points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        ids = self.table[points]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        ends = np.cumsum(lengths) - 1
        keep = np.ones(len(ids), bool)
        keep[1:] = (ids[1:] != 0) | (ids[:-1] != 0)
        keep[ends] = True
        kept = np.cumsum(keep)
        return ids[keep], np.concatenate(([0], kept[ends]))[:-1] if len(texts) else np.zeros(0, np.int64)


def grams(ids: np.ndarray, order: int) -> np.ndarray:
    """The code of the n-gram that ends at each id; before the array stand zeros."""
    code = np.zeros(len(ids), np.int64)
    padded = np.concatenate((np.zeros(order - 1, np.int64), ids.astype(np.int64)))
    for k in range(order):
        code = code << BITS | padded[k : k + len(ids)]
    return code


class Model:
    """Interpolated Kneser-Ney models of several languages in shared sorted hash arrays."""

    def __init__(self, alphabet: Alphabet, samples: dict[str, list[str]], order: int = ORDER):
        self.alphabet, self.languages, self.order = alphabet, sorted(samples), order
        fitted = [self.fit(alphabet.codes(samples[lang])[0], order) for lang in self.languages]
        mask = [(1 << BITS * n) - 1 for n in range(order + 1)]
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        self.weights: list[tuple[np.ndarray, np.ndarray]] = []
        floor = 1.0 / alphabet.size
        probs: dict[int, np.ndarray] = {}
        for n in range(1, order + 1):
            all_codes = np.unique(np.concatenate([f[n][0] for f in fitted]))
            contexts = np.unique(all_codes >> BITS)
            weight, value = np.ones((len(contexts), len(fitted))), np.zeros((len(all_codes), len(fitted)))
            for j, f in enumerate(fitted):
                codes, counts = f[n]
                own, first = np.unique(codes >> BITS, return_index=True)
                total = np.add.reduceat(counts, first) if len(counts) else np.zeros(0)
                kinds = np.diff(np.append(first, len(codes)))
                once, twice = (counts == 1).sum(), (counts == 2).sum()
                d = once / (once + 2 * twice) if once and twice else 0.5
                weight[np.searchsorted(contexts, own), j] = d * kinds / np.maximum(total, 1)
                at = np.searchsorted(own, codes >> BITS)
                value[np.searchsorted(all_codes, codes), j] = np.maximum(counts - d, 0) / np.maximum(total[at], 1)
            low = np.full((len(all_codes), len(fitted)), floor) if n == 1 else np.exp(self.lookup(all_codes & mask[n - 1], n - 1))
            value += weight[np.searchsorted(contexts, all_codes >> BITS)] * low
            for store, keys, rows in ((self.tables, all_codes, np.log(value)), (self.weights, contexts, np.log(weight))):
                hashed = mixed(keys, n)
                by = np.argsort(hashed)
                store.append((hashed[by], rows[by].astype(np.float32)))

    @staticmethod
    def fit(ids: np.ndarray, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """N-gram codes and counts: occurrences at the top order, distinct left neighbours below."""
        out = {order: np.unique(grams(ids, order), return_counts=True)}
        for n in range(order - 1, 0, -1):
            mask = (1 << BITS * n) - 1
            out[n] = np.unique(out[n + 1][0] & mask, return_counts=True)
        return out

    @staticmethod
    def find(store: tuple[np.ndarray, np.ndarray], hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, _ = store
        at = np.searchsorted(keys, hashed)
        at[at == len(keys)] = 0
        return at, keys[at] == hashed if len(keys) else np.zeros(len(hashed), bool)

    def lookup(self, codes: np.ndarray, n: int) -> np.ndarray:
        """Log-probabilities (a column a language) of n-grams; unseen ones take the context's weight times the lower order's."""
        if n == 0:
            return np.full((len(codes), len(self.languages)), -math.log(self.alphabet.size), np.float32)
        at, seen = self.find(self.tables[n - 1], mixed(codes, n))
        out = self.tables[n - 1][1][at]
        if not seen.all():
            rest = codes[~seen]
            low = self.lookup(rest & (1 << BITS * (n - 1)) - 1, n - 1)
            at, known = self.find(self.weights[n - 1], mixed(rest >> BITS, n))
            low[known] += self.weights[n - 1][1][at[known]]
            out[~seen] = low
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats a character of each text under each language, scored characters, letters."""
        ids, starts = self.alphabet.codes(texts)
        codes = grams(ids, self.order)
        depth = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
        for k in range(1, self.order):  # what stands before a text is 0
            near = depth < k
            codes[near] &= (1 << BITS * k) - 1
        total = np.zeros((len(texts), len(self.languages)))
        for a in range(0, len(ids), 1 << 18):
            part = self.lookup(codes[a : a + (1 << 18)], self.order)
            first = np.searchsorted(starts, a, "right") - 1
            last = np.searchsorted(starts, a + len(part), "left")
            cuts = np.maximum(starts[first:last] - a, 0)
            total[first:last] += np.add.reduceat(part, cuts, axis=0, dtype=np.float64)
        sizes = np.diff(np.append(starts, len(ids)))
        letters = np.add.reduceat((ids != 0).astype(np.int64), starts) if len(texts) else np.zeros(0, np.int64)
        return -total / sizes[:, None], sizes, letters

    def calibrate(self, samples: dict[str, list[str]]) -> None:
        """For each language and length the cross-entropy that all but ``FALSE`` of its own pieces stay under, from texts not fitted on."""
        self.limits = np.full((len(self.languages), len(LENGTHS)), math.log(self.alphabet.size))
        for j, lang in enumerate(self.languages):
            texts = [t for t in samples.get(lang, []) if any(c.isalpha() for c in t)]
            for i, n in enumerate(LENGTHS):
                cut = [t[k : k + n] for t in texts for k in range(0, len(t) - n + 1, n)]
                cut = cut[:: max(1, -(-len(cut) // PIECES))]  # spread over all texts
                cut = [t for t in cut if any(c.isalpha() for c in t)]
                if cut:
                    self.limits[j, i] = np.quantile(self.cross_entropies(cut)[0][:, j], 1 - FALSE)
                elif i and texts:
                    self.limits[j, i] = self.limits[j, i - 1]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (0 to 1) and rejection of each text."""
        if not texts:
            return [], np.zeros(0), np.zeros(0, bool)
        entropies, sizes, letters = self.cross_entropies(texts)
        best = entropies.argmin(axis=1)
        sharp = np.minimum(sizes, 100)[:, None]
        score = 1 / np.exp((entropies.min(axis=1, keepdims=True) - entropies) * sharp).sum(axis=1)
        names = [self.languages[j] for j in best]
        size = np.log(np.maximum(sizes - 1, 1))
        each = np.stack([np.interp(size, np.log(LENGTHS), row) for row in self.limits], axis=1)
        limit = each[np.arange(len(best)), best] * (1 + SLACK)
        none = letters == 0
        return ["und" if z else x for x, z in zip(names, none, strict=True)], np.where(none, 0.0, score), none | (entropies.min(axis=1) > limit)


def train(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, seed: int = 5) -> Model | None:
    """Fits on a sample of about ``sample`` texts a language (chosen by a hash of the key), the bound of what the driver gathers."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    if not counts:
        return None
    spread = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("k", F.lit(""))), F.lit(1 << 30))
    chosen = F.lit(False)
    for x, n in counts.items():
        chosen = chosen | ((F.col("l") == x) & (spread < int((1 << 30) * min(1.0, sample / n))))
    found = sorted((r["l"], r["k"] or "", r["t"]) for r in rows.where(chosen).limit(2 * sample * len(counts) + 100).collect())
    fit: dict[str, list[str]] = {x: [] for x in counts}
    check: dict[str, list[str]] = {x: [] for x in counts}
    for i, (x, _, t) in enumerate(found):
        (check if i % 2 and fit[x] else fit)[x].append(t)
    fit = {x: t for x, t in fit.items() if t}
    if not fit:
        return None
    letters: dict[str, int] = {}
    for texts in fit.values():
        for c in "".join(texts).lower():
            if c.isalpha():
                letters[c] = letters.get(c, 0) + 1
    model = Model(Alphabet("".join(sorted(letters, key=lambda c: (-letters[c], c))[:LETTERS])), fit)
    model.calibrate(check)
    return model


def identify(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected`` (columns of these names are replaced). The model (bounded by its sample) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "rejected")
    columns = docs.columns

    def make():
        model = shared.value

        def step(batch):
            for part in pieces(batch, text, 1 << 20):
                texts = [x or "" for x in part.column(text).to_pylist()]
                if model is None:
                    names, scores, out = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                else:
                    names, scores, out = model.predict(texts)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], [*columns, "lang_pred", "score", "rejected"])

        return step

    return map_arrow(docs, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double, rejected boolean")


def held_out(key: str = "doc_id"):
    """Documents kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def recognised(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the rows that language ID rejects."""
    model = train(docs.where(~held_out(key)), key=key, text=text, lang=lang)
    aside = docs.withColumnsRenamed({c: f"c_{c}" for c in docs.columns})
    return identify(aside, model, text=f"c_{text}").where("not rejected").select(*(F.col(f"c_{c}").alias(c) for c in docs.columns))


def op7_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
