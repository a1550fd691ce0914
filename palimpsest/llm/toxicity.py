"""Toxicity scores from a learned lexicon, matched fuzzily and weighed by context.

Learning reads at most ``SAMPLE_PER_LABEL`` labelled documents of each label (those of least id hash): a bound
on the classifier's fit. Of near copies within the sample (texts of one label with a min-hash of 5-word shingles in common) one counts,
so that no word seems frequent by being copied. It finds words, and stems that begin many different words, that are far more frequent
under label 1 than chance among so many words explains, and fits a logistic regression on what they look like in context.

Scoring reads each whole text. Each different word of it meets the lexicon's trie through a Levenshtein
automaton that allows one edit in words of five letters or more, two from nine on; a stem must begin the word
exactly, but words chosen with a stem are in the trie too, so that edits inside the stem are met. Around each match a window of words is looked at: a match inside quotation marks, or near a verb of
saying, counts as quoted; one close to further matches counts as heaped. The regression weighs these counts.

Defined results. A null text is empty; texts without a match get the regression's base score, empty ones too.
With no labels, or of one kind only, all scores are 0. Labels that contradict each other for one id: the
greater counts. Repeated rows give repeated results; an empty table gives an empty result; other columns take
no part.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import as_long, mix, ngram_hash
from .language import held_out, sample_ids

#: Labelled rows of each label that are learned from: they bound the words that may become terms.
SAMPLE_PER_LABEL = 2000
STEMS = (4, 5, 6, 7)
WINDOW = 12
THRESHOLD = 0.3
CACHE_WORDS = 500_000
FEATURES = 8
RATE = 0.2
SHINGLE = 5
SIGNATURE = 4

_WORD = re.compile(r"[^\W\d_]+")
_QUOTES = "\"“”„«»‟"
#: Verbs of saying near which a term counts as quoted.
_SAYING = frozenset("said says say wrote writes quote quoted quotes cited dit écrit cité sagte sagt schrieb zitierte dijo dice escribió citó".split())

EXACT, STEM, FUZZY = 1, 2, 3


@dataclass
class Lexicon:
    """Words (matched with edits) in a trie, stems (matched as beginnings), and words with these stems (matched by the stem, or with edits)."""

    words: list[str]
    stems: list[str]
    stemmed: list[str] = field(default_factory=list)
    trie: dict = field(default_factory=dict)
    known: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        for word in self.words + self.stemmed:
            node = self.trie
            for c in word:
                node = node.setdefault(c, {})
            node[""] = word
        self.exact = frozenset(self.words)
        self.beginnings = frozenset(self.stems)
        self.lengths = sorted({len(s) for s in self.stems})
        # a word within one (two) edits keeps one of two (three) parts of the term, at its place but for the edits before it
        self.heads: set[str] = set()
        self.tails: set[str] = set()
        self.middles: set[str] = set()
        for word in self.words + self.stemmed:
            edits = allowed(len(word))
            if edits:
                n = len(word) // (edits + 1)
                self.heads.add(word[:n])
                self.tails.add(word[-n:])
                if edits == 2:
                    self.middles.add(word[n:-n])
        self.head_sizes = sorted({len(x) for x in self.heads})
        self.tail_sizes = sorted({len(x) for x in self.tails})

    def _near(self, word: str) -> bool:
        """Whether the automaton for some term within its edits accepts ``word``: rows of edit distances down the trie."""
        n = len(word)
        most = 2
        stack = [(self.trie, tuple(range(n + 1)))]
        while stack:
            node, row = stack.pop()
            for c, child in node.items():
                if not c:
                    if row[n] <= allowed(len(child)):
                        return True
                    continue
                new = [row[0] + 1]
                for i in range(n):
                    new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (word[i] != c)))
                if min(new) <= most:
                    stack.append((child, tuple(new)))
        return False

    def kind(self, word: str) -> int:
        """0, or how a word matches."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            if word in self.exact:
                found = EXACT
            elif any(word[:n] in self.beginnings for n in self.lengths):
                found = STEM
            elif (
                len(word) >= 4
                and (any(word[:n] in self.heads for n in self.head_sizes) or any(word[-n:] in self.tails for n in self.tail_sizes) or any(m in word for m in self.middles))
                and self._near(word)
            ):
                found = FUZZY
            else:
                found = 0
            self.known[word] = found
        return found

    def features(self, text: str) -> list[float]:
        """Counts of matches by kind and context, for one whole text."""
        low = text.lower()
        words = _WORD.findall(low)
        hits = {w: k for w in set(words) if (k := self.kind(w))}
        out = [0.0] * FEATURES
        if not hits:
            return out
        places, kinds, quoted = [], [], []
        spans = [m.span() for m in _WORD.finditer(low)]
        for i, w in enumerate(words):
            if w in hits:
                near = words[max(0, i - WINDOW) : i + WINDOW + 1]
                start, end = spans[i]
                before, after = low[max(0, start - 80) : start], low[end : end + 80]
                within = any(q in before for q in _QUOTES) and any(q in after for q in _QUOTES)
                places.append(i), kinds.append(hits[w]), quoted.append(within or not _SAYING.isdisjoint(near))
        gaps = np.diff(np.array(places))
        close = np.concatenate([[False], gaps <= WINDOW]) | np.concatenate([gaps <= WINDOW, [False]])
        for kind, cited, heaped in zip(kinds, quoted, close):
            out[3 if cited else kind - 1] += 1
            out[4] += bool(heaped)
        counts = out[:5]
        out[:5] = [math.log1p(x) for x in counts]
        direct = sum(counts[:2])
        out[5] = math.log1p(1000 * direct / (len(words) + 20))
        out[6] = float(direct > 0)
        out[7] = math.log1p(len({w for w, k in hits.items() if k != FUZZY}))
        return out


def allowed(length: int) -> int:
    """Edits that a term of so many letters may have."""
    return 0 if length < 5 else 1 if length < 9 else 2


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray | None

    def score(self, text: str) -> float:
        if self.weights is None:
            return 0.0
        z = float(self.weights[0] + np.dot(self.weights[1:], self.lexicon.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _units(text: str) -> set[tuple[str, bool]]:
    """The different words of a text, and their beginnings (True)."""
    words = set(_WORD.findall(text.lower()))
    return {(w, False) for w in words if len(w) > 2} | {(w[:n], True) for w in words for n in STEMS if len(w) > n}


def choose(counts: list[tuple[str, bool, int, int]], positive: int, negative: int) -> Lexicon:
    """The lexicon from (unit, is stem, documents with it of label 1, of label 0)."""
    scored = {}
    for unit, stem, p, n in counts:
        if n * positive <= RATE * p * negative:
            scored[unit, stem] = p
    stems: list[str] = []
    words: list[str] = []
    stemmed: list[str] = []
    best_word = Counter()
    for (unit, stem), p in scored.items():
        if not stem:
            for n in STEMS:
                best_word[unit[:n]] = max(best_word[unit[:n]], p)
    for (unit, stem), p in sorted(scored.items(), key=lambda x: (len(x[0][0]), x[0])):
        if stem and best_word[unit] < 0.6 * p and not any(unit.startswith(s) for s in stems):
            stems.append(unit)
    for (unit, stem), p in sorted(scored.items(), key=lambda x: (-x[1], x[0])):
        if not stem:
            (stemmed if any(unit.startswith(s) for s in stems) else words).append(unit)
    return Lexicon(words, stems, stemmed)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps; the first weight is the base."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, text) with the ``SIGNATURE`` min-hashes of each text's shingles."""
    seeds = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64))
    for batch in batches:
        least = []
        for text in batch.column(1).to_pylist():
            codes = np.array([zlib.crc32(w.encode()) for w in _WORD.findall(text.lower())], np.uint64)
            grams = ngram_hash(codes, min(SHINGLE, len(codes))) if len(codes) else np.zeros(1, np.uint64)
            least += [mix(grams ^ seed).min() for seed in seeds]
        offsets = pa.array(np.arange(0, len(least) + 1, SIGNATURE, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, as_long(np.array(least, np.uint64)))], ["y", "text", "least"])


def without_copies(rows: DataFrame) -> DataFrame:
    """(y, text) of a bounded sample, without texts that share a min-hash with one of the same label and a smaller hash."""
    signed = rows.mapInArrow(_sign, "y int, text string, least array<long>").withColumn("h", F.xxhash64("text"))
    each = signed.select("y", "h", F.posexplode("least").alias("k", "least"))
    first = F.min("h").over(Window.partitionBy("y", "k", "least"))
    kept = each.select("y", "h", (F.col("h") > first).alias("copy")).groupBy("y", "h").agg(F.max("copy").alias("copy")).filter("not copy")
    # no more than the sample's rows are broadcast
    return signed.join(F.broadcast(kept), ["y", "h"]).select("y", "text")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE_PER_LABEL) -> Model:
    """The model from labelled documents, all of which may be learned from."""
    marks = labels.groupBy(labels[id_col].alias("id")).agg(F.max(labels[label_col]).alias("y")).filter("y in (0, 1)")
    chosen = sample_ids(marks.filter("id is not null"), "y", sample)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).filter("text is not null")
    # at most 2 * sample rows are broadcast
    rows = texts.join(F.broadcast(chosen), "id").select(F.col("y").cast("int").alias("y"), "text").distinct()
    rows = without_copies(rows).cache()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total.update((unit, stem, y) for unit, stem in _units(text))
        keys = list(total)
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([k[2] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["unit", "stem", "y", "n"])

    sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    positive, negative = sizes.get(1, 0), sizes.get(0, 0)
    if not positive or not negative:
        rows.unpersist()
        return Model(Lexicon([], []), None)
    units = rows.mapInArrow(count, "unit string, stem boolean, y int, n long").groupBy("unit", "stem").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("q"))
    units = units.cache()
    # Chernoff's bound on chance: as many units as there are would give about one false term
    seen, share = F.col("p") + F.col("q"), positive / (positive + negative)
    a, b = F.col("p") / seen, F.col("q") / seen
    surprise = seen * (a * F.log(a / share) + F.when(b > 0, b * F.log(b / (1 - share))).otherwise(0.0))
    frequent = units.filter((F.col("p") >= 3) & (F.col("q") * positive <= RATE * F.col("p") * negative)).filter(surprise >= math.log(units.count()))
    # the bound on chance alone decides; the units are those of a bounded sample
    top = frequent.orderBy(F.desc(surprise), "unit", "stem").collect()
    units.unpersist()
    lexicon = choose([(r.unit, r.stem, r.p, r.q) for r in top], positive, negative)

    words, stems, stemmed = lexicon.words, lexicon.stems, lexicon.stemmed

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(words, stems, stemmed)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], ["y", "x"])

    seen = rows.mapInArrow(describe, "y int, x array<double>").collect()
    rows.unpersist()
    return Model(lexicon, fit(np.array([r.x for r in seen]), np.array([r.y for r in seen], float)))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with score and predicted."""
    rest = [f.name for f in docs.schema.fields if f.name != text_col]
    schema = docs.select(*[docs[c] for c in rest]).schema.add("score", "double").add("predicted", "integer")
    words, stems, stemmed, weights = model.lexicon.words, model.lexicon.stems, model.lexicon.stemmed, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(Lexicon(words, stems, stemmed), weights)
        for batch in batches:
            found = np.array([own.score(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32))], schema.fieldNames())

    return docs.select(*[docs[c] for c in rest], docs[text_col]).mapInArrow(run, schema)


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learned from those that aren't held out."""
    named = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    marks = labels.select(labels[id_col].alias("doc_id"), labels["toxic"].alias("toxic")).filter(~held_out())
    model = learn(named.filter(~held_out()), marks)
    return score(named.select("doc_id", held_out().alias("held_out"), "text"), model)
