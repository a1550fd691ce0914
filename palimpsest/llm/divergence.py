"""Source divergence audit: how far the sources of a language differ in their terms, by sort-based streaming.

Each task first counts the terms of its own documents by (lang, term, source), so that a term or source of a third of all
words is a few rows a task. These partial counts are dealt by (lang, term) and sorted by (lang, term, source, first document);
one scan over the runs of equal values yields each term's document frequency and its counts by source. Terms in enough
documents of their language are kept.

A second scan over the runs of the kept terms emits the terms in which a source stands out of its language, and partial sums for pairs of sources.
A source's share of a term it doesn't have is the same for all such terms, so that what a pair's sum is without any term
is known beforehand; terms that one of the two has depend on how often it has them only, and are added by a histogram of its counts. A run
therefore emits pairs only of sources that both have the term, as the difference that this makes; a task adds them
up before they are shuffled.

All numbers are whole: shares are parts in 10**9, p = 1 + floor(10**9 (count + 2) / (N + 2 V)), and a term's divergence is
floor((p - q)**2 / (p + q)). Products with counts are decimals of 38 digits.

Defined results. Null text, lang and source are ''. Each row is a document, repeated rows too. A source without terms counts with N = 0; a language
without kept terms has pairs of value 0. Other columns of the input, whatever their names, take no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize
from ._text import LOWER, slices
from .periodic import numbered, packed_words

MIN_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Rows of partial counts or sums that a task holds before it gives them away.
HELD_ROWS = 400_000
SLICE = 4 << 20

#: Bytes of a term are letters and all beyond ASCII (not [\x00-\x40\x5B-\x60\x7B-\x7F]).
_IN_TERM = np.zeros(256, bool)
_IN_TERM[0x41:0x5B] = _IN_TERM[0x61:0x7B] = _IN_TERM[0x80:] = True


def term_spans(buf: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, bounds): spans of the terms; bounds[d]:bounds[d + 1] are those of document d."""
    inside = _IN_TERM[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # a document's edge ends a term
    inner = edges[(edges > 0) & (edges < len(buf))]
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, edges)


def _merged(parts: list[pa.Table]) -> pa.Table:
    """Partial counts added up by (lang, term, source)."""
    table = pa.concat_tables(parts).group_by(["lang", "term", "source"]).aggregate([("document", "min"), ("documents", "sum"), ("count", "sum")])
    return table.select(["lang", "term", "source", "document_min", "documents_sum", "count_sum"]).rename_columns(["lang", "term", "source", "document", "documents", "count"])


def _counted(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """Counts of a batch (doc_id, lang, source, text), a slice at a time."""
    lang, source = batch.column(1).dictionary_encode(), batch.column(2).dictionary_encode()
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    for first, _, buf, edges in slices(batch, "text", SLICE):
        start, end, bounds = term_spans(buf, edges)
        if not len(start):
            continue
        data, offsets = packed_words(LOWER[buf], start, end)
        # term numbers, and a place where each is written
        code = numbered(data, offsets)
        n = int(code.max()) + 1
        shown = np.zeros(n, np.int64)
        shown[code] = np.arange(len(code))
        key, tf = np.unique(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * n + code, return_counts=True)
        doc = key // n
        at = group[first + doc] * n + key % n
        order = np.argsort(at, kind="stable")
        cut = np.flatnonzero(np.diff(at[order], prepend=-1))
        g, c = np.divmod(at[order][cut], n)
        text = pa.Array.from_buffers(pa.large_string(), len(code), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        columns = {
            "lang": lang.dictionary.take(pa.array(g // len(source.dictionary))),
            "term": text.take(pa.array(shown[c])).cast(pa.string()),
            "source": source.dictionary.take(pa.array(g % len(source.dictionary))),
            "document": batch.column(0).take(pa.array(first + doc[order][cut])),
            "documents": pa.array(np.diff(np.append(cut, len(at)))),
            "count": pa.array(np.add.reduceat(tf[order], cut)),
        }
        yield pa.table(columns)


def partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, source, document, documents, count): counts of spans of documents, the least id of a span with them; docs: doc_id, lang, source, text without nulls but for ids."""
    schema = docs.select("lang", F.col("text").alias("term"), "source", F.col("doc_id").alias("document")).schema.add("documents", "long").add("count", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for part in _counted(batch):
                held.append(part)
                if sum(t.num_rows for t in held) >= HELD_ROWS:
                    held = [_merged(held)]
                    if held[0].num_rows >= HELD_ROWS // 2:
                        yield from held.pop().to_batches(max_chunksize=1 << 16)
        if held:
            yield from _merged(held).to_batches(max_chunksize=1 << 16)

    return docs.select("doc_id", "lang", "source", "text").mapInArrow(run, schema)


def _changes(*columns: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """True where a row differs from the one before it in some column; the first row does."""
    out = np.ones(len(columns[0]), bool)
    if len(out) > 1:
        out[1:] = False
        for c in columns:
            out[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return out


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows (lang, term, ...) with counts of one source added up: (rows, starts of runs of a term), each run whole."""
    held = None

    def reduced(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        starts = np.flatnonzero(_changes(table["lang"], table["term"], table["source"]))
        out = table.take(pa.array(starts))
        for name in {"documents", "count"} & set(table.column_names):
            out = out.set_column(out.column_names.index(name), name, pa.array(np.add.reduceat(table[name].to_numpy(), starts)))
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = reduced(pa.concat_tables([held, table]) if held is not None else table)
        starts = np.flatnonzero(_changes(table["lang"], table["term"]))
        held = table.slice(starts[-1])
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
    if held is not None and held.num_rows:
        yield held, np.zeros(1, np.int64)


def kept_terms(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, term, source, count, lang_count, first): the terms in at least min_documents documents of a language, by source; first marks one row of each term."""
    parts = partial_counts(docs)
    schema = parts.select("lang", "term", "source", "count", F.col("count").alias("lang_count")).schema.add("first", "boolean")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_runs(batches):
            size = np.diff(np.append(starts, table.num_rows))
            often = np.add.reduceat(table["documents"].to_numpy(), starts) >= min_documents
            total = np.repeat(np.add.reduceat(table["count"].to_numpy(), starts), size)
            first = np.zeros(table.num_rows, bool)
            first[starts] = True
            keep = pa.array(np.repeat(often, size))
            out = table.select(["lang", "term", "source", "count"]).append_column("lang_count", pa.array(total)).append_column("first", pa.array(first))
            yield from out.filter(keep).combine_chunks().to_batches()

    return parts.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document").mapInArrow(scan, schema)


def share(count: str, n: str, v: str) -> F.Column:
    """p of a count; null without kept terms."""
    return F.expr(f"1 + (CAST({SCALE} AS decimal(38,0)) * ({count} + 2)) div nullif(CAST({n} + 2 * {v} AS decimal(38,0)), 0)")


def divergence(p: str, q: str) -> F.Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def partial_pairs(shares: DataFrame) -> DataFrame:
    """(lang, source, item, more), source < item: sums over terms that both have of f(p, p') - f(p, none') - f(none, p') + f(none, none')."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = lambda p, q: (p - q) ** 2 // (p + q)
        held: list[pa.Table] = []
        names = ["lang", "source", "item"]

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by(names).aggregate([("more", "sum")]).rename_columns([*names, "more"])

        for table, starts in _whole_runs(batches):
            run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
            p, none = table["p"].to_numpy(), table["none"].to_numpy()
            lang, source = (table[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
            lang, source = ((x.chunk(0) if isinstance(x, pa.ChunkedArray) else x) for x in (lang, source))
            n, s = len(source.dictionary), source.indices.to_numpy().astype(np.int64)
            lang_at = lang.indices.to_numpy().astype(np.int64)
            at, lag = np.arange(table.num_rows), 0
            while True:
                lag += 1
                at = at[at + lag < table.num_rows]
                at = at[run[at] == run[at + lag]]
                if not len(at):
                    break
                a, b = at, at + lag
                more = f(p[a], p[b]) - f(p[a], none[b]) - f(none[a], p[b]) + f(none[a], none[b])
                key = (lang_at[a] * n + s[a]) * n + s[b]
                order = np.argsort(key, kind="stable")
                cut = np.flatnonzero(np.diff(key[order], prepend=-1))
                own = key[order][cut]
                held.append(pa.table({
                    "lang": lang.dictionary.take(pa.array(own // n // n)), "source": source.dictionary.take(pa.array(own // n % n)),
                    "item": source.dictionary.take(pa.array(own % n)), "more": pa.array(np.add.reduceat(more[order], cut)),
                }))
                if sum(t.num_rows for t in held) >= HELD_ROWS:
                    held = [merged()]
                    if held[0].num_rows >= HELD_ROWS // 2:
                        yield from held.pop().to_batches(max_chunksize=1 << 16)
        if held:
            yield from merged().to_batches(max_chunksize=1 << 16)

    columns = shares.select("lang", "term", "source", "p", "none")
    return columns.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(scan, "lang string, source string, item string, more long")


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank.

    Part "pair": for each (lang, source) all other sources of the language by divergence. Part "term": the ``top`` terms that
    the source has more often than the language.
    """
    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    kept = materialize(kept_terms(rows, min_documents), "kept")

    langs = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"), F.sum("count").alias("lang_n"))
    counts = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = rows.select("lang", "source").distinct().join(counts, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "v", "lang_n"])
    groups = materialize(groups.withColumn("none", share("0L", "n", "v")), "groups")

    shares = materialize(kept.join(groups, ["lang", "source"]).select("lang", "term", "source", share("count", "n", "v").alias("p"), share("lang_count", "lang_n", "v").alias("q"), "none"), "shares")
    by_value = lambda *c: Window.partitionBy("lang", "source").orderBy(F.desc("value"), *c)
    standing_out = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence("p", "q").alias("value"))
    terms = standing_out.withColumn("rank", F.row_number().over(by_value("item"))).filter(F.col("rank") <= top)

    # what a source's own terms add to a pair where the other has none of them
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other"))
    alone = shares.groupBy("lang", "source", "p", "none").agg(F.count(F.lit(1)).alias("times"))
    added = alone.join(other, "lang").filter("source <> item").select("lang", "source", "item", (F.col("times") * (divergence("p", "other") - divergence("none", "other"))).alias("more"))
    both = partial_pairs(shares)
    sums = added.unionByName(both).select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), "more")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("more").alias("more"))
    pairs = groups.join(other, "lang").filter("source < item").select("lang", "source", "item", (F.col("v") * divergence("none", "other")).alias("base"))
    pairs = materialize(pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", (F.coalesce("base", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("value")), "pairs")
    pairs = pairs.union(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value("item")))
    return ranked.unionByName(terms)
