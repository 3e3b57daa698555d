"""Benchmark decontamination: a prefix-filtered set join of item windows and documents.

A window is a run of item words, its set the word pairs (shingles) in it. Shingles
are ordered by rarity, counted over the whole corpus. A document holds a window only
if it holds all the window's shingles, so the prefix that must be joined is the one
rarest shingle of the window. Where a document has it, the positional bound places
the window (at the shingle's position less its offset), the length bound drops
places that run over the document's ends, and the words there are compared with the
window's.

Items are taken in blocks of bounded size, each broadcast and joined with all
documents; a benchmark of any size is a number of passes, not a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key, segments, spread_join

#: Bytes of item text that one pass broadcasts at most.
BLOCK_BYTES = 16 << 20
WINDOW_WORDS = 8
#: A-Z become a-z, other word bytes stay (all of any character beyond ASCII), the rest part words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Identifies a row; equal rows have equal results.
ROW = row_key("cast(doc_id as long)", "cast(text as string)")
#: Word numbers that no item has: a word outside the items, the gap between documents, and padding.
OUTSIDE, GAP, PAD = -1, -2, -3


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        return OUTSIDE


class Windows:
    """The distinct windows of a block of items, and the shingles in them."""

    def __init__(self, items: list[tuple], window: int) -> None:
        self.numbers = Numbers()
        of: dict[tuple, set] = {}
        for item, text in items:
            ids = tuple(self.numbers.setdefault(w, len(self.numbers)) for w in words_of(text))
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                of.setdefault(ids[i : i + window], set()).add(item)
        self.base = len(self.numbers) + 1
        rows = sorted(of)
        self.width = np.array([len(r) for r in rows], np.int64)
        self.words = np.full((len(rows), window), PAD, np.int32)
        for i, r in enumerate(rows):
            self.words[i, : len(r)] = r
        self.items = [sorted(of[r], key=lambda x: (x is None, x)) for r in rows]
        # A window of one word has that word for its shingle.
        self.shingles = [
            [r[k] * self.base + r[k + 1] for k in range(len(r) - 1)] or [r[0] * self.base + self.base - 1] for r in rows
        ]
        self.codes = np.unique(np.array([c for x in self.shingles for c in x], np.int64))

    def number(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row with a gap after each; where each begins; words in each."""
        lists = [words_of(t) for t in texts]
        count = np.array([len(x) for x in lists], np.int64)
        start = np.cumsum(count + 1) - count - 1
        ids = np.full(int((count + 1).sum()), GAP, np.int32)
        for at, x in zip(start.tolist(), lists, strict=True):
            ids[at : at + len(x)] = np.fromiter(map(self.numbers.__getitem__, x), np.int32, len(x))
        return ids, start, count

    def places(self, ids: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of shingles among ``codes`` (sorted), and the index of each there."""
        if not len(codes) or not len(ids):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(ids >= 0)
        after = np.append(ids[1:], GAP)[at].astype(np.int64)
        left = ids[at].astype(np.int64) * self.base
        single = codes % self.base == self.base - 1
        out = []
        for pos, code in ((at[after >= 0], (left + after)[after >= 0]), *([(at, left + self.base - 1)] if single.any() else [])):
            k = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            same = codes[k] == code
            out.append((pos[same], k[same]))
        return np.concatenate([p for p, _ in out]), np.concatenate([k for _, k in out])


class Anchors:
    """Each window's prefix: its rarest shingle, with its offset."""

    def __init__(self, windows: Windows, counts: dict[int, int]) -> None:
        self.windows = windows
        offsets = [min(range(len(x)), key=lambda k: (counts.get(x[k], 0), x[k])) for x in windows.shingles]
        anchor = np.array([x[k] for x, k in zip(windows.shingles, offsets, strict=True)], np.int64)
        order = np.argsort(anchor, kind="stable")
        self.codes, self.first = np.unique(anchor[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))
        self.window, self.offset = order, np.array(offsets, np.int64)[order]

    def matches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows begin among the word numbers, and which; verified word by word."""
        w = self.windows
        pos, k = w.places(ids, self.codes)
        many = (self.last - self.first)[k]
        slot = np.repeat(self.first[k] - np.cumsum(many) + many, many) + np.arange(many.sum())
        window = self.window[slot]
        start = np.repeat(pos, many) - self.offset[slot]
        inside = (start >= 0) & (start + w.width[window] <= len(ids))
        start, window = start[inside], window[inside]
        for j in range(w.words.shape[1]):
            want = w.words[window, j]
            same = (want == PAD) | (ids[np.minimum(start + j, len(ids) - 1)] == want)
            start, window = start[same], window[same]
        return start, window


def covered(starts: np.ndarray, widths: np.ndarray) -> list[list[int]]:
    """Disjoint runs ``[from, to)`` that the intervals cover, in order."""
    runs: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), (starts + widths).tolist(), strict=True)):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return runs


FOUND = "row binary, doc_id long, n_words long, runs array<array<long>>, items array<long>"


def occurrences(docs: DataFrame, items: list[tuple], window: int, row: str, hits_only: bool = False) -> DataFrame:
    """One pass: for every document (or only those with a hit) its words, the runs of hit words and the items found."""
    spark = docs.sparkSession
    windows = spark.sparkContext.broadcast(Windows(items, window))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value
        total = np.zeros(len(w.codes), np.int64)
        for batch in segments(batches):
            _, k = w.places(w.number(batch.column("text").to_pylist())[0], w.codes)
            total += np.bincount(k, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(w.codes[some]), pa.array(total[some])], ["code", "n"])

    texts = docs.select("text")
    rarity = texts.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    # A row for each shingle of the block at most.
    anchors = spark.sparkContext.broadcast(Anchors(windows.value, {r.code: r.n for r in rarity.collect()}))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = anchors.value
        w = a.windows
        for batch in segments(batches):
            ids, first, count = w.number(batch.column("text").to_pylist())
            start, window = a.matches(ids)
            doc = np.searchsorted(first, start, side="right") - 1
            order = np.argsort(doc, kind="stable")
            start, window, doc = start[order], window[order], doc[order]
            runs: list[list] = [[] for _ in count]
            found: list[list] = [[] for _ in count]
            hit, at = np.unique(doc, return_index=True)
            for d, i, j in zip(hit.tolist(), at.tolist(), np.append(at, len(doc))[1:].tolist(), strict=True):
                runs[d] = covered(start[i:j] - first[d], w.width[window[i:j]])
                found[d] = sorted({x for k in np.unique(window[i:j]).tolist() for x in w.items[k] if x is not None})
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    pa.array(count),
                    pa.array(runs, pa.list_(pa.list_(pa.int64()))),
                    pa.array(found, pa.list_(pa.int64())),
                ],
                ["row", "doc_id", "n_words", "runs", "items"],
            )
            yield out.take(pa.array(hit)) if hits_only else out

    return docs.selectExpr(f"{row} as row", "doc_id", "text").mapInArrow(find, FOUND)


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_bytes`` of text; only one is held at a time."""
    items = benchmark.selectExpr(f"cast(`{id_col}` as long) as item_id", f"coalesce(cast(`{text_col}` as string), '') as text")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in part.collect()]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``row, doc_id, n_words, runs, items`` for every document.

    ``row`` is a hash of id and text, ``runs`` are the word ranges ``[from, to)`` that occurrences of windows cover and
    ``items`` the sorted ids of items with one. A null or empty text has no words and
    no hits; items without words have no windows; a null item id is matched but not
    listed; repeated rows of either table repeat or change nothing; an empty benchmark
    hits nothing. Other columns aren't read.
    """
    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text")
    blocks = blocks_of(benchmark, item_id_col, item_text_col, block_bytes)
    items, more = next(blocks, []), next(blocks, None)
    # With one block every row has its result at once. Of several, the first pass alone gives all rows, the others their hits.
    passes = occurrences(rows, items, window, ROW)
    if more is not None:
        found = [cut(passes)]
        while more is not None:
            found.append(cut(occurrences(rows, more, window, ROW, hits_only=True)))
            more = next(blocks, None)
        hits = reduce(DataFrame.unionByName, (x.where(F.size("runs") > 0) for x in found))
        merged = hits.groupBy("row").agg(
            F.flatten(F.collect_set("runs")).alias("all_runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("all_items")
        )
        join_runs = """aggregate(array_sort(all_runs), cast(array() as array<array<bigint>>), (out, r) ->
            if(size(out) > 0 and r[0] <= element_at(out, -1)[1],
               concat(slice(out, 1, size(out) - 1), array(array(element_at(out, -1)[0], greatest(r[1], element_at(out, -1)[1])))),
               concat(out, array(r))))"""
        merged = merged.select("row", F.expr(join_runs).alias("all_runs"), "all_items")
        # Equal rows have equal results, so passes meet by what a row holds; copies of one row are dealt to many tasks.
        passes = spread_join(found[0], merged, "row", "left")
        passes = passes.withColumn("runs", F.coalesce("all_runs", "runs")).withColumn("items", F.coalesce("all_items", "items"))
    return passes.select("row", "doc_id", "n_words", "runs", "items")


def op5_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest of :func:`find_contamination`."""
    return find_contamination(docs, benchmark).selectExpr(
        "doc_id",
        "n_words",
        "aggregate(runs, 0L, (n, r) -> n + r[1] - r[0]) as n_hit",
        "cast(size(items) as long) as n_items",
        "sha2(array_join(array_sort(transform(items, i -> cast(i as string))), ','), 256) as items_sha256",
        "size(items) >= 2 as contaminated",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least_items: int = 1, window: int = WINDOW_WORDS) -> DataFrame:
    """The rows of documents in which windows of fewer than ``least_items`` items occur; all columns stay.

    Needs ``doc_id`` and ``text``. A passage of a single item is enough by default: it
    is a window's eight words in a row, which clean text doesn't hold by chance.
    """
    found = find_contamination(docs, benchmark, window).where(F.size("items") >= least_items)
    bad = found.select(F.col("row").alias("__bad_row")).distinct()
    return docs.join(bad, F.expr(ROW) == F.col("__bad_row"), "left_anti")
