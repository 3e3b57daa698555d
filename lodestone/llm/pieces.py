"""SentencePiece encoding and decoding over a relational lattice.

Texts are parted where no piece can reach across, so equal words are encoded once. All
substrings of a word that are no longer than the longest piece are exploded and
equi-joined to the piece table; the matches are the edges of the word's lattice. Long
words are parted where no piece has two neighbouring characters; what is still long is
exploded in overlapping chunks, whose edges are put together where the word is. Edges are
grouped by word and folded into its pieces by a higher-order aggregate: Viterbi's
best path for unigram models, and for BPE models, whose scores order merges rather than
weigh paths, the merges in that order over the same edges. Characters that no piece
covers become their UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts_for, release, segments

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Pieces that are broadcast at most; a larger table is joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Characters of a word that one long's bits can part; longer words are parted or chunked, and folded by a queue.
MOST_BITS = 60
#: Characters at which substrings of one chunk of a long word begin.
CHUNK = 64
#: Bytes of text whose words are looked up together.
BLOCK_BYTES = 6 << 20
#: Bytes of text for each bucket that the words are dealt to.
BUCKET_BYTES = 4 << 20
#: Ids travel as characters from here on.
FIRST_ID = 0x10000
#: Between words that travel together; between fields of an encoded word.
GAP, FIELD = "\ufdd0", "\ufdd1"
#: Before a chunk of a long word.
PIECE_OF = FIELD + FIELD
#: Sent words are compressed so.
PACK_LEVEL = 6
#: Characters that are parts of their own; they aren't looked up.
BREAKS = f"\n{GAP}{FIELD}"


@dataclass(frozen=True)
class Vocabulary:
    """The pieces of a model and what its type implies."""

    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    kind: str
    unknown: int

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)

    def after_letters(self) -> str:
        """Punctuation that follows a letter in no piece, so that no piece reaches across such a place."""
        inside = {b for p, _, _ in self.pieces for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        return "".join(c for c in string.punctuation if c not in inside)

    def neighbours(self) -> frozenset[str]:
        """All two characters that stand side by side in some piece; no piece reaches across others."""
        return frozenset(p[i : i + 2] for p, _, _ in self.pieces for i in range(len(p) - 1))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.pieces), "piece string, id int, score double")


def load(path: str = MODEL, kind: str = "bpe") -> Vocabulary:
    """Read a model's pieces on the driver; executors need no copy of the file.

    Normalization must leave texts as they are but for the space mark, no piece may
    hold a mark after another character or a line break, and one pass over merges must be
    exact; all are checked.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain, raw = [], [-1] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            raw[int(piece[1:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            plain.append((piece, i, float(model.get_score(i))))
    for piece, _, _ in plain:
        if MARK in piece.lstrip(MARK) or not set(BREAKS).isdisjoint(piece):
            raise ValueError(f"a piece reaches across words: {piece!r}")
    for probe in ("a  b", " ﬁ X", "İ½"):
        if model.decode(model.encode(probe)) != probe:
            raise ValueError("the model normalizes texts")
    vocabulary = Vocabulary(tuple(plain), tuple(raw), kind, model.unk_id())
    if kind == "bpe" and not steady(vocabulary):
        raise ValueError("a later merge of this model makes an earlier one possible")
    return vocabulary


#: A break, marks with what follows them, or marks alone.
PART = re.compile(f"[{BREAKS}]|{MARK}*[^{MARK}{BREAKS}]+|{MARK}+")


def words_of(text: str) -> list[str]:
    """The parts of a text (spaces marked, one mark put first) that no piece reaches across; some may be empty."""
    if "  " in text or MARK in text or GAP in text or FIELD in text or text.startswith(" "):
        return PART.findall(MARK + text.replace(" ", MARK))
    # The same for texts without runs of marks, by splitting alone.
    return (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ") if text else []


@dataclass(frozen=True)
class Parting:
    """Where words may be parted: before the punctuation ``ends``, and in long words between no ``neighbours``.

    What is long even so is looked up in chunks of ``CHUNK`` characters and as many more
    as the longest piece reaches (0 if whole words are looked up).
    """

    ends: str
    neighbours: frozenset[str]
    longest: int

    def atoms(self, word: str) -> tuple[str, ...]:
        """The parts of a word that no piece reaches across."""
        if len(word) > MOST_BITS:
            at = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.neighbours), len(word)]
            return tuple(word[a:b] for a, b in zip(at, at[1:], strict=False))
        core = word.rstrip(self.ends)
        return (core, word[len(core) :]) if len(core) < len(word) and core and core[-1].isalpha() else (word,)

    def entries(self, atom: str) -> list[str]:
        """What is looked up for an atom: itself, or its chunks behind a mark."""
        if len(atom) <= MOST_BITS or not self.longest:
            return [atom]
        return [PIECE_OF + atom[at : at + CHUNK + self.longest - 1] for at in range(0, len(atom), CHUNK)]


BLOCK = "block long, packed binary"


def blocks(docs: DataFrame) -> DataFrame:
    """``block, packed``: documents in compressed blocks named by a hash of their content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in segments(batches, limit=BLOCK_BYTES):
            whole = pa.RecordBatch.from_pylist(batch.to_pylist(), batch.schema)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
                out.write_batch(whole)
            packed = sink.getvalue().to_pybytes()
            name = int.from_bytes(hashlib.blake2b(packed, digest_size=8).digest(), "big", signed=True)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([packed], pa.binary())], ["block", "packed"])

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(run, BLOCK)


def unpack(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def dealt_words(texts: list[str | None], buckets: int, parting: Parting) -> dict[int, list[str]]:
    """What is looked up for texts by bucket, each once."""
    found: set[str] = set()
    for text in texts:
        found.update(words_of(text or ""))
    found.difference_update([*BREAKS, ""])
    ends = frozenset(parting.ends)
    other = [w for w in found if w[-1] in ends or len(w) > MOST_BITS]
    found.difference_update(other)
    for w in other:
        for atom in parting.atoms(w):
            found.update(parting.entries(atom) if len(atom) > MOST_BITS else (atom,))
    dealt: list[list[str]] = [[] for _ in range(buckets)]
    crc = zlib.crc32
    for word in found:
        dealt[crc(word.encode()) % buckets].append(word)
    return {i: words for i, words in enumerate(dealt) if words}


def block_words(packed: DataFrame, buckets: int, parting: Parting) -> DataFrame:
    """``bucket, words``: the distinct words (and chunks) of each block, dealt to buckets by their hash.

    The block's name comes first, behind a mark: every reader of the exchange then needs
    all its columns, and Spark makes it once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                dealt = dealt_words(unpack(raw).column("text").to_pylist(), buckets, parting)
                listed = [GAP.join([f"{FIELD}{block}", *x]) for x in dealt.values()]
                buckets_of = pa.array(list(dealt), pa.int32())
                del dealt
                release()
                yield pa.RecordBatch.from_arrays([buckets_of, pa.array(listed, pa.string())], ["bucket", "words"])

    return packed.mapInArrow(run, "bucket int, words string")


#: Bits of a packed edge: its place in the order of merges, its start, its length.
START_BITS, LENGTH_BITS = 28, 12


def merge_order(vocabulary: Vocabulary) -> list[tuple[str, int]]:
    """Pieces of two characters and more in the order in which merges make them."""
    longer = sorted((-score, i, p) for p, i, score in vocabulary.pieces if len(p) > 1)
    return [(p, n) for n, (_, _, p) in enumerate(longer)]


def spans(words: DataFrame, longest: int, least: int) -> DataFrame:
    """``bucket, word, n, s, l, piece``: every substring of ``least`` to ``longest`` characters; of a chunk those that begin in it."""
    mark, chunk = len(PIECE_OF), F.col("word").startswith(PIECE_OF)
    each = words.withColumn("skip", F.when(chunk, mark).otherwise(0)).withColumn("n", F.expr("length(word) - skip")).where(F.col("n") >= least)
    each = each.withColumn("s", F.explode(F.expr(f"sequence(0, if(skip > 0, least({CHUNK - 1}, n - {least}), n - {least}))")))
    each = each.withColumn("l", F.explode(F.expr(f"sequence({least}, least({longest}, n - s))")))
    return each.withColumn("piece", F.expr("substring(word, skip + s + 1, l)")).drop("skip")


def bounded(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= MOST_BROADCAST else table


PACKED = f"shiftleft(cast(place as bigint), {START_BITS + LENGTH_BITS}) | shiftleft(cast(s as bigint), {LENGTH_BITS}) | l"


def piece_places(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    order = merge_order(vocabulary)
    return bounded(spark.createDataFrame(order, "piece string, place int"), len(order))


def merge_lattices(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``bucket, word, n, edges``: each word's pieces of two characters and more, packed, first merge first.

    ``words`` is partitioned by ``bucket``, so nothing is shuffled. A word without such
    pieces has no row.
    """
    pieces = piece_places(words.sparkSession, vocabulary)
    edges = spans(words, vocabulary.longest, 2).join(pieces, "piece")
    # The hash comes first: grouping sorts by it, and comparing numbers is quick.
    grouped = edges.withColumn("hash", F.xxhash64("word")).groupBy("hash", "word", "bucket", "n")
    return grouped.agg(F.sort_array(F.collect_list(F.expr(PACKED))).alias("edges")).drop("hash")


#: Bit i of ``b`` says that a piece begins or ends before character i. An edge joins the pieces it spans if there
#: are exactly two; edges come in the order of merges, and a merge never makes an earlier one possible
#: (:func:`steady`), so one pass does all.
MERGES = f"""aggregate(
    transform(edges, e -> named_struct('s', cast(shiftright(e, {LENGTH_BITS}) & {(1 << START_BITS) - 1} as int), 'l', cast(e & {(1 << LENGTH_BITS) - 1} as int))),
    shiftleft(1L, n + 1) - 1,
    (b, e) -> if(getbit(b, e.s) = 1 and getbit(b, e.s + e.l) = 1 and bit_count(shiftright(b, e.s + 1) & (shiftleft(1L, e.l - 1) - 1)) = 1,
      b & ~shiftleft(shiftleft(1L, e.l - 1) - 1, e.s + 1), b))"""


def merge_folds(lattices: DataFrame) -> DataFrame:
    """``bucket, word, borders, edges``: where each word's pieces part, as bits; words with runs of marks, and chunks, keep edges."""
    suits = f"not contains(word, '{MARK}{MARK}') and not startswith(word, '{FIELD}')"
    return lattices.select(
        "bucket", "word", F.expr(f"if({suits}, {MERGES}, null)").alias("borders"), F.expr(f"if({suits}, null, edges)").alias("edges")
    )


def steady(vocabulary: Vocabulary) -> bool:
    """Whether one pass in merge order is exact: all pieces but runs of marks, taken alone, are two pieces at their turn."""
    place = dict(merge_order(vocabulary))
    for piece, turn in place.items():
        if piece.strip(MARK) == "":
            continue
        parts = list(piece)
        while True:
            ways = [(place.get(a + b, turn), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            best = min(ways, default=(turn, 0))
            if best[0] >= turn:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        if len(parts) != 2:
            return False
    return True


def merged(word: str, edges: list[int] | None) -> list[str]:
    """The merges of any word over its edges, by a queue: best first, then leftmost."""
    n = len(word)
    spans_: dict[tuple[int, int], int] = {}
    for e in edges or []:
        s = e >> LENGTH_BITS & (1 << START_BITS) - 1
        spans_[s, s + (e & (1 << LENGTH_BITS) - 1)] = e >> START_BITS + LENGTH_BITS
    after = list(range(1, n + 1))  # where the piece that begins here ends; 0 if none begins
    before = list(range(-1, n))  # where the piece before begins
    queue = [(spans_[s, s + 2], s, s + 1, s + 2) for s in range(n - 1) if (s, s + 2) in spans_]
    heapq.heapify(queue)
    while queue:
        _, s, middle, end = heapq.heappop(queue)
        if after[s] != middle or middle >= n or after[middle] != end:
            continue
        after[s], after[middle] = end, 0
        if end < n:
            before[end] = s
        for a, b in ((before[s], s), (s, end)):
            if a >= 0 and b < n and after[b] and (a, after[b]) in spans_:
                heapq.heappush(queue, (spans_[a, after[b]], a, b, after[b]))
    out, s = [], 0
    while s < n:
        out.append(word[s : after[s]])
        s = after[s]
    return out


def parted(word: str, borders: int) -> list[str]:
    at = [i for i in range(len(word) + 1) if borders >> i & 1]
    return [word[a:b] for a, b in zip(at, at[1:], strict=False)]


#: Viterbi over positions: the best score to reach each, from where, by which piece; then back from the end.
FORWARD = """aggregate(sequence(1, n), array(named_struct('score', 0D, 'from', 0, 'id', -1)),
    (t, j) -> concat(t, array(array_max(transform(filter(edges, e -> e.s + e.l = j), e -> named_struct(
      'score', t[e.s].score + coalesce(e.score, {unknown}D), 'from', e.s, 'id', coalesce(e.id, -1)))))))"""
BACK = """aggregate(sequence(1, n), named_struct('at', n, 'ids', cast(array() as array<int>)),
    (t, i) -> if(t.at = 0, t, named_struct('at', path[t.at].`from`, 'ids', concat(array(path[t.at].id), t.ids))),
    t -> t.ids)"""


def viterbi(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``bucket, word, ids``: the best path of a unigram model; -1 for a character that no piece covers."""
    pieces = vocabulary.table(words.sparkSession)
    edges = spans(words, vocabulary.longest, 1).join(bounded(pieces, len(vocabulary.pieces)), "piece", "left").where("id is not null or l = 1")
    lattice = edges.groupBy("bucket", "word", "n").agg(F.collect_list(F.struct("s", "l", "id", "score")).alias("edges"))
    # As unigram models have it, an uncovered character costs ten more than the worst piece.
    unknown = min(s for _, _, s in vocabulary.pieces) - 10
    return lattice.withColumn("path", F.expr(FORWARD.format(unknown=repr(float(unknown))))).select("bucket", "word", F.expr(BACK).alias("ids"))


class Coder:
    """What the assembly of words to ids and of ids to texts looks up."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.ids = {p: i for p, i, _ in vocabulary.pieces}
        self.bytes, self.unknown = vocabulary.byte_ids, vocabulary.unknown
        self.raw = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in enumerate(self.bytes) if i >= 0}
        self.character = {p: chr(FIRST_ID + i) for p, i in self.ids.items()}
        size = range(max(self.raw, default=-1) + 2)
        self.table = pa.array([self.raw.get(i, b"\xe2\x81\x87") for i in size], pa.binary())
        spelled = {i: p.encode() for p, i in self.ids.items()}
        self.spelled = pa.array([spelled.get(i, self.raw.get(i, b"\xe2\x81\x87")) for i in size], pa.binary())

    def fallback(self, character: str) -> list[int]:
        """The bytes of a character that no piece covers, or the unknown piece."""
        out = [self.bytes[b] for b in character.encode()]
        return out if min(out) >= 0 else [self.unknown]

    def characters(self, ids: list[int]) -> str:
        return "".join([chr(FIRST_ID + i) for i in ids])

    def of_parts(self, parts: list[str]) -> str:
        """The ids of parts, as characters."""
        get = self.character.get
        return "".join([get(p) or self.characters(self.fallback(p)) for p in parts])

    def of_path(self, word: str, ids: list[int]) -> list[int]:
        """A path's ids with the bytes of uncovered characters in place of -1."""
        out, at = [], 0
        for i in ids:
            out += [i] if i >= 0 else self.fallback(word[at])
            at += len(self.raw[i].decode()) if i >= 0 else 1
        return out

    def strung(self, table: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """What a table has for the ids of lists that lie end to end, strung together for each."""
        known = (ids >= 0) & (ids < len(table))
        stands = table.take(pa.array(np.where(known, ids, len(table) - 1)))
        begins = np.frombuffer(stands.buffers()[1], np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        stops = begins[ends].tolist()
        data = stands.buffers()[2].to_pybytes() if len(ids) and stands.buffers()[2] is not None else b""
        return [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """What pieces stand for; the first mark of each list is the one put before the text."""
        return [x.removeprefix(b" ") for x in self.strung(self.table, ids, ends)]

    def words(self, coded: list[str]) -> list[str]:
        """The words that ids as characters spell."""
        ids = np.frombuffer("".join(coded).encode("utf-32-le"), np.uint32).astype(np.int64) - FIRST_ID
        return [x.decode() for x in self.strung(self.spelled, ids, np.cumsum(list(map(len, coded)), dtype=np.int64))]

    def text(self, ids: list[int]) -> str:
        return self.texts(np.array(ids, np.int64), np.array([len(ids)]))[0].decode(errors="replace")


CODED = "doc_id long, ids array<int>, round_trip boolean"


def encode(docs: DataFrame, vocabulary: Vocabulary, text_bytes: int | None = None) -> DataFrame:
    """``doc_id, ids, round_trip``: the pieces of every row's whole text, and whether they decode to it.

    A null or empty text has no pieces; repeated rows repeat; null ids stay null; an
    empty table gives no rows. Other columns aren't read.

    Documents travel in compressed blocks. Each block's distinct words are dealt to
    buckets; a bucket's distinct words are encoded over their lattice and sent back, for
    each block those it has; so no table of all words is ever in one place.
    """
    spark = docs.sparkSession
    if text_bytes is None:
        text_bytes = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(parts_for(text_bytes, BUCKET_BYTES), 8)
    known = spark.sparkContext.broadcast(vocabulary)
    unigram = vocabulary.kind == "unigram"
    parting = Parting(vocabulary.after_letters(), vocabulary.neighbours(), 0 if unigram else vocabulary.longest)
    # One exchange, read twice: both readers see the same blocks.
    packed = blocks(docs).repartition(parts_for(text_bytes, BLOCK_BYTES) + 7, "block")
    dealt = block_words(packed, buckets, parting).repartition(buckets, "bucket")
    each = dealt.select("bucket", F.explode_outer(F.split("words", GAP)).alias("word"))
    words = each.where(~F.col("word").startswith(FIELD) | F.col("word").startswith(PIECE_OF)).distinct()
    table = viterbi(words, vocabulary) if unigram else merge_folds(merge_lattices(words, vocabulary))

    def answer(asked: pa.Table, coded: pa.Table) -> pa.Table:
        coder = Coder(known.value)
        entries: dict[str, str] = {}
        unknown = chr(FIRST_ID + coder.unknown)

        def enter(word: str, coded: str) -> str:
            # An id travels as a character. Words that their pieces don't spell travel with them.
            entries[word] = coded if unknown not in coded else f"{FIELD}{word}{FIELD}{coded}"
            return entries[word]

        release()
        columns = [coded.column(c).to_pylist() for c in coded.schema.names if c != "of"]
        if unigram:
            for word, path in zip(*columns, strict=True):
                enter(word, coder.characters(coder.of_path(word, path)))
        else:
            for word, borders, edges in zip(*columns, strict=True):
                if word.startswith(PIECE_OF):
                    entries[word] = f"{word}{FIELD}{','.join(map(str, edges))}"
                else:
                    enter(word, coder.of_parts(merged(word, edges) if borders is None else parted(word, borders)))
        names, raw = [], []
        for asked_words in asked.column("words").to_pylist():
            block, *listed = asked_words.split(GAP)
            names.append(int(block.removeprefix(FIELD)))
            # A word without an edge has a part for every character, a chunk without one has none.
            found = [entries.get(w) or (f"{w}{FIELD}" if w.startswith(PIECE_OF) else enter(w, coder.of_parts(list(w)))) for w in listed]
            raw.append(GAP.join(found).encode())
        packs = [pa.Codec("zstd", PACK_LEVEL).compress(x, asbytes=True) for x in raw]
        return pa.table([pa.array(names, pa.int64()), pa.array(map(len, raw), pa.int64()), pa.array(packs, pa.binary())], names=["block", "size", "pack"])

    coded = table.withColumnRenamed("bucket", "of").groupBy("of")
    answers = dealt.groupBy("bucket").cogroup(coded).applyInArrow(answer, "block long, size long, pack binary")

    class Words(dict):
        """Ids of words as strings of characters; a word of several atoms has all their ids, a long one those of its chunks' edges."""

        def __init__(self, coder: Coder, first: dict[str, str]) -> None:
            super().__init__(first)
            self.coder = coder

        def __missing__(self, word: str) -> str:
            atoms = parting.atoms(word)
            if len(atoms) > 1:
                self[word] = coded = "".join([self[a] for a in atoms])
                return coded
            entries = parting.entries(word)
            if entries[0].startswith(PIECE_OF) and all(e in self for e in entries):
                edges = [int(e) + (k * CHUNK << LENGTH_BITS) for k, x in enumerate(entries) if self[x] for e in self[x].split(",")]
                self[word] = self.coder.of_parts(merged(word, edges))
            else:
                raise KeyError(f"{word[:99]!r} isn't among its block's words; the documents changed while they were read")
            return self[word]

    def assemble(held: pa.Table, coded: pa.Table) -> pa.Table:
        release()
        coder = Coder(known.value)
        ids = Words(coder, {b: coder.characters(coder.fallback(b)) for b in BREAKS} | {"": ""})
        tables = [unpack(raw) for raw in held.column("packed").to_pylist()]
        texts = [t for rows in tables for t in rows.column("text").to_pylist()]  # of more than one if blocks are equal
        entries = [e for size, pack in zip(coded.column("size").to_pylist(), coded.column("pack").to_pylist(), strict=True) for e in pa.decompress(pack, size, "zstd", asbytes=True).decode().split(GAP)]
        plain = [e for e in entries if e[0] != FIELD]
        ids.update(zip(coder.words(plain), plain, strict=True))
        for e in entries:
            if e[0] == FIELD:
                word, _, coded_as = e.rpartition(FIELD)
                ids[word if word.startswith(PIECE_OF) else word[1:]] = coded_as
        names = [i for rows in tables for i in rows.column("doc_id").to_pylist()]
        parts, lengths = [], [0]
        for text in texts:
            joined = "".join(map(ids.__getitem__, words_of(text or "")))
            parts.append(joined.encode("utf-32-le"))
            lengths.append(len(joined))
        values = np.frombuffer(b"".join(parts), np.uint32).astype(np.int32) - FIRST_ID
        ends = np.cumsum(lengths)
        # What was put together is decoded whole.
        trips = [(text or "").encode() == back for text, back in zip(texts, coder.texts(values, ends[1:]), strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
        return pa.table([pa.array(names, pa.int64()), lists, pa.array(trips, pa.bool_())], ["doc_id", "ids", "round_trip"])

    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(assemble, CODED)


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``decoded`` beside the other columns: the text that ``ids`` stand for; null for null."""
    known = rows.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        coder = Coder(known.value)
        return pa.array([None if x is None else coder.text(x) for x in ids.to_pylist()], pa.string())

    return rows.withColumn("decoded", text("ids"))


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, n_tokens, ids, round_trip`` of every row."""
    return encode(docs, load(model)).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def op7_pieces(docs: DataFrame) -> DataFrame:
    """All documents, encoded and decoded."""
    return encode_documents(docs)
