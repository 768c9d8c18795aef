"""Best-fit packing of tokenised documents into fixed-length training sequences.

Bulk-synchronous best-fit over two range-sorted tables: documents and gaps. Sizes are integers of 1..``seq_len``, so
both are run-length encoded (a size, and how many share it). One superstep handles the documents of one size class,
larger classes first: documents and gaps are range-partitioned by size and every partition sweeps from its largest size
down, each document taking the successor, the smallest gap above it that is free; conflicts are resolved by rank inside
the runs (rank i of the documents takes rank i of the gaps). What partitions leave over meets in a closing sweep that
opens new sequences for documents no gap holds. The gaps shrink, are written, and the next class follows. No table of a
superstep has more rows than there are runs, however many documents there are; ranks of the documents themselves are
computed and applied in a distributed pass at the end.
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import by_bytes, stash, texts_only

SEQ_LEN = 4096
END_ID = 1
#: Distinct words whose ids a worker process keeps; a miss is encoded again, so the bound changes no result.
CACHE_WORDS = 1_500_000
_SLICE = 1 << 20
_SPACE = re.compile(rb"[ \n\t\r]")
_BLANK = bytes(32 if i in (9, 10, 13) else i for i in range(256))
_LOWER = bytes(i + 32 if 65 <= i <= 90 else _BLANK[i] for i in range(256))
#: Signs a letter or digit beside them never joins; the apostrophe is none, as it does.
_SIGNS = b"!#$%&()*+,-./:;<=>?@[]^_{|}~"
_ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
_LATIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Letters that stand for bytes in the vocabulary: printable ones for themselves, the others from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Words(dict):
    """Ids of words (UTF-8, lower case but for letters beyond ASCII), worked out when first asked for.

    A word is parted where signs meet letters or digits, which the tokenizer never joins, so its parts are shared with
    other words. Words of Latin letters go to the merges directly, everything else to the whole tokenizer.
    """

    def __init__(self, tokenizer):
        super().__init__({b"": b""})
        self.whole, self.merge = tokenizer.encode, tokenizer.model.tokenize

    def __missing__(self, w: bytes) -> bytes:
        if w.isalpha() and w.islower():
            ids = [t.id for t in self.merge(w.decode())]
        elif _LATIN.fullmatch(w):
            ids = [t.id for t in self.merge("".join(map(_BYTES.__getitem__, w.decode().lower().encode())))]
        else:
            word = w.rstrip(_SIGNS)
            if word and word != w and (word[-1] in _ALNUM or _LATIN.fullmatch(word[-2:])):
                out = self[w] = self[word] + self[w[len(word) :]]
                return out
            word = w.lstrip(_SIGNS)
            if word and word != w and (word[0] in _ALNUM or _LATIN.fullmatch(word[:2])):
                out = self[w] = self[w[: len(w) - len(word)]] + self[word]
                return out
            ids = self.whole(w.decode(), add_special_tokens=False).ids
        out = self[w] = array("I", ids).tobytes()
        return out


#: Texts a tokenizer must encode alike word by word and whole, for the word-wise way to be used with it.
_PROBES = ["Él dijo: ÀÿÞÖ (ñandú)... x--y's ß§ ª9º é's d'Éa é_a $$a$$ 9é%%%, it'll<b>a</b>", "The cat, it's 12,5 a.b ... ,x. DON'T\t\r\n Éa ﬁ", "a  b\n\nc. D, 9. é. ,. (x) [y] <|z", "ΑΣ İx H̱ X 你好 мир. ß, naïve-café"]
_CODERS: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Encoder:
    """Word-wise encoder: the tokenizer never joins text across white space, so words are encoded once each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Words(self.tokenizer)
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.wordwise = True
        self.wordwise = all(self.encode([x.encode()])[0] == self._whole(x.encode()) for x in _PROBES)

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _one(self, text: bytes, low: bytes) -> bytes:
        """Ids of a text whose lower-case form is ``low``.

        The tokenizer drops white space and lower-cases. Letters keep their case where combining marks (lead bytes 0xCC,
        0xCD) are in the text, because those are composed before it lower-cases. A text that may have a special token, in
        any case of letters, goes to the tokenizer whole.
        """
        if any(x in low for x in self.special):
            return self._whole(text)
        marked = b"\xcc" in low or b"\xcd" in low
        return b"".join(map(self.known.__getitem__, (text.translate(_BLANK) if marked else low).split(b" ")))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (UTF-8); whole texts at a time with a tokenizer that does not pass
        the probes of the word-wise way."""
        if not self.wordwise:
            return [self._whole(text) for text in texts]
        if len(self.known) > CACHE_WORDS:  # the first words seen are mostly the frequent ones
            kept = _Words(self.tokenizer)
            kept.update(itertools.islice(self.known.items(), CACHE_WORDS // 2))
            self.known = kept
        if any(x in b"\n".join(texts).translate(_LOWER) for x in (*self.special, b"\xcc", b"\xcd")):
            return [self._one(text, text.translate(_LOWER)) for text in texts]
        get = self.known.__getitem__
        return [b"".join(map(get, text.translate(_LOWER).split(b" "))) for text in texts]

    def encode_long(self, text: bytes) -> bytes:
        """The same for one text in slices cut at white space."""
        out, at = [], 0
        while at < len(text):
            cut = _SPACE.search(text, at + _SLICE)
            end = cut.start() if cut else len(text)
            out += self.encode([text[at:end]])
            at = end
        return b"".join(out)


def tokenize(docs: DataFrame, tokenizer_path: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID, id_col: str = "doc_id") -> DataFrame:
    """Pieces of at most ``seq_len`` tokens: doc_id, piece, start, length, ids (binary, little-endian uint32).

    A null or empty text is the end id alone. Only documents longer than ``seq_len`` are cut; very long texts are
    encoded in slices. Repeated rows give repeated pieces, null ids are kept; other columns of ``docs``, of any name,
    are not looked at.
    """
    path, width = tokenizer_path or default_tokenizer(), 4 * seq_len
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _CODERS.get(path) or _CODERS.setdefault(path, _Encoder(path))
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
        for batch in by_bytes(batches):
            docs_, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            coded = [coder.encode_long(texts[0])] if len(texts) == 1 else coder.encode(texts)
            rows = [(doc, k, at // 4, len(part) // 4, part) for doc, ids in zip(docs_, coded, strict=True) for k, at in enumerate(range(0, len(ids) + 4, width)) for part in ((ids + end)[at : at + width],)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    source = texts_only(docs, id_col).withColumnRenamed(id_col, "doc_id")
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


GAP, DOCUMENT, PLACED, OPENED = range(4)
#: A class holds the sizes above 1/CLASS of its largest; range partitions of one superstep.
CLASS, PARTITIONS = 4, 8
_RUNS = "kind int, size long, first long, n long, sequence long, offset long, per long"


def _take(size: int, first: int, n: int, gap: tuple[int, int, int], seq_len: int, out: list) -> tuple[int, int, list[tuple[int, int, int]], tuple[int, int, int] | None]:
    """Documents first.. (n of ``size``) fill a run of gaps (free, sequence, how many), each with as many as it holds.

    Appends the placed runs to ``out``; returns what is left of the documents, the gaps that shrank, and those not used.
    """
    free, seq, m = gap
    per, shrunk = free // size, []
    full = min(m, n // per)
    for many, each in ((full, per), (1, n - full * per)) if full < m and n - full * per < per else ((full, per),):
        if many and each:
            out.append((PLACED, size, first, many * each, seq, seq_len - free, each))
            shrunk.append((free - each * size, seq, many))
            first, n, seq, m = first + many * each, n - many * each, seq + many, m - many
    return first, n, [g for g in shrunk if g[0]], (free, seq, m) if m else None


def sweep(runs: list[tuple], seq_len: int) -> list[tuple]:
    """One successor sweep over runs sorted by falling size, gaps before documents: the last gap passed is the smallest that
    holds a document. Gaps that took documents wait for the next sweep."""
    stack: list[tuple[int, int, int]] = []
    out: list[tuple] = []
    waiting: list[tuple[int, int, int]] = []
    for kind, size, first, n, *rest in runs:
        if kind == GAP:
            stack.append((size, first, n))
        elif kind == DOCUMENT:
            while n and stack:
                first, n, shrunk, unused = _take(size, first, n, stack.pop(), seq_len, out)
                waiting += shrunk
                if unused:
                    stack.append(unused)
            if n:
                out.append((DOCUMENT, size, first, n, 0, 0, 0))
        else:
            out.append((kind, size, first, n, *rest))
    return out + [(GAP, *g, 0, 0, 0) for g in stack + waiting]


def close(runs: list[tuple], seq_len: int) -> list[tuple]:
    """Best-fit of all documents in ``runs``, largest first: gaps that shrank are used again, and where none holds a size,
    sequences are opened. The numbers opened so far are in the OPENED run."""
    out = [r for r in runs if r[0] == PLACED]
    opened = sum(r[3] for r in runs if r[0] == OPENED)
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []

    def put(free: int, seq: int, n: int) -> None:
        if free not in gaps:
            bisect.insort(order, free)
            gaps[free] = []
        gaps[free].append((seq, n))

    for r in runs:
        if r[0] == GAP:
            put(*r[1:4])
    for _, size, first, n, *_ in sorted((r for r in runs if r[0] == DOCUMENT), key=lambda r: (-r[1], r[2])):
        while n:
            at = bisect.bisect_left(order, size)
            if at == len(order):
                fresh = -(-n // (seq_len // size))
                put(seq_len, opened, fresh)
                opened += fresh
                at = bisect.bisect_left(order, size)
            free = order[at]
            seq, m = gaps[free].pop()
            if not gaps[free]:
                del gaps[free], order[at]
            first, n, shrunk, unused = _take(size, first, n, (free, seq, m), seq_len, out)
            for g in [*shrunk, *([unused] if unused else [])]:
                put(*g)
    return [*out, (OPENED, 0, 0, opened, 0, 0, 0), *((GAP, f, seq, n, 0, 0, 0) for f, g in gaps.items() for seq, n in g)]


def _swept(runs: DataFrame, fn, seq_len: int) -> DataFrame:
    """``fn`` over the sorted runs of each partition."""

    def run(frames):
        rows = [r for pdf in frames for r in pdf.itertuples(index=False, name=None)]
        yield pd.DataFrame(fn(rows, seq_len), columns=[c.split()[0] for c in _RUNS.split(", ")])

    return runs.mapInPandas(run, _RUNS)


def supersteps(sizes: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """Placed runs (size, first, n, sequence, offset, per) for ``sizes`` (length, n): the document of rank first+i of that
    size goes to sequence + i div per, at offset + size * (i mod per)."""
    spark = sizes.sparkSession
    docs = stash(sizes.select(F.lit(DOCUMENT).alias("kind"), F.col("length").cast("long").alias("size"), F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n"), *[F.lit(0).cast("long").alias(c) for c in ("sequence", "offset", "per")]), "sizes")
    gaps, placed, top = spark.createDataFrame([], _RUNS), spark.createDataFrame([], _RUNS), seq_len
    largest = docs.agg(F.max("size")).first()[0] or 0
    while top:
        if top // CLASS < largest:
            runs = docs.filter(F.col("size").between(top // CLASS + 1, top)).union(gaps)
            ranged = runs.repartitionByRange(PARTITIONS, F.desc("size"), "kind").sortWithinPartitions(F.desc("size"), "kind", F.desc("n"), "first")
            swept = _swept(ranged, sweep, seq_len)
            # one row a run: at most a few for each size, whatever the number of documents
            state = stash(_swept(swept.repartition(1), close, seq_len), "gaps")
            gaps, placed = state.filter(F.col("kind").isin(GAP, OPENED)), placed.union(state.filter(F.col("kind") == PLACED))
        top //= CLASS
    return placed.select("size", "first", "n", "sequence", "offset", "per")


def place(pieces: DataFrame, seq_len: int = SEQ_LEN, row: str = "row") -> DataFrame:
    """``pieces`` (a stored table with ``length`` of 1..seq_len and a number of its own for each row) without the row number,
    plus sequence_id long and offset long.

    Ties and repeated rows are told apart by their row number. A size that many rows share is ranked in salted groups
    of about 500 rows or more, whose offsets come from their counts, so no task gets a whole hot size.
    """
    spark = pieces.sparkSession
    sizes = stash(pieces.groupBy("length").agg(F.count("*").alias("n")), "lengths")
    low, high, total = sizes.agg(F.min("length"), F.max("length"), F.sum("n")).first()
    if low is not None and not 1 <= low <= high <= seq_len:
        raise ValueError(f"piece lengths must be 1 to {seq_len}")
    runs = [tuple(r) for r in supersteps(sizes, seq_len).orderBy("size", "first").collect()]  # a few for each size
    target = max(500, (total or 0) // 1_000_000)
    salts = sizes.select("length", F.ceil(F.col("n") / F.lit(target)).alias("salts"))
    # at most seq_len rows: a proven bound
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64(row), F.col("salts"))).drop("salts")
    within = salted.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy(row)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.select("length", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = within.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("nth") - 1).select(*[c for c in pieces.columns if c != row], "rank")
    shared = spark.sparkContext.broadcast(np.array(runs or [(0, 0, 0, 0, 0, 1)], np.int64))
    names = ranked.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        starts = (t[:, 0] << 48) + t[:, 1]
        for b in batches:
            size = b.column(names.index("length")).to_numpy()
            rank = b.column(names.index("rank")).to_numpy()
            _, first, _, sequence, offset, per = t[np.searchsorted(starts, (size << 48) + rank, side="right") - 1].T
            cols = [b.column(i) for i, c in enumerate(names) if c != "rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence + (rank - first) // per), pa.array(offset + size * ((rank - first) % per))], names=[*(c for c in names if c != "rank"), "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank") + ", sequence_id long, offset long"
    return ranked.mapInArrow(assign, schema)


def pack(docs: DataFrame, tokenizer_path: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Pieces with their ids (or only ids_crc32), sequence_id and offset; empty tables give no rows.

    The ids are stored once and move with their rows to the ranks of their size, so repeated rows keep their own.
    With ``keep_ids=False`` the ids are digested as they are made and never move.
    """
    pieces = tokenize(docs, tokenizer_path, seq_len, end_id).withColumns({"ids_crc32": F.crc32("ids"), "row": F.monotonically_increasing_id()})
    stored = stash(pieces if keep_ids else pieces.drop("ids"), "pieces")
    return place(stored, seq_len)
