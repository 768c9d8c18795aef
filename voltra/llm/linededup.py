"""Substring dedup by hashing lines, cut into pieces at places their words choose.

The units are the lines of a text and, where a line is long enough, pieces of it: a piece begins before each word whose
hash is smaller than those of PIECE_RADIUS words on both sides. Such cuts follow the words alone, whatever the stops, so
a passage is cut alike wherever it stands, equal lines have equal pieces, and units tile the text. They are normalised
(lower-cased words, everything between words ignored) and digested to 128 bits; digests are grouped globally and the
occurrence of the smallest doc_id (there, the first in the text) stays. Of the others, neighbouring ones are joined, and
a run of at least MIN_WORDS words is cut: shorter ones are phrases and notices that unrelated texts share. Offsets of
what was cut refer to the original text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _textvec as tv
from ._shared import by_bytes, stash, string_bytes, unused

#: Least words of a run of repeated units that is cut.
MIN_WORDS = 20
PIECE_RADIUS = 4


def _cuts(h: np.ndarray, line: np.ndarray, radius: int = PIECE_RADIUS) -> np.ndarray:
    """Words that start a piece: local minima of ``h`` at least ``radius`` words inside a line."""
    if len(h) <= 2 * radius:
        return np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(h, radius).min(axis=1)
    at = np.arange(radius, len(h) - radius)
    inside = (line[at - radius] == line[at]) & (line[at + radius] == line[at])
    return at[inside & (h[at] < least[at - radius]) & (h[at] < least[at + 1])]


class Units:
    """Units of a batch in order: row, first word in its row, words, digest (two words), and whether an earlier unit of the
    row has the same digest."""

    def __init__(self, raw, off):
        h, s, _, row = tv.words(raw, off)
        marks = np.unique(np.concatenate([off[:-1], np.flatnonzero(raw == 10) + 1]))
        marks = np.union1d(marks, s[_cuts(h, np.searchsorted(marks, s, side="right") - 1)])
        of = np.searchsorted(marks, s, side="right") - 1
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
        n = np.diff(np.append(first, len(of)))
        self.row, self.n = row[first], n
        self.word = first - tv.row_bounds(row, len(off) - 1)[self.row] if len(first) else first
        if not len(first):
            self.d1 = self.d2 = np.zeros(0, np.uint64)
            self.again = np.zeros(0, bool)
            return
        place = np.arange(len(of)) - np.repeat(first, n)
        up, _ = tv._powers(int(n.max()) + 2)
        self.d1 = tv.mix(np.add.reduceat(h * up[place + 1], first) + n.astype(np.uint64))
        self.d2 = tv.mix(np.add.reduceat((h ^ (h >> np.uint64(17))) * up[place], first))
        order = np.lexsort((self.d2, self.d1, self.row))  # stable: the first of equal ones comes first
        same = np.ones(len(order) - 1, bool)
        for x in (self.row, self.d1, self.d2):
            same &= x[order][1:] == x[order][:-1]
        self.again = np.zeros(len(order), bool)
        self.again[order[1:]] = same


def unit_table(docs: DataFrame) -> DataFrame:
    """d1, d2, doc_id, th (digest of the text), words (first word, words and again, packed) of every unit of every row."""

    def run(batches):
        for b in by_bytes(batches):
            raw, off = string_bytes(b.column(2))
            u = Units(raw, off)
            take = pa.array(u.row)
            words = (u.word << 32) | (u.n << 1) | u.again
            yield pa.RecordBatch.from_arrays([pa.array(u.d1.view(np.int64)), pa.array(u.d2.view(np.int64)), b.column(0).take(take), b.column(1).take(take), pa.array(words)], names=schema.names)

    source = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([*T._parse_datatype_string("d1 long, d2 long").fields, docs.schema["doc_id"], *T._parse_datatype_string("th long, words long").fields])
    return source.mapInArrow(run, schema)


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, th, cut (the packed words): the units of each row that an earlier document, or the row before, holds.

    Texts are hashed once, into a stored table. Counting is combined before its shuffle; the join that follows it has
    plain exchanges on both sides, so a digest that a third of all documents hold is split over tasks.
    """
    units = stash(unit_table(docs), "units")
    keepers = units.groupBy("d1", "d2").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = units.join(keepers.hint("merge"), ["d1", "d2"]).filter("doc_id > keeper or (doc_id is null and keeper is not null) or words % 2 = 1")
    return later.groupBy("doc_id", "th").agg(F.collect_set("words").alias("cut"))


def _spans(units: np.ndarray, own: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Byte ranges in a text of the runs of neighbouring units of at least ``least`` words: from the word (or the line it
    begins) to the next unit (or the end of the line). A run of whole lines takes its newline."""
    units = np.sort(units)
    first, n = units >> 32, (units & 0xFFFFFFFF) >> 1
    new = np.append(True, first[1:] != first[:-1] + n[:-1])
    at = np.flatnonzero(new)[np.add.reduceat(n, np.flatnonzero(new)) >= least]
    if not len(at):
        return []
    last = np.flatnonzero(np.append(new[1:], True))
    last = last[np.searchsorted(last, at)]
    _, starts, _, _ = tv.words(own, np.array([0, len(own)]))
    lines = np.append(0, np.flatnonzero(own == 10) + 1)
    line = np.searchsorted(lines, starts, side="right") - 1
    out = []
    for a, z in zip(first[at].tolist(), (first[last] + n[last]).tolist(), strict=True):
        opens = a == 0 or line[a] != line[a - 1]
        closes = z == len(starts) or line[z] != line[z - 1]
        stop = int(lines[line[z - 1] + 1]) if line[z - 1] + 1 < len(lines) else len(own) + 1
        out.append((int(lines[line[a]] if opens else starts[a]), min(len(own), stop if opens else stop - 1) if closes else int(starts[z])))
    return out


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated runs cut from ``text``, plus cut_spans array<struct<start,end>> (characters of the original).

    A null text stays null and an empty one empty; very long texts are cut like others. Rows with one doc_id rank alike
    (so do null ids, which come last): a unit that several of them hold stays in all of them. Repeats inside one text
    keep their first occurrence. All other columns, of any name, are as they came; cut_spans must not be one of them. An
    empty table gives no rows.
    """
    names = docs.columns
    cut, cut_id, cut_th, th, text_ = unused(docs, "cut", "cut_id", "cut_th", "th", "text_")
    cuts = repeated(docs).select(F.col("doc_id").alias(cut_id), F.col("th").alias(cut_th), F.col("cut").alias(cut))
    hashed = docs.withColumn(th, F.xxhash64("text"))
    joined = hashed.join(cuts.hint("merge"), (F.col(th) == F.col(cut_th)) & hashed["doc_id"].eqNullSafe(F.col(cut_id)), "left").select(*[hashed[f"`{c}`"] for c in names], F.coalesce(hashed["text"], F.lit("")).alias(text_), cut)
    at = names.index("text")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in by_bytes(batches, text_):
            raw, off = string_bytes(b.column(len(names)))
            found = b.column(len(names) + 1)
            spans: list[list] = [[] for _ in range(b.num_rows)]
            texts: dict[int, str] = {}
            for r in np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)).tolist():
                own = raw[off[r] : off[r + 1]]
                ranges = _spans(found[r].values.to_numpy(), own, min_words)
                if not ranges:
                    continue
                chars = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                kept, done = [], 0
                for s, e in ranges:
                    kept.append(own[done:s].tobytes())
                    spans[r].append({"start": int(chars[s]), "end": int(chars[e])})
                    done = e
                kept.append(own[done:].tobytes())
                texts[r] = b"".join(kept).decode()
            text = b.column(at)
            if texts:
                text = pa.array([texts.get(i, x) for i, x in enumerate(text.to_pylist())], text.type)
            yield pa.RecordBatch.from_arrays([*(text if i == at else b.column(i) for i in range(len(names))), pa.array(spans, span)], names=[*names, "cut_spans"])

    schema = T.StructType([*docs.schema.fields, T.StructField("cut_spans", T._parse_datatype_string("array<struct<start:int,end:int>>"))])
    return joined.mapInArrow(run, schema)


def clean(docs: DataFrame, **options) -> DataFrame:
    """``docs`` after ``dedup``, in its own columns; n_chars (if there) counts the text that stays."""
    out = dedup(docs, **options)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("cut_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])
