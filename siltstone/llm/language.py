"""Language identification by multinomial naive Bayes over hashed character n-grams.

A text is read as lower-case letters with one blank for every run of other characters;
its n-grams of 1 to SIZES characters (never of blanks alone) fall in BUCKETS groups by
hash. Learning is a sum: tasks count the groups for each language, the counts meet by
(language, group), and the matrix of log-probabilities, whose size is at most LANGUAGES x
BUCKETS numbers, is broadcast. Scoring multiplies the sparse counts of each text with it
in numpy. N-grams of SIZES lengths tell each character SIZES times, so the evidence is
divided by SIZES before it meets the prior.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from siltstone.llm.rows import ROW, append, with_row

#: Lengths of n-grams, groups they fall in, count that every group has from the start.
SIZES, BUCKETS, SMOOTHING = 4, 1 << 15, 0.5
#: Languages that one model holds at most: its matrix is then at most 32 MB.
LANGUAGES = 256
#: Prediction for texts without a letter.
UNDETERMINED = "und"
#: Remainder of crc32(doc_id) modulo 3 of the documents that are never learnt from.
HELD_OUT = 1
#: Characters that one vectorised pass takes; longer texts go in pieces.
PIECE = 1 << 20
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@cache
def _alphabet() -> np.ndarray:
    """For each code point: its lower case if it is a letter, itself if it is a mark, else 0."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 else code
        elif c > "˿" and unicodedata.category(c)[0] == "M":
            out[code] = code
    return out


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(code).isalpha() for code in range(0x110000)), bool, 0x110000)


def _pieces(texts: list[str]) -> Iterator[list[tuple[int, str, bool, bool]]]:
    """Runs of (row, part of its text, is it the first part, is it the last) of PIECE characters at most.

    A part that is not its text's last ends its run.
    """
    held, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(len(text), 1), PIECE):
            part = text[at : at + PIECE]
            if held and size + len(part) > PIECE:
                yield held
                held, size = [], 0
            held.append((row, part, at == 0, at + PIECE >= len(text)))
            size += len(part)
    if held:
        yield held


def ngram_counts(texts: list[str]) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(row, counts of its BUCKETS groups, has it a letter), once for each text, in their order."""
    counts, lettered, tail = np.zeros(BUCKETS, np.int64), False, _BLANK
    for parts in _pieces(texts):
        raw = np.frombuffer("".join(p for _, p, _, _ in parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        code = _alphabet()[raw]
        begins = np.concatenate(([0], np.cumsum([len(p) for _, p, _, _ in parts])))
        letters = np.concatenate(([0], np.cumsum(_letters()[raw])))
        # a text is framed by blanks: two in a row stand between texts only
        heads = [_BLANK if first else tail for _, _, first, _ in parts]
        framed = [(h, code[a:b], _BLANK if part[3] else code[:0]) for h, a, b, part in zip(heads, begins[:-1], begins[1:], parts, strict=True)]
        stops = np.cumsum([sum(map(len, x)) for x in framed])
        starts = np.concatenate(([0], stops[:-1]))
        whole = np.concatenate([y for x in framed for y in x])
        keep = np.ones(len(whole), bool)
        keep[1:] = (whole[1:] != 0) | (whole[:-1] != 0)
        keep[starts] = True
        place = np.concatenate(([0], np.cumsum(keep)))
        seq = whole[keep].astype(np.uint64)
        grams = _groups(seq)
        for i, (row, _, first, last) in enumerate(parts):
            a, b = place[starts[i]], place[stops[i]]
            old = 0 if first else len(tail)
            new = [g[max(a, a + old - n) : max(a, b - n)] for n, g in enumerate(grams)]  # n-grams that end in what is new
            own = np.bincount(np.concatenate(new), minlength=BUCKETS + 1)[:BUCKETS]
            counts = own if first else counts + own
            lettered = bool(letters[begins[i + 1]] > letters[begins[i]]) or not first and lettered
            if last:
                yield row, counts, lettered
            else:
                tail = seq[max(a, b - SIZES + 1) : b].astype(np.uint32)


_BLANK = np.zeros(1, np.uint32)


def _groups(seq: np.ndarray) -> list[np.ndarray]:
    """For each length, the group of the n-gram at each place; BUCKETS where two blanks meet in it."""
    out, n = [], len(seq)
    total = np.zeros(n, np.uint64)
    bad = seq == 0
    for size in range(1, SIZES + 1):
        m = n - size + 1
        if m <= 0:
            out.append(np.zeros(0, np.int64))
            continue
        total = total[:m] * _STEP + seq[size - 1 :] + np.uint64(size)
        if size == 2:
            bad = (seq[:-1] == 0) & (seq[1:] == 0)
        elif size > 2:
            bad = bad[:m] | ((seq[size - 2 : -1] == 0) & (seq[size - 1 :] == 0))
        mixed = (total ^ (total >> np.uint64(29))) * _SPREAD
        group = (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
        group[bad[:m]] = BUCKETS
        out.append(group)
    return out


@dataclass
class NaiveBayes:
    """Languages in the order of their names, their log priors, and log-probabilities by group (row) and language."""

    languages: list[str]
    prior: np.ndarray
    table: np.ndarray

    @classmethod
    def fit(cls, languages: list[str], documents: np.ndarray, counts: np.ndarray) -> NaiveBayes:
        """``counts``: a row of BUCKETS for each language; ``documents``: how many it has."""
        share = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
        return cls(languages, np.log(documents / max(documents.sum(), 1)), np.ascontiguousarray(np.log(share).T.astype(np.float32)))

    def predict(self, counts: np.ndarray) -> tuple[int, float]:
        """The likeliest language (ties: the first name) and its probability."""
        some = np.flatnonzero(counts)
        z = self.prior + counts[some].astype(np.float64) @ self.table[some].astype(np.float64) / SIZES
        best = int(np.argmax(z))
        return best, float(1 / np.exp(z - z[best]).sum())


def _strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; nulls are empty, bytes that are no UTF-8 are no letters."""
    raw = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    return [x.as_buffer().to_pybytes().decode("utf-8", "replace") if x.is_valid else "" for x in raw]


def held_out(doc_id: Column) -> Column:
    """Is the document kept from learning? A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == HELD_OUT, F.lit(False))


def learn_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> NaiveBayes | None:
    """A model of all rows of ``docs`` with a language; None if no row has one.

    Null and empty texts count for the prior only. More than LANGUAGES languages are an error:
    the matrix would outgrow what is broadcast.
    """
    rows = docs.select(docs[f"`{lang_col}`"].cast("string").alias("lang"), docs[f"`{text_col}`"].alias("text")).where("lang is not null")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(LANGUAGES + 1).collect()
    if not sizes:
        return None
    if len(sizes) > LANGUAGES:
        raise ValueError(f"a model holds {LANGUAGES} languages at most")
    names = sorted(r.lang for r in sizes)
    at = {name: i for i, name in enumerate(names)}

    def count(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for row, counts, _ in ngram_counts(_strings(batch.column("text"))):
                own = at[langs[row]]
                if own in total:
                    total[own] += counts
                else:
                    total[own] = counts
        for own, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), own, np.int32)), pa.array(some.astype(np.int32)), pa.array(counts[some])], ["lang", "bucket", "n"])

    cells = rows.mapInArrow(count, "lang int, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(names), BUCKETS))
    counts[cells.column("lang").to_numpy(), cells.column("bucket").to_numpy()] = cells.column("n").to_numpy()
    documents = {r.lang: r.n for r in sizes}
    return NaiveBayes.fit(names, np.array([documents[x] for x in names], dtype=np.float64), counts)


def identify_languages(docs: DataFrame, model: NaiveBayes | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of the kept columns, all by default), ``lang_pred`` and ``score`` of every row.

    The score is the posterior probability of the prediction. Null texts, texts without a letter,
    and all texts if there is no model, are ``und`` with score 0. Texts are read whole, in pieces
    of bounded size; rows that repeat are predicted one by one and alike; an empty table gives no
    rows; the caller's columns lie inside ``row`` and may have any names.
    """
    given = with_row(docs, {"text": text_col}, keep)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batch):
        nb = held.value
        texts = _strings(batch.column("text"))
        names, scores = [], np.zeros(len(texts))
        for row, counts, lettered in ngram_counts(texts):
            if nb is None or not lettered:
                names.append(UNDETERMINED)
            else:
                best, scores[row] = nb.predict(counts)
                names.append(nb.languages[best])
        if texts:
            yield 0, len(texts), {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)}

    return append(given, predict, [StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Learnt from the rows with a language whose doc_id is not held out (a null doc_id is not);
    see ``identify_languages`` for the cases. Neither lang nor source nor doc_id is an input of a
    prediction.
    """
    known = docs.select("doc_id", "text", "lang")
    model = learn_languages(known.where(~held_out(F.col("doc_id"))))
    found = identify_languages(known, model, keep=["doc_id"])
    return found.select(F.col(f"{ROW}.doc_id").alias("doc_id"), held_out(F.col(f"{ROW}.doc_id")).alias("held_out"), "lang_pred", "score")
