"""Languages of mixed text: script ranges, per-word scores and a Viterbi path over the words.

A word's score for a language is the sum of log probabilities of its byte n-grams. Scripts narrow
the candidates: a language that almost never used a word's script when it was learned pays a large
penalty on that word. Along the words of a text the best path pays ``SWITCH`` for every change of
language, so single odd words don't break a span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from temblor.llm.words import Words, mix, text_slices

UNDETERMINED = "und"
BUCKETS = 1 << 15
SAMPLE_ROWS = 4_000  # labelled documents per language that are read at most to learn
SWITCH = 12.0
_FOREIGN_SCRIPT = -8.0
_SCRIPT_SHARE = 0.01
# First code points of Unicode script blocks, and the script that begins there.
_BLOCKS = (
    (0x0000, "other"), (0x0041, "latin"), (0x005B, "other"), (0x0061, "latin"), (0x007B, "other"),
    (0x00C0, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)
SCRIPTS = tuple(dict.fromkeys(name for _, name in _BLOCKS))
_EDGES = np.array([first for first, _ in _BLOCKS])
_SCRIPT_OF = np.array([SCRIPTS.index(name) for _, name in _BLOCKS], np.int8)
_OTHER = SCRIPTS.index("other")


@dataclass
class Model:
    """Log probabilities by n-gram bucket, and which scripts each language uses."""

    languages: list[str]
    table: np.ndarray  # buckets x languages, float32
    allowed: np.ndarray  # scripts x languages, penalty


def _lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z and the capitals U+00C0 to U+00DE as small letters."""
    out = raw.copy()
    out[(raw >= 0x41) & (raw <= 0x5A)] += 32
    if len(raw) > 1:
        wide = np.zeros(len(raw), bool)
        wide[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
        out[wide] += 32
    return out


def _scripts(raw: np.ndarray) -> np.ndarray:
    """The script of each character, at its first byte; other bytes are ``other``."""
    out = np.full(len(raw), _OTHER, np.int8)
    ascii_ = raw < 0x80
    small = raw[ascii_] | 0x20
    out[ascii_] = np.where((small >= 0x61) & (small <= 0x7A), SCRIPTS.index("latin"), _OTHER)
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        b = np.pad(raw, (0, 3)).astype(np.int64)
        b0, b1, b2 = b[lead], b[lead + 1] & 63, b[lead + 2] & 63
        point = np.where(b0 < 0xE0, (b0 & 31) << 6 | b1, (b0 & 15) << 12 | b1 << 6 | b2)
        point = np.where(b0 >= 0xF0, 0x2000, point)
        out[lead] = _SCRIPT_OF[np.searchsorted(_EDGES, point, side="right") - 1]
    return out


def _grams(raw: np.ndarray) -> np.ndarray:
    """The buckets of the byte trigram and the byte 5-gram that end at each byte: 2 x bytes.

    White space is one value, so the edges of words are part of the n-grams.
    """
    b = raw.astype(np.uint64)
    b[(raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))] = 0x20
    # Digits and ASCII signs tell nothing about the language and are one value.
    sign = (raw > 0x20) & (raw < 0x61) | (raw > 0x7A) & (raw < 0x80)
    b[sign] = 0x21
    padded = np.concatenate([np.full(4, 0x20, np.uint64), b])
    n = len(b)
    three = padded[2 : n + 2] << np.uint64(16) | padded[3 : n + 3] << np.uint64(8) | padded[4:]
    five = padded[:n] << np.uint64(32) | padded[1 : n + 1] << np.uint64(24) | three
    out = np.empty((2, n), np.int64)
    half = np.uint64(BUCKETS // 2)
    out[0] = (mix(three) % half).astype(np.int64)
    out[1] = (mix(five) % half + half).astype(np.int64)
    return out


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from the rows with text and language; None if there are none.

    At most ``sample_rows`` rows of each language are read, those with the smallest hash of their id.
    The model has ``BUCKETS`` x languages numbers whatever the size of the table.
    """
    known = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.xxhash64(F.lit(5), F.col(id_col)).alias("h"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    # Hashes are uniform, so a threshold for each language keeps about the wanted number of rows.
    keep = F.lit(False)
    for lang in languages:
        share = min(1.0, sample_rows / sizes[lang])
        limit = int(share * 2**64 - 2**63) - (share == 1.0)
        keep = keep | ((F.col("lang") == lang) & (F.col("h") <= F.lit(min(limit, 2**63 - 1)).cast("bigint")))
    place = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS + len(SCRIPTS)), np.int64)
        for batch in batches:
            which = np.array([place[x] for x in batch.column("lang").to_pylist()])
            for row, raw, offsets in text_slices(batch.column("text"), 500_000):
                low = _lowered(raw)
                grams, scripts = _grams(low), _scripts(low)
                lang = np.repeat(which[row : row + len(offsets) - 1], np.diff(offsets))
                for i in np.unique(lang):
                    mine = lang == i
                    for g in grams:
                        counts[i, :BUCKETS] += np.bincount(g[mine], minlength=BUCKETS)
                    counts[i, BUCKETS:] += np.bincount(scripts[mine], minlength=len(SCRIPTS))
        i, j = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(counts[i, j])], names=["i", "j", "n"])

    rows = known.filter(keep).select("lang", "text").mapInArrow(count, "i int, j int, n bigint")
    total = np.zeros((len(languages), BUCKETS + len(SCRIPTS)))
    sums = rows.groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()  # buckets x languages at most
    total[np.asarray(sums["i"]), np.asarray(sums["j"])] = np.asarray(sums["n"])
    grams, scripts = total[:, :BUCKETS] + 0.5, total[:, BUCKETS:]
    half = BUCKETS // 2
    table = np.log(np.concatenate(
        [grams[:, :half] / grams[:, :half].sum(1, keepdims=True), grams[:, half:] / grams[:, half:].sum(1, keepdims=True)], 1)).T
    table -= table.mean(1, keepdims=True)  # only differences between languages count
    letters = np.delete(scripts, _OTHER, 1).sum(1, keepdims=True)
    allowed = np.where(scripts >= _SCRIPT_SHARE * np.maximum(letters, 1), 0.0, _FOREIGN_SCRIPT).T
    allowed[_OTHER] = 0.0
    return Model(languages, np.ascontiguousarray(table, np.float32), allowed.astype(np.float32))


def _paths(scores: np.ndarray, count: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The language of each word on the best path of each text; all texts advance together."""
    order = np.argsort(-count, kind="stable")
    lengths, begin = count[order], first[:-1][order]
    active = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1 if len(lengths) else 1), side="right")
    total = int(count.sum())
    came = np.empty(total, np.int8)  # the best language before each word
    stay = np.empty((total, scores.shape[1]), bool)
    best = np.zeros((len(order), scores.shape[1]), np.float32)
    for t in range(int(lengths[0]) if len(lengths) else 0):
        n = active[t]
        at = begin[:n] + t
        now = best[:n]
        top = now.argmax(1)
        switched = now[np.arange(n), top] - SWITCH
        kept = now >= switched[:, None]
        came[at], stay[at] = top, kept
        best[:n] = np.where(kept, now, switched[:, None]) + scores[at]
    out = np.empty(total, np.int8)
    state = best.argmax(1).astype(np.int8)
    for t in reversed(range(int(lengths[0]) if len(lengths) else 0)):
        n = active[t]
        at = begin[:n] + t
        out[at] = state[:n]
        state[:n] = np.where(stay[at, state[:n]], state[:n], came[at])
    return out


def _label(raw: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, language of each word, letters of each word) for a slice of texts."""
    low = _lowered(raw)
    words = Words(low, offsets, lower=False)
    if not len(words.starts):
        return words, np.zeros(0, np.int8), np.zeros(0)
    grams, scripts = _grams(low), _scripts(low)
    value = model.table[grams[0]]
    value += model.table[grams[1]]
    letter = scripts != _OTHER
    scores = np.add.reduceat(value, words.starts)
    letters = np.add.reduceat(letter.astype(np.int32), words.starts)
    # A word's script is that of its last letter; words without letters have no say.
    ends = np.maximum.reduceat(np.where(letter, scripts, -1).astype(np.int8), words.starts)
    scores += model.allowed[ends] * (ends >= 0)[:, None]
    scores[letters == 0] = 0
    return words, _paths(scores, words.count, words.first), letters


def _has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred, score and spans of each row: an array of (start, end, lang).

    ``lang_pred`` has most letters on the path, and ``score`` is its share of them; ``und`` with score
    0 if the text is null or has no letter, or nothing could be learned. Spans are byte ranges of the
    UTF-8 text. Only the text is looked at. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            done = 0
            for _, raw, offsets in text_slices(batch.column("text")):
                n = len(offsets) - 1
                names, shares, spans = [UNDETERMINED] * n, np.zeros(n), [[] for _ in range(n)]
                if model is not None:
                    words, path, letters = _label(raw, offsets, model)
                    k = len(model.languages)
                    weight = np.bincount(words.row * k + path, letters, n * k).reshape(n, k) if len(path) else np.zeros((n, k))
                    total, top = weight.sum(1), weight.argmax(1)
                    opens = np.ones(len(path), bool)
                    opens[1:] = (path[1:] != path[:-1]) | (words.row[1:] != words.row[:-1])
                    at = np.flatnonzero(opens)
                    last = np.append(at[1:], len(path)) - 1
                    for i, j in zip(at, last):
                        row = int(words.row[i])
                        spans[row].append((int(words.starts[i] - offsets[row]), int(words.ends[j] - offsets[row]), model.languages[path[i]]))
                    for i in range(n):
                        if total[i]:
                            names[i], shares[i] = model.languages[top[i]], weight[i, top[i]] / total[i]
                        elif _has_letter(raw[offsets[i] : offsets[i + 1]].tobytes()):
                            # Letters of no listed script: the path still says which language is least unlike.
                            names[i] = model.languages[int(np.bincount(path[words.row == i]).argmax())]
                        else:
                            spans[i] = []
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(done, n), pa.array(names, pa.string()), pa.array(shares),
                     pa.array([[dict(zip(("start", "end", "lang"), s)) for s in one] for one in spans],
                              pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))],
                    names=["id", "lang_pred", "score", "spans"])
                done += n

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        label, f"id {kind}, lang_pred string, score double, spans array<struct<start: bigint, end: bigint, lang: string>>"
    ).withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """A quarter of the ids, never learned from. A null id is not held out, nor learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, spans): learned from the rows that are not held out."""
    model = learn(docs.filter(~held_out(id_col) & F.col(id_col).isNotNull()), id_col, text_col, lang_col)
    found = predict(docs, model, id_col, text_col)
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "spans")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    least_share: float = 0.5) -> DataFrame:
    """``docs`` without texts that have no language: no letter, or no language with ``least_share``
    of the letters. Columns stay as they are, no shuffle."""
    model = learn(docs.filter(~held_out(id_col) & F.col(id_col).isNotNull()), id_col, text_col, lang_col)
    if model is None:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.languages)
        for batch in batches:
            keep = []
            for _, raw, offsets in text_slices(batch.column(text_col)):
                n = len(offsets) - 1
                words, path, letters = _label(raw, offsets, model)
                weight = np.bincount(words.row * k + path, letters, n * k).reshape(n, k) if len(path) else np.zeros((n, k))
                total = weight.sum(1)
                for i in range(n):
                    keep.append(bool(weight[i].max() >= least_share * total[i]) if total[i]
                                else _has_letter(raw[offsets[i] : offsets[i + 1]].tobytes()))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(sift, docs.schema)
