"""Language identification of mixed-language text.

Script ranges narrow the candidate languages of a word; hashed byte trigrams
score the word in each of them; Viterbi with a penalty for switching labels the
words of a text, so that spans in another language are found, and the language
with the most letters names the text. The model is one number for each trigram
bucket and language, from counts that Spark sums over all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LOWER, fresh, pieces, releasing, utf8, words

BUCKETS = 1 << 15
#: A language is a candidate for a script if at least this share of its words has it.
SCRIPT_SHARE = 0.005
#: What a switch of language between two words costs, in nats.
SWITCH = 12.0
#: The model's size is BUCKETS times the number of languages; more languages than this are refused.
MAX_LANGUAGES = 512
_GROUP_WORDS = 1_500_000
_BAR = -1e4

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
#: Script class by UTF-8 lead byte: Latin with ASCII, then ranges of the lead bytes that open other scripts.
_SCRIPT = np.zeros(256, np.int8)
for _lo, _hi, _class in ((0xCD, 0xCF, 1), (0xD0, 0xD3, 2), (0xD4, 0xD5, 3), (0xD6, 0xD7, 4), (0xD8, 0xDB, 5), (0xDC, 0xDF, 6), (0xE0, 0xE0, 7), (0xE1, 0xE1, 8), (0xE3, 0xE3, 9), (0xE4, 0xE9, 10), (0xEA, 0xED, 11), (0xEE, 0xEF, 12), (0xF0, 0xF7, 13)):
    _SCRIPT[_lo : _hi + 1] = _class
SCRIPTS = 14


def held_out(doc_id: Column) -> Column:
    """Whether a row is held out of learning; one without id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _featured(buf: np.ndarray, off: np.ndarray):
    """Word starts, ends, first words by row, the trigram bucket of every byte and the script of every word."""
    low = LOWER[buf]
    starts, ends, first = words(low, off, _LETTER)
    if not len(starts):
        return starts, ends, first, None, None
    low = np.where(_LETTER[low], low, np.uint8(0x20))
    wide = np.full(len(low) + 2, 0x20, np.uint32)
    wide[1:-1] = low
    wide[1:][off[1:-1]] = 0x20
    wide[1:-1] = low
    gram = wide[:-2] * np.uint32(0x01000193) ^ wide[1:-1] * np.uint32(0x9E3779B1) ^ wide[2:] * np.uint32(0x85EBCA77)
    bucket = (gram * np.uint32(0xC2B2AE35)) >> np.uint32(17)
    script = np.maximum.reduceat(_SCRIPT[low], starts)
    return starts, ends, first, bucket, script


def language_counts(docs: DataFrame, languages: list[str]) -> DataFrame:
    """(language, bucket, n) summed over the labelled rows (lang, text): trigram buckets, and scripts of words as -1 - script."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(languages)}
        grams = np.zeros((len(languages), BUCKETS), np.int64)
        scripts = np.zeros((len(languages), SCRIPTS), np.int64)
        for batch in batches:
            label = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for lo, hi, buf, off in pieces(batch.column(1)):
                starts, ends, first, bucket, script = _featured(buf, off)
                if not len(starts):
                    continue
                of_word = np.repeat(label[lo:hi], np.diff(first))
                inside = np.zeros(len(buf) + 1, np.int64)
                inside[starts] += 1
                inside[ends] -= 1
                at = np.flatnonzero(np.cumsum(inside[:-1]))
                of_byte = np.repeat(of_word, ends - starts)
                grams += np.bincount(of_byte * BUCKETS + bucket[at], minlength=grams.size).reshape(grams.shape)
                scripts += np.bincount(of_word * SCRIPTS + script, minlength=scripts.size).reshape(scripts.shape)
        i, j = np.nonzero(grams)
        k, m = np.nonzero(scripts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[i, k].astype(np.int32)), pa.array(np.r_[j, -1 - m].astype(np.int32)), pa.array(np.r_[grams[i, j], scripts[k, m]])], ["language", "bucket", "n"])

    return docs.mapInArrow(releasing(run), "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, languages: list[str], grams: np.ndarray, scripts: np.ndarray):
        score = np.log((grams + 0.5) / (grams + 0.5).sum(axis=1, keepdims=True))
        self.languages = languages
        # What the languages have in common on a bucket, in nats above the background (all buckets alike).
        common = score.mean(axis=0) if languages else np.zeros(BUCKETS)
        self.common = (common + np.log(BUCKETS)).astype(np.float32)
        self.score = np.ascontiguousarray((score - common).T.astype(np.float32))  # bucket, language
        seen = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        allowed = (seen >= SCRIPT_SHARE).T
        allowed[~allowed.any(axis=1)] = True  # no language has the script: all stay candidates
        self.barred = np.where(allowed, 0, _BAR).astype(np.float32)  # script, language
        self.known = (seen >= SCRIPT_SHARE).T  # script, language

    def word_scores(self, buf: np.ndarray, off: np.ndarray):
        """Of each word: scores by language, letters, what the languages have in common, script; and each row's first word."""
        starts, ends, first, bucket, script = _featured(buf, off)
        if not len(starts):
            return np.zeros((0, len(self.languages)), np.float32), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int8), first
        flat = self.score[bucket]
        edges = np.empty(2 * len(starts), np.int64)
        edges[0::2], edges[1::2] = starts, ends
        if edges[-1] == len(flat):
            edges = edges[:-1]
        common = np.add.reduceat(self.common[bucket], edges)[::2]
        return np.add.reduceat(flat, edges, axis=0)[::2] + self.barred[script], ends - starts, common, script, first

    def paths(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best label of each word; all rows advance together, the longest first."""
        count = np.diff(first)
        order = np.argsort(-count, kind="stable")
        begin, count = first[:-1][order], count[order]
        label = np.zeros(len(scores), np.uint8 if len(self.languages) <= 256 else np.uint16)
        longest = int(count[0]) if len(count) else 0
        if not longest:
            return label
        on = np.searchsorted(-count, -np.arange(longest), "left")  # rows with more than t words
        back = np.zeros(scores.shape, label.dtype)
        own = np.arange(scores.shape[1], dtype=label.dtype)
        best = scores[begin[: on[0]]].copy()
        for t in range(1, longest):
            n = on[t]
            now = best[:n]
            top = now.argmax(axis=1)
            change = now[np.arange(n), top][:, None] - np.float32(SWITCH)
            stay = now >= change
            at = begin[:n] + t
            back[at] = np.where(stay, own, top[:, None].astype(label.dtype))
            best[:n] = np.where(stay, now, change) + scores[at]
        state = best.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            n = on[t]
            at = begin[:n] + t
            label[at] = state[:n]
            if t:
                state[:n] = back[at, state[:n]]
        return label


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model from all rows with a language; the driver gets counts only, BUCKETS + SCRIPTS a language at most."""
    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    grams, scripts = np.zeros((len(languages), BUCKETS), np.int64), np.zeros((len(languages), SCRIPTS), np.int64)
    if languages:
        got = language_counts(rows, languages).toArrow()
        i, j, n = (got.column(k).to_numpy() for k in range(3))
        grams[i[j >= 0], j[j >= 0]] = n[j >= 0]
        scripts[i[j < 0], -1 - j[j < 0]] = n[j < 0]
    return Model(languages, grams, scripts)


def _predict(model: Model, texts) -> tuple[list, np.ndarray, list, np.ndarray]:
    """Language, score, labelled spans [(first word, words, language)], and (fit, script share) of each text."""
    n = len(texts)
    names, share, spans, measures = [None] * n, np.zeros(n), [[] for _ in range(n)], np.zeros((n, 2))
    buf, off = utf8(texts)
    group: list[tuple] = []

    def settle() -> None:
        if not group:
            return
        lo = group[0][0]
        scores = np.concatenate([g[2] for g in group])
        weight = np.concatenate([g[3] for g in group])
        common, script = (np.concatenate([g[k] for g in group]) for k in (4, 5))
        count = np.concatenate([np.diff(g[6]) for g in group])
        first = np.r_[0, np.cumsum(count)]
        label = model.paths(scores, first)
        row = np.repeat(np.arange(len(count)), count)
        langs = len(model.languages)
        letters = np.bincount(row * langs + label, weight, len(count) * langs).reshape(-1, langs)
        top, total = letters.argmax(axis=1), letters.sum(axis=1)
        fit = scores[np.arange(len(label)), label] - model.barred[script, label] + common
        known = model.known[script, top[row]] * weight
        sums = np.stack([np.bincount(row, fit, len(count)), np.bincount(row, known, len(count))], axis=1)
        edge = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (row[1:] != row[:-1])]) if len(label) else np.zeros(0, np.int64)
        for e, size in zip(edge.tolist(), np.diff(np.r_[edge, len(label)]).tolist()):
            spans[lo + row[e]].append({"first": int(e - first[row[e]]), "n": size, "lang": model.languages[label[e]]})
        for k in np.flatnonzero(total).tolist():
            text = buf[off[lo + k] : off[lo + k + 1]]
            if _ASCII_LETTER[text].any() or any(c.isalpha() for c in text.tobytes().decode()):
                names[lo + k], share[lo + k] = model.languages[top[k]], letters[k, top[k]] / total[k]
                measures[lo + k] = sums[k] / total[k]
        group.clear()

    if model.languages:
        held = 0
        for lo, hi, part, ends in pieces(texts, 1 << 19):
            group.append((lo, hi, *model.word_scores(part, ends)))
            held += len(group[-1][2])
            if held > _GROUP_WORDS:
                settle()
                held = 0
        settle()
    return names, share, spans, measures


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = True
_ASCII_LETTER[0x61:0x7B] = True


def labelled(docs: DataFrame, model: Model, text_col: str = "text", with_spans: bool = True, with_fit: bool = False) -> DataFrame:
    """docs with lang_pred (`und` if the text is null or has no letter, or nothing was learned), score (the predicted
    language's share of the letters, 0 for `und`) and lang_spans (runs of words of one language). Columns of docs
    that bear these names are replaced; rows come out as they went in, however often they repeat. Of languages that
    tie the first by name is taken; a very long text is labelled whole, in one task.

    The score compares the learned languages with each other. with_fit adds what compares the text with the language:
    `fit` (mean log-likelihood of a letter's trigram in the language chosen for its word, in nats above a background
    in which all trigrams are alike) and `script_share` (share of the letters in scripts that lang_pred was seen
    with); both are 0 for `und`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c not in ("lang_pred", "score", "lang_spans", *["fit", "script_share"] * with_fit)]
    span = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, share, spans, measures = _predict(shared.value, batch.column(len(columns)))
            extra = [pa.array([x or "und" for x in names], pa.string()), pa.array(share, pa.float64())]
            if with_spans:
                extra.append(pa.array(spans, span))
            if with_fit:
                extra += [pa.array(measures[:, 0]), pa.array(measures[:, 1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], [str(i) for i in range(len(columns) + len(extra))])

    kept = docs.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", lang_pred string, score double" + ", lang_spans array<struct<first:long,n:long,lang:string>>" * with_spans + ", fit double, script_share double" * with_fit
    return docs.select(*columns, F.col(text_col).cast("string").alias(fresh("__text", columns))).mapInArrow(releasing(run), schema)


def fit_bounds(rows: DataFrame) -> DataFrame:
    """(lang_pred, min_fit, min_script_share): half of what all but 1 % of the rows (lang_pred, fit, script_share) reach.

    The rows are labelled ones that were predicted as labelled. Half way to the background leaves room for clean texts
    that are shorter or plainer than those; random letters and languages that are not akin to a learned one stay below.
    """
    low = lambda c: F.greatest(F.percentile_approx(c, 0.01, 10_000), F.lit(0.0)) / 2
    return rows.groupBy("lang_pred").agg(low("fit").alias("min_fit"), low("script_share").alias("min_script_share"))
