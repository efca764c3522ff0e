"""Language identification of mixed-language text.

A token's letters are scored by naive Bayes over hashed character n-grams and whole words, learned from labelled
documents. Script ranges narrow the candidates: a language that training never saw in a token's script is out for it,
as long as some language was. Viterbi over a document's tokens, with a penalty for switching, labels spans; the
document's language is the one whose spans hold most letters. The model has a fixed number of hash buckets, so what is
broadcast grows with the number of languages only.

Defined results: null texts and texts without a letter are ``und`` with score 0 and no spans; without any training row
every text is ``und``; rows that repeat an id are labelled each; an empty table gives no rows; columns besides
``doc_id``, ``text`` and ``lang`` (training only) are not read, and null languages are not learned from.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import release_memory

BUCKETS = 1 << 15
MAX_LANGUAGES = 256
CACHED_TOKENS = 250_000
HASHED_AT_ONCE = 20_000
WORDS_AT_ONCE = 1_000_000
UNKNOWN = "und"

# First code points of script ranges (Unicode blocks) and the script that each begins.
SCRIPT_STARTS = (0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0900, 0x0980, 0x0A00, 0x0E00, 0x0E80, 0x10A0, 0x1100,
                 0x1200, 0x1E00, 0x1F00, 0x2000, 0x2E80, 0x3040, 0x3100, 0x3130, 0x3190, 0xA960, 0xAC00, 0xD800, 0xF900, 0xFB1D, 0xFB50)
SCRIPT_NAMES = ("Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Devanagari", "Bengali", "Indic", "Thai", "Lao",
                "Georgian", "Hangul", "Other", "Latin", "Greek", "Other", "Han", "Kana", "Han", "Hangul", "Han", "Hangul",
                "Hangul", "Other", "Han", "Hebrew", "Arabic")
SCRIPTS = sorted(set(SCRIPT_NAMES))
LETTERS = re.compile(r"[^\W\d_]+")


def script_of(char: str) -> str:
    return SCRIPT_NAMES[bisect_right(SCRIPT_STARTS, ord(char)) - 1]


def letters_of(token: str) -> str:
    """The letters of a token in lower case, by Unicode category: numbers such as one half or a Roman one are none."""
    found = "".join(LETTERS.findall(token.lower()))
    return found if found.isalpha() else "".join(filter(str.isalpha, found))


def _buckets_of(values: np.ndarray) -> np.ndarray:
    mixed = values * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS


def features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word number, hash bucket) arrays: the whole words, then their character 1- to 4-grams with marked ends.

    All words are hashed together: they are laid end to end and a gram counts where it stays inside one word.
    """
    yield np.arange(len(words)), np.fromiter((zlib.crc32(w.encode()) % BUCKETS for w in words), np.int64, len(words))
    points = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    gram = points
    for n in (1, 2, 3, 4):
        if n > 1:
            gram = gram[:-1] * np.uint64(0x10001B3) + points[n - 1 :]
        inside = owner[: len(gram)] == owner[n - 1 :]
        if n == 1:
            ends = np.cumsum(sizes)
            inside[ends - sizes] = inside[ends - 1] = False
        yield owner[: len(gram)][inside], _buckets_of(gram[inside] + np.uint64(n << 40))


@dataclass
class LanguageModel:
    """``logs``: log probability of every bucket by language; ``seen``: whether training saw the script in the language."""

    languages: list[str]
    logs: np.ndarray
    seen: np.ndarray
    switch: float = 6.0
    strength: float = 0.5

    def token_scores(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by language (0 for the best) and number of letters of every token."""
        words = [letters_of(t) for t in tokens]
        letters = np.fromiter(map(len, words), np.int64, len(words))
        scores = np.zeros((len(words), len(self.languages)))
        for owner, buckets in features(words):
            for k in range(scores.shape[1]):
                scores[:, k] += np.bincount(owner, self.logs[buckets, k], len(words))
        scores *= self.strength
        scripts = np.fromiter((SCRIPTS.index(script_of(w[0])) if w else 0 for w in words), np.int64, len(words))
        out = ~self.seen[scripts] & self.seen.any(axis=1)[scripts, None]
        scores[out] -= 1e6
        scores = np.maximum(scores - scores.max(axis=1, keepdims=True, initial=-1e12), -30.0)
        scores[letters == 0] = 0.0
        return scores.astype(np.float32), letters


class _BucketCounts:
    """How often each language's texts hold a bucket, and their letters by script, over as many texts as come.

    Of tokens, ``CACHED_TOKENS`` and one text's are held, and ``HASHED_AT_ONCE`` words are hashed together.
    """

    def __init__(self) -> None:
        self.tables: dict[str, np.ndarray] = {}
        self.words: dict[str, Counter] = {}

    def add(self, text: str, lang: str) -> None:
        self.words.setdefault(lang, Counter()).update(text.split())
        if sum(map(len, self.words.values())) > CACHED_TOKENS:
            self.flush()

    def flush(self) -> None:
        for lang, counter in self.words.items():
            table = self.tables.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
            found = ((w, n) for w, n in ((letters_of(t), n) for t, n in counter.items()) if w)
            while part := list(islice(found, HASHED_AT_ONCE)):
                known, counts = [w for w, _ in part], np.array([n for _, n in part])
                for owner, buckets in features(known):
                    table[:BUCKETS] += np.bincount(buckets, counts[owner], BUCKETS).astype(np.int64)
                scripts = np.array([SCRIPTS.index(script_of(w[0])) for w in known])
                held = counts * np.fromiter(map(len, known), np.int64, len(known))
                table[BUCKETS:] += np.bincount(scripts, held, len(SCRIPTS)).astype(np.int64)
        self.words.clear()


def train(docs: DataFrame, smoothing: float = 0.05) -> LanguageModel:
    """Bucket counts per language over all of ``docs`` (text, lang), summed in Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _BucketCounts()
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                counts.add(text.as_py(), lang)
        counts.flush()
        for lang, table in counts.tables.items():
            at = np.flatnonzero(table)
            columns = [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(table[at], pa.int64())]
            yield pa.record_batch(columns, names=["lang", "bucket", "n"])
        release_memory()

    rows = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    languages = sorted(set(table["lang"].to_pylist()))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the broadcast model is meant for at most {MAX_LANGUAGES}")
    cells = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    column = {lang: i for i, lang in enumerate(languages)}
    cells[table["bucket"].to_numpy(), [column[x] for x in table["lang"].to_pylist()]] = table["n"].to_numpy()
    grams, scripts = cells[:BUCKETS] + smoothing, cells[BUCKETS:]
    return LanguageModel(
        languages,
        np.log(grams / grams.sum(axis=0)).astype(np.float32),
        scripts > 0.001 * scripts.sum(axis=0) if len(languages) else np.zeros((len(SCRIPTS), 0), bool),
    )


def viterbi(scores: np.ndarray, rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best language of every token; documents are advanced side by side, longest first.

    ``scores[rows[i]]`` are the scores of token i; document d owns the tokens starts[d] ... starts[d] + lengths[d] - 1.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # documents with more than t tokens
    n, k = len(rows), scores.shape[1]
    best, moved = np.zeros(n, np.uint8), np.zeros((n, k), bool)
    value = np.zeros((len(lengths), k), np.float32)
    for t in range(steps):
        at = starts[: active[t]] + t
        now = value[: active[t]]
        if t:
            top = now.argmax(axis=1)
            jump = now[np.arange(len(top)), top][:, None] - switch
            moved[at] = jump > now
            best[at] = top
            np.maximum(now, jump, out=now)
        now += scores[rows[at]]
    path = np.zeros(n, np.uint8)
    current = value.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        at, now = starts[:a] + t, current[:a]
        path[at] = now
        if t:
            current[:a] = np.where(moved[at, now], best[at], now)
    return path


class _Labeller:
    """Scores tokens once per task and labels documents in groups of bounded size."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.model.languages)), np.float32)
        self.letters = np.zeros(1024, np.int64)

    def learn(self, tokens: set[str]) -> None:
        known = self.known
        new = [t for t in tokens if t not in known]
        first, last = len(known), len(known) + len(new)
        if last > len(self.letters):
            room = max(last, 2 * len(self.letters)) - len(self.letters)
            self.scores = np.concatenate([self.scores, np.zeros((room, self.scores.shape[1]), np.float32)])
            self.letters = np.concatenate([self.letters, np.zeros(room, np.int64)])
        for at in range(0, len(new), HASHED_AT_ONCE):
            part = new[at : at + HASHED_AT_ONCE]
            end = first + at + len(part)
            self.scores[first + at : end], self.letters[first + at : end] = self.model.token_scores(part)
        known.update(zip(new, range(first, last)))

    def label(self, texts: list[str | None]) -> Iterator[tuple[str, float, list]]:
        """(language, score, spans of (first token, token after the last, language)) of each text."""
        languages, k = self.model.languages, len(self.model.languages)
        if len(self.known) > CACHED_TOKENS:
            self.reset()
        whole = [t or "" for t in texts] if k else [""] * len(texts)
        unique: set[str] = set()
        for text in whole:  # split twice, so that only one text's tokens are held at a time
            unique.update(text.split())
        self.learn(unique)
        index = self.known.__getitem__
        found = [np.fromiter(map(index, text.split()), np.int32) for text in whole]
        lengths = np.array([len(x) for x in found], np.int64)
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        rows = np.concatenate(found)
        path = viterbi(self.scores, rows, starts, lengths, self.model.switch) if k else np.zeros(0, np.uint8)
        letters = self.letters[rows]
        for start, n in zip(starts.tolist(), lengths.tolist()):
            own, weight = path[start : start + n], letters[start : start + n]
            total = weight.sum()
            if not total:
                yield UNKNOWN, 0.0, []
                continue
            held = np.bincount(own, weights=weight, minlength=k)
            top = int(held.argmax())
            evidence = self.scores[rows[start : start + n]].sum(axis=0)
            rest = np.r_[evidence[:top], evidence[top + 1 :]]
            gap = float(evidence[top] - rest.max(initial=-1e9))
            sure = 1.0 / (1.0 + np.exp(-np.clip(gap, -30.0, 30.0)))
            turns = np.flatnonzero(own[1:] != own[:-1]) + 1
            bounds = [0, *turns.tolist(), n]
            spans = [(a, b, languages[own[a]]) for a, b in zip(bounds, bounds[1:])]
            yield languages[top], max(float(held[top] / total) * float(sure), 1e-6), spans


SPANS = pa.schema(
    [
        ("lang_pred", pa.string()),
        ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("lang", pa.string())]))),
    ]
)


def label_languages(docs: DataFrame, model: LanguageModel, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, lang_pred, score and spans (token ranges of one language) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _Labeller(shared.value)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(sizes) // (6 * WORDS_AT_ONCE)
            for g in np.unique(group).tolist():
                part = batch.slice(*(lambda at: (int(at[0]), len(at)))(np.flatnonzero(group == g)))
                out = list(labeller.label(part.column(0).to_pylist()))
                lang, score, spans = zip(*out)
                named = [[{"first": a, "after": b, "lang": x} for a, b, x in s] for s in spans]
                columns = [pa.array(v, f.type) for v, f in zip((lang, score, named), SPANS)]
                yield pa.record_batch(part.columns[1:] + columns, names=[*part.schema.names[1:], *SPANS.names])
        release_memory()

    rows = docs.select(F.col("text").cast("string").alias("text"), *[f"`{c}`" for c in carry])
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    ddl = f"{fields}lang_pred string, score double, spans array<struct<first: int, after: int, lang: string>>"
    return rows.mapInArrow(compute, ddl)


def with_known_language(docs: DataFrame, model: LanguageModel, min_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` that have a language and reach ``min_score``. One pass, no shuffle.

    The decision travels with the row, so rows that repeat an id are judged each by its own text.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    judged = label_languages(docs.select(F.col("text"), row), model, ("row",))
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("row.*")
