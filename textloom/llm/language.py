"""Languages of texts and of the segments of mixed texts (problem 5).

Features are character n-grams with TF-IDF weights, hashed to a fixed number of buckets. A multinomial logistic
regression is trained on them with follow-the-regularised-leader and elastic-net penalties, on the sentences of a
bounded sample of labelled rows (``SAMPLE_ROWS`` of each label, each with its whole text). As labels may be wrong, each half of the sentences is
judged by a model of the other half, and what it contradicts is left out of the training proper. Confidences are calibrated by a temperature on held-out
sentences. The model (a table of weights) then judges every sentence of every row in Arrow batches; nothing is shuffled.

A sentence counts as whole if it ends with a closing mark. Quoted passages aren't looked at for the language of a text.

Defined results: null and blank texts, texts without words and texts of at most ``SHORT`` words get no language; a text
in which no sentence is sure gets the language of the whole; repeated rows are judged each by itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.arrow import strings

SAMPLE_ROWS = 1000
#: The calibration takes this share of a held-out sentence to be of any language, so that a model without held-out errors doesn't become certain.
SMOOTHING = 0.01
BUCKETS = 1 << 16
ORDERS = (2, 3)
SHORT = 4
EPOCHS = 3
#: A sentence shows a language of its own with this confidence and at least so many letters and words.
SURE, LETTERS, WORDS = 0.75, 12, 3

_SIZE = 1 << 16
_OPENING = re.compile('["“«„]')
_CLOSING = {'"': re.compile('["\n]'), "“": re.compile("”"), "«": re.compile("»"), "„": re.compile("[“”]")}
_ENDS = re.compile(r"[.!?…]+[\"')\]]*\s+(?=[\[\"'(]*[^\W\d_a-zàèéìòùħġċż])|\n\s*\n")
_CLOSED = re.compile(r"[.!?][\"')\]]*\s*\Z")
_CUT = re.compile(r"(?:\.\.+|…)[\"')\]]*\s*\Z")
_WORD = re.compile(r"[^\W\d_]+")
_LONG = re.compile(r"[^\W\d_]{2,}")


def _alphabet() -> np.ndarray:
    """For each code point of the basic plane its small letter, or a blank for what is no letter."""
    table = np.full(_SIZE, 32, np.uint32)
    for c in range(33, _SIZE):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 and ord(low) < _SIZE else c
    table[ord("'")], table[ord("-")] = ord("'"), ord("-")
    return table


_TABLE = _alphabet()


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each order at every position of the joined texts, and where each text begins."""
    joined = "  ".join(texts) + "  "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _TABLE[np.where(codes < _SIZE, codes, 32)]
    sizes = np.array([len(t) for t in texts], np.int64) + 2
    starts = np.cumsum(sizes) - sizes
    padded = np.concatenate([codes, np.full(max(ORDERS), 32, np.uint32)])
    out = []
    n = len(codes)
    for order in ORDERS:
        h = np.full(n, order, np.uint32)
        blank = np.ones(n, bool)
        for k in range(order):
            part = padded[k : k + n]
            h = (h * np.uint32(2654435761)) ^ (part * np.uint32(40503))
            blank &= part == 32
        h ^= h >> np.uint32(15)
        h *= np.uint32(2246822519)
        h ^= h >> np.uint32(13)
        h &= np.uint32(BUCKETS - 1)
        h[blank] = BUCKETS  # a bucket of its own, without weight
        out.append(h)
    return out, starts, codes


@dataclass(frozen=True)
class Model:
    """Weights (with the inverse document frequencies in them), one row for each bucket."""

    languages: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Logits of each text."""
        out = np.zeros((len(texts), len(self.languages)), np.float32)
        at = 0
        while at < len(texts):  # so many at a time that the arrays stay in the cache
            size, to = 0, at
            while to < len(texts) and (to == at or size < 60_000):
                size += len(texts[to])
                to += 1
            buckets, starts, codes = grams(texts[at:to])
            total = self.weights[buckets[0]]
            for h in buckets[1:]:
                total += self.weights[h]
            used = np.maximum(np.add.reduceat((buckets[-1] != BUCKETS).astype(np.float32), starts), 1)
            out[at:to] = np.add.reduceat(total, starts, axis=0) / np.sqrt(used)[:, None] + self.bias
            at = to
        return out

    def probabilities(self, texts: list[str]) -> np.ndarray:
        x = self.scores(texts) / self.temperature
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a text; quoted passages should be blanked before."""
    bounds = [0, *(m.end() for m in _ENDS.finditer(text)), len(text)]
    return [(a, b) for a, b in zip(bounds, bounds[1:]) if b > a]


def blank_quotes(text: str) -> str:
    """The text with blanks for its quotations, however long; one that isn't closed ends with its line."""
    out, at = [], 0
    unclosed: set[str] = set()  # marks that close nowhere in the rest
    while m := _OPENING.search(text, at):
        start, mark = m.start(), m.group()
        close = None if mark in unclosed else _CLOSING[mark].search(text, m.end())
        if close is None:
            unclosed.add(mark)
            end = text.find("\n", start)
            end = len(text) if end < 0 else end
        elif close.group() == "\n":  # a straight mark alone in its line encloses nothing
            out.append(text[at : m.end()])
            at = m.end()
            continue
        else:
            end = close.end()
        out += [text[at:start], " " * (end - start)]
        at = end
    out.append(text[at:])
    return "".join(out)


_TAG = re.compile(r"</?[A-Za-z][^<>]*>|&#?\w+;")


def prose(text: str) -> str:
    """The text with blanks for quotations, tags and entities, every character in its place."""
    if "<" in text or "&" in text:
        text = _TAG.sub(lambda m: " " * len(m.group()), text)
    return blank_quotes(text) if _OPENING.search(text) else text


def at_least(pattern: re.Pattern, text: str, n: int) -> bool:
    """Whether a pattern stands at least n times in the whole text; looks no further than it must."""
    return next(islice(pattern.finditer(text), n - 1, None), None) is not None


def _ftrl(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, k: int, epochs: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.05, l2: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            index, value = examples[i]
            w, wb = weight(z[index], n[index]), weight(zb, nb)
            x = value @ w + wb
            p = np.exp(x - x.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = value[:, None] * p
            z[index] += g - (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha * w
            n[index] += g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * wb
            nb += p * p
    return weight(z, n), weight(zb, nb)


def train(rows: list[tuple[str, str]], languages: tuple[str, ...], epochs: int = EPOCHS) -> Model:
    """A model from labelled texts."""
    texts, labels = [], []
    for text, label in rows:
        plain = prose(text)
        for a, b in sentences(plain):
            if len(_WORD.findall(plain[a:b])) >= WORDS:
                texts.append(plain[a:b].strip())
                labels.append(languages.index(label))
    y = np.array(labels, np.int64)
    if not len(texts):
        return Model(languages, np.zeros((BUCKETS + 1, len(languages)), np.float32), np.zeros(len(languages), np.float32), 1.0)
    buckets, starts, _ = grams(texts)
    ends = np.r_[starts[1:], len(buckets[0])]
    seen = np.zeros(BUCKETS + 1)
    raw = []
    for a, b in zip(starts, ends):
        index, count = np.unique(np.concatenate([h[a:b] for h in buckets]), return_counts=True)
        real = index != BUCKETS
        seen[index[real]] += 1
        raw.append((index[real], count[real], max(1, int((buckets[-1][a:b] != BUCKETS).sum()))))
    idf = np.log((1 + len(raw)) / (1 + seen)) + 1
    examples = [(index, count * idf[index] / math.sqrt(used)) for index, count, used in raw]
    held = np.arange(len(examples)) % 5 == 0
    # Labels may be wrong: a model of one half judges the other half, and what it contradicts is left out.
    half = (np.arange(len(examples)) // 5) % 2 == 0
    right_label = np.ones(len(examples), bool)
    for _ in range(2):
        judged = np.zeros((len(examples), len(languages)))
        for own in (half, ~half):
            w, b = _ftrl([examples[i] for i in np.flatnonzero(own & right_label)], y[own & right_label], len(languages), 1)
            table = (w * idf[:, None]).astype(np.float32)
            table[BUCKETS] = 0
            judged += np.where(own[:, None], 0, Model(languages, table, b.astype(np.float32), 1.0).probabilities(texts))
        right_label = judged.argmax(axis=1) == y
    keep = np.flatnonzero(~held & right_label)
    w, b = _ftrl([examples[i] for i in keep], y[keep], len(languages), epochs)
    table = (w * idf[:, None]).astype(np.float32)
    table[BUCKETS] = 0
    model = Model(languages, table, b.astype(np.float32), 1.0)
    logits, right = model.scores(texts), np.flatnonzero(held & right_label)
    if not len(right):
        return model

    def loss(t: float) -> float:
        x = logits[right] / t
        x = x - x.max(axis=1, keepdims=True)
        own = (1 - SMOOTHING) * x[np.arange(len(right)), y[right]] + SMOOTHING * x.mean(axis=1)
        return float((np.log(np.exp(x).sum(axis=1)) - own).mean())

    temperature = min((1.15**i for i in range(-12, 25)), key=loss)
    return Model(languages, model.weights, model.bias, temperature)


def fit(df: DataFrame, id_column: str, text_column: str, label_column: str, languages: tuple[str, ...], sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``sample_rows`` rows of each label, chosen by the hash of their id, with their whole texts.

    The rows are chosen on ids and labels alone (each task hands on no more than the bound), and one pass reads their texts.
    """
    h = F.xxhash64(id_column)
    labelled = df.where(F.col(label_column).isin(*languages)).select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), h.alias("h"))
    chosen = labelled.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("h", "id"))).where(F.col("k") <= sample_rows)
    ids = [r["id"] for r in chosen.select("id").collect()]  # at most sample_rows for each label
    texts = df.where(F.col(id_column).isin(ids) & F.col(label_column).isin(*languages) & F.col(text_column).isNotNull())
    rows = texts.select(F.col(text_column).alias("text"), F.col(label_column).alias("label"), h.alias("h")).collect()
    return train([(r["text"], r["label"]) for r in sorted(rows, key=lambda r: (r["label"], r["h"], r["text"])) if r["text"].strip()], languages)


def judge(model: Model, texts: list[str | None]) -> list[tuple[str | None, float | None, list[dict]]]:
    """Of each text its main language, the confidence, and the segments if it is mixed."""
    plain, spans, owners, whole = [], [], [], []
    pieces: list[str] = []
    counts: list[int] = []
    for i, text in enumerate(texts):
        body = prose(text) if text else ""
        plain.append(body)
        found = sentences(body) if body else []
        for a, b in found:
            piece = body[a:b]
            pieces.append(piece)
            owners.append(i)
            spans.append((a, b))
            whole.append(bool(_CLOSED.search(piece)) and not _CUT.search(piece))
        counts.append(len(found))
    p = model.probabilities(pieces) if pieces else np.zeros((0, len(model.languages)))
    out: list[tuple[str | None, float | None, list[dict]]] = []
    at = 0
    for text, n in zip(texts, counts):
        own = range(at, at + n)
        at += n
        if not text or not at_least(_WORD, text, SHORT + 1):
            out.append((None, None, []))
            continue
        best = p[at - n : at].argmax(axis=1) if n else np.zeros(0, int)
        sure = [j for j, k in enumerate(own) if whole[k] and p[k].max() >= SURE and len(pieces[k].strip()) >= LETTERS and at_least(_LONG, pieces[k], WORDS)]
        shown = {int(best[j]) for j in sure}
        weight = np.zeros(len(model.languages))
        for j, k in enumerate(own):
            if n == 1 or at_least(_LONG, pieces[k], 2):
                weight += p[k] * len(pieces[k])
        if weight.sum() == 0:
            weight = model.probabilities([text])[0]
        main = int(weight.argmax()) if not shown or int(weight.argmax()) in shown else max(shown, key=lambda s: weight[s])
        confidence = float(weight[main] / weight.sum())
        segments: list[dict] = []
        if len(shown) > 1:
            # Unsure sentences go with the segment before them.
            certain = set(sure)
            for j, k in enumerate(own):
                language = model.languages[int(best[j])] if j in certain else segments[-1]["lang"] if segments else model.languages[int(best[sure[0]])]
                if segments and segments[-1]["lang"] == language:
                    segments[-1]["end"] = spans[k][1]
                    segments[-1]["confidence"] = min(segments[-1]["confidence"], float(p[k].max())) if j in certain else segments[-1]["confidence"]
                else:
                    segments.append({"start": spans[k][0], "end": spans[k][1], "lang": language, "confidence": float(p[k].max())})
        out.append((model.languages[main], round(confidence, 4), segments))
    return out


_SEGMENTS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))


def _judging(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                rows = judge(model, strings(part.column(part.num_columns - 1)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], _SEGMENTS)],
                    names=[*part.schema.names[:-1], "lang", "confidence", "segments"],
                )

    return run


def languages_of(df: DataFrame, model: Model) -> DataFrame:
    """df(..., text) with lang, confidence and segments(start, end, lang, confidence) in place of the text."""
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != "text")
    ordered = df.select(*[c for c in df.columns if c != "text"], "text")
    return ordered.mapInArrow(_judging(model), f"{kind}, lang string, confidence double, segments array<struct<start:int,end:int,lang:string,confidence:double>>")


def missing_label(label: Column) -> Column:
    return label.isNull() | F.lower(F.btrim(label)).isin("", "und")


def mislabelled(judged: DataFrame, label: str = "label") -> DataFrame:
    """(table_name, row_id, lang): judged rows with a missing or wrong label, or in several languages."""
    langs = F.when(F.size("segments") > 0, F.array_distinct(F.transform("segments", lambda s: s["lang"]))).otherwise(F.array("lang"))
    wrong = missing_label(F.col(label)) | (F.col(label) != F.col("lang")) | (F.size("segments") > 0)
    return judged.where(F.col("lang").isNotNull() & wrong).select("table_name", "row_id", F.explode(langs).alias("lang")).distinct()
