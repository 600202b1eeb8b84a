"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A text is parsed greedily into the longest phrases that occur
in that text; the language that needs the fewest phrases for each code point wins.  Words (runs of letters in lower case) are parsed
one by one, each with a blank before it, so that a word's phrase counts can be kept and summed up.

The labelled text of a language is a bounded sample, SAMPLE_CHARS code points of distinct documents in the order of a hash of doc_id and text, and
one document at least; it is chosen in two steps, so that no language's documents meet in one task, and it is the only thing that reaches the
driver.  More than MOST_LANGUAGES different labels are refused: each one has an automaton of its own, and they share ALL_CHARS.

Defined results.  A text that is null or has no letter (Unicode's categories L) is `und` with score 0.  Ties go to the language that sorts first.
With no labelled text at all every text is `und`.  Documents with a null lang are not learned from; those with a null doc_id are
not held out.  Rows that share a doc_id, or have none, are learned from by their texts, and predicted each on its own.  An empty table gives no rows.  A text of any length is parsed
whole.  Columns of the caller keep their names and values, whatever these are.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import crc_bucket, worker_model

#: Bound of what is learned: code points of text for each language, of one document, and of all languages together, which
#: share this last one evenly if they are many.
SAMPLE_CHARS = 60_000
DOCUMENT_CHARS = 2_000
ALL_CHARS = 6_000_000
MOST_LANGUAGES = 2000
#: A text is rejected if even the best language needs more phrases than this for each code point.
REJECT_RATE = 0.55
MEMO_WORDS = 200_000
_WORDS = re.compile(r"[^\W\d_]+")  # runs of letters, and of numbers that are no digits: letter_runs() parts these


def letter_runs(text: str) -> list[str]:
    """The runs of letters (Unicode's categories L) of a text in lower case."""
    out = []
    for word in _WORDS.findall(text.lower()):
        if word.isalpha():
            out.append(word)
        else:
            out.extend("".join(c if c.isalpha() else " " for c in word).split())
    return out


class SuffixAutomaton:
    """All substrings of a text as a deterministic automaton."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur

    def phrases(self, text: str) -> int:
        """Into how many longest phrases that occur here the text is parsed; a code point that occurs nowhere is one phrase."""
        edges, count, state = self.next, 0, 0
        for c in text:
            to = edges[state].get(c)
            if to is None:
                count += 1
                if state:
                    to = edges[0].get(c)
                    if to is None:
                        count += 1
            state = to or 0
        return count + (state != 0)


class CrossParser(dict):
    """Phrase counts of words against labelled text of each language, kept by word: one whole number with WIDTH bits for each language,
    so that a text's counts are the sum of its words' numbers."""

    WIDTH = 48

    def __init__(self, samples: list[tuple[str, str]]):
        super().__init__()
        self.languages = [lang for lang, _ in samples]
        self.automata = [SuffixAutomaton(text) for _, text in samples]

    def __missing__(self, word: str) -> int:
        """Phrases by language and, above them, the code points parsed: none for what holds no letter."""
        value = 0
        for run in [word] if word.isalpha() else letter_runs(word):
            for i, a in enumerate(self.automata):
                value += a.phrases(" " + run) << (self.WIDTH * i)
            value += len(run) + 1 << (self.WIDTH * len(self.automata))
        self[word] = value
        return value

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and phrases of the best language for each code point."""
        if text is None or not self.languages:
            return "und", 0.0, 1.0
        if len(self) > MEMO_WORDS:
            self.clear()
        total = sum(map(self.__getitem__, _WORDS.findall(text.lower())))
        mask = (1 << self.WIDTH) - 1
        *counts, size = [total >> (self.WIDTH * i) & mask for i in range(len(self.languages) + 1)]
        if not size:
            return "und", 0.0, 1.0
        order = sorted(range(len(counts)), key=counts.__getitem__)  # stable: ties go to the first language
        best = counts[order[0]]
        second = counts[order[1]] if len(counts) > 1 else best * 2
        return self.languages[order[0]], 1.0 - best / second, best / size


def labelled_samples(docs: DataFrame, text: str = "text", label: str = "lang", chars: int = SAMPLE_CHARS, per_document: int = DOCUMENT_CHARS) -> list[tuple[str, str]]:
    """(language, sample) in the order of languages.  docs: the rows that may be learned from."""
    rows = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(label).alias("label"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("doc_id", "text", F.lit("language sample")), F.lit(1 << 30)))
    per_label = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.least(F.length("text"), F.lit(per_document))).alias("chars"), F.min("at").alias("least"))
    counts = {r["label"]: (r["n"], r["chars"], r["least"]) for r in per_label.limit(MOST_LANGUAGES + 1).collect()}
    if not counts:
        return []
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different labels in {label}")
    chars = min(chars, max(1, ALL_CHARS // len(counts)))
    # a share of the hash range that holds about four times what is needed, then the first of those in order
    upto = {lang: max(least, int(min(1.0, 4.0 * chars / total + 64.0 / n) * (1 << 30))) for lang, (n, total, least) in counts.items()}
    limits = F.create_map(*[F.lit(x) for pair in upto.items() for x in pair])
    near = rows.filter(F.col("at") <= limits[F.col("label")])
    near = near.select("label", "doc_id", "at", F.substring("text", 1, per_document).alias("text")).distinct()
    w = Window.partitionBy("label").orderBy("at", "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    got = near.withColumn("before", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))).filter(F.col("before") < chars).collect()
    out: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r["label"], r["at"], r["doc_id"] or 0, r["text"])):
        out.setdefault(r["label"], []).append(r["text"])
    return [(lang, " ".join(letter_runs(" ".join(texts)))[:chars]) for lang, texts in sorted(out.items())]


def identify(docs: DataFrame, samples: list[tuple[str, str]], text: str = "text", name: str = "found") -> DataFrame:
    """docs with the struct `name` of lang_pred, score and phrase_rate.  Every whole text is parsed."""
    key = hashlib.sha256(repr(samples).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(samples)  # at most ALL_CHARS code points
    fields = "lang_pred string, score double, phrase_rate double"

    @F.pandas_udf(fields)
    def parse(values):
        import pandas as pd

        parser = worker_model(f"samples {key}", lambda: CrossParser(sent.value))
        got = [parser.predict(v) for v in values]
        return pd.DataFrame(got, columns=["lang_pred", "score", "phrase_rate"])

    return docs.withColumn(name, parse(F.col(f"`{text}`")))


def held_out(modulus: int = 4, remainder: int = 2):
    return F.coalesce(crc_bucket(F.col("doc_id"), modulus) == remainder, F.lit(False))


def language_id(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, phrase_rate; learned from the documents that are not held out."""
    samples = labelled_samples(docs.filter(~held_out()), text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col(text).alias("text"))
    return identify(rows, samples).select("doc_id", "held_out", "found.lang_pred", "found.score", "found.phrase_rate")


def keep_identified(docs: DataFrame, text: str = "text", reject_rate: float = REJECT_RATE) -> DataFrame:
    """The documents of docs in a known language, with docs' own columns: those with no letter, and those that no language explains, go.

    Where nothing was learned, every document with a letter stays."""
    samples = labelled_samples(docs.filter(~held_out()), text)
    if not samples:

        @F.pandas_udf("boolean")
        def has_letter(values):
            return values.map(lambda v: v is not None and any(map(str.isalpha, v))).astype(bool)

        return docs.filter(has_letter(F.col(text)))
    name = "found"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    found = identify(docs, samples, text, name)
    return found.filter((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.phrase_rate") <= reject_rate)).select(*[F.col(f"`{c}`") for c in docs.columns])
