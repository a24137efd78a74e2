"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior per document:

* the text: byte-trigram likelihoods per language, learned from all documents' declared languages;
* the declared markup language, weighed by how often a declaration agrees with the text;
* the address suffix and the host: priors that are smoothed down a hierarchy (all, suffix, domain, host)
  and computed by grouped sums of the text's own posteriors.

A further class, ``und``, spreads its likelihood evenly over all trigrams, so that a text in none of the
languages is rejected rather than forced into one.

Defined cases: a null or empty text has no text evidence and is judged by the other evidence, of which alone it can't
reach ``und`` with certainty, so it is rejected (language ``und``, confidence 0). A null or unknown
declaration and a null host give no evidence of their kind. Repeated rows get equal answers; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinlift.llm.common import flat_bytes, lookup_join, slices, store

LANGUAGES = ("de", "en", "es", "fr")
UND = "und"
BUCKETS = 1 << 13          # hashed trigrams
EVIDENCE = 40.0            # a text counts as at most so many independent trigrams
UND_PRIOR = 0.01
STRENGTH = 20.0            # pseudo-documents that a level of the host hierarchy borrows from the level above
MIN_CONFIDENCE = 0.5
SLICE_BYTES = 1 << 19

# letters keep their (lower-cased) byte, everything else in ASCII is one separator
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def trigram_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bucket per byte position (of the trigram that starts there) and whether it counts."""
    x = np.full(len(data) + 2, 32, np.uint32)
    x[:-2] = _FOLD[data]
    a, b, c = x[:-2], x[1:-1], x[2:]
    codes = ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D)))
    codes = (codes ^ (codes >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    counts = (b != 32) & ((a != 32) | (c != 32))
    ends = offsets[1:][np.diff(offsets) > 0]
    counts[ends - 1] = False
    two = ends[ends >= 2] - 2
    counts[two] = False
    return (codes >> np.uint32(19)).astype(np.int32), counts


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    log_p: np.ndarray          # (languages + und, BUCKETS), log likelihood of a trigram

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Summed log likelihood per text and class, and the number of trigrams that counted."""
        data, offsets = flat_bytes(column)
        n = len(offsets) - 1
        total, seen = np.zeros((n, len(self.log_p))), np.zeros(n)
        for i, j in slices(offsets, SLICE_BYTES):
            own = offsets[i:j + 1] - offsets[i]
            full = np.flatnonzero(np.diff(own))
            if not len(full):
                continue
            codes, counts = trigram_codes(data[offsets[i]:offsets[j]], own)
            starts = own[:-1][full]
            seen[i + full] = np.add.reduceat(counts, starts, dtype=np.float64)
            for k, row in enumerate(self.log_p):
                total[i + full, k] = np.add.reduceat(np.where(counts, row[codes], 0.0), starts)
        return total, seen


def fit_text(docs: DataFrame, text: str, declared: str, languages: Sequence[str] = LANGUAGES) -> TextModel:
    """Trigram counts per declared language over all documents; the result has a fixed size."""
    languages = tuple(languages)
    k = len(languages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(k * BUCKETS, np.int64)
        for batch in batches:
            data, offsets = flat_bytes(batch.column(0))
            who = np.array([languages.index(x) if x in languages else -1 for x in batch.column(1).to_pylist()])
            for i, j in slices(offsets, SLICE_BYTES):
                own = offsets[i:j + 1] - offsets[i]
                codes, counts = trigram_codes(data[offsets[i]:offsets[j]], own)
                owner = np.repeat(who[i:j], np.diff(own))
                counts &= owner >= 0
                sums += np.bincount(codes[counts] + owner[counts] * BUCKETS, minlength=k * BUCKETS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["at", "n"])

    rows = (docs.select(F.col(text).cast("string"), F.lower(F.col(declared)))
            .mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros(k * BUCKETS)
    for at, n in rows:
        counts[at] = n
    smooth = counts.reshape(k, BUCKETS) + 0.5
    log_p = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    return TextModel(languages, np.vstack([log_p, np.full(BUCKETS, -np.log(BUCKETS))]))


def _scored(docs: DataFrame, text: str, model: TextModel, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep``, and ``__ll``: tempered log likelihoods, null where the text says nothing."""
    frame = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = frame.drop("__text").schema
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + ["__ll array<double>"])
    names = [*schema.names, "__ll"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, seen = model.score(batch.column(batch.num_columns - 1))
            total *= (np.minimum(seen, EVIDENCE) / np.maximum(seen, 1))[:, None]
            width = total.shape[1]
            ll = pa.ListArray.from_arrays(pa.array(np.arange(0, len(total) * width + 1, width), pa.int32()),
                                          pa.array(total.ravel()), mask=pa.array(seen == 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ll], names)

    return frame.mapInArrow(score, fields)


def _softmax(logs: Column) -> Column:
    """exp, scaled to sum one; null stays null."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def host_levels(host: Column) -> tuple[Column, Column]:
    """Address suffix and domain of a host; a name without a dot has an empty suffix and is its own domain."""
    labels = F.split(host, r"\.")
    dotted = F.size(labels) > 1
    return (F.when(dotted, F.element_at(labels, -1)).otherwise(""),
            F.when(dotted, F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))).otherwise(host))


def host_priors(narrow: DataFrame, classes: int) -> DataFrame:
    """(host, weight, prior): posteriors of the text summed per host, smoothed by domain, suffix and all documents.

    The per-host sums are combined before the shuffle, so a host with a third of the documents costs one row per task.
    """
    p = _softmax(F.col("__ll"))
    sums = [F.sum(p[i]).alias(f"s{i}") for i in range(classes)]
    cols = [f"s{i}" for i in range(classes)]
    hosts = narrow.groupBy("__host").agg(F.count(F.lit(1)).alias("weight"), *sums).fillna(0.0, cols)
    suffix, domain = host_levels(F.col("__host"))
    hosts = store(hosts.withColumns({"suffix": suffix, "domain": domain}))
    total = hosts.agg(*[F.sum(c).alias(c) for c in cols]).first()
    total = np.array([x or 0.0 for x in total])
    top = (total + 1.0) / (total.sum() + classes)

    def smoothed(above: list[Column]) -> list[Column]:
        n = sum((F.col(c) for c in cols), F.lit(0.0))
        return [(F.col(c) + STRENGTH * a) / (n + STRENGTH) for c, a in zip(cols, above)]

    def level(frame: DataFrame, key: str) -> DataFrame:
        return frame.groupBy(key).agg(F.count(F.lit(1)).alias("members"), *[F.sum(c).alias(c) for c in cols])

    suffixes = level(hosts, "suffix").withColumn("prior", F.array(*smoothed([F.lit(float(x)) for x in top])))
    suffixes = suffixes.select("suffix", "members", F.col("prior").alias("above"))
    above = [F.col("above")[i] for i in range(classes)]
    domains = level(hosts, "domain").withColumn("suffix", host_levels(F.col("domain"))[0])
    domains = lookup_join(domains, store(suffixes), "suffix", "members")
    domains = domains.select("domain", "members", F.array(*smoothed(above)).alias("above"))
    hosts = lookup_join(hosts, store(domains), "domain", "members")
    return hosts.select("__host", "weight", F.array(*smoothed(above)).alias("prior"))


def declared_weights(narrow: DataFrame, languages: Sequence[str]) -> np.ndarray:
    """log P(declared | language), from how often each declaration meets each language of the text."""
    best = F.array_position(F.col("__ll"), F.array_max("__ll")) - 1
    rows = narrow.where("__ll is not null").groupBy(best.alias("l"), "__declared").count().where(
        F.col("__declared").isin(*languages)).collect()
    counts = np.full((len(languages) + 1, len(languages)), 1.0)
    for lang, declared, n in rows:
        counts[lang, languages.index(declared)] += n
    share = counts / counts.sum(axis=1, keepdims=True)
    share = 0.9 * share + 0.1 / len(languages)          # a declaration never decides alone
    share[-1] = 1.0 / len(languages)                    # it says nothing about texts of no language
    return np.log(share)


@dataclass(frozen=True)
class Evidence:
    model: TextModel
    priors: DataFrame          # stored: __host, weight, prior
    declared: np.ndarray


def gather(docs: DataFrame, text: str, declared: str, host: str,
           languages: Sequence[str] = LANGUAGES) -> tuple[Evidence, DataFrame]:
    """All evidence of a corpus, and its narrow table: every column but the text, with the text's likelihoods."""
    model = fit_text(docs, text, declared, languages)
    narrow = store(_scored(_keyed(docs, declared, host), text, model,
                           [F.col(c) for c in docs.columns if c != text] + ["__declared", "__host"]))
    priors = store(host_priors(narrow, len(languages) + 1))
    return Evidence(model, priors, declared_weights(narrow, tuple(languages))), narrow


def _keyed(docs: DataFrame, declared: str, host: str) -> DataFrame:
    return docs.withColumns({"__declared": F.lower(F.col(declared).cast("string")),
                             "__host": F.coalesce(F.lower(F.col(host).cast("string")), F.lit(""))})


def fuse(narrow: DataFrame, evidence: Evidence) -> DataFrame:
    """Adds __language and __confidence to rows that have __ll, __declared and __host."""
    languages = evidence.model.languages
    classes = [*languages, UND]
    joined = lookup_join(narrow, evidence.priors, "__host", "weight")
    said = F.lit(None).cast("array<double>")
    for j, lang in enumerate(languages):
        weights = F.array(*[F.lit(float(x)) for x in evidence.declared[:, j]])
        said = F.when(F.col("__declared") == lang, weights).otherwise(said)
    logs = [F.col("__ll")[i] + F.coalesce(said[i], F.lit(0.0))
            + F.log(F.coalesce(F.col("prior")[i], F.lit(1.0 / len(classes))) * (1 - UND_PRIOR) + UND_PRIOR / len(classes))
            for i in range(len(classes))]
    posterior = F.when(F.col("__ll").isNotNull(), _softmax(F.array(*logs)))
    out = joined.withColumn("__p", posterior).withColumn("__top", F.array_max("__p"))
    name = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("__p", F.col("__top")).cast("int"))
    sure = F.col("__top") >= MIN_CONFIDENCE
    return out.withColumns({"__language": F.when(sure, name).otherwise(UND),
                            "__confidence": F.coalesce(F.col("__top"), F.lit(0.0))}).drop("__p", "__top", "prior")


def identify(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source",
             languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """Every column of ``docs`` but the text, with ``language`` and ``confidence``; ``und`` is a rejection."""
    evidence, narrow = gather(docs, text, declared, host, languages)
    fused = fuse(narrow, evidence)
    return fused.withColumnsRenamed({"__language": "language", "__confidence": "confidence"}).drop(
        "__ll", "__declared", "__host")


def keep_identified(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source",
                    languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """The documents that have one of the languages, with their own columns.

    Texts are scored again where they are kept, so they are neither stored twice nor joined by key.
    """
    narrow_docs = docs.select(F.col(text), F.col(declared).alias("__d"), F.col(host).alias("__h"))
    evidence, _ = gather(narrow_docs, text, "__d", "__h", languages)
    rows = _scored(_keyed(docs, declared, host), text, evidence.model, [*docs.columns, "__declared", "__host"])
    return fuse(rows, evidence).where(F.col("__language") != UND).select(*docs.columns)


