"""Language identification by fusing evidence.

Four kinds of evidence are combined by Bayes' rule: the likelihood of the text
under byte-trigram models, the language the markup declares, the suffix of the
address, and a prior of the host.  Host priors are smoothed in a hierarchy (host,
registered domain, all) and come from grouped sums of the text posteriors; a page
is taken out of its own prior.  How far declarations and suffixes can be trusted
is learnt from the same sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import slices, texts_of, written

BUCKETS = 1 << 13
# A text counts as this many independent trigrams at most; its mean is over all of it.
EVIDENCE = 60
# Pseudo-counts of the level above in host priors, and of unseen clues.
HOST_WEIGHT, CLUE_WEIGHT = 10.0, 1.0
# A text is rejected if no language reaches this probability.
LEAST = 0.5
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Log probability of each trigram bucket: buckets x languages."""

    languages: tuple[str, ...]
    logs: np.ndarray


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Bucket of each byte trigram; ASCII capitals count as small letters."""
    low = raw.astype(np.uint32)
    low = low + 32 * ((low >= 65) & (low <= 90))
    code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int64) % BUCKETS


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Trigram models from all rows with a language, by grouped aggregation.

    Each task sums the counts of its rows; the driver gets at most one row per
    language and bucket.  Without rows the model has no languages.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches, text):
            for value, language in zip(texts_of(batch, text), batch.column(lang).to_pylist(), strict=True):
                raw = np.frombuffer(f" {value} ".encode(), np.uint8)
                held = totals.setdefault(language, np.zeros(BUCKETS, np.int64))
                held += np.bincount(trigrams(raw), minlength=BUCKETS)
        rows = [(language, np.flatnonzero(held), held) for language, held in totals.items()]
        for language, some, held in rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(some), pa.string()), pa.array(some), pa.array(held[some])], ["lang", "bucket", "n"]
            )

    known = docs.select(text, lang).filter(F.col(lang).isNotNull())
    counted = known.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    languages = tuple(sorted(found["lang"].unique()))
    counts = np.full((BUCKETS, len(languages)), 0.5)
    place = {language: k for k, language in enumerate(languages)}
    counts[found["bucket"].to_numpy(int), found["lang"].map(place).to_numpy(int)] += found["n"].to_numpy(float)
    return Model(languages, np.log(counts / counts.sum(0)) if languages else counts)


def text_evidence(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``evidence``: tempered log likelihood per language, best one at 0.

    The mean over all trigrams of the whole text counts as ``EVIDENCE`` of them,
    or as many as there are.  Null for texts without a letter.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)  # buckets x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value.logs
        for batch in slices(batches, text):
            found: list[list[float] | None] = []
            for value in texts_of(batch, text):
                if not any(c.isalpha() for c in value):
                    found.append(None)
                    continue
                grams = trigrams(np.frombuffer(f" {value} ".encode(), np.uint8))
                total = np.bincount(grams, minlength=BUCKETS) @ logs
                total *= min(1.0, EVIDENCE / len(grams))
                found.append((total - total.max()).tolist() if len(total) else [])
            column = pa.array(found, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "evidence"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{own}, evidence array<double>")


def _softmax(logs: Column) -> Column:
    powers = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def _array(columns: list[Column]) -> Column:
    return F.array(*columns)


def fuse(rows: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """Add ``lang, probability`` to rows with ``evidence, host, declared, suffix``.

    Null clues are no evidence.  A row without text evidence keeps its clues; if
    it has none either, the overall shares decide.
    """
    count = len(languages)
    each = range(count)
    at = lambda name: [F.col(name)[k] for k in each]
    flat = F.array(*[F.lit(1.0 / count) for _ in each])
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    rows = rows.withColumn("text_p", F.coalesce(_softmax(F.col("evidence")), flat))
    rows = rows.withColumn("seen", F.col("evidence").isNotNull().cast("double"))
    rows = rows.withColumn("domain", F.when(domain != "", domain).otherwise(F.col("host")))
    rows = written(rows, "evidence")

    def sums(name: str, *keys: str) -> DataFrame:
        parts = [F.sum(F.col("text_p")[k] * F.col("seen")).alias(f"{name}{k}") for k in each]
        summed = rows.filter(" and ".join(f"{k} is not null" for k in keys) or "true").groupBy(*keys).agg(*parts)
        filled = [F.coalesce(F.col(f"{name}{k}"), F.lit(0.0)) for k in each]
        return summed.select(*keys, _array(filled).alias(name))

    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    overall = sums("all").first()[0]
    shares = [(x + 1.0) / (sum(overall) + count) for x in overall]
    share = F.array(*map(F.lit, shares))
    hosts = sums("of_host", "host", "domain").join(sums("of_domain", "domain"), "domain").select("host", "of_host", "of_domain")
    joined = rows.join(written(hosts, "hosts"), "host", "left")
    for clue in ("declared", "suffix"):
        seen = sums(f"of_{clue}", clue)
        joined = joined.join(written(seen, clue), clue, "left")

    def smoothed(counts: list[Column], above: list[Column]) -> list[Column]:
        whole = sum(counts[1:], counts[0]) + HOST_WEIGHT
        return [(c + HOST_WEIGHT * a) / whole for c, a in zip(counts, above)]

    zero = F.lit(0.0)
    own = [p * F.col("seen") for p in at("text_p")]
    of_domain = [F.greatest(F.coalesce(c - h, zero), zero) for c, h in zip(at("of_domain"), at("of_host"))]
    of_host = [F.greatest(F.coalesce(c - o, zero), zero) for c, o in zip(at("of_host"), own)]
    joined = joined.withColumn("domain_prior", _array(smoothed(of_domain, [share[k] for k in each])))
    joined = joined.withColumn("prior", _array(smoothed(of_host, at("domain_prior"))))

    def clue_log(clue: str) -> list[Column]:
        """Log of P(clue | language), up to a constant, without the row itself."""
        counts = [F.greatest(c - o, zero) for c, o in zip(at(f"of_{clue}"), own)]
        whole = total(F.col(f"of_{clue}")) + CLUE_WEIGHT
        back = [(c + CLUE_WEIGHT * s) / whole / s for c, s in zip(counts, [share[k] for k in each])]
        return [F.coalesce(F.log(b), zero) for b in back]

    evidence = [F.coalesce(e, zero) for e in at("evidence")]
    logs = [
        e + F.log(p) + d + s
        for e, p, d, s in zip(evidence, at("prior"), clue_log("declared"), clue_log("suffix"))
    ]
    joined = joined.withColumn("posterior", _softmax(_array(logs)))
    names = F.array(*map(F.lit, languages))
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    return joined.withColumn("lang", F.get(names, best - 1)).withColumn("probability", F.array_max("posterior"))


def identify(
    rows: DataFrame, key: str, model: Model, text: Column, host: Column | None = None,
    declared: Column | None = None, suffix: Column | None = None, least: float = LEAST,
) -> DataFrame:
    """``key, lang, probability, text_lang, declared, host, rejected`` per row.

    ``rejected`` if the text has no letter or no language reaches ``least``; the
    language is then ``und``.  Null and empty texts are rejected.  Repeated or
    null keys get a row each, equal rows equal ones.  Whole texts count, however long.  Of
    languages that are equally likely the first by name is taken.  Without languages in
    the model all is rejected; an empty table gives no rows.  Only the named columns are read.

    The models are a closed set: a text in another language is named as the closest one,
    and no text with letters is rejected for being in none.
    """
    none = F.lit(None).cast("string")
    lower = lambda c: none if c is None else F.nullif(F.lower(c), F.lit(""))
    narrow = rows.select(
        F.col(key).alias(key), text.alias("body"), lower(host).alias("host"),
        lower(declared).alias("declared"), lower(suffix).alias("suffix"),
    )
    scored = text_evidence(narrow, model, "body").drop("body")
    if not model.languages:
        return scored.select(
            key, F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("probability"), none.alias("text_lang"),
            "declared", "host", F.lit(True).alias("rejected"),
        )
    fused = fuse(scored, model.languages)
    names = F.array(*map(F.lit, model.languages))
    at = F.array_position("evidence", F.array_max("evidence")).cast("int") - 1
    of_text = F.when(F.col("evidence").isNotNull(), F.get(names, at))
    rejected = F.col("evidence").isNull() | (F.col("probability") < least)
    return fused.select(
        key, F.when(rejected, F.lit(UNKNOWN)).otherwise(F.col("lang")).alias("lang"), "probability",
        of_text.alias("text_lang"), "declared", "host", rejected.alias("rejected"),
    )


# Markup whose content is no text of the page.
_NO_TEXT = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z0-9#]{1,10};"


def identify_pages(pages: DataFrame, model: Model) -> DataFrame:
    """Language of web pages ``page_id, url, html`` from all four kinds of evidence."""
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    declared = F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    suffix = F.regexp_extract(host, r"\.([A-Za-z]+)$", 1)
    return identify(pages, "page_id", model, F.regexp_replace("html", _NO_TEXT, " "), host, declared, suffix)
