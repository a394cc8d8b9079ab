"""One agreed label from the labels of several annotators who disagree.

An annotator knows the right value with a probability and otherwise gives any value at the
rate at which values occur. Then the agreement of two annotators, corrected for chance, is
the product of their two probabilities, and three annotators determine each one of them:
``w_a^2 = k_ab * k_ac / k_bc``. All triplets are pooled by their numbers of common items.
Votes are combined with the log-odds that these probabilities give.

Votes never meet at the driver: it receives counts for each pair of annotators, whose
number is checked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut, spread

#: Annotators whose pairs are counted; more is an error, since pairs grow with its square.
MAX_ANNOTATORS = 2000
#: Probability bounds, and the number of common votes at which a field's own estimate counts half.
LEAST, MOST, SHRINK = 0.01, 0.97, 30
#: Cosine below which a free text is none of the standard texts.
LEAST_COSINE = 0.35
FIELDS = ("severity", "claim", "refs")


# -- free texts to standard ones ---------------------------------------------------------


def _grams(text: str) -> list[str]:
    plain = " " + " ".join(re.findall(r"\w+", text.lower())) + " "
    return [plain[k : k + 3] for k in range(len(plain) - 2)]


class Matcher:
    """The standard text that a reworded, cut or mistyped text means, by weighted trigrams."""

    def __init__(self, forms: Sequence[tuple[int, str]]):
        self.ids = [number for number, _ in forms]
        sets = [set(_grams(text)) for _, text in forms]
        seen: dict[str, int] = {}
        for grams in sets:
            for g in grams:
                seen[g] = seen.get(g, 0) + 1
        self.weight = {g: float(np.log((1 + len(sets)) / n)) for g, n in seen.items()}
        self.unknown = float(np.log(1 + len(sets)))
        self.holders: dict[str, list[int]] = {}
        for k, grams in enumerate(sets):
            for g in grams:
                self.holders.setdefault(g, []).append(k)
        self.norms = [np.sqrt(sum(self.weight[g] ** 2 for g in grams)) for grams in sets]
        self.known: dict[str, int | None] = {}

    def __call__(self, text: str | None) -> int | None:
        if text is None:
            return None
        if text not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[text] = self._match(text)
        return self.known[text]

    def _match(self, text: str) -> int | None:
        scores, own = [0.0] * len(self.ids), 0.0
        for g in set(_grams(text)):
            w = self.weight.get(g)
            # what no standard text has is remarks and slips; it counts, but less
            own += 0.25 * self.unknown**2 if w is None else w * w
            for k in self.holders.get(g, ()):
                scores[k] += w * w
        if not own or not any(scores):
            return None
        cosines = [s / (n * np.sqrt(own)) if n else 0.0 for s, n in zip(scores, self.norms, strict=True)]
        best = max(range(len(cosines)), key=lambda k: (cosines[k], -self.ids[k]))
        return self.ids[best] if cosines[best] >= LEAST_COSINE else None


def votes(flags: DataFrame, forms: DataFrame, severities: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """One vote of each annotator (``source``) on each item: severity, claim (id), refs.

    A flag counts once however often it is delivered. Severities outside the scale and
    claims that mean no standard text are no votes. If someone flags an item several
    times, the most frequent value (the least of equals) and all labels count. Rows without item or source are
    left out.
    """
    rows = forms.filter("claim IS NOT NULL").orderBy("claim_id").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("standard texts are a fixed vocabulary of at most 10,000 entries")
    shared = flags.sparkSession.sparkContext.broadcast([(r.claim_id, r.claim) for r in rows])
    once = flags.filter("item_id IS NOT NULL AND source IS NOT NULL").select("flag_id", "item_id", "source", "severity", "claim", "refs").dropDuplicates(["flag_id", "item_id", "source"])
    matchers: list[Matcher] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not matchers:
            matchers.append(Matcher(shared.value))
        for batch in batches:
            ids = pa.array([matchers[0](text) for text in batch.column(3).to_pylist()], pa.int32())
            yield pa.record_batch([*batch.columns[:3], ids, batch.column(4)], names=["item_id", "source", "severity", "claim", "refs"])

    meant = spread(once.select("item_id", "source", "severity", "claim", "refs"), "item_id").mapInArrow(run, "item_id bigint, source string, severity int, claim int, refs array<string>")
    valid = F.when(F.col("severity").isin(*severities), F.col("severity"))
    return meant.groupBy("item_id", "source").agg(
        F.mode(valid, deterministic=True).alias("severity"),
        F.mode("claim", deterministic=True).alias("claim"),
        F.array_sort(F.array_compact(F.array_distinct(F.flatten(F.collect_set(F.coalesce("refs", F.array().cast("array<string>"))))))).alias("refs"),
    )


# -- agreement of pairs ------------------------------------------------------------------


def _same_group(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places in equal groups (sorted), by distance: memory stays linear."""
    for distance in range(1, len(group)):
        at = np.flatnonzero(group[distance:] == group[:-distance])
        if not len(at):
            return
        yield at, at + distance


def pair_counts(voted: DataFrame, annotators: Sequence[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each field: in how many votes two annotators meet, and in how many they agree.

    Items come together with at most one vote of each annotator. Every task adds its items
    up in one matrix, and only these matrices are summed.
    """
    place = {name: k for k, name in enumerate(annotators)}
    size = len(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = {f: np.zeros((size, size), dtype=np.int64) for f in FIELDS}
        same = {f: np.zeros((size, size), dtype=np.int64) for f in FIELDS}
        for batch in batches:
            lists = batch.column(0)
            group = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            flat = lists.flatten()
            who = np.array([place[s] for s in flat.field("source").to_pylist()], dtype=np.int64)
            for f in ("severity", "claim"):
                column = flat.field(f)
                has = np.flatnonzero(np.asarray(column.is_valid()))
                value = np.asarray(column.fill_null(0))[has]
                for a, b in _same_group(group[has]):
                    np.add.at(met[f], (who[has[a]], who[has[b]]), 1)
                    equal = value[a] == value[b]
                    np.add.at(same[f], (who[has[a[equal]]], who[has[b[equal]]]), 1)
            refs = flat.field("refs")
            named = np.asarray(refs.value_lengths().fill_null(0), dtype=np.int64)
            owner = np.repeat(np.arange(len(named)), named)
            labels = np.unique(np.array(refs.flatten().to_pylist(), dtype=object).astype(str), return_inverse=True)[1] if len(owner) else np.zeros(0, dtype=np.int64)
            offered = np.zeros(batch.num_rows, dtype=np.int64)
            if len(owner):
                offered += np.bincount(np.unique(np.stack([group[owner], labels], 1), axis=0)[:, 0], minlength=batch.num_rows)
            for a, b in _same_group(group):
                np.add.at(met["refs"], (who[a], who[b]), offered[group[a]])
                np.add.at(same["refs"], (who[a], who[b]), offered[group[a]] - named[a] - named[b])
            order = np.lexsort((labels, group[owner]))
            joint = group[owner][order] * (labels.max(initial=0) + 1) + labels[order]
            for a, b in _same_group(joint):
                np.add.at(same["refs"], (who[owner[order[a]]], who[owner[order[b]]]), 2)
        for k, f in enumerate(FIELDS):
            m, s = met[f] + met[f].T, same[f] + same[f].T
            a, b = np.nonzero(np.triu(m, 1))
            yield pa.record_batch([pa.array(np.full(len(a), k, dtype=np.int32)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(m[a, b]), pa.array(s[a, b])], names=["field", "a", "b", "met", "same"])

    items = voted.groupBy("item_id").agg(F.collect_list(F.struct("source", "severity", "claim", "refs")).alias("votes")).select("votes")
    counted = items.mapInArrow(run, "field int, a int, b int, met bigint, same bigint").groupBy("field", "a", "b").agg(F.sum("met").alias("met"), F.sum("same").alias("same"))
    out = {f: (np.zeros((size, size)), np.zeros((size, size))) for f in FIELDS}
    for r in counted.collect():  # at most 3 * MAX_ANNOTATORS^2 / 2 rows
        met, same = out[FIELDS[r.field]]
        met[r.a, r.b] = met[r.b, r.a] = r.met
        same[r.a, r.b] = same[r.b, r.a] = r.same
    return out


def triplets(met: np.ndarray, same: np.ndarray, chance: float) -> np.ndarray:
    """The probability of each annotator to know the value, from all triplets; NaN without any."""
    with np.errstate(divide="ignore", invalid="ignore"):
        kappa = np.where(met > 0, (same / met - chance) / (1 - chance), 0.0)
    weighted = met * kappa
    # the regression of k_ab k_ac on k_bc, weighted by the meetings of all three pairs
    over = np.einsum("ab,ba->a", weighted @ weighted, weighted)
    under = np.einsum("ab,ba->a", met @ (met * kappa**2), met)
    with np.errstate(divide="ignore", invalid="ignore"):
        squared = np.where(under > 0, over / under, np.nan)
    size = np.sqrt(np.clip(squared, 0, 1))
    # those who agree less with all others than chance would are no better than chance
    against = (weighted.sum(1) < 0) & ~np.isnan(size)
    size[against] = 0.0
    return size


# -- consensus ---------------------------------------------------------------------------


@dataclass
class Consensus:
    """``values``: item_id, field_name, field_value, score, agreement; ``annotators``: source, votes and reliabilities."""

    values: DataFrame
    annotators: DataFrame


def _shares(voted: DataFrame) -> dict[str, dict[int, float]]:
    """How often each severity and claim is given; both have few values."""
    out: dict[str, dict[int, float]] = {}
    for f in ("severity", "claim"):
        counts = {r[0]: r[1] for r in voted.filter(f"{f} IS NOT NULL").groupBy(f).count().collect()}
        total = sum(counts.values())
        out[f] = {k: n / total for k, n in counts.items()}
    return out


def _naming_rate(voted: DataFrame) -> float:
    """Share of the offered labels of an item that an annotator names."""
    labels = voted.select("item_id", F.explode("refs").alias("label"))
    offered = labels.distinct().groupBy("item_id").agg(F.count("*").alias("offered"))
    named = voted.groupBy("item_id").agg(F.count("*").alias("n"), F.sum(F.size("refs")).alias("named"))
    r = offered.join(named, "item_id").agg(F.sum("named").alias("named"), F.sum(F.col("offered") * F.col("n")).alias("of")).first()
    return r.named / r.of if r.of else 0.0


def agree(flags: DataFrame, forms: DataFrame) -> Consensus:
    """The consensus of each item and the reliability of each annotator.

    Each item has one severity and one claim if anyone gave one (ties: the smaller value)
    and every label that the greater part of the weight of its annotators names; naming
    none counts as a vote against. ``agreement`` is the share of the weight of an item's votes
    that its value has. An empty table gives empty results.
    """
    spark = flags.sparkSession
    voted = cut(votes(flags, forms))
    per = voted.groupBy("source").agg(F.count("*").alias("n"), F.count("severity").alias("n_severity"), F.count("claim").alias("n_claim")).orderBy("source").limit(MAX_ANNOTATORS + 1).collect()
    if len(per) > MAX_ANNOTATORS:
        raise ValueError(f"more than {MAX_ANNOTATORS} annotators")
    names = [r.source for r in per]
    counts = pair_counts(voted, names)
    shares = _shares(voted)
    rate = _naming_rate(voted)
    chance = {"severity": sum(p * p for p in shares["severity"].values()), "claim": sum(p * p for p in shares["claim"].values()), "refs": rate**2 + (1 - rate) ** 2}
    known, seen = {}, {}
    for f in FIELDS:
        met, same = counts[f]
        known[f] = triplets(met, same, min(chance[f], 0.999)) if names else np.zeros(0)
        seen[f] = met.sum(1)
    stacked = np.array([known[f] for f in FIELDS]).reshape(len(FIELDS), -1)
    trust = np.where(np.isnan(stacked), 0, np.array([seen[f] for f in FIELDS]).reshape(len(FIELDS), -1))
    middle = [np.average(row[~np.isnan(row)], weights=t[~np.isnan(row)] + 1e-9) if (~np.isnan(row)).any() else 0.5 for row, t in zip(stacked, trust, strict=True)]
    # a field with few meetings leans on how the annotator does in the others, relative to their average
    with np.errstate(invalid="ignore", divide="ignore"):
        relative = np.nansum(trust * np.nan_to_num(stacked) / np.array(middle)[:, None], axis=0) / np.maximum(trust.sum(0), 1e-9)
    relative = np.where(trust.sum(0) > 0, relative, 1.0)
    final = {}
    for k, f in enumerate(FIELDS):
        own, n = np.nan_to_num(stacked[k]), trust[k]
        final[f] = np.clip((n * own + SHRINK * middle[k] * relative) / (n + SHRINK), LEAST, MOST)

    rows = [(r.source, r.n, *[float(final[f][k]) for f in FIELDS], float(np.log((1 + final["refs"][k]) / (1 - final["refs"][k])))) for k, r in enumerate(per)]
    annotators = spark.createDataFrame(rows, "source string, n_votes bigint, severity_reliability double, claim_reliability double, refs_reliability double, refs_weight double")
    weights = []
    for f in ("severity", "claim"):
        for k, name in enumerate(names):
            for value, q in shares[f].items():
                w = final[f][k]
                weights.append((name, f, int(value), float(np.log((w + (1 - w) * q) / ((1 - w) * q)))))
    weight = spark.createDataFrame(pd.DataFrame(weights, columns=["source", "field_name", "value", "weight"]) if weights else [], "source string, field_name string, value int, weight double")
    prior = spark.createDataFrame([(f, int(v), float(np.log(q))) for f in ("severity", "claim") for v, q in shares[f].items()], "field_name string, value int, prior double")

    single = voted.select("item_id", "source", F.stack(F.lit(2), F.lit("severity"), "severity", F.lit("claim"), "claim").alias("field_name", "value")).filter("value IS NOT NULL")
    scored = single.join(weight, ["source", "field_name", "value"]).groupBy("item_id", "field_name", "value").agg(F.sum("weight").alias("weight"))
    scored = scored.join(prior, ["field_name", "value"])
    best = scored.groupBy("item_id", "field_name").agg(
        F.max_by(F.struct("value", "weight"), F.struct(F.round(F.col("weight") + F.col("prior"), 9), -F.col("value"))).alias("best"), F.sum("weight").alias("total")
    )
    chosen = best.select("item_id", "field_name", F.col("best.value").cast("string").alias("field_value"), F.col("best.weight").alias("score"), (F.col("best.weight") / F.col("total")).alias("agreement"))

    naming = voted.join(annotators.select("source", "refs_weight"), "source")
    total = naming.groupBy("item_id").agg(F.sum("refs_weight").alias("total"))
    labels = naming.select("item_id", "refs_weight", F.explode("refs").alias("field_value")).groupBy("item_id", "field_value").agg(F.sum("refs_weight").alias("score"))
    kept = labels.join(total, "item_id").filter(F.round(2 * F.col("score") - F.col("total"), 9) > 0)
    refs = kept.select("item_id", F.lit("refs").alias("field_name"), "field_value", "score", (F.col("score") / F.col("total")).alias("agreement"))
    return Consensus(chosen.unionByName(refs), annotators.drop("refs_weight"))
