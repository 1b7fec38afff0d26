"""Best representative of each duplicate group.

Two operators share the grouping of records by type and comparison name:

* dominant_records names, field by field, the record that is at least as complete, as
  recent and as trusted as every other and better than each in one of these.
* fused_fields builds one surviving record by Bayesian fusion: source accuracies and
  copying between sources are estimated from the values they share, who copies whom from
  who had them first; copied votes are discounted, and the value of greatest posterior
  is kept.

Defined cases: records without a name or with a deletion moment stand in no group;
a null loaded_at is older than all others, and says nothing on copying; an unknown or null extractor has trust 0;
null arrays count as empty; NaN confidence is outside 0..1; a group of one record
gives no row; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinwork.functions.names import name_key
from veinwork.session import bounded, broadcast_if_small

# Observations that say nothing, compared in lower case after trimming.
EMPTY_WORDS = ["", "-", "--", "---", "?", "??", "???", ".", "..", "...", "…", "–", "—", "n/a", "na", "n.a.", "nan", "none", "null", "nil",
               "tbd", "tba", "todo", "to do", "unknown", "unspecified", "not available", "not applicable", "missing",
               "empty", "undefined", "xxx", "x", "fixme"]
FIELDS = ["observations", "provenance", "code_anchors", "confidence"]


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x{200b}\x{feff}]+|[\s\x{200b}\x{feff}]+$", "")


def says_something(c: Column) -> Column:
    t = F.lower(trimmed(c))
    return c.isNotNull() & ~t.isin(EMPTY_WORDS) & t.rlike(r"[\p{L}\p{N}]")


def _non_blank(c: Column) -> Column:
    return c.isNotNull() & (trimmed(c) != "")


def usable_observations(c: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), says_something), trimmed))


def usable_provenance(c: Column) -> Column:
    return F.array_distinct(F.filter(c, lambda p: p.isNotNull() & _non_blank(p.document)))


def usable_anchors(c: Column) -> Column:
    return F.array_distinct(F.filter(c, lambda a: a.isNotNull() & _non_blank(a.repo) & _non_blank(a.path)))


def usable_confidence(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c <= 1), c)


def _size(c: Column) -> Column:
    return F.when(c.isNull(), 0).otherwise(F.size(c))


def live_members(entities: DataFrame, extractors: DataFrame) -> DataFrame:
    """One row for each record that may stand in a group, with its trust."""
    trust = broadcast_if_small(extractors.select(F.col("extracted_by").alias("by"), "trust").filter("by IS NOT NULL").groupBy("by").agg(F.max("trust").alias("trust")))
    members = entities.filter("deleted_at IS NULL").select(
        "ord", "entity_type", name_key(F.col("name")).alias("key"), "loaded_at", "extracted_by",
        usable_observations(F.col("observations")).alias("observations"),
        usable_provenance(F.col("provenance")).alias("provenance"),
        usable_anchors(F.col("code_anchors")).alias("code_anchors"),
        usable_confidence(F.col("confidence")).alias("confidence"),
    ).filter("key IS NOT NULL AND key <> ''")
    return members.join(trust, members.extracted_by == trust.by, "left").drop("by").withColumn("trust", F.coalesce("trust", F.lit(0)))


def dominant_records(entities: DataFrame, extractors: DataFrame) -> DataFrame:
    """(group_ord, field, ord): the record that dominates its group in each field.

    A record dominates all others exactly if it alone has the greatest completeness,
    the latest loaded_at and the greatest trust, so bounded aggregates suffice: no group
    is gathered anywhere, and each is reduced before it is shuffled.
    """
    m = live_members(entities, extractors).select(
        "ord", "entity_type", "key",
        F.coalesce(F.col("loaded_at").cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).alias("at"), "trust",
        _size(F.col("observations")).alias("observations"), _size(F.col("provenance")).alias("provenance"),
        _size(F.col("code_anchors")).alias("code_anchors"), F.col("confidence").isNotNull().cast("int").alias("confidence"),
    )
    aggs = [F.min("ord").alias("group_ord"), F.count("*").alias("n")]
    for f in FIELDS:
        left = F.col(f) > 0
        rank = F.struct(F.col(f).alias("c"), "at", "trust")
        aggs += [
            F.max(F.when(left, F.struct(rank.alias("r"), F.col("ord").alias("o")))).alias(f"{f}_hi"),
            F.max(F.when(left, F.struct(rank.alias("r"), (-F.col("ord")).alias("o")))).alias(f"{f}_lo"),
            F.max(F.when(left, F.col("at"))).alias(f"{f}_at"),
            F.max(F.when(left, F.col("trust"))).alias(f"{f}_trust"),
        ]
    groups = m.groupBy("entity_type", "key").agg(*aggs).filter("n > 1")
    picks = []
    for f in FIELDS:
        hi, lo = F.col(f"{f}_hi"), F.col(f"{f}_lo")
        wins = (hi.r["at"] == F.col(f"{f}_at")) & (hi.r["trust"] == F.col(f"{f}_trust")) & (hi.o == -lo.o)
        picks.append(F.when(wins, F.struct(F.lit(f).alias("field"), hi.o.alias("ord"))))
    return groups.select("group_ord", F.explode(F.array_compact(F.array(*picks))).alias("p")).select("group_ord", "p.field", "p.ord")


def _claims(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_ord, src, field, single, item, at): one vote of a source for a value and its first moment; votes of one source count once."""
    json = F.to_json
    items = F.array(
        F.struct(F.lit("observations").alias("field"), F.col("observations").alias("items"), F.lit(False).alias("single")),
        F.struct(F.lit("provenance").alias("field"), F.transform("provenance", lambda p: json(p)).alias("items"), F.lit(False).alias("single")),
        F.struct(F.lit("code_anchors").alias("field"), F.transform("code_anchors", lambda p: json(p)).alias("items"), F.lit(False).alias("single")),
        F.struct(F.lit("confidence").alias("field"), F.when(F.col("confidence").isNotNull(), F.array(F.format_string("%.3f", "confidence"))).alias("items"), F.lit(True).alias("single")),
    )
    return (
        members.join(groups, ["entity_type", "key"])
        .select("group_ord", F.coalesce("extracted_by", F.lit("(none)")).alias("src"), "loaded_at", F.explode(items).alias("i"))
        .select("group_ord", "src", "loaded_at", "i.field", "i.single", F.explode("i.items").alias("item"))
        .groupBy("group_ord", "src", "field", "single", "item")
        .agg(F.min("loaded_at").alias("at"))
    )


def _orders(claims: DataFrame) -> DataFrame:
    """(early, late, n): on how many values that both list the one source was before the other."""
    told = F.collect_list(F.when(F.col("at").isNotNull(), F.struct("src", "at"))).alias("told")
    pairs = F.flatten(F.transform("told", lambda a: F.transform(F.filter("told", lambda b: b["at"] > a["at"]), lambda b: F.struct(a["src"].alias("early"), b["src"].alias("late")))))
    return claims.groupBy("group_ord", "field", "item").agg(told).select(F.explode(pairs).alias("p")).groupBy("p.early", "p.late").agg(F.count("*").alias("n"))


def fused_fields(entities: DataFrame, extractors: DataFrame, rounds: int = 12, copy_prior: float = 0.1, copy_rate: float = 0.8, n_false: int = 20, most_patterns: int = 200_000) -> DataFrame:
    """(group_ord, field, item, posterior, n_sources): the values kept for the surviving record.

    Array fields keep every item more likely true than false; confidence keeps its one
    most likely value. The model has one row for each source and one for each pair of
    sources. Sources are extractors, a fixed list, so both are a few rows. More than
    most_patterns distinct patterns of votes, which takes many sources, are a ValueError.
    """
    members = live_members(entities, extractors)
    groups = members.groupBy("entity_type", "key").agg(F.min("ord").alias("group_ord"), F.count("*").alias("n")).filter("n > 1").drop("n")
    claims = _claims(members, groups).persist()
    cell = ["group_ord", "field", "item"]
    # one row for each distinct value: the sources that vote for it, at most one entry a source
    votes = claims.groupBy(*cell, "single").agg(F.sort_array(F.collect_set("src")).alias("srcs"))
    # the same pattern of sources recurs, so the model is fitted on counts of patterns
    asked = claims.groupBy("group_ord", "field").agg(F.sort_array(F.collect_set("src")).alias("asked"))
    cells = votes.join(asked, ["group_ord", "field"])
    fits, rows = bounded(cells.groupBy("srcs", "asked", "single").agg(F.count("*").alias("n")), most_patterns)
    if not fits:
        raise ValueError(f"more than {most_patterns} patterns of votes")
    patterns = [(tuple(r.srcs), tuple(r.asked), r.single, r["n"]) for r in rows]
    sources = sorted({s for _, asked_, _, _ in patterns for s in asked_})
    earlier = {(r.early, r.late): r["n"] for r in _orders(claims).collect()}  # one row for each pair of sources at most
    model = fit_sources(patterns, sources, rounds, copy_prior, copy_rate, n_false, earlier)
    posts = {(srcs, asked_, single): _posterior(srcs, asked_, model, copy_rate, n_false, single) for srcs, asked_, single, _ in patterns}
    spark = entities.sparkSession
    schema = "srcs array<string>, asked array<string>, single boolean, posterior double"
    table = broadcast_if_small(spark.createDataFrame([(list(a), list(b), c, float(p)) for (a, b, c), p in posts.items()] or [], schema))
    scored = cells.join(table, ["srcs", "asked", "single"]).withColumn("n_sources", F.size("srcs"))
    many = scored.filter("NOT single AND posterior >= 0.5").select(*cell, "posterior", "n_sources")
    one = (
        scored.filter("single")
        .groupBy("group_ord", "field")
        .agg(F.max(F.struct("posterior", "n_sources", "item")).alias("b"))
        .select("group_ord", "field", "b.item", "b.posterior", "b.n_sources")
    )
    return many.unionByName(one)


def _weight(srcs: tuple, m: SourceModel, copy_rate: float, n_false: int) -> float:
    """Sum of log odds of the voters, each discounted by what it may have copied from one before it."""
    total, seen = 0.0, []
    for s in m.originals_first(srcs, m.acc):
        independent = math.prod(1 - copy_rate * m.copies.get(tuple(sorted((s, o))), 0.0) for o in seen)
        total += independent * math.log(n_false * m.acc[s] / (1 - m.acc[s]))
        seen.append(s)
    return total


def _posterior(srcs: tuple, asked: tuple, m: SourceModel, copy_rate: float, n_false: int, single: bool) -> float:
    """Probability that an item is true, given who lists it and who was asked.

    In a field of one value each voter is for its value and against all others. In a field
    of many the first voter's accuracy is the prior; each further voter counts by how much
    likelier it lists a true item than a false one, which is next to nothing if it copies,
    and each silent one by what it leaves out of the true ones.
    """
    silent = tuple(s for s in asked if s not in srcs)
    if single:
        odds = _weight(srcs, m, copy_rate, n_false) - math.log(n_false) - _weight(silent, m, copy_rate, n_false) / 2
    else:
        def tied(s: str, to: list[str]) -> float:
            return copy_rate * max((m.copies.get(tuple(sorted((s, o))), 0.0) for o in to), default=0.0)

        first, *others = m.originals_first(srcs, m.acc)
        odds, seen = math.log(m.acc[first] / (1 - m.acc[first])), [first]
        for s in others:
            c = tied(s, seen)
            odds += math.log((c + (1 - c) * m.recall[s]) / (c + (1 - c) * m.wrong(s, n_false)))
            seen.append(s)
        quiet: list[str] = []
        for s in m.originals_first(silent, m.recall):
            c = 1 - tied(s, quiet)  # who copies a silent one is silent with it
            odds += math.log((1 - c * m.recall[s]) / (1 - c * m.wrong(s, n_false)))
            quiet.append(s)
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))


@dataclass
class SourceModel:
    """Accuracy of each source, the share of true items it lists, and for each pair the probability that one copies the other.

    copier has for each ordered pair the probability that it is the first of the two who
    copies, given that one does. The values don't show it, since a copy of most of a list
    looks alike from both sides; the moments do, since a copy comes after its original.
    """

    acc: dict[str, float]
    recall: dict[str, float]
    copies: dict[tuple[str, str], float] = field(default_factory=dict)
    copier: dict[tuple[str, str], float] = field(default_factory=dict)

    def originals_first(self, srcs: tuple, worth: dict[str, float]) -> list[str]:
        """The sources, copiers after those they copy; where copying or its direction is open, the better before the worse."""
        if not self.copier:
            return sorted(srcs, key=lambda s: (-worth[s], s))

        def copied(s: str) -> float:
            return round(sum(self.copies.get(tuple(sorted((s, o))), 0.0) * (2 * self.copier.get((s, o), 0.5) - 1) for o in srcs if o != s), 6)

        return sorted(srcs, key=lambda s: (copied(s), -worth[s], s))

    def wrong(self, s: str, n_false: int) -> float:
        """How likely the source lists a given false item by itself."""
        return max(1e-3, (1 - self.acc[s]) / n_false)


def fit_sources(patterns: list, sources: list, rounds: int, copy_prior: float, copy_rate: float, n_false: int, earlier: dict | None = None) -> SourceModel:
    """Accuracies, shares of true items listed and copying of sources, from counts of vote patterns.

    A field of one value shows copying by agreement, most of all on a false value. In a
    field of many values sources leave out much that is true, so a pair is judged by what
    one of them does with the other's items: an independent source lists a true one as
    often as it lists any true item, and a false one hardly ever; a copier lists most of
    both. Accuracies are taken from posteriors that discount copied votes.

    earlier has for pairs of sources on how many shared values the first was before the
    second. A copied value comes after its original, others come in any order. The order
    tells who copies if one does, not whether: some sources are late in everything.
    """
    earlier = earlier or {}
    late = math.log((1 + copy_rate) / (1 - copy_rate))  # log odds that one value which a source has later says it's the copier
    copier = {(a, b): 1 / (1 + math.exp(-max(-40.0, min(40.0, late * (earlier.get((b, a), 0) - earlier.get((a, b), 0)))))) for a, b in {q for p in earlier for q in (p, p[::-1])}}
    m = SourceModel(dict.fromkeys(sources, 0.5), dict.fromkeys(sources, 0.5))  # from below, since trust in what only copies say confirms itself
    for _ in range(rounds):
        right, votes = dict.fromkeys(sources, 1.0), dict.fromkeys(sources, 2.0)
        listed, could = dict.fromkeys(sources, 1.0), dict.fromkeys(sources, 2.0)  # true items listed, and those it was asked for
        same: dict = {}  # one value: [shared true, shared false, different]
        took: dict = {}  # many values, by (copier, original): [listed true, listed false, left out true, left out false]
        for srcs, asked, single, n in patterns:
            p = _posterior(srcs, asked, m, copy_rate, n_false, single)
            for s in srcs:
                right[s] += n * p
                votes[s] += n
            for s in asked:
                if not single:
                    could[s] += n * p
                    listed[s] += n * p * (s in srcs)
            for i, a in enumerate(asked):
                for b in asked[i + 1 :] if single else [x for x in asked if x != a]:
                    if single:
                        c = same.setdefault(tuple(sorted((a, b))), [0.0, 0.0, 0.0])
                        if a in srcs and b in srcs:
                            c[0] += n * p
                            c[1] += n * (1 - p)
                        elif a in srcs or b in srcs:
                            c[2] += n
                    elif b in srcs:  # what a does with b's items
                        c = took.setdefault((a, b), [0.0, 0.0, 0.0, 0.0])
                        at = 0 if a in srcs else 2
                        c[at] += n * p
                        c[at + 1] += n * (1 - p)
        acc = {s: min(0.99, max(0.05, right[s] / votes[s])) for s in sources}
        m = SourceModel(acc, {s: min(0.95, max(0.05, listed[s] / could[s])) for s in sources}, copier=copier)
        for i, a in enumerate(sources):
            for b in sources[i + 1 :]:
                mean = (acc[a] + acc[b]) / 2
                both_false = (1 - mean) ** 2 / n_false
                _, f, d = same.get(tuple(sorted((a, b))), (0.0, 0.0, 0.0))
                # agreement on what is true says nothing: two good sources agree too
                one = f * math.log(((1 - mean) * copy_rate + both_false * (1 - copy_rate)) / both_false) + d * math.log(1 - copy_rate)
                odds = {}
                for x, y in ((a, b), (b, a)):
                    lt, lf, mt, mf = took.get((x, y), (0.0,) * 4)
                    q, wrong = m.recall[x], m.wrong(x, n_false)
                    many = lt * math.log((copy_rate + (1 - copy_rate) * q) / q) + lf * math.log((copy_rate + (1 - copy_rate) * wrong) / wrong) + (mt + mf) * math.log(1 - copy_rate)
                    odds[x, y] = math.log(copy_prior / 2 / (1 - copy_prior)) + one + many
                top = max(0.0, *odds.values())
                total = math.exp(-top) + sum(math.exp(v - top) for v in odds.values())
                m.copies[tuple(sorted((a, b)))] = sum(math.exp(v - top) for v in odds.values()) / total
    return m
