"""Resolution of entities that stand under several names, in the order of their records.

Candidate pairs come from joins that lose none: equal names, names that are aliases, and
names that share enough of their signs. Records of one connected block are then replayed in
order; blocks are independent of each other, so the replay gives what one pass over all
records would give.

Defined cases: records without a name are left out; null aliases are empty; records that
repeat name, type and aliases of an earlier one follow it; an empty table gives empty
results; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinwork.functions.matching import bigram_bits, close_pairs, code_points, count_bits, length_bound, sequence_ratios
from veinwork.operators.graph import components, renamed_relations
from veinwork.session import tasks


def _statistics(names: DataFrame, steps: int) -> list[tuple[int, int]]:
    """(sign, k): the counts 'a name has the sign at least k times' that divide the names most evenly, counted over all names."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for x in batches:
            for name in x["name"]:
                n.update((ord(c), min(k, 8)) for c, k in Counter(name).items())
        if n:
            yield pd.DataFrame([(c, k, v) for (c, k), v in n.items()], columns=["c", "k", "n"])

    total, having = names.count(), Counter()
    for r in names.mapInPandas(count, "c bigint, k bigint, n bigint").groupBy("c", "k").agg(F.sum("n").alias("n")).collect():
        having.update({(r.c, k): r.n for k in range(1, r.k + 1)})
    return sorted(having, key=lambda x: (abs(2 * having[x] - total), x))[:steps]


def _near(both: DataFrame, apart: Callable[[int, int], int], finish: Callable[[list[str], list[str]], pd.DataFrame], schema: str, steps: int, most: int = 4096) -> DataFrame:
    """What finish makes of lists a and b: at least all pairs of a left and a right name that share all but apart(length, length) of their signs; apart is negative for lengths that never pass.

    both has name and side (1 left, 2 right, 3 both). Names of one length and side form
    blocks of about most names; each two blocks whose lengths can pass are compared by
    bits of their signs, all with all.
    """
    spark = both.sparkSession
    bits = _statistics(both, steps)
    named = both.select("name", "side", F.length("name").alias("length"))
    sizes = named.groupBy("side", "length").agg(F.ceil(F.count("*") / most).alias("parts"))
    named = named.join(sizes, ["side", "length"]).withColumn("part", F.pmod(F.xxhash64("name"), "parts"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"side": pdf["side"][:1], "length": pdf["length"][:1], "names": [zlib.compress("".join(pdf["name"]).encode("utf-32-le"), 1)]})

    packed = named.groupBy("side", "length", "part").applyInPandas(pack, "side int, length int, names binary").collect()
    blocks = sorted((r.length, r.side, bytes(r.names)) for r in packed)
    todo = [(i, j) for i, x in enumerate(blocks) for j, y in enumerate(blocks[i:], i) if apart(x[0], y[0]) >= 0 and (x[1] | y[1]) == 3]
    shared = spark.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        @lru_cache(32)
        def unpacked(i: int) -> tuple[list[str], tuple]:
            length, _, names = shared.value[i]
            text = zlib.decompress(names).decode("utf-32-le")
            names = [text[k : k + length] for k in range(0, len(text), length)] if length else [""]
            codes = code_points(names)
            return names, (codes[:, :length], count_bits(codes, bits), bigram_bits(codes))

        for x in batches:
            for i, j in zip(x["i"].tolist(), x["j"].tolist()):
                (na, a), (nb, b) = unpacked(i), unpacked(j)
                y, z = close_pairs(a, b, apart(shared.value[i][0], shared.value[j][0]))
                if i == j:
                    y, z = y[y <= z], z[y <= z]
                pairs = [(na[p], nb[q]) for p, q in zip(y.tolist(), z.tolist())]
                ways = [pairs] if shared.value[i][1] & 1 and shared.value[j][1] & 2 else []
                if shared.value[j][1] & 1 and shared.value[i][1] & 2:
                    ways.append([(q, p) for p, q in pairs if i != j or p != q])
                rows = [p for way in ways for p in way]
                if rows:
                    yield finish([p for p, _ in rows], [q for _, q in rows])

    ids = spark.createDataFrame(pd.DataFrame(todo, columns=["i", "j"], dtype="int64"), "i bigint, j bigint")
    return ids.repartition(min(max(1, len(todo)), 4 * tasks(both)), F.xxhash64("i", "j")).mapInPandas(run, schema)


def _sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, side): distinct names of both, 1 left, 2 right, 3 both."""
    named = lambda d, x: d.select("name", F.lit(x).alias("side")).filter("name IS NOT NULL").distinct()
    return named(left, 1).unionByName(named(right, 2)).groupBy("name").agg(F.sum("side").cast("int").alias("side")).persist(StorageLevel.MEMORY_AND_DISK)


def similar_names(left: DataFrame, right: DataFrame, threshold: float = 0.85, ranked: int = 128) -> DataFrame:
    """(a, b, score) of distinct names left.name and right.name with a ratio of at least threshold; exact.

    Pairs that can't share enough signs are left out by ranked bits of their counts, by
    bits of their bigrams and by their longest common subsequence; the others are scored.
    """

    def apart(la: int, lb: int) -> int:
        return int((1 - threshold) * (la + lb) + 1e-9) if 2 * min(la, lb) >= threshold * (la + lb) - 1e-9 else -1

    def score(a: list[str], b: list[str]) -> pd.DataFrame:
        out = pd.DataFrame({"a": a, "b": b, "score": sequence_ratios(a, b)})
        return out[out["score"] >= threshold]

    return _near(_sides(left, right), apart, score, "a string, b string, score double", ranked)


def _beginnings(entities: DataFrame) -> DataFrame:
    """(name, entity_type, words): distinct lower-case names with the first three letters of their words."""
    words = F.array_distinct(F.filter(F.transform(F.split("name", " "), lambda w: F.substring(w, 1, 3)), lambda w: w != ""))
    return entities.filter("name IS NOT NULL AND entity_type IS NOT NULL").select(F.lower("name").alias("name"), "entity_type").distinct().withColumn("words", words)


def name_blocking_pairs(entities: DataFrame, threshold: float = 0.85, chunk: int = 500) -> DataFrame:
    """(a, b, entity_type): pairs of different lower-case names of one type, a < b, whose lengths may pass the threshold and that share a word's first three letters.

    A pair is made once, at the most frequent beginning that it shares; names of one
    beginning are compared in chunks, so that no task has all of a frequent one.
    """
    key = ["entity_type", "w"]
    keyed = _beginnings(entities).select("name", "entity_type", F.explode("words").alias("w"))
    sizes = keyed.groupBy(*key).agg(F.count("*").alias("n"))
    # the beginnings of a name in falling frequency; before: those that come first
    ranked = keyed.join(sizes, key).groupBy("name", "entity_type").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "w"))).alias("ws"))
    ranked = ranked.select("name", "entity_type", F.length("name").alias("l"), F.posexplode("ws").alias("at", "x"), "ws")
    ranked = ranked.select("name", "entity_type", "l", F.col("x.w").alias("w"), F.ceil(-F.col("x.n") / chunk).alias("parts"), F.transform(F.slice("ws", 1, F.col("at")), lambda x: x.w).alias("before"))
    ends = lambda x: [F.col("name").alias(x), F.col("l").alias(f"l{x}"), F.col("before").alias(f"before_{x}")]
    few = ranked.select(*key, F.pmod(F.xxhash64("name"), "parts").alias("part"), *ends("a"))
    all_of = ranked.select(*key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), *ends("b"))
    n = 4 * tasks(entities)
    pairs = all_of.repartition(n, *key, "part").join(few.repartition(n, *key, "part"), [*key, "part"])
    fits = (2 * F.least("la", "lb") >= threshold * (F.col("la") + F.col("lb"))) & (F.col("a") < F.col("b"))
    first = (F.size("before_a") == 0) | (F.size("before_b") == 0) | ~F.arrays_overlap("before_a", "before_b")
    return pairs.filter(fits & first).select("a", "b", "entity_type")


def edited_pairs(entities: DataFrame, share: float = 0.15, threshold: float = 0.85) -> DataFrame:
    """Pairs of name_blocking_pairs whose edit distance is at most share of the longer name; only names that share enough signs are paired."""

    def apart(la: int, lb: int) -> int:
        return 2 * int(share * max(la, lb) + 1e-9) - abs(la - lb)

    def ordered(a: list[str], b: list[str]) -> pd.DataFrame:
        return pd.DataFrame([(x, y) for x, y in zip(a, b) if x < y], columns=["a", "b"], dtype=str)

    n = _beginnings(entities)
    near = _near(_sides(n, n), apart, ordered, "a string, b string", 128).filter(F.levenshtein("a", "b") <= share * F.greatest(F.length("a"), F.length("b")))
    a, b = (n.select(F.col("name").alias(x), "entity_type", F.col("words").alias(f"words_{x}")) for x in "ab")
    return near.join(a, "a").join(b, ["b", "entity_type"]).filter(F.arrays_overlap("words_a", "words_b") & length_bound(F.col("a"), F.col("b"), threshold)).select("a", "b", "entity_type")


def _forms(entities: DataFrame) -> DataFrame:
    """One row for each distinct name, type and aliases, with its first ord."""
    aliases = F.array_sort(F.array_distinct(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.isNotNull())))
    return entities.filter("name IS NOT NULL").groupBy("name", "entity_type", aliases.alias("aliases")).agg(F.min("ord").alias("ord"))


def replay(rows: list[tuple[int, str, str | None, list[str], list[str]]]) -> list[tuple[int, int]]:
    """(ord, ord of its entity) of records (ord, name, type, aliases, near) in order: the first entity that matches takes the record.

    A record matches an entity by name and type, by an alias of either, or by a ratio of
    names of one type; its name and aliases become aliases of the entity. near has the
    lower-case names of which an entity of the type takes the record by ratio.
    """
    resolved: list[tuple[int, str]] = []
    typed: dict[tuple[str | None, str], int] = {}
    heads: dict[str, int] = {}
    known: dict[str, int] = {}
    out = []
    for o, name, kind, aliases, near in sorted(rows, key=lambda r: r[0]):
        low, own = name.lower(), {a.lower() for a in aliases}
        found = [typed.get((kind, low)), known.get(low), *(heads.get(a) for a in own), *(typed.get((kind, n)) for n in near)]
        at = min((x for x in found if x is not None), default=None)
        if at is None:
            at = len(resolved)
            resolved.append((o, name))
            typed[kind, low] = at
            heads.setdefault(low, at)
        elif name != resolved[at][1]:
            own.add(low)
        for a in own:
            known[a] = min(known.get(a, at), at)
        out.append((o, resolved[at][0]))
    return out


def resolved_records(entities: DataFrame, threshold: float = 0.85, most_forms: int = 1_000_000) -> DataFrame:
    """(ord, entity_ord): for each record the first record of the entity it belongs to.

    A block of more than most_forms distinct names, types and aliases is a ValueError, since
    its records are replayed in one task, in time linear in them and their similar names.
    """
    forms = _forms(entities).persist(StorageLevel.MEMORY_AND_DISK)
    low = forms.select(F.lower("name").alias("name"), "entity_type").distinct()
    names = low.select("name").distinct()
    by_alias = forms.select(F.lower("name").alias("source"), F.explode("aliases").alias("t")).select("source", F.lower("t").alias("target")).distinct()
    by_alias = by_alias.join(names.withColumnRenamed("name", "target"), "target", "left_semi").filter("source <> target").select("source", "target")
    fuzzy = similar_names(names, names, threshold).filter("a <> b")
    t = lambda c: low.select(F.col("name").alias(c), F.col("entity_type").alias(f"t{c}"))
    fuzzy = fuzzy.join(t("a"), "a").join(t("b"), "b").filter(F.col("ta").eqNullSafe(F.col("tb"))).select(F.col("a").alias("source"), F.col("b").alias("target")).distinct().persist(StorageLevel.MEMORY_AND_DISK)
    blocks = components(by_alias.unionByName(fuzzy), names)
    near = fuzzy.groupBy(F.col("source").alias("low")).agg(F.collect_list("target").alias("near"))
    placed = forms.withColumn("low", F.lower("name")).join(blocks.withColumnRenamed("name", "low"), "low").join(near, "low", "left")
    placed = placed.select("component", "ord", "name", "entity_type", "aliases", F.coalesce("near", F.array().cast("array<string>")).alias("near")).persist(StorageLevel.MEMORY_AND_DISK)
    large = placed.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > most_forms).limit(1).collect()
    if large:
        raise ValueError(f"a block of {large[0]['n']} forms around {large[0]['component']!r}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(o), n, k if isinstance(k, str) else None, list(a), list(x)) for o, n, k, a, x in zip(pdf["ord"], pdf["name"], pdf["entity_type"], pdf["aliases"], pdf["near"])]
        return pd.DataFrame(replay(rows), columns=["first_ord", "entity_ord"])

    # no record matches one of another block, so many blocks are replayed at once
    bucket = F.pmod(F.xxhash64("component"), F.lit(tasks(placed)))
    done = placed.groupBy(bucket.alias("bucket")).applyInPandas(run, "first_ord bigint, entity_ord bigint")
    aliases = F.array_sort(F.array_distinct(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.isNotNull())))
    keyed = entities.filter("name IS NOT NULL").select("ord", F.col("name").alias("n"), F.col("entity_type").alias("k"), aliases.alias("a"))
    match = (F.col("n") == F.col("name")) & F.col("k").eqNullSafe(F.col("entity_type")) & (F.col("a") == F.col("aliases"))
    own = keyed.join(forms.withColumnRenamed("ord", "first_ord"), match)
    return own.join(done, "first_ord").select("ord", "entity_ord")


def resolve_entities(entities: DataFrame, threshold: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(entities, renames): one row for each resolved entity, and (old, new) names.

    An entity keeps the name, type, confidence and abstractness of its first record and
    takes all aliases, observations, provenance and anchors, sorted, and the other names.
    """
    placed = resolved_records(entities, threshold).persist(StorageLevel.MEMORY_AND_DISK)
    rows = entities.join(placed, "ord")
    heads = entities.select(F.col("ord").alias("entity_ord"), F.col("name").alias("head"))
    rows = rows.join(heads, "entity_ord")
    keep = [c for c in ("name", "entity_type", "confidence", "abstract") if c in entities.columns]
    out = rows.groupBy("entity_ord").agg(F.min_by(F.struct(*keep), "ord").alias("f"), F.count("*").alias("n_records")).select(F.col("entity_ord").alias("ord"), "f.*", "n_records")
    lists = [c for c in ("aliases", "observations", "provenance", "code_anchors", "citation_anchors") if c in entities.columns]
    for c in lists:
        items = rows.select("entity_ord", F.explode(c).alias("v")).filter("v IS NOT NULL")
        if c == "aliases":
            items = items.unionByName(rows.filter("name <> head").select("entity_ord", F.col("name").alias("v")))
        out = out.join(items.groupBy(F.col("entity_ord").alias("ord")).agg(F.array_sort(F.collect_set("v")).alias(c)), "ord", "left")
        out = out.withColumn(c, F.coalesce(c, F.array().cast(entities.schema[c].dataType)))
    renames = rows.filter("ord <> entity_ord").groupBy(F.col("name").alias("old")).agg(F.max_by("head", "ord").alias("new")).filter("old <> new")
    return out, renames


def resolve_relations(relations: DataFrame, renames: DataFrame) -> DataFrame:
    """Relations between resolved names: no self loops, the first of each (source, target, type)."""
    return renamed_relations(relations, renames)


def merge_graphs(entities: list[DataFrame], relations: list[DataFrame], threshold: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of several graphs, resolved; of one name one entity remains, the first.

    Records count in the order of the graphs, then of their ord.
    """
    def together(frames: list[DataFrame]) -> DataFrame:
        out = None
        for i, f in enumerate(frames):
            f = f.withColumn("ord", F.col("ord") + F.lit(i).cast("bigint") * F.lit(1 << 40))
            out = f if out is None else out.unionByName(f, allowMissingColumns=True)
        return out

    found, renames = resolve_entities(together(entities), threshold)
    from veinwork.operators.graph import merged_entities

    return merged_entities(found), resolve_relations(together(relations), renames)
