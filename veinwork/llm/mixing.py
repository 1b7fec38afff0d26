"""Mixing sources to target weights.

Token weights are raked by iterative proportional fitting so that sources reach their
target shares while languages and topics keep their own (or given) ones; documents are
then sampled with their calibrated number of copies, by sequential Poisson sampling with
a threshold that is set from a histogram, so that each source meets its size without
being sorted or gathered anywhere.

The size of the mixture is the largest at which every source that has documents can give
its share within max_repeats (or a given size). Defined cases: null and blank texts have
no tokens and are not drawn; spellings of a source are brought to one form; documents of
sources without target are not drawn; targets without documents are reported with share
0 and the others are scaled over the sources that are there; null max_repeats is 1; equal
rows are drawn alike; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinwork.llm.tokenizer import DEFAULT_DIR, token_counts
from veinwork.session import bounded

#: Buckets of the histograms that place a source's sampling threshold.
BUCKETS = 4096


def source_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"[\s-]+", "_"))


def language_key(c: Column) -> Column:
    """Two-letter language; 'und' where it is missing or in no known form."""
    two = F.lower(F.regexp_extract(F.trim(c), r"^([A-Za-z]{2})(?:[-_].*)?$", 1))
    return F.when(c.isNull() | (two == ""), "und").otherwise(two)


def rake(cells: dict[tuple[str, str, str], float], caps: dict[str, float], by_source: dict[str, float], by_lang: dict[str, float], by_topic: dict[str, float], rounds: int = 60) -> dict[tuple[str, str, str], float]:
    """Weights (copies) of cells (source, language, topic) by iterative proportional fitting.

    cells has tokens; margins are tokens wanted. Sources are fitted last in each round and
    weights never pass the source's cap; what a capped cell can't give the others of its
    source give.
    """
    w = {k: 1.0 for k in cells}

    def fit(axis: int, want: dict[str, float]) -> None:
        have: dict[str, float] = defaultdict(float)
        for k, t in cells.items():
            have[k[axis]] += t * w[k]
        total, wanted = sum(have.values()), sum(v for a, v in want.items() if have.get(a))
        for k in cells:
            if have[k[axis]] and want.get(k[axis]) is not None:
                w[k] *= want[k[axis]] / wanted * total / have[k[axis]] if axis else want[k[axis]] / have[k[axis]]

    for _ in range(rounds):
        fit(1, by_lang)
        fit(2, by_topic)
        fit(0, by_source)
        for _ in range(20):
            over = {k for k in cells if w[k] > caps[k[0]]}
            if not over:
                break
            for s in {k[0] for k in over}:
                own = [k for k in cells if k[0] == s]
                for k in own:
                    w[k] = min(w[k], caps[s])
                fixed = sum(cells[k] * w[k] for k in own if w[k] >= caps[s])
                free = sum(cells[k] * w[k] for k in own if w[k] < caps[s])
                if free <= 0:
                    continue
                up = max(0.0, (by_source[s] - fixed) / free)
                for k in own:
                    if w[k] < caps[s]:
                        w[k] *= up
    return {k: min(v, caps[k[0]]) for k, v in w.items()}


def sized_documents(docs: DataFrame, topics: DataFrame | None, folder: str = DEFAULT_DIR, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens) of every document that has tokens."""
    counts = token_counts(docs.filter("text IS NOT NULL AND trim(text) <> ''"), "doc_id", "text", tokenizer, folder)
    rows = docs.select("doc_id", source_key(F.col("source")).alias("source"), language_key(F.col("lang")).alias("lang")).join(counts, "doc_id")
    if topics is not None:
        # all subjects of a document together, so that keeping the shares of these keeps the share of each subject
        one = topics.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("subject")), "+").alias("topic"))
        rows = rows.join(one, "doc_id", "left")
    else:
        rows = rows.withColumn("topic", F.lit(None).cast("string"))
    return rows.withColumn("topic", F.coalesce("topic", F.lit("none"))).filter("n_tokens > 0")


def mixture(docs: DataFrame, targets: DataFrame, topics: DataFrame | None = None, total_tokens: float | None = None, folder: str = DEFAULT_DIR, most_languages: int = 100, most_topics: int = 1000, most_sources: int = 20_000, most_cells: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, n_tokens, copies), report): drawn documents and the shares reached.

    The driver sees one row for each target and for each cell of source, language and
    topic, the topic being all subjects of a document together; languages and topics beyond
    the stated numbers of most frequent ones share the cell 'other'. More than most_sources
    targets or most_cells cells are a ValueError, so that nothing is left out unsaid.
    """
    spark = docs.sparkSession
    goal = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source IS NOT NULL AND target_share > 0")
    fits, found = bounded(goal.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")), most_sources)
    if not fits:
        raise ValueError(f"more than {most_sources} sources with a target")
    goals = {r.source: (float(r.target_share), float(r.max_repeats if r.max_repeats is not None else 1)) for r in found}
    sized = sized_documents(docs, topics, folder).join(F.broadcast(goal.select("source").distinct()), "source", "left_semi")
    sized = sized.persist(StorageLevel.MEMORY_AND_DISK)
    for col, most in (("lang", most_languages), ("topic", most_topics)):
        top = [r[0] for r in sized.groupBy(col).agg(F.sum("n_tokens").alias("n")).orderBy(F.desc("n"), col).limit(most).collect()]
        sized = sized.withColumn(col, F.when(F.col(col).isin(top), F.col(col)).otherwise("other"))
    fits, rows = bounded(sized.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("t")), most_cells)
    if not fits:
        raise ValueError(f"more than {most_cells} cells of source, language and topic")
    cells = {(r.source, r.lang, r.topic): float(r.t) for r in rows}
    tokens: dict[str, float] = defaultdict(float)
    for (s, _, _), t in cells.items():
        tokens[s] += t
    share_sum = sum(goals[s][0] for s in tokens)
    shares = {s: goals[s][0] / share_sum for s in tokens}
    size = total_tokens or min((tokens[s] * goals[s][1] / shares[s] for s in tokens), default=0.0)
    caps = {s: goals[s][1] for s in tokens}
    want = {s: min(size * shares[s], tokens[s] * caps[s]) for s in tokens}
    lang: dict[str, float] = defaultdict(float)
    topic: dict[str, float] = defaultdict(float)
    for (_, l, p), t in cells.items():
        lang[l] += t
        topic[p] += t
    weights = rake(cells, caps, want, lang, topic)
    schema = "source string, lang string, topic string, weight double, cap double"
    table = spark.createDataFrame([(*k, w, caps[k[0]]) for k, w in weights.items()] or [], schema)
    # whole copies are given to all; the rest goes to those with the smallest rank u/p, up to the size wanted
    u = (F.xxhash64("doc_id") % F.lit(1 << 52)).cast("double")
    u = (F.when(u < 0, u + float(1 << 52)).otherwise(u) + 0.5) / float(1 << 52)
    ranked = (
        sized.join(F.broadcast(table) if len(weights) <= 200_000 else table, ["source", "lang", "topic"])
        .withColumn("whole", F.floor(F.col("weight") + 1e-9))
        .withColumn("part", F.greatest(F.lit(0.0), F.col("weight") - F.col("whole")))
        .withColumn("rank", F.when((F.col("part") > 1e-9) & (F.col("whole") < F.col("cap")), u / F.col("part")))
        .withColumn("bucket", F.floor(F.least(F.col("rank") / 4, F.lit(0.9999)) * BUCKETS).cast("int"))
    )
    per_bucket = ranked.groupBy("source", "bucket").agg(F.sum(F.when(F.col("bucket").isNotNull(), F.col("n_tokens"))).alias("t"), F.sum(F.col("n_tokens") * F.col("whole")).alias("whole_t"))
    sums = per_bucket.groupBy("source").agg(F.sum("whole_t").alias("given"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    goal_rows = spark.createDataFrame([(s, v) for s, v in want.items()] or [], "source string, want double")
    limits = (
        per_bucket.filter("bucket IS NOT NULL").withColumn("upto", F.sum("t").over(upto))
        .join(sums, "source").join(goal_rows, "source")
        .filter(F.col("upto") - F.col("t") / 2 <= F.col("want") - F.col("given"))
        .groupBy("source").agg(F.max("bucket").alias("last"))
    )
    drawn = (
        ranked.join(limits, "source", "left")
        .withColumn("copies", (F.col("whole") + F.when(F.col("bucket") <= F.col("last"), 1).otherwise(0)).cast("int"))
        .filter("copies > 0")
        .select("doc_id", "source", "lang", "topic", "n_tokens", "copies")
    )
    by_source = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    report = (
        goal.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        .join(have, "source", "left").join(by_source, "source", "left")
        .withColumn("all_tokens", F.sum("mixed_tokens").over(Window.partitionBy()))  # one row for each target
        .select(
            "source", "target_share", "max_repeats",
            *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("source_tokens", "mixed_tokens", "n_docs", "most_copies")],
            F.round(F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("reached_share"),
        )
    )
    return drawn, report
