"""Variant spellings of names of persons and organisations.

Every name and alias is brought to a form: accents, titles, legal forms and punctuation
are dropped and abbreviations written out. The distinct tokens of all forms are put into
tries, sharded by how they begin and end; each token traverses its shard with a
Levenshtein automaton and finds all tokens within a bounded distance, a swap of
neighbours counting as one edit. Rare tokens near a common one take its spelling. Forms
meet by their rarest token; whether they name one person or organisation is decided by
matching their tokens in any order, with initials, nicknames and acronyms. Records are
joined over the forms they bear.

Defined cases: null and blank names bear no form; null aliases are empty; forms with only
initials are linked if one person of that family fits and to nobody if several do; equal
names are one form, so a name borne by many records is compared once; deleted records
count; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinwork.session import cut, spread, tasks

# Words of a name that don't tell whom it means.
TITLES = set("dr prof professor mr mrs ms miss sir dame phd md msc bsc ma jr sr dipl ing ph d".split()) - {"d"}
LEGAL = set("ltd limited inc incorporated plc llc llp gmbh ag sa corp corporation co company kg nv bv spa srl ab oy as group holding holdings foundation trust".split())
STOP = set("the of for on and in at de la der die das und et y del des du".split())
# Abbreviations in names of organisations.
SHORT = {"dept": "department", "dep": "department", "cncl": "council", "lab": "laboratory", "labs": "laboratory", "univ": "university", "uni": "university",
         "eng": "engineering", "engg": "engineering", "comm": "commission", "commn": "commission", "comml": "commercial", "com": "commission", "ins": "insurance", "reins": "reinsurance",
         "assoc": "association", "assn": "association", "ass": "association", "inst": "institute", "ctr": "centre", "cent": "centre", "center": "centre", "cen": "centre", "sci": "science",
         "mgmt": "management", "mgt": "management", "natl": "national", "intl": "international", "govt": "government", "min": "ministry", "off": "office", "soc": "society", "svgs": "savings", "sav": "savings",
         "util": "utilities", "utils": "utilities", "exch": "exchange", "mut": "mutual", "stud": "studies", "fin": "finance", "reg": "regulation", "tech": "technology", "ptnrs": "partners", "ptrs": "partners", "bk": "bank",
         "cap": "capital", "econ": "economics", "obs": "observation", "hist": "history", "med": "medicine", "comp": "computational", "agcy": "agency", "res": "research", "wks": "works", "frt": "freight", "pwr": "power", "stl": "steel", "stats": "statistics", "stat": "statistics"}
ORG_WORDS = set("department council laboratory university engineering commission commercial insurance reinsurance association institute centre management ministry office society savings utilities exchange mutual studies bank partners lines works agency academy board bureau college school authority fund union federation company industries services".split())
# Short forms of given names, after the dropping of accents.
NICK = {"ted": "edward theodore", "teddy": "edward theodore", "ed": "edward edmund edwin", "eddie": "edward edwin", "ned": "edward", "theo": "theodore", "peggy": "margaret", "peg": "margaret", "maggie": "margaret", "meg": "margaret", "marge": "margaret", "margie": "margaret", "rita": "margaret", "greta": "margaret", "daisy": "margaret",
        "dick": "richard", "rick": "richard", "ricky": "richard", "rich": "richard", "richie": "richard", "beth": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "betty": "elizabeth", "betsy": "elizabeth", "eliza": "elizabeth", "lisa": "elizabeth", "libby": "elizabeth", "bess": "elizabeth", "elsie": "elizabeth", "lili": "elizabeth",
        "kathy": "katherine", "kate": "katherine", "katie": "katherine", "kitty": "katherine", "kat": "katherine", "kay": "katherine", "cathy": "katherine catherine", "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert", "bert": "robert albert", "bill": "william", "billy": "william", "will": "william", "willy": "william", "liam": "william",
        "chuck": "charles", "charlie": "charles", "chaz": "charles", "alex": "alexander alexandra", "sandy": "alexander alexandra", "sasha": "alexander alexandra", "al": "alexander albert", "xander": "alexander", "lex": "alexander", "ben": "benjamin", "benny": "benjamin", "benji": "benjamin", "jim": "james", "jimmy": "james", "jamie": "james", "jack": "john", "johnny": "john", "jon": "jonathan jonas", "joe": "joseph", "joey": "joseph", "jo": "joseph johannes",
        "mike": "michael", "mick": "michael", "mickey": "michael", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "dan": "daniel", "danny": "daniel", "dave": "david", "davy": "david", "sue": "susanna susan", "susie": "susanna susan", "suzy": "susanna susan", "susan": "susanna", "anna": "susanna", "sanna": "susanna", "hank": "henry", "harry": "henry harold", "hetty": "henrietta", "hettie": "henrietta", "nik": "nikolai", "rina": "ekaterina", "etta": "henrietta", "hattie": "henrietta", "henny": "henrietta", "netta": "henrietta",
        "fran": "francesca frances francis", "frankie": "francesca frances francis", "frank": "francis franklin", "chess": "francesca", "cesca": "francesca", "chesca": "francesca", "franca": "francesca", "francie": "francesca", "franny": "francesca", "gus": "augustus", "hans": "johannes", "jan": "johannes", "johann": "johannes", "nick": "nikolai nicholas", "nico": "nikolai nicholas", "kolya": "nikolai", "niko": "nikolai", "kolja": "nikolai", "katya": "ekaterina", "katia": "ekaterina", "katja": "ekaterina", "pepe": "giuseppe", "beppe": "giuseppe", "peppe": "giuseppe", "peppino": "giuseppe", "pino": "giuseppe",
        "dot": "dorothea dorothy", "dotty": "dorothea dorothy", "dolly": "dorothea dorothy", "dora": "dorothea", "thea": "dorothea", "dottie": "dorothea", "tilda": "matilda", "tilly": "matilda", "mattie": "matilda", "maud": "matilda", "sam": "samuel", "sammy": "samuel", "steve": "steven stephen", "pat": "patrick patricia", "patty": "patricia", "greg": "gregory", "andy": "andrew", "drew": "andrew", "matt": "matthew", "chris": "christopher christina", "kit": "christopher", "tina": "christina", "vicky": "victoria", "nell": "eleanor", "ellie": "eleanor", "nora": "eleanor", "larry": "lawrence", "lou": "louis louise", "ray": "raymond", "ron": "ronald", "walt": "walter", "zack": "zachary", "abby": "abigail", "becky": "rebecca", "debbie": "deborah", "jenny": "jennifer", "mandy": "amanda", "molly": "mary", "polly": "mary", "nan": "anne", "sally": "sarah", "sonny": "soren"}


def fold(text: str) -> str:
    """Lower case without accents."""
    t = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("đ", "d").replace("ı", "i"))
    return "".join(c for c in t if not unicodedata.combining(c)).lower()


_NICK = {fold(k): {fold(v) for v in vs.split()} for k, vs in NICK.items()}
_DOTTED = re.compile(r"(?<!\w)(?:[^\W\d_]\.\s?){1,6}(?!\w)|(?<!\w)(?:[^\W\d_]\.){2,6}")


def parse(raw: str | None) -> tuple[str, list[str], list[str], bool] | None:
    """(key, words, initials, code?) of a name; None if it names nobody.

    words are the telling words in folded form, initials single letters and blocks of
    capitals in their order; a code is a name that is only a sign.
    """
    t = unicodedata.normalize("NFKC", raw or "").replace("_", " ")
    t = re.sub(r"[​-‏­﻿]", "", t)
    t = " ".join(t.split())
    if not any(c.isalnum() for c in t):
        return None
    bare = re.sub(r"[^\w]", "", t)
    if re.fullmatch(r"[A-Za-z]{2,7}[ -][0-9A-Z]{1,3}", t) or (re.search(r"\d", t) and len(bare) <= 10):
        return "code:" + fold(t).replace("-", " "), [], [], True
    t = re.sub(r"(?i)\bph\.?\s?d\b\.?", " ", t)
    all_caps = t.upper() == t and any(len(w) > 3 for w in re.findall(r"\w+", t))
    words, initials = [], []
    for part in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*\.?(?:[^\W\d_]\.)*|\d+|&", t):
        if part == "&":
            continue
        letters = part.replace(".", "")
        dotted = part.count(".") >= 2 or (len(letters) == 1)
        f = fold(letters.replace("'", "").replace("’", ""))
        if dotted or (not all_caps and letters.isupper() and 2 <= len(letters) <= 6):
            if f in TITLES or (f in LEGAL and len(f) > 2):
                continue
            initials += list(letters.lower()) if letters.isascii() else list(f)
            continue
        f = SHORT.get(f, f)
        if f in TITLES or f in LEGAL or f in STOP or not f:
            continue
        words.append(f)
    if not words and not initials:
        return None
    return " ".join(sorted(words)) + "|" + "".join(initials), words, initials, False


def neighbours(query: str, trie: dict, bound: int) -> list[tuple[str, int]]:
    """All words of the trie within bound edits of query, by its Levenshtein automaton.

    A state of the automaton is the part of a row of the edit table that lies within bound
    of the diagonal; a branch of the trie is left as soon as no entry is within the bound.
    Swaps of neighbours are one edit.
    """
    out: list[tuple[str, int]] = []
    n, width, far = len(query), 2 * bound + 1, bound + 1
    # entry t of a state at depth d stands for the first d - bound + t signs of the query
    first = [t - bound if t >= bound else far for t in range(width)]
    stack: list[tuple[dict, int, list[int], list[int] | None, str]] = [(trie, 0, first, None, "")]
    while stack:
        node, depth, row, before, last = stack.pop()
        if "" in node:
            t = n - depth + bound
            if 0 <= t < width and row[t] <= bound:
                out.append((node[""], row[t]))
        low = depth + 1 - bound
        for ch, child in node.items():
            if ch == "":
                continue
            new, best, left = [], far, far
            for t in range(width):
                j = low + t
                if j < 0 or j > n:
                    left = far
                else:
                    left += 1
                    if j and (c := row[t] + (query[j - 1] != ch)) < left:
                        left = c
                    if t + 1 < width and (c := row[t + 1] + 1) < left:
                        left = c
                    if before is not None and j > 1 and query[j - 1] == last and query[j - 2] == ch and (c := before[t] + 1) < left:
                        left = c
                    if left > far:
                        left = far
                new.append(left)
                if left < best:
                    best = left
            if best <= bound:
                stack.append((child, depth + 1, new, row, ch))
    return out


def build_trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    return root


def edit_bound(n: int) -> int:
    return 0 if n < 4 else 1 if n < 9 else 2


def token_neighbours(tokens: DataFrame, per_group: int = 2000) -> DataFrame:
    """(token, other, d): distinct tokens within the bound of each other.

    Tokens that begin or end alike share a shard; short ones need two letters for that,
    long ones three, and those in between stand in both kinds. A shard of more than per_group tokens is
    asked by several groups, each with a part of the questions.
    """
    n = F.length("token")
    shards = F.array_compact(F.array(*[
        F.when((n <= 8) if k == 2 else (n >= 8), F.concat(F.lit(f"{sign}{k}"), part))
        for k in (2, 3) for sign, part in (("^", F.substring("token", 1, k)), ("$", F.expr(f"right(token, {k})")))
    ]))
    rows = tokens.filter(n >= 4).select("token", F.explode(shards).alias("shard")).distinct()
    sizes = rows.groupBy("shard").agg(F.ceil(F.count("*") / per_group).cast("int").alias("n_parts"))
    rows = rows.join(sizes, "shard")
    asked = rows.select("shard", (F.abs(F.xxhash64("token")) % F.col("n_parts")).cast("int").alias("part"), "token", F.lit(True).alias("asks"))
    held = rows.select("shard", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"), "token", F.lit(False).alias("asks"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        trie = build_trie(list(pdf.loc[~pdf["asks"], "token"]))
        out = [(q, w, d) for q in pdf.loc[pdf["asks"], "token"] for w, d in neighbours(q, trie, edit_bound(len(q))) if w != q]
        return pd.DataFrame(out, columns=["token", "other", "d"])

    return asked.unionByName(held).repartition(tasks(tokens), "shard", "part").groupBy("shard", "part").applyInPandas(run, "token string, other string, d int").distinct()


def _given_sets(words: list[str]) -> list[set[str]]:
    return [{w} | _NICK.get(w, set()) for w in words]


def cluster_block(forms: list[tuple[str, list[str], str]], anchor: str) -> list[int]:
    """Cluster number of each form (key, words in common spelling, initials) that shares the anchor word."""
    n = len(forms)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(i: int, j: int) -> None:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)

    rest = [sorted(w for k, w in enumerate(words) if w != anchor or words.index(w) != k) for _, words, _ in forms]
    org = [any(w in ORG_WORDS for w in r) or len(r) >= 3 for r in rest]
    # organisations: the same words in any order
    by_words: dict[tuple, int] = {}
    for i in range(n):
        if org[i]:
            j = by_words.setdefault(tuple(rest[i]), i)
            union(i, j)
    # acronyms: capitals that spell the words of one organisation of this place, with one letter more at most
    spelt: dict[tuple, set[int]] = defaultdict(set)
    for j in range(n):
        if org[j]:
            spelt[tuple(sorted([anchor[0], *(w[0] for w in rest[j])]))].add(j)
    for i in range(n):
        if not org[i] and not rest[i] and len(forms[i][2]) >= 3:
            letters = sorted(forms[i][2])
            for shorter in ({tuple(letters)}, {tuple(letters[:k] + letters[k + 1 :]) for k in range(len(letters))}):
                best = {find(j) for k in shorter for j in spelt.get(k, ())}
                if best:
                    if len(best) == 1:
                        union(i, best.pop())
                    break
    # persons with a given name; middle initials must not differ. Groups are found by their given names and all these stand for
    full = [i for i in range(n) if not org[i] and len(rest[i]) >= 1]
    groups: list[dict] = []
    by_given: dict[str, set[int]] = defaultdict(set)
    by_head: dict[str, dict[int, None]] = defaultdict(dict)

    def known(at: int, given: set[str]) -> None:
        for x in set().union(*_given_sets(sorted(given))):
            by_given[x].add(at)
            by_head[x[0]][at] = None

    for i in sorted(full, key=lambda i: (any(w in _NICK for w in rest[i]), len(forms[i][2]) == 0, -len(rest[i]), forms[i][0])):
        given, middle = set(rest[i]), set(forms[i][2])
        fits = []
        for at in sorted({g for x in set().union(*_given_sets(sorted(given))) for g in by_given.get(x, ())}):
            g = groups[at]
            mine, theirs = sorted((_given_sets(sorted(given)), _given_sets(sorted(g["given"]))), key=len)
            same = all(any(a & b for b in theirs) for a in mine)
            if same and not (middle and g["middle"] and not (middle & g["middle"])):
                fits.append((not given & g["given"], at))
        exact = [at for ne, at in fits if not ne]
        fits_ = exact or [at for _, at in fits]
        if len(fits_) == 1:
            g = groups[fits_[0]]
            union(i, g["at"])
            g["given"] |= given
            g["middle"] |= middle
            known(fits_[0], given)
        elif not fits_:
            groups.append({"given": given, "middle": middle, "at": i})
            known(len(groups) - 1, given)
        elif exact and not middle:
            union(i, groups[exact[0]]["at"])
    # initials only: the one person whose given name begins so, by the first initial or else by the second
    only = [i for i in range(n) if not org[i] and not rest[i] and forms[i][2] and find(i) == i]
    for i in only:
        ini = forms[i][2]
        first: list[int] = []
        for a in range(min(2, len(ini))):
            others = set(ini[:a] + ini[a + 1 :])
            for at in by_head.get(ini[a], ()):
                if not (others and groups[at]["middle"] and not (others & groups[at]["middle"])):
                    first.append(at)
                    if len(first) > 1:
                        break
            if first:
                break
        if len(first) == 1:
            union(i, groups[first[0]]["at"])
    loose: dict[str, list[int]] = defaultdict(list)
    for i in only:
        if find(i) == i:
            loose[forms[i][2][0]].append(i)
    for head, same in loose.items():
        if len(same) > 1 and len({forms[j][2][1:] for j in same if len(forms[j][2]) > 1}) <= 1 and head not in by_head:
            for i in same:
                union(i, same[0])
    return [find(i) for i in range(n)]


def name_clusters(records: DataFrame, least_ratio: float = 8.0) -> DataFrame:
    """(ord, cluster): records of one person or organisation share the cluster.

    A token takes the spelling of a neighbour that stands in least_ratio times as many
    forms, whatever their numbers; in one or two forms, of any that is at least as common.
    Short forms of given names and words of organisations are no misspellings.
    """
    ord_type = records.schema["ord"].dataType.simpleString()
    raw = spread(records.select("ord", F.explode(F.array_distinct(F.array_compact(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))))).alias("raw"), "name"))
    schema = "key string, words array<string>, initials string, code boolean, variant boolean"

    def to_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for o, r, name in zip(b["ord"], b["raw"], b["name"]):
                p = parse(r)
                if p is None:
                    continue
                key, words, initials, code = p
                out.append((o, r == name, key, words, "".join(initials), code, False))
                if r == name and 2 < len(words) <= 4 and not any(w in ORG_WORDS for w in words):
                    for i in range(len(words) - 1):  # a blank inside a word
                        joined = [*words[:i], words[i] + words[i + 1], *words[i + 2 :]]
                        out.append((o, True, " ".join(sorted(joined)) + "|" + "".join(initials), joined, "".join(initials), False, True))
            yield pd.DataFrame(out, columns=["ord", "is_name", "key", "words", "initials", "code", "variant"])

    borne = cut(raw.mapInPandas(to_forms, f"ord {ord_type}, is_name boolean, {schema}"))
    forms = cut(borne.groupBy("key").agg(F.first("words").alias("words"), F.first("initials").alias("initials"), F.min("code").alias("code"), F.min("variant").alias("variant")))
    tokens = forms.filter("NOT code").select("variant", F.explode(F.array_distinct("words")).alias("token"))
    df = cut(tokens.groupBy("token").agg(F.sum(F.when(F.col("variant"), 0).otherwise(1)).alias("df")))
    near = cut(token_neighbours(df))
    # the common spelling of a rare token, and how common its spelling is
    given = sorted(set(_NICK) | {v for vs in _NICK.values() for v in vs} | ORG_WORDS)
    other = df.select(F.col("token").alias("other"), F.col("df").alias("df_other"))
    best = (
        near.join(df, "token").join(other, "other")
        .filter(((F.col("df") <= 2) & ((F.col("df_other") > F.col("df")) | ((F.col("df_other") == F.col("df")) & (F.col("other") < F.col("token"))))) | ((F.col("df") > 2) & (F.col("df_other") >= least_ratio * F.col("df"))))
        .filter((F.col("df_other") > 0) & ~F.col("token").isin(given))
        .groupBy("token").agg(F.max(F.struct((-F.col("d")).alias("d"), "df_other", "other")).alias("b"))
        .select("token", F.col("b.other").alias("spelt"), F.col("b.df_other").alias("df_spelt"))
    )
    best = cut(best)
    # a spelling may have a better one itself
    again = best.select(F.col("token").alias("spelt"), F.col("spelt").alias("spelt2"), F.col("df_spelt").alias("df2"))
    best = best.join(again, "spelt", "left").select("token", F.coalesce("spelt2", "spelt").alias("spelt"), F.greatest("df_spelt", F.coalesce("df2", F.lit(0))).alias("df_spelt"))
    spelling = df.join(best, "token", "left").select(
        "token", F.coalesce("spelt", "token").alias("spelt"), F.greatest("df", F.coalesce("df_spelt", F.lit(0))).alias("df_spelt")
    ).withColumn("df_spelt", F.when(F.col("spelt").isin(given), 1 << 40).otherwise(F.col("df_spelt")).cast("bigint"))
    spelling = cut(spelling)
    placed = forms.filter("NOT code AND size(words) > 0").select("key", "initials", F.posexplode("words").alias("pos", "token")).join(spelling, "token")
    with_anchor = cut(placed.groupBy("key", "initials").agg(
        F.sort_array(F.collect_list(F.struct("pos", "spelt"))).alias("ws"),
        F.min(F.when(F.length("spelt") >= 4, F.struct("df_spelt", (-F.length("spelt")).alias("l"), "spelt"))).alias("a"),
    ).select("key", "initials", F.col("ws.spelt").alias("words"), F.coalesce("a.spelt", F.col("ws.spelt")[0]).alias("anchor")))
    # blanks inside words count only where the joined word is known from elsewhere
    known = df.filter("df > 0").select(F.col("token").alias("anchor"))
    variants = forms.filter("variant").select("key")
    plain = with_anchor.join(variants, "key", "left_anti").unionByName(with_anchor.join(variants, "key", "left_semi").join(known, "anchor", "left_semi"))

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        forms_ = [(k, list(w), i) for k, w, i in zip(pdf["key"], pdf["words"], pdf["initials"])]
        ids = cluster_block(forms_, pdf["anchor"].iloc[0])
        return pd.DataFrame({"key": pdf["key"].values, "cluster": [forms_[i][0] for i in ids]})

    clusters = plain.repartition(tasks(plain), "anchor").groupBy("anchor").applyInPandas(resolve, "key string, cluster string").unionByName(
        forms.filter("code OR size(words) = 0").select("key", F.col("key").alias("cluster"))
    )
    # an alias of initials or capitals only is no bridge to other records
    bridges = borne.filter("is_name OR code OR size(words) >= 2").select("ord", "key", "is_name").distinct()
    held = cut(bridges.join(cut(clusters), "key").select("ord", "cluster").distinct())
    return _joined(held)


def _joined(held: DataFrame) -> DataFrame:
    """Records with clusters in common, directly or over others, get the least cluster of all.

    Only clusters that stand together in some record are looked at again; labels move
    over them until none changes, with a durable cut after each round.
    """
    pairs = held.groupBy("ord").agg(F.min("cluster").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    edges = cut(held.join(pairs, "ord").filter("cluster <> a").select("a", F.col("cluster").alias("b")).distinct())
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("cluster"), F.least("a", "m").alias("label")))
    while True:
        moved = both.join(labels, both.b == labels.cluster).groupBy("a").agg(F.min("label").alias("m"))
        new = labels.join(moved, labels.cluster == moved.a, "left").select("cluster", F.least("label", F.coalesce("m", "label")).alias("label"), (F.coalesce(F.col("m") < F.col("label"), F.lit(False))).alias("changed"))
        # pointer jump: the label of the label
        hop = new.select(F.col("cluster").alias("c2"), F.col("label").alias("l2"))
        new = cut(new.join(hop, new.label == hop.c2, "left").select("cluster", F.least("label", F.coalesce("l2", "label")).alias("label"), (F.col("changed") | F.coalesce(F.col("l2") < F.col("label"), F.lit(False))).alias("changed")))
        labels = new.drop("changed")
        if new.filter("changed").limit(1).count() == 0:
            break
    return held.join(labels, "cluster", "left").groupBy("ord").agg(F.min(F.coalesce("label", "cluster")).alias("cluster"))


def same_entity_pairs(clusters: DataFrame) -> DataFrame:
    """(ord_a, ord_b), ord_a < ord_b: every pair of records of one cluster."""
    several = clusters.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1").select("cluster")
    c = clusters.join(several, "cluster", "left_semi")
    a, b = c.select("cluster", F.col("ord").alias("ord_a")), c.select("cluster", F.col("ord").alias("ord_b"))
    return a.join(b, "cluster").filter("ord_a < ord_b").select("ord_a", "ord_b")
